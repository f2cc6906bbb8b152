import pytest
from pyspark.sql import functions as F

from corpusmill.operators import search as S
from corpusmill.operators.vector import hashed_bag_of_words


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [("IPC:300", "Murder", "murder is culpable homicide with intention"), ("IPC:302", "Punishment for murder", "whoever commits murder shall be punished with death"), ("BNS:103", "Punishment for murder", "punishment of murder under the new code"), ("BNS:101", "Murder", "culpable homicide is murder if done with intention"), ("CrPC:313", "Power to examine the accused", "the court may question the accused"), ("IPC:378", "Theft", "whoever takes property dishonestly commits theft")]
    st = spark.createDataFrame([(s, s.replace(":", "_"), s.split(":")[0], t, x) for s, t, x in rows], "section_id string, chunk_id string, act string, title string, text string").withColumn("embedding", hashed_bag_of_words(F.col("text")))
    jd = spark.createDataFrame([("J1", "K1", ["IPC:302"], "convicted of murder and sentenced"), ("J2", None, ["IPC:378"], "theft of property was proved")], "chunk_id string, case_id string, legal_references array<string>, text string").withColumn("embedding", hashed_bag_of_words(F.col("text")))
    q = spark.createDataFrame([(1, "Punishment for murder under Section 302 or BNS 103"), (2, "question the accused CRPC 313"), (3, "who takes property")], "query_id int, query_text string").withColumn("query_vec", hashed_bag_of_words(F.col("query_text")))
    e = spark.createDataFrame([("IPC:302", "BNS:103", "CORRESPONDS_TO"), ("IPC:300", "BNS:101", "CORRESPONDS_TO"), ("IPC:302", "IPC:300", "REFERS_TO"), ("IPC:302", "C:murder", "DISCUSSES")], "src string, dst string, type string")
    n = spark.createDataFrame([(x, "Section", x) for x, *_ in rows] + [("C:murder", "Concept", "murder")], "id string, label string, name string")
    return q, st, jd, e, n


@pytest.mark.parametrize("fused", [False, True])
def test_research(corpus, fused):
    q, st, jd, e, n = corpus
    laws, cases = S.research(q, st, jd, e, n, fused=fused)
    top = {(r.query_id, r["rank"]): r.section_id for r in laws.collect()}
    assert {top[(1, 1)], top[(1, 2)]} == {"BNS:103", "IPC:302"} and top[(2, 1)] == "CrPC:313"
    boosts = {(r.query_id, r.chunk_id): r.boost_applied for r in cases.collect()}
    assert boosts[(1, "J1")] == 0.5 and boosts[(1, "J2")] == 0.0


def test_without_graph(corpus):
    q, st, jd, *_ = corpus
    laws, none = S.research(q, st, None)
    assert none is None and laws.where("query_id = 2 and rank = 1").first().section_id == "CrPC:313"
    base, _ = S.plain(q, st, jd)
    again, _ = S.plain(q, st, jd, bulk=True)
    assert sorted(map(str, base.select("query_id", "section_id", "rank", "rrf_score").collect())) == sorted(map(str, again.select("query_id", "section_id", "rank", "rrf_score").collect()))
    assert base.groupBy("query_id").count().where("count = 3").count() == 3


def test_compare_cards_and_answers(corpus):
    q, st, jd, e, n = corpus
    added = S.compare(q, st, e, n, k=1)
    assert {r.query_id for r in added.collect()} <= {1, 2, 3}
    laws, cases = S.research(q, st, jd, e, n)
    card = S.provision_cards(laws).where("query_id = 2 and rank = 1").first()
    assert (card.act, card.section, card.title) == ("CrPC", "313", "Power to examine the accused")
    assert S.judgment_cards(cases).where("source_id = 'J2'").first().case_id == "Unknown case"
    out = {r.query_id: r for r in S.ask(q, st, jd, e, n).collect()}
    assert out[1].sources and not out[1].out_of_scope
    related = q.select("query_id", F.lit("IPC:300, BNS:999,IPC:302").alias("related"))
    assert [(r.pos, r.section_id) for r in S.related_cards(related, st).where("query_id = 1").orderBy("pos").collect()] == [(0, "IPC:300"), (2, "IPC:302")]


def test_triage_and_admin(corpus):
    q, st, jd, e, n = corpus
    got = {r.section_id for r in S.triage(q.where("query_id = 1"), st, e, n).collect()}
    assert "BNS:103" in got and not any(x.startswith(("IPC", "CrPC")) for x in got)
    assert S.stats(statutes=st, judgments=jd) == {"statutes": 6, "judgments": 2}
    assert S.exists(st, "section_id", "IPC:300") and not S.exists(st, "section_id", "IPC:1")
