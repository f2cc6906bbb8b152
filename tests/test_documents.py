import json

from pyspark.sql import functions as F

from corpusmill import schemas
from corpusmill.functions import rules
from corpusmill.operators import judgments as J
from corpusmill.operators import statutes as S
from corpusmill.sources.readers import json_files

HEADER = "[2025] 12 S.C.R. 77"


def pages(spark):
    p1 = ["Issue for Consideration", "Whether murder was proved.", "Headnotes", "Murder – proof – shown. [Paras 1, 2]", "JUDGMENT", "1. The appellant was convicted under Section 302 IPC.", "He appealed. The FIR was seen by (PW-"]
    p2 = [HEADER, "State v. Someone", "2. 5) who ran away.", "3. " + "A sentence about evidence here. " * 200, "Result of the case: dismissed", "Headnotes prepared by someone"]
    return spark.createDataFrame([("2025 INSC 1", 1, "\n".join(p1)), ("2025 INSC 1", 2, "\n".join(p2))], schemas.PAGES)


def test_judgment(spark):
    lines = J.clean_lines(pages(spark)).cache()
    assert HEADER not in {r.line for r in lines.collect()} and "State v. Someone" not in {r.line for r in lines.collect()}
    found = {r.section: r.text for r in J.sections(lines).collect()}
    assert set(found) == {"issue_for_consideration", "headnotes", "judgment"} and "Result" not in found["judgment"]
    paras = J.paragraphs(lines).cache()
    got = {r.paragraph_number: r for r in paras.collect()}
    assert sorted(got) == [1, 3] and got[1].page_end == 2 and "(PW-) who ran away." in got[1].text
    rows = J.judgment_chunks(paras, spark.createDataFrame([("2025 INSC 1", ["Sentence About v. X [2001] 1"])], "doc_id string, citations array<string>")).orderBy("chunk_id").collect()
    assert rows[0].chunk_id == "2025_INSC_1_JUDGMENT_001" and rows[0].legal_references == ["IPC:302"] and rows[0].source.paragraphs == [1]
    assert [r.source.sub_part for r in rows[1:]] == ["3-A", "3-B"] and all(r.token_count <= 1000 for r in rows)
    others = {r.chunk_type: r for r in J.section_chunks(J.sections(lines)).collect()}
    assert others["headnote"].related_paragraphs == [1, 2] and others["issue"].legal_concepts == ["LEGAL_CONCEPT:murder"] and "legal_topic" not in others
    r = J.extraction_report(J.sections(lines), ["headnotes", "acts_cited"]).first()
    assert r.missing == ["acts_cited"] and not r.passed


def test_case_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("x")).first().x
    assert one(J.normalised(F.lit("u/s 302 of IPC and s. 313 CrPC; Part II of Section 304 of the IPC; the FIR"))) == "under IPC Section 302 and CrPC Section 313 CrPC; IPC Section 304, Part II; the First Information Report (FIR)"
    assert one(J.cited_cases(F.lit(" A v. B. ; ; C  v. D"))) == ["A v. B", "C v. D"]
    m = J.metadata(spark.createDataFrame([("A versus B", "[X. Rao and Y, JJ.]", "Criminal Appeal No. 12 of 2020\nfrom the High Court of Madras at")], "title string, judge string, text string")).first()
    assert (m.title, m.judges, m.appeal_number, m.high_court) == ("A v. B", ["X. Rao", "Y"], "Criminal Appeal No. 12 of 2020", "Madras")
    a = J.case_analysis(spark.createDataFrame([("murder under Section 302 IPC",)], "text string")).first()
    assert (a.acts, a.provisions, a.offences) == (["IPC"], ["IPC:302"], ["LEGAL_CONCEPT:murder"])
    assert len(rules.JUDGMENT_REWRITES) == 71 and len(rules.GOLD_QUERIES) == 13


def test_statutes(spark, tmp_path):
    sec = {"section_id": "BNS:103", "section_number": "103", "title": "Murder", "text": "", "predecessor_act": "IPC:302", "successor_act": None, "subsections": [{"section_id": "BNS:103(1)", "subsection_number": "1", "text": "Whoever commits murder under sub-section"}, {"section_id": "x", "subsection_number": "9", "text": "(2) of section 101 dies."}, {"section_id": "y", "subsection_number": "2", "text": "Second one."}], "explanations": [{"label": "Explanation", "text": "One."}, {"label": "Explanation", "text": "two."}], "illustrations": [{"label": "", "text": "(a) A kills B."}], "exceptions": [], "provisos": [], "legal_concepts": ["murder"]}
    more = {**sec, "text": "Main text", "subsections": [], "explanations": [], "illustrations": [], "legal_concepts": []}
    bad = {**more, "section_id": "bad id", "text": " ", "title": None, "legal_concepts": ["odd"]}
    (tmp_path / "bns.json").write_text(json.dumps({"act": {"act_id": "BNS"}, "sections": [sec, more, bad]}, indent=1))
    raw = S.raw_sections(json_files(spark, str(tmp_path), schemas.ACT)).cache()
    whole = S.consolidated(raw).where("section_id = 'BNS:103'")
    chunk = S.chunks(whole).first()
    assert chunk.chunk_id == "BNS_103_SECTION_001" and chunk.source.subsections == ["1", "2"] and chunk.source.illustrations == ["a"]
    assert chunk.text.startswith("Section 103 - Murder Main text (1) Whoever commits murder under sub-section (2) of section 101 dies. (2) Second one. Explanation: One. two. Illustrations: (a) A kills B.")
    assert chunk.legal_references == ["BNS:101"] and chunk.legal_concepts == ["LEGAL_CONCEPT:murder"] and chunk.predecessor_references == ["IPC:302"] and chunk.successor_references == []
    found = sorted((r.at, r.severity, r.message) for r in S.findings(raw, ["murder"]).collect())
    assert found == [(0, "info", "no main text, but subsections"), (1, "issue", "section id is there already"), (1, "warning", "text seems cut off"), (2, "info", "other concept: odd"), (2, "issue", "no title"), (2, "warning", "no text at all"), (2, "warning", "unusual section id")]
    assert not S.summary(S.findings(raw)).first().valid
