"""The graph job: against brute force, rerun, shrinking input, odd rows and its command line."""

import json
import re
import subprocess
import sys
from pathlib import Path

import pytest

from jobs import graph_build as job

SETTINGS = {"name_chars": 10, "concepts": {"Digits": r"\d{3,}", "Email address": r"[a-z]+@[a-z]+"}}
DOCS = [(1, "Charged under IPC 302 and ipc 34a.", "s 1"), (2, "mail me: a@b or call 12345", "s-1"), (3, "same", "t"), (4, "same", "t"), (5, None, None), (None, "lost", "t"), (6, "same", "u"), (6, "same", "u"), (7, " ", "t"), (8, " ", "t")]
TURNS = [(1, 0, "user", "what is 4567"), (1, 1, "assistant", "same"), (1, 1, "assistant", "twice"), (2, 1000, "user", None)]


def write(spark, folder, docs, turns):
    spark.createDataFrame([(*d, "en") for d in docs], "doc_id long, text string, source string, lang string").write.mode("overwrite").parquet(f"{folder}/documents")
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.mode("overwrite").parquet(f"{folder}/conversations")


def run(spark, at):
    return job.run(spark, f"{at}/documents", f"{at}/conversations", f"{at}/out", **SETTINGS)


def whole(spark, at):
    nodes, edges = job.graph_tables(spark, f"{at}/out")
    return sorted(map(str, nodes.select("label", "id", "name").collect())), sorted(map(str, edges.select("type", "src", "dst").collect())), sorted(map(str, job.reports(spark, f"{at}/out").collect()))


def brute(docs, turns):
    rows = [(f"DOC_{i}", None if s is None else "SOURCE_" + re.sub("[^A-Za-z0-9_]+", "_", s), t) for i, t, s in docs if i is not None]
    rows += [(f"CONV_{c}_TURN_{n:03d}", f"CONV_{c}", t) for c, n, _, t in turns]
    edges, names = set(), {}
    for chunk, case, text in rows:
        text = text or ""
        if case:
            edges.add(("HAS_CHUNK", case, chunk))
            names.setdefault(("Case", case), None)
        key = ("Chunk", chunk)
        names[key] = min(text[:10], names.get(key) or text[:10]) if key in names else text[:10]
        for act, n in re.findall(r"(?i)(IPC)[\s]*(\d+[A-Za-z]?)", text):
            edges.add(("REFERS_TO", chunk, f"IPC:{n}"))
            names[("StatuteSection", f"IPC:{n}")] = None
        for pattern, concept, name in ((r"\d{3,}", "digits", "Digits"), (r"[a-z]+@[a-z]+", "email_address", "Email Address")):
            if re.search(pattern, text, re.I):
                edges.add(("DISCUSSES", chunk, f"LEGAL_CONCEPT:{concept}"))
                names[("LegalConcept", f"LEGAL_CONCEPT:{concept}")] = name
        first = min(c for c, _, t in rows if (t or "") == text)
        if text.strip() and first < chunk:
            edges.add(("SAME_TEXT", chunk, first))
    return names, edges


def test_against_brute_force(spark, tmp_path):
    write(spark, tmp_path, DOCS, TURNS)
    said = run(spark, tmp_path)
    names, want = brute(DOCS, TURNS)
    nodes, edges = job.graph_tables(spark, f"{tmp_path}/out")
    assert {(r.type, r.src, r.dst) for r in edges.collect()} == want and edges.count() == len(want)
    assert {(r.label, r.id): r.name for r in nodes.collect()} == names and nodes.count() == len(names)
    assert said == {"documents": 10, "turns": 4, "nodes": len(names), "edges": len(want), "repeated": 0, "dangling": 0, "unnamed": sum(not (n or "") for n in names.values())}
    concepts = {r.key: r.n for r in job.reports(spark, f"{tmp_path}/out").where("kind = 'concept_cases'").collect()}
    assert concepts == {"LEGAL_CONCEPT:digits": 2, "LEGAL_CONCEPT:email_address": 1}
    assert {p.name for p in Path(tmp_path, "out", "edges").iterdir() if p.is_dir()} == {f"type={t}" for t, *_ in want}


def test_running_again_gives_the_same(spark, tmp_path):
    write(spark, tmp_path, DOCS, TURNS)
    first = run(spark, tmp_path), whole(spark, tmp_path)
    assert (run(spark, tmp_path), whole(spark, tmp_path)) == first


def test_input_that_shrinks_leaves_nothing_behind(spark, tmp_path):
    write(spark, tmp_path, DOCS, TURNS)
    run(spark, tmp_path)
    write(spark, tmp_path, [(9, "plain", "v")], [(9, 0, "user", "words")])
    assert run(spark, tmp_path)["edges"] == 2
    assert {r.label for r in job.graph_tables(spark, f"{tmp_path}/out").nodes.collect()} == {"Case", "Chunk"}


def test_faults_are_told(spark):
    nodes = spark.createDataFrame([("a", "Case", None), ("c", "Chunk", "x"), ("c", "Chunk", "y")], "id string, label string, name string")
    edges = spark.createDataFrame([("a", "c", "HAS_CHUNK"), ("c", "gone", "REFERS_TO")], "src string, dst string, type string")
    got = {(r.kind, r.key): r.n for r in job.report(nodes, edges).collect()}
    assert got[("repeated", "Chunk")] == got[("dangling", "REFERS_TO")] == got[("unnamed", "Case")] == 1


def test_many_copies_make_one_edge_each(spark):
    rows = spark.range(3000).selectExpr("format_string('C%05d', id) as chunk_id", "'case' as case_id", "if(id % 3 = 0, 'hot', cast(id as string)) as text")
    same = job.same_texts(rows)
    assert same.count() == 999 and same.select("dst").distinct().count() == 1


def test_texts_are_looked_through_once(spark, tmp_path):
    """Nodes and edges are made of what was found, not of the texts."""
    write(spark, tmp_path, DOCS, TURNS)
    run(spark, tmp_path)
    found = spark.read.parquet(f"{tmp_path}/out/found")
    assert found.count() == 13  # all rows but the one without an id
    for df in job.build(found):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "regexp_extract_all" not in plan and "RLIKE" not in plan


def test_empty_tables(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert set(run(spark, tmp_path).values()) == {0}


def test_command_line(spark, tmp_path):
    write(spark, tmp_path, DOCS, TURNS)
    (tmp_path / "settings.json").write_text(json.dumps(SETTINGS))
    args = ["--documents", f"{tmp_path}/documents", "--conversations", f"{tmp_path}/conversations", "--out", f"{tmp_path}/out", "--config", f"{tmp_path}/settings.json"]
    done = subprocess.run([sys.executable, "-m", "jobs.graph_build", *args], cwd=Path(job.__file__).parents[1], capture_output=True, text=True, timeout=300, check=False)
    assert done.returncode == 0, done.stderr[-2000:]
    assert "read 10 documents" in done.stderr and "0 dangling" in done.stderr
    assert job.graph_tables(spark, f"{tmp_path}/out").edges.count() == len(brute(DOCS, TURNS)[1])


def test_nothing_of_the_optional_parts():
    for f in Path(job.__file__).parent.glob("*.py"):
        assert not re.search(r"\bllm\b|corpus_pipeline", f.read_text(encoding="utf-8")), f


@pytest.mark.parametrize("name", ["chunk_stream", "graph_build"])
def test_settings_files(name):
    assert json.loads(Path(job.__file__).with_name(f"{name}.json").read_text(encoding="utf-8"))["concepts"]
