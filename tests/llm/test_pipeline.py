import shutil
import subprocess
import sys
from pathlib import Path

import corpus_pipeline as P
from cohortveil.session import cut
from tests.llm.test_decontaminate import split
from tests.llm.test_jaccard_join import brute as near_brute
from tests.llm.test_line_spread import brute as line_brute

SF = "/root/testdata/sf0.01"


def test_every_stage_decides_on_what_the_one_before_kept(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    given = docs.columns
    held = {}
    for name, stage in P.STAGES:
        before = {r.doc_id: r for r in docs.collect()}
        docs = cut(stage(spark, docs, SF))
        held[name] = (before, docs.collect())
        if name != "packing":
            assert docs.columns == given
    before, after = held["toxicity"]
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = set(before) - {r.doc_id for r in after}
    assert gone and all(before[r.doc_id] == r for r in after)
    assert sum(labels.get(d) == 0 for d in gone) <= 0.01 * len(before)
    before, after = held["line_dedup"]
    assert sorted(((r.doc_id, r.text) for r in after), key=str) == line_brute([(r.doc_id, r.text, r.source) for r in before.values()], 10)
    assert all(r.n_chars == len(r.text) for r in after)
    before, after = held["near_copies"]
    classes = near_brute([(r.doc_id, r.text) for r in before.values()])
    assert {r.doc_id for r in after} == {c for c, _ in classes.values()} and len(after) < len(before)
    before, after = held["decontamination"]
    items = [" ".join(split(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    leaks = {d for d, r in before.items() if any(f" {i} " in f" {' '.join(split(r.text))} " for i in items)}
    assert leaks and not leaks & {r.doc_id for r in after} and len(before) - len(after) <= len(leaks) + 3
    before, after = held["packing"]
    assert {r.doc_id for r in after} == set(before)


def test_run_gives_what_the_stages_give(spark):
    rows = P.run(spark, "/root/testdata/sf0.001").collect()
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    for _, stage in P.STAGES:
        docs = cut(stage(spark, docs, "/root/testdata/sf0.001"))
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, rows)) == sorted(map(key, docs.collect()))


def test_stages_take_empty_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = cut(stage(spark, docs, "/root/testdata/sf0.001"))
        assert docs.count() == 0, name


def test_other_queries_are_there_without_this_package(tmp_path):
    root = Path(P.__file__).parent
    shutil.copytree(root, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "corpus_pipeline.py", "__pycache__"))
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q, len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env={"PATH": "/usr/bin:/bin"})
    number, ours, pipeline, checks = out.stdout.split()
    assert int(number) > 150 and ours == "0" and pipeline == "False" and int(checks) > 140
