from cohortveil.llm import line_spread as S
from tests.llm.conftest import DOCS


def brute(rows, least):
    """{position: text} with boilerplate lines removed, by plain loops."""
    sites, first = {}, {}
    for doc, text, site in rows:
        for place, line in enumerate((text or "").split("\n") if text is not None else []):
            line = line.strip(" \t\r")
            if line:
                sites.setdefault(line, set()).add(site or "")
                key = (doc if doc is not None else float("inf"), place)
                first[line] = min(first.get(line, key), key)
    out = []
    for doc, text, site in rows:
        if text is None:
            out.append((doc, None))
            continue
        key = doc if doc is not None else float("inf")
        kept = [x for i, x in enumerate(text.split("\n"))
                if len(sites.get(x.strip(" \t\r"), ())) < least or first[x.strip(" \t\r")] == (key, i)]
        out.append((doc, "\n".join(kept)))
    return sorted(out, key=str)


def test_removal_equals_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    for least in (2, 3, 10):
        got = sorted(((r.doc_id, r.text) for r in S.clean(docs, least_sites=least).collect()), key=str)
        assert got == brute(rows, least)
    assert got != sorted(((a, b) for a, b, _ in rows), key=str)


def test_many_sites_near_the_threshold(spark):
    rows = [(10 * n + k, f"shared {n} \nown {n} {k}", f"site{k}") for n in range(1, 40) for k in range(9)]
    rows += [(10_000 + 400 * n + k, f"wide {n}\nx{n} {k}", f"host{k}") for n in range(3) for k in range(198 + n)]
    docs = spark.createDataFrame([(a, b, None, c, None) for a, b, c in rows], DOCS)
    for least in (9, 10, 199, 200):
        got = sorted(((r.doc_id, r.text) for r in S.clean(docs, least_sites=least).collect()), key=str)
        assert got == brute(rows, least)


def test_odd_documents_and_none(spark, odd_documents, no_documents):
    got = S.clean(odd_documents, least_sites=2, removed_col="gone")
    assert got.columns == [*odd_documents.columns, "gone"]
    rows = [(r.doc_id, r.text, r.source) for r in odd_documents.collect()]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == brute(rows, 2)
    assert S.clean(no_documents).count() == 0


def test_no_python_on_executors(spark, sf):
    df = S.clean(spark.read.parquet(f"{sf}/documents.parquet"))
    assert "Python" not in df._jdf.queryExecution().toString() and "Arrow" not in df._jdf.queryExecution().toString()


def test_null_and_string_ids_keep_a_line_once(spark):
    rows = [(None, f"shared\nown {k}", f"site{k}") for k in range(12)]
    docs = spark.createDataFrame([(a, b, None, c, None) for a, b, c in rows], DOCS)
    kept = [r.text for r in S.clean(docs, removed_col="gone").collect()]
    assert sum(t.startswith("shared") for t in kept) == 1 and len(kept) == 12
    named = spark.createDataFrame([(f"d{k:02d}", f"shared\nown {k}", f"site{k}") for k in range(12)], "doc_id string, text string, source string")
    out = {r.doc_id: r.text for r in S.clean(named).collect()}
    assert out["d00"] == "shared\nown 0" and all(out[f"d{k:02d}"] == f"own {k}" for k in range(1, 12))
