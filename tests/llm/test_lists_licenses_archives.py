import datetime
import random
import re

from cohortveil.llm import license_scan as C
from cohortveil.llm import url_lists as U
from cohortveil.llm import warc_fixity as F_
from pyspark.sql import functions as F
from tests.llm.conftest import words

DAY = datetime.date(2024, 1, 1)


def day(n):
    return DAY + datetime.timedelta(n)


def test_lists_as_of_the_fetch(spark):
    entries = [("a", "bad.org", "block", "add", day(10)), ("a", "bad.org", "block", "remove", day(20)),
               ("a", "bad.org", "block", "add", day(30)), ("b", "bad.org/ok/", "allow", "add", day(0)),
               ("b", "sub.bad.org", "allow", "add", day(15)), ("c", "Same.org", "block", "add", day(5)),
               ("c", "Same.org", "block", "remove", day(5)), (None, "x.org", "block", "add", day(1)),
               ("a", None, "block", "add", day(1)), ("a", "x.org", "block", "add", None)]
    rules = U.intervals(spark.createDataFrame(entries, "list string, rule string, effect string, action string, day date"))
    urls = [("http://bad.org/p", 9, "none"), ("http://bad.org/p", 10, "block"), ("https://u:p@www.BAD.org:80/p?q#f", 19, "block"),
            ("http://bad.org/p", 20, "none"), ("http://bad.org/p", 31, "block"), ("http://bad.org//ok//x", 12, "allow"),
            ("http://bad.org/okay", 12, "block"), ("http://sub.bad.org/", 14, "block"), ("http://sub.bad.org/", 16, "allow"),
            ("http://notbad.org/", 12, "none"), ("http://same.org/", 6, "none"), ("http://x.org/", 6, "none"),
            (None, 12, "none"), ("", 12, "none"), ("bad.org", 12, "none"), ("http:///bad.org", 12, "none"),
            ("http://bad.org", None, "none"), ("http://bad.org./", 12, "block")]
    urls += urls[:3]
    frame = spark.createDataFrame([(i, u, None if d is None else day(d), w) for i, (u, d, w) in enumerate(urls)],
                                  "n int, url string, fetched_on date, want string")
    rows = U.judge(frame, rules).collect()
    assert len(rows) == len(urls) and all(r.verdict == r.want for r in rows), [r for r in rows if r.verdict != r.want]
    assert U.judge(frame.limit(0), rules).count() == 0
    assert {r.verdict for r in U.judge(frame, rules.limit(0)).collect()} == {"none"}


def test_rules_keep_the_case_of_paths_only(spark):
    entries = [("a", "Example.COM/Docs/", "block", "add", day(0)), ("a", "example.com/Docs/", "block", "remove", day(10)),
               ("b", "Whole.org", "block", "add", day(0)), ("b", "whole.ORG", "block", "remove", day(10)),
               ("b", "WHOLE.org", "block", "add", day(20))]
    rules = U.intervals(spark.createDataFrame(entries, "list string, rule string, effect string, action string, day date"))
    assert sorted((r.rule, r.valid_from, r.valid_until.year) for r in rules.collect()) == [
        ("example.com/Docs/", day(0), 2024), ("whole.org", day(0), 2024), ("whole.org", day(20), 9999)]
    urls = [("https://EXAMPLE.com/Docs/x", 5, "block"), ("https://example.com/docs/x", 5, "none"),
            ("https://example.com/Docs/x", 10, "none"), ("http://www.Whole.org/A", 5, "block"),
            ("http://whole.org/A", 12, "none"), ("http://whole.org/a", 20, "block")]
    frame = spark.createDataFrame([(u, day(d), w) for u, d, w in urls], "url string, fetched_on date, want string")
    assert all(r.verdict == r.want for r in U.judge(frame, rules).collect())


def test_rules_in_other_spellings(spark):
    rules = ["example.com/docs", "c.com/", "e.com.", " D.com ", "f.com//a///b/", "[::1]", "/nothing", "", "G.org./X"]
    entries = spark.createDataFrame([("l", r, "block", "add", day(1)) for r in rules], "list string, rule string, effect string, action string, day date")
    urls = [("https://example.com/docs", "block"), ("https://example.com/docs/x?q", "block"), ("https://example.com/docsx", "none"),
            ("http://c.com/any", "block"), ("http://sub.e.com./", "block"), ("http://d.com", "block"), ("http://f.com/a/b", "block"),
            ("http://f.com/a", "none"), ("http://[::1]:8080/x", "block"), ("http://[::2]/", "none"), ("http://g.org/X/y", "block"), ("http://g.org/x/y", "none")]
    frame = spark.createDataFrame([(u, day(2), w) for u, w in urls], "url string, fetched_on date, want string")
    got = U.judge(frame, U.intervals(entries)).collect()
    assert all(r.verdict == r.want for r in got) and len(got) == len(urls), [r for r in got if r.verdict != r.want]


def plain_lcs(a, b):
    line = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b, 1):
            new.append(max(line[j], new[-1], line[j - 1] + (x == y)))
        line = new
    return line[-1]


def split(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_notices_and_edited_templates_are_found(spark):
    rng = random.Random(6)
    docs, want = [], {}
    names = sorted(C.TEMPLATES)
    for d in range(120):
        text = words(rng, 60)
        if d % 2:
            name = names[rng.randrange(len(names))]
            own = C.TEMPLATES[name].split(" ")
            if len(own) > 30:
                for _ in range(3):
                    own[rng.randrange(len(own))] = words(rng, 1)[0]
            at = rng.randrange(60)
            text[at:at] = own
            want[d] = name
        docs.append((d, " ".join(text)))
    rows = C.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    found = {}
    for r in rows:
        found.setdefault(r.doc_id, set()).add(r.license)
        piece = split(dict(docs)[r.doc_id][r.start:r.start + r.length])
        assert plain_lcs(split(C.TEMPLATES[r.license]), piece) / len(split(C.TEMPLATES[r.license])) == r.coverage
    assert set(found) == set(want) and all(want[d] in found[d] for d in want)


def test_exact_notices_of_the_table_all_found(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = {(r.doc_id, r.license) for r in C.scan(docs).where("coverage = 1 and identity = 1").collect()}
    texts = [(r.doc_id, " " + " ".join(split(r.text)) + " ") for r in docs.collect()]
    want = {(d, n) for n, t in C.TEMPLATES.items() for d, x in texts if f" {' '.join(split(t))} " in x}
    assert want and {w for w in want if w[1] != "apache-2.0"} <= got and got <= want


def test_odd_documents_and_no_templates(odd_documents, no_documents):
    assert C.scan(odd_documents).count() == 0 and C.scan(no_documents).count() == 0
    assert C.scan(odd_documents, {}).count() == 0
    got = C.scan(odd_documents, {"t": "one two", "u": "one two", "w": "text in two rows of"}).collect()
    assert sorted((r.doc_id, r.license) for r in got) == [(6, "t"), (6, "t"), (6, "u"), (6, "u"), (8, "w"), (9, "w")]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_audit_locates_every_damage(spark, monkeypatch):
    monkeypatch.setattr(F_, "FILE_BYTES", 1 << 20)
    monkeypatch.setattr(F_, "BRANCH", 1 << 12)
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", "é" * rng.randrange(3000)) for i in range(900)] + [(None, None, None), (5, "http://h/5", None), (5, "http://h/5", None)]
    ours = F_.layout(pages(spark, rows)).cache()
    text = {r.id: r for r in ours.collect() if r.id not in (None, 5)}
    assert len({r.file for r in text.values()}) > 1
    bad, lost = set(rng.sample(range(10, 900), 12)), set(rng.sample(range(10, 900), 6))
    theirs = ours.withColumn("hash", F.when(F.col("id").isin(list(bad)), F.lit("0")).otherwise(F.col("hash"))).where(
        ~F.coalesce(F.col("id").isin(list(lost)), F.lit(False)))
    got = {(r.id, r.status): (r.file, r.offset, r.length, r.expected) for r in F_.audit(ours, theirs).collect()}
    want = {(i, "missing"): text[i] for i in lost} | {(i, "changed"): text[i] for i in bad - lost}
    assert got == {k: (r.file, r.offset, r.length, r.hash) for k, r in want.items()}
    assert {r.status for r in F_.audit(theirs, ours).collect()} == {"changed", "extra"}
    assert F_.audit(ours, ours).count() == 0 and F_.audit(ours.limit(0), ours.limit(0)).count() == 0
    assert F_.audit(ours, ours.limit(0)).count() == 903


def test_offsets_are_those_of_the_written_archive(spark, tmp_path):
    rows = [(i, f"http://h/{i}", f"<p>ü{i}</p>\n" * i) for i in range(40)]
    frame = pages(spark, rows).repartition(1)
    F_.write(frame, f"file://{tmp_path}/out")
    data = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    for r in F_.layout(frame).collect():
        piece = data[r.offset:r.offset + r.length]
        assert piece.startswith(b"WARC/1.0\r\n") and piece.endswith(b"\r\n\r\n")
        assert int(re.search(rb"Content-Length: (\d+)", piece)[1]) == len(piece.split(b"\r\n\r\n", 1)[1]) - 4


def test_bounds_of_coverage_and_identity(spark):
    template = " ".join(f"word{k}" for k in range(40))
    w = template.split()
    replaced = lambda n: " ".join("other" if 3 < k <= 3 + n else x for k, x in enumerate(w))
    missing = lambda n: " ".join(x for k, x in enumerate(w) if not 3 < k <= 3 + n)
    texts = [replaced(4), replaced(5), missing(8), missing(9)]
    docs = spark.createDataFrame([(i, "before " + t + " after") for i, t in enumerate(texts)], "doc_id int, text string")
    ids = lambda **bounds: sorted(r.doc_id for r in C.scan(docs, {"t": template}, **bounds).collect())
    assert ids() == [0, 2]              # 4 of 40 replaced: 36 of 44 words alike; 8 of 40 missing: 32 of 40
    assert ids(identity=0.77) == [0, 1, 2]
    assert ids(coverage=0.7, identity=0.7) == [0, 1, 2, 3]
