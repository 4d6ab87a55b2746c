"""Registered queries of the operators, each over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import tune

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = lambda spark, folder: fn(tune(spark), folder)
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def fold(modulus: int) -> F.Column:
    """Remainder of the CRC-32 of the id's text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % modulus


@query("op1_decontamination")
def decontamination(spark, folder):
    """Every place where a document holds a benchmark item within the edit limit."""
    from .decontaminate import find

    return find(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


_FIXITY_SQL = """
WITH raw AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, substr(md5(page_id::VARCHAR), 1, 2) AS draw FROM pages),
body AS (
  SELECT page_id, draw, 'WARC/1.0' || e || 'WARC-Type: response' || e || 'WARC-Record-ID: <urn:page:' || page_id || '>' || e
    || 'WARC-Target-URI: ' || url || e || 'Content-Type: text/html' || e || 'Content-Length: ' || strlen(html) || e || e AS head,
    html || e || e AS tail FROM raw, (SELECT chr(13) || chr(10) AS e)),
hashed AS (
  SELECT page_id, draw, (strlen(head) + strlen(tail))::BIGINT AS length, sha256(head || tail) AS ours,
    sha256(head || CASE WHEN draw < '10' THEN translate(tail, '<', '(') ELSE tail END) AS theirs FROM body),
placed AS (
  SELECT *, (sum(length) OVER (ORDER BY page_id, ours))::BIGINT - length AS start FROM hashed)
SELECT start // 67108864 AS file, start % 67108864 AS "offset", page_id AS id, length, ours AS expected,
  CASE WHEN draw < 'f8' THEN theirs END AS found, CASE WHEN draw < 'f8' THEN 'changed' ELSE 'missing' END AS status
FROM placed WHERE draw < '10' OR draw >= 'f8'
"""


@query("op2_warc_fixity", _FIXITY_SQL)
def warc_fixity(spark, folder):
    """Audit of the pages' archive against a replica with altered and lost records.

    The replica is the archive itself, altered where the hash of the id begins with
    0 and without the records where it begins with f8 to ff.
    """
    from .warc_fixity import audit, layout

    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    draw = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    altered = F.when(draw < "10", F.translate("html", "<", "(")).otherwise(F.col("html"))
    drawn = F.substring(F.md5(F.col("id").cast("string").cast("binary")), 1, 2)
    replica = layout(pages.withColumn("html", altered)).where(drawn < "f8")
    return audit(layout(pages), replica)


@query("op3_spot_signatures")
def spot_signatures(spark, folder):
    """Fingerprints of every text and of its edited text."""
    from .spot_signatures import edited_fingerprints

    return edited_fingerprints(table(spark, folder, "documents"))


@query("op4_toxicity")
def toxicity(spark, folder):
    """Score of every document; remainder 1 is held out of training."""
    from . import toxicity as mil

    documents = table(spark, folder, "documents").select("doc_id", "text")
    labels = table(spark, folder, "labels")
    model = mil.train(mil.labelled_sample(documents, labels.where(fold(3) != 1)))
    return mil.score(documents, model).select(
        "doc_id", F.coalesce(fold(3) == 1, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"), "offending")


@query("op5_packing")
def packing(spark, folder):
    """Every piece of every document with its place."""
    from .packing import pack

    return pack(table(spark, folder, "documents"))


_URL_SQL = """
WITH seen AS (
  SELECT page_id, url, lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda s: s <> '') AS parts,
    DATE '2023-01-01' + ('0x' || substr(md5(page_id::VARCHAR), 1, 4))::INT % 730 AS fetched_on FROM pages),
captures AS (
  SELECT *, host || '/' || array_to_string(parts, '/') || CASE WHEN len(parts) > 0 THEN '/' ELSE '' END AS place FROM seen),
named AS (
  SELECT DISTINCT 'hosts' AS list, host AS rule, 'block' AS effect FROM captures WHERE host <> ''
  UNION SELECT DISTINCT 'paths', host || '/' || parts[1] || '/', 'allow' FROM captures WHERE host <> '' AND len(parts) > 0),
drawn AS (
  SELECT *, ('0x' || substr(md5(rule), 1, 4))::INT % 500 AS a, ('0x' || substr(md5(rule), 5, 4))::INT % 300 + 1 AS b,
    ('0x' || substr(md5(rule), 9, 4))::INT % 200 + 1 AS c FROM named),
rules AS (
  SELECT list, rule, effect, DATE '2023-01-01' + a AS valid_from, DATE '2023-01-01' + a + b AS valid_until FROM drawn
  UNION ALL SELECT list, rule, effect, DATE '2023-01-01' + a + b + c, DATE '9999-12-31' FROM drawn),
met AS (
  SELECT page_id, url, fetched_on, r.*, row_number() OVER (PARTITION BY c.page_id, c.url
      ORDER BY length(rule) DESC, effect = 'allow' DESC, list DESC, rule DESC) AS place_no
  FROM captures c JOIN rules r ON fetched_on >= valid_from AND fetched_on < valid_until
    AND (host = rule OR ends_with(host, '.' || rule) OR (contains(rule, '/') AND starts_with(place, rule))))
SELECT c.page_id, c.fetched_on, coalesce(effect, 'none') AS verdict, rule, list, valid_from, valid_until
FROM captures c LEFT JOIN (SELECT * FROM met WHERE place_no = 1) m ON c.page_id = m.page_id AND c.url = m.url
"""


@query("op6_url_lists", _URL_SQL)
def url_lists(spark, folder):
    """Every page judged by the list entries active on its day.

    ``pages`` has neither fetch days nor lists; both are drawn from hashes: a day in
    2023 or 2024 per page, and for every host and every host with its first path
    segment a rule that is added, removed and added again.
    """
    from . import url_lists as lists

    def drawn(text: F.Column, first: int) -> F.Column:
        return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), first, 4), 16, 10).cast("int")

    origin = F.to_date(F.lit("2023-01-01"))
    captures = table(spark, folder, "pages").select("page_id", "url").withColumn(
        "fetched_on", F.date_add(origin, drawn(F.col("page_id"), 1) % 730))
    seen = captures.select(lists.host_of(F.col("url")).alias("host"), lists.path_of(F.col("url")).alias("path")).where(
        "host is not null")
    head = F.split_part("path", F.lit("/"), F.lit(2))
    hosts = seen.select(F.lit("hosts").alias("list"), F.col("host").alias("rule"), F.lit("block").alias("effect"))
    paths = seen.where(head != "").select(F.lit("paths").alias("list"), F.concat("host", F.lit("/"), head, F.lit("/")).alias("rule"),
                                          F.lit("allow").alias("effect"))
    rules = hosts.union(paths).distinct()
    rule = F.col("rule")
    added = drawn(rule, 1) % 500
    removed = added + drawn(rule, 5) % 300 + 1
    again = removed + drawn(rule, 9) % 200 + 1
    dated = F.array(*[F.struct(F.lit(action).alias("action"), F.date_add(origin, day).alias("day"))
                      for action, day in (("add", added), ("remove", removed), ("add", again))])
    entries = rules.withColumn("e", F.explode(dated)).select("list", "rule", "effect", "e.action", "e.day")
    return lists.judge(captures, lists.intervals(entries)).drop("url")


@query("op7_license_scan")
def license_scan(spark, folder):
    """Every license notice in every document."""
    from .license_scan import scan

    return scan(table(spark, folder, "documents"))


@query("op8_jaccard_join")
def jaccard_join(spark, folder):
    """Class, links and copies of every document."""
    from .jaccard_join import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op9_language")
def language(spark, folder):
    """Language of every document; remainder 2 is held out of training."""
    from . import language as lid

    documents = table(spark, folder, "documents").select("doc_id", "text", "lang")
    model = lid.train(documents.where(fold(4) != 2))
    return lid.predict(documents.drop("lang"), model).select(
        "doc_id", F.coalesce(fold(4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


_LINES_SQL = """
WITH parts AS (
  SELECT doc_id, md5(text) AS body, coalesce(source, '') AS site, string_split(text, chr(10)) AS lines FROM documents WHERE text IS NOT NULL),
lines AS (
  SELECT doc_id, body, site, unnest(range(len(lines))) AS place, trim(unnest(lines), ' ' || chr(9) || chr(13)) AS line FROM parts),
placed AS (SELECT *, (doc_id IS NULL, coalesce(doc_id, 0), body, place) AS here FROM lines WHERE line <> ''),
marks AS (SELECT line, min(here) AS keep FROM placed GROUP BY line HAVING count(DISTINCT site) >= 10),
drops AS (SELECT doc_id, body, list(DISTINCT place) AS gone FROM placed JOIN marks USING (line) WHERE here <> keep GROUP BY doc_id, body)
SELECT d.doc_id,
  CASE WHEN gone IS NULL THEN text
       ELSE array_to_string([x[1] FOR x IN list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10)))))
                             IF NOT list_contains(gone, x[2])], chr(10)) END AS text,
  coalesce(len(gone), 0)::INT AS removed_lines
FROM documents d LEFT JOIN drops ON d.doc_id IS NOT DISTINCT FROM drops.doc_id AND md5(d.text) = drops.body
"""


@query("op10_line_dedup", _LINES_SQL)
def line_dedup(spark, folder):
    """Every document's text without cross-site boilerplate lines."""
    from .line_spread import clean

    return clean(table(spark, folder, "documents"), removed_col="removed_lines").select("doc_id", "text", "removed_lines")


def repeated_words(text: F.Column, doc_id: F.Column) -> F.Column:
    """The text with its tail of words made periodic where the CRC-32 of the id ends in 0.

    With g = floor(crc / 10), every word from a = g mod n on becomes one of the p words
    from a on in turn, p = 1 + floor((n - a) / (3 + g mod 8)).  Null ids change nothing.
    """
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    crc = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(crc / 10)
    n = F.size(words)
    a = F.pmod(g, n).cast("int")
    times = (3 + g % 8).cast("int")
    p = (1 + F.floor((n - a) / times)).cast("int")
    turns = F.flatten(F.array_repeat(F.slice(words, a + 1, p), times + 1))
    edited = F.concat_ws(" ", F.slice(words, F.lit(1), a), F.slice(turns, F.lit(1), n - a))
    has = text.rlike(r"[^\x20\x09-\x0D]")
    return F.when((crc % 10 == 0) & has, edited).otherwise(text)


@query("op11_word_runs")
def word_runs(spark, folder):
    """Runs and collapsed text of every document, a tenth of them made periodic."""
    from .word_runs import periodic_runs

    documents = table(spark, folder, "documents")
    edited = documents.select("doc_id", repeated_words(F.col("text"), F.col("doc_id")).alias("text"))
    found = periodic_runs(edited)
    longest = F.reduce("runs", F.lit(None).cast("struct<start: bigint, length: bigint, period: bigint>"),
                       lambda best, r: F.when(best.isNull() | (r.length > best.length), r).otherwise(best))
    listed = F.transform("runs", lambda r: F.concat_ws(",", r.start.cast("string"), r.length.cast("string"), r.period.cast("string")))
    text = F.concat(F.array_join(listed, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("best", longest).select(
        "doc_id", F.size("runs").cast("bigint").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(text, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))


@query("op13_simhash")
def simhash(spark, folder):
    """Fingerprint and component of every document."""
    from .simhash import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


def damaged(turns: DataFrame) -> DataFrame:
    """Conversations with faults drawn from the CRC-32 of ``conv_id:turn``; nulls are one blank.

    Of twenty turns one each is dropped, emptied, stripped of ``.!?``, repeated, and given to the user.
    """
    draw = F.crc32(F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn"))).cast("binary")) % 20
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    rows = turns.select(
        "conv_id", "turn", draw.alias("draw"), F.when(draw == 4, "user").otherwise(role).alias("role"),
        F.when(draw == 1, "").when(draw == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"))
    return (rows.where("draw <> 0").withColumn("copy", F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
            .select("conv_id", "turn", "role", "text"))


@query("op12_turn_repair")
def turn_repair(spark, folder):
    """Faults, cheapest repair and repaired text of every conversation after damage."""
    from .turn_repair import digests, repair

    turns = table(spark, folder, "conversations")
    summaries, pieces = repair(damaged(turns))
    found = summaries.withColumnRenamed("conv_id", "s").join(digests(pieces), F.col("s").eqNullSafe(F.col("conv_id"))).drop("conv_id")
    known = turns.select("conv_id").distinct()
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return known.join(found, F.col("conv_id").eqNullSafe(F.col("s")), "left").select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
