"""Merkle fixity audit of WARC replicas.

Records are laid out in archive order; a record's place is its byte offset, and
files are filled up to a size.  Leaves are the records' hashes; a branch is the hash
of its children's hashes over one range of offsets, FANOUT ranges to the next level,
up to a root per file.  Two replicas are compared by their roots, and only ranges
whose hashes differ are descended, level by level, down to the damaged records.

Only offsets, lengths and hashes are shuffled, never records.  A range of the lowest
level is BRANCH bytes long, so its children are bounded; higher ones have at most
FANOUT children.

Edge cases: a null field of a record is an empty one.  Repeated ids are records of
their own, ordered by their hash.  A record missing from one replica, or standing at
an offset where the other has none, is reported as ``missing`` or ``extra``.  Empty
replicas have no roots; against a full one all records are missing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scans import running_sum
from ..session import cut

#: Bytes of an archive file, of a lowest branch, and branches under one of the next level.
FILE_BYTES, BRANCH, FANOUT = 1 << 26, 1 << 16, 16
#: Levels of branches under the root of a file: BRANCH · FANOUT^LEVELS reaches FILE_BYTES.
LEVELS = 3


def record(page_id: Column, url: Column, payload: Column) -> Column:
    """A WARC response record as text; lengths count bytes."""
    body = F.coalesce(payload, F.lit(""))
    return F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")),
        F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "),
        F.octet_length(body).cast("string"), F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def layout(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """(id, file, offset, length, hash): every record's place, in the order of ids, and its SHA-256.

    A record belongs to the file in which it begins; offsets count from the file's
    start range, so a record longer than a file simply has a file of its own.
    """
    text = record(F.col(id_col), F.col(url_col), F.col(payload_col))
    slim = pages.select(F.col(id_col).alias("id"), F.octet_length(text).cast("bigint").alias("length"), F.sha2(text, 256).alias("hash"))
    placed = running_sum(slim, (), ["id", "hash"], F.col("length"), "stop")
    start = F.col("stop") - F.col("length")
    return placed.select("id", F.floor(start / FILE_BYTES).alias("file"), (start % FILE_BYTES).alias("offset"), "length", "hash")


def tree(records: DataFrame) -> list[DataFrame]:
    """Branches per level, lowest first: (file, range, hash, children); the last has one root per file.

    ``records`` has file, offset and hash.
    """
    def fold(rows: DataFrame, order: str, hashed: str, span: Column) -> DataFrame:
        children = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(hashed).alias("hash"))))
        return (rows.groupBy("file", span.alias("span")).agg(children.alias("c"))
                .select("file", F.col("span").alias("range"), F.size("c").alias("children"),
                        F.sha2(F.array_join(F.transform("c", lambda x: F.concat(x["at"].cast("string"), F.lit(":"), x["hash"])), "\n"), 256).alias("hash")))

    levels = [fold(records, "offset", "hash", F.floor(F.col("offset") / BRANCH))]
    for _ in range(LEVELS - 1):
        levels.append(fold(levels[-1], "range", "hash", F.floor(F.col("range") / FANOUT)))
    levels.append(fold(levels[-1], "range", "hash", F.lit(0).cast("bigint")))
    return [cut(x) for x in levels]


def audit(ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """(file, offset, id, length, expected, found, status) of the records that differ.

    Both have id, file, offset, length and hash; status is changed, missing or
    extra, seen from ``ours``.
    """
    ours, theirs = cut(ours), cut(theirs)
    mine, other = tree(ours), tree(theirs)
    parents = None
    for level in range(LEVELS, -1, -1):
        a = mine[level].select("file", "range", F.col("hash").alias("h"))
        b = other[level].select("file", "range", F.col("hash").alias("h2"))
        if parents is not None:
            up = F.floor(F.col("range") / FANOUT) if level < LEVELS - 1 else F.lit(0).cast("bigint")
            # only children of differing branches are looked at
            a, b = (x.withColumn("up", up).join(parents, ["file", "up"], "left_semi").drop("up") for x in (a, b))
        parents = (a.join(b, ["file", "range"], "full").where(~F.col("h").eqNullSafe(F.col("h2")))
                   .select("file", F.col("range").alias("up")))
    leaves = [x.withColumn("up", F.floor(F.col("offset") / BRANCH)).join(parents, ["file", "up"], "left_semi") for x in (ours, theirs)]
    a = leaves[0].select("file", "offset", F.col("id").alias("id_a"), F.col("length").alias("length_a"), F.col("hash").alias("expected"))
    b = leaves[1].select("file", "offset", F.col("id").alias("id_b"), F.col("length").alias("length_b"), F.col("hash").alias("found"))
    status = F.when(F.col("found").isNull(), "missing").when(F.col("expected").isNull(), "extra").otherwise("changed")
    return (a.join(b, ["file", "offset"], "full").where(~F.col("expected").eqNullSafe(F.col("found")))
            .select("file", "offset", F.coalesce("id_a", "id_b").alias("id"), F.coalesce("length_a", "length_b").alias("length"),
                    "expected", "found", status.alias("status")))


def write(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> None:
    """Write the records as WARC files, in the order of ids inside each file.

    A record ends with two line breaks, which are the writer's separator.
    """
    text = record(F.col(id_col), F.col(url_col), F.col(payload_col))
    ordered = pages.repartitionByRange(F.col(id_col)).sortWithinPartitions(id_col)
    ordered.select(F.left(text, F.length(text) - 4).alias("value")).write.option("lineSep", "\r\n\r\n").text(path)
