"""N-gram Jaccard join through a MinHash LSH forest.

Every document is its set of word 5-grams.  A tree of the forest orders the
documents by a row of min-hashes, a label; documents that share a prefix of their
labels are near each other in that tree.  The matched prefix is shortened from the
full label until pairs at the threshold share one in some tree with the target
recall; as groups of a shorter prefix hold those of every longer one, only the
last is written out.  Groups are joined into neighbourhoods, and inside them the
sets are compared exactly.

Equal sets are one member from the start (with its number of copies), and a large
neighbourhood is compared block by block, so no group is expanded into rows of
pairs and none has to fit into one task.

Edge cases: texts without words (null and empty ones too) have no set; equal ones
are copies of each other and link to nothing else.  A text of one to four words
has one n-gram of all its words.  Repeated rows are copies.  Null ids are kept; a
class is named by its least id.  Null and repeated ids can give several classes one
name; ``class_key`` tells them apart.  An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut
from .components import components
from .textarrays import Words, chunks, mix, shingle_sets

#: Words of an n-gram, and the least Jaccard similarity of a link.
WIDTH, THRESHOLD = 5, 0.8
#: Trees of the forest, min-hashes of a full label, and the recall aimed at.
TREES, LABEL, TARGET_RECALL = 24, 8, 0.9999
#: Members of a neighbourhood that one task holds at a time.
BLOCK = 512


def prefix_recall(similarity: float, depth: int, trees: int = TREES) -> float:
    """Chance that a pair shares a label prefix of this depth in some tree."""
    return 1 - (1 - similarity ** depth) ** trees


def prefix_depth(threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> int:
    """Longest matched prefix that reaches the target recall at the threshold."""
    depth = LABEL
    while depth > 1 and prefix_recall(threshold, depth) < target:
        depth -= 1
    return depth


def _multipliers() -> np.ndarray:
    return np.random.default_rng(17).integers(1, 2 ** 63, TREES * LABEL).astype(np.uint64) * np.uint64(2) + np.uint64(1)


def _names(values: np.ndarray, first: np.ndarray) -> list[str]:
    """128-bit names of the sets, "" for an empty one."""
    names = [""] * (len(first) - 1)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        at = first[:-1][has]
        one = np.add.reduceat(values, at).tolist()
        two = np.add.reduceat(mix(values + np.uint64(1)), at).tolist()
        for i, a, b in zip(has.tolist(), one, two):
            names[i] = f"{a:016x}{b:016x}"
    return names


def _sketch(texts: list[str], depth: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Per text: name of its set, size of its set, and a key per tree for its label prefix."""
    values, first = shingle_sets(Words(texts), WIDTH)
    size = np.diff(first)
    has = np.flatnonzero(size)
    names = _names(values, first)
    keys = np.zeros((len(texts), TREES), np.uint64)
    if len(has):
        at = first[:-1][has]
        many = _multipliers()
        for tree in range(TREES):
            key = np.full(len(has), tree + 1, np.uint64)
            for k in range(tree * LABEL, tree * LABEL + depth):
                key = mix(key * np.uint64(31) + (np.minimum.reduceat(values * many[k], at) >> np.uint64(16)))
            keys[has, tree] = key
    return names, size, keys


def _whole(text_col: str) -> Column:
    """Hash of a whole text; with the id it tells one document from all but its repeated rows."""
    return F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256)


def _least() -> Column:
    """The least (id, whole) of a group; null ids come last."""
    return F.min(F.struct(F.col("id").isNull().alias("late"), "id", "whole"))


def sketches(documents: DataFrame, id_col: str, text_col: str, depth: int) -> DataFrame:
    """(id, member, size, keys, whole): the member is the name of the document's n-gram set, ``whole`` its text's hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, held in chunks(batch.column(1).to_pylist()):
                names, size, keys = _sketch(held, depth)
                lists = [k.view(np.int64) if n else None for k, n in zip(keys, size)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, len(held)), pa.array(names), pa.array(size.astype(np.int32)),
                     pa.array(lists, pa.list_(pa.int64())), batch.column(2).slice(at, len(held))],
                    names=["id", "member", "size", "keys", "whole"])

    kind = documents.schema[id_col].dataType
    schema = (T.StructType().add("id", kind).add("member", "string").add("size", "integer")
              .add("keys", T.ArrayType(T.LongType())).add("whole", "string"))
    rows = documents.select(F.col(id_col), F.col(text_col), _whole(text_col))
    # a text without words is named by its own hash
    return rows.mapInArrow(run, schema).selectExpr(
        "id", "if(size = 0, concat('-', whole), member) as member", "size", "keys", "whole")


def linked_pairs(sets: list[np.ndarray], left: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs (i < j) of sets at or over the threshold.

    With ``left`` > 0 only pairs between the first ``left`` sets and the rest are
    compared.  Intersections are counted from the n-grams that occur in several
    sets, slab by slab, so memory stays bounded.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate(([True], values[1:] != values[:-1]))
    run = np.cumsum(new) - 1
    shared = np.bincount(run)[run] > 1
    owner, column = owner[shared], (np.cumsum(new & shared) - 1)[shared]
    common = np.zeros((n, n), np.float32)
    slab = 4096
    edges = np.searchsorted(column, np.arange(0, (column[-1] + 1 if len(column) else 0) + slab, slab))
    for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])):
        if a < b:
            held = np.zeros((n, slab), np.float32)
            held[owner[a:b], column[a:b] - k * slab] = 1
            common += held @ held.T
    common = common.astype(np.float64)
    union = sizes[:, None] + sizes[None, :] - common
    linked = np.triu(common / np.maximum(union, 1) >= threshold, 1)
    if left:
        linked[:left, :left] = False
        linked[left:, left:] = False
    return np.nonzero(linked)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Least index reachable from each of n nodes."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _compare(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """Links inside every (neighbourhood, block, block) of one task's sorted rows."""
    held: list = []
    at = None
    out: list = []

    def close():
        own = [r for r in held if r[1] == 0]
        other = [r for r in held if r[1] == 1]
        rows = own + other
        if len(rows) < 2:
            return
        sets = [np.frombuffer(r[4], np.uint64) for r in rows]
        a, b = linked_pairs(sets, len(own) if other else 0, threshold)
        copies = np.array([r[3] for r in rows])
        links = np.bincount(a, copies[b], len(rows)) + np.bincount(b, copies[a], len(rows))
        root = _roots(len(rows), a, b)
        for i in np.flatnonzero(links):
            out.append((rows[i][2], int(links[i]), rows[root[i]][2]))

    def flush():
        columns = list(zip(*out)) if out else [[], [], []]
        batch = pa.RecordBatch.from_arrays([pa.array(list(columns[0]), pa.string()), pa.array(list(columns[1]), pa.int64()),
                                            pa.array(list(columns[2]), pa.string())], names=["member", "links", "root"])
        out.clear()
        return batch

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] != at:
                close()
                held.clear()
                at = row[0]
            held.append(row)
        if len(out) > 10_000:
            yield flush()
    close()
    yield flush()


def near_duplicates(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                    threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """One row per document: its id, class id, links, copies and class key.

    ``links`` counts the other documents at or over the threshold, equal sets
    included; a class is a connected component of links, named by its least id;
    ``copies`` counts the documents with an equal set; ``class_key`` is the class's
    own name, also where several classes have one least id or none.
    """
    docs, named = _classified(documents, id_col, text_col, threshold, target)
    return docs.select("id", "member").join(named, "member").select(
        F.col("id").alias(id_col), F.col("least.id").alias("class_id"), "links", "copies", F.col("label").alias("class_key"))


def _classified(documents: DataFrame, id_col: str, text_col: str, threshold: float,
                target: float) -> tuple[DataFrame, DataFrame]:
    """The sketches, and (member, label, least, links, copies): the label names the class, ``least`` its first document."""
    depth = prefix_depth(threshold, target)
    docs = cut(sketches(documents, id_col, text_col, depth))
    members = docs.groupBy("member").agg(F.count("*").alias("copies"), _least().alias("least"),
                                         F.first("keys").alias("keys"), F.max("size").alias("size"))
    members = cut(members)
    keyed = members.where("size > 0").select("member", F.explode("keys").alias("key"))
    groups = keyed.groupBy("key").agg(F.min("member").alias("first"), F.count("*").alias("n")).where("n > 1")
    # a member is tied to the least head of its groups, and its other heads to that one:
    # about one edge per member, however many trees it is met in
    heads = keyed.join(groups, "key").groupBy("member").agg(F.min("first").alias("b"), F.collect_set("first").alias("heads"))
    edges = heads.select(F.col("member").alias("a"), "b").union(heads.select(F.explode("heads").alias("a"), "b").distinct())
    near = components(edges).withColumnRenamed("label", "place")
    counts = near.groupBy("place").agg(F.ceil(F.count("*") / F.lit(BLOCK)).cast("int").alias("blocks"))
    placed = (near.join(counts, "place").join(members.select(F.col("member").alias("node"), "copies", "least"), "node")
              .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    placed = cut(placed)
    linked = cut(_links(documents, docs, placed, id_col, text_col, threshold))
    totals = linked.groupBy("member").agg(F.sum("links").alias("near"))
    classes = components(linked.select(F.col("member").alias("a"), F.col("root").alias("b")))
    named = (members.select("member", "copies", "least")
             .join(classes.withColumnRenamed("node", "member"), "member", "left")
             .withColumn("label", F.coalesce("label", "member")))
    least = named.groupBy("label").agg(F.min("least").alias("least"))
    # one label can stand for very many members: only minima meet, and joins may be split
    return docs, named.drop("least").join(least, "label").join(totals, "member", "left").selectExpr(
        "member", "label", "least", "coalesce(near, 0) + copies - 1 as links", "copies")


def _links(documents: DataFrame, docs: DataFrame, placed: DataFrame, id_col: str, text_col: str,
           threshold: float) -> DataFrame:
    """(member, links, root) found in every pair of blocks; a member's rows add up."""
    # one document per member is read again for its whole set
    chosen = placed.select("least", "node", "place", "block", "blocks", "copies")
    source = documents.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), _whole(text_col).alias("whole"))
    source = source.join(chosen, source.id.eqNullSafe(chosen.least.id) & (source.whole == chosen.least.whole))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for at, held in chunks(texts):
                values, first = shingle_sets(Words(held), WIDTH)
                bits = [values[a:b].tobytes() for a, b in zip(first[:-1], first[1:])]
                yield pa.RecordBatch.from_arrays(
                    [*(c.slice(at, len(held)) for c in batch.columns[1:]), pa.array(bits, pa.binary())],
                    names=["node", "place", "block", "blocks", "copies", "bits"])

    built = source.select("text", "node", "place", "block", "blocks", "copies").mapInArrow(
        sets, "node string, place string, block int, blocks int, copies bigint, bits binary")
    # block b meets every block: as the first of a pair with b.., as the second with ..b
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(
        F.concat_ws("/", "place", F.least("block", j).cast("string"), F.greatest("block", j).cast("string")).alias("pair"),
        (F.col("block") > j).cast("int").alias("side")))
    spread = built.withColumn("meet", F.explode(pairs)).select("meet.pair", "meet.side", "node", "copies", "bits")
    return (spread.dropDuplicates(["pair", "node"]).repartition("pair").sortWithinPartitions("pair", "side", "node")
            .mapInArrow(lambda b: _compare(b, threshold), "member string, links bigint, root string"))


def keep_one(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             threshold: float = THRESHOLD, target: float = TARGET_RECALL) -> DataFrame:
    """The documents without all but one of each class, all columns kept.

    The document of the least id stays (null ids last, several texts of one id in
    the order of their hashes); of its repeated rows, one.
    """
    docs, named = _classified(documents, id_col, text_col, threshold, target)
    kept = named.groupBy("label").agg(F.first("least").alias("least")).select(
        F.col("least.id").alias("kept_id"), F.col("least.whole").alias("kept_whole"))
    columns = [F.col(f"`{c}`") for c in documents.columns]
    rows = documents.select(F.struct(*columns).alias("row"), F.col(id_col).alias("own_id"), _whole(text_col).alias("own_whole"))
    rows = rows.join(kept, F.col("own_id").eqNullSafe(F.col("kept_id")) & (F.col("own_whole") == F.col("kept_whole")), "left_semi")
    return rows.groupBy("own_id", "own_whole").agg(F.first("row").alias("row")).select("row.*")
