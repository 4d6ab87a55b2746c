"""Document fingerprints by spot signatures.

Common words are anchors: wherever one stands, the chain of the next content words
is a signature, named together with the anchor.  Navigation and lists have few
anchors, prose has many, so the set of signatures follows the prose.  Sets are
partitioned by their length; only sets of near lengths can be alike, and within a
partition pairs meet over their rarest signatures before the exact Jaccard
similarity is taken.

DataFrame functions only, no Python on the executors.

Edge cases: a null text is an empty one.  A text with words but no anchored chain
takes all runs of ``CHAIN`` words as its signatures, and its printed fingerprint is one
hash of that whole set; with fewer words than a run, all of them are its one signature.
A text without words takes the hash of the whole text, so only equal texts are alike.  Chains at the end of a text are
shorter.  Repeated rows (same id and text) are one member and come out as often as
they came in; several texts under one id follow each other in the order of their
hashes.  Null ids come last.  Long texts count whole.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scans import _ranged
from ..session import cut

#: Content words of a chain, and the least similarity of a pair.
CHAIN, THRESHOLD = 3, 0.8
#: Control character between an anchor and the word after it.
MARK = "\u0001"
#: Hexadecimal digits of a signature in a fingerprint: hashes have 32 bits.
DIGITS = 8
# Anchor words of English, German, French and Spanish.
ANCHORS = """
a an and are as at be but by for from had has have he in is it not of on or that the they this to was were which with
aber als auch auf aus bei das dem den der des die ein eine einen er es für ich im ist mit nicht sich sie sind und von zu
au aux avec ce dans du elle est et il la le les mais ne nous ou par pas pour qui sur un une
como con de del el ella en ha las lo los más no para pero por que se sin su una y
""".split()


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, however often ``then`` mentions it."""
    return F.get(F.transform(F.array(value), then), F.lit(0))


def signatures(text: Column) -> Column:
    """Sorted distinct hashes of a text's signatures; never empty."""
    return marked_signatures(text)["set"]


def marked_signatures(text: Column) -> Column:
    """The struct (set, anchored): a text's signatures, and whether they are anchored chains.

    Anchors are folded into the content word that follows, behind a mark that texts lose
    first: "the house of the big" becomes "the+house", "of+the+big", and a chain starts at
    every marked word.
    """
    whole = F.coalesce(text, F.lit(""))
    bare = F.translate(F.lower(whole), MARK, " ")
    names = "|".join(sorted(set(ANCHORS)))
    # an anchor glues itself to the word after it
    glued = F.regexp_replace(
        bare, rf"(?<![\p{{L}}\p{{N}}])({names})(?![\p{{L}}\p{{N}}])[^\p{{L}}\p{{N}}]+(?=[\p{{L}}\p{{N}}])", "$1" + MARK)
    words = F.filter(F.split(glued, rf"[^\p{{L}}\p{{N}}{MARK}]+", -1), lambda w: F.translate(w, MARK, "") != "")

    def sets(held: Column) -> Column:
        def chain(w: Column, i: Column) -> Column:
            following = [F.substring_index(F.get(held, i + k), MARK, -1) for k in range(1, CHAIN)]
            return F.when(w.contains(MARK), F.hash(w, *following))

        found = F.array_sort(F.array_distinct(F.array_compact(F.transform(held, chain))))
        short = F.when(F.size(held) > 0, F.hash(F.lit("start"), F.array_join(held, " "))).otherwise(
            F.hash(F.lit("whole"), F.sha2(whole, 256)))
        starts = F.slice(held, F.lit(1), F.greatest(F.size(held) - (CHAIN - 1), F.lit(0)))
        runs = F.transform(starts, lambda w, i: F.hash(F.lit("run"), w, *[F.get(held, i + k) for k in range(1, CHAIN)]))
        other = F.when(F.size(held) >= CHAIN, F.array_sort(F.array_distinct(runs))).otherwise(F.array(short))
        return let(found, lambda f: F.struct(
            F.when(F.size(f) > 0, f).otherwise(other).alias("set"), (F.size(f) > 0).alias("anchored")))

    return let(words, sets)


def fingerprint(signatures_: Column, anchored: Column | None = None) -> Column:
    """The set as text: its sorted hashes, ``DIGITS`` hexadecimal digits each; one hash of them all if not anchored."""
    if anchored is not None:
        signatures_ = F.when(anchored | (F.size(signatures_) == 1), signatures_).otherwise(F.array(F.hash(signatures_)))
    return F.array_join(F.transform(signatures_, lambda h: F.lpad(F.hex(h.cast("bigint") + (1 << 31)), DIGITS, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets."""
    common = F.size(F.array_intersect(a, b))
    return common / (F.size(a) + F.size(b) - common)


def similar_pairs(sets: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(a, b, similarity) for the pairs of different sets at or over the threshold.

    ``sets`` has (member, signatures); members with equal sets are one: the least
    member stands for them, see ``classes``.  Lengths are cut into partitions whose
    ends differ by the factor 1 / threshold, so a set meets those of its own and
    the next partition only; in a partition it is listed under its
    n - ceil(threshold · n) + 1 rarest signatures, of which any alike pair shares
    one.  Prefixes stop a candidate whose length alone rules it out.
    """
    one = sets.groupBy("signatures").agg(F.min("member").alias("member"))
    one = cut(one.withColumn("n", F.size("signatures")))
    exploded = one.select("member", "n", F.explode("signatures").alias("s"))
    often = exploded.groupBy("s").agg(F.count("*").alias("f"))
    ranked = exploded.join(often, "s").groupBy("member", "n").agg(
        F.array_sort(F.collect_list(F.struct("f", "s"))).alias("order"))
    keep = F.col("n") - F.ceil(F.col("n") * threshold - 1e-9).cast("int") + 1
    listed = ranked.select("member", "n", F.explode(F.slice("order", F.lit(1), keep)).alias("o")).select(
        "member", "n", "o.s", F.floor(F.log("n") / math.log(1 / threshold) + 1e-9).alias("part"))
    small = listed.select(F.col("member").alias("a"), F.col("n").alias("na"), "s",
                          F.explode(F.array(F.col("part"), F.col("part") + 1)).alias("part"))
    large = listed.select(F.col("member").alias("b"), F.col("n").alias("nb"), "s", "part")
    met = small.join(large, ["part", "s"]).where(
        ((F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b"))))
        & (F.col("na") >= F.col("nb") * threshold - 1e-9)).select("a", "b").distinct()
    left = one.select(F.col("member").alias("a"), F.col("signatures").alias("sa"))
    right = one.select(F.col("member").alias("b"), F.col("signatures").alias("sb"))
    return (met.join(left, "a").join(right, "b").select("a", "b", likeness(F.col("sa"), F.col("sb")).alias("similarity"))
            .where(F.col("similarity") >= threshold))


def classes(sets: DataFrame) -> DataFrame:
    """(member, first): the least member with an equal set."""
    first = sets.groupBy("signatures").agg(F.min("member").alias("first"))
    return sets.join(first, "signatures").select("member", "first")


def edited_fingerprints(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of every text and of its edited text, with likenesses.

    The edited text replaces the last floor(n / 2) code points by the first as many
    (or all) of the next document's.  Ids and hashes alone are ranged first; then whole
    texts are shuffled once, each to the range of its id, and every text meets the next one
    and its set there.  Only the first text of every range travels besides, to the last
    one of the range before.
    """
    texts = documents.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    texts = texts.select(F.col("id").isNull().alias("late"), "id", F.xxhash64("text").alias("body"), "text")
    order = ["late", "id", "body"]
    slim = _ranged(texts.groupBy(*order).agg(F.count("*").alias("n")), (), order)
    # one row per range, as many as shuffle partitions
    heads = cut(slim.groupBy("_part").agg(F.min(F.struct(*order)).alias("head")).select("head"))
    begins = heads.agg(F.sort_array(F.collect_list("head"))).scalar()
    # rows that are wholly repeated stand for each other; few tables have any
    repeated = cut(slim.where("n > 1").select(*order, "n"))
    same = lambda left, right: [left[c].eqNullSafe(right[c]) for c in order]
    once = texts.join(repeated, same(texts, repeated), "left_anti").unionByName(
        texts.join(repeated, same(texts, repeated), "left_semi").dropDuplicates(order))
    at = F.size(F.filter("begins", lambda b: b <= F.struct(*order)))
    ranged = once.withColumn("begins", begins).select(*order, "text", at.alias("range")).repartition("range")
    held = ranged.withColumn("own", marked_signatures(F.col("text")))
    inside = W.partitionBy("range").orderBy(*order)
    nothing = F.struct(F.col("text"), F.col("own.set").alias("set"))
    placed = held.withColumn("next", F.lead(nothing).over(inside))
    # the first text of each range, for the range before it and, of the first one, for the last
    first = heads.select("head.*").withColumn("range", F.row_number().over(W.orderBy(*order)))
    most = first.agg(F.max("range")).scalar()
    opening = texts.join(
        first.withColumnsRenamed({c: "f_" + c for c in order}), [F.col(c).eqNullSafe(F.col("f_" + c)) for c in order])
    opening = opening.groupBy("range").agg(F.first("text").alias("text")).select(
        F.when(F.col("range") == 1, most).otherwise(F.col("range") - 1).alias("range"),
        F.struct("text", signatures(F.col("text")).alias("set")).alias("following"))
    met = placed.join(opening, "range").withColumn("next", F.coalesce("next", "following"))
    again = repeated.withColumnsRenamed({c: "r_" + c for c in order})
    met = met.join(again, [F.col(c).eqNullSafe(F.col("r_" + c)) for c in order], "left")
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next.text", F.lit(1), half))
    rows = met.select("id", F.length("text").cast("bigint").alias("n_chars"), edited.alias("edited"), "own",
                      F.col("next.set").alias("next_set"), F.coalesce("n", F.lit(1)).cast("int").alias("n"))
    sets = rows.select("id", "n_chars", "n", F.sha2("edited", 256).alias("edited_sha256"), "own",
                       marked_signatures(F.col("edited")).alias("changed"), "next_set")
    out = sets.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256", fingerprint(F.col("own.set"), F.col("own.anchored")).alias("fingerprint"),
        fingerprint(F.col("changed.set"), F.col("changed.anchored")).alias("edited_fingerprint"),
        likeness(F.col("own.set"), F.col("changed.set")).alias("near_edited"),
        likeness(F.col("own.set"), F.col("next_set")).alias("near_next"), F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    return out.drop("copy")
