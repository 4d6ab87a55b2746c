"""URL filters whose lists change over time.

Dated list entries (a rule added or removed on a day) become validity intervals.
An as-of join then judges every capture by the entries that were active when it was
fetched.  A rule is a host, which holds for its subdomains too, or a host with
leading path segments; the most specific active rule decides.

Captures are reduced to distinct (host, path, day) before they meet the rules, so a
host that holds a third of all captures sends no more rows than it has pages and
days; verdicts return to the captures by an equality join that Spark may split.

Edge cases: a URL that is null or has no host, and a capture without a date, is
judged by nothing: verdict ``none``.  Entries with a null rule, list, action or date
are ignored.  A rule is read as a URL is, before its entries are grouped: blanks around it go, its
host is in lower case without a final dot, its path has its own case, single slashes and one at the
end; a host with a bare slash is the host.  Of several entries of one rule on one day a removal
wins; adding an active rule again starts a new interval.  Ties between rules go to allowing ones,
then to the last list by name.  Repeated captures are judged each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Day after every interval that has no end.
FOREVER = "9999-12-31"


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and a final dot; null if there is none."""
    place = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    return F.nullif(F.regexp_replace(F.lower(place), r"\.$", ""), F.lit(""))


def path_of(url: Column) -> Column:
    """``/`` and the non-empty path segments, each followed by ``/``."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.concat(F.lit("/"), F.regexp_replace(F.concat(path, F.lit("/")), r"^/+|(?<=/)/+", ""))


def rule_keys(host: Column, path: Column) -> Column:
    """Every rule that would hold for the URL: host suffixes, then the host with leading segments."""
    labels = F.split(host, r"\.")
    parts = F.filter(F.split(path, "/"), lambda s: s != "")
    hosts = F.transform(labels, lambda _, i: F.array_join(F.slice(labels, i + 1, F.size(labels)), "."))
    paths = F.transform(parts, lambda _, i: F.concat(host, F.lit("/"), F.array_join(F.slice(parts, F.lit(1), i + 1), "/"), F.lit("/")))
    return F.array_distinct(F.concat(hosts, paths))


def rule_of(rule: Column) -> Column:
    """A rule in the form of ``rule_keys``; null if it has no host."""
    bare = F.btrim(rule, F.lit(" \t\r\n"))
    parts = F.filter(F.split(bare, "/"), lambda s: s != "")
    host = F.when(~F.startswith(bare, F.lit("/")), F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"\.$", ""))
    path = F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), "/")
    return F.nullif(F.concat(host, F.when(path != "", F.concat(F.lit("/"), path, F.lit("/"))).otherwise("")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, rule, effect, valid_from, valid_until): until is the first day it no longer holds.

    ``entries`` has list, rule, effect (block or allow), action (add or remove) and
    day.  A rule has at most one entry per day once reduced, which bounds the window.
    """
    daily = (entries.withColumn("rule", rule_of(F.col("rule")))
             .where("list is not null and rule is not null and action is not null and day is not null").groupBy("list", "rule", "day")
             .agg(F.max("action").alias("action"), F.max("effect").alias("effect")))
    following = F.lead("day").over(W.partitionBy("list", "rule").orderBy("day"))
    return (daily.withColumn("valid_until", F.coalesce(following, F.to_date(F.lit(FOREVER)))).where("action = 'add'")
            .select("list", "rule", "effect", F.col("day").alias("valid_from"), "valid_until"))


def judge(captures: DataFrame, rules: DataFrame, url_col: str = "url", day_col: str = "fetched_on") -> DataFrame:
    """All columns of the captures plus verdict, rule, list, valid_from and valid_until.

    ``rules`` are intervals; ``verdict`` is block, allow or none.
    """
    names = captures.columns
    new = {"verdict", "rule", "list", "valid_from", "valid_until"}
    if new & set(names):
        raise ValueError(f"captures have columns of the result already: {sorted(new & set(names))}")
    left = captures.withColumns({"__host": host_of(F.col(url_col)), "__path": path_of(F.col(url_col)), "__day": F.col(day_col)})
    asked = left.where("__host is not null and __day is not null").select("__host", "__path", "__day").distinct()
    keyed = asked.withColumn("rule", F.explode(rule_keys(F.col("__host"), F.col("__path"))))
    # as of the day of the fetch
    met = keyed.join(rules, "rule").where("__day >= valid_from and __day < valid_until")
    best = met.groupBy("__host", "__path", "__day").agg(F.max(F.struct(
        F.length("rule").alias("size"), (F.col("effect") == "allow").alias("allowed"), "list", "rule", "effect",
        "valid_from", "valid_until")).alias("best"))
    best = best.select(F.col("__host").alias("b_host"), F.col("__path").alias("b_path"), F.col("__day").alias("b_day"), "best")
    out = left.join(best, (left["__host"] == best.b_host) & (left["__path"] == best.b_path) & (left["__day"] == best.b_day), "left")
    return out.select(*[left[c] for c in names], F.coalesce("best.effect", F.lit("none")).alias("verdict"), "best.rule",
                      "best.list", "best.valid_from", "best.valid_until")
