"""Transfers between two trees: what would be carried, in which order, and what came of it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators.graph import numbered

ORDERS = {
    "largest": lambda: [F.desc("size"), F.asc("path")],
    "smallest": lambda: [F.asc("size"), F.asc("path")],
    "oldest": lambda: [F.asc_nulls_last("mtime"), F.asc("path")],
    "path": lambda: [F.asc("path")],
}


def classified(source: DataFrame, target: DataFrame, cooldown_ms: int = 0, now=None) -> DataFrame:
    """path, size, verdict: fresh, identical, same_size (contents unread), clash or too_recent."""
    there = target.select("path", F.col("size").alias("t_size"), F.col("digest").alias("t_digest"))
    rows = source.join(there, "path", "left")
    young = F.lit(False) if now is None else F.coalesce(F.unix_millis(F.lit(now)) - F.unix_millis("mtime") < cooldown_ms, F.lit(False))
    same = F.col("digest") == F.col("t_digest")
    verdict = F.when(young, "too_recent").when(F.col("t_size").isNull(), "fresh").when(F.col("size") != F.col("t_size"), "clash").when(same, "identical").when(~same, "clash").otherwise("same_size")
    return rows.select("path", "size", verdict.alias("verdict"))


def preview(rows: DataFrame) -> DataFrame:
    """One row of counts, and bytes that would be carried."""
    n = lambda v: F.count_if(F.col("verdict") == v)
    return rows.agg(n("fresh").alias("fresh"), n("identical").alias("identical"), n("same_size").alias("same_size"), n("clash").alias("clashes"), n("too_recent").alias("too_recent"), F.coalesce(F.sum(F.when(F.col("verdict").isin("fresh", "clash"), F.col("size"))), F.lit(0)).alias("bytes"))


def in_order(files: DataFrame, order: str) -> DataFrame:
    return files.orderBy(*ORDERS[order]())


def placed(files: DataFrame, order: str) -> DataFrame:
    """The files with ``place``, their number from 1 in an order."""
    return numbered(files, *ORDERS[order]())


def disambiguated(rows: DataFrame, target: DataFrame, most: int = 9999) -> DataFrame:
    """Adds ``free``: for a clash the first numbered name, from 2 on, that the target does not hold; null if there is none.

    Held variants of a name become the set of their numbers, and the first gap
    in it is the answer, so no candidate names are made.
    """
    of_name = paths.name(F.col("path"))
    stem = paths.joined(paths.parent(F.col("path")), paths.stem(of_name))
    numbered = target.select(F.regexp_extract(stem, r"(?s)^(.*)-([0-9]{1,4})$", 1).alias("stem"), F.regexp_extract(stem, r"(?s)^(.*)-([0-9]{1,4})$", 2).alias("n"), paths.ext(of_name).alias("ext")).where("n <> ''")
    held = numbered.withColumn("number", F.col("n").cast("int")).where(F.col("n") == F.col("number").cast("string")).where(F.col("number").between(2, most))
    taken = held.groupBy("stem", "ext").agg(F.collect_set("number").alias("taken"))  # at most ``most`` numbers
    keyed = rows.withColumn("_stem", stem).withColumn("_ext", paths.ext(of_name)).join(taken, (F.col("_stem") == F.col("stem")) & (F.col("_ext") == F.col("ext")), "left")
    gap = F.array_min(F.array_except(F.sequence(F.lit(2), F.coalesce(F.array_max("taken"), F.lit(1)) + 1), F.coalesce("taken", F.array().cast("array<int>"))))
    tail = F.when(F.col("_ext") == "", "").otherwise(F.concat(F.lit("."), F.col("_ext")))
    return keyed.withColumn("free", F.when(gap <= most, F.concat("_stem", F.lit("-"), gap.cast("string"), tail))).drop("_stem", "_ext", "stem", "ext", "taken")


def summary(outcomes: DataFrame) -> DataFrame:
    """outcome, files, bytes of a run."""
    return outcomes.groupBy("outcome").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def decided(rows: DataFrame, on_conflict: str) -> DataFrame:
    """Adds ``action`` to classified rows: copy, keep (already there), wait, read (contents have to be compared), or what is done about a clash."""
    if on_conflict not in ("rename", "skip", "replace", "quarantine"):
        raise ValueError(f"no such way to deal with a clash: {on_conflict!r}")
    v = F.col("verdict")
    return rows.withColumn("action", F.when(v == "fresh", "copy").when(v == "identical", "keep").when(v == "too_recent", "wait").when(v == "same_size", "read").otherwise(on_conflict))


def overlapping_names(a: DataFrame, b: DataFrame) -> DataFrame:
    """The paths that two legs both have."""
    return a.select("path").intersect(b.select("path"))
