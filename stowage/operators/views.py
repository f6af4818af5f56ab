"""What lists, tables and previews show."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.functions import paths
from stowage.operators import planner
from stowage.plans.policy import Policy, PolicyError, load


def compare(inventory: DataFrame, policies: dict[str, str]) -> DataFrame:
    """layout, loads, files, of, bytes, created, removed: what each layout would do to a tree."""
    out = []
    spark = inventory.sparkSession
    schema = "layout string, loads boolean, files long, of long, bytes long, created long, removed long"
    for name, text in policies.items():
        try:
            policy: Policy = load(text)
        except PolicyError:
            out.append(spark.createDataFrame([(name, False, 0, 0, 0, 0, 0)], schema))
            continue
        ops, _ = planner.operations(inventory, policy)
        out.append(planner.blast(inventory, ops).select(F.lit(name).alias("layout"), F.lit(True).alias("loads"), "files", "of", "bytes", "created", "removed"))
    return reduce(DataFrame.unionByName, out)


def facets(rows: DataFrame, column: str) -> DataFrame:
    """value, n of each value, most frequent first."""
    return rows.groupBy(F.col(column).cast("string").alias("value")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "value")


def searched(rows: DataFrame, text: str, columns: list[str], picks: dict[str, object] | None = None) -> DataFrame:
    """Rows whose columns together hold a text in any case, and that have the picked values."""
    hay = F.lower(F.concat_ws("\n", *columns))
    out = rows.where(hay.contains(text.lower()))
    for c, v in (picks or {}).items():
        out = out.where(F.col(c) == v)
    return out


def table_order(column: str, descending: bool, pinned: Column | None = None, natural: bool = False) -> list[Column]:
    """Sort keys of a table: pinned rows first, null and empty last either way; natural order compares numbers in text as numbers."""
    c = F.col(column)
    empty = c.isNull() | (c.cast("string") == "")
    key = F.regexp_replace(F.lower(c), r"([0-9]+)", "0000000000000000$1") if natural else c
    key = F.regexp_replace(key, r"0*([0-9]{16})(?![0-9])", "$1") if natural else key
    return ([pinned.desc()] if pinned is not None else []) + [empty.asc(), key.desc() if descending else key.asc()]


def browse(inventory: DataFrame, directory: str) -> DataFrame:
    """One directory's own entries: directories first, then by name in any case; no dotfiles, no symlinks."""
    of_name = paths.name(F.col("path"))
    rows = inventory.where((paths.parent(F.col("path")) == directory) & ~of_name.startswith(".") & ~F.coalesce(F.col("is_symlink"), F.lit(False)))
    return rows.orderBy(F.coalesce(F.col("is_dir"), F.lit(False)).desc(), F.lower(of_name), of_name)


def library_summary(assets: DataFrame) -> DataFrame:
    """year, n, bytes, favourites."""
    return assets.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.count_if("favourite").alias("favourites"))


def library_layout(assets: DataFrame) -> DataFrame:
    """Adds ``place``: year/kind/name; of assets that clash, all but the first get a tag made from their id."""
    of_name = paths.sanitize(F.col("name"))
    base = F.concat_ws("/", F.col("year").cast("string"), "kind", of_name)
    clash = F.row_number().over(W.partitionBy("_base").orderBy("id")) > 1
    tagged = F.concat_ws("/", F.col("year").cast("string"), "kind", F.concat(paths.stem(of_name), F.lit("-"), paths.digest(F.col("id").cast("string"), 8), F.when(paths.ext(of_name) == "", "").otherwise(F.concat(F.lit("."), paths.ext(of_name)))))
    return assets.withColumn("_base", base).withColumn("place", F.when(clash, tagged).otherwise(F.col("_base"))).drop("_base")


def most_recent(scans: DataFrame, n: int = 6) -> DataFrame:
    """The ``n`` places scanned last, each once."""
    return scans.groupBy("place").agg(F.max("at").alias("at")).orderBy(F.desc("at"), "place").limit(n)


def preview_tree(inventory: DataFrame, ops: DataFrame) -> DataFrame:
    """path, side (before, after), moves."""
    moved = ops.where(F.col("op").isin("move", "quarantine"))
    before = inventory.select("path").join(moved.select(F.col("source").alias("path"), F.lit(True).alias("m")), "path", "left").select("path", F.lit("before").alias("side"), F.coalesce("m", F.lit(False)).alias("moves"))
    after = planner.apply_on_paper(inventory, ops).select("path").join(moved.select(F.col("target").alias("path"), F.lit(True).alias("m")), "path", "left").select("path", F.lit("after").alias("side"), F.coalesce("m", F.lit(False)).alias("moves"))
    return before.unionByName(after)


def batches(rows: DataFrame, limit: int, group: str, order: str, size: str) -> DataFrame:
    """Adds ``batch``: runs of rows in order whose sizes add up to at most ``limit``; a larger row is alone.

    Where a run ends depends on where it began, so each group is folded in
    order, by its own task.
    """

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, kind="stable")
        batch, filled, out = 0, None, []
        for n in pdf[size]:
            if filled is not None and filled + n > limit:
                batch, filled = batch + 1, n
            else:
                filled = n if filled is None else filled + n
            out.append(batch)
        return pdf.assign(batch=out)

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.groupBy(group).applyInPandas(fold, kinds + ", batch long")


def lately(rows: DataFrame, keys: list[str], at: str, window_s: float = 600.0) -> DataFrame:
    """keys, head, n: runs of like rows, newest first, each within ten minutes of its newest row.

    A run is anchored at its head, not at its last row, so it is folded. Rows
    further apart than the time are in different runs in any case, so what is
    folded are the stretches between such gaps only.
    """
    near = W.partitionBy(*keys).orderBy(F.desc(at))
    gap = F.unix_micros(F.lag(at).over(near)) - F.unix_micros(at) > int(window_s * 1e6)
    rows = rows.select(*keys, at, F.coalesce(gap, F.lit(False)).cast("int").alias("_cut"))
    rows = rows.withColumn("_stretch", F.sum("_cut").over(near.rowsBetween(W.unboundedPreceding, 0)))
    stretch = W.partitionBy(*keys, "_stretch")
    span = F.unix_micros(F.max(at).over(stretch)) - F.unix_micros(F.min(at).over(stretch))
    rows = rows.withColumn("_long", span > int(window_s * 1e6))
    # A stretch no longer than the time is one run as it is.
    short = rows.where(~F.col("_long")).groupBy(*keys, "_stretch").agg(F.max(at).alias("head"), F.count(F.lit(1)).alias("n")).drop("_stretch")

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        times = pdf[at].sort_values(ascending=False)
        heads: list[list] = []
        for t in times:
            if heads and (heads[-1][0] - t).total_seconds() <= window_s:
                heads[-1][1] += 1
            else:
                heads.append([t, 1])
        return pd.DataFrame([(*(pdf[k].iloc[0] for k in keys), h, n) for h, n in heads], columns=[*keys, "head", "n"])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return short.unionByName(rows.where("_long").select(*keys, at, "_stretch").groupBy(*keys, "_stretch").applyInPandas(fold, ", ".join(f"`{k}` {kinds[k]}" for k in keys) + f", head {kinds[at]}, n long"))


def scan_rows(exact: DataFrame, near: DataFrame, sizes: DataFrame) -> DataFrame:
    """kind, keep, others, reclaim of a scan: groups of copies and clusters of near ones, most to gain first."""
    kept = exact.where("kept").select("group", F.col("path").alias("keep"))
    a = exact.where("not kept").groupBy("group").agg(F.count(F.lit(1)).alias("others"), F.sum("size").alias("reclaim")).join(kept, "group").select(F.lit("same").alias("kind"), "keep", "others", "reclaim")
    size = sizes.select("path", "size")
    b = near.join(size, "path").groupBy(F.col("leader").alias("keep"), "band").agg(F.count(F.lit(1)).alias("others"), F.sum("size").alias("reclaim")).select(F.concat(F.lit("like_"), "band").alias("kind"), "keep", "others", "reclaim")
    return a.unionByName(b).orderBy(F.desc("reclaim"), "keep", "kind")


def removable(assets: DataFrame, delivered: DataFrame) -> DataFrame:
    """Ids of assets whose copy arrived and was verified: same place, size and digest."""
    there = delivered.where("verified").select("place", "size", "digest")
    return assets.join(there, ["place", "size", "digest"], "left_semi").select("id")


def chosen(rows: DataFrame, group: str, rule: str, directory: str = "") -> DataFrame:
    """group, keep by a rule of the user's: newest, oldest, biggest or in (the first in a directory, if any)."""
    by = {"newest": F.max(F.struct(F.coalesce(F.unix_millis("mtime"), F.lit(-1)).alias("v"), F.col("path"))), "oldest": F.min(F.struct(F.coalesce(F.unix_millis("mtime"), F.lit(1 << 62)).alias("v"), F.col("path"))), "biggest": F.max(F.struct(F.col("size").alias("v"), F.col("path"))), "in": F.min(F.when(F.col("path").startswith(directory.rstrip("/") + "/"), F.struct(F.lit(0).alias("v"), F.col("path"))))}
    return rows.groupBy(group).agg(by[rule].alias("b")).select(group, F.col("b.path").alias("keep"))


def unexplained(notices: DataFrame, ops: DataFrame, within_s: int = 120) -> DataFrame:
    """Notices (id, folder, at) that no operation (root, started_at) in the folder or above it explains by starting up to two minutes before."""
    up = notices.select("id", "at", F.explode(F.concat(F.array("folder"), paths.ancestors(F.col("folder")))).alias("root"))
    o = ops.select("root", F.col("started_at").alias("_started"))
    late = F.unix_micros("at") - F.unix_micros("_started")
    explained = up.join(o, "root").where(late.between(0, within_s * 1_000_000)).select("id").distinct()
    return notices.join(explained, "id", "left_anti")
