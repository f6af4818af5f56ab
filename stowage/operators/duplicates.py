"""Exact duplicates in tiers: equal size, then equal sample, then equal content.

Each tier only reads what the one before left over; group sizes come from
aggregates joined back, never from groups gathered in one place. What to keep
is a window's first row; folders compare by digests of their layouts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.functions import paths

#: Bytes of a piece of the sample.
PIECE = 64 * 1024


def candidates(inventory: DataFrame) -> DataFrame:
    """Files that can have copies: no directories, symlinks, online-only, reserved or empty ones."""
    no = lambda c: ~F.coalesce(F.col(c), F.lit(False)) if c in inventory.columns else F.lit(True)
    return inventory.where(no("is_dir") & no("is_symlink") & no("online_only") & ~paths.is_reserved(F.col("path")) & (F.col("size") > 0))


def sharing(rows: DataFrame, *keys: str) -> DataFrame:
    """The rows whose keys occur more than once. Counts are merged before they are shuffled."""
    many = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    return rows.join(many, list(keys), "left_semi")


def sample_digest(content: Column, size: Column) -> Column:
    """Digest of the size, the first piece, pieces at one and two thirds, and the last one, where they don't overlap."""
    inner = [F.when((at > PIECE) & (size > at + PIECE), F.substring(content, at.cast("int") + 1, PIECE)).otherwise(F.lit(b"")) for at in (F.floor(size * 33 / 100), F.floor(size * 66 / 100))]
    tail = F.when(size > 2 * PIECE, F.substring(content, (size - PIECE).cast("int") + 1, PIECE)).otherwise(F.lit(b""))
    return F.sha2(F.concat(F.hex(size).cast("binary"), F.substring(content, 1, PIECE), *inner, tail), 256)


def scan_cost(inventory: DataFrame) -> DataFrame:
    """stage, files, requests, bytes of a search in tiers (list, sample, whole), and of one that reads everything (all).

    The inventory has path, size and sample. A listing is a request for each
    directory; a sample reads up to four pieces of files that share their
    size; contents are only read of those that share their sample as well.
    """
    files = candidates(inventory).select("path", "size", "sample")
    inner = [(at > PIECE) & (F.col("size") > at + PIECE) for at in (F.floor(F.col("size") * 33 / 100), F.floor(F.col("size") * 66 / 100))]
    further = sum((x.cast("long") for x in inner), (F.col("size") > 2 * PIECE).cast("long"))
    stages = {
        "list": (files.groupBy(paths.parent(F.col("path"))).agg(F.count(F.lit(1)).alias("n")), F.sum("n"), F.count(F.lit(1)), F.lit(0)),
        "sample": (sharing(files, "size"), F.count(F.lit(1)), F.sum(further + 1), F.sum(F.least("size", F.lit(PIECE)) + further * PIECE)),
        "whole": (sharing(sharing(files, "size"), "size", "sample"), F.count(F.lit(1)), F.count(F.lit(1)), F.sum("size")),
        "all": (files, F.count(F.lit(1)), F.count(F.lit(1)), F.sum("size")),
    }
    zero = lambda c: F.coalesce(c.cast("long"), F.lit(0).cast("long"))
    parts = [rows.agg(zero(n).alias("files"), zero(requests).alias("requests"), zero(size).alias("bytes")).select(F.lit(stage).alias("stage"), "*") for stage, (rows, n, requests, size) in stages.items()]
    return reduce(DataFrame.unionByName, parts)


def cached_digests(inventory: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``known``: the digest remembered for a path while its size and time, to the second, are the same."""
    second = lambda c: F.date_trunc("second", c)
    c = cache.select(F.col("path").alias("c_path"), F.col("size").alias("c_size"), F.col("mtime").alias("c_mtime"), F.col("digest").alias("known"))
    same = (F.col("path") == F.col("c_path")) & (F.col("size") == F.col("c_size")) & second(F.col("mtime")).eqNullSafe(second(F.col("c_mtime")))
    return inventory.join(c, same, "left").drop("c_path", "c_size", "c_mtime")


def keep_choice(rows: DataFrame, group: str = "digest") -> DataFrame:
    """Adds ``kept`` (whether a row is the copy to keep) and ``why``: pinned, settled, oldest or order.

    Rows have path, mtime, pinned, settled. Settledness and age only decide
    where they tell the copies apart. More than one pin is the reason two_pins,
    and nothing is kept. The best of each kind are smallest structs, merged
    before the shuffle, so a group of very many copies is never sorted.
    """
    pinned, settled = F.coalesce(F.col("pinned"), F.lit(False)), F.coalesce(F.col("settled"), F.lit(False))
    order = F.struct(*(c.alias(f"o{k}") for k, c in enumerate(paths.path_order(F.col("path")))))
    best = lambda *keys: F.min(F.struct(*(k.alias(f"k{n}") for n, k in enumerate(keys)), order.alias("order")))["order"]["o2"]
    chosen = rows.groupBy(group).agg(
        F.sum(pinned.cast("int")).alias("_pins"), F.sum(settled.cast("int")).alias("_st"), F.count(F.lit(1)).alias("_n"),
        F.min("mtime").alias("_lo"), F.max("mtime").alias("_hi"), F.max(F.col("mtime").isNull()).alias("_null"),
        best(~pinned, ~settled).alias("_settled"), best(~pinned, F.col("mtime").isNull(), F.col("mtime")).alias("_oldest"), best(~pinned).alias("_order"),
    )
    settles = (F.col("_st") > 0) & (F.col("_st") < F.col("_n"))
    ages = F.coalesce((F.col("_lo") < F.col("_hi")) | (F.col("_null") & F.col("_lo").isNotNull()), F.lit(False))
    why = F.when(F.col("_pins") > 1, "two_pins").when(F.col("_pins") == 1, "pinned").when(settles, "settled").when(ages, "oldest").otherwise("order")
    keep = F.when(F.col("_pins") > 1, None).when(settles, F.col("_settled")).when(ages, F.col("_oldest")).otherwise(F.col("_order"))
    chosen = chosen.select(group, keep.alias("_keep"), why.alias("why"))
    return rows.join(chosen, group).withColumn("kept", F.coalesce(F.col("path") == F.col("_keep"), F.lit(False))).drop("_keep")


def hard_links(inventory: DataFrame) -> DataFrame:
    """identity, first (the name that goes on to be compared), names of files with several names."""
    linked = sharing(inventory.where(F.col("identity").isNotNull()), "identity")
    order = F.struct(paths.depth(F.col("path")).alias("d"), F.octet_length("path").alias("n"), F.col("path").alias("path"))
    return linked.groupBy("identity").agg(F.min(order)["path"].alias("first"), F.count(F.lit(1)).alias("names"))


def folder_prints(files: DataFrame) -> DataFrame:
    """directory, files, bytes, print of each directory all of whose files have copies elsewhere.

    Rows have path, size, digest, twinned. Two directories have one print
    exactly if the same relative paths hold the same contents: the print sums
    digests of (relative path, content), so no directory is gathered.
    """
    rel = F.expr("substring(path, length(directory) + 2)")
    entry = F.sha2(F.concat_ws("\0", rel, F.col("digest")), 256)
    halves = [F.conv(F.substring(entry, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(4)]
    return (
        files.select("*", F.explode(paths.ancestors(F.col("path"))).alias("directory"))
        .groupBy("directory").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"), F.every("twinned").alias("_all"), F.concat_ws("-", *(F.sum(h).cast("string") for h in halves)).alias("print"))
        .where("_all").drop("_all")
    )


def folder_groups(prints: DataFrame) -> DataFrame:
    """print, keep, extra, files, bytes of copied directories, outermost only: shallow ones cover what is below them."""
    copied = sharing(prints, "print")
    kept = F.row_number().over(W.partitionBy("print").orderBy(*paths.path_order(F.col("directory"))))
    rows = copied.withColumn("_k", kept)
    keep = rows.where("_k = 1").select("print", F.col("directory").alias("keep"))
    extra = rows.where("_k > 1").select("print", F.col("directory").alias("extra"), "files", "bytes")
    covering = extra.select(F.col("extra").alias("above"))
    below = extra.select("extra", F.explode(paths.ancestors(F.col("extra"))).alias("above")).join(covering, "above", "left_semi").select("extra").distinct()
    return extra.join(below, "extra", "left_anti").join(keep, "print").select("print", "keep", "extra", "files", "bytes")


def groups(files: DataFrame, sampled: bool = False) -> DataFrame:
    """Rows of groups of copies with kept, why, sure: by content, or by sample only, which is then not sure.

    Files have path, size, mtime, sample, digest, pinned, settled.
    """
    same_size = sharing(candidates(files), "size")
    same_sample = sharing(same_size, "size", "sample")
    rows = same_sample.withColumn("group", F.col("sample") if sampled else F.col("digest"))
    rows = rows if sampled else sharing(rows, "group")
    return keep_choice(rows, "group").withColumn("sure", F.lit(not sampled))


def totals(grouped: DataFrame) -> DataFrame:
    """One row: groups, extra files, bytes that could be freed, groups not sure."""
    return grouped.agg(
        F.count_if("kept").alias("groups"), F.count_if(~F.col("kept")).alias("extra_files"),
        F.coalesce(F.sum(F.when(~F.col("kept"), F.col("size"))), F.lit(0)).alias("reclaimable"), F.count_if(F.col("kept") & ~F.col("sure")).alias("unsure"),
    )


def confirm(grouped: DataFrame, contents: DataFrame) -> DataFrame:
    """Rows of sampled groups whose whole content (path, digest) equals that of the kept copy."""
    whole = contents.select("path", F.col("digest").alias("_whole"))
    rows = grouped.join(whole, "path")
    kept = rows.where("kept").select("group", F.col("_whole").alias("_kept"))
    same = rows.join(kept, "group").where("_whole = _kept").drop("_kept").withColumnRenamed("_whole", "whole").withColumn("sure", F.lit(True))
    return sharing(same, "group")


def decide(grouped: DataFrame, ticked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(extras to deal with: group, path; errors: group, error): groups of which every copy is ticked are refused, each path is dealt with once."""
    asked = ticked.select("path").distinct().withColumn("_asked", F.lit(1))
    marked = grouped.join(asked, "path", "left")
    empty = marked.groupBy("group").agg(F.count("_asked").alias("a"), F.count(F.lit(1)).alias("n")).where("a = n").select("group")
    dealt = marked.where("_asked = 1").join(empty, "group", "left_anti").select("group", "path")
    return dealt, empty.withColumn("error", F.lit("would_empty"))


def dealings(dealt: DataFrame, files: DataFrame, set_aside: bool) -> DataFrame:
    """Operations for dealt paths; a dealt directory stands for every file below it."""
    below = files.select("path", F.explode(F.concat(F.array("path"), paths.ancestors(F.col("path")))).alias("dealt"))
    chosen = below.join(dealt.select(F.col("path").alias("dealt")), "dealt", "left_semi").select("path").distinct()
    return chosen.select(F.lit("quarantine" if set_aside else "trash").alias("op"), F.col("path").alias("source"), (paths.parked(F.col("path")) if set_aside else F.lit(None).cast("string")).alias("target"), F.lit("duplicate").alias("because"))
