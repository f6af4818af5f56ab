"""The journal: what was done, asked again later.

``ops`` has id, kind (move, copy, delete, mkdir), status (intended, committed,
failed, abandoned, undone), plan, link, src, dst, src_root, dst_root, size, hash,
started_at, finished_at. The order of ids is the order of events; times can tie.
Rows are only ever appended: a status is the newest row's.
"""

from __future__ import annotations

import time

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Tables of an export, in the order in which they are read back.
TABLES = ("ops", "links", "link_files", "connections", "plans", "folders", "hashes", "settings", "syncs", "sync_members", "sync_state")
VERSION = 1


def current(rows: DataFrame, *keys: str) -> DataFrame:
    """The newest row, by id, for each key. ``max_by`` merges before the shuffle, so a key with a long history stays cheap."""
    rest = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.col("id")).alias("_row"))
    return newest.select(*keys, "_row.*").select(*rows.columns)


def touches(path: str) -> Column:
    """Whether an operation reads or writes a path, given relative or below the operation's root."""
    whole = lambda root, p: F.concat_ws("/", root, p) == path
    return (F.col("src") == path) | (F.col("dst") == path) | whole("src_root", "src") | whole("dst_root", "dst")


def history(ops: DataFrame, path: str) -> DataFrame:
    """All operations on a path, newest first."""
    return ops.where(F.coalesce(touches(path), F.lit(False))).orderBy(F.desc("id"))


def whereis(ops: DataFrame, path: str | None = None, digest: str | None = None) -> DataFrame:
    """Places that a path's or a content's committed operations led to, newest operation of each."""
    wanted = F.lit(False)
    if path is not None:
        wanted = wanted | F.coalesce(touches(path), F.lit(False))
    if digest is not None:
        wanted = wanted | F.coalesce(F.col("hash") == digest, F.lit(False))
    hits = ops.where(wanted & (F.col("status") == "committed") & F.col("dst").isNotNull())
    return hits.groupBy("dst").agg(F.max("id").alias("id"), F.max_by("hash", "id").alias("hash"), F.max_by("finished_at", "id").alias("finished_at"))


def recent(ops: DataFrame, n: int) -> DataFrame:
    """The ``n`` newest operations."""
    return ops.orderBy(F.desc("id")).limit(n)


def incomplete(ops: DataFrame) -> DataFrame:
    """Operations that were intended and never finished."""
    return ops.where("status = 'intended'")


def interrupted(ops: DataFrame) -> DataFrame:
    """link, files, bytes of unfinished operations."""
    return incomplete(ops).where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"))


def past_plans(plans: DataFrame, ops: DataFrame, purpose: str | None = None) -> DataFrame:
    """plan, purpose, n_ops, committed, bytes of every plan, also those without operations.

    A plan without a purpose of its own has that of its operations: transfers
    belong to a link, all else is policy.
    """
    # Operations are summed before they meet the plans, so a plan with many of them is one row by then.
    sums = ops.groupBy("plan").agg(
        F.count(F.lit(1)).alias("n_ops"), F.count_if(F.col("status") == "committed").alias("committed"),
        F.coalesce(F.sum(F.when(F.col("status") == "committed", F.col("size"))), F.lit(0)).alias("bytes"), F.count("link").alias("_links"),
    )
    out = plans.join(sums, "plan", "left").select(
        "plan", F.coalesce("purpose", F.when(F.col("_links") > 0, "transfer").otherwise("policy")).alias("purpose"),
        F.coalesce("n_ops", F.lit(0)).alias("n_ops"), F.coalesce("committed", F.lit(0)).alias("committed"), F.coalesce("bytes", F.lit(0)).alias("bytes"),
    )
    return out if purpose is None else out.where(F.col("purpose") == purpose)


def past_syncs(syncs: DataFrame, ops: DataFrame) -> DataFrame:
    """plan, copied, removed, failed, bytes of the plans that a sync made."""
    sums = ops.groupBy("plan").agg(
        F.count_if((F.col("kind") == "copy") & (F.col("status") == "committed")).alias("copied"), F.count_if((F.col("kind") == "delete") & (F.col("status") == "committed")).alias("removed"),
        F.count_if(F.col("status") == "failed").alias("failed"), F.coalesce(F.sum(F.when((F.col("kind") == "copy") & (F.col("status") == "committed"), F.col("size"))), F.lit(0)).alias("bytes"),
    )
    return syncs.select("plan").distinct().join(sums, "plan", "left").na.fill(0)


def current_baseline(state: DataFrame, plans: DataFrame) -> DataFrame:
    """The newest row for each member and path among those whose plan was not undone."""
    undone = plans.where("undone_at is not null").select("plan")
    return current(state.join(undone, "plan", "left_anti"), "member", "path")


def remembered_hashes(ops: DataFrame, inventory: DataFrame) -> DataFrame:
    """path, hash: what the newest committed operation that brought a file there recorded, if the file has not changed since."""
    landed = ops.where("status = 'committed' and hash is not null").groupBy(F.col("dst").alias("path"), "size").agg(F.max_by(F.struct("hash", "finished_at"), "id").alias("_last"))
    return inventory.join(landed, ["path", "size"]).where(F.col("mtime").isNull() | (F.col("_last.finished_at") >= F.col("mtime"))).select("path", F.col("_last.hash").alias("hash"))


def provenance(inventory: DataFrame, ops: DataFrame) -> DataFrame:
    """Adds ``source``: where the newest committed operation brought a file from."""
    last = ops.where("status = 'committed' and dst is not null").groupBy(F.col("dst").alias("path")).agg(F.max_by("src", "id").alias("source"))
    return inventory.join(last, "path", "left")


def uses(connections: DataFrame, links: DataFrame, ops: DataFrame, sync_members: DataFrame) -> DataFrame:
    """connection, links, members, ops: how often each connection is used."""
    by_link = links.select("link", F.explode(F.array_distinct(F.array("from_connection", "to_connection"))).alias("connection")).where("connection is not null")
    a = by_link.groupBy("connection").agg(F.countDistinct("link").alias("links"))
    b = sync_members.where("connection is not null").groupBy("connection").agg(F.countDistinct("member").alias("members"))
    n = ops.where("link is not null").groupBy("link").agg(F.count(F.lit(1)).alias("n"))
    c = by_link.join(n, "link").groupBy("connection").agg(F.sum("n").alias("ops"))
    return connections.select("connection").join(a, "connection", "left").join(b, "connection", "left").join(c, "connection", "left").na.fill(0)


def invert(ops: DataFrame) -> DataFrame:
    """seq, kind, src, dst, of: what undoes committed operations, newest first; those that can't be undone have kind irreversible."""
    kind = F.when(F.col("kind") == "move", "move").when(F.col("kind") == "copy", "delete").when(F.col("kind") == "mkdir", "rmdir").otherwise("irreversible")
    rows = ops.where("status = 'committed'").select(F.col("id").alias("of"), kind.alias("kind"), F.col("dst").alias("src"), F.when(F.col("kind") == "move", F.col("src")).alias("dst"), F.col("plan"))
    return rows.withColumn("seq", F.row_number().over(W.partitionBy("plan").orderBy(F.desc("of")))).select("plan", "seq", "kind", "src", "dst", "of")


def recovered(ops: DataFrame, inventory: DataFrame) -> DataFrame:
    """id, verdict of unfinished moves, by what is there: committed, abandoned or unclear."""
    there = inventory.select("path").distinct()
    rows = (
        incomplete(ops).where("kind = 'move'")
        .join(there.select(F.col("path").alias("src"), F.lit(True).alias("has_src")), "src", "left")
        .join(there.select(F.col("path").alias("dst"), F.lit(True).alias("has_dst")), "dst", "left")
    )
    src, dst = F.coalesce("has_src", F.lit(False)), F.coalesce("has_dst", F.lit(False))
    return rows.select("id", F.when(~src & dst, "committed").when(src & ~dst, "abandoned").otherwise("unclear").alias("verdict"))


def export(tables: dict[str, DataFrame], path: str) -> None:
    """Each table as lines of JSON below ``path``, with the version beside them."""
    for name in TABLES:
        if name in tables:
            tables[name].write.mode("error").json(f"{path}/{name}")
    spark = next(iter(tables.values())).sparkSession
    spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("error").json(f"{path}/version")


def import_(spark, path: str, schemas: dict[str, str], into: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The tables of an export. Only into an empty journal, and not from a newer version."""
    if spark.read.schema("version int").json(f"{path}/version").first().version > VERSION:
        raise ValueError("the export is newer than this program")
    if any(not df.isEmpty() for df in into.values()):
        raise ValueError("the journal is not empty")
    return {name: spark.read.schema(schema).json(f"{path}/{name}") for name, schema in schemas.items()}


def reset(ops: DataFrame) -> None:
    """Raises while operations are unfinished, since clearing would lose track of them."""
    if not incomplete(ops).isEmpty():
        raise ValueError("operations are unfinished")


def archive(tables: dict[str, DataFrame], folder: str) -> str:
    """Puts the journal aside below ``folder``, on any file system that Spark reaches; returns the archive's name, which sorts by time."""
    name = f"{time.time_ns():020d}"
    export(tables, f"{folder}/{name}")
    return name


def cleared(tables: dict[str, DataFrame], folder: str) -> tuple[str, dict[str, DataFrame]]:
    """The archive that the journal was put into, and its tables without rows; not while operations are unfinished."""
    reset(tables["ops"])
    return archive(tables, folder), {name: df.limit(0) for name, df in tables.items()}


def archives(spark: SparkSession, folder: str) -> list[str]:
    """Names of archives, newest first."""
    files, path = _hadoop(spark, folder)
    found = [s.getPath().getName() for s in files.listStatus(path)] if files.exists(path) else []
    return sorted((n for n in found if n.isdigit()), reverse=True)


def restored(tables: dict[str, DataFrame], folder: str, name: str) -> tuple[str, dict[str, DataFrame]]:
    """The archive that the present journal was put into, and the tables of the archive ``name``.

    What can't be read fails before anything is put aside.
    """
    spark = tables["ops"].sparkSession
    reset(tables["ops"])
    _known(spark, folder, name)
    schemas = {n: df.schema for n, df in tables.items()}
    back = import_(spark, f"{folder}/{name}", schemas, {})
    for df in back.values():
        df.isEmpty()
    return archive(tables, folder), back


def forget_archive(spark: SparkSession, folder: str, name: str) -> None:
    """Deletes an archive for good."""
    _known(spark, folder, name)
    files, path = _hadoop(spark, f"{folder}/{name}")
    files.delete(path, True)


def _known(spark: SparkSession, folder: str, name: str) -> None:
    if name not in archives(spark, folder):
        raise KeyError(f"no archive is called {name!r}")


def _hadoop(spark: SparkSession, folder: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def quarantined(ops: DataFrame, root: str) -> DataFrame:
    """path, original, id of files that were set aside and are still there by the journal."""
    aside = ops.where((F.col("status") == "committed") & F.col("dst").startswith(root + "/")).groupBy(F.col("dst").alias("path")).agg(F.max_by("src", "id").alias("original"), F.max("id").alias("id"))
    left = ops.where((F.col("status") == "committed") & F.col("src").startswith(root + "/")).groupBy(F.col("src").alias("path")).agg(F.max("id").alias("left_at"))
    return aside.join(left, "path", "left").where("left_at is null or left_at < id").select("path", "original", "id")


def discarded(ops: DataFrame, link: int) -> DataFrame:
    """The rows that give up a link's unfinished operations, to be appended."""
    return incomplete(ops).where(F.col("link") == link).withColumn("status", F.lit("abandoned"))
