"""Inventories of trees as tables.

``InventorySource`` is a Python data source: each top-level entry of a root is
a partition, walked where its task runs. ``files`` uses Hadoop's file systems
by Spark's own reader, for every store that Spark can read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from stowage.functions import paths

SCHEMA = "path string, size long, is_dir boolean, is_symlink boolean, mtime timestamp, identity string"


class InventorySource(DataSource):
    """``spark.read.format("inventory").option("prune", "a,b").load(root)``; pruned directories are listed but not entered."""

    @classmethod
    def name(cls) -> str:
        return "inventory"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return InventoryReader(self.options["path"], set(filter(None, self.options.get("prune", "").split(","))))


class Part(InputPartition):
    def __init__(self, top: str):
        super().__init__(top)


class InventoryReader(DataSourceReader):
    def __init__(self, root: str, prune: set[str]):
        self.root, self.prune = root, prune

    def partitions(self) -> list[InputPartition]:
        return [Part(n) for n in sorted(os.listdir(self.root))] or [Part("")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if not partition.value:
            return
        todo = [partition.value]
        while todo:
            path = todo.pop()
            full = os.path.join(self.root, path)
            row, enter = _row(full, path)
            yield row
            # Links are listed and never followed, so a walk can't leave its root.
            if enter and path not in self.prune and os.path.basename(path) not in self.prune:
                todo += [f"{path}/{n}" for n in sorted(os.listdir(full), reverse=True)]


def _row(full: str, path: str) -> tuple[tuple, bool]:
    from datetime import datetime, timezone

    info = os.lstat(full)
    link, folder = os.path.islink(full), os.path.isdir(full) and not os.path.islink(full)
    changed = datetime.fromtimestamp(info.st_mtime, timezone.utc)
    return (path, 0 if folder else info.st_size, folder, link, changed, f"{info.st_dev}:{info.st_ino}" if info.st_nlink > 1 and not folder else None), folder


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InventorySource)


def files(spark: SparkSession, root: str, pattern: str = "*", content: bool = False) -> DataFrame:
    """path, size, mtime (and content) of all files below a root in any store that Spark reads."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(root)
    rel = F.regexp_replace(F.substring_index("path", root.rstrip("/").split("://")[-1], -1), "^/", "")
    return rows.select(rel.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), *(["content"] if content else []))


#: First bytes of file formats, in hexadecimal, and media types by extension.
MAGIC = {"ffd8ff": "image/jpeg", "89504e470d0a1a0a": "image/png", "474946383761": "image/gif", "474946383961": "image/gif", "25504446": "application/pdf", "504b0304": "application/zip", "1f8b": "application/gzip", "494433": "audio/mpeg", "4f676753": "audio/ogg", "664c6143": "audio/flac", "377abcaf271c": "application/x-7z-compressed"}
BY_EXTENSION = {"txt": "text/plain", "md": "text/markdown", "html": "text/html", "htm": "text/html", "css": "text/css", "csv": "text/csv", "json": "application/json", "xml": "application/xml", "js": "text/javascript", "svg": "image/svg+xml", "mp4": "video/mp4", "mov": "video/quicktime", "mkv": "video/x-matroska", "wav": "audio/wav", "heic": "image/heic"}


def sniff(head, path):
    """Media type of a file by its first bytes, then its extension, then whether they are printable."""
    out = None
    for magic, kind in MAGIC.items():
        hit = F.startswith(F.hex(head), F.lit(magic.upper()))
        out = F.when(hit, F.lit(kind)) if out is None else out.when(hit, F.lit(kind))
    table = F.create_map(*[F.lit(x) for pair in BY_EXTENSION.items() for x in pair])
    by_ext = F.element_at(table, F.lower(paths.ext(paths.name(path))))
    text = F.decode(F.substring(head, 1, 8192), "ISO-8859-1")
    printable = F.length(F.regexp_replace(text, r"[^\t\n\r\x20-\x7e\x80-\xff]", ""))
    return F.coalesce(out.otherwise(F.lit(None).cast("string")), by_ext, F.when((F.length(text) > 0) & (printable * 100 >= F.length(text) * 95), "text/plain").otherwise("application/octet-stream"))


def save_plan(ops: DataFrame, path: str) -> None:
    """A plan as lines of JSON, in order."""
    ops.orderBy("ordinal").coalesce(1).write.mode("error").json(path)


def load_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("ordinal long, op string, source string, target string, because string").json(path)


def documents(rows: DataFrame) -> DataFrame:
    """json: each row as a document, nulls included; for explanations, groups of copies and decisions of members."""
    return rows.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("json"))


def save_documents(rows: DataFrame, path: str) -> None:
    """The same as lines of text, in as many files as there are partitions."""
    documents(rows).write.mode("error").text(path)


def parse_end(text: str) -> tuple[str | None, str]:
    """(connection, path) of ``name:path``; one letter before the colon is a drive."""
    head, colon, tail = text.partition(":")
    return (head, tail) if colon and len(head) > 1 and "/" not in head else (None, text)


def survey(spark: SparkSession, root: str, policy, now=None) -> DataFrame:
    """The inventory of a local root with what a policy asks for, and nothing that costs more.

    Listings alone give the first tier; only policies that ask for media types
    or digests make files be read. Ignored and opaque directories are listed
    but not entered where their patterns are plain names.
    """
    from datetime import datetime, timezone

    register(spark)
    plain = [p.removeprefix("**/") for p in (*policy.ignore, *policy.opaque) if not any(c in p.removeprefix("**/") for c in "*?[{/")]
    rows = spark.read.format("inventory").option("prune", ",".join([*plain, *paths.RESERVED])).load(root)
    rows = rows.withColumn("now", F.lit(now or datetime.now(timezone.utc)).cast("timestamp"))
    if policy.tier == "stat":
        return rows
    read = files(spark, root, content=True).select("path", sniff(F.substring("content", 1, 8192), F.col("path")).alias("mime"), *([F.sha2("content", 256).alias("hash")] if policy.tier == "whole" else []))
    return rows.join(read, "path", "left")


def deepened(inventory: DataFrame, content: DataFrame, wanted: DataFrame) -> DataFrame:
    """The inventory with digests of the wanted paths alone, from content (path, content)."""
    some = content.join(wanted.select("path"), "path", "left_semi").select("path", F.sha2("content", 256).alias("_hash"))
    base = inventory if "hash" in inventory.columns else inventory.withColumn("hash", F.lit(None).cast("string"))
    return base.join(some, "path", "left").withColumn("hash", F.coalesce("hash", "_hash")).drop("_hash")
