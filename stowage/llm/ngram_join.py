"""Similarity join of documents on word n-grams: MinHash banding, then exact verification.

1. Every text becomes the set of its word 5-grams, a digest of that set, and
   band hashes of its MinHash signature. ``bands_for`` picks bands and rows so
   that a pair at the threshold shares a band with the wanted probability.
2. Documents of one set are one *node* with a number of its own: copies
   collapse before anything is compared, and rows that share a doc_id but not
   their words are nodes of their own.
3. Each bucket of a band links its nodes to its smallest one: as many links as
   nodes, never pairs. The components of these links are the only places where
   similar pairs can be.
4. Within a component nodes are split by set size (similar sets have similar
   sizes) and then into blocks of bounded content; each pair of blocks is one
   cell, in which all Jaccard similarities come from one sparse product. A cell
   gives each node's number of links and a forest of links, not the pairs.
5. The components of the verified links are the classes.

Tasks hold one cell, whose size is bounded whatever the component's size.
Intermediate tables are written to the shared folder, where lineage ends.

* Texts without a word (null, empty, punctuation) link with nothing.
* Texts of fewer words than an n-gram are one gram of all their words.
* A document with a null doc_id has class null and no links. Each row is a
  document: rows of one doc_id repeat in the result, each with the answer for
  its own text, and copies count as links of each other. A class is named by
  its smallest doc_id, so classes can share a name where texts share an id.
* Only doc_id and text are read; extra columns are ignored. An empty table
  gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.llm.batches import Codes, drop, give_back, map_batches, mixed, stored, windows, words

GRAM, THRESHOLD, RECALL, HASHES = 5, 0.8, 0.9995, 256
#: Grams in a block of nodes, each node counting for as many more, which bounds the nodes too; a cell has two blocks.
BLOCK, EACH = 400_000, 400
#: Grams that so many nodes of a cell share are multiplied as a matrix, rarer ones pair by pair.
DENSE = 12
_codes = Codes(__name__, limit=150_000)


def bands_for(threshold: float = THRESHOLD, recall: float = RECALL, hashes: int = HASHES) -> tuple[int, int]:
    """(bands, rows) with the most rows, thus fewest false candidates, that reach ``recall`` at ``threshold`` with ``hashes`` hashes."""
    for rows in range(hashes, 0, -1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold**rows)))
        if bands * rows <= hashes:
            return bands, rows
    raise ValueError("too few hashes for this recall")


def grams(text: str | None, n: int = GRAM) -> np.ndarray:
    """The sorted set of hashes of a text's word n-grams."""
    found = words(text)
    return np.unique(windows(_codes.array(found), n)) if found else np.zeros(0, np.uint64)


def signatures(sets: list[np.ndarray], bands: int, rows: int) -> np.ndarray:
    """(sets, bands) band hashes; sets must not be empty."""
    rng = np.random.default_rng(20)
    factors = rng.integers(0, 1 << 31, bands * rows, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
    offsets = rng.integers(0, 1 << 32, bands * rows, dtype=np.uint32)
    out = np.empty((len(sets), bands), np.uint64)
    first = 0
    while first < len(sets):
        last, size = first, 0
        while last < len(sets) and (last == first or size + len(sets[last]) <= 1 << 15):
            size += len(sets[last])
            last += 1
        x = (np.concatenate(sets[first:last]) >> np.uint64(32)).astype(np.uint32)
        starts = np.cumsum([0, *map(len, sets[first : last - 1])])
        least, y = np.empty((bands * rows, last - first), np.uint32), np.empty_like(x)
        for k in range(bands * rows):
            np.multiply(x, factors[k], out=y)
            np.add(y, offsets[k], out=y)
            np.minimum.reduceat(y, starts, out=least[k])
        for b in range(bands):
            h = np.full(last - first, b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + least[k])
            out[first:last, b] = h
        first = last
    return out


def _digest(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def described(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, key (digest of the set; null if it is empty), hash (of the text), n (the set's size), bands."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = [grams(x, n) for x in batch.column("text").to_pylist()]
        some = [k for k, s in enumerate(sets) if len(s)]
        found: list[list[int] | None] = [None] * len(sets)
        for k, row in zip(some, signatures([sets[k] for k in some], bands, rows).view(np.int64).tolist() if some else [], strict=True):
            found[k] = row
        keys = pa.array([_digest(s) if len(s) else None for s in sets], pa.binary())
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, batch.column("hash"), pa.array(list(map(len, sets)), pa.int32()), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "key", "hash", "n", "bands"])

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", _hash().alias("hash")), run, "doc_id long, key binary, hash long, n int, bands array<long>", remember=False)


def _hash() -> Column:
    """Tells texts of one doc_id apart."""
    return F.xxhash64(F.coalesce(F.col("text"), F.lit("")))


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, root) of every node of the edges (a, b): the smallest node of its component.

    Each round gives a node the smallest label around it and then that label's
    own label, so that chains shorten by halves. Labels are stored between
    rounds; the joins' large keys can be split, since both sides are read anew.
    """
    one = edges.select(F.col("a").alias("x"), F.col("b").alias("y"))
    around = stored(one.unionByName(one.select(F.col("y").alias("x"), F.col("x").alias("y"))).unionByName(one.select("x", F.col("x").alias("y"))).unionByName(one.select(F.col("y").alias("x"), "y")).distinct(), f"{name}-around")
    labels = stored(around.groupBy("x").agg(F.min("y").alias("root")).withColumnRenamed("x", "node"), f"{name}-0")
    total = None
    for k in range(1, 60):
        near = stored(around.join(labels, around.y == labels.node).groupBy("x").agg(F.min("root").alias("root")).withColumnRenamed("x", "node"), f"{name}-{k}a")
        of_root = near.select(F.col("node").alias("root"), F.col("root").alias("next"))
        before, labels = labels, stored(near.join(of_root, "root").select("node", F.col("next").alias("root")), f"{name}-{k}b")
        drop(before, near)
        # Labels only ever fall, so an equal sum means that none did.
        now = labels.agg(F.sum(F.col("root").cast("decimal(38,0)"))).first()[0]
        if now == total:
            drop(around)
            return labels
        total = now
    raise RuntimeError("labels still fall after so many rounds")


def _products(left: list[np.ndarray], right: list[np.ndarray] | None) -> np.ndarray:
    """Sizes of the intersections of all sets of ``left`` with all of ``right`` (of ``left``, if None)."""
    both = left + (right or [])
    owner = np.repeat(np.arange(len(both)), list(map(len, both)))
    order = np.argsort(flat := np.concatenate(both), kind="stable")
    flat, owner = flat[order], owner[order]
    edges = np.flatnonzero(np.concatenate(([True], flat[1:] != flat[:-1])))
    counts = np.diff(np.append(edges, len(flat)))
    out = np.zeros((len(both), len(both)), np.float32)
    many = np.flatnonzero(counts >= DENSE)
    for a in range(0, len(many), 2048):
        part = many[a : a + 2048]
        rows = np.zeros((len(both), len(part)), np.float32)
        at = np.concatenate([owner[edges[j] : edges[j] + counts[j]] for j in part])
        rows[at, np.repeat(np.arange(len(part)), counts[part])] = 1
        out += rows @ rows.T
    for c in range(2, DENSE):
        starts = edges[counts == c]
        for i in range(c):
            for j in range(i):
                # Owners of one gram are in order of their numbers.
                np.add.at(out, (owner[starts + i], owner[starts + j]), 1)
    out = np.maximum(out, np.tril(out, -1).T)
    return out[: len(left), len(left) :] if right is not None else out


def _cell(table: pa.Table, threshold: float) -> pa.Table:
    """Links and a forest of links of a cell's nodes."""
    if table.num_rows > 200:  # there may be large matrices
        give_back()
    rows = {(r["node"], r["side"]): r for r in table.select(["node", "side", "copies", "grams"]).to_pylist()}
    rows = sorted(rows.values(), key=lambda r: (r["side"], r["node"]))
    sets = [np.frombuffer(r["grams"], np.uint64) for r in rows]
    nodes, copies, sizes = np.array([r["node"] for r in rows], np.int64), np.array([r["copies"] for r in rows], np.int64), np.array(list(map(len, sets)))
    a = sum(r["side"] == 0 for r in rows)
    linked = np.zeros((len(rows), len(rows)), bool)
    low_step, low, high_step, high = (table[c][0].as_py() for c in ("low_step", "low", "high_step", "high"))
    if (low_step, low) == (high_step, high):  # one block with itself
        shared = _products(sets, None)
        linked = shared >= threshold * (sizes[:, None] + sizes[None] - shared) - 1e-6
        np.fill_diagonal(linked, False)
    elif 0 < a < len(rows):  # else the other block is empty
        shared = _products(sets[:a], sets[a:])
        linked[:a, a:] = shared >= threshold * (sizes[:a, None] + sizes[None, a:] - shared) - 1e-6
        linked |= linked.T
    links = linked @ copies
    label = np.arange(len(rows))
    while True:
        near = np.minimum(label, np.where(linked, label[None], len(rows)).min(1)) if len(rows) else label
        near = near[near]
        if (near == label).all():
            break
        label = near
    return pa.table({"node": nodes, "links": links.astype(np.int64), "other": nodes[label]})


def _compared(docs: DataFrame, n: int, threshold: float, recall: float, block: int) -> tuple[DataFrame, DataFrame]:
    """Two tables: doc_id, key, hash of every row; and of every key class_id, n_links, copies, and the doc_id and hash of the row that stands for its class."""
    bands, rows = bands_for(threshold, recall)
    every = stored(described(docs, n, bands, rows), "described")
    # Numbers are given as the table is written, and read from there ever after.
    nodes = stored(
        every.where(F.col("key").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("key").agg(F.min(F.struct("doc_id", "hash")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("bands").alias("bands"))
        .select(F.monotonically_increasing_id().alias("node"), "key", "row.doc_id", "row.hash", "copies", "n", "bands"),
        "nodes",
    )
    in_band = nodes.select("node", F.explode("bands").alias("band"))
    buckets = stored(in_band.groupBy("band").agg(F.min("node").alias("center"), F.count(F.lit(1)).alias("size")).where("size > 1").select("band", "center"), "buckets")
    candidates = in_band.join(buckets, "band").where("node != center").select(F.col("node").alias("a"), F.col("center").alias("b")).distinct()
    near = components(candidates, "candidates")
    members = near.join(nodes.select("node", "key", "doc_id", "hash", "n", "copies"), "node")

    # Sizes that differ by more than one step of the threshold can't be similar.
    members = stored(members.withColumn("step", F.floor(F.log(F.col("n").cast("double")) / -math.log(threshold)).cast("int")), "members")
    parts = members.groupBy("root", "step").agg(F.sum(F.col("n") + EACH).alias("grams"))
    by_root = W.partitionBy("root")
    ahead = F.lead(F.struct("step", "grams")).over(by_root.orderBy("step"))
    behind = F.lag(F.struct("step", "grams")).over(by_root.orderBy("step"))
    blocks = lambda grams: F.greatest(F.lit(1), F.ceil(grams / block)).cast("long")
    parts = parts.select(
        "root", "step", (F.sum("grams").over(by_root) <= block).alias("whole"), blocks(F.col("grams")).alias("own"),
        F.when(ahead["step"] == F.col("step") + 1, blocks(ahead["grams"])).otherwise(0).alias("next"),
        F.when(behind["step"] == F.col("step") - 1, blocks(behind["grams"])).otherwise(0).alias("before"),
    )
    parts = stored(parts, "parts")
    mine = F.pmod(F.xxhash64("node"), F.col("own"))

    def numbers(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<long>"))

    def cell(low_step, low, high_step, high, side):
        return F.struct(low_step.alias("low_step"), low.alias("low"), high_step.alias("high_step"), high.alias("high"), side.cast("int").alias("side"))

    step, none = F.col("step"), F.lit(-1).cast("long")
    cells = F.when(F.col("whole"), F.array(cell(F.lit(-1), none, F.lit(-1), none, F.lit(0)))).otherwise(
        F.concat(
            F.transform(numbers(F.col("own")), lambda j: cell(step, F.least(mine, j), step, F.greatest(mine, j), (mine > j).cast("int"))),
            F.transform(numbers(F.col("next")), lambda j: cell(step, mine, step + 1, j, F.lit(0))),
            F.transform(numbers(F.col("before")), lambda j: cell(step - 1, j, step, mine, F.lit(1))),
        )
    )
    placed = stored(members.join(parts, ["root", "step"]).select("root", "node", "key", "doc_id", "hash", "copies", cells.alias("cells")), "placed")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [grams(x, n) for x in batch.column("text").to_pylist()]
        keep = pa.array([len(s) > 0 and _digest(s) == k for s, k in zip(found, batch.column("key").to_pylist(), strict=True)])
        out = pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("root", "node", "copies", "cells")), pa.array([s.tobytes() for s in found], pa.binary())], ["root", "node", "copies", "cells", "grams"])
        return out.filter(keep)

    # Always by a shuffle: what is placed grows with the documents, so it is no side to broadcast. Rows that are
    # equal in id and text become one on the side that reads them, so that no key is hot and no node is there twice.
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _hash().alias("hash"), "text").groupBy("doc_id", "hash").agg(F.first("text").alias("text"))
    texts = texts.join(placed.hint("merge"), ["doc_id", "hash"])
    kind = placed.schema["cells"].dataType.simpleString()
    with_sets = map_batches(texts.select("root", "node", "copies", "cells", "key", "text"), sets, f"root long, node long, copies long, cells {kind}, grams binary", remember=False)
    in_cells = with_sets.select("root", "node", "copies", "grams", F.explode("cells").alias("cell")).select("root", "node", "copies", "grams", "cell.*")
    compared = stored(
        in_cells.groupBy("root", "low_step", "low", "high_step", "high").applyInArrow(lambda t: _cell(t, threshold), "node long, links long, other long"),
        "compared",
    )
    links = compared.groupBy("node").agg(F.sum("links").alias("links"))
    linked = components(compared.where("node != other").select(F.col("node").alias("a"), F.col("other").alias("b")), "links")
    first = linked.join(nodes.select("node", "doc_id", "hash"), "node").groupBy("root").agg(F.min(F.struct("doc_id", "hash")).alias("first"))
    classes = linked.join(first, "root").select("node", "first")
    known = stored(
        nodes.select("key", "node", "copies", F.struct("doc_id", "hash").alias("own")).join(links, "node", "left").join(classes, "node", "left")
        .select("key", "copies", F.coalesce("first", "own").alias("first"), (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"))
        .select("key", "copies", F.col("first.doc_id").alias("class_id"), F.col("first.hash").alias("class_hash"), "n_links"),
        "known",
    )
    drop(nodes, buckets, near, members, parts, placed, compared, linked)
    return every.select("doc_id", "key", "hash"), known


def similar(docs: DataFrame, n: int = GRAM, threshold: float = THRESHOLD, recall: float = RECALL, block: int = BLOCK) -> DataFrame:
    """doc_id, class_id, n_links, copies of every row.

    class_id is the smallest doc_id that links lead to, n_links the number of
    other documents with at least the threshold's similarity, copies that of
    the documents with this very set of n-grams.
    """
    every, known = _compared(docs, n, threshold, recall, block)
    there = F.col("doc_id").isNotNull()
    return (
        every.join(known, "key", "left")
        .select(
            "doc_id",
            F.when(there, F.coalesce("class_id", "doc_id")).alias("class_id"),
            F.when(there, F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"),
            F.when(there, F.coalesce("copies", F.lit(1))).otherwise(1).cast("long").alias("copies"),
        )
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns, of one document of each class: its smallest doc_id.

    Of rows that are equal in id and text one stays; of a class's texts with its
    smallest doc_id one stays as well. Rows without a doc_id stay.
    """
    every, known = _compared(docs, GRAM, THRESHOLD, RECALL, BLOCK)
    alone = every.where(F.col("key").isNull() & F.col("doc_id").isNotNull()).select("doc_id", "hash")
    kept = stored(known.select(F.col("class_id").alias("doc_id"), F.col("class_hash").alias("hash")).unionByName(alone).distinct().select(F.col("doc_id").alias("_kept"), F.col("hash").alias("_hash")), "kept")
    rows = docs.withColumn("_text_hash", _hash())
    stay = rows.join(kept, (rows["doc_id"] == kept["_kept"]) & (rows["_text_hash"] == kept["_hash"]), "left_semi").dropDuplicates(["doc_id", "_text_hash"])
    return stay.drop("_text_hash").unionByName(docs.where(F.col("doc_id").isNull()))
