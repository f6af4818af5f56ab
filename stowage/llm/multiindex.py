"""Approximate nearest neighbours by an inverted multi-index (Babenko and Lempitsky, 2012).

Vectors are cut into halves and each half is quantised by its own centroids; a
pair of centroids is a cell. For a query, cells are visited in order of the two
halves' summed distance, taken off a heap, until the cells hold the wanted
number of candidates; these are ranked again by the inner product itself.

* Equal vectors are one entry with its smallest ids, so that copies neither use
  up the candidates nor gather anywhere; they are told apart again in results.
* Centroids are found on a bounded sample, as many as make cells of about
  ``IN_CELL`` entries; every entry is indexed.
* How far to look is measured on a fixed number of trial queries, for which all
  entries are searched: the share of entries before which ``RECALL`` of their
  true neighbours lie. It falls as a table grows denser, and does so the less
  the more dimensions the vectors fill evenly.
* Cells lie in chunks of bounded size, in order of their centroids; a cell too
  large for one has chunks of its own. Queries meet chunks in blocks.

Vectors that are null, zero, of another length than most, or hold null or
non-finite components take no part, nor do rows without an id. Repeated rows
count once. With fewer candidates than asked for, all are returned; ties go to
the smaller id. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.llm.batches import map_batches, stored

#: Rows of the sample, and its bytes, at most; centroids of a half at most, and entries in a cell that they are chosen for.
SAMPLE, SAMPLE_BYTES, CENTROIDS, IN_CELL = 20_000, 256 << 20, 1024, 4
#: Entries of a chunk; queries of a block; trial queries.
CHUNK, QUERIES, TRIALS = 4096, 512, 200
#: Share of the true neighbours that the trial queries must find.
RECALL = 0.95
#: Entries that are ranked again at least, for each neighbour that is asked for.
LEAST = 20


@dataclass
class Index:
    """Centroids of the halves, how far to look, and where the cells' chunks are."""

    left: np.ndarray
    right: np.ndarray
    by_product: bool  # distances are inner-product deficits; else squared Euclidean
    share: float
    least: int = 0  # entries to look at, however small their share
    counts: np.ndarray | None = None  # entries of each cell
    first: np.ndarray | None = None  # first chunk of each cell
    splits: np.ndarray | None = None  # chunks of its own, or 1
    wanted: int = 0

    def cells(self, x: np.ndarray) -> np.ndarray:
        half = x.shape[1] // 2
        return _nearest(x[:, :half], self.left) * len(self.right) + _nearest(x[:, half:], self.right)

    def distances(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of one query to the centroids of the halves."""
        half = len(q) // 2
        return tuple(_distance(part[None], c, self.by_product)[0] for part, c in ((q[:half], self.left), (q[half:], self.right)))

    def visit(self, q: np.ndarray) -> tuple[float, list[int]]:
        """The largest summed distance visited, and the chunks with visited entries."""
        to_left, to_right = self.distances(q)
        a, b = np.argsort(to_left, kind="stable"), np.argsort(to_right, kind="stable")
        x, y = to_left[a].tolist(), to_right[b].tolist()
        base, column = (a * len(self.right)).tolist(), b.tolist()
        counts = self.counts_list
        heap, found, reach = [(x[0] + y[0], 0, 0)], 0, 0.0
        cells = []
        while heap and found < self.wanted:
            reach, i, j = heapq.heappop(heap)
            cell = base[i] + column[j]
            if counts[cell]:
                found += counts[cell]
                cells.append(cell)
            # The pair below; and the pair to the right once in each row.
            if i + 1 < len(x):
                heapq.heappush(heap, (x[i + 1] + y[j], i + 1, j))
            if i == 0 and j + 1 < len(y):
                heapq.heappush(heap, (x[0] + y[j + 1], 0, j + 1))
        first, splits = self.first[cells], self.splits[cells]
        chunks = set(first.tolist())
        for f, s in zip(first[splits > 1].tolist(), splits[splits > 1].tolist(), strict=True):
            chunks.update(range(f, f + s))
        return reach, sorted(chunks)

    @property
    def counts_list(self) -> list[int]:
        if getattr(self, "_counts", None) is None:
            self._counts = self.counts.tolist()
        return self._counts

    def place(self, counts: np.ndarray, chunk: int = CHUNK) -> None:
        """Lays the cells into chunks of at most ``chunk`` entries, where a cell itself is not larger."""
        self.counts = counts
        self.splits = np.maximum(1, -(-counts // chunk))
        self.first = np.zeros(len(counts), np.int64)
        now, filled = 0, 0
        for cell in np.flatnonzero(counts).tolist():
            n, s = int(counts[cell]), int(self.splits[cell])
            if filled and (s > 1 or filled + n > chunk):
                now, filled = now + 1, 0
            self.first[cell] = now
            if s > 1:
                now += s
            else:
                filled += n
        total = int(counts.sum())
        self.wanted = min(total, max(int(np.ceil(self.share * total)), self.least))


def _distance(x: np.ndarray, centroids: np.ndarray, by_product: bool) -> np.ndarray:
    products = x @ centroids.T
    if by_product:
        return products.max(1, keepdims=True) - products
    return np.maximum((x * x).sum(1, keepdims=True) - 2 * products + (centroids * centroids).sum(1), 0)


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return ((centroids * centroids).sum(1) - 2 * (x @ centroids.T)).argmin(1)


def _centroids(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 10) -> np.ndarray:
    """Lloyd's algorithm from ``k`` of the rows."""
    found = x[rng.permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        of = _nearest(x, found)
        counts = np.bincount(of, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, of, x)
        found[counts > 0] = sums[counts > 0] / counts[counts > 0, None]
    return found


def centroids_for(entries: int) -> int:
    """Centroids of a half, for cells of about ``IN_CELL`` entries."""
    return min(CENTROIDS, max(1, math.isqrt(entries // IN_CELL)))


def fit(x: np.ndarray, k: int, recall: float = RECALL, centroids: int = 256, seed: int = 3) -> Index:
    """An index fitted on sample rows ``x``, to find ``recall`` of the ``k`` nearest among a part of them."""
    rng = np.random.default_rng(seed)
    half = x.shape[1] // 2
    n = min(centroids, max(1, len(x) // 8))
    left, right = _centroids(x[:, :half], n, rng), _centroids(x[:, half:], n, rng)
    base = x[rng.permutation(len(x))[:8192]]
    queries = base[:200]
    products = queries @ base.T
    products[np.arange(len(queries)), np.arange(len(queries))] = -np.inf
    near = np.argsort(-products, axis=1)[:, :k][:, : max(0, len(base) - 1)]
    index = Index(left, right, True, 1.0, LEAST * k)
    for by_product in (True, False):
        sums = _distance(queries[:, :half], left, by_product)[:, _nearest(base[:, :half], left)] + _distance(queries[:, half:], right, by_product)[:, _nearest(base[:, half:], right)]
        shares = [float(np.quantile((np.sort(s)[None] <= s[near[j], None]).mean(1), recall)) for j, s in enumerate(sums)] if near.size else [1.0]
        # Searches differ; what finds the wanted share in nearly each of them finds more on the whole.
        share = float(np.quantile(shares, 0.6))
        if share < index.share:
            index.by_product, index.share = by_product, share
    return index


def tuned(index: Index, queries: np.ndarray, near: list[np.ndarray], counts: np.ndarray, recall: float = RECALL) -> None:
    """Sets how far ``index`` looks: to where ``recall`` of the true neighbours of trial queries lie. near: the neighbours' cells."""
    best = (2.0, True)
    cells = np.flatnonzero(counts)
    for by_product in (True, False):
        index.by_product = by_product
        shares = []
        for q, own in zip(queries, near, strict=True):
            to_left, to_right = index.distances(q)
            sums = to_left[cells // len(index.right)] + to_right[cells % len(index.right)]
            order = np.argsort(sums, kind="stable")
            before = np.cumsum(counts[cells][order])
            theirs = to_left[own // len(index.right)] + to_right[own % len(index.right)]
            at = np.searchsorted(sums[order], theirs, "right") - 1
            shares += (before[np.maximum(at, 0)] / before[-1]).tolist()
        share = float(np.quantile(shares, recall, method="higher")) if shares else 1.0
        best = min(best, (share, by_product))
    index.share, index.by_product = best


def _true_neighbours(celled: DataFrame, queries: np.ndarray, ids: np.ndarray, width: int, k: int) -> list[np.ndarray]:
    """The cells of the ``k`` nearest of all entries to each of a fixed number of queries."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        top = [np.full((len(queries), k), -np.inf), np.zeros((len(queries), k), np.int64)]
        for batch in batches:
            own = np.array([x[0] for x in batch.column("ids").to_pylist()], np.int64)
            products = queries @ _matrix(batch, "v", width).T
            products[ids[:, None] == own[None]] = -np.inf
            cells = np.broadcast_to(batch.column("cell").to_numpy().astype(np.int64), products.shape)
            scores, cells = np.concatenate([top[0], products], 1), np.concatenate([top[1], cells], 1)
            at = np.argpartition(-scores, k - 1, axis=1)[:, :k]
            top = [np.take_along_axis(scores, at, 1), np.take_along_axis(cells, at, 1)]
        q, j = np.nonzero(top[0] > -np.inf)
        if len(q):
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(top[0][q, j]), pa.array(top[1][q, j])], ["q", "score", "cell"])

    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "cell"))
    found = celled.select("cell", "ids", "v").mapInArrow(run, "q int, score double, cell long").withColumn("rank", rank).where(F.col("rank") <= k).select("q", "cell").collect()
    return [np.array([r.cell for r in found if r.q == q], np.int64) for q in range(len(queries))]


def usable(vector: Column) -> Column:
    """Whether a vector is not null, and all its components are finite and not all zero."""
    odd = F.exists(vector, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return vector.isNotNull() & ~odd & F.exists(vector, lambda v: v != 0)


def _matrix(batch: pa.RecordBatch, name: str, width: int) -> np.ndarray:
    column = batch.column(name)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(-1, width)


def search(vectors: DataFrame, is_query: Column, k: int = 20, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: of each row where ``is_query`` holds the ``k`` nearest of all other rows found."""
    schema = "query_id long, rank int, vec_id long, score double"
    spark = vectors.sparkSession
    rows = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(vector_column).cast("array<double>").alias("v"), is_query.alias("asks")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    if not sizes:
        return spark.createDataFrame([], schema)
    width = sizes[0].n
    rows = rows.where(F.size("v") == width)

    # One entry for equal vectors, with as many of their smallest ids as can be wanted.
    of_vector = W.partitionBy("v").orderBy("vec_id")
    few = rows.select("v", "vec_id").withColumn("r", F.dense_rank().over(of_vector)).where(F.col("r") <= k + 1)
    entries = stored(few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids")), "entries")
    sample = entries.select("ids", "v").orderBy(F.xxhash64("v"), "v").limit(max(TRIALS, min(SAMPLE, SAMPLE_BYTES // (8 * width)))).collect()
    x = np.array([r.v for r in sample])
    index = fit(x, k, centroids=centroids_for(entries.count()))

    def assign(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = index.cells(_matrix(batch, "v", width))
        return pa.RecordBatch.from_arrays([pa.array(cells, pa.int32()), batch.column("ids"), batch.column("v")], ["cell", "ids", "v"])

    celled = stored(map_batches(entries.select("ids", "v"), assign, "cell int, ids array<long>, v array<double>"), "cells")
    # As many counts as there are cells: bounded by the centroids, whatever the table's size.
    counts = np.zeros(len(index.left) * len(index.right), np.int64)
    for cell, n in celled.groupBy("cell").count().collect():
        counts[cell] = n
    trials = x[:TRIALS]
    tuned(index, trials, _true_neighbours(celled, trials, np.array([r.ids[0] for r in sample[:TRIALS]], np.int64), width, k), counts)
    index.place(counts)

    def into_chunks(batch: pa.RecordBatch) -> pa.RecordBatch:
        cells = batch.column("cell").to_numpy()
        spread = np.array([x[0] for x in batch.column("ids").to_pylist()], np.int64) * 0x9E3779B1 >> 7
        chunks = index.first[cells] + spread % index.splits[cells]
        return pa.RecordBatch.from_arrays([pa.array(chunks), batch.column("cell"), batch.column("ids"), batch.column("v")], ["chunk", "cell", "ids", "v"])

    def pack(table: pa.Table) -> pa.Table:
        v = np.asarray(table["v"].combine_chunks().flatten(), np.float64)
        ids = table["ids"].combine_chunks()
        lengths = np.asarray(ids.value_lengths(), np.int32)
        return pa.table({"chunk": table["chunk"][:1], "cells": [table["cell"].to_numpy().astype(np.int32).tobytes()], "lengths": [lengths.tobytes()], "ids": [np.asarray(ids.flatten(), np.int64).tobytes()], "v": [v.tobytes()]})

    chunks = map_batches(celled, into_chunks, "chunk long, cell int, ids array<long>, v array<double>").groupBy("chunk").applyInArrow(pack, "chunk long, cells binary, lengths binary, ids binary, v binary")

    def visits(batch: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for q, v in zip(batch.column("query_id").to_pylist(), _matrix(batch, "v", width), strict=True):
            reach, found = index.visit(v)
            out += [(c, q, reach, v.tobytes()) for c in found]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64(), pa.binary()), strict=True)], ["chunk", "query_id", "reach", "q"])

    # The heaps are the work here, so queries are dealt out over many tasks; few rows would else be merged into one.
    asking = rows.where("asks").select(F.col("vec_id").alias("query_id"), "v").distinct()
    n_queries = asking.count()
    asking = asking.repartition(max(1, -(-n_queries // max(64, n_queries // 10_000))), "query_id")
    visiting = stored(map_batches(asking, visits, "chunk long, query_id long, reach double, q binary"), "visits")
    blocks = (
        visiting.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(max(1, -(-n_queries // QUERIES)))))
        .groupBy("chunk", "block").agg(F.collect_list(F.struct("query_id", "reach", "q")).alias("queries"))
    )

    # Rows are about a megabyte each; Arrow batches are bounded by bytes as well as by rows.
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in range(batch.num_rows):
                row = {n: batch.column(n)[r].as_py() for n in batch.schema.names}
                found = _rerank(index, row, width, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], ["query_id", "vec_id", "score"])

    pairs = blocks.join(chunks, "chunk").mapInArrow(rerank, "query_id long, vec_id long, score double")
    best = pairs.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _rerank(index: Index, row: dict, width: int, k: int) -> list[tuple[int, int, float]]:
    """The nearest of a chunk's visited entries for each query of a block."""
    cells = np.frombuffer(row["cells"], np.int32)
    v = np.frombuffer(row["v"], np.float64).reshape(-1, width)
    lengths = np.frombuffer(row["lengths"], np.int32)
    starts = np.concatenate(([0], np.cumsum(lengths)))
    ids = np.frombuffer(row["ids"], np.int64)
    smallest = ids[starts[:-1]]
    lefts, rights = cells // len(index.right), cells % len(index.right)
    half = width // 2
    q = np.frombuffer(b"".join(x["q"] for x in row["queries"]), np.float64).reshape(-1, width)
    products = q @ v.T
    out = []
    for j, asked in enumerate(row["queries"]):
        # The same sums as on the heap, so that the same cells are within reach.
        to_left, to_right = index.distances(q[j])
        at = np.flatnonzero(to_left[lefts] + to_right[rights] <= asked["reach"])
        if not len(at):
            continue
        scores = products[j, at]
        if len(at) > k + 1:
            least = np.partition(scores, len(at) - k - 1)[len(at) - k - 1]
            keep = scores >= least - 1e-9
            at = at[keep]
        exact = (v[at] * q[j]).sum(1)
        order = np.lexsort((smallest[at], -exact))[: k + 1]
        found = [(-float(exact[o]), int(i)) for o in order for i in ids[starts[at[o]] : starts[at[o] + 1]] if i != asked["query_id"]]
        out += [(asked["query_id"], i, -s) for s, i in sorted(found)[:k]]
    return out
