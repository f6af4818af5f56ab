"""Near duplicates by 64-bit signatures.

Signatures within ``BITS`` bits of each other are within a few bits on at least
one of ``BANDS`` wide bands: the radii and one each add up to more than ``BITS``,
so not all can be passed. Each signature is looked up under all values near its
bands, which an equi-join finds; it misses no pair and meets a sixtieth of those
of unrelated signatures. Equal signatures are collapsed before. Clusters are leaders with their followers: marks in order
of weight join the best leader that is near enough, or lead themselves. Leaders
only meet followers along candidate pairs, so components are independent.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.operators.graph import components

BITS, SAME, LIKE = 12, 90, 70
#: Bands of a signature.
BANDS = 4


def signature(vector: Column) -> Column:
    """The signs of up to 64 numbers as the bits of a long, first one lowest."""
    bit = F.transform(vector, lambda v, k: F.when(v > 0, F.expr("1L")).otherwise(F.expr("0L")))
    return F.aggregate(F.reverse(bit), F.expr("0L"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b))


def apart(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def alike(a: Column, b: Column) -> Column:
    """How alike two signatures are: 100 if equal, 0 from half of the bits on; null without both."""
    return F.greatest(F.lit(0), F.least(F.lit(100), F.round((64 - apart(a, b)) / 64 * 200 - 100))).cast("int")


def alike_detail(a: Column, b: Column) -> Column:
    """The same over arrays of signatures of one length; null for different lengths."""
    same = F.aggregate(F.zip_with(a, b, lambda x, y: 64 - apart(x, y)), F.lit(0), lambda s, x: s + x)
    bits = F.size(a) * 64
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), F.greatest(F.lit(0), F.least(F.lit(100), F.round(same / bits * 200 - 100))).cast("int"))


def _bands(bits: int) -> list[tuple[int, int, list[int]]]:
    """(first bit, mask, differences to look up) of the bands over 64 bits."""
    n = min(BANDS, bits + 1)
    edges = [64 * k // n for k in range(n + 1)]
    out = []
    for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
        radius = (bits + 1) // n - 1 + (k < (bits + 1) % n)
        out.append((a, (1 << (b - a)) - 1, [sum(1 << j for j in some) for r in range(radius + 1) for some in combinations(range(b - a), r)]))
    return out


def near_pairs(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """sort, a, b, apart for pairs of different signatures of one sort within ``bits`` bits, a below b.

    Marks with one signature are one row here, so a common signature makes no pairs with itself.
    """
    each = marks.select("sort", "signature").where(F.col("signature").isNotNull()).distinct()
    of = lambda a, m: F.shiftrightunsigned("signature", a).bitwiseAND(F.lit(m).cast("long"))
    bands = list(enumerate(_bands(bits)))
    own = F.array(*[F.struct(F.lit(k).alias("band"), of(a, m).alias("part")) for k, (a, m, _) in bands])

    def around(k: int, a: int, m: int, differences: list[int]) -> Column:
        return F.transform(F.lit(differences).cast("array<long>"), lambda x: F.struct(F.lit(k).alias("band"), of(a, m).bitwiseXOR(x).alias("part")))

    near = F.concat(*[around(k, *band) for k, band in bands])
    a, b = (each.select("sort", F.col("signature").alias(name), F.explode(x).alias("x")).select("sort", name, "x.band", "x.part") for name, x in (("a", near), ("b", own)))
    return (
        a.join(b, ["sort", "band", "part"]).where(F.col("a") < F.col("b"))
        .withColumn("apart", apart(F.col("a"), F.col("b"))).where(F.col("apart") <= bits)
        .select("sort", "a", "b", "apart").distinct()
    )


def clusters(marks: DataFrame, bits: int = BITS) -> DataFrame:
    """sort, leader, path, alike, band (same or similar) of every follower.

    Marks have sort, path, signature, weight, size, mtime. Each leads or joins
    the leader that is most like it (of equals the one that comes first), if at
    least LIKE.
    """
    order = [F.desc_nulls_last("weight"), F.desc_nulls_last("size"), F.asc_nulls_first("mtime"), F.asc("path")]
    pairs = near_pairs(marks, bits).select("sort", "a", "b")
    name = lambda c: F.concat_ws(":", "sort", F.col(c).cast("string"))
    labels = components(pairs.select(name("a").alias("a"), name("b").alias("b")))
    rows = marks.where(F.col("signature").isNotNull()).withColumn("node", name("signature")).join(labels, "node", "left").withColumn("label", F.coalesce("root", "node"))
    rows = rows.withColumn("rank", F.row_number().over(W.partitionBy("sort", "label").orderBy(*order)))

    def lead(group: pd.DataFrame) -> pd.DataFrame:
        leaders: list[tuple[int, str]] = []
        out = []
        for r in group.sort_values("rank").itertuples():
            best, of = -1, None
            for s, path in leaders:
                bits_apart = ((s ^ r.signature) & 0xFFFFFFFFFFFFFFFF).bit_count()
                score = max(0, round((64 - bits_apart) / 64 * 200 - 100 + 1e-9))
                if bits_apart <= bits and score >= LIKE and score > best:
                    best, of = score, path
            if of is None:
                leaders.append((r.signature, r.path))
            else:
                out.append((r.sort, of, r.path, best, "same" if best >= SAME else "similar"))
        return pd.DataFrame(out, columns=["sort", "leader", "path", "alike", "band"])

    return rows.select("sort", "label", "path", "signature", "rank").groupBy("sort", "label").applyInPandas(lead, "sort string, leader string, path string, alike int, band string")


def _shrunk(grey: np.ndarray, height: int, width: int) -> np.ndarray:
    """A picture's grey values at another size, by triangles as wide as the pixels they stand for."""

    def weights(old: int, new: int) -> np.ndarray:
        ratio = old / new
        reach = max(ratio, 1.0)
        at = np.abs(np.arange(old)[None, :] + 0.5 - (np.arange(new)[:, None] + 0.5) * ratio) / reach
        w = np.maximum(1 - at, 0)
        return w / w.sum(1, keepdims=True)

    return np.clip(np.rint(weights(grey.shape[0], height) @ grey @ weights(grey.shape[1], width).T), 0, 255)


def gradient(grey: np.ndarray, edge: int) -> list[int]:
    """Bits, 64 to a signed number, first one lowest: whether each of edge x edge pixels is brighter than the one to its right."""
    small = _shrunk(np.asarray(grey, float), edge, edge + 1)
    bits = (small[:, :-1] > small[:, 1:]).ravel()
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def picture_prints(pictures: DataFrame) -> DataFrame:
    """path, signature (8 x 8), weight (pixels), detail (16 x 16) of decoded pictures (path, width, height, grey: a byte each, by rows).

    Pictures without pixels, or with other than width x height of them, have nulls.
    """

    def read(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            out = []
            for path, width, height, grey in part[["path", "width", "height", "grey"]].itertuples(index=False):
                whole = grey is not None and width > 0 and height > 0 and len(grey) == width * height
                image = np.frombuffer(grey, np.uint8).reshape(int(height), int(width)) if whole else None
                out.append((path, gradient(image, 8)[0], int(width * height), gradient(image, 16)) if whole else (path, None, None, None))
            yield pd.DataFrame(out, columns=["path", "signature", "weight", "detail"]).astype({"signature": "Int64", "weight": "Int64"})

    return pictures.mapInPandas(read, "path string, signature long, weight long, detail array<long>")


def encode_print(algorithm: Column, sign: Column, weight: Column, detail: Column) -> Column:
    """``algorithm:signature:weight:detail`` with signatures in hexadecimal."""
    wide = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return F.concat_ws(":", algorithm, wide(sign), weight.cast("string"), F.array_join(F.transform(detail, wide), ","))


def decode_print(text: Column, algorithm: str) -> Column:
    """struct(signature, weight, detail); null for another algorithm or anything unreadable."""
    parts = F.split(text, ":")
    # conv gives unsigned decimals; those beyond a long's range are its negative numbers.
    whole = F.lit(Decimal(1 << 64)).cast("decimal(21,0)")

    def number(h: Column) -> Column:
        n = F.conv(h, 16, 10).cast("decimal(21,0)")
        return F.when(n * 2 >= whole, n - whole).otherwise(n).cast("long")

    fits = text.rlike(f"^{algorithm}:[0-9a-f]{{16}}:[0-9]+:([0-9a-f]{{16}}(,[0-9a-f]{{16}})*)?$")
    detail = F.when(F.get(parts, F.lit(3)) == "", F.array().cast("array<long>")).otherwise(F.transform(F.split(F.get(parts, F.lit(3)), ","), number))
    return F.when(fits, F.struct(number(F.get(parts, F.lit(1))).alias("signature"), F.get(parts, F.lit(2)).cast("long").alias("weight"), detail.alias("detail")))
