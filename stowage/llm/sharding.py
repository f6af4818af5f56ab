"""Sharding by jump consistent hashing (Lamping and Veach, 2014). Native.

A shard depends on the key and the number of shards alone: no ring table, no
state. With one more shard, a row stays where it is or moves into the new one.
Everything runs as SQL expressions on the JVM.

* A null key counts as key 0. Rows with equal keys share a shard, by the law.
* A null text has no bytes; size is then 8. An empty table gives no rows.
* Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.llm.batches import stored

#: Fixed values of the published generator.
MULTIPLIER, INCREMENT = 2862933555777941757, 1
_LIMB = 22
_MASK = (1 << _LIMB) - 1
#: Bytes that each row takes beside its text.
OVERHEAD = 8


def _next(key: Column) -> Column:
    """key * MULTIPLIER + INCREMENT modulo 2^64, by 22-bit limbs: a plain product would overflow under ANSI rules."""
    c = [(MULTIPLIER >> (_LIMB * i)) & _MASK for i in range(3)]
    k = [key.bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(key, _LIMB).bitwiseAND(F.lit(_MASK)), F.shiftrightunsigned(key, 2 * _LIMB)]
    low = k[0] * c[0] + INCREMENT
    middle = k[0] * c[1] + k[1] * c[0] + F.shiftright(low, _LIMB)
    high = k[0] * c[2] + k[1] * c[1] + k[2] * c[0] + F.shiftright(middle, _LIMB)
    return F.shiftleft(high, 2 * _LIMB).bitwiseOR(F.shiftleft(middle.bitwiseAND(F.lit(_MASK)), _LIMB)).bitwiseOR(low.bitwiseAND(F.lit(_MASK)))


def jump(key: Column, shards: int) -> Column:
    """struct(shard, grown, state): the shards of ``key`` among ``shards`` and ``shards + 1``, and the generator's last state.

    One walk gives both: its steps only increase, so the shard among fewer is
    the last step below their number.
    """
    if shards < 1:
        raise ValueError("there must be a shard")
    key = F.coalesce(key.cast("long"), F.lit(0).cast("long"))
    start = F.struct(F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("at"), _next(key).alias("state"))

    def step(s: Column, _: Column) -> Column:
        there = ((s["at"] + 1).cast("double") * (F.lit(float(1 << 31)) / (F.shiftrightunsigned(s["state"], 33) + 1).cast("double"))).cast("long")
        return F.when(
            there < shards + 1,
            F.struct(s["at"].alias("before"), there.alias("at"), _next(s["state"]).alias("state")),
        ).otherwise(s)

    def done(s: Column) -> Column:
        return F.struct(
            F.when(s["at"] == shards, s["before"]).otherwise(s["at"]).cast("int").alias("shard"),
            s["at"].cast("int").alias("grown"),
            s["state"].alias("state"),
        )

    return F.aggregate(F.sequence(F.lit(1), F.lit(shards)), start, step, done)


def slots(rows: DataFrame, shard: str, spread: str, order: list[str], shards: int, rows_per_part: int = 50_000) -> DataFrame:
    """Adds ``slot``, gapless from 0 in each shard, without one task ever holding a shard.

    Rows of a shard go to parts by ``spread`` (an evenly spread number not
    below 0); a part's first slot is the number of rows in the parts before
    it, and rows are numbered within parts only.
    """
    parts = F.greatest(F.lit(64), F.ceil(F.lit(rows.count() / (shards * rows_per_part)))).cast("long")
    rows = rows.withColumn("part", F.pmod(F.col(spread), parts))
    before = W.partitionBy(shard).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    first = (
        rows.groupBy(shard, "part").agg(F.count(F.lit(1)).alias("n"))
        .select(shard, "part", F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("first"))
    )
    within = F.row_number().over(W.partitionBy(shard, "part").orderBy(*[F.col(c).asc_nulls_first() for c in order]))
    return rows.withColumn("within", within).join(first, [shard, "part"]).withColumn("slot", F.col("first") + F.col("within") - 1)


def shard_documents(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    placed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(body) + OVERHEAD).cast("long").alias("size"),
        F.crc32(body).alias("text_crc32"),
        jump(F.col("doc_id"), shards).alias("j"),
    ).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "j.shard", F.col("j.grown").alias("grown_shard"), F.shiftrightunsigned("j.state", 33).alias("spread"))
    rows = stored(placed, "shards")
    return slots(rows, "shard", "spread", ["doc_id", "size", "text_crc32"], shards).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")


def shard_sql(shards: int) -> str:
    """The same rows in SQL, with the CRC taken byte by byte from a table made on the spot."""
    return f"""
with recursive crc as (
  select list(v order by i) as t from (select i, list_reduce(list_prepend(i::bigint, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as v from range(256) x(i))
), walk as (
  select doc_id, text, row_number() over () as r, -1::bigint as prev, 0::bigint as pos,
         ((coalesce(doc_id, 0)::hugeint & 18446744073709551615) * {MULTIPLIER} + {INCREMENT}) % 18446744073709551616 as state
  from documents
  union all
  select doc_id, text, r, pos, there, (state * {MULTIPLIER} + {INCREMENT}) % 18446744073709551616
  from (select *, trunc((pos + 1)::double * (2147483648.0::double / ((state // 8589934592) + 1)::double))::bigint as there from walk) w
  where there <= {shards}
), last as (
  select *, row_number() over (partition by r order by pos desc) as k from walk
), placed as (
  select doc_id, text, case when pos = {shards} then prev else pos end as shard, pos as grown_shard, state // 8589934592 as spread
  from last where k = 1
), sized as (
  select doc_id, octet_length(encode(coalesce(text, ''))) + {OVERHEAD} as size, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: ('0x' || h)::bigint)), lambda c, b: xor(c >> 8, t[1 + (xor(c, b) & 255)])), 4294967295) as text_crc32, shard, grown_shard,
         spread % greatest(64, ceil((select count(*) from documents) / ({shards} * 50000.0)))::bigint as part
  from placed, crc
)
select doc_id, size::bigint as size, text_crc32::bigint as text_crc32, 'key' as law, shard::int as shard,
       row_number() over (partition by shard order by part, doc_id nulls first, size, text_crc32) - 1 as slot, grown_shard::int as grown_shard
from sized"""
