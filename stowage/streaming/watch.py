"""Watching folders: when a root has gone quiet, what was an echo of our own work, and how often to look.

Events have root, path, kind, ts. In batch and as a stream a root is settled
once nothing has happened in it for the cooldown: a session window with that
gap. Events later than the watermark are dropped; a periodic sweep looks at
everything anyway.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from stowage.functions import paths

#: Seconds in which events of our own writes are echoes; the ladder of waits after failures; least and most between looks.
ECHO_S, LADDER, LEAST_S, MOST_S = 10, (60, 120, 300, 600), 30, 3600


def settled(events: DataFrame, cooldown_s: int) -> DataFrame:
    """root, first, settles_at, n: the quiet moments of each root."""
    return events.groupBy("root", F.session_window("ts", f"{cooldown_s} seconds").alias("w")).agg(F.min("ts").alias("first"), F.count(F.lit(1)).alias("n")).select("root", "first", F.col("w.end").alias("settles_at"), "n")


def settled_stream(events: DataFrame, cooldown_s: int, lateness_s: int = 60) -> DataFrame:
    """The same over a stream, each row once its session is closed by the watermark."""
    return settled(events.withWatermark("ts", f"{lateness_s} seconds"), cooldown_s)


def relevant(events: DataFrame, roots: DataFrame) -> DataFrame:
    """Events that change something in a root: no reads, nothing reserved, each given to the longest root above it."""
    rows = events.where((F.col("kind") != "access") & ~paths.is_reserved(F.col("path")))
    above = rows.select("*", F.explode(F.concat(F.array("path"), paths.ancestors(F.col("path")))).alias("root")).join(roots.select("root"), "root")
    best = F.max_by("root", F.length("root"))
    return above.groupBy(*rows.columns).agg(best.alias("root"))


def without_echoes(events: DataFrame, own: DataFrame, ttl_s: int = ECHO_S) -> DataFrame:
    """Events that do not follow one of our own writes (path, at) to the same path within the time."""
    o = own.select(F.col("path").alias("own_path"), F.col("at").alias("own_at"))
    near = (events.path == o.own_path) & (events.ts >= o.own_at) & (events.ts <= F.expr(f"own_at + interval {ttl_s} seconds"))
    return events.join(o, near, "left_anti")


def without_echoes_stream(events: DataFrame, own: DataFrame, ttl_s: int = ECHO_S, lateness_s: int = 60) -> DataFrame:
    """The same over two streams. Left rows wait until no echo can come, that is until both streams are past them; so state is bounded by the watermarks."""
    e = events.withWatermark("ts", f"{lateness_s} seconds")
    o = own.select(F.col("path").alias("own_path"), F.col("at").alias("own_at")).withWatermark("own_at", f"{lateness_s} seconds")
    joined = e.join(o, F.expr(f"path = own_path and ts >= own_at and ts <= own_at + interval {ttl_s} seconds"), "leftOuter")
    return joined.where("own_path is null").drop("own_path", "own_at")


def next_wait(wait_s: int, changed: bool, failures: int) -> int:
    """Seconds until the next look: doubling while nothing changes, back to the least when something does, a ladder after failures."""
    if failures:
        return LADDER[min(failures, len(LADDER)) - 1]
    return LEAST_S if changed else min(MOST_S, max(LEAST_S, wait_s * 2))


def polls(looks: DataFrame) -> DataFrame:
    """root, look, changed, wait_s of a stream of looks (root, look, digest, failed): what changed, and how long to wait next."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        digest, wait, failures = state.get if state.exists else (None, 0, 0)
        rows = pd.concat(list(frames)).sort_values("look")
        out = []
        for r in rows.itertuples():
            if r.failed:
                failures += 1
                changed = False
            else:
                changed, failures, digest = r.digest != digest, 0, r.digest
            wait = next_wait(wait, changed, failures)
            out.append((key[0], r.look, changed, wait))
        state.update((digest, wait, failures))
        yield pd.DataFrame(out, columns=["root", "look", "changed", "wait_s"])

    return looks.groupBy("root").applyInPandasWithState(step, "root string, look long, changed boolean, wait_s int", "digest string, wait int, failures int", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """All that a stream has now, written to a folder as Parquet and read back."""
    query = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def look(mode: str, plan, act) -> str:
    """What a look at a settled root does: only ``enforce`` acts, and never on a plan over its limit."""
    if mode != "enforce":
        return "reported"
    if plan.over_limit:
        return "held"
    act(plan)
    return "applied"


def with_rescans(events: DataFrame, errors: DataFrame, roots: DataFrame) -> DataFrame:
    """Events and, for each lost event (ts, and path or null for all), one event in every root that it may concern."""
    around = F.explode(F.concat(F.array("path"), paths.ancestors(F.col("path"))))
    known = errors.where("path is not null").select("ts", around.alias("root")).join(roots.select("root"), "root")
    # Where nothing is known, an event for each root is the result itself.
    unknown = errors.where("path is null").select("ts").crossJoin(roots.select("root"))
    lost = known.unionByName(unknown)
    return events.unionByName(lost.select("root", F.col("root").alias("path"), F.lit("rescan").alias("kind"), "ts"), allowMissingColumns=True)


def sweeps(roots: DataFrame, start, end, every_s: int = 3600) -> DataFrame:
    """root, ts of the regular full looks between two instants (columns), one at the start."""
    times = F.sequence(start, end, F.expr(f"interval {every_s} seconds"))
    return roots.select("root", F.explode(times).alias("ts"))
