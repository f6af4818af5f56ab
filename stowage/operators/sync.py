"""Keeping several copies of a tree alike, against what they held when last alike.

Listings have member, path, size, mtime, digest (null if unread); the baseline
has member, path, present, size, mtime, digest. Every path is decided from its
own rows alone: one grouping by path over members and baseline, and from there
on projections.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.functions import paths


@dataclass(frozen=True)
class Mode:
    """direction: push (the anchor sends), pull (the anchor receives) or all."""

    direction: str = "all"
    anchor: str | None = None
    exact: bool = False
    on_conflict: str = "quarantine"  # quarantine, rename, skip
    on_remove: str = "trash"
    cooldown_ms: int = 0
    now_ms: int = 0

    def sends(self, member: Column) -> Column:
        return F.lit(True) if self.direction == "all" else (member == self.anchor) if self.direction == "push" else (member != self.anchor)

    def receives(self, member: Column) -> Column:
        return F.lit(True) if self.direction == "all" else (member != self.anchor) if self.direction == "push" else (member == self.anchor)


def usable(path: Column) -> Column:
    return ~paths.is_reserved(path) & ~paths.is_partial(path)


def states(members: DataFrame, listings: DataFrame, baseline: DataFrame) -> DataFrame:
    """member, path, state, and what is there now, for every path that any member or the baseline has.

    States: new, missing, gone, deleted, changed, unchanged, question (a
    digest has to be read before anything about the path is decided).
    """
    now = listings.select("member", "path", F.struct("size", "mtime", "digest").alias("now"))
    then = baseline.select("member", "path", F.struct("present", "size", "mtime", "digest").alias("then"))
    seen = now.join(then, ["member", "path"], "full").where(usable(F.col("path")))
    # A path that only some members hold is missing at the others.
    names = [r.member for r in members.select("member").distinct().collect()]  # as many as a sync has ends
    every = seen.select("path").distinct().select("path", F.explode(F.array(*map(F.lit, names))).alias("member"))
    rows = every.join(seen, ["member", "path"], "left")
    both_clocks = F.col("now.mtime").isNotNull() & F.col("then.mtime").isNotNull()
    changed = (
        F.when(F.col("now.size") != F.col("then.size"), F.lit(True))
        .when(both_clocks, F.col("now.mtime") != F.col("then.mtime"))
        .when(F.col("then.digest").isNull(), F.lit(False))
        .otherwise(F.col("now.digest") != F.col("then.digest"))
    )
    present = F.coalesce(F.col("then.present"), F.lit(False))
    state = (
        F.when(F.col("now").isNotNull() & ~present, "new")
        .when(F.col("now").isNull() & F.col("then").isNull(), "missing")
        .when(F.col("now").isNull() & ~present, "gone")
        .when(F.col("now").isNull(), "deleted")
        .when(changed.isNull(), "question").when(changed, "changed").otherwise("unchanged")
    )
    return rows.select("member", "path", state.alias("state"), F.col("now.size").alias("size"), F.col("now.mtime").alias("mtime"), F.coalesce("now.digest", F.when(~F.coalesce(changed, F.lit(True)), F.col("then.digest"))).alias("digest"))


def decide(members: DataFrame, listings: DataFrame, baseline: DataFrame, mode: Mode) -> DataFrame:
    """path, member, action, origin, why: one row for each member's part in each path that is not alike everywhere.

    Actions: copy (from origin), remove, park (its own version goes aside and
    origin's comes), record (alike already), wait (too young, or a question),
    conflict (left alone).
    """
    rows = states(members, listings, baseline).withColumn("sends", mode.sends(F.col("member"))).withColumn("receives", mode.receives(F.col("member")))
    moved = F.col("state").isin("new", "changed")
    held = F.col("state").isin("new", "changed", "unchanged")
    rows = rows.withColumn("moved", moved).withColumn("held", held)
    young = F.lit(mode.cooldown_ms > 0) & moved & F.col("mtime").isNotNull() & (F.lit(mode.now_ms) - F.unix_millis("mtime") < mode.cooldown_ms)
    version = F.struct(F.coalesce("digest", F.concat_ws("@", "member", F.col("size").cast("string"), F.unix_millis("mtime").cast("string"))).alias("content"), F.col("size"))
    rows = rows.withColumn("version", version)
    first = lambda c: F.min(F.when(c, F.col("member")))
    of_path = rows.groupBy("path").agg(
        F.max(young.cast("int")).alias("young"), F.max((F.col("state") == "question").cast("int")).alias("question"),
        first(F.col("moved") & F.col("sends")).alias("mover"), first(F.col("held") & F.col("sends") & ~F.col("moved")).alias("still"),
        F.max((F.col("state") == "deleted").cast("int")).alias("any_deleted"),
        F.min(F.when(F.col("moved") & F.col("sends"), F.col("version.content"))).alias("low"), F.max(F.when(F.col("moved") & F.col("sends"), F.col("version.content"))).alias("high"),
    )
    of_path = of_path.withColumn("origin", F.coalesce("mover", "still"))
    source = rows.select("path", F.col("member").alias("origin"), F.col("version").alias("wanted"))
    rows = rows.join(of_path, "path").join(source, ["path", "origin"], "left")
    removed = F.lit(mode.exact) & F.col("mover").isNull() & (F.col("origin").isNull() | (F.lit(mode.direction == "all") & (F.col("any_deleted") == 1)))
    same = F.col("version.content") == F.col("wanted.content")
    clash = F.col("moved") & ~same & (F.col("member") != F.col("origin"))
    action = (
        F.when((F.col("young") == 1) | (F.col("question") == 1), "wait")
        .when(removed, F.when(F.col("held") & F.col("receives"), "remove"))
        .when(F.col("origin").isNull() | (F.col("member") == F.col("origin")), None)
        .when(F.col("held") & same, F.when(F.col("moved"), "record"))
        .when(clash & ((F.col("low") != F.col("high")) | ~F.col("sends")), F.lit({"quarantine": "park", "rename": "park", "skip": "conflict"}[mode.on_conflict]))
        .when(F.col("receives") & (F.col("mover").isNotNull() | ~F.col("held") & (F.col("state") != "deleted") | (F.col("state") == "deleted") & F.lit(not mode.exact)), "copy")
    )
    why = F.when(F.col("young") == 1, "cooling").when(F.col("question") == 1, "unread").otherwise(F.col("state"))
    return rows.withColumn("action", action).where(F.col("action").isNotNull()).select("path", "member", "action", F.when(F.col("action").isin("copy", "park"), F.col("origin")).alias("origin"), why.alias("why"))


def moves(listings: DataFrame, baseline: DataFrame) -> DataFrame:
    """member, source, target: what one member moved, by equal size and digest, paired in path order."""
    gone = baseline.where("present").join(listings, ["member", "path"], "left_anti").where(F.col("digest").isNotNull())
    fresh = listings.join(baseline.where("present"), ["member", "path"], "left_anti").where(F.col("digest").isNotNull())
    n = F.row_number().over(W.partitionBy("member", "size", "digest").orderBy("path"))
    a = gone.select("member", "size", "digest", F.col("path").alias("source"), n.alias("n"))
    b = fresh.select("member", "size", "digest", F.col("path").alias("target"), n.alias("n"))
    return a.join(b, ["member", "size", "digest", "n"]).select("member", "source", "target")


def cleanly_moved(found: DataFrame, members: DataFrame, listings: DataFrame) -> DataFrame:
    """The moves whose target no other member holds, so that they can be carried over by a rename."""
    others = listings.select(F.col("member").alias("other"), F.col("path").alias("target"))
    taken = found.join(others, "target").where("other <> member").select("member", "source", "target")
    return found.join(taken, ["member", "source", "target"], "left_anti")


def case_clashes(listings: DataFrame) -> DataFrame:
    """member, low, high: different paths of one member that are one on volumes that ignore case."""
    rows = listings.select("member", F.lower("path").alias("key"), "path")
    many = rows.groupBy("member", "key").agg(F.min("path").alias("low")).select("member", "key", "low")
    return rows.join(many, ["member", "key"]).where("path <> low").select("member", "low", F.col("path").alias("high"))


def legs(decided: DataFrame, listings: DataFrame) -> DataFrame:
    """origin, member, files, bytes of what has to be carried from one member to another."""
    size = listings.select(F.col("member").alias("origin"), "path", "size")
    return decided.where(F.col("action").isin("copy", "park")).join(size, ["origin", "path"]).groupBy("origin", "member").agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


def member_blast(members: DataFrame, listings: DataFrame, decided: DataFrame) -> DataFrame:
    """member, adding, replacing, removing, of, over_limit."""
    of = listings.groupBy("member").agg(F.count(F.lit(1)).alias("of"))
    there = listings.select("member", "path", F.lit(1).alias("there"))
    acts = decided.join(there, ["member", "path"], "left").groupBy("member").agg(
        F.count_if((F.col("action") == "copy") & F.col("there").isNull()).alias("adding"),
        F.count_if(F.col("action").isin("copy", "park") & F.col("there").isNotNull()).alias("replacing"),
        F.count_if(F.col("action") == "remove").alias("removing"),
    )
    out = members.select("member").join(of, "member", "left").join(acts, "member", "left").na.fill(0)
    hit = F.col("removing") + F.col("replacing")
    return out.withColumn("over_limit", (hit > 500) | ((hit * 5 >= F.col("of")) & (hit > 0)))


def hollow(members: DataFrame, listings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Members that list nothing although the baseline has files of theirs: an unmounted disk rather than deletions."""
    held = baseline.where("present").select("member").distinct()
    return members.select("member").join(held, "member", "left_semi").join(listings.select("member").distinct(), "member", "left_anti")


def refused(members: DataFrame, listings: DataFrame, baseline: DataFrame, decided: DataFrame) -> DataFrame:
    """member, why (hollow, blast) of members for which a run must be asked about."""
    over = member_blast(members, listings, decided).where("over_limit").select("member", F.lit("blast").alias("why"))
    return hollow(members, listings, baseline).select("member", F.lit("hollow").alias("why")).unionByName(over)


def unattended(decided: DataFrame) -> DataFrame:
    """One row: whether a run may go on by itself, having nothing to remove, park or ask."""
    return decided.agg((F.count_if(F.col("action").isin("remove", "park", "conflict")) == 0).alias("unattended"))


def apply_on_paper(listings: DataFrame, decided: DataFrame) -> DataFrame:
    """The listings after the decided actions."""
    gone = decided.where(F.col("action").isin("remove", "copy", "park")).select("member", "path")
    new = decided.where(F.col("action").isin("copy", "park")).select("member", "path", "origin").join(listings.withColumnRenamed("member", "origin"), ["origin", "path"])
    aside = decided.where("action = 'park'").select("member", "path").join(listings, ["member", "path"]).withColumn("path", paths.parked(F.col("path")))
    return listings.join(gone, ["member", "path"], "left_anti").unionByName(new.select(*listings.columns)).unionByName(aside.select(*listings.columns))


def baseline_after(listings: DataFrame, decided: DataFrame) -> DataFrame:
    """What to remember after a run: everything held, except paths of which some part did not happen."""
    open_paths = decided.where(F.col("action").isin("wait", "conflict")).select("path").distinct()
    return apply_on_paper(listings, decided).join(open_paths, "path", "left_anti").where(usable(F.col("path"))).withColumn("present", F.lit(True))


def questions(members: DataFrame, listings: DataFrame, baseline: DataFrame) -> DataFrame:
    """member, path of files whose digest has to be read before their paths can be decided."""
    return states(members, listings, baseline).where("state = 'question'").select("member", "path")


def answered(listings: DataFrame, digests: DataFrame) -> DataFrame:
    """The listings with digests (member, path, digest) that were read since."""
    new = digests.select("member", "path", F.col("digest").alias("_read"))
    return listings.join(new, ["member", "path"], "left").withColumn("digest", F.coalesce("digest", "_read")).drop("_read")


def decide_reading(members: DataFrame, listings: DataFrame, baseline: DataFrame, mode: Mode, read, rounds: int = 8) -> DataFrame:
    """As ``decide``, reading digests for as long as there are questions. ``read`` takes (member, path) rows and adds ``digest``."""
    for _ in range(rounds):
        asked = questions(members, listings, baseline)
        if asked.isEmpty():
            break
        listings = answered(listings, read(asked))
    return decide(members, listings, baseline, mode)


def undone(acts: DataFrame, listings_before: DataFrame, listings_now: DataFrame) -> DataFrame:
    """member, path, action (restore, remove) that takes a run back where what it delivered is unchanged; refused elsewhere."""
    before = listings_before.select("member", "path", F.col("digest").alias("was"))
    now = listings_now.select("member", "path", F.col("digest").alias("is"))
    origin = listings_before.select(F.col("member").alias("origin"), "path", F.col("digest").alias("sent"))
    rows = acts.where(F.col("action").isin("copy", "park", "remove")).join(before, ["member", "path"], "left").join(now, ["member", "path"], "left").join(origin, ["origin", "path"], "left")
    unchanged = F.when(F.col("action") == "remove", F.col("is").isNull()).otherwise(F.coalesce(F.col("is") == F.col("sent"), F.lit(False)))
    return rows.select("member", "path", F.when(~unchanged, "refused").when(F.col("was").isNull(), "remove").otherwise("restore").alias("action"))


def routes(holders: DataFrame, members: DataFrame, wanted: DataFrame) -> DataFrame:
    """path, member, origin: from whom each copy is best taken: a local holder, then one of the member's own connection, then the first.

    Holders have path, origin; members have member, local, connection; wanted has path, member.
    """
    of = members.select(F.col("member").alias("origin"), F.col("local").alias("o_local"), F.col("connection").alias("o_connection"))
    rows = wanted.join(members, "member").join(holders.join(of, "origin"), "path").where("origin <> member")
    rank = F.struct(F.when(F.col("o_local"), 0).when(F.col("o_connection") == F.col("connection"), 1).otherwise(2).alias("rank"), F.col("origin").alias("origin"))
    return rows.groupBy("path", "member").agg(F.min(rank)["origin"].alias("origin"))
