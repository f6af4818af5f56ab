"""Plans: the ordered operations that bring a tree to the shape a policy wants.

Deciding what each file wants is one projection. Names are then given out
within each family of names of a target directory, the only place where two
wants can meet: a name and its numbered variants. Ordering joins operations on
the paths they touch.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable
from dataclasses import dataclass
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from stowage.functions import grammar, paths
from stowage.operators.classify import complete, place
from stowage.operators.graph import checkpointed, components, numbered
from stowage.plans.policy import Policy

#: Numbers tried for a taken name; a plan is over its limit from so many files, or such a share of all, on.
NUMBERS, MOST_FILES, MOST_SHARE = 1000, 500, 5
OPS = "op string, source string, target string, because string"


def wanted(inventory: DataFrame, policy: Policy) -> DataFrame:
    """Adds ``want`` (where a file should be, or null) and ``reason`` (why it stays, or null).

    Reasons: reserved, ignored, opaque, unresolvable, unmatched, already_there,
    cooling. Directories have neither.
    """
    files = complete(inventory).where(~F.coalesce(F.col("is_dir"), F.lit(False)))
    placed = place(files, policy)
    want = F.col("target")
    if policy.inbox is not None:
        box = paths.canonical(F.lit(policy.inbox))
        want = F.when(F.col("outcome") == "unmatched", paths.joined(box, paths.sanitize(paths.name(F.col("path"))))).otherwise(want)
        there = (F.col("outcome") == "unmatched") & (paths.parent(F.col("path")) == box)
    else:
        there = F.lit(False)
    cool = grammar.cooling(F.col("now"), F.col("mtime"), policy.cooldown)
    reason = (
        F.when(paths.is_reserved(F.col("path")), "reserved")
        .when(F.col("outcome").isin("ignored", "opaque", "unresolvable"), F.col("outcome"))
        .when(F.col("_want").isNull(), "unmatched")
        .when((F.col("_want") == F.col("path")) | there, "already_there")
        .when(cool.isNotNull(), "cooling")
    )
    return (
        placed.withColumn("_want", want).withColumn("reason", reason)
        .withColumn("waits", F.when(F.col("reason") == "cooling", cool))
        .withColumn("want", F.when(F.col("reason").isNull(), F.col("_want"))).drop("_want")
    )


def assign(decided: DataFrame, inventory: DataFrame, policy: Policy) -> DataFrame:
    """path, kind (move, quarantine, replace, skipped, blocked), final: the names that movers get.

    Movers are taken in path order. A name is free if it is the mover's own, or
    neither claimed nor held by a file that stays; a name that another mover
    leaves is free. Arrivals that want one name are numbered, whatever the
    policy says about files already there.
    """
    # What is decided is read several times from here on.
    decided = checkpointed(decided.select("path", "want"))
    movers = decided.where(F.col("want").isNotNull()).select("path", "want")
    stays = decided.where(F.col("want").isNull()).select("path")
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    folders = inventory.where(is_dir).select("path").union(inventory.where(~is_dir).select(F.explode(paths.ancestors(F.col("path"))))).distinct()
    how, most = policy.on_conflict, NUMBERS
    plain = lambda rows, kind, final: rows.select("path", F.lit(kind).alias("kind"), final.cast("string").alias("final"))
    none = F.lit(None)

    # A want that a folder holds, or a file that stays where that decides, is settled whatever the others want.
    barred = movers.join(folders.select(F.col("path").alias("want")), "want", "left_semi")
    done, left = [plain(barred, "blocked", none)], movers.join(folders.select(F.col("path").alias("want")), "want", "left_anti")
    if how in ("skip", "quarantine"):
        taken = stays.select(F.col("path").alias("want"))
        hit = left.join(taken, "want", "left_semi")
        done.append(plain(hit, "skipped", none) if how == "skip" else plain(hit, "quarantine", F.concat(F.lit(f"{paths.QUARANTINE}/"), "path")))
        left = left.join(taken, "want", "left_anti")
    left = checkpointed(left.withColumn("family", _family(F.col("want"))))

    # Behind as many movers as there are numbers, a want has no name left, but for files that have one of its names already.
    first = left.withColumn("_rank", F.row_number().over(W.partitionBy("want").orderBy("path"))).where(F.col("_rank") <= most + 1).select("path")
    late = left.join(first, "path", "left_anti").where(_family(F.col("path")) != F.col("family"))
    done.append(plain(late, "blocked", none))
    left = checkpointed(left.join(late.select("path"), "path", "left_anti"))

    # A family in which every want is wanted once and free needs no numbers.
    wants = left.groupBy("family", "want").agg(F.count(F.lit(1)).alias("n"))
    wants = wants.join(stays.select(F.col("path").alias("want"), F.lit(1).alias("held")), "want", "left")
    contested = checkpointed(wants.where("n > 1 or held = 1").select("family").distinct())
    calm = left.join(contested, "family", "left_anti")
    done.append(calm.select("path", F.when(F.col("want") == F.col("path"), "already_there").otherwise("move").alias("kind"), F.col("want").alias("final")))

    of = lambda rows, role: rows.select(_family(F.col("path")).alias("family"), F.lit(role).alias("role"), "path", F.col("path").alias("want"))
    rows = left.select("family", F.lit("mover").alias("role"), "path", "want").unionByName(of(stays, "stays")).unionByName(of(folders, "folder"))
    rows = rows.join(contested, "family", "left_semi")

    def give(group: pd.DataFrame) -> pd.DataFrame:
        role = {r: set(group.loc[group.role == r, "path"]) for r in ("stays", "folder")}
        wanted_ = group[group.role == "mover"].sort_values("path")[["path", "want"]].itertuples(index=False, name=None)
        return pd.DataFrame(given(wanted_, role["stays"], role["folder"], how, most), columns=["path", "kind", "final"])

    done.append(rows.groupBy("family").applyInPandas(give, "path string, kind string, final string"))
    return reduce(DataFrame.unionByName, done)


def given(movers: Iterable[tuple[str, str]], held: set[str], folders: set[str], how: str, most: int) -> list[tuple]:
    """(path, kind, final) of movers (path, want) in the order of their paths."""
    claimed: set[str] = set()
    held = set(held)
    #: The number from which on a want's names have not been tried; names are never given back.
    untried: dict[str, int] = {}
    out = []

    def free(name: str) -> bool:
        return name not in claimed and name not in held and name not in folders

    for path, want in movers:
        final, kind = want, "move"
        if want in folders:
            out.append((path, "blocked", None))
            continue
        if want in claimed or want in held:
            standing = want in held and want not in claimed
            if standing and how == "skip":
                out.append((path, "skipped", None))
                continue
            if standing and how == "quarantine":
                out.append((path, "quarantine", f"{paths.QUARANTINE}/{path}"))
                continue
            if standing and how == "replace":
                kind = "replace"
                held.discard(want)
            else:
                n = untried.get(want, 1)
                while n <= most and not free(_numbered(want, n)):
                    if _numbered(want, n) == path:
                        break
                    n += 1
                untried[want] = n
                own = next((k for k in range(1, min(n, most + 1)) if _numbered(want, k) == path), None) if _same_family(path, want) else None
                final = path if own else _numbered(want, n) if n <= most else None
                if final is None:
                    out.append((path, "blocked", None))
                    continue
        claimed.add(final)
        out.append((path, "already_there" if final == path else kind, final))
    return out


def _same_family(path: str, want: str) -> bool:
    """Whether a path can be a numbered variant of a want."""
    return path.rpartition("/")[0] == want.rpartition("/")[0] and path.startswith(want.rpartition(".")[0] if "." in want.rpartition("/")[2][1:] else want)


def _family(path: Column) -> Column:
    """What a path and all its numbered variants share."""
    n = paths.name(path)
    return F.concat_ws("/", paths.parent(path), F.regexp_replace(paths.stem(n), "(-[0-9]+)+$", ""), paths.ext(n))


def _numbered(path: str, n: int) -> str:
    directory, slash, own = path.rpartition("/")
    head, dot, tail = own.rpartition(".")
    return f"{directory}{slash}{head}-{n}.{tail}" if dot and head else f"{directory}{slash}{own}-{n}"


def directory_ops(inventory: DataFrame, moves: DataFrame) -> DataFrame:
    """mkdir and rmdir operations around moves (source, target): missing ancestors, and directories that the plan empties."""
    files = inventory.where(~F.coalesce(F.col("is_dir"), F.lit(False))).select("path")
    there = (
        inventory.where(F.coalesce(F.col("is_dir"), F.lit(False))).select("path")
        .union(files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"))).distinct()
    )
    needed = moves.select(F.explode(paths.ancestors(F.col("target"))).alias("path")).distinct()
    made = needed.join(there, "path", "left_anti").select(F.lit("mkdir").alias("op"), F.lit(None).cast("string").alias("source"), F.col("path").alias("target"), F.lit("needed").alias("because"))
    counts = (
        files.select(F.explode(paths.ancestors(F.col("path"))).alias("path"), F.lit(1).alias("n"), F.lit(0).alias("out"))
        .unionAll(moves.select(F.explode(paths.ancestors(F.col("source"))).alias("path"), F.lit(-1).alias("n"), F.lit(1).alias("out")))
        .unionAll(moves.select(F.explode(paths.ancestors(F.col("target"))).alias("path"), F.lit(1).alias("n"), F.lit(0).alias("out")))
        .groupBy("path").agg(F.sum("n").alias("left"), F.sum("out").alias("out"))
    )
    gone = counts.where("left = 0 and out > 0").join(there, "path", "left_semi").where(~paths.is_reserved(F.col("path")))
    return made.unionByName(gone.select(F.lit("rmdir").alias("op"), F.col("path").alias("source"), F.lit(None).cast("string").alias("target"), F.lit("emptied").alias("because")))


def blast(inventory: DataFrame, ops: DataFrame) -> DataFrame:
    """One row: files moved, of how many, their bytes, directories created and removed, and whether that is over the limit."""
    files = complete(inventory).where(~F.coalesce(F.col("is_dir"), F.lit(False))).select("path", "size")
    moved = ops.where(F.col("op").isin("move", "quarantine", "trash")).select(F.col("source").alias("path"), F.lit(1).alias("moved"))
    zero = F.lit(0)
    one = files.join(moved, "path", "left").select(F.coalesce("moved", zero).alias("files"), F.lit(1).alias("of"), F.when(F.col("moved") == 1, F.col("size")).otherwise(0).alias("bytes"), zero.alias("created"), zero.alias("removed"))
    two = ops.select(zero.alias("files"), zero.alias("of"), zero.alias("bytes"), (F.col("op") == "mkdir").cast("int").alias("created"), (F.col("op") == "rmdir").cast("int").alias("removed"))
    out = one.unionByName(two).agg(*[F.coalesce(F.sum(c), zero).cast("long").alias(c) for c in ("files", "of", "bytes", "created", "removed")])
    return out.withColumn("over_limit", (F.col("files") > MOST_FILES) | (F.col("files") * MOST_SHARE >= F.col("of")) & (F.col("files") > 0))


def waiting(decided: DataFrame) -> DataFrame:
    """One row: how many files cool down, and the longest wait."""
    return decided.agg(F.count_if(F.col("reason") == "cooling").alias("waiting"), F.coalesce(F.max("waits"), F.lit(0)).alias("longest_wait"))


@dataclass
class Plan:
    """A plan's operations in order (ordinal, op, source, target, because), what stays, and whether a second plan would be empty."""

    ops: DataFrame
    untouched: DataFrame
    settles: bool


def operations(inventory: DataFrame, policy: Policy) -> tuple[DataFrame, DataFrame]:
    """(operations without order, files that stay with their reasons)."""
    # Classification is read by every step that follows, so it is computed once; in narrow columns.
    decided = checkpointed(wanted(inventory, policy).select("path", "want", "reason"))
    names = checkpointed(assign(decided, complete(inventory), policy))
    moves = names.where(F.col("kind").isin("move", "quarantine", "replace"))
    ops = moves.select(F.when(F.col("kind") == "quarantine", "quarantine").otherwise("move").alias("op"), F.col("path").alias("source"), F.col("final").alias("target"), F.lit("policy").alias("because"))
    evicted = names.where("kind = 'replace'").select(F.lit("quarantine").alias("op"), F.col("final").alias("source"), paths.parked(F.col("final")).alias("target"), F.lit("replaced").alias("because"))
    ops = ops.unionByName(evicted)
    stays = (
        decided.where(F.col("reason").isNotNull()).select("path", "reason")
        .unionByName(names.where(F.col("kind").isin("blocked", "skipped", "already_there")).select("path", F.col("kind").alias("reason")))
    )
    return checkpointed(ops.unionByName(directory_ops(complete(inventory), ops.select("source", "target")))), stays


def edges(ops: DataFrame) -> DataFrame:
    """(first, then) pairs of operations by id: what must happen before what."""
    moves = ops.where(F.col("op").isin("move", "quarantine")).select("id", "source", "target")
    mkdirs = ops.where("op = 'mkdir'").select("id", "target")
    rmdirs = ops.where("op = 'rmdir'").select("id", "source")

    def pairs(a: DataFrame, a_key, b: DataFrame, b_key) -> DataFrame:
        x, y = a.select(F.col("id").alias("first"), a_key.alias("k")), b.select(F.col("id").alias("then"), b_key.alias("k"))
        return x.join(y, "k").select("first", "then").where("first <> then")

    up = lambda c: F.explode(paths.ancestors(F.col(c)))
    return (
        pairs(mkdirs, F.col("target"), mkdirs.select("id", up("target").alias("a")), F.col("a"))  # parents first
        .union(pairs(mkdirs, F.col("target"), moves.select("id", up("target").alias("a")), F.col("a")))  # a place before what lands there
        .union(pairs(moves, F.col("source"), moves, F.col("target")))  # leave before another takes the name
        .union(pairs(moves, F.col("source"), mkdirs, F.col("target")))  # a file off the name of a new directory
        .union(pairs(moves.select("id", up("source").alias("a")), F.col("a"), rmdirs, F.col("source")))  # all out before a directory goes
        .union(pairs(rmdirs.select("id", up("source").alias("a")).select("id", "a"), F.col("a"), rmdirs, F.col("source")))  # children first
        .distinct()
    )


def ordered(ops: list[tuple], before: list[tuple[int, int]]) -> list[tuple]:
    """Operations (id, op, source, target, because) in an order that can be executed; ties by the order given.

    A ring of moves is broken by sending its first one to a name of its own,
    and from there on to its target at the end.
    """
    by_id = {o[0]: o for o in ops}
    rank = {o[0]: k for k, o in enumerate(ops)}
    after: dict[int, set[int]] = {i: set() for i in by_id}
    count = dict.fromkeys(by_id, 0)
    for a, b in set(before):
        after[a].add(b)
        count[b] += 1
    out, late = [], []
    ready = [(rank[i], i) for i, n in count.items() if n == 0]
    heapq.heapify(ready)
    left = set(by_id)
    while left:
        while ready:
            _, i = heapq.heappop(ready)
            left.discard(i)
            out.append(by_id[i])
            for j in after[i]:
                count[j] -= 1
                if count[j] == 0 and j in left:
                    heapq.heappush(ready, (rank[j], j))
        if left:
            # What is left waits in rings: the first move steps aside, so its place is free.
            i = next(i for i in sorted(left, key=rank.get) if by_id[i][1] in ("move", "quarantine") and _in_ring(i, after, left))
            _, op, source, target, because = by_id[i]
            # Beside its source, whose directory is there; that of its target may not be yet.
            aside = f"{source}.stowage-{rank[i]}-swap"
            out.append((i, "move", source, aside, "swap"))
            late.append((i, op, aside, target, because))
            left.discard(i)
            for j in after[i]:
                count[j] -= 1
                if count[j] == 0 and j in left:
                    heapq.heappush(ready, (rank[j], j))
    rmdirs = [o for o in out if o[1] == "rmdir"]
    return [o for o in out if o[1] != "rmdir"] + late + rmdirs


def _in_ring(i: int, after: dict[int, set[int]], left: set[int]) -> bool:
    seen, todo = set(), [j for j in after[i] if j in left]
    while todo:
        j = todo.pop()
        if j == i:
            return True
        if j not in seen:
            seen.add(j)
            todo += [k for k in after[j] if k in left]
    return False


def in_order(ops: DataFrame) -> DataFrame:
    """ordinal, op, source, target, because: operations in an order that can be executed, found without gathering them.

    First come directories on whose names no file has to be waited for, by
    depth; last come moves that nothing waits for, and behind them directories
    to remove, deepest first. What is left between are chains and rings of names
    that are handed on; each is sequential by nature and ordered in one place,
    apart from the others.
    """
    canonical = [F.asc_nulls_first(c) for c in ("op", "source", "target", "because")]
    rows = checkpointed(numbered(ops, *canonical).withColumnRenamed("place", "id"))
    is_move = F.col("op").isin("move", "quarantine")
    mkdirs = rows.where("op = 'mkdir'").select("id", "target")
    # Directories that wait for a file to leave their own name or that of one above them.
    held = rows.where(is_move).select(F.col("source").alias("k")).distinct()
    above = mkdirs.select("id", F.explode(F.concat(F.array("target"), paths.ancestors(F.col("target")))).alias("k"))
    waits = above.join(held, "k", "left_semi").select("id").distinct()
    acts = rows.where("op <> 'rmdir'").join(waits.withColumn("waits", F.lit(True)), "id", "left").where(is_move | F.col("waits")).drop("waits")
    links = checkpointed(edges(acts))
    knots = checkpointed(links.where("first <> then").select(F.col("first").alias("id")).distinct())
    inner = links.join(knots.withColumnRenamed("id", "then"), "then", "left_semi")
    between = _handed_on(acts.join(knots, "id", "left_semi"), checkpointed(inner)) if not knots.isEmpty() else None

    def phase(of: DataFrame, n: int, depth: Column, group: Column, step: Column) -> DataFrame:
        return of.select(F.lit(n).alias("_phase"), depth.cast("int").alias("_depth"), group.cast("long").alias("_group"), step.cast("long").alias("_step"), "op", "source", "target", "because")

    none, own = F.lit(0), F.col("id")
    parts = [
        phase(rows.where("op = 'mkdir'").join(waits, "id", "left_anti"), 0, paths.depth(F.col("target")), own, none),
        phase(acts.join(knots, "id", "left_anti"), 2, none, own, none),
        phase(rows.where("op = 'rmdir'"), 3, -paths.depth(F.col("source")), own, none),
    ]
    if between is not None:
        parts.append(phase(between, 1, none, F.col("root"), F.col("step")))
    placed = numbered(reduce(DataFrame.unionByName, parts), F.col("_phase"), F.col("_depth"), F.col("_group"), F.col("_step"))
    return checkpointed(placed.select((F.col("place") - 1).alias("ordinal"), "op", "source", "target", "because"))


def _handed_on(acts: DataFrame, links: DataFrame) -> DataFrame:
    """root, step, op, source, target, because of operations (id and the rest), each set of linked ones in order."""
    labels = components(links.select(F.col("first").alias("a"), F.col("then").alias("b")).union(acts.select(F.col("id").alias("a"), F.col("id").alias("b"))))
    of = acts.join(labels, acts.id == labels.node).select("root", *acts.columns)
    within = links.join(labels, links["first"] == labels.node).select(F.col("root").alias("of"), "first", "then")

    def order(ops: pd.DataFrame, before: pd.DataFrame) -> pd.DataFrame:
        rows = [tuple(None if pd.isna(x) else x for x in r) for r in ops.sort_values("id")[["id", "op", "source", "target", "because"]].itertuples(index=False)]
        out = ordered(rows, list(before[["first", "then"]].itertuples(index=False, name=None)))
        return pd.DataFrame([(ops["root"].iloc[0], k, *o[1:]) for k, o in enumerate(out)], columns=["root", "step", "op", "source", "target", "because"])

    return of.groupBy("root").cogroup(within.groupBy("of")).applyInPandas(order, "root long, step long, " + OPS)


def plan(inventory: DataFrame, policy: Policy) -> Plan:
    """The plan for a tree."""
    ops, stays = operations(inventory, policy)
    final = in_order(ops)
    again, _ = operations(apply_on_paper(inventory, final), policy)
    return Plan(final, stays, again.where(F.col("op").isin("move", "quarantine")).isEmpty())


def apply_on_paper(inventory: DataFrame, ops: DataFrame) -> DataFrame:
    """The inventory after the operations: the last place that each file's chain of moves leads to."""
    whole = complete(inventory)
    steps = ops.where(F.col("op").isin("move", "quarantine")).select("source", "target", "because")
    hop = steps.where("because = 'swap'").select(F.col("source").alias("path"), F.col("target").alias("aside"))
    on = steps.where("because <> 'swap'").select(F.col("source").alias("from_path"), F.col("target").alias("to"))
    direct = on.join(hop, on.from_path == hop.aside, "left").select(F.coalesce("path", "from_path").alias("path"), "to")
    moved = whole.join(direct, "path", "left")
    gone = ops.where("op = 'rmdir'").select(F.col("source").alias("path"))
    new = ops.where("op = 'mkdir'").select(F.col("target").alias("path"), F.lit(True).alias("is_dir"))
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    after = moved.withColumn("path", F.coalesce("to", "path")).drop("to")
    after = after.where(~is_dir).unionByName(after.where(is_dir).join(gone, "path", "left_anti").select(*after.columns))
    return after.unionByName(new, allowMissingColumns=True).select(*whole.columns)


def broken_steps(inventory: DataFrame, ops: DataFrame) -> DataFrame:
    """ordinal, op, path, why of operations that can't run when their turn comes, each judged as if all before it had run.

    What holds a path changes at few operations, so each path has intervals of
    ordinals, and what an operation needs is looked up in them. Set-aside
    places are not in inventories: what is said of them is taken as true.
    """
    whole = complete(inventory)
    is_dir = F.coalesce(F.col("is_dir"), F.lit(False))
    held = whole.select("path", F.when(is_dir, "dir").otherwise("file").alias("holds")).union(whole.select(F.explode(paths.ancestors(F.col("path"))), F.lit("dir"))).distinct()

    def steps(kinds: tuple[str, ...], path: str | Column, *more: Column) -> DataFrame:
        return ops.where(F.col("op").isin(*kinds)).select((F.col(path) if isinstance(path, str) else path).alias("path"), "ordinal", *more)

    moved, made, gone = ("move", "quarantine"), ("mkdir",), ("rmdir",)
    changes = (
        held.select("path", F.lit(-1).cast("long").alias("since"), "holds")
        .union(steps((*moved, "trash"), "source", F.lit("nothing"))).union(steps(moved, "target", F.lit("file")))
        .union(steps(made, "target", F.lit("dir"))).union(steps(gone, "source", F.lit("nothing")))
    )
    spans = checkpointed(changes.withColumn("until", F.lead("since").over(W.partitionBy("path").orderBy("since", "holds"))))

    needs = lambda *kinds: F.array(*map(F.lit, kinds)).alias("needs")
    why = lambda text: F.lit(text).alias("why")
    asked = (
        steps((*moved, "trash"), "source", needs("file"), why("nothing to move"))
        .union(steps(moved, "target", needs("nothing"), why("taken")))
        .union(steps(moved, F.explode(paths.ancestors(F.col("target"))), needs("dir"), why("no directory")))
        .union(steps(made, F.explode(paths.ancestors(F.col("target"))), needs("dir"), why("no directory")))
        .union(steps(made, "target", needs("nothing", "dir"), why("taken")))
        .union(steps(gone, "source", needs("dir"), why("no directory")))
    ).where(~paths.is_reserved(F.col("path")))
    during = (F.col("since") < F.col("ordinal")) & (F.col("until").isNull() | (F.col("until") >= F.col("ordinal")))
    found = asked.join(spans.withColumnRenamed("path", "place"), (F.col("path") == F.col("place")) & during, "left")
    failed = found.where(~F.array_contains("needs", F.coalesce("holds", F.lit("nothing")))).select("ordinal", "path", "why")
    inside = spans.where("holds <> 'nothing'").select(paths.parent(F.col("path")).alias("place"), "since", "until")
    full = steps(gone, "source").join(inside, (F.col("path") == F.col("place")) & during, "left_semi").select("ordinal", "path", why("not empty"))
    return failed.union(full).distinct().join(ops.select("ordinal", "op"), "ordinal").select("ordinal", "op", "path", "why")


def replayed(inventory: DataFrame, ops: DataFrame) -> DataFrame:
    """``apply_on_paper``, if every operation can run in its turn; else ValueError with the first that can't."""
    first = broken_steps(inventory, ops).agg(F.min(F.struct("ordinal", "op", "path", "why")).alias("first")).first()["first"]
    if first is not None:
        raise ValueError(f"operation {first.ordinal}, {first.op} {first.path!r}: {first.why}")
    return apply_on_paper(inventory, ops)


def fingerprint(inventory: DataFrame) -> DataFrame:
    """One row: a digest of all paths, sizes and times, whatever the rows' order. Digests of rows are summed, so nothing is gathered."""
    row = F.sha2(F.concat_ws("\0", "path", F.col("size").cast("string"), F.unix_millis("mtime").cast("string")), 256)
    halves = [F.conv(F.substring(row, 1 + 8 * k, 8), 16, 10).cast("decimal(38,0)") for k in range(4)]
    return complete(inventory).agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(",", *(F.sum(h).cast("string") for h in halves)), 256).alias("fingerprint"))


def changed_since(inventory: DataFrame, live: DataFrame) -> DataFrame:
    """path, change (gone, size, time) of files that are not what they were when a plan was made."""
    now = live.select("path", F.col("size").alias("_size"), F.col("mtime").alias("_mtime"), F.lit(True).alias("_there"))
    rows = complete(inventory).where(~F.coalesce(F.col("is_dir"), F.lit(False))).join(now, "path", "left")
    change = F.when(F.col("_there").isNull(), "gone").when(F.col("size") != F.col("_size"), "size").when(F.col("mtime").isNotNull() & F.col("_mtime").isNotNull() & (F.col("mtime") != F.col("_mtime")), "time")
    return rows.select("path", change.alias("change")).where("change is not null")


def same_contents(before: DataFrame, after: DataFrame, content: str = "hash") -> bool:
    """Whether two trees hold the same contents, each as often, wherever they are."""
    a, b = before.select(content), after.select(content)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
