"""Operators on small tables, and the invariants that hold for any policy and tree."""

from __future__ import annotations

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stowage.operators import classify, duplicates, graph, journal, learn, planner, similar, sync, transfer, views
from stowage.plans.policy import load
from stowage.sources import inventory as source
from stowage.streaming import watch

T0 = datetime(2024, 1, 1)
INVENTORY = "path string, size long, is_dir boolean, mtime timestamp, mime string, now timestamp"


def tree(spark, files, folders=()):
    rows = [(p, 10 + len(p), False, T0, None, T0 + timedelta(days=9)) for p in files] + [(p, 0, True, None, None, T0 + timedelta(days=9)) for p in folders]
    return spark.createDataFrame(rows, INVENTORY)


def policy(path, conflict="rename", match='glob = ["**"]', rename=None, more=""):
    return load(f'[folder]\nname = "p"\n{more}\n[defaults]\non_conflict = "{conflict}"\ncooldown = "0s"\n[[rule]]\nname = "r"\npath = "{path}"\nmatch = {{ {match} }}\n' + (f'rename = "{rename}"\n' if rename else ""))


def moves(made):
    return {(r.op, r.source, r.target) for r in made.ops.collect() if r.op in ("move", "quarantine")}


# Classification


def test_verdicts_in_order(spark):
    p = load('[folder]\nname = "p"\nignore = ["*.tmp"]\nopaque = ["repo"]\n[[rule]]\nname = "a"\npath = "x/{exif.Model}"\nmatch = { ext = "jpg" }\n[[rule]]\nname = "b"\npath = "y"\nmatch = { glob = ["**"] }\n')
    got = {r.path: (r.outcome, r.rule, r.target, r.detail) for r in classify.place(tree(spark, ["a.tmp", "repo/b.txt", "c.jpg", "d.txt"]), p).collect()}
    assert got["a.tmp"] == ("ignored", None, None, "*.tmp") and got["repo/b.txt"][0] == "opaque"
    assert got["c.jpg"] == ("unresolvable", "a", None, "exif.Model")  # it does not fall through
    assert got["d.txt"] == ("placed", "b", "y/d.txt", None)


def test_explain_agrees_with_place(spark):
    p = load('[folder]\nname = "p"\n[[rule]]\nname = "a"\npath = "a"\nmatch = { ext = "txt", size = ">100" }\n[[rule]]\nname = "b"\npath = "b"\nmatch = { ext = "txt" }\n')
    rows = classify.explain(tree(spark, ["x.txt", "y.jpg"]), p).collect()
    assert [(r.name, r.result, r.failed_on) for r in rows[0].rules] == [("a", "failed", "size"), ("b", "matched", None)]
    assert all(r.result == "failed" for r in rows[1].rules) and rows[1].outcome == "unmatched"


def test_maps_and_buckets(spark):
    table = {"a*": "wide", "ab*": "narrow", "abc": "exact", "_": "rest"}
    got = spark.createDataFrame([("abc",), ("abd",), ("ax",), ("q",), (None,)], "x string").select(classify.mapped(F.col("x"), table)).collect()
    assert [r[0] for r in got] == ["exact", "narrow", "wide", "rest", None]


# Plans


def test_numbering_and_conflicts(spark):
    files = ["a/x.txt", "b/x.txt", "all/x.txt"]
    assert moves(planner.plan(tree(spark, files), policy("all"))) == {("move", "a/x.txt", "all/x-1.txt"), ("move", "b/x.txt", "all/x-2.txt")}
    assert moves(planner.plan(tree(spark, files[::2]), policy("all", "skip"))) == set()
    assert moves(planner.plan(tree(spark, files[::2]), policy("all", "quarantine"))) == {("quarantine", "a/x.txt", ".stowage-quarantine/a/x.txt")}
    assert moves(planner.plan(tree(spark, files[::2]), policy("all", "replace"))) == {("quarantine", "all/x.txt", ".stowage-quarantine/all/x.txt"), ("move", "a/x.txt", "all/x.txt")}


def test_directories(spark):
    made = planner.plan(tree(spark, ["a/b/x.txt", "c/y.txt", "c/z.md"]), policy("new/{ext}", match='ext = "txt"'))
    ops = [(r.op, r.source or r.target) for r in made.ops.orderBy("ordinal").collect()]
    assert ops[:2] == [("mkdir", "new"), ("mkdir", "new/txt")] and ops[-2:] == [("rmdir", "a/b"), ("rmdir", "a")]
    assert made.settles and ("rmdir", "c") not in ops


def test_swaps_and_rings():
    ops = [(0, "move", "a", "b", ""), (1, "move", "b", "c", ""), (2, "move", "c", "a", "")]
    order = planner.ordered(ops, [(1, 0), (2, 1), (0, 2)])
    there = {"a": 1, "b": 2, "c": 3}
    for _, _, source_, target, _ in order:
        assert target not in there
        there[target] = there.pop(source_)
    assert there == {"b": 1, "c": 2, "a": 3}


def random_tree(rng):
    names = ["a", "b", "c", "x.txt", "y.txt", "x-1.txt", "z"]
    files = set()
    for _ in range(rng.randint(1, 12)):
        p = "/".join(rng.choice(names) for _ in range(rng.randint(1, 3)))
        if not any(f.startswith(p + "/") or p.startswith(f + "/") for f in files):
            files.add(p)
    return sorted(files)


@pytest.mark.parametrize("seed", range(6))
def test_plan_invariants(spark, seed):
    """Nothing is lost, every name is free when it is taken, nothing leaves the root, each file is accounted for, and the paper tree is what executing gives."""
    rng = random.Random(seed)
    files = random_tree(rng)
    p = policy(rng.choice(["{parent}", "all", "{ext}/../{stem}", "{stem}/{ext}", "a/{ext}"]), rng.choice(["rename", "skip", "quarantine", "replace"]), rename=rng.choice([None, "x.txt", "{name}"]))
    before = tree(spark, files)
    made = planner.plan(before, p)
    there = {f: f for f in files}
    dirs = {"/".join(f.split("/")[:k]) for f in files for k in range(1, len(f.split("/")))}
    for r in made.ops.orderBy("ordinal").collect():
        if r.op == "mkdir":
            assert r.target not in there and r.target not in dirs
            dirs.add(r.target)
        elif r.op == "rmdir":
            assert not any(f.startswith(r.source + "/") for f in there)
            dirs.discard(r.source)
        else:
            assert r.target not in there and not r.target.startswith("/") and ".." not in r.target.split("/")
            there[r.target] = there.pop(r.source)
    assert sorted(there.values()) == files
    paper = planner.apply_on_paper(before, made.ops).where("not is_dir").select("path").collect()
    assert sorted(r.path for r in paper) == sorted(there)
    stays = {r.path for r in made.untouched.collect()}
    assert stays | {r.source for r in made.ops.collect() if r.op in ("move", "quarantine")} >= set(files)


def test_fingerprint_ignores_order(spark):
    a, b = tree(spark, ["a", "b", "c"]), tree(spark, ["c", "a", "b"])
    assert planner.fingerprint(a).first() == planner.fingerprint(b.repartition(3)).first() != planner.fingerprint(tree(spark, ["a", "b"])).first()


# Duplicates

COPIES = "path string, size long, mtime timestamp, sample string, digest string, pinned boolean, settled boolean"


@pytest.mark.parametrize(
    ("marks", "expected", "why"),
    [
        ([(False, False, 2), (True, False, 3)], 1, "pinned"), ([(False, False, 1), (False, True, 2)], 1, "settled"), ([(False, True, 2), (False, True, 1)], 1, "oldest"),
        ([(False, False, 1), (False, False, 1)], 0, "order"), ([(False, False, None), (False, False, 5)], 1, "oldest"), ([(True, False, 1), (True, False, 2)], None, "two_pins"),
    ],
)
def test_keep_choice(spark, marks, expected, why):
    rows = [(f"p{k}", 5, T0 + timedelta(days=m) if m else None, "s", "d", pin, settled) for k, (pin, settled, m) in enumerate(marks)]
    got = duplicates.groups(spark.createDataFrame(rows, COPIES)).orderBy("path").collect()
    assert [k for k, r in enumerate(got) if r.kept] == ([] if expected is None else [expected]) and {r.why for r in got} == {why}


def test_tiers_confirm_and_decide(spark):
    rows = [("a", 5, T0, "s", "d1", False, False), ("b", 5, T0, "s", "d1", False, False), ("c", 5, T0, "s", "d2", False, False), ("e", 0, T0, "s", "d1", False, False), (".stowage/f", 5, T0, "s", "d1", False, False)]
    files = spark.createDataFrame(rows, COPIES)
    sampled = duplicates.groups(files, sampled=True)
    assert {r.path for r in sampled.collect()} == {"a", "b", "c"} and not sampled.first().sure
    assert {r.path for r in duplicates.confirm(sampled.drop("digest"), files.select("path", "digest")).collect()} == {"a", "b"}
    exact = duplicates.groups(files)
    assert duplicates.totals(exact).first().asDict() == {"groups": 1, "extra_files": 1, "reclaimable": 5, "unsure": 0}
    tick = lambda *p: spark.createDataFrame([(x,) for x in p], "path string")
    dealt, errors = duplicates.decide(exact, tick("a", "b"))
    assert dealt.isEmpty() and errors.first().error == "would_empty"
    dealt, errors = duplicates.decide(exact, tick("b", "b"))
    assert [r.path for r in dealt.collect()] == ["b"] and errors.isEmpty()


def test_folders_outermost_only(spark):
    paths_ = [("one/d/x", "1"), ("one/d/e/y", "2"), ("two/d/x", "1"), ("two/d/e/y", "2"), ("three/d/x", "1"), ("three/d/z", "9")]
    files = spark.createDataFrame([(p, 1, d, d != "9") for p, d in paths_], "path string, size long, digest string, twinned boolean")
    got = {(r.keep, r.extra) for r in duplicates.folder_groups(duplicates.folder_prints(files)).collect()}
    assert got == {("one", "two")}


def test_sample_digest(spark):
    size = 300_000
    base = bytes(k % 251 for k in range(size))
    middle, tail = bytearray(base), bytearray(base)
    middle[80_000] ^= 1  # between the pieces
    tail[-1] ^= 1
    rows = spark.createDataFrame([(bytes(x), size) for x in (base, middle, tail)], "c binary, n long").select(duplicates.sample_digest(F.col("c"), F.col("n"))).collect()
    assert rows[0] == rows[1] != rows[2]


def test_near_pairs_equal_a_full_comparison(spark):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(12)]
    signs = []
    for b in base:
        for _ in range(4):
            x = b
            for _ in range(rng.randint(0, 16)):
                x ^= 1 << rng.randrange(64)
            signs.append(x - (1 << 64) if x >= 1 << 63 else x)
    marks = spark.createDataFrame([("s", f"p{k:02}", x, 1, 1, None) for k, x in enumerate(signs)], "sort string, path string, signature long, weight int, size int, mtime timestamp")
    got = {(r.a, r.b) for r in similar.near_pairs(marks).collect()}
    apart = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    assert got == {(a, b) for a in set(signs) for b in set(signs) if a < b and apart(a, b) <= 12}
    found = similar.clusters(marks).collect()
    leaders, followers = {r.leader for r in found}, {r.path for r in found}
    assert not leaders & followers and all(r.alike >= 70 for r in found)


def test_components(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(50)] + [(90, 80)], "a long, b long")
    assert {r.node: r.root for r in graph.components(edges).collect()} == {**dict.fromkeys(range(51), 0), 90: 80, 80: 80}


# Sync

LISTING = "member string, path string, size long, mtime timestamp, digest string"


def world(spark, now, then):
    """now: {member: {path: content}}, then: {path: content}, the same for all members."""
    members = spark.createDataFrame([(m,) for m in now], "member string")
    listings = spark.createDataFrame([(m, p, len(c), None, c) for m, files in now.items() for p, c in files.items()], LISTING)
    baseline = spark.createDataFrame([(m, p, True, len(c), None, c) for m in now for p, c in then.items()], "member string, path string, present boolean, size long, mtime timestamp, digest string")
    return members, listings, baseline


def actions(decided):
    return {(r.path, r.member): (r.action, r.origin) for r in decided.collect()}


def test_sync_additions_edits_and_deletions(spark):
    now = {"a": {"same": "1", "edited": "22", "new": "n"}, "b": {"same": "1", "edited": "2", "gone": "g"}, "c": {"same": "1", "edited": "2", "gone": "g"}}
    then = {"same": "1", "edited": "2", "gone": "g"}
    got = actions(sync.decide(*world(spark, now, then), sync.Mode("all", None, exact=True)))
    assert got == {("edited", "b"): ("copy", "a"), ("edited", "c"): ("copy", "a"), ("new", "b"): ("copy", "a"), ("new", "c"): ("copy", "a"), ("gone", "b"): ("remove", None), ("gone", "c"): ("remove", None)}
    assert actions(sync.decide(*world(spark, now, then), sync.Mode("all")))[("gone", "a")] == ("copy", "b")
    assert actions(sync.decide(*world(spark, now, then), sync.Mode("push", "a", exact=True)))[("gone", "b")] == ("remove", None)


def test_sync_conflicts_and_questions(spark):
    now, then = {"a": {"x": "aa"}, "b": {"x": "bbb"}, "c": {"x": "0"}}, {"x": "0"}
    got = actions(sync.decide(*world(spark, now, then), sync.Mode("all")))
    assert got == {("x", "b"): ("park", "a"), ("x", "c"): ("copy", "a")}
    members, listings, baseline = world(spark, {"a": {"x": "0"}, "b": {"x": "0"}}, {"x": "0"})
    unread = listings.withColumn("digest", F.lit(None).cast("string"))
    assert {a for a, _ in actions(sync.decide(members, unread, baseline, sync.Mode())).values()} == {"wait"}


@pytest.mark.parametrize("seed", range(4))
def test_sync_all_converges(spark, seed):
    """After a run all members are alike, and a second run has nothing to do."""
    rng = random.Random(seed)
    then = {p: rng.choice("xyz") * rng.randint(1, 3) for p in "abcdef"}
    now = {m: {p: (c if rng.random() < 0.7 else c + m) for p, c in then.items() if rng.random() < 0.8} | ({f"n{m}": "new"} if rng.random() < 0.5 else {}) for m in "123"}
    members, listings, baseline = world(spark, now, then)
    decided = sync.decide(members, listings, baseline, sync.Mode("all", None, exact=True))
    after = sync.apply_on_paper(listings, decided)
    held = {}
    for r in after.collect():
        if not r.path.startswith("."):
            held.setdefault(r.path, {})[r.member] = r.digest
    assert all(len(v) == 3 and len(set(v.values())) == 1 for v in held.values())
    again = sync.decide(members, after, sync.baseline_after(listings, decided), sync.Mode("all", None, exact=True))
    assert again.isEmpty()


def test_moves_and_clashes(spark):
    members, listings, baseline = world(spark, {"a": {"new/x": "123", "k": "1"}, "b": {"x": "123", "k": "1"}}, {"x": "123", "k": "1"})
    found = sync.moves(listings, baseline)
    assert [(r.member, r.source, r.target) for r in found.collect()] == [("a", "x", "new/x")]
    assert sync.cleanly_moved(found, members, listings).count() == 1
    clash = sync.case_clashes(spark.createDataFrame([("a", "X", 1, None, None), ("a", "x", 1, None, None)], LISTING))
    assert [(r.low, r.high) for r in clash.collect()] == [("X", "x")]


# Journal, transfers, learning, views


def test_journal(spark, tmp_path):
    schema = "id long, kind string, status string, plan long, link long, src string, dst string, src_root string, dst_root string, size long, hash string, started_at timestamp, finished_at timestamp"
    row = lambda i, kind, status, src, dst: (i, kind, status, 1, None, src, dst, "/s", "/d", 5, "h", T0, T0)
    ops = spark.createDataFrame([row(1, "move", "committed", "a", "b"), row(2, "move", "committed", "b", "c"), row(3, "move", "intended", "x", "y"), row(4, "copy", "committed", "c", "d")], schema)
    assert [r.id for r in journal.history(ops, "b").collect()] == [2, 1]
    assert [r.id for r in journal.history(ops, "/d/d").collect()] == [4]
    assert [(r.kind, r.src, r.dst) for r in journal.invert(ops).orderBy("seq").collect()] == [("delete", "d", None), ("move", "c", "b"), ("move", "b", "a")]
    there = spark.createDataFrame([("y",)], "path string")
    assert journal.recovered(ops, there).first().verdict == "committed"
    assert journal.recovered(ops, spark.createDataFrame([("x",)], "path string")).first().verdict == "abandoned"
    with pytest.raises(ValueError):
        journal.reset(ops)
    journal.export({"ops": ops}, f"{tmp_path}/j")
    back = journal.import_(spark, f"{tmp_path}/j", {"ops": schema}, {"ops": ops.limit(0)})
    assert sorted(map(str, back["ops"].collect())) == sorted(map(str, ops.collect()))
    with pytest.raises(ValueError):
        journal.import_(spark, f"{tmp_path}/j", {"ops": schema}, {"ops": ops})


def test_transfer_names(spark):
    target = spark.createDataFrame([("d/f.txt",), ("d/f-2.txt",), ("d/f-4.txt",), ("d/f-03.txt",), ("e-2",)], "path string")
    rows = spark.createDataFrame([("d/f.txt",), ("e",), ("g.txt",)], "path string")
    assert {r.path: r.free for r in transfer.disambiguated(rows, target).collect()} == {"d/f.txt": "d/f-3.txt", "e": "e-3", "g.txt": "g-2.txt"}


def test_learned_policy_loads_and_keeps_the_tree(spark):
    rows = [(f"2024/0{m}/f{k}.txt", 1, False, datetime(2024, m, 3), "text/plain", datetime(2025, 1, 1)) for m in (1, 2, 3) for k in range(4)]
    inventory = spark.createDataFrame(rows, INVENTORY)
    text = learn.learn(inventory)
    assert "{date:%Y}/{date:%m}" in text
    assert planner.wanted(inventory, load(text)).where("want is not null").isEmpty()


def test_views(spark):
    rows = spark.createDataFrame([("g", k, n) for k, n in enumerate([5, 5, 12, 3, 4, 4])], "g string, k int, n long")
    assert [r.batch for r in views.batches(rows, 10, "g", "k", "n").orderBy("k").collect()] == [0, 0, 1, 2, 2, 3]
    order = views.table_order("x", False, natural=True)
    got = spark.createDataFrame([("f10",), ("f9",), (None,), ("",), ("F2",)], "x string").orderBy(*order).collect()
    assert [r.x for r in got][:3] == ["F2", "f9", "f10"]


# Streams and sources


def test_stream_settles_like_batch(spark, tmp_path):
    rng = random.Random(3)
    rows = [(f"r{rng.randrange(3)}", T0 + timedelta(seconds=rng.randrange(20_000))) for _ in range(200)]
    spark.createDataFrame(rows, "root string, ts timestamp").coalesce(1).write.parquet(f"{tmp_path}/in")
    batch = {(r.root, r.first, r.n) for r in watch.settled(spark.read.parquet(f"{tmp_path}/in"), 300).collect()}
    stream = spark.readStream.schema("root string, ts timestamp").parquet(f"{tmp_path}/in")
    got = {(r.root, r.first, r.n) for r in watch.run_available(watch.settled_stream(stream, 300), f"{tmp_path}/out", f"{tmp_path}/state").collect()}
    assert got <= batch and len(batch - got) <= 3


def test_waits():
    assert [watch.next_wait(30, False, 0), watch.next_wait(3000, False, 0), watch.next_wait(3000, True, 0), watch.next_wait(30, False, 1), watch.next_wait(30, False, 9)] == [60, 3600, 30, 60, 600]


def test_inventory_source(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "b" / "x.txt").write_text("hello")
    (tmp_path / "skip").mkdir()
    (tmp_path / "skip" / "y").write_text("no")
    (tmp_path / "link").symlink_to(tmp_path / "a")
    source.register(spark)
    rows = {r.path: r for r in spark.read.format("inventory").option("prune", "skip").load(str(tmp_path)).collect()}
    assert set(rows) == {"a", "a/b", "a/b/x.txt", "skip", "link"} and rows["link"].is_symlink and rows["a/b/x.txt"].size == 5
    files = {r.path: r.size for r in source.files(spark, str(tmp_path / "a")).collect()}
    assert files == {"b/x.txt": 5}


def test_sniff(spark):
    rows = [(b"\xff\xd8\xff\xe0", "a.txt"), (b"hello world", "a.md"), (b"hello world", "a"), (bytes(range(32)), "b"), (b"", "c")]
    got = spark.createDataFrame(rows, "h binary, p string").select(source.sniff(F.col("h"), F.col("p"))).collect()
    assert [r[0] for r in got] == ["image/jpeg", "text/markdown", "text/plain", "application/octet-stream", "application/octet-stream"]


def test_entry(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0
