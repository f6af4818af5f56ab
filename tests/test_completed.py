"""Starting layouts, learned policies, preconditions, archives, settings, pictures' data, stops."""

from __future__ import annotations

import json
import random
import struct
import threading
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.actions import executor
from stowage.operators import classify, duplicates, journal, learn, planner, similar
from stowage.plans import layouts
from stowage.plans.policy import load
from stowage.sources import connections, exif
from stowage.sources import inventory as source
from stowage.streaming import watch

T0 = datetime(2024, 3, 5)
INVENTORY = "path string, size long, is_dir boolean, mtime timestamp, mime string, now timestamp, exif map<string,string>"


def tree(spark, rows):
    """Rows (path, mime) or paths."""
    return spark.createDataFrame([(p, 10, False, T0, m, T0 + timedelta(days=9), None) for p, m in ((r, None) if isinstance(r, str) else r for r in rows)], INVENTORY)


def targets(inventory, text):
    return {r.path: r.target for r in classify.place(inventory, load(text)).collect()}


@pytest.mark.parametrize(
    ("name", "wanted"),
    [
        ("downloads", {"a.jpg": "Images/a.jpg", "b.pdf": "Documents/b.pdf", "IMG-WA12.jpg": "Images/IMG-WA12.jpg"}),
        ("photos", {"a.jpg": "2024/03/a.jpg", "v.mp4": "Videos/2024/v.mp4"}),
        ("documents", {"b.pdf": "PDF/2024/b.pdf"}),
        ("media", {"a.jpg": "2024/Camera/Photo/jpg/under-100MB/a.jpg", "IMG-WA12.jpg": "2024/WhatsApp/Photo/jpg/under-100MB/IMG-WA12.jpg"}),
        ("by-date", {"b.pdf": "2024/03/b.pdf"}),
        ("by-source", {"IMG-WA12.jpg": "WhatsApp/IMG-WA12.jpg", "Screenshot 1.png": "Screenshots/Screenshot 1.png", "a.jpg": None}),
        ("by-type", {"b.pdf": "PDF/b.pdf"}),
    ],
)
def test_layouts(spark, name, wanted):
    rows = [("a.jpg", "image/jpeg"), ("b.pdf", "application/pdf"), ("v.mp4", "video/mp4"), ("IMG-WA12.jpg", "image/jpeg"), ("Screenshot 1.png", "image/png")]
    got = targets(tree(spark, rows), layouts.layout(name))
    assert {p: got[p] for p in wanted} == wanted
    assert not load(layouts.layout(name)).warnings or name == "media"


def test_layout_names():
    assert layouts.names() == ["downloads", "photos", "documents", "media", "by-date", "by-source", "by-type"]
    with pytest.raises(KeyError):
        layouts.layout("other")


def test_learned_policy_knows_names_kinds_and_sizes(spark):
    rows = [(f"Work/Acme/2024/f{k}.txt", "text/plain") for k in range(5)] + [(f"Home/Trips/2024/g{k}.txt", "text/plain") for k in range(5)]
    kept = tree(spark, rows)
    text = learn.learn(kept)
    assert 'path = "Work/Acme/{date:%Y}"' in text and 'path = "Home/Trips/{date:%Y}"' in text
    assert planner.wanted(kept, load(text)).where("want is not null").isEmpty()
    assert targets(tree(spark, ["Work/Acme/new.txt"]), text) == {"Work/Acme/new.txt": "Work/Acme/2024/new.txt"}
    pictures = tree(spark, [(f"2024/Photos/p{k}.jpg", "image/jpeg") for k in range(4)])
    text = learn.learn(pictures)
    assert 'mime = "image/*"' in text and planner.wanted(pictures, load(text)).where("want is not null").isEmpty()
    with pytest.raises(ValueError, match="branches"):
        learn.learn(kept, most_branches=1)
    assert not load(learn.learn(tree(spark, ["a.txt"]))).rules


OPS = "ordinal long, op string, source string, target string, because string"


def by_hand(files, folders, ops):
    """(ordinal, path, why), one operation after another, each done whether it can be or not."""
    held = dict.fromkeys(folders, "dir") | dict.fromkeys(files, "file")
    up = lambda p: ["/".join(p.split("/")[:k]) for k in range(1, p.count("/") + 1)]
    held = {a: "dir" for p in [*files, *folders] for a in up(p)} | held
    out = set()
    for k, op, a, b, _ in ops:
        if op in ("move", "quarantine", "trash") and held.get(a) != "file":
            out.add((k, a, "nothing to move"))
        if b:
            out |= {(k, d, "no directory") for d in up(b) if held.get(d) != "dir"}
            if held.get(b) is not None and not (op == "mkdir" and held[b] == "dir"):
                out.add((k, b, "taken"))
        if op == "rmdir":
            out |= {(k, a, "no directory")} if held.get(a) != "dir" else set()
            out |= {(k, a, "not empty")} if any(p.rpartition("/")[0] == a for p in held) else set()
        held.pop(a, None)
        if b:
            held[b] = "dir" if op == "mkdir" else "file"
    return out


def test_preconditions_against_brute_force(spark):
    chance = random.Random(5)
    names = [f"{d}{f}" for d in ("", "a/", "a/b/", "c/") for f in "xyz"]
    for _ in range(4):
        files, folders, ops = chance.sample(names, 5), ["a", "a/b", "c"], []
        for k in range(25):
            op = chance.choice(["move", "move", "mkdir", "rmdir", "trash"])
            place = chance.choice(["a", "a/b", "c", "d", "d/e"])
            a = None if op == "mkdir" else place if op == "rmdir" else chance.choice(names)
            b = place if op == "mkdir" else chance.choice([n for n in [*names, "d/x"] if n != a]) if op == "move" else None
            ops.append((k, op, a, b, ""))
        inventory = spark.createDataFrame([(p, False) for p in files] + [(p, True) for p in folders], "path string, is_dir boolean")
        got = planner.broken_steps(inventory, spark.createDataFrame(ops, OPS))
        assert {(r.ordinal, r.path, r.why) for r in got.collect()} == by_hand(files, folders, ops)


def test_plans_can_be_replayed(spark):
    text = '[folder]\nname = "p"\n[defaults]\ncooldown = "0s"\n[[rule]]\nname = "r"\npath = "{ext}/{stem}"\nmatch = { glob = ["**"] }\n'
    inventory = tree(spark, ["x/a.txt", "x/b.txt", "y/a.txt", "c.md"])
    made = planner.plan(inventory, load(text))
    assert planner.broken_steps(inventory, made.ops).isEmpty()
    assert planner.replayed(inventory, made.ops).where("not coalesce(is_dir, false)").count() == 4
    late = made.ops.withColumn("ordinal", -F.col("ordinal"))
    with pytest.raises(ValueError, match="operation"):
        planner.replayed(inventory, late)
    assert planner.broken_steps(inventory, made.ops.limit(0)).isEmpty()


def test_archives(spark, tmp_path):
    folder = f"file://{tmp_path}/archives"
    ops = spark.createDataFrame([(1, "move", "committed", "a", "b")], "id long, kind string, status string, src string, dst string")
    assert journal.archives(spark, folder) == []
    name, empty = journal.cleared({"ops": ops}, folder)
    assert journal.archives(spark, folder) == [name] and empty["ops"].isEmpty() and empty["ops"].schema == ops.schema
    other, back = journal.restored(empty, folder, name)
    assert [tuple(r) for r in back["ops"].collect()] == [(1, "move", "committed", "a", "b")]
    assert journal.archives(spark, folder) == [other, name]
    journal.forget_archive(spark, folder, name)
    assert journal.archives(spark, folder) == [other]
    for bad in (name, "../x"):
        with pytest.raises(KeyError):
            journal.forget_archive(spark, folder, bad)
    with pytest.raises(ValueError, match="unfinished"):
        journal.cleared({"ops": ops.withColumn("status", F.lit("intended"))}, folder)


def test_documents(spark):
    got = [json.loads(r.json) for r in source.documents(spark.createDataFrame([("a", None, [1, 2])], "path string, rule string, marks array<int>")).collect()]
    assert got == [{"path": "a", "rule": None, "marks": [1, 2]}]


def test_settings():
    s = connections.Settings
    assert connections.problems(s("fs")) == [("needs", "root")] and connections.problems(s("ftp", host=" ")) == [("needs", "host")]
    assert connections.problems(s("smb", root="//", host="h")) == [("needs", "user"), ("needs", "share")]
    assert connections.problems(s("s3", options={"endpoint": "ftp://x"})) == [("needs", "bucket"), ("bad_endpoint", "ftp://x")]
    assert connections.problems(s("smb", root="/docs/x", host="h", username="u", options={"encryption": "maybe", "bucket": "b", "new": "1"})) == [("bad_value", "encryption"), ("unused", "bucket")]
    assert connections.problems(s("webdav", options={"endpoint": "HTTPS://x"})) == []
    assert [connections.in_the_clear(s(x)) is None for x in ("fs", "sftp", "ftps", "s3", "ftp", "smb")] == [True, True, True, True, False, False]
    assert connections.in_the_clear(s("webdav", options={"endpoint": "http://x"})) and not connections.in_the_clear(s("smb", options={"encryption": "required"}))
    assert connections.share_of("\\\\docs\\x") == "docs" and connections.share_of(" / ") is None
    assert connections.remote_key("./a//b/") == "a/b" and connections.remote_key("") == ""
    for bad in ("/a", "a/../../b", "C:\\x"):
        with pytest.raises(ValueError):
            connections.remote_key(bad)
    assert connections.decode_options(connections.encode_options({"b": "ü", "a": "1"})) == {"a": "1", "b": "ü"}
    assert [connections.decode_options(x) for x in (None, "", "[1]", '{"a": 1}', "{")] == [{}] * 5


def jpeg(end):
    """A picture without pixels: make, orientation, a further directory with a date and a focal length."""
    pack = lambda f, *x: struct.pack(("<" if end == b"II" else ">") + f, *x)
    make, date = b"Stow Camera\0", b"2021:07:04 10:11:12\0"
    at = 8 + 2 + 3 * 12 + 4
    deeper = at + len(make)
    first = pack("H", 3) + pack("HHII", 0x010F, 2, len(make), at) + pack("HHIHH", 0x0112, 3, 1, 6, 0) + pack("HHII", 0x8769, 4, 1, deeper) + pack("I", 0)
    values = deeper + 2 + 2 * 12 + 4
    second = pack("H", 2) + pack("HHII", 0x9003, 2, len(date), values) + pack("HHII", 0x920A, 5, 1, values + len(date)) + pack("I", 0)
    body = b"Exif\0\0" + end + pack("H", 42) + pack("I", 8) + first + make + second + date + pack("II", 35, 2)
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff\xe1" + struct.pack(">H", len(body) + 2) + body + b"\xff\xda\0\2"


def test_exif(spark):
    wanted = {"Make": "Stow Camera", "Orientation": "6", "DateTimeOriginal": "2021-07-04 10:11:12", "FocalLength": "17.5"}
    assert exif.read_exif(jpeg(b"II")) == exif.read_exif(jpeg(b"MM")) == wanted
    whole = jpeg(b"MM")
    for k in range(len(whole)):  # whatever is cut off, nothing breaks
        assert set(exif.read_exif(whole[:k])) <= set(wanted)
    assert exif.read_exif(None) == exif.read_exif(b"text") == {}
    content = spark.createDataFrame([("p/a.jpg", bytearray(whole)), ("p/b.jpg", None)], "path string, content binary")
    rows = exif.with_exif(tree(spark, ["p/a.jpg", "p/b.jpg", "p/c.jpg"]), content)
    assert {r.path: r.m for r in rows.select("path", exif.tag("Make").alias("m")).collect()} == {"p/a.jpg": "Stow Camera", "p/b.jpg": None, "p/c.jpg": None}
    text = layouts.layout("by-date")
    assert targets(rows, text)["p/a.jpg"] == "2021/07/a.jpg" and targets(rows, text)["p/b.jpg"] == "2024/03/b.jpg"


def test_picture_prints(spark):
    slope = np.tile(np.arange(90, 0, -1, dtype=np.uint8), (40, 1))
    noise = np.random.default_rng(3).integers(0, 256, (64, 72), dtype=np.uint8)
    rows = [("slope", 90, 40, slope), ("mirror", 90, 40, slope[:, ::-1]), ("noise", 72, 64, noise), ("larger", 144, 128, np.kron(noise, np.ones((2, 2), np.uint8)))]
    frame = spark.createDataFrame([(p, w, h, bytearray(x.tobytes())) for p, w, h, x in rows] + [("cut", 3, 3, bytearray(b"12")), ("none", 3, 3, None)], "path string, width int, height int, grey binary")
    got = {r.path: r for r in similar.picture_prints(frame).collect()}
    assert got["slope"].signature == -1 and got["slope"].detail == [-1] * 4 and got["slope"].weight == 3600
    assert got["mirror"].signature == 0 and got["cut"].signature is None and got["none"].weight is None
    assert bin((got["noise"].signature ^ got["larger"].signature) & (1 << 64) - 1).count("1") <= 2
    # Pixels that already are 9 x 8 stay as they are.
    small = noise[:8, :9]
    assert similar.gradient(small, 8)[0] & (1 << 64) - 1 == sum(1 << (8 * y + x) for y in range(8) for x in range(8) if small[y, x] > small[y, x + 1])


def test_scan_cost(spark):
    piece = duplicates.PIECE
    sizes = {"a/1": (5 * piece, "s"), "a/2": (5 * piece, "s"), "b/3": (5 * piece, "t"), "b/4": (7, "u"), "c/5": (9, "v"), "c/6": (9, "w"), "d/7": (0, None)}
    rows = spark.createDataFrame([(p, n, s) for p, (n, s) in sizes.items()], "path string, size long, sample string")
    got = {r.stage: (r.files, r.requests, r.bytes) for r in duplicates.scan_cost(rows).collect()}
    assert got == {"list": (6, 3, 0), "sample": (5, 14, 12 * piece + 18), "whole": (2, 2, 10 * piece), "all": (6, 6, 15 * piece + 25)}
    assert {tuple(r)[1:] for r in duplicates.scan_cost(rows.limit(0)).collect()} == {(0, 0, 0)}


def test_stop_and_queue(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * (3 << 20))
    stop = executor.Stop()
    executor.copy_verified(str(tmp_path / "a"), str(tmp_path / "b"), stop=stop)
    stop.wish()
    with pytest.raises(executor.Stopped):
        executor.copy_verified(str(tmp_path / "a"), str(tmp_path / "c"), stop=stop)
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a", "b"]
    queue, seen, go = executor.Queue(), [], threading.Event()
    first = threading.Thread(target=queue.run, args=(lambda s: (go.wait(10), seen.append(1)),))
    first.start()
    with pytest.raises(executor.Stopped):  # stopped while it waits
        queue.run(lambda s: seen.append("never"), stop)
    go.set()
    assert queue.run(lambda s: seen.append(2) or "done") == "done" and seen == [1, 2]
    first.join()


def test_names_handed_on_in_rings_and_chains(spark):
    """Rings, chains, and a file that has to go below its own name, apart from each other and from what waits for nothing."""
    chain = [("move", f"c/{k}", f"c/{k + 1}") for k in range(12)]
    rings = [("move", f"r{k}/{a}", f"r{k}/{b}") for k in range(3) for a, b in ("xy", "yz", "zx")]
    below = [("mkdir", None, "f"), ("move", "f", "f/g"), ("mkdir", None, "f/d"), ("move", "old/k", "f/d/k"), ("rmdir", "old", None)]
    plain = [("mkdir", None, "n"), ("mkdir", None, "n/m"), ("move", "p", "n/m/p")]
    ops = [(*o, "") for o in chain + rings + below + plain]
    random.Random(2).shuffle(ops)
    files = sorted({o[1] for o in ops if o[0] == "move"})
    inventory = spark.createDataFrame([(f, False) for f in files], "path string, is_dir boolean")
    made = planner.in_order(spark.createDataFrame(ops, planner.OPS))
    rows = made.orderBy("ordinal").collect()
    assert [r.ordinal for r in rows] == list(range(len(ops) + 4))  # one more for each ring
    assert planner.broken_steps(inventory, made).collect() == []
    after = {r.path for r in planner.replayed(inventory, made).where("not coalesce(is_dir, false)").collect()}
    assert after == {o[2] for o in ops if o[0] == "move"}


def one_by_one(movers, held, folders, how, most):
    """The rule as it is said: each mover tries its want, then all numbers."""
    held, claimed, out = set(held), set(), {}
    for path, want in sorted(movers):
        final, kind = want, "move"
        if want in folders:
            out[path] = ("blocked", None)
            continue
        if want in held and want not in claimed and how in ("skip", "quarantine"):
            out[path] = ("skipped", None) if how == "skip" else ("quarantine", f".stowage-quarantine/{path}")
            continue
        if want in held and want not in claimed and how == "replace":
            kind = "replace"
            held.discard(want)
        elif want in claimed or want in held:
            stem, dot, ext = want.rpartition(".")
            names = [f"{stem}-{n}.{ext}" if dot else f"{want}-{n}" for n in range(1, most + 1)]
            final = next((c for c in names if c == path or c not in claimed | held | folders), None)
            if final is None:
                out[path] = ("blocked", None)
                continue
        claimed.add(final)
        out[path] = ("already_there" if final == path else kind, final)
    return out


@pytest.mark.parametrize("how", ["rename", "skip", "quarantine", "replace"])
def test_names_against_one_by_one(spark, monkeypatch, how):
    monkeypatch.setattr(planner, "NUMBERS", 3)
    chance = random.Random(how)
    policy = load(f'[folder]\nname = "p"\n[defaults]\non_conflict = "{how}"\n')
    for _ in range(3):
        files = sorted({f"{d}{f}" for d in ("d/", "e/", "f/", "g/") for f in ("x.txt", "x-1.txt", "x-2.txt", "y", "y-1", "q.md") if chance.random() < 0.8})
        wants = {p: chance.choice([None, "d/x.txt", "d/x.txt", "d/y", "d/x-1.txt", "d/q.md", "e", p]) for p in files}
        decided = spark.createDataFrame(list(wants.items()), "path string, want string")
        inventory = spark.createDataFrame([(p, False) for p in files] + [("h", True)], "path string, is_dir boolean")
        got = {r.path: (r.kind, r.final) for r in planner.assign(decided, inventory, policy).collect()}
        folders = {"h"} | {p.split("/")[0] for p in files}
        assert got == one_by_one([(p, w) for p, w in wants.items() if w], {p for p, w in wants.items() if not w}, folders, how, 3)


def test_lost_events_are_looked_at_again(spark):
    roots = spark.createDataFrame([("a",), ("a/b",), ("ab",)], "root string")
    errors = spark.createDataFrame([("a/b/c", T0), ("ab", T0), ("x/y", T0), (None, T0 + timedelta(1))], "path string, ts timestamp")
    events = spark.createDataFrame([("a", "a/f", "modify", T0)], "root string, path string, kind string, ts timestamp")
    got = sorted((r.root, r.path, r.kind, r.ts) for r in watch.with_rescans(events, errors, roots).collect())
    late = T0 + timedelta(1)
    assert got == sorted([("a", "a/f", "modify", T0), *((r, r, "rescan", T0) for r in ("a", "a/b", "ab")), *((r, r, "rescan", late) for r in ("a", "a/b", "ab"))])


@pytest.mark.parametrize("links", [True, False])
def test_copies_never_replace(tmp_path, monkeypatch, links):
    def refused(*_):
        raise PermissionError

    if not links:
        monkeypatch.setattr(executor.os, "link", refused)
    (tmp_path / "a").write_text("new")
    executor.copy_verified(str(tmp_path / "a"), str(tmp_path / "c"), "readback")
    (tmp_path / "b").write_text("old")
    with pytest.raises(executor.Stale):
        executor.copy_verified(str(tmp_path / "a"), str(tmp_path / "b"))
    assert {p.name: p.read_text() for p in tmp_path.iterdir()} == {"a": "new", "b": "old", "c": "new"}
