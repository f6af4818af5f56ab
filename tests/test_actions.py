"""The executor: the tree is what the plan says on paper, and undoing brings it back."""

from __future__ import annotations

import os
import random
from collections import namedtuple

import pytest

from stowage.actions.executor import Executor, Governor, Journal, Stale, copy_verified
from stowage.operators import journal, planner
from stowage.plans.policy import load
from stowage.sources import inventory as source

Op = namedtuple("Op", "op source target because", defaults=["x"])


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): open(os.path.join(d, f)).read() for d, _, names in os.walk(root) for f in names}


def test_plan_on_disk_equals_paper_and_undo(spark, tmp_path):
    rng = random.Random(4)
    for k in range(12):
        p = tmp_path / "t" / rng.choice("ab") / f"{rng.choice('xyz')}{k % 5}.{rng.choice(['txt', 'md'])}"
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(str(k))
    root = str(tmp_path / "t")
    source.register(spark)
    inventory = spark.read.format("inventory").load(root)
    policy = load('[folder]\nname = "p"\n[defaults]\ncooldown = "0s"\n[[rule]]\nname = "r"\npath = "by/{ext}"\nmatch = { glob = ["**"] }\nrename = "{stem|trunc:1}.{ext}"\n')
    before = files(root)
    made = planner.plan(inventory, policy)
    ops = made.ops.orderBy("ordinal").collect()
    paper = {r.path for r in planner.apply_on_paper(inventory, made.ops).where("not is_dir").collect()}
    notes = Journal()
    Executor(root, notes).apply(ops)
    after = files(root)
    assert set(after) == paper and sorted(after.values()) == sorted(before.values())
    assert journal.incomplete(notes.frame(spark)).isEmpty()
    Executor(root, notes).undo(1)
    assert files(root) == before
    with pytest.raises(ValueError):
        Executor(root, notes).undo(1)


def test_refusals(tmp_path):
    (tmp_path / "a").write_text("1")
    (tmp_path / "b").write_text("2")
    run = Executor(str(tmp_path), Journal())
    for op in (Op("move", "a", "b"), Op("move", "nope", "c")):
        with pytest.raises(Stale):
            run.apply([op])
    with pytest.raises(ValueError):
        run.apply([Op("move", "a", "../../out")])
    (tmp_path / "link").symlink_to("/tmp")
    with pytest.raises(Stale):
        run.apply([Op("move", "a", "link/x")])
    with pytest.raises(Stale):
        run.apply([Op("move", "a", "c")], sizes={"a": 99})
    assert run.journal.rows == []


@pytest.mark.parametrize("happened", [True, False])
def test_recovery_after_a_crash(tmp_path, happened):
    (tmp_path / "a").write_text("1")
    notes = Journal()

    def crash(_):
        if happened:
            os.rename(tmp_path / "a", tmp_path / "b")
        raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Executor(str(tmp_path), notes, crash).apply([Op("move", "a", "b")])
    assert Executor(str(tmp_path), notes).recover() == {1: "committed" if happened else "abandoned"}
    assert Executor(str(tmp_path), notes).recover() == {}


def test_verified_copy_and_governor(tmp_path):
    (tmp_path / "a").write_bytes(b"x" * 3_000_000)
    assert copy_verified(str(tmp_path / "a"), str(tmp_path / "b"), "readback") and (tmp_path / "b").read_bytes() == (tmp_path / "a").read_bytes()
    with pytest.raises(Stale):
        copy_verified(str(tmp_path / "a"), str(tmp_path / "b"))
    assert sorted(os.listdir(tmp_path)) == ["a", "b"]
    g = Governor()
    assert [g.observe(t) for t in (10, 20, 20.1)] == [3, 4, 3] and g.observe(5, overloaded=True) == 1


def test_survey_reads_no_more_than_asked(spark, tmp_path):
    (tmp_path / "node_modules" / "x").mkdir(parents=True)
    (tmp_path / "node_modules" / "x" / "y.js").write_text("1")
    (tmp_path / "a.txt").write_text("hello")
    head = '[folder]\nname = "p"\nopaque = ["**/node_modules"]\n[[rule]]\nname = "r"\npath = "{}"\nmatch = {{ glob = ["**"] }}\n'
    rows = source.survey(spark, str(tmp_path), load(head.format("{ext}")))
    assert {r.path for r in rows.collect()} == {"a.txt", "node_modules"} and "hash" not in rows.columns
    rows = source.survey(spark, str(tmp_path), load(head.format("{hash:8}")))
    import hashlib

    assert {r.path: (r.mime, r.hash) for r in rows.where("not is_dir").collect()} == {"a.txt": ("text/plain", hashlib.sha256(b"hello").hexdigest())}


def test_changes_and_contents(spark):
    a = spark.createDataFrame([("x", 1, None, "h"), ("y", 1, None, "h")], "path string, size long, mtime timestamp, hash string")
    b = spark.createDataFrame([("z", 1, None, "h"), ("y", 2, None, "h")], "path string, size long, mtime timestamp, hash string")
    assert {r.path: r.change for r in planner.changed_since(a, b).collect()} == {"x": "gone", "y": "size"}
    assert planner.same_contents(a, b) and not planner.same_contents(a, b.limit(1))
