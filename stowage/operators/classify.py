"""Classification: where each file belongs, by the first rule that matches it.

An inventory has the columns path, size, is_dir, is_symlink, mtime, mime, exif,
hash, now; those that it lacks count as null. The whole policy becomes one
projection, so a table of any size is classified in one pass without a shuffle,
and columns that the policy never asks for are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stowage.functions import grammar, matching, paths
from stowage.functions.templates import Value
from stowage.plans.policy import Policy, Rule, Var

SCHEMA = {"size": "long", "is_dir": "boolean", "is_symlink": "boolean", "mtime": "timestamp", "mime": "string", "exif": "map<string,string>", "hash": "string", "source": "string", "now": "timestamp"}


def complete(inventory: DataFrame) -> DataFrame:
    """The inventory with nulls for the columns that it lacks."""
    return inventory.withColumns({c: F.lit(None).cast(t) for c, t in SCHEMA.items() if c not in inventory.columns})


def attribute(name: str, zone: str | None = None) -> Value:
    """An attribute of a file by its name in policies."""
    of_name = paths.name(F.col("path"))
    if name.startswith("exif."):
        text = F.element_at(F.col("exif"), name[5:])
        if "DateTime" in name:
            return Value(F.coalesce(*(F.try_to_timestamp(text, F.lit(p)).cast("timestamp_ntz") for p in ("yyyy:MM:dd HH:mm:ss", "yyyy-MM-dd HH:mm:ss"))), "civil")
        return Value(text)
    own = {"name": of_name, "stem": paths.stem(of_name), "ext": paths.ext(of_name), "parent": paths.parent(F.col("path"))}
    if name in own:
        return Value(own[name])
    return Value(F.col(name), "size" if name == "size" else "instant" if name in ("mtime", "now") else "text", zone)


class Compiled:
    """A rule's columns: whether it matches, the first test that fails, and where files go."""

    def __init__(self, rule: Rule):
        self.rule = rule
        m, path = rule.match, F.col("path")
        of_name = paths.name(path)
        tests: list[tuple[str, Column]] = []
        if m.ext:
            tests.append(("ext", matching.extensions(path, list(m.ext))))
        if m.mime:
            tests.append(("mime", matching.mime(F.col("mime"), list(m.mime))))
        if m.glob:
            any_of = F.lit(False)
            for p in m.glob:
                any_of = any_of | matching.glob(path, p)
            tests.append(("glob", any_of))
        if m.regex:
            tests.append(("regex", of_name.rlike(m.regex)))
        if m.size:
            tests.append(("size", m.size.holds(F.col("size"))))
        if m.age:
            tests.append(("age", m.age.holds(grammar.age(F.col("now"), F.col("mtime")))))
        self.matches = F.lit(True)
        for _, test in tests:
            self.matches = self.matches & test
        self.failed = F.coalesce(*(F.when(~t, F.lit(n)) for n, t in tests)) if tests else F.lit(None).cast("string")
        self._captures = {n: F.nullif(F.regexp_extract(of_name, m.regex, k), F.lit("")) for n, k in m.captures}
        self.missing = F.coalesce(rule.path.missing(self._value), rule.rename.missing(self._value) if rule.rename else F.lit(None).cast("string"))
        directory = rule.path.render(self._value)
        new_name = rule.rename.render(self._value) if rule.rename else of_name
        self.target = F.when(self.missing.isNull(), paths.destination(directory, new_name))

    def _value(self, name: str) -> Value:
        if name in self.rule.vars:
            return self._var(self.rule.vars[name])
        if name in self._captures:
            return Value(self._captures[name])
        return attribute(name, "UTC")

    def _var(self, var: Var) -> Value:
        values = [Value(self._captures[s]) if s in self._captures else attribute(s, var.tz) for s in var.sources]
        if var.bucket is not None:
            return Value(bucketed(F.coalesce(*(v.column.cast("long") for v in values)), var.bucket))
        if var.map is not None:
            return Value(mapped(F.coalesce(*(v.text(None) for v in values)), dict(var.map)))
        if len({v.kind for v in values}) == 1:
            return Value(F.coalesce(*(v.column for v in values)), values[0].kind, values[0].zone)
        if {v.kind for v in values} <= {"instant", "civil"}:
            # Wall-clock and zoned times meet as wall-clock times of the variable's zone.
            walls = [grammar.wall(v.column, var.tz) if v.kind == "instant" else v.column for v in values]
            return Value(F.coalesce(*walls), "civil")
        return Value(F.coalesce(*(v.text(None) for v in values)))


def bucketed(size: Column, intervals) -> Column:
    """The label of the first interval that holds a size; null outside all."""
    out = F.lit(None).cast("string")
    for i in reversed(intervals):
        out = F.when(i.holds(size), F.lit(i.label())).otherwise(out)
    return out


def mapped(text: Column, table: dict[str, str]) -> Column:
    """Exact key, then the wildcard with most literal characters (of equals the last key), then ``_``; else null."""
    out = F.lit(table["_"]) if "_" in table else F.lit(None).cast("string")
    wild = sorted((k for k in table if "*" in k), key=lambda k: (len(k.replace("*", "")), k))
    for k in wild:
        out = F.when(paths.wildcard(text, k), F.lit(table[k])).otherwise(out)
    exact = [k for k in table if "*" not in k and k != "_"]
    for k in exact:
        out = F.when(text == k, F.lit(table[k])).otherwise(out)
    return F.when(text.isNotNull(), out)


def _verdict(policy: Policy) -> list[tuple[Column, str, Column]]:
    """What is decided before any rule: (condition, outcome, detail)."""
    path = F.col("path")
    ignored, opaque = matching.under_any(path, list(policy.ignore)), matching.under_any(path, list(policy.opaque))
    out = [(ignored.isNotNull(), "ignored", ignored)]
    if policy.symlinks == "ignore":
        out.append((F.coalesce(F.col("is_symlink"), F.lit(False)), "ignored", F.lit("symlink")))
    out.append((opaque.isNotNull(), "opaque", opaque))
    return out


def place(inventory: DataFrame, policy: Policy) -> DataFrame:
    """Adds outcome (ignored, opaque, placed, unresolvable, unmatched), rule, target, detail."""
    compiled = [Compiled(r) for r in policy.rules]
    text = lambda x: F.lit(x).cast("string")
    made = F.struct(text("unmatched").alias("outcome"), text(None).alias("rule"), text(None).alias("target"), text(None).alias("detail"))
    for c in reversed(compiled):
        made = F.when(
            c.matches,
            F.struct(F.when(c.missing.isNull(), text("placed")).otherwise(text("unresolvable")).alias("outcome"), text(c.rule.name).alias("rule"), c.target.alias("target"), c.missing.alias("detail")),
        ).otherwise(made)
    for condition, outcome, detail in reversed(_verdict(policy)):
        made = F.when(condition, F.struct(text(outcome).alias("outcome"), text(None).alias("rule"), text(None).alias("target"), detail.alias("detail"))).otherwise(made)
    return complete(inventory).withColumn("_placed", made).select("*", "_placed.*").drop("_placed")


def explain(inventory: DataFrame, policy: Policy) -> DataFrame:
    """As ``place``, with ``rules``: for each rule its name, result (matched, also_matches, failed) and the test that failed."""
    compiled = [Compiled(r) for r in policy.rules]
    trace = [
        F.struct(
            F.lit(c.rule.name).alias("name"),
            F.when(c.matches & (F.col("rule") == c.rule.name), "matched").when(c.matches, "also_matches").otherwise("failed").alias("result"),
            F.when(~c.matches, c.failed).alias("failed_on"),
        )
        for c in compiled
    ]
    none = "array<struct<name:string,result:string,failed_on:string>>"
    return place(inventory, policy).withColumn("rules", F.array(*trace) if trace else F.array().cast(none))
