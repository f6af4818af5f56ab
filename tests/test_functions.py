"""Names, grammars, templates and policies."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from stowage.functions import grammar, matching, paths
from stowage.functions.templates import Template, TemplateError, Value, java_pattern
from stowage.plans.policy import Policy, PolicyError, load


def column(spark, values, expression):
    rows = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, x string").select("k", expression(F.col("x")).alias("y")).orderBy("k").collect()
    return [r.y for r in rows]


def test_name_parts(spark):
    names = [".env", "a.tar.gz", "a.", "a", "", "..x", "b\nc.txt"]
    assert column(spark, names, paths.stem) == [".env", "a.tar", "a", "a", "", ".", "b\nc"]
    assert column(spark, names, paths.ext) == ["", "gz", "", "", "", "x", "txt"]
    whole = ["/a/b/c.txt/", "c.txt", "a/b"]
    assert column(spark, whole, paths.name) == ["c.txt", "c.txt", "b"]
    assert column(spark, whole, paths.parent) == ["a/b", "", "a"]
    assert column(spark, whole, paths.ancestors) == [["a", "a/b"], [], ["a"]]
    assert column(spark, whole, paths.depth) == [2, 0, 1]


def test_clean_names(spark):
    assert column(spark, ["a<b>:c", "con", "CON.txt", "x. .", "cone", "a\x07b"], paths.sanitize) == ["a_b__c", "_con", "_CON.txt", "x", "cone", "a_b"]
    assert column(spark, ["  Hello, World! ", "É1", "--", ""], paths.slug) == ["hello-world", "1", "", ""]
    assert column(spark, ["7", "12345"], lambda c: paths.pad(c, 3)) == ["007", "12345"]


@pytest.mark.parametrize("seed", range(3))
def test_canonical_paths_never_leave_the_root(spark, seed):
    rng = random.Random(seed)
    raw = ["".join(rng.choice(["/", "\\", "..", ".", " ", "a", "con", ":", "b"]) for _ in range(rng.randint(0, 12))) for _ in range(200)]
    for clean in column(spark, raw, paths.canonical):
        assert not clean.startswith("/") and all(s not in ("", ".", "..") for s in clean.split("/")) or clean == ""


def test_numbers_and_members(spark):
    assert column(spark, ["a/b.txt", "c"], lambda p: paths.numbered(p, F.lit(2))) == ["a/b-2.txt", "c-2"]
    assert column(spark, ["a/clip.mp4"], lambda p: paths.named_after(p, F.lit("nas"))) == ["a/clip (nas).mp4"]
    assert column(spark, ["a/b-12.txt", "a/b.txt", "a/b-x.txt", "a/bc-1.txt"], lambda p: paths.is_numbered(p, F.lit("a/b.txt"))) == [True, True, False, False]
    assert column(spark, [".stowage/x", ".stowagex", "a/.stowage"], paths.is_reserved) == [True, False, False]
    assert column(spark, ["a.txt.stowage-12.part", "a.part"], paths.is_partial) == [True, False]


def test_sizes_durations_intervals(spark):
    assert [grammar.parse_size(x) for x in ("10", "1.5KiB", "2kb", "1 M", "3GB")] == [10, 1536, 2000, 1 << 20, 3 * 10**9]
    assert [grammar.parse_duration(x) for x in ("5", "2m", "1h", "1d", "1w")] == [5, 120, 3600, 86400, 604800]
    for bad in ("", "x", "1parsec", "-3"):
        with pytest.raises(ValueError):
            grammar.parse_size(bad)
    parse = grammar.Interval.parse
    assert [parse(x).label() for x in ("<10MiB", ">=1KiB", "<=2KB", ">3", "=4", "1KiB..2KiB")] == ["under-10MiB", "from-1KiB", "up-to-2KB", "over-3", "exactly-4", "1KiB-2KiB"]
    assert parse("1-5").contains(5) and parse("1-5").contains(1) and not parse("<5").contains(5)
    with pytest.raises(ValueError):
        parse("5-1")
    rng = random.Random(1)
    texts = [">=3", ">3", "<=7", "<7", "=5", "3-7", "4..6", "3"]
    for _ in range(100):
        a, b = parse(rng.choice(texts)), parse(rng.choice(texts))
        if a.subsumes(b):
            assert all(a.contains(n) for n in range(12) if b.contains(n))


def test_globs(spark):
    import re

    table = [("*.txt", "a.txt", True), ("*.txt", "a/b.txt", False), ("**/x", "x", True), ("**/x", "a/b/x", True), ("a/**", "a/b/c", True), ("a?c", "abc", True), ("a?c", "a/c", False), ("[!a]b", "cb", True), ("{a,b}.c", "b.c", True), ("a.b", "axb", False), ("\\*", "*", True)]
    for pattern, text, expected in table:
        assert bool(re.search(matching.glob_regex(pattern), text)) is expected, (pattern, text)
    for bad in ("[a", "{a"):
        with pytest.raises(ValueError):
            matching.glob_regex(bad)
    with pytest.raises(ValueError):
        matching.regex("(?=a)b")


def test_templates(spark):
    made = Template.parse('{{{name|upper|trunc:2}}}/{n|pad:3}-{x|default:"a|b"}-{when:%Y-%m}')
    values = {"name": Value(F.lit("hello")), "n": Value(F.lit(7), "size"), "x": Value(F.lit(None).cast("string")), "when": Value(F.timestamp_seconds(F.lit(1704067200)), "instant", "America/New_York")}
    assert spark.range(1).select(made.render(values.__getitem__)).first()[0] == "{HE}/007-a|b-2023-12"
    assert spark.range(1).select(Template.parse("{x}").missing(values.__getitem__)).first()[0] == "x"
    for bad in ("{", "}", "{}", "{a|nope}", "{a|pad}", "{a|trunc:x}"):
        with pytest.raises(TemplateError):
            Template.parse(bad)
    assert java_pattern("%Y week%%") == "yyyy' week%'"
    with pytest.raises(ValueError):
        java_pattern("%Q")


GOOD = """
[folder]
name = "x"
[[rule]]
name = "a"
path = "{ext}"
match = { ext = ["jpg", "png"] }
[[rule]]
name = "b"
path = "{hash:8}/{v}"
match = { ext = "png", size = ">1MB" }
vars.v = { from = ["exif.Model", "name"] }
"""


def test_policies():
    policy = load(GOOD)
    assert isinstance(policy, Policy) and policy.tier == "whole" and policy.rules[0].tier == "stat" and policy.cooldown == 30
    assert policy.warnings == ("rule 'b' never applies: 'a' matches all of it first",)
    for old, new in (('name = "x"', 'name = "x"\nwhat = 1'), ("{ext}", "{nothing}"), ("{ext}", "{"), ('">1MB"', '"5-1"'), ('name = "b"', 'name = "a"'), ("[folder]", "[folders]"), ('from = ["exif.Model", "name"]', 'from = ["nope"]'), ('ext = "png", size', 'color = "red", size')):
        with pytest.raises(PolicyError):
            load(GOOD.replace(old, new, 1))
