"""Queries on a few rows with the keys that only large tables have, against their SQL."""

from __future__ import annotations

from datetime import datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from stowage import catalog
from stowage.functions import grammar
from stowage.operators import learn


@pytest.fixture
def documents(spark, tmp_path):
    """Writes documents (doc_id, text), and gives a function to ask for a query's rows and its SQL's."""

    def write(rows):
        made = [(k, text, "en", f"src{k % 3}") for k, text in rows]
        spark.createDataFrame(made, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")

        def ask(name):
            con = duckdb.connect()
            con.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
            got = catalog.QUERIES[name](spark, str(tmp_path))
            rows = con.execute(f"select {', '.join(got.columns)} from ({catalog.SQL[name]})").fetchall()
            return sorted((tuple(r) for r in got.collect()), key=repr), sorted(rows, key=repr)

        return ask

    return write


def test_no_cooldown_holds_no_file_back(spark):
    now = datetime(2024, 6, 1)
    rows = spark.createDataFrame([(k, now + timedelta(seconds=s), now) for k, s in enumerate((-31, -30, -29, 0, 60))], "k int, mtime timestamp, now timestamp")
    for seconds, left in ((30, [None, None, 1, 30, 90]), (0, [None] * 5)):
        assert [r.c for r in rows.orderBy("k").select(grammar.cooling(F.col("now"), F.col("mtime"), seconds).alias("c")).collect()] == left


def test_layouts_move_files_that_are_newer_than_now(documents):
    got, wanted = documents([(k, "x" * k) for k in (1, 2, 3)] + [(k, "abc") for k in (218_880, 218_881, 400_000)])("compare_layouts")
    assert got == wanted and ("by-type", True, 6, 6, 15, 1, 6) in got


def test_sizes_and_ages_in_units(spark):
    sizes = {1023: "1023 B", 1280: "1.2 KiB", 1_024_000: "1000.0 KiB", 1_048_575: "1024.0 KiB", 3 << 29: "1.5 GiB", 1234 << 40: "1234.0 TiB"}
    ages = {59: "59s", 60: "1m", 3599: "59m", 86_399: "23h", 86_400: "1d", 604_800: "1w"}
    at = lambda f, keys, *units: [r[0] for r in spark.createDataFrame([(k,) for k in keys], "n long").coalesce(1).select(f(F.col("n"), *units)).collect()]
    assert at(grammar.human_bytes, sizes) == list(sizes.values()) and at(grammar.human_age, ages) == list(ages.values())
    assert at(grammar.human_bytes, [3 << 29], ("KiB", "MiB")) == ["1536.0 MiB"] and at(grammar.human_age, [86_399, 90_000], ("d", "w")) == ["86399s", "1d"]


def test_shown_sizes_and_ages_of_young_files(documents):
    got, wanted = documents([(0, "x"), (217_439, None), (217_440, "x" * 1280), (217_441, "x" * 1_024_000), (218_879, "x" * 1_048_575), (218_880, "x" * 1_048_576), (400_000, "")])("display_sizes")
    assert got == wanted and ("src1/en/217441.txt", "1000.0 KiB", "86340s") in got


#: Rows whose years are 2014, 2099 to 2101 and 10000 and later.
FAR = [(k, "x") for k in (*range(9), *range(67_030, 67_040), *range(67_850, 67_860), *range(68_700, 68_800), *range(6_300_400, 6_300_420))]


def test_levels_of_far_years(documents):
    got, wanted = documents(FAR)("learn_levels")
    assert got == wanted and {guess for level, guess, _ in got if level == 1} == {"year", "name"}


def test_settled_far_years(documents):
    got, wanted = documents(FAR)("learn_settled")
    assert got == wanted and [row[1] for row in got if row[0] == 1] == ["year"]


def test_learn_keeps_its_years(spark):
    rows = [(f"{y}/05/f.txt", datetime(y, 5, 3), "text/plain") for y in (1899, 1900, 2100, 2101)]
    found = learn.levels(spark.createDataFrame(rows, "path string, mtime timestamp, mime string"))
    assert [tuple(r) for r in found.orderBy("path", "level").select("guess").collect()] == [(g,) for g in ("name", "name", "year", "month", "year", "month", "name", "name")]
