from datetime import datetime

import pytest
from pyspark.sql import functions as F

from worklog.functions import expr


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(f(F.col("c")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "ms"),
    [("500ms", 500), ("5s", 5000), ("2h", 7_200_000), ("1d", 86_400_000), ("1w", 604_800_000), ("2h30m", 9_000_000), ("1h30m15s500ms", 5_415_500), ("", None), ("abc", None), ("5", None), ("0s", None), ("5y", None), ("99999999999999999999h", None), ("9999999999999w", None), (None, None)],
)
def test_durations(spark, text, ms):
    assert one(spark, text, expr.duration_ms) == ms


def test_clipping(spark):
    assert one(spark, "x" * 10, lambda c: expr.clip(c, 10)) == "x" * 10
    assert one(spark, "x" * 11, lambda c: expr.clip(c, 10)) == "x" * 10 + "..."
    assert one(spark, "2024-01-02T03:04:05", expr.stamp) == "2024-01-02 03:04"


@pytest.mark.parametrize(
    ("text", "want"),
    [('{"a":"123456"}', '{"a":"1234..."}'), ('{"abcdefgh":"123"}', '{"abcdefgh":"123"}'), ('{"a":["12345",{"b":"1\\"345678"}]}', '{"a":["1234...",{"b":"1\\"34..."}]}'), ('{"a":12345678}', '{"a":12345678}')],
)
def test_json_strings_are_clipped(spark, text, want):
    assert one(spark, text, lambda c: expr.clip_json_strings(c, 4)) == want


def test_display_ids(spark):
    assert one(spark, 7, lambda c: expr.format_display_id(F.lit("CTX"), c), "long") == "CTX-0007"
    assert [one(spark, t, expr.display_number) for t in ("A-B-0012", "A", "A-x", None)] == [12, None, None, None]
    assert one(spark, "A-B-0012", expr.display_prefix) == "A-B"


def test_since_bounds(spark):
    now = F.lit(datetime(2024, 1, 8)).cast("timestamp_ntz")
    assert one(spark, "7d", lambda c: expr.since_bound(c, now)) == datetime(2024, 1, 1)
    assert one(spark, "2023-05-06T07:08:09", lambda c: expr.since_bound(c, now)) == datetime(2023, 5, 6, 7, 8, 9)


@pytest.mark.parametrize(
    ("pattern", "text", "want"),
    [("src/*", "src/a/b", True), ("src/**", "src/a", True), ("a?c", "a/c", True), ("src/[ab].rs", "src/a.rs", True), ("src/[ab].rs", "src/[ab].rs", False), ("src/[!a].rs", "src/b.rs", True), ("{a,b}/x", "b/x", True), ("a.rs", "axrs", False), ("a+b(c)", "a+b(c)", True)],
)
def test_globs(spark, pattern, text, want):
    row = spark.createDataFrame([(pattern, text)], "p string, t string").select(F.rlike("t", expr.glob_regex(F.col("p"))).alias("r"), expr.valid_glob(F.col("p")).alias("ok")).first()
    assert (row.r, row.ok) == (want, True)


@pytest.mark.parametrize("pattern", ["a[b", "a]", "{a", "a{b{c}}", "[]"])
def test_bad_globs(spark, pattern):
    assert one(spark, pattern, expr.valid_glob) is False
