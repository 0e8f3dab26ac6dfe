"""Clamped sums and what is built on them."""

import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import scans


def by_loop(deltas, low=-1.0, high=1.0):
    x = 0
    for d in deltas:
        x = min(max(x + round(d * 10_000), round(low * 10_000)), round(high * 10_000))
    return x / 10_000


def test_many_keys_like_a_loop(spark):
    rng = random.Random(1)
    rows = [(rng.choice(["a", "b", None, "c"]), rng.randrange(5), t, rng.choice([0.3, -0.4, 0.05, -0.0001, 2.5, None])) for t in range(3000)]
    df = spark.createDataFrame(rows, "k string, j int, t int, d double").repartition(7)
    got = {(r.k, r.j): r.total for r in scans.clamped_sum(df, ["k", "j"], ["t"], "d", -0.9, 1.1).collect()}
    want = {}
    for k, j, _, d in rows:
        want.setdefault((k, j), []).append(d or 0.0)
    assert got == pytest.approx({k: by_loop(v, -0.9, 1.1) for k, v in want.items()})


def test_a_key_of_many_ranges(spark):
    """300,000 rows of one key lie in many ranges, and no task holds them together."""
    df = spark.range(300_000).select(F.lit(1).alias("k"), F.col("id").alias("t"), (F.pmod(F.xxhash64("id"), F.lit(2001)) / 10_000 - 0.1).alias("d"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = scans.clamped_sum(df, "k", ["t"], "d", -0.35, 0.35)
        total = got.first().total
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert total == by_loop([r.d for r in df.orderBy("t").collect()], -0.35, 0.35)


def test_no_rows(spark):
    assert scans.clamped_sum(spark.createDataFrame([], "k int, t int, d double"), "k", ["t"], "d").count() == 0


def test_gates_and_ranking(spark):
    rows = [("q", "a", 1, 0.2, True, True, None), ("q", "a", 2, 0.1, True, None, True), ("q", "b", 1, 0.3, True, True, True), ("q", "b", 2, 0.3, True, True, True), ("q", "c", 1, 0.1, False, True, True), ("q", "d", 1, -0.1, True, False, True), ("q", "d", 2, 0.1, True, True, None), ("q", "e", 1, 0.34, True, True, True)]
    df = spark.createDataFrame(rows, "q string, c string, t int, delta double, passed boolean, coverage_ok boolean, gate_ran boolean")
    impacts = scans.adjustment_impacts(df, ["q", "c"], ["t"])
    got = {r.c: (r.total, r.recommendation, r.next_action, list(r.blocked)) for r in impacts.collect()}
    assert got["a"] == (0.3, "eligible_for_shadow_runtime", "eligible_for_shadow_observation", [])
    assert got["b"] == (0.6, "keep_passive", "rollback_or_review", ["score delta exceeds promotion cap 0.35"])
    assert got["c"] == (0.1, "keep_passive", "rollback_or_review", [scans.NOT_PASSED])
    assert got["d"] == (0.0, "review_only", "inspect_blockers", [scans.NO_COVERAGE, scans.NO_EFFECT])
    places = spark.createDataFrame([("q", c, i) for i, c in enumerate("fabcde")] + [("r", "a", 0)], "q string, c string, place int")
    ranked = scans.shadow_ranked(places, impacts, "q", "c").where("q = 'q'").orderBy("shadow_place").collect()
    assert [r.c for r in ranked] == list("eafbcd")
