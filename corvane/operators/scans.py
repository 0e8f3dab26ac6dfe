"""Folds whose steps depend on order, computed range by range and combined: no key's rows are ever held together."""

from __future__ import annotations

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.session import table


def clamped_sum(rows: DataFrame, key: str | list[str], order: list[str], delta: str, low: float = -1.0, high: float = 1.0, places: int = 4) -> DataFrame:
    """key, total: the deltas added in order, held between low and high at every step; exact, in units of 10 ** -places.

    A step takes x to min(max(x + d, low), high). Steps in a row are a map of the same form, min(max(x + shift, a), b), so rows
    are dealt into ranges of key and order, each range of a key becomes one such map, and a key's maps, as many as
    ranges at most, are applied one after the other to 0. A key with very many rows is many ranges. Deltas are
    rounded to places first; a null delta is 0; rows that tie in order are added in no certain order, so order should tell all apart.
    """
    keys = [key] if isinstance(key, str) else list(key)
    unit = 10**places
    least, most = round(low * unit), round(high * unit)
    steps = rows.select(*keys, *[c for c in order if c not in keys], F.coalesce(F.round(F.col(delta) * unit), F.lit(0)).cast("long").alias("_d"))

    def fold(batches):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        part, schema = TaskContext.get().partitionId(), None

        def out(k, m):
            arrays = [pa.array([v], schema.field(c).type) for c, v in zip(keys, k, strict=True)]
            return pa.RecordBatch.from_arrays([*arrays, pa.array([part], pa.int32()), *(pa.array([x], pa.int64()) for x in m)], [*keys, "_part", "_s", "_a", "_b"])

        open_key, state = None, None
        for batch in batches:
            n, schema = batch.num_rows, batch.schema
            if not n:
                continue
            new = np.zeros(n, bool)
            for c in keys:
                a, b = batch.column(c).slice(1), batch.column(c).slice(0, n - 1)
                differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.not_equal(pc.is_null(a), pc.is_null(b)))
                new[1:] |= differ.to_numpy(zero_copy_only=False)
            starts = np.flatnonzero(new).tolist()
            d = batch.column("_d").to_pylist()
            for i, j in zip([0, *starts], [*starts, n], strict=True):
                k = tuple(batch.column(c)[i].as_py() for c in keys)
                if state is None or k != open_key:
                    if state is not None:
                        yield out(open_key, state)
                    open_key, state = k, (0, least - (1 << 60), most + (1 << 60))
                s, a, b = state
                for x in d[i:j]:
                    s += x
                    a += x
                    b += x
                    if a < least:
                        a = least
                    elif a > most:
                        a = most
                    if b > most:
                        b = most
                    elif b < least:
                        b = least
                state = s, a, b
        if state is not None:
            yield out(open_key, state)

    ranged = steps.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    types = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keys)
    maps = ranged.mapInArrow(fold, f"{types}, _part int, _s long, _a long, _b long")
    listed = maps.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_part", "_s", "_a", "_b"))).alias("m"))
    total = F.aggregate("m", F.lit(0).cast("long"), lambda x, m: F.least(F.greatest(x + m["_s"], m["_a"]), m["_b"]))
    return listed.select(*keys, (total / unit).alias("total"))


#: Why an adjustment is held back, and how large a promoted one may be.
NOT_PASSED, NO_COVERAGE, NO_EVIDENCE, NO_EFFECT = (
    "not all source apply records passed eval gate",
    "feedback regression coverage missing or incomplete",
    "production gate evidence missing",
    "review-only adjustment has no runtime score effect",
)
MOST_DELTA = 0.35


def adjustment_impacts(rows: DataFrame, key: list[str], order: list[str], cap: float = MOST_DELTA) -> DataFrame:
    """key, total, active, passed, coverage_ok, gate_ran, blocked (reasons), recommendation, next_action of adjustments.

    rows: key, order, delta, passed, coverage_ok, gate_ran; the last two are true, false or unknown: one false makes the
    group's false, else one true makes it true. Nothing is promoted that has a reason against it.
    """
    folded = clamped_sum(rows, key, order, "delta")
    counts = rows.groupBy(*key).agg(
        F.count("*").alias("active"), F.count_if("passed").alias("passed"), F.bool_and("coverage_ok").alias("coverage_ok"), F.bool_and("gate_ran").alias("gate_ran")
    )
    # a key may be null, so it is joined by equality of nulls too
    same = [folded[c].eqNullSafe(counts[c]) for c in key]
    joined = folded.join(counts, same).select(*[folded[c] for c in key], "total", "active", "passed", "coverage_ok", "gate_ran")
    over = f"score delta exceeds promotion cap {cap:g}"
    reasons = [
        (F.col("passed") != F.col("active"), NOT_PASSED),
        (~F.coalesce("coverage_ok", F.lit(False)), NO_COVERAGE),
        (~F.coalesce("gate_ran", F.lit(False)), NO_EVIDENCE),
        (F.col("total") == 0, NO_EFFECT),
        (F.abs("total") > cap, over),
    ]
    blocked = F.array_compact(F.array(*[F.when(when, F.lit(why)) for when, why in reasons]))
    advice = F.when(F.size("blocked") == 0, "eligible_for_shadow_runtime").when(F.col("total") == 0, "review_only").otherwise("keep_passive")
    undo = F.array_contains("blocked", NOT_PASSED) | F.array_contains("blocked", over)
    action = F.when(F.size("blocked") == 0, "eligible_for_shadow_observation").when(undo, "rollback_or_review").otherwise("inspect_blockers")
    return joined.withColumn("blocked", blocked).withColumns({"recommendation": advice, "next_action": action})


def shadow_ranked(candidates: DataFrame, impacts: DataFrame, query_key: str, collection: str) -> DataFrame:
    """candidates (query_key, collection, place) with delta and shadow_place: by the eligible deltas, the largest first, then by place."""
    eligible = impacts.where(F.col("recommendation") == "eligible_for_shadow_runtime").select(query_key, collection, F.col("total").alias("delta"))
    with_delta = candidates.join(eligible, [query_key, collection], "left").fillna(0.0, ["delta"])
    order = Window.partitionBy(query_key).orderBy(F.desc("delta"), "place")
    return with_delta.withColumn("shadow_place", F.row_number().over(order))


def _band() -> Column:
    return F.floor(F.col("value") / 25).cast("int")


_ADJUSTED = """a AS (SELECT user_id, CAST(floor(value / 25) AS INTEGER) AS band, ts, event_id, CASE event_type WHEN 'error' THEN -0.08 WHEN 'purchase' THEN 0.12 ELSE 0.03 END AS d,
    event_type <> 'error' AS passed, CASE event_type WHEN 'signup' THEN NULL ELSE value > 1 END AS cov, CASE WHEN event_type <> 'view' THEN true END AS ran FROM events),
  e AS (SELECT *, row_number() OVER (PARTITION BY user_id, band ORDER BY ts, event_id) AS rn FROM a),
  f AS (SELECT user_id, band, rn, round(least(greatest(CAST(0 AS DOUBLE) + d, -1), 1), 4) AS t FROM e WHERE rn = 1
    UNION ALL SELECT e.user_id, e.band, e.rn, round(least(greatest(f.t + e.d, -1), 1), 4) FROM f JOIN e ON e.user_id = f.user_id AND e.band = f.band AND e.rn = f.rn + 1),
  g AS (SELECT user_id, band, arg_max(t, rn) AS total FROM f GROUP BY ALL),
  c AS (SELECT user_id, band, count(*) AS active, count(*) FILTER (passed) AS passed, bool_and(cov) AS cov, bool_and(ran) AS ran FROM a GROUP BY ALL),
  i AS (SELECT *, list_filter([CASE WHEN passed <> active THEN 'not all source apply records passed eval gate' END, CASE WHEN NOT coalesce(cov, false) THEN 'feedback regression coverage missing or incomplete' END,
    CASE WHEN NOT coalesce(ran, false) THEN 'production gate evidence missing' END, CASE WHEN total = 0 THEN 'review-only adjustment has no runtime score effect' END,
    CASE WHEN abs(total) > 0.35 THEN 'score delta exceeds promotion cap 0.35' END], lambda x: x IS NOT NULL) AS blocked FROM g JOIN c USING (user_id, band))"""


def _adjustments(spark, sf_dir) -> DataFrame:
    """Events as adjustments of a user's bands of values."""
    kind = F.col("event_type")
    return table(spark, sf_dir, "events").select(
        "user_id",
        _band().alias("band"),
        "ts",
        "event_id",
        F.when(kind == "error", -0.08).when(kind == "purchase", 0.12).otherwise(0.03).alias("delta"),
        (kind != "error").alias("passed"),
        F.when(kind != "signup", F.col("value") > 1).alias("coverage_ok"),
        F.when(kind != "view", F.lit(True)).alias("gate_ran"),
    )


@query(
    "agg_adjustment_impacts",
    f"""WITH RECURSIVE {_ADJUSTED} SELECT user_id, band, total, active, passed, cov AS coverage_ok, ran AS gate_ran, array_to_string(blocked, ';') AS blocked,
      CASE WHEN len(blocked) = 0 THEN 'eligible_for_shadow_runtime' WHEN total = 0 THEN 'review_only' ELSE 'keep_passive' END AS recommendation,
      CASE WHEN len(blocked) = 0 THEN 'eligible_for_shadow_observation' WHEN passed <> active OR abs(total) > 0.35 THEN 'rollback_or_review' ELSE 'inspect_blockers' END AS next_action FROM i""",
)
def agg_adjustment_impacts(spark, sf_dir):
    """What each band's adjustments come to, the state of their gates, and why they are held back."""
    impacts = adjustment_impacts(_adjustments(spark, sf_dir), ["user_id", "band"], ["ts", "event_id"])
    return impacts.withColumn("blocked", F.array_join("blocked", ";"))


@query(
    "plan_shadow_ranking",
    f"""WITH RECURSIVE {_ADJUSTED}, k AS (SELECT user_id, band, row_number() OVER (PARTITION BY user_id ORDER BY active DESC, band) AS place FROM c),
    s AS (SELECT k.*, CASE WHEN len(blocked) = 0 THEN total ELSE 0 END AS delta FROM k JOIN i USING (user_id, band))
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY delta DESC, place) AS shadow_place FROM s""",
)
def plan_shadow_ranking(spark, sf_dir):
    """A user's bands, the busiest first, and their order once the adjustments that no gate holds back are applied."""
    rows = _adjustments(spark, sf_dir)
    impacts = adjustment_impacts(rows, ["user_id", "band"], ["ts", "event_id"])
    place = F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("active"), "band"))
    candidates = rows.groupBy("user_id", "band").agg(F.count("*").alias("active")).select("user_id", "band", place.alias("place"))
    return shadow_ranked(candidates, impacts, "user_id", "band")
