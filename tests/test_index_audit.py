"""An index with planted damage of every kind, and how few rows are joined."""

from corvane.operators.index_audit import FINDINGS, _leaves, audit, report, unequal_buckets

SCHEMA = "id long, content_hash string, payload_hash string, provider string, visibility string, version long, vector array<double>, bucket string"


def test_planted_damage(spark):
    rows = {i: [i, f"c{i}", f"p{i}", "bag", "PRIVATE", 2, [1.0, float(i)], "x"] for i in range(400)}
    rows[20] = [20, None, None, None, None, None, None, None]
    targets = list(map(tuple, rows.values()))
    points = {i: list(r) for i, r in rows.items()}
    del points[0]
    points[1000] = [1000, "c", "p", "bag", "PRIVATE", 1, None, "x"]
    points[2][1] = "old"
    points[3][5] = 1
    points[4][2] = "q"
    points[5][3] = "other"
    points[6][4] = "PUBLIC"
    points[7][6] = [1.0, -7.0]
    points[8][6] = [1.0]
    points[9][6] = [1.0, 9.0 + 1e-9]
    points[10][6] = None
    points[11][6] = [0.0, 0.0]
    extra = [tuple(rows[12]), (13, "older", "p13", "bag", "PRIVATE", 1, None, "x"), (None, "c", "p", "b", "v", 1, None, "x")]
    a, b = spark.createDataFrame(targets + [targets[14]] + [(None, "c", "p", "b", "v", 1, None, "x")], SCHEMA), spark.createDataFrame(list(map(tuple, points.values())) + extra, SCHEMA)
    found = audit(a, b)
    assert {r.id: r.findings for r in found.collect()} == {
        0: ["missing"], 1000: ["orphan"], 2: ["stale"], 3: ["stale"], 4: ["payload_drift"], 5: ["provider_mismatch"], 6: ["visibility_drift"],
        7: ["vector_drift"], 8: ["vector_drift"], 11: ["vector_drift"], 12: ["duplicate"], 13: ["duplicate"],
    }
    r = report(a, b, found).first()
    assert (r.total_targets, r.total_points, r.status, r.ready_ratio) == (400, 400, "degraded", round(391 / 400, 6)) and [r[f] for f in FINDINGS] == [1, 1, 2, 1, 1, 1, 3, 2]
    # one bucket for each id that differs, repeated targets and unlike nulls included
    assert unequal_buckets(_leaves(a, 65_536), _leaves(b, 65_536)).count() <= 15
    assert {r.id for r in audit(a, b, 3).collect()} == {r.id for r in found.collect()}


def test_equal_and_empty(spark):
    full = spark.createDataFrame([(i, "c", "p", "b", "v", 1, None, "x") for i in range(50)], SCHEMA)
    none = full.limit(0)
    assert audit(full, full).count() == 0 and report(full, full, audit(full, full)).first().status == "ready"
    assert report(full, none, audit(full, none)).first().asDict() | {"missing": 50, "status": "unavailable", "ready_ratio": 0.0} == report(full, none, audit(full, none)).first().asDict()
    assert report(none, none, audit(none, none)).first().ready_ratio == 1.0
