"""Conflicts against all pairs, compiled evidence on planted cases."""

import random

from corvane.operators.evidence_compile import compiled, conflicts

FACTS = "answer_id long, at long, source_id string, subject string, field string, value string, unit string, low double, high double, quote string"
TEXTS = "answer_id long, at long, channel string, text string"
REQUESTS = "answer_id long, grounding string, fields array<string>"


def test_conflicts_as_by_pairs(spark):
    r = random.Random(3)
    rows = [(r.choice(["a", "b", "hot", "hot", "hot", None]), r.choice(["x", "y"]), *sorted((r.randrange(60), r.randrange(60) if r.random() < 0.2 else 30))) for _ in range(400)]
    rows = [(k, f, float(lo), float(hi)) for k, f, lo, hi in rows] + [("one", "x", 5.0, 1.0), ("gap", "x", 1.0, 2.0), ("gap", "x", 2.5, 3.0), ("gap", "x", 1.5, 2.6), ("none", "x", None, 2.0), ("none", "x", float("nan"), 2.0)]
    found = {(x.k, x.f): x for x in conflicts(spark.createDataFrame(rows, "k string, f string, low double, high double"), ["k", "f"]).collect()}
    sound = [(k or "", f, min(a, b), max(a, b)) for k, f, a, b in rows if a is not None and a == a]
    assert set(found) == {x[:2] for x in sound}
    for key, x in found.items():
        mine = [s[2:] for s in sound if s[:2] == key]
        apart = [a for a in mine if any(a[0] > b[1] or a[1] < b[0] for b in mine)]
        camps, reach = 0, None
        for lo, hi in sorted(mine):
            camps, reach = (camps + 1, hi) if reach is None or lo > reach else (camps, max(reach, hi))
        assert (x.facts, x.readings, x.camps, x.disagreeing, x.in_conflict) == (len(mine), len(set(mine)), camps, len(apart), bool(apart)), key
    assert found["gap", "x"].camps == 1 and found["gap", "x"].in_conflict  # linked by a third, yet two have no point in common


def test_conflicts_of_large_groups_and_shuffles(spark, monkeypatch):
    r = random.Random(4)
    rows = [(r.choice(["hot", "hot", "hot", "a", "b", None]), r.randrange(3), float(r.randrange(50)), float(r.randrange(50))) for _ in range(600)]
    facts = spark.createDataFrame(rows, "k string, f int, low double, high double")
    plain = conflicts(facts, ["k", "f"])
    assert plain._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1  # the facts are shuffled once
    monkeypatch.setattr("corvane.operators.evidence_compile.MOST_FACTS", 70)
    ranged = conflicts(facts, ["k", "f"])
    assert ranged.columns == plain.columns and sorted(ranged.collect()) == sorted(plain.collect())
    monkeypatch.setattr("corvane.operators.evidence_compile.MOST_FACTS", 0)
    assert sorted(conflicts(facts, ["k", "f"]).collect()) == sorted(plain.collect())


def test_compiled_cases(spark):
    def fact(a, at, field, value, source="s", subject="m", unit="kg"):
        return a, at, source, subject, field, str(value), unit, float(value), float(value), "q"

    facts = [fact(1, i, "net weight", 4) for i in range(3)] + [fact(2, 0, "net weight", 4), fact(2, 1, "net weight", 5, "t")]
    facts += [fact(3, i, f"field {i}", i) for i in range(9)] + [fact(8, 0, "net weight", 4), fact(8, 1, "net weight", 5, "t", unit="lb")]
    texts = [(4, 0, "fact", "Same"), (4, 1, "fact", "same "), (4, 2, "risk", "THESE conflict"), (4, 3, "unknown", "these conflict"), (5, 0, "fact", None), (5, 1, "fact", "  ")]
    texts += [(6, i, "fact", f"text {i}") for i in range(8)] + [(6, i, "risk", f"r {i}") for i in range(8)]
    requests = [(1, "high", ["net weight", "colour"]), (2, "high", ["net weight"]), (3, "medium", []), (4, "high", None), (5, "high", ["x"]), (6, None, ["total gross tax amount"]), (7, "medium", []), (8, "medium", ["Net Weight", None, " "]), (None, "high", [])]
    got = {x.answer_id: x for x in compiled(spark.createDataFrame(requests, REQUESTS), spark.createDataFrame(texts, TEXTS), spark.createDataFrame(facts, FACTS)).collect()}
    assert set(got) == set(range(1, 9))

    def told(a, *names):
        return tuple(got[a][n] for n in names)

    ways = ("coverage", "confidence", "reason", "sufficiency", "mode", "should_answer", "score")
    assert told(1, *ways) == ("partial", "high", "grounding_high", "partial", "partial_answer", True, 0.78) and told(1, "covered", "missing", "structured_facts") == (["net weight"], ["colour"], 1)
    assert told(2, *ways) == ("complete", "low", "contradiction", "contradictory", "contradiction", True, 0.11) and told(2, "conflict_fields", "sources") == (["net weight"], 2)
    assert told(3, "structured_facts", "covered", *ways[:3]) == (5, [f"field {i}" for i in range(5)], "complete", "medium", "grounding_medium")
    assert told(4, "text_facts", "risks", "unknowns", "contradictions", "mode") == (1, 1, 1, 1, "contradiction")
    assert told(5, *ways) == ("none", "low", "no_usable_facts", "insufficient", "no_source", False, 0.0)
    assert told(6, "text_facts", "risks", "confidence", "coverage") == (5, 3, "low", "partial")
    assert told(7, "coverage", "mode") == ("none", "no_source") and told(8, "contradictions", "coverage", "missing") == (0, "complete", [])


def test_compiled_of_large_answers(spark, monkeypatch):
    r = random.Random(5)
    facts = [(r.choice([1, 1, 1, 2, 3]), i, f"s{r.randrange(20)}", "m", f"field {r.randrange(9)}", str(i % 7), "kg", float(i % 7), float(i % 7), "q") for i in range(300)]
    requests = [(a, "high", ["field 1", "field 8"]) for a in (1, 2, 3, 4)]
    made = spark.createDataFrame(requests, REQUESTS), spark.createDataFrame([], TEXTS), spark.createDataFrame(facts, FACTS)
    plain = sorted(compiled(*made).collect())
    assert {x.answer_id: x.sources for x in plain} == {1: 8, 2: 8, 3: 8, 4: 0}
    monkeypatch.setattr("corvane.operators.evidence_compile.MOST_FACTS", 100)
    assert sorted(compiled(*made).collect()) == plain


def test_no_rows(spark):
    empty = [spark.createDataFrame([], s) for s in (REQUESTS, TEXTS, FACTS)]
    assert compiled(*empty).count() == 0 and conflicts(empty[2], ["field"]).count() == 0
