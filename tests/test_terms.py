"""Terms in texts against a loop over all terms."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from corvane.functions import terms


def loop(text, table):
    """All matches of (number, term, open) in a folded text, term by term."""
    out = []
    for number, term, is_open in table:
        tail = r"[^ ]*" if is_open else ""
        out += [(m.start(), m.start() + len(m[1]), number) for m in re.finditer(rf"(?<![^ ])(?=({re.escape(term)}{tail})(?: |$))", text)]
    return sorted(out)


def test_like_a_loop_over_thousands_of_terms():
    rng = random.Random(2)
    words = ["".join(rng.choices("abc", k=rng.randrange(1, 4))) for _ in range(60)]
    table = [(i, " ".join(rng.choices(words, k=rng.randrange(1, 4))), rng.random() < 0.3) for i in range(3000)]
    automaton = terms._automaton(table)
    for _ in range(40):
        text = " ".join(rng.choices(words, k=rng.randrange(0, 40)))
        assert terms.found_in(automaton, text) == loop(text, table)


def test_longest_from_the_left():
    automaton = terms._automaton([(1, "new york", False), (2, "york city", False), (3, "new york city", False), (4, "city", False), (5, "new yor", True)])
    every = terms.found_in(automaton, "new york city new york x city")
    assert [n for _, _, n in terms.longest(every)] == [3, 1, 5, 4]


def test_time_does_not_follow_the_number_of_terms():
    rng = random.Random(3)
    word = lambda: "".join(rng.choices("abcdefgh", k=7))
    text = " ".join(word() for _ in range(40_000))
    took = []
    for n in (300, 60_000):
        automaton = terms._automaton([(i, word(), False) for i in range(n)])
        began = time.process_time()
        terms.found_in(automaton, text)
        took.append(time.process_time() - began)
    assert took[1] < 10 * took[0] + 0.05


@pytest.mark.parametrize("most", [20_000_000, 12])
@pytest.mark.parametrize("overlaps", [False, True])
def test_rows(spark, monkeypatch, most, overlaps):
    """Also with the terms dealt to several automata."""
    monkeypatch.setattr(terms, "MOST_CHARS", most)
    table = [(1, "New-York", False), (2, "york city", False), (3, "ÇAĞRI", False), (4, "kasi", True), (5, "!?", False), (1, "big apple", False), (6, "new york city", None)]
    texts = [(1, "New York City, new_york!"), (2, "Çağrı merkezi: kasiklar KASI"), (3, None), (4, ""), (5, "the big  apple\nyork city" * 2)]
    df = spark.createDataFrame(texts, "k int, text string")
    rules = spark.createDataFrame(table, "number int, term string, open boolean")
    got = sorted((r.k, r.start, r.end, r.number) for r in terms.term_matches(df, "k", "text", rules, overlaps).collect())
    fold = {r.k: r.f for r in df.select("k", terms.folded(df.text).alias("f")).collect()}
    clean = [(r.number, r.t, bool(r.open)) for r in rules.select("number", "open", terms.folded(rules.term).alias("t")).collect() if r.t]
    want = [(k, *m) for k, t in fold.items() for m in (loop(t, clean) if overlaps else terms.longest(loop(t, clean)))]
    assert got == sorted(want) and len(got) > 4


def test_concepts_and_synonyms(spark):
    rules = spark.createDataFrame([(1, "pain", "ache", True), (1, "pain", "hurt", False), (2, "head", "head", False), (3, "none", "zzz", False)], "rank int, concept string, term string, open boolean")
    df = spark.createDataFrame([(1, "My head aches, it hurts."), (2, "nothing"), (3, "Head")], "k int, text string")
    named = terms.named_concepts(df, "k", "text", rules)
    assert {r.k: r.concepts for r in named.collect()} == {1: ["pain", "head"], 3: ["head"]}
    synonyms = spark.createDataFrame([("pain", 1, "sore"), ("pain", 2, "head"), ("head", 1, "skull")], "concept string, place int, synonym string")
    assert {r.k: r.terms for r in terms.expanded(named, "k", synonyms).collect()} == {1: ["pain", "sore", "head", "skull"], 3: ["head", "skull"]}


def test_matches_of_a_batch_take_little_memory(spark):
    """Texts full of terms: a worker holds the numbers of a batch in arrays, not one object a match."""
    import resource

    from corvane.functions.terms import term_matches

    texts = spark.range(0, 4000, 1, 1).select("id", F.expr("repeat('red fox ', 150)").alias("text"))
    terms = spark.createDataFrame([(1, "red", False), (2, "fox", False), (3, "red fox", False)], "number long, term string, open boolean")
    found = term_matches(texts, "id", "text", terms, overlaps=True)

    def peak(batches):
        import pyarrow as pa

        rows = sum(b.num_rows for b in batches)
        yield pa.RecordBatch.from_arrays([pa.array([rows]), pa.array([resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024])], ["rows", "mb"])

    got = found.select("number").mapInArrow(peak, "rows long, mb long").collect()
    assert sum(r.rows for r in got) == 4000 * 450
    counts = {r.number: r.n for r in found.groupBy("number").agg(F.count("*").alias("n")).collect()}
    assert counts == {1: 600_000, 2: 600_000, 3: 600_000}
    assert max(r.mb for r in got) < 500
