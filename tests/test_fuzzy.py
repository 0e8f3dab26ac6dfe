"""Fuzzy terms against all pairs of small vocabularies."""

import random

from pyspark.sql import functions as F

from corvane.functions.folds import ENDINGS
from corvane.functions.terms import folded
from corvane.operators import fuzzy, joins
from corvane.operators.fuzzy import edit_pairs, fuzzy_pairs
from corvane.operators.joins import similar_names


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def near(a, b):
    return min(len(a), len(b)) >= 4 and distance(a, b) <= (2 if min(len(a), len(b)) >= 8 else 1)


def changed(r, word, edits):
    for _ in range(edits):
        i, how = r.randrange(len(word) + 1), r.randrange(3)
        word = word[:i] + (r.choice("abcé") if how else "") + word[i + (how != 1):]
    return word


def vocabulary(r, n, alphabet="abcé"):
    base = ["".join(r.choice(alphabet) for _ in range(r.choice([3, 4, 5, 7, 8, 9, 30, 31, 32, 33, 34, 45, 100]))) for _ in range(n)]
    return base, [changed(r, w, r.randrange(4)) for w in base for _ in range(3)] + base[: n // 3]


def frame(spark, words, c):
    return spark.createDataFrame([(w,) for w in words] + [(None,), ("",)], f"{c} string")


def test_edits_as_by_all_pairs(spark):
    left, right = vocabulary(random.Random(1), 40)
    got = {(x.l, x.r): x.distance for x in edit_pairs(frame(spark, left, "l"), frame(spark, right, "r")).collect()}
    assert got == {(a, b): distance(a, b) for a in set(left) for b in set(right) if near(a, b)}
    assert any(len(a) > 32 and d == 2 for (a, _), d in got.items()) and any(len(a) < 8 and d for (a, _), d in got.items())
    words = ["x" * 5000 + "y" * 900, "x" * 5000 + "z" + "y" * 899, "x" * 5002 + "y" * 900, "x" * 4000]
    long_ = edit_pairs(frame(spark, words[:1], "l"), frame(spark, words, "r")).collect()
    assert {(len(x.r), x.distance) for x in long_} == {(5900, 0), (5900, 1), (5902, 2)}


def test_terms_as_by_all_pairs(spark):
    def soft(w):
        return {w, w[:-1] + {"g": "k", "b": "p", "d": "t"}[w[-1]]} if len(w) >= 4 and w[-1] in "gbd" else {w}

    def variants(w):
        stems = {w[: -len(e)] for e in ENDINGS if w.endswith(e) and len(w) - len(e) >= 3}
        return {v for x in {w} | stems for v in soft(x)}

    def grams(w):
        return {w[i : i + 3] for i in range(len(w) - 2)}

    def how(a, b):
        legs = []
        for x in variants(a):
            for y in variants(b):
                if x == y:
                    legs.append(0)
                elif min(len(x), len(y)) >= 6 and (x.startswith(y) or y.startswith(x)):
                    legs.append(1)
                elif min(len(x), len(y)) >= 6 and len(grams(x) & grams(y)) / len(grams(x) | grams(y)) >= 0.58:
                    legs.append(2)
                elif near(x, y):
                    legs.append(3)
        return ("equal", "prefix", "trigram", "edit")[min(legs)] if legs else None

    r = random.Random(4)
    roots = ["kitap", "kitab", "araba", "bilgisayar", "defter", "gozluk", "gozlug", "sandalye", "ogrenci", "p" * 70]
    ends = ["", "lar", "lari", "dan", "imiz", "u", "ler", "yi", "x", "abcd" * 20]
    left, right = ([changed(r, r.choice(roots), r.randrange(2)) + r.choice(ends) for _ in range(60)] for _ in range(2))
    got = {(x.l, x.r): x.how for x in fuzzy_pairs(frame(spark, left, "l"), frame(spark, right, "r")).collect()}
    want = {(a, b): how(a, b) for a in set(left) for b in set(right)}
    assert got == {k: v for k, v in want.items() if v} and set(got.values()) == {"equal", "prefix", "trigram", "edit"}


def test_no_words(spark):
    assert fuzzy_pairs(frame(spark, [], "l"), frame(spark, ["word"], "r")).count() == 0


def test_shared_trigrams_as_by_all_pairs(spark):
    """Short names, names of one trigram, and names of more trigrams than meet on triples; the large side is only shuffled to tell its names and the pairs apart."""
    r = random.Random(7)
    base = ["".join(r.choice("abc") for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14, 17, 19, 22, 40]))) for _ in range(60)] + ["aaaaaaaa", "a" * 40, "ababababab"]
    left, right = base, base[::3] + [changed(r, w, 1 + r.randrange(4)) for w in base for _ in range(3)]

    def grams(w):
        p = f" {w} "
        return {p[i : i + 3] for i in range(max(len(p) - 2, 1))}

    for least in (0.3, 0.58, 0.9):
        found = similar_names(frame(spark, left, "l"), frame(spark, right, "r"), least)
        got = {(x.l, x.r): x.jaccard for x in found.collect() if x.l and x.r}
        shares = {(a, b): len(grams(a) & grams(b)) / len(grams(a) | grams(b)) for a in set(left) for b in set(right) if a and b}
        assert got == {k: v for k, v in shares.items() if v >= least}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning") <= 2


def test_keys_of_a_word_stay_few(spark):
    """Two edits within words of eight letters or more: six keys, where the words without two letters were 56 for one of ten letters."""
    words = [(("bilgisayar" * 20)[:n],) for n in (8, 10, 20, 32, 200)]
    keys = fuzzy._segments_of(spark.createDataFrame(words, "r string")).groupBy("r").count().collect()
    assert len(keys) == len(words) and {k["count"] for k in keys} == {6}


def test_words_are_those_of_whole_folded_texts(spark):
    texts = ["ΣΑΣ Σ x_y-Z\tİI ıi", "á ́b ..\n, q\r\nw\x0bé\x0cÉ\x85k", "  ", "", "x y　z ßẞ", None, "-_- a--b ç_Ğ"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string")
    whole = rows.select(F.explode(F.split(folded(F.col("text")), " ")).alias("w")).distinct()
    assert {x.w for x in fuzzy._words(rows, "w").collect()} - {""} == {x.w for x in whole.collect()} - {""}


def test_sides_that_are_both_large(spark, monkeypatch):
    """Without keys that go to every task: the same pairs."""
    left, right = vocabulary(random.Random(5), 30)
    a, b = frame(spark, left, "l"), frame(spark, right, "r")
    sent = {tuple(x) for x in fuzzy_pairs(a, b).collect()}
    monkeypatch.setattr(joins, "MOST_SENT", -1)
    assert sent and {tuple(x) for x in fuzzy_pairs(a, b).collect()} == sent
