"""Words that nearly agree: by few edits, by prefix, by trigrams, by their stems; each found by equality joins, no pair missed."""

from __future__ import annotations

from functools import reduce
from itertools import combinations, product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.folds import ENDINGS, _softened
from corvane.functions.terms import folded
from corvane.operators.joins import similar_names, small
from corvane.session import table
from corvane.storage import stored

#: Letters from which a word may differ by one edit, by two; segments of a word that may differ by two.
ONE_EDIT, TWO_EDITS, SEGMENTS = 4, 8, 4
#: Letters a word needs for prefixes and trigrams, share of trigrams, letters of the longest prefix that is listed.
LONG_WORD, SHARE, LONGEST_PREFIX = 6, 0.58, 64


def ending_variants(word: Column) -> Column:
    """A folded word, its stems without one of ENDINGS (three letters or more), and both with a hard last letter."""
    ends = F.filter(F.array(*map(F.lit, ENDINGS)), lambda e: F.endswith(word, e) & (F.length(word) - F.length(e) >= 3))
    stems = F.transform(ends, lambda e: F.substring(word, F.lit(1), F.length(word) - F.length(e)))
    return F.array_distinct(F.concat(_softened(F.array(word)), _softened(stems)))


def deletions(word: Column) -> Column:
    """The word, and what is left of it without one letter."""
    one = F.transform(F.sequence(F.lit(1), F.length(word)), lambda i: F.concat(F.substring(word, F.lit(1), i - 1), F.substring(word, i + 1, F.length(word))))
    return F.array_distinct(F.concat(F.array(word), one))


def _segment(n: Column, i: Column) -> tuple[Column, Column]:
    """Start and length of the i-th of the segments of a word of n letters; the last ones are longer."""
    base, first_long = F.floor(n / SEGMENTS).cast("int"), SEGMENTS - n % SEGMENTS
    return 1 + i * base + F.greatest(i - first_long, F.lit(0)), base + (i >= first_long).cast("int")


def _segments_of(words: DataFrame) -> DataFrame:
    """r, key: any two segments of each word."""
    n = F.length("r")
    parts = [F.substring("r", *_segment(n, F.lit(i))) for i in range(SEGMENTS)]
    keys = [F.xxhash64(n, F.lit(i), F.lit(j), parts[i], parts[j]) for i, j in combinations(range(SEGMENTS), 2)]
    return words.select("r", F.explode(F.array(*keys)).alias("key"))


def _segments_for(words: DataFrame) -> DataFrame:
    """l, key: what a word within two edits could have as two segments.

    A segment without edits lies as many places off as letters were put in or left out before it, so the steps of these shifts, up to the difference of the lengths, are two at most.
    """
    shifts = [(more, s, t) for more, s, t in product(range(-2, 3), repeat=3) if abs(s) + abs(t - s) + abs(more + t) <= 2]
    ways = [(more, i, j, s, t) for more, s, t in shifts for i, j in combinations(range(SEGMENTS), 2)]
    names = ("more", "i", "j", "s", "t")
    m = F.length("l")

    def key(w):
        n = m + w["more"]
        (p, a), (q, b) = ((at + w[shift], size) for shift, (at, size) in (("s", _segment(n, w["i"])), ("t", _segment(n, w["j"]))))
        inside = (n >= TWO_EDITS) & (p >= 1) & (p + a - 1 <= m) & (q >= 1) & (q + b - 1 <= m)
        return F.when(inside, F.xxhash64(n, w["i"], w["j"], F.substring("l", p, a), F.substring("l", q, b)))

    listed = F.array(*(F.struct(*(F.lit(x).alias(c) for x, c in zip(w, names, strict=True))) for w in ways))
    return words.select("l", F.explode(F.array_distinct(F.array_compact(F.transform(listed, key)))).alias("key"))


def edit_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r, distance of words (l) and words (r): all pairs of edit distance up to 2 if both have TWO_EDITS letters, else 1, from ONE_EDIT letters on.

    Two words within one edit have a rest in common after a deletion from each, so shorter words meet on what deletions leave. Two edits leave two of
    four segments as they were, so words of TWO_EDITS letters or more meet on pairs of segments: six keys for a word (r), the many places for a word (l). Then the distance decides.
    Nulls and shorter words have no pairs; repeated words give one.
    """
    a, b = (stored(x.select(c).where(F.length(c) >= ONE_EDIT).distinct(), "words") for x, c in ((left, "l"), (right, "r")))
    # levenshtein() gives -1 beyond its limit
    limit = F.when(F.least(F.length("l"), F.length("r")) >= TWO_EDITS, 2).otherwise(1)
    d = F.levenshtein("l", "r", 2)
    keys = [x.where(F.length(c) <= TWO_EDITS).select(c, F.explode(deletions(F.col(c))).alias("key")) for x, c in ((a, "l"), (b, "r"))]
    short = keys[1].join(small(keys[0], "deletions"), "key")
    long_ = _segments_of(b.where(F.length("r") >= TWO_EDITS)).join(small(_segments_for(a.where(F.length("l") >= TWO_EDITS)), "segments"), "key")
    checked = [x.select("l", "r", d.alias("distance")).where((F.col("distance") >= 0) & (F.col("distance") <= limit)) for x in (short, long_)]
    return checked[0].unionByName(checked[1]).distinct()


def prefix_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r of words of LONG_WORD letters or more of which one begins with the other.

    Prefixes up to LONGEST_PREFIX letters meet words; longer ones meet by that many first letters and are compared.
    """

    def begins(whole: DataFrame, w: str, part: DataFrame, p: str) -> DataFrame:
        lengths = F.sequence(F.lit(LONG_WORD), F.least(F.length(w), F.lit(LONGEST_PREFIX)))
        heads = whole.where(F.length(w) >= LONG_WORD).select(w, F.explode(F.transform(lengths, lambda n: F.substring(w, F.lit(1), n))).alias("key"))
        return heads.join(part.where(F.length(p) >= LONG_WORD).select(p, F.substring(p, 1, LONGEST_PREFIX).alias("key")), "key").where(F.startswith(w, p)).select("l", "r")

    a, b = left.select("l").distinct(), right.select("r").distinct()
    return begins(a, "l", b, "r").unionByName(begins(b, "r", a, "l")).distinct()


def trigram_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """l, r of words of LONG_WORD letters or more whose sets of trigrams have a Jaccard similarity of SHARE or more."""

    def grams(w):
        return F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3)))

    return similar_names(*(x.where(F.length(c) >= LONG_WORD) for x, c in ((left, "l"), (right, "r"))), SHARE, grams).select("l", "r")


def fuzzy_pairs(left: DataFrame, right: DataFrame, edits: bool = True) -> DataFrame:
    """l, r, how of folded terms (l) and (r): the pairs of which some variants agree, and by what: equal, prefix, trigram or edit, the first that holds.

    Each leg joins the distinct variants of both sides, and the pairs go back to the terms. Null and empty terms have none. A pair of terms comes once.
    """

    def varied(terms: DataFrame, c: str) -> DataFrame:
        kept = terms.select(c).where(F.col(c) != "").distinct()
        return stored(kept.select(F.col(c).alias(f"{c}_term"), F.explode(ending_variants(F.col(c))).alias(c)), "variants")

    a, b = varied(left, "l"), varied(right, "r")
    words_a, words_b = a.select("l").distinct(), b.select("r").distinct()
    legs = [words_a.join(words_b, F.col("l") == F.col("r")), prefix_pairs(words_a, words_b), trigram_pairs(words_a, words_b)]
    if edits:
        legs.append(edit_pairs(words_a, words_b).select("l", "r"))
    met = reduce(DataFrame.unionByName, (stored(x.select("l", "r").withColumn("leg", F.lit(i)), "leg") for i, x in enumerate(legs)))
    firsts = met.join(a, "l").join(b, "r").groupBy("l_term", "r_term").agg(F.min("leg").alias("leg"))
    names = F.array(*map(F.lit, ("equal", "prefix", "trigram", "edit")))
    return firsts.select(F.col("l_term").alias("l"), F.col("r_term").alias("r"), names[F.col("leg")].alias("how"))


def _words(rows: DataFrame, c: str) -> DataFrame:
    """The words of all folded texts. Folding looks at nothing beyond white space, so each distinct run between it is folded once."""
    runs = rows.select(F.explode(F.split("text", r"\s+")).alias("run")).distinct()
    return runs.select(F.explode(F.split(folded(F.col("run")), " ")).alias(c)).distinct()


def _plain(rows: DataFrame, c: str) -> DataFrame:
    """The words of all texts by their letters a to z, since the SQL counts bytes."""
    each = rows.select(F.explode(F.split(F.regexp_replace(F.lower("text"), "[^a-z ]", ""), " ")).alias(c))
    return each.where(F.length(c) >= ONE_EDIT).distinct()


_AZ = "SELECT DISTINCT unnest(string_split(regexp_replace(lower(text), '[^a-z ]', '', 'g'), ' ')) AS w FROM"


@query(
    "join_edit_terms",
    f"""WITH a AS (SELECT w AS l FROM ({_AZ} benchmark) WHERE length(w) >= 4), b AS (SELECT w AS r FROM ({_AZ} documents) WHERE length(w) >= 4),
    d AS (SELECT l, r, CAST(levenshtein(l, r) AS INTEGER) AS distance FROM a JOIN b ON abs(length(l) - length(r)) <= 2)
    SELECT l, r, distance FROM d WHERE distance <= CASE WHEN least(length(l), length(r)) >= 8 THEN 2 ELSE 1 END""",
)
def join_edit_terms(spark, sf_dir):
    """Words of the benchmark and words of all documents within one or two edits."""
    return edit_pairs(_plain(table(spark, sf_dir, "benchmark"), "l"), _plain(table(spark, sf_dir, "documents"), "r"))


@query(
    "join_prefix_terms",
    f"""WITH a AS (SELECT w AS l FROM ({_AZ} benchmark) WHERE length(w) >= 6), b AS (SELECT w AS r FROM ({_AZ} documents) WHERE length(w) >= 6)
    SELECT l, r FROM a JOIN b ON substr(l, 1, 6) = substr(r, 1, 6) WHERE starts_with(l, r) OR starts_with(r, l)""",
)
def join_prefix_terms(spark, sf_dir):
    """Words of the benchmark and words of all documents of which one begins with the other."""
    return prefix_pairs(_plain(table(spark, sf_dir, "benchmark"), "l"), _plain(table(spark, sf_dir, "documents"), "r"))


@query("join_fuzzy_terms")
def join_fuzzy_terms(spark, sf_dir):
    """How many words of the documents each word of the benchmark finds, by what they agree in."""
    pairs = fuzzy_pairs(_words(table(spark, sf_dir, "benchmark"), "l"), _words(table(spark, sf_dir, "documents"), "r"))
    return pairs.groupBy(F.col("l").alias("term")).agg(*(F.count_if(F.col("how") == h).alias(h) for h in ("equal", "prefix", "trigram", "edit")))
