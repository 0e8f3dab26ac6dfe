"""Toxicity by weak supervision.

Voters are word lists (seed insults, and words and word beginnings that stand out in labelled training rows, dealt
into several lists) and text patterns. Each votes on every document. A generative label model takes the votes
of the whole corpus, as counts of vote patterns: voters' accuracies follow from how triples of them agree, what two
voters agree beyond that is their own correlation and gives each a weight (voters that repeat each other share
theirs), and expectation maximisation with those weights estimates how often each fires on either class. Its posterior labels of all
documents train a logistic regression, by Newton steps whose sums Spark adds up over the corpus.

Labels are read of at most max_labelled rows, training rows by crc32(doc_id) only, chosen by a hash of doc_id.
Voters read nothing but the text.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize, number_rows, unused

#: Labelled training rows that the word lists are learned from, at most.
MAX_LABELLED = 50_000
THRESHOLD = 0.3

#: The seed list.
SEED = [["idiot", "moron", "stupid", "fool"], ["loser", "clown", "worthless"], ["pathetic", "disgusting"], ["trash", "scum", "garbage"]]
WORD_LISTS, BEGIN_LISTS = 5, 5
#: A word stands out if its share of toxic rows is at least so many times that of all rows.
LIFT = 2.0
#: Lengths of word beginnings.
BEGIN, BEGIN_MOST = 4, 8
_WORD = re.compile(r"[^\W\d_]+")
_DIRECT = re.compile(r"\b(?:you|you're|u)\s+(?:are\s+)?(?:an?\s+)?(?:idiot|moron|fool|loser|clown|trash|scum)", re.I)
_SHOUT = re.compile(r"!{3,}|\?{3,}")
VOTERS = len(SEED) + WORD_LISTS + BEGIN_LISTS + 2


def held_out():
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2


def learn_words(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED) -> tuple[dict[str, int], dict[str, int]]:
    """Words and word beginnings that toxic training rows hold far oftener than others: name to list.

    One stands out if its share of toxic rows would come about by chance in less than one of 100 corpora, by the
    Chernoff bound over all candidates. No labels, or none of a class: nothing is learned.
    """
    train = labels.where("toxic is not null and doc_id is not null").where(~held_out()).select("doc_id", "toxic")
    train = train.orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(max_labelled)
    train = materialize(train.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "training")
    sizes = train.agg(F.count("*").alias("n"), F.sum("toxic").alias("t")).first()
    if not sizes.n or not sizes.t or sizes.t == sizes.n:
        return {}, {}
    rate = sizes.t / sizes.n
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]+"), F.lit(0)))
    rows = docs.join(F.broadcast(train), "doc_id").select("toxic", words.alias("w"))

    def begins(k):
        return F.transform(F.filter("w", lambda x: F.length(x) > k), lambda x: F.concat(F.substring(x, 1, k), F.lit("*")))

    names = F.concat("w", *[F.array_distinct(begins(k)) for k in range(BEGIN, BEGIN_MOST + 1)])
    named = rows.select("toxic", F.explode(names).alias("name"))
    counts = materialize(named.groupBy("name").agg(F.count("*").alias("n"), F.sum("toxic").alias("t")), "words")
    total = counts.count()
    share = F.col("t") / F.col("n")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    bound = F.col("n") * (share * F.log(share / rate) + rest)
    apart = counts.where((share >= LIFT * rate) & (bound > math.log(100 * max(total, 1)))).select("name", bound.alias("bound"), share.alias("share"))
    # all that stand out, however many: their number is bounded by the words of max_labelled rows
    rows = apart.orderBy("name").collect()
    found = [r for r in rows if not r.name.endswith("*")], [r for r in rows if r.name.endswith("*")]

    def dealt(r, lists: int) -> int:  # what clean rows hold too votes in lists of its own, by how many do
        return 2 + zlib.crc32(r.name.encode()) % (lists - 2) if r.share >= 0.95 else int(r.share >= 0.6)

    seeds = {w for part in SEED for w in part}
    return (
        {r.name: dealt(r, WORD_LISTS) for r in found[0] if r.name not in seeds},
        {r.name[:-1]: dealt(r, BEGIN_LISTS) for r in found[1]},
    )


def count_hits(docs: DataFrame, words: dict[str, int], begins: dict[str, int], carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried, hits (one count a voter), n_words for every row of docs; an empty or null text has no hits."""
    seeds = {w: k for k, part in enumerate(SEED) for w in part}
    by_word = seeds | {w: len(SEED) + k for w, k in words.items()}
    by_begin = {b: len(SEED) + WORD_LISTS + k for b, k in begins.items()}
    opening = {b[:BEGIN] for b in by_begin}

    @F.arrow_udf("hits array<int>, n_words int")
    def of(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in texts:
            hits, sizes = np.zeros((len(batch), VOTERS), np.int32), np.zeros(len(batch), np.int32)
            for i, text in enumerate(batch):  # one text at a time is a Python string
                text = text.as_py() or ""
                found = _WORD.findall(text.lower())
                row = hits[i]
                for w in found:
                    if (k := by_word.get(w)) is not None:
                        row[k] += 1
                    if w[:BEGIN] in opening:  # each list that knows a beginning of the word counts it once
                        for k in {by_begin.get(w[:j]) for j in range(BEGIN, min(BEGIN_MOST + 1, len(w)))} - {None}:
                            row[k] += 1
                row[-2] = len(_DIRECT.findall(text))
                row[-1] = len(_SHOUT.findall(text))
                sizes[i] = len(found)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1) * VOTERS, pa.int32()), pa.array(hits.ravel()))
            yield pa.StructArray.from_arrays([lists, pa.array(sizes)], names=["hits", "n_words"])

    scored = docs.select("doc_id", *carried, of("text").alias("v"))
    return scored.select("doc_id", *carried, "v.hits", "v.n_words")


def dependencies(votes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(accuracy, correlation): each voter's correlation with the hidden label, and that of voters beyond it.

    Voters that are independent within a class correlate by the product of their accuracies, so any two others tell
    a voter's; the median over all pairs withstands pairs that depend on each other.
    """
    m = votes.shape[1]
    share = n / max(n.sum(), 1)
    centred = votes - (votes * share[:, None]).sum(0)
    covariance = (centred * share[:, None]).T @ centred
    scale = np.sqrt(np.clip(np.diag(covariance), 1e-12, None))
    rho = covariance / np.outer(scale, scale)
    accuracy = np.zeros(m)
    for i in range(m):
        told = [
            rho[i, j] * rho[i, k] / rho[j, k]
            for j in range(m)
            for k in range(j)
            if i not in (j, k) and min(rho[i, j], rho[i, k], rho[j, k]) > 0.01
        ]
        accuracy[i] = math.sqrt(min(float(np.median(told)), 0.98)) if told else 0.0
    beyond = rho - np.outer(accuracy, accuracy)
    np.fill_diagonal(beyond, 0)
    return accuracy, beyond


def fit_label_model(votes: np.ndarray, n: np.ndarray, rounds: int = 200) -> dict[str, np.ndarray]:
    """The generative model of distinct vote patterns (0 or 1 for each voter) that occur n times.

    Returns prior, fires (2 by voters: how often each fires on class 0 and 1), weight, accuracy and correlation. A voter
    that never fires, or always does, has weight 0: it tells nothing apart.
    """
    m = votes.shape[1]
    rates = (votes * n[:, None]).sum(0) / max(n.sum(), 1)
    informs = (rates > 0) & (rates < 1)
    accuracy, correlation = dependencies(votes, n)
    weight = informs / (1 + np.where(correlation > 0.05, correlation, 0).sum(1))
    lead = informs & (accuracy > 0.1)
    lead = lead if lead.any() else informs & (np.arange(m) < m - 1)
    q = np.where((votes & lead).any(1), 0.9, 0.02)  # to begin with: any voter that agrees with others
    prior, fires = 0.05, np.full((2, m), 0.5)
    for _ in range(rounds):
        for y, r in ((0, (1 - q) * n), (1, q * n)):
            fires[y] = ((votes * r[:, None]).sum(0) + 0.01) / (r.sum() + 0.02)
        prior = float(np.clip((q * n).sum() / max(n.sum(), 1), 1e-4, 1 - 1e-4))
        before, q = q, posterior(votes, prior, fires, weight)
        if np.abs(q - before).max(initial=0) < 1e-6:
            break
    return {"prior": np.array(prior), "fires": fires, "weight": weight, "accuracy": accuracy, "correlation": correlation}


def posterior(votes: np.ndarray, prior: float, fires: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Probability of class 1 for each row of votes."""
    p = np.clip(fires, 1e-6, 1 - 1e-6)
    ratio = np.where(votes, np.log(p[1] / p[0]), np.log((1 - p[1]) / (1 - p[0])))
    return 1 / (1 + np.exp(-np.clip(math.log(prior / (1 - prior)) + (ratio * weight).sum(1), -30, 30)))


def features(hits: np.ndarray, n_words: np.ndarray) -> np.ndarray:
    """Inputs of the classifier: a constant, whether each voter fired, its hits' logarithm and their density."""
    hits = hits.astype(float)
    n = np.maximum(n_words, 1)[:, None].astype(float)
    any_list = hits[:, :-1].sum(1, keepdims=True)
    return np.hstack([np.ones((len(hits), 1)), hits > 0, np.log1p(hits), np.minimum(100 * hits / n, 10), np.log1p(any_list)])


WIDTH = 2 + 3 * VOTERS


def fit_classifier(counted: DataFrame, model: dict[str, np.ndarray], steps: int = 8, ridge: float = 1.0) -> np.ndarray:
    """Weights of the logistic regression on the posterior labels of all rows of counted (hits, n_words).

    Each Newton step is one pass; a task returns one gradient and one matrix, which are added up by entry.
    """
    beta = np.zeros(WIDTH)
    for _ in range(steps):

        def sums(batches, beta=beta):
            total = np.zeros((WIDTH + 1, WIDTH))
            for batch in batches:
                if not batch.num_rows:
                    continue
                hits = np.array(batch.column("hits").flatten()).reshape(-1, VOTERS)
                x = features(hits, batch.column("n_words").to_numpy())
                y = posterior(hits > 0, float(model["prior"]), model["fires"], model["weight"])
                p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
                total[0] += x.T @ (y - p)
                total[1:] += (x * (p * (1 - p))[:, None]).T @ x
            flat = total.ravel()
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], ["i", "v"])

        added = counted.select("hits", "n_words").mapInArrow(sums, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).collect()
        total = np.zeros((WIDTH + 1) * WIDTH)
        for r in added:
            total[r.i] = r.v
        total = total.reshape(WIDTH + 1, WIDTH)
        step = np.linalg.solve(total[1:] + ridge * np.eye(WIDTH), total[0] - ridge * beta)
        beta = beta + np.clip(step, -4, 4)
        if np.abs(step).max() < 1e-4:
            break
    return beta


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, carried, held_out, score, predicted for every row of docs; carried: columns of docs to hand on.

    A null or empty text scores as one without a hit. Repeated rows score alike. Without documents the result is empty.
    """
    words, begins = learn_words(docs, labels, max_labelled)
    counted = materialize(count_hits(docs, words, begins, carried), "hits")
    # at most 2 ** VOTERS patterns, whatever the corpus
    pattern = F.aggregate(F.transform("hits", lambda h, i: F.when(h > 0, F.pow(F.lit(2.0), i)).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    seen = counted.groupBy(pattern.cast("int").alias("pattern")).agg(F.count("*").alias("n")).collect()
    if not seen:
        none = [F.lit(None).cast(t).alias(c) for c, t in (("held_out", "boolean"), ("score", "double"), ("predicted", "int"))]
        return counted.select("doc_id", *carried, *none)
    patterns = np.array([r.pattern for r in seen])
    votes = (patterns[:, None] >> np.arange(VOTERS) & 1).astype(bool)
    model = fit_label_model(votes, np.array([r.n for r in seen], float))
    beta = fit_classifier(counted, model)

    @F.pandas_udf("double")
    def probability(hits: pd.Series, n_words: pd.Series) -> pd.Series:
        x = features(np.array(hits.tolist()).reshape(-1, VOTERS), n_words.to_numpy())
        return pd.Series(1 / (1 + np.exp(-np.clip(x @ beta, -30, 30))))

    scored = counted.select("doc_id", *carried, held_out().alias("held_out"), probability("hits", "n_words").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def remove_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that are not predicted toxic, each decided by its own text."""
    row = unused(docs, "_row")
    numbered = number_rows(docs, row, "zstd")
    bad = score(numbered, labels, carried=(row,)).where("predicted = 1").select(row)
    return numbered.join(bad, row, "left_anti").select(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's toxicity."""
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
