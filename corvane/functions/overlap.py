"""Overlap of an answer with a reference: longest common subsequence and BLEU."""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def lcs_f1(a: list[str], b: list[str]) -> float:
    """F1 of the longest common subsequence of two lists of words."""
    if not a or not b:
        return 0.0
    codes = {w: i for i, w in enumerate(dict.fromkeys(b))}
    right = np.array([codes[w] for w in b])
    row = np.zeros(len(b) + 1, np.int64)
    for w in a:
        best = row.copy()
        best[1:] = np.where(right == codes.get(w, -1), row[:-1] + 1, row[1:])
        row = np.maximum.accumulate(best)
    n = int(row[-1])
    return 2 * n / (len(a) + len(b))


def bleu(a: list[str], b: list[str], most: int = 4) -> float:
    """Smoothed sentence BLEU of a against b."""
    if not a or not b:
        return 0.0
    logs = []
    for n in range(1, most + 1):
        x, y = (Counter(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) for w in (a, b))
        total = max(sum(x.values()), 0)
        if not total:
            break
        logs.append(math.log((sum((x & y).values()) + (n > 1)) / (total + (n > 1)) or 1e-9))
    short = min(0.0, 1 - len(b) / len(a))
    return math.exp(sum(logs) / len(logs) + short)


@F.pandas_udf(DoubleType())
def answer_score(answer: pd.Series, reference: pd.Series) -> pd.Series:
    """0 to 100; a null is empty."""
    out = []
    for a, b in zip(answer, reference, strict=True):
        x, y = (a or "").lower().split(), (b or "").lower().split()
        out.append(50 * lcs_f1(x, y) + 50 * bleu(x, y))
    return pd.Series(out)
