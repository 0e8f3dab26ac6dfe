"""Alignment of two tokenizers against the libraries and loops."""

import collections
import hashlib

import numpy as np
import public_tokenizers
import pytest

from corvane.llm import alignment
from tests.llm.helpers import docs, with_clashes

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def brute(rows):
    """What the operator returns for (doc_id, text), text by text with the libraries."""
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    ta, tb = Tokenizer.from_file(A), SentencePieceProcessor(model_file=B)
    ta.encode_special_tokens = True
    of_a, of_b = alignment.vocabulary(A).bytes, alignment.vocabulary(B).bytes
    found = []
    for _, text in rows:
        if not text:
            found.append([])
            continue
        raw = f" {text}".encode()
        a, b = ta.encode(f" {text}", add_special_tokens=False).ids, tb.encode(text)
        if b"".join(of_a[i] for i in a) != raw or b"".join(of_b[i] for i in b) != raw:
            found.append([])
            continue
        ea, eb = (np.cumsum([len(of[i]) for i in ids]).tolist() for of, ids in ((of_a, a), (of_b, b)))
        cut, groups, i, j = sorted(set(ea) & set(eb)), [], 0, 0
        for c in cut:
            x, y = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append((a[i:x], b[j:y]))
            i, j = x, y
        found.append(groups)
    count = collections.Counter(p for g in found for p in {(x, y) for xs, ys in g for x in xs for y in ys})
    best = collections.defaultdict(int)
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = []
    for (doc_id, _), groups in zip(rows, found, strict=True):
        links = [(x, y) for xs, ys in groups for x in xs for y in ys]
        said = ";".join(",".join(map(str, xs)) + "|" + ",".join(map(str, ys)) for xs, ys in groups)
        sums = sum(len(x) for x, _ in groups), sum(len(y) for _, y in groups), len(groups), len(links)
        told = sum(count[p] == best[p[0]] for p in links), sum(count[p] for p in links)
        out.append((doc_id, *sums, *told, hashlib.sha256(said.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


TEXTS = [
    "the quick brown fox", "  two  spaces \n a line\n\n b\t c ", " lead", "trail ", "   ", "\n", "x", "don't we'll 's ' s", "naïve façade Straße", "日本語 のテキスト", "😀 smile 😀😀",
    "a b  c   d", "has ▁ inside", "▁", "<|endoftext|> and </s> <s> <unk> <0x41>", "nul \x00 byte", "=" * 200 + " " + "-=" * 90, "a " * 500, " " * 70, "the the the the", "ABC abc 123 4567,89.", None, "", "́ é ﬁ Ａ",
]


def same(spark, rows, **more):
    got = alignment.align(with_clashes(docs(spark, rows)).repartition(3), A, B, **more)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == brute(rows)


def test_edges_like_brute_force(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)]
    same(spark, [*rows, (3, TEXTS[0]), (3, TEXTS[0]), (None, "the fox"), (None, "the fox"), (900, "thequickbrown" * 3000)])


def test_random_texts_like_brute_force(spark):
    rng = np.random.default_rng(0)
    pieces = np.array([" ", "  ", "\n", "\t", "the", "Ba", "'s", "12", "é", "…", "字", "<", "▁", " ", ",", "xq"])
    share = np.array([6, 1, 1, 1, 6, 6, 1, 2, 2, 1, 1, 1, 0.05, 0.5, 2, 4])
    same(spark, [(i, "".join(rng.choice(pieces, rng.integers(1, 60), p=share / share.sum()))) for i in range(300)])


def test_counts_that_are_joined(spark, monkeypatch):
    monkeypatch.setattr(alignment, "MOST_PAIRS", 0)
    monkeypatch.setattr(alignment, "MOST_BUILD", 0)
    same(spark, [(i, t) for i, t in enumerate(TEXTS)])


def test_documents_like_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    got = alignment.query(spark, "/root/testdata/sf0.001").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_cuts_are_not_shuffled(spark):
    rows, n = alignment.dealt(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    assert n > 1
    with alignment.by_bucket(spark):
        units = alignment.bucketed(alignment.tokenized(rows, A, B).selectExpr("*", "monotonically_increasing_id() AS unit"), "units", n)
        found = units.join(alignment.cuts(units, A, B).hint("merge"), ["bucket", "unit"])
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert found.count() == units.count()
    assert "hashpartitioning" not in plan and "SortMergeJoin" in plan
    assert spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") == "true"


def test_no_documents(spark):
    assert alignment.align(docs(spark, []), A, B).count() == 0
    same(spark, [(1, None), (2, "")])


@pytest.mark.parametrize("path", [A, B])
def test_vocabulary_bytes(path):
    v = alignment.vocabulary(path)
    text = " Übung macht den Meister, the quick 日本 \t x"
    assert b"".join(v.bytes[i] for i in v.ids(text)) == text.encode()


def test_units_of_few_tokens_need_no_joins(spark, monkeypatch):
    """The cuts of ordinary words come from their rows; before, the tokens of all units were joined on their ends."""
    monkeypatch.setattr(alignment, "cuts", None)
    rows = [(i, f"unbelievable {i} wörter, añadir: naïve\n\tend " * (i % 4)) for i in range(20)] + [(30, "日本語のテキスト"), (31, None), (32, "")]
    same(spark, rows)


def test_long_units_are_cut_by_joins(spark, monkeypatch):
    """Few tokens, many, and tokens that all end alike, in one corpus; the joins give what the rows give."""
    monkeypatch.setattr(alignment, "FEW", 2)
    rows = [(i, f"unbelievable {i} wörter, añadir: naïve\n\tend " * (i % 4) + "x" * i) for i in range(20)] + [(30, "日本語のテキスト" * 30), (31, None), (32, " a  b")]
    same(spark, rows)
