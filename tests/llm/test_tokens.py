"""Tokens, packing and Simple-8b against the tokenizers library and exact round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corvane.llm import packing, simple8b
from corvane.llm.tokens import PieceEncoder
from tests.llm.helpers import docs, with_clashes

TEXTS = [None, "", "a", " a", "a\n", "a  b", "x's don't, it'll.", "1234 5,6. a.b", "Ünï cödé. ñ, ß.", "日本語 テスト", "<|endoftext|> x", "İx", "...", "a,.", "ª. µ,", "word " * 3000 + "end", "a\n\nb", "a\tb", "A.\nB c, d."]
FILES = ["byte_bpe_50k.json", "word_bpe_49k.json"]


def library(name):
    t = Tokenizer.from_file(public_tokenizers.path(name))
    t.encode_special_tokens = True
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_ids_are_the_librarys(name, monkeypatch):
    monkeypatch.setattr("corvane.llm.tokens.MAX_PIECES", 20)
    e, want = PieceEncoder(public_tokenizers.path(name)), library(name)
    texts = [t or "" for t in TEXTS]
    for _ in range(3):
        ids, offsets = e.encode(texts)
        for i, t in enumerate(texts):
            assert ids[offsets[i] : offsets[i + 1]].tolist() == want(t), t


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(alphabet=st.sampled_from("ab'stred .,\n\t0é!ß <İ "), max_size=40))
def test_any_text(name, text):
    if name not in CACHE:
        CACHE[name] = PieceEncoder(public_tokenizers.path(name)), library(name)
    e, want = CACHE[name]
    assert e.encode([text])[0].tolist() == want(text)


CACHE: dict = {}


def test_piece_lengths():
    assert packing.piece_lengths(0, 8) == [] and packing.piece_lengths(29, 8) == [8, 8, 8, 4, 1]
    with pytest.raises(ValueError):
        packing.piece_lengths(5, 6)


def test_packed_pieces(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(3, TEXTS[3]), (None, "a b")]
    want = library("word_bpe_49k.json")
    packed = packing.pack(with_clashes(docs(spark, rows)), public_tokenizers.path("word_bpe_49k.json"), 64)
    got = packed.collect()
    assert len({r.sequence_id for r in got}) == len(got)
    for k, t in rows:
        ids = want(t) + [1]
        pieces = sorted((r.start, r.length, bytes(r.ids)) for r in got if r.doc_id == k)
        pieces = pieces[:: 1 if k != 3 else 2]
        assert b"".join(p[2] for p in pieces) == np.array(ids, "<u4").tobytes()
        assert [p[1] for p in pieces] == packing.piece_lengths(len(ids), 64)
    packing.write_buckets(packed, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == len(got)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.just(0), st.integers(0, 70000), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    v = np.array(values, np.uint64)
    assert simple8b.decode(*simple8b.encode(v)).tolist() == values


def test_simple8b_runs():
    v = np.array([0] * 500 + [1] * 130 + [2**60, 5], np.uint64)
    words, at, escaped = simple8b.encode(v)
    assert at.tolist() == [630] and escaped.tolist() == [2**60] and len(words) < 12
    assert simple8b.decode(words, at, escaped).tolist() == v.tolist()


def test_files(spark, tmp_path):
    rows = list(enumerate(TEXTS)) + [(7, "again"), (None, "a b")]
    want = library("byte_bpe_50k.json")
    path = str(tmp_path / "f")
    simple8b.write(with_clashes(docs(spark, rows)).repartition(4), path, public_tokenizers.path("byte_bpe_50k.json"), block_ids=64)
    got = sorted(simple8b.read_ids(spark, path).collect(), key=lambda r: r.start)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for r, (k, t) in zip(got, ordered, strict=True):
        ids = np.array(want(t) + [0], "<u4").tobytes()
        assert (r.doc_id, r.start, r.n_tokens) == (k, at, len(ids) // 4) and zlib.crc32(r.ids) == zlib.crc32(ids)
        at += r.n_tokens


def test_empty_tables(spark, tmp_path):
    assert packing.pack(docs(spark, []), public_tokenizers.path("word_bpe_49k.json")).count() == 0
    simple8b.write(docs(spark, []), str(tmp_path / "e"), public_tokenizers.path("byte_bpe_50k.json"))
    assert simple8b.read_ids(spark, str(tmp_path / "e")).count() == 0
