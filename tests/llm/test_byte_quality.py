"""The byte network against a loop and central differences; the quality query on held-out rows."""

import math
import zlib

import numpy as np
import pytest

from corvane.llm import byte_quality, bytenet
from tests.llm.helpers import docs, with_clashes


def packed(texts):
    sizes = np.array([len(t) for t in texts], np.int64)
    return np.frombuffer(b"".join(texts), np.uint8), np.cumsum(sizes) - sizes, sizes


def by_loop(net, text):
    """The probability of one text, window by window."""
    step = bytenet.CHUNK - bytenet.OVERLAP
    hidden = []
    for a in range(0, max(1, len(text) - bytenet.OVERLAP), step):
        part = text[a : a + bytenet.CHUNK]
        x = list(part) + [bytenet.PAD] * (bytenet.CHUNK - len(part))
        windows = range(0, bytenet.CHUNK - bytenet.WIDTH + 1, bytenet.STRIDE)
        best = np.max([net.bytes[x[w : w + bytenet.WIDTH]].ravel() @ net.filters for w in windows], axis=0)
        inputs = np.append(np.maximum(best + net.filter_bias, 0), len(part) / bytenet.CHUNK)
        hidden.append(np.tanh(inputs @ net.hidden + net.hidden_bias))
    z = np.append(np.max(hidden, axis=0), np.mean(hidden, axis=0)) @ net.out + net.out_bias[0]
    return 1 / (1 + math.exp(-z))


@pytest.fixture(scope="module")
def texts():
    rng = np.random.default_rng(1)
    return [rng.integers(256, size=n, dtype=np.uint8).tobytes() for n in (0, 1, 7, 255, 256, 257, 496, 497, 3000)]


def test_probabilities_like_a_loop(texts):
    net = bytenet.ByteNet(seed=3)
    got = net.probabilities(*packed(texts))
    assert got == pytest.approx([by_loop(net, t) for t in texts], abs=1e-5)
    assert net.probabilities(*packed([])).size == 0


def test_chunks_cover_each_text(texts):
    raw, starts, sizes = packed(texts)
    place, valid, of = bytenet.chunk_places(starts, sizes)
    for i, t in enumerate(texts):
        seen = {p for a, n in zip(place[of == i], valid[of == i], strict=True) for p in range(a - starts[i], a - starts[i] + n)}
        assert seen == set(range(len(t)))


def test_gradient(texts):
    rng = np.random.default_rng(4)
    net = bytenet.ByteNet(seed=5)
    y = np.arange(len(texts)) % 2
    grad, loss = net.gradient(*packed(texts), y.astype(float))
    p = net.probabilities(*packed(texts))
    assert loss == pytest.approx(-np.mean(np.log(np.where(y, p, 1 - p))), abs=1e-5)
    big = rng.permutation(np.flatnonzero(abs(grad) > 1e-3))[:60]
    assert len(big) == 60
    close = 0
    for i in big:
        sides = []
        for e in (1e-3, -1e-3):
            flat = net.flat.copy()
            flat[i] += e
            sides.append(bytenet.ByteNet(flat).gradient(*packed(texts), y.astype(float))[1])
        close += abs((sides[0] - sides[1]) / 2e-3 - grad[i]) < 0.05 * abs(grad[i]) + 5e-4
    assert close >= 57  # a step may move a largest answer


@pytest.fixture(scope="module")
def labelled():
    rng = np.random.default_rng(2)
    words = [f"w{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(300):
        w = " ".join(rng.choice(words, 50))
        bad = i % 4 == 0
        rows.append((i, w.replace(" ", "$$$ ") if bad else w))
        if i % 7:
            labels.append((i, int(not bad), 0))
    return rows, labels


def scored(spark, rows, labels, **more):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return byte_quality.score(with_clashes(docs(spark, rows)).repartition(3), lab, **more).collect()


def test_edges(spark, labelled):
    rows, labels = labelled
    more = [(1000, ""), (1001, None), (1002, "a$$$ " * 100_000), (0, rows[0][1]), (None, rows[1][1]), (1003, "é𝄞 " * 5)]
    got = scored(spark, rows + more, [*labels, (5, None, 0), (None, 1, 0), (1, 1, 0)], epochs=6)
    assert len(got) == len(rows) + len(more) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
    assert all((zlib.crc32(str(r.doc_id).encode()) % 3 == 1) == r.held_out for r in got if r.doc_id is not None)
    by: dict = {}
    for r in got:
        by.setdefault(r.doc_id, []).append(r.score)
    assert by[0][0] == by[0][1] and by[None] == by[1] and by[1000] == by[1001] and by[1002][0] < 0.5
    right = [r.predicted == int(r.doc_id % 4 != 0) for r in got if r.held_out and r.doc_id is not None and r.doc_id < 300]
    assert np.mean(right) > 0.95


def test_reads_no_held_out_label(spark, labelled):
    rows, labels = labelled
    changed = [(k, 1 - q if zlib.crc32(str(k).encode()) % 3 == 1 else q, t) for k, q, t in labels]
    a, b = ({r.doc_id: r.score for r in scored(spark, rows, x, epochs=2)} for x in (labels, changed))
    assert a == pytest.approx(b, abs=2e-6)


def test_without_labels_or_documents(spark, labelled):
    rows, labels = labelled
    assert {r.score for r in scored(spark, rows, [])} == {0.5}
    ones = [(k, 1, 0) for k, _, _ in labels]
    assert {r.predicted for r in scored(spark, rows, ones)} == {1}
    assert scored(spark, [], labels) == [] and scored(spark, [], []) == []


def test_sample_is_bounded(spark, labelled):
    rows, labels = labelled
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    d = docs(spark, [*rows, (0, "x" * 40_000)])
    assert 20 <= byte_quality.training_rows(d, lab, max_labelled=40).count() <= 65
    assert all(len(r.text) <= 32_768 for r in byte_quality.training_rows(d, lab).collect())


def test_query_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality")
    rows = byte_quality.query(spark, sf).where("held_out").join(labels, "doc_id").collect()
    rank = np.argsort(np.argsort([r.score for r in rows]))
    good, kept = np.array([r.quality == 1 for r in rows]), np.array([r.predicted == 1 for r in rows])
    area = (rank[good].sum() - good.sum() * (good.sum() - 1) / 2) / (good.sum() * (~good).sum())
    assert area > 0.99 and kept[good].mean() > 0.99 and kept[~good].mean() < 0.1
