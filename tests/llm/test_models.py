"""Toxicity, language-model scores and embeddings."""

import collections
import math
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from corvane.llm import embeddings, network, scoring, toxicity
from corvane.llm.common import number_rows
from tests.llm.helpers import docs, with_clashes


@pytest.fixture(scope="module")
def toxic(spark):
    rng = np.random.default_rng(2)
    plain = [f"w{i}" for i in range(400)]
    rows, labels = [], []
    for i in range(600):
        w = rng.choice(plain, 60).tolist()
        bad = i % 8 == 0
        if bad:
            for _ in range(4):
                w[rng.integers(60)] = str(rng.choice(["idiot", "scum", "Zorgle" + "abcdef"[rng.integers(6)], "worthless"]))
        rows.append((i, " ".join(w)))
        if i % 5:
            labels.append((i, 1, int(bad)))
    rows += [(1000, ""), (1001, None), (1002, "word " * 20000), (0, rows[0][1]), (None, "you are an idiot and a loser")]
    return rows, labels


def scored(spark, rows, labels):
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    return toxicity.score(with_clashes(docs(spark, rows)), lab).collect()


def test_toxicity_on_held_out_rows(spark, toxic):
    rows, labels = toxic
    got = scored(spark, rows, labels)
    assert len(got) == len(rows) and all(0 <= r.score <= 1 for r in got)
    truth = {k: t for k, _, t in labels}
    held = [r for r in got if r.held_out and r.doc_id in truth]
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got if r.doc_id is not None)
    assert held and np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.97
    assert {r.predicted for r in got if r.doc_id in (1000, 1001, 1002)} == {0} and [r.predicted for r in got if r.doc_id is None] == [1]


def test_toxicity_row_by_row(spark, toxic):
    """A toxic row takes no clean row of the same doc_id, or of none, with it."""
    rows, labels = toxic
    bad, clean = rows[0][1], rows[1][1]
    plain = [(k, t) for k, t in (r[:2] for r in rows) if k is not None]
    more = [(None, bad), (None, clean), (None, clean + " one"), (5000, bad), (5000, clean + " two")]
    label_rows = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    kept = toxicity.remove_toxic(docs(spark, plain + more), label_rows).collect()
    assert sorted(r.text for r in kept if r.doc_id is None) == sorted([clean, clean + " one"])
    assert [r.text for r in kept if r.doc_id == 5000] == [clean + " two"]


def test_toxicity_reads_no_held_out_label(spark, toxic):
    rows, labels = toxic
    changed = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 4 == 2 else t) for k, q, t in labels]
    a, b = ({r.doc_id: r.score for r in scored(spark, rows, x)} for x in (labels, changed))
    assert a == pytest.approx(b)


def test_toxicity_without_labels(spark):
    got = scored(spark, [(1, "you are an idiot, scum and trash"), (2, "a b c"), (3, "d e f")], [])
    assert len(got) == 3 and all(0 <= r.score <= 1 for r in got)
    assert scored(spark, [], []) == []


def test_toxicity_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic")
    rows = toxicity.query(spark, sf).where("held_out").join(labels, "doc_id").select("score", "toxic", "predicted").collect()
    rank = np.argsort(np.argsort([r.score for r in rows]))
    bad = np.array([r.toxic == 1 for r in rows])
    area = (rank[bad].sum() - bad.sum() * (bad.sum() - 1) / 2) / (bad.sum() * (~bad).sum())
    hit = np.array([r.predicted == 1 for r in rows])
    assert area > 0.95 and hit[bad].mean() > 0.8 and hit[~bad].mean() < 0.02


def test_label_model_finds_accuracies_and_correlation():
    rng = np.random.default_rng(0)
    y = rng.random(40000) < 0.15
    fires = np.array([[0.02, 0.7], [0.05, 0.6], [0.01, 0.5], [0.03, 0.55], [0.5, 0.5]])
    votes = rng.random((len(y), 5)) < fires[:, y.astype(int)].T
    votes = np.hstack([votes[:, :4], votes[:, 3:4] ^ (rng.random((len(y), 1)) < 0.01), votes[:, 4:]])
    patterns, n = np.unique(votes, axis=0, return_counts=True)
    m = toxicity.fit_label_model(patterns, n.astype(float))
    assert m["fires"][1][:3] == pytest.approx(fires[:3, 1], abs=0.15) and float(m["prior"]) == pytest.approx(0.15, abs=0.03)
    assert m["accuracy"][5] < 0.1 < 0.5 < m["accuracy"][0]
    assert m["correlation"].argmax() in (3 * 6 + 4, 4 * 6 + 3) and m["weight"][3] < 0.85 < m["weight"][0]


def test_gradient_of_one_step():
    """Against central differences in double precision, and one Adagrad step written out."""
    rng = np.random.default_rng(4)
    net = network.Network(3, rng.normal(0, 0.3, len(network.Network(3).flat)))
    target, around = rng.integers(27, size=9).astype(np.uint16), rng.integers(28, size=(9, 4)).astype(np.uint16)

    def loss(flat):
        w, total = network.Network(3, flat), 0.0
        for t, x in zip(target.tolist(), around.tolist(), strict=True):
            h = np.append(np.tanh(sum(w.context[j][c] for j, c in enumerate(x)) + w.bias), 1)
            for level, node, branch in ((w.first, 0, t // 9), (w.second, t // 9, t // 3 % 3), (w.third, t // 3, t % 3)):
                z = h @ level[node]
                total -= z[branch] - math.log(np.exp(z).sum())
        return total

    grad = net.gradient(target, around)
    for i in rng.permutation(len(grad))[:150]:
        up, down = net.flat.copy(), net.flat.copy()
        up[i] += 1e-5
        down[i] -= 1e-5
        assert grad[i] == pytest.approx((loss(up) - loss(down)) / 2e-5, abs=1e-3)
    start, squares = net.flat.copy(), np.zeros_like(net.flat)
    net.train(squares, target, around)
    step = grad / 3
    assert np.allclose(net.flat, start - 0.1 * step / np.sqrt(step**2 + 1e-6), atol=1e-4)


def sentences(rng, n):
    """Numbered texts whose words follow from those around them, and some words that few texts have."""
    out = []
    for i in range(n):
        at = int(rng.integers(6))
        words = [["the", "cat", "sat", "on", "a", "mat"][(at + j) % 6] for j in range(int(rng.integers(5, 60)))]
        words.insert(2, f"w{rng.integers(90)}x")
        out.append((i, " ".join(words)))
    return out


def test_scores_like_one_process(spark):
    rng = np.random.default_rng(1)
    rows = sentences(rng, 80)
    rows += [(100, ""), (101, None), (102, "The cat " * 20000), (5, rows[5][1]), (5, rows[5][1]), (None, "cat the\nZugg"), (None, "mat"), (103, "  two  spaces\n\nà")]
    df = with_clashes(docs(spark, rows))
    v = scoring.vocabulary(scoring.word_counts(df), branches=5)
    assert len(v.known) <= 125 - scoring.ENDINGS and set(v.known[:2]) == {"cat", "the"}
    numbered = number_rows(df.select("doc_id", F.lower("text").alias("text")), "row")
    packed = scoring.shards(numbered, v, 5000)
    assert packed.count() > 1
    flat = scoring.fit(packed, v)
    got = sorted(((r.doc_id, r.n_tokens, r.log_prob, r.mean_log_prob) for r in scoring.fit_and_score(df, branches=5, shard_words=5000).collect()), key=str)
    w = network.Network(5, flat)
    number = {x: i for i, x in enumerate(v.known)}
    texts = [(k, [x for x in (t or "").lower().replace("\n", " ").split(" ") if x]) for k, t in rows]
    total = collections.Counter(x for _, t in texts for x in t)
    assert sum(total.values()) == v.words
    rest = {x: n for x, n in total.items() if x not in number}
    letters = np.bincount(np.frombuffer("".join(rest).encode(), np.uint8), minlength=256)
    letters = (np.append(letters, len(rest)) + 0.5) / (letters.sum() + len(rest) + 257 / 2)
    novel = max(1.0, sum(n == 1 for n in rest.values()) / scoring.ENDINGS)

    def ending(x):
        x = x.encode()
        return (x[-1] * 29 + (x[-2] if len(x) > 1 else 0)) % scoring.ENDINGS

    want = []
    for k, t in texts:
        ids = [number[x] if x in number else 125 - scoring.ENDINGS + ending(x) for x in t]
        own, score = collections.Counter(t), 0.0
        if len(t) > 1000:
            ids = ids[:0]
        for i, x in enumerate(ids):
            around = [ids[i + d] if 0 <= i + d < len(ids) else 125 for d in (-2, -1, 1, 2)]
            h = np.append(np.tanh(sum(w.context[j][c] for j, c in enumerate(around)) + w.bias), 1)
            for level, node, branch in ((w.first, 0, x // 25), (w.second, x // 25, x // 5 % 5), (w.third, x // 5, x % 5)):
                z = h @ level[node]
                score += z[branch] - math.log(np.exp(z).sum())
            if t[i] in rest:
                of = sum(n - own[y] for y, n in rest.items() if ending(y) == ending(t[i]))
                spelled = math.prod(letters[b] for b in t[i].encode()) * letters[256]
                score += math.log((rest[t[i]] - own[t[i]] + novel * spelled) / (of + novel))
        want.append((k, len(t), score if len(t) < 1000 else None, score / len(t) if t else None))
    for a, b in zip(got, sorted(want, key=str), strict=True):
        assert a[:2] == b[:2] and (a[3] is None) == (b[1] == 0)
        if b[2] is not None:
            assert a[2] == pytest.approx(b[2], abs=2e-2)


def test_scores_do_not_follow_the_layout(spark):
    rows = sentences(np.random.default_rng(5), 300) + [(7, "cat the"), (None, "cat"), (None, "the")]
    found = []
    for parts in (1, 7):
        got = scoring.fit_and_score(docs(spark, rows).repartition(parts), shard_words=2000).collect()
        found.append(np.array(sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.log_prob) for r in got)))
    assert np.allclose(found[0], found[1], rtol=1e-5)


def test_held_out_loss_falls_with_rounds(spark):
    rng = np.random.default_rng(6)
    df, fresh = docs(spark, sentences(rng, 300)), sentences(rng, 60)
    v = scoring.vocabulary(scoring.word_counts(df), branches=5)
    packed = scoring.shards(number_rows(df.select("doc_id", "text"), "row"), v, 3000)
    _, sizes, leaf, _ = scoring.Words(v).cut(pa.array([t for _, t in fresh]))
    target, around = network.windows(np.split(leaf, np.cumsum(sizes)[:-1]), v.pad)
    loss = [-network.Network(5, scoring.fit(packed, v, rounds)).log_probabilities(target, around).mean() for rounds in (0, 1, 2, 4)]
    assert loss[0] > loss[1] + 0.3 and loss[1] > loss[2] > loss[3]
    target, around = network.windows([rng.permutation(x) for x in np.split(leaf, np.cumsum(sizes)[:-1])], v.pad)
    assert -network.Network(5, scoring.fit(packed, v, 4)).log_probabilities(target, around).mean() > loss[3]


def test_more_leaves_than_16_bits_count(spark):
    """41 branches are 68,921 leaves, so ids take four bytes."""
    target, around = network.windows([np.array([70_000 % 68_921, 68_000], np.uint32), np.array([5], np.uint32)], 68_921)
    assert target.tolist() == [1079, 68_000, 5] and around[0].tolist() == [68_921, 68_921, 68_000, 68_921]
    rows = sentences(np.random.default_rng(8), 30)
    got = scoring.fit_and_score(docs(spark, rows), rounds=1, branches=41).collect()
    assert len(got) == len(rows) and all(r.log_prob < 0 for r in got if r.n_tokens)


def test_average_of_shards(spark):
    """The streamed mean of the shards' networks is the mean by their words."""
    rng = np.random.default_rng(9)
    df = docs(spark, sentences(rng, 120))
    v = scoring.vocabulary(scoring.word_counts(df), branches=5)
    packed = scoring.shards(number_rows(df.select("doc_id", "text"), "row"), v, 300)
    total, seen = 0.0, 0
    for r in packed.orderBy("shard", "part").toArrow().to_batches():
        for i in range(r.num_rows):
            net, n = network.Network(v.branches, network.Network.initial(v.branches).flat.copy()), 0
            squares = np.zeros_like(net.flat)
            for _, ids in scoring._documents(r.slice(i, 1), v):
                t, c = network.windows(ids, v.pad)
                net.train(squares, t, c)
                n += len(t)
            total, seen = total + n * net.flat.astype(np.float64), seen + n
    assert packed.count() > 3
    assert np.allclose(scoring.fit(packed, v, 1), total / seen, atol=1e-5)


def test_texts_that_occur_twice_score_higher(spark):
    """No text is evidence for itself: what one text alone has is told from what two have."""
    rng = np.random.default_rng(7)
    texts = [" ".join("".join(rng.choice(list("abcdefgh"), 7)) for _ in range(30)) for _ in range(40)]
    rows = list(enumerate(texts + texts[:10]))
    got = {r.doc_id: r.mean_log_prob for r in scoring.fit_and_score(docs(spark, rows)).collect()}
    twice = {*range(10), *range(40, 50)}
    assert min(got[i] for i in twice) > max(got[i] for i in set(got) - twice) + 1


def test_scores_of_nothing(spark):
    assert scoring.fit_and_score(docs(spark, [])).collect() == []
    got = scoring.fit_and_score(docs(spark, [(1, None), (2, " \n")])).collect()
    assert sorted((r.doc_id, r.n_tokens, r.log_prob, r.mean_log_prob) for r in got) == [(1, 0, 0.0, None), (2, 0, 0.0, None)]


def test_query_of_scores(spark):
    got = scoring.query(spark, "/root/testdata/sf0.001")
    assert got.columns == ["doc_id", "n_tokens", "log_prob", "mean_log_prob"]
    rows = got.collect()
    assert len({r.doc_id for r in rows}) == len(rows) == 200 and all(r.log_prob < 0 for r in rows if r.n_tokens)


def cosine_links(rows, least=0.93):
    ok = {}
    for i, (_, v, label) in enumerate(rows):
        if label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            ok[i] = np.array(v, float) / np.linalg.norm(v)
    return [(i, j) for i in ok for j in ok if i < j and rows[i][2] == rows[j][2] and len(rows[i][1]) == len(rows[j][1]) and ok[i] @ ok[j] >= least]


def test_embeddings_like_brute_force(spark):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(60):
        b = rng.normal(size=64)
        b /= np.linalg.norm(b)
        rows.append((len(rows), b.tolist(), i % 3))
        for _ in range(3):
            v = rng.normal(size=64)
            v -= (v @ b) * b
            c = rng.uniform(0.9, 0.96)
            rows.append((len(rows), (5 * (c * b + math.sqrt(1 - c * c) * v / np.linalg.norm(v))).tolist(), i % 3))
    hot = rng.normal(size=64)
    rows += [(len(rows) + i, (hot + 0.02 * rng.normal(size=64)).tolist(), 1) for i in range(90)]
    rows += [(5000 + i, hot.tolist(), 1) for i in range(20)]
    rows += [(6000, None, 1), (6001, [0.0] * 64, 1), (6002, [float("nan")] * 64, 1), (6003, [None] * 64, 1), (6004, [], 1), (6005, hot.tolist(), None), (6006, hot[:32].tolist(), 1), (6007, [float("inf")] * 64, 1)]
    df = with_clashes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    linked = cosine_links(rows)
    n, up = dict.fromkeys(range(len(rows)), 0), list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, j in linked:
        n[i] += 1
        n[j] += 1
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    for block in (512, 16):
        got = {r.vec_id: r for r in embeddings.near_duplicates(df, block=block).collect()}
        assert len(got) == len(rows)
        counts = np.array([got[rows[i][0]].n_links for i in n])
        assert (counts <= np.array(list(n.values()))).all() and counts.sum() >= 0.99 * sum(n.values())
        same = [got[rows[i][0]].component_id == rows[find(i)][0] for i in n]
        assert np.mean(same) > 0.98
        assert all(r.kept == (r.vec_id == r.component_id) for r in got.values())
        assert all(got[k].n_links == 0 and got[k].kept for k in range(6000, 6008))


@pytest.mark.parametrize("functions", [1, 2, 3])
def test_tables_hold_recall(spark, functions):
    rng = np.random.default_rng(functions)
    a = embeddings.unit(rng.normal(size=(400, 64)))
    v = rng.normal(size=a.shape)
    v -= (v * a).sum(1, keepdims=True) * a
    b = 0.932 * a + math.sqrt(1 - 0.932**2) * embeddings.unit(v)
    rows = [(i, x.tolist(), "one label") for i, x in enumerate(np.concatenate([a, b]))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: r for r in embeddings.near_duplicates(df, functions=functions).collect()}
    assert np.mean([got[i].component_id == got[400 + i].component_id for i in range(400)]) >= 0.99
    assert sum(r.n_links for r in got.values()) >= 2 * 0.99 * 400


def test_query_of_embeddings(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    n = collections.Counter(rows[k][0] for pair in cosine_links(rows) for k in pair)
    got = {r.vec_id: r.n_links for r in embeddings.query(spark, sf).collect()}
    assert got == {k: n[k] for k, _, _ in rows}


def test_embeddings_of_nothing(spark):
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).collect() == []


def test_hadamard_keeps_lengths():
    x = embeddings.unit(np.random.default_rng(0).normal(size=(5, 64)))
    y = embeddings.rotations(x, 1, 2)
    assert np.allclose((y * y).sum(2), 1) and np.allclose(y[0] @ y[0].T, x @ x.T)


def test_held_out_is_crc32(spark):
    df = spark.range(50).select(F.col("id").alias("doc_id"))
    assert all(r.h == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in df.select("doc_id", toxicity.held_out().alias("h")).collect())
