"""Removal of repeated strings against a plain loop."""

import random

import numpy as np
import pyarrow as pa
import pytest

from corvane.llm import phrases, suffixes
from tests.llm.helpers import docs, with_clashes


def brute(rows, length):
    seen, out = set(), {}
    for k, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        raw = (text or "").encode()
        gone = bytearray(len(raw))
        for p in range(len(raw) - length + 1):
            s = raw[p : p + length]
            if s in seen:
                gone[p : p + length] = b"\1" * length
            seen.add(s)
        out.setdefault(k, []).append(bytes(x for x, g in zip(raw, gone, strict=True) if not g))
    return out


def words(rng, n):
    return " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "ünïcode", "the", "of", "a"]) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    shared, other = words(rng, 40), words(rng, 60)
    out = [(i, words(rng, rng.randrange(0, 80))) for i in range(30)]
    out += [(100 + i, words(rng, 5) + shared + words(rng, 5)) for i in range(12)]
    out += [(200, other), (201, other), (202, other[37:]), (203, "x" * 99), (204, "x" * 100), (205, "x" * 5000), (206, ""), (207, None)]
    out += [(208, (other + " ") * 3), (209, words(rng, 30000)), (210, words(rng, 3)), (None, other[:200])]
    return out


@pytest.mark.parametrize("crowd", [2000, 1])
def test_like_a_loop(spark, rows, crowd):
    want = brute(rows, 100)
    got = suffixes.remove_repeats(with_clashes(docs(spark, rows)).repartition(5), crowd=crowd).collect()
    assert len(got) == len(rows)
    for r in got:
        assert bytes(r.kept) == want[r.doc_id][0], r.doc_id
        assert r.n_bytes - sum(s.end - s.start for s in r.spans) == len(r.kept)


class OneHash:
    """Gives every string the same hash."""

    def __init__(self, data):
        pass

    def of(self, a, b):
        return np.full(len(a), 7, np.uint64)


def test_bytes_decide_where_hashes_collide():
    rng = random.Random(3)
    texts = [words(rng, 30), words(rng, 30)]
    texts += [texts[0][:150], texts[1]]
    wanted = [[{"start": 0, "n": len(t.encode()) - 99, "anchor": 5, "crowded": True}] for t in texts]
    for slices in ([[0, 1, 2, 3]], [[0, 1], [2], [3]]):
        batches = [pa.RecordBatch.from_pylist([{"row": i, "doc": i, "text": texts[i], "wanted": wanted[i]} for i in part]) for part in slices]
        fetched = sorted((x for b in suffixes._fetch(batches, 100, OneHash) for x in b.to_pylist()), key=lambda r: r["key"])
        schema = pa.schema([("key", pa.int64()), ("row", pa.int64()), ("doc", pa.int64()), ("start", pa.int32()), ("n", pa.int32()), ("text", pa.binary())])
        gone = {i: bytearray(len(t.encode())) for i, t in enumerate(texts)}
        for b in suffixes._sort_suffixes([pa.RecordBatch.from_pylist(fetched, schema)], 100):
            for r in b.to_pylist():
                gone[r["row"]][r["start"] : r["end"]] = b"\1" * (r["end"] - r["start"])
        want = brute(list(enumerate(texts)), 100)
        for i, t in enumerate(texts):
            assert bytes(x for x, g in zip(t.encode(), gone[i], strict=True) if not g) == want[i][0]


def test_query(spark):
    import hashlib

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    want = brute(rows, 100)
    got = {r.doc_id: r for r in suffixes.query(spark, sf).collect()}
    assert len(got) == len(rows)
    for k, text in rows:
        raw, r = (text or "").encode(), got[k]
        assert (r.n_bytes, r.n_removed, r.kept_sha256) == (len(raw), len(raw) - len(want[k][0]), hashlib.sha256(want[k][0]).hexdigest())
        assert (r.n_spans > 0) == (r.n_removed > 0)


def test_repeated_rows(spark):
    text = "some text that is repeated " * 6
    got = suffixes.remove_repeats(docs(spark, [(1, text), (1, text)]).coalesce(1)).collect()
    assert sorted(len(r.kept) for r in got)[0] == 0 and len(got) == 2


def test_empty_table(spark):
    assert suffixes.remove_repeats(docs(spark, [])).collect() == []


def test_texts_longer_than_a_buffer(spark, monkeypatch):
    """Cut into pieces, the phrases differ but what is repeated does not."""
    import numpy as np
    import pyarrow as pa

    rng = random.Random(6)
    text = words(rng, 2000)
    batch = pa.RecordBatch.from_arrays([pa.array([text, text[500:4000]])], ["text"])
    monkeypatch.setattr(suffixes, "MAX_BUFFER", 4096)
    found = []
    for data, ends, of, at in suffixes._buffers(batch, 100):
        e = phrases.parse(data, ends, 100)
        begins = np.concatenate([[0], ends[:-1]])
        found += [(int(of[d]), int(s - begins[d] + at[d]), int(n)) for d, s, n in zip(e["doc"], e["start"], e["n"], strict=True)]
    for i, t in enumerate((text, text[500:4000])):
        starts = sorted(p for d, s, n in found if d == i for p in range(s, s + n))
        assert starts == list(range(len(t.encode()) - 99))


def test_rows_keep_their_numbers(spark, rows, tmp_path):
    """The input's splits may change between the jobs, as they do where executors come or go."""
    want = brute(rows, 100)
    docs(spark, rows).repartition(7).write.parquet(str(tmp_path / "d"))
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    found = suffixes.remove_repeats(spark.read.parquet(str(tmp_path / "d")))
    try:
        spark.conf.set(key, "2k")
        got = found.collect()
    finally:
        spark.conf.set(key, before)
    assert len(got) == len(rows)
    assert all(bytes(r.kept) == want[r.doc_id][0] for r in got)
