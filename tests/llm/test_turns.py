"""The conversation trie against brute force."""

import collections
import hashlib
import random
import zlib

import duckdb
import numpy as np
import pytest

from corvane.llm import turns
from tests.llm.helpers import with_clashes
from tests.oracle import same_rows

SCHEMA = "conv_id long, turn long, role string, text string"


def brute(rows):
    """Nodes of the rebuilt conversations of rows, by their definition."""
    own = collections.defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()[:32]
            own[c].append((t is not None, t or 0, digest, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    seqs = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        seqs[c] = tuple(own.get(c - c % 100, [])[:h] + v[h:])
    members = collections.defaultdict(list)
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
    kids = collections.Counter(s[:-1] for s in members if s)
    leaves, saved = collections.Counter(), collections.Counter()
    for s, m in members.items():
        for d in range(len(s) + 1):
            leaves[s[:d]] += not kids[s]
            saved[s[:d]] += (len(m) - 1) * len(s[-1][1]) if s else 0
    out = []
    for s, m in members.items():
        ends = ",".join(str(c) for c in sorted(m) if len(seqs[c]) == len(s))
        up = min(members[s[:-1]]) if s else None
        out.append((min(m), len(s), up, len(m), kids[s], leaves[s], saved[s], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def talks(seed, n=400, most=9):
    rng = random.Random(seed)
    rows = []
    for c in range(n):
        if rng.random() < 0.1:
            continue
        rows += [(c, t, rng.choice(["user", "assistant", None]), rng.choice(["a", "bc", "é𝄞", "", None])) for t in range(rng.randrange(1, most))]
    return rows


CASES = {
    "random": talks(1),
    "hot": [(c, t, "user", f"same {t}") for c in range(300) for t in range(4)] + talks(2, 60),
    "long": [(c, t, "user", f"t{t}" if t < 900 else f"t{t} {c % 3}") for c in (7, 8, 9, 1000, 1001) for t in range(1000)],
    "edges": [(5, None, None, None), (5, None, "user", "x"), (5, 1, "user", "x"), (5, 1, "user", "x"), (None, 0, "user", "x"), (105, 0, "a", ""), (3, 0, "", "a"), (10**12, 2, "user", "z")],
    "prefixes": [(100 * c, t, "u", "x") for c in range(40) for t in range(c % 13)],
}


@pytest.mark.parametrize("name, run_rows, range_bytes", [*((n, 7, 300) for n in CASES), ("random", 50_000, 32_000_000), ("edges", 1, 1)])
def test_like_brute_force(spark, name, run_rows, range_bytes):
    rows = CASES[name]
    df = with_clashes(spark.createDataFrame(rows, SCHEMA)).repartition(3)
    got = turns.trie(turns.rebuilt(df), run_rows, range_bytes).drop("key", "up").collect()
    assert sorted((tuple(r) for r in got), key=str) == brute(rows)


def test_many_ranges_are_used(spark):
    df = spark.createDataFrame(talks(3), SCHEMA)
    runs = turns.sorted_runs(turns.rebuilt(df), 20)
    cuts = turns.splitters(runs, 500)
    assert len(cuts) > 20 and cuts == sorted(set(cuts))


def test_without_conversations(spark):
    assert turns.trie(turns.rebuilt(spark.createDataFrame([], SCHEMA))).count() == 0


def test_loser_tree_merges_and_compares_little():
    """Outputs are sorted with right LCPs; shared turns are compared once a run at most."""
    rng = np.random.default_rng(5)
    stem = bytes(50 * turns.TURN)
    runs = []
    for _ in range(9):
        seqs = sorted(stem + rng.integers(3, size=int(rng.integers(0, 6)), dtype=np.uint8).repeat(turns.TURN).tobytes() for _ in range(40))
        runs.append([(s, turns.common_turns(seqs[i - 1], s) if i else 0, None) for i, s in enumerate(seqs)])
    tree = turns.LoserTree(runs)
    got = [(p, h) for p, h, _ in tree]
    assert [p for p, _ in got] == sorted(s for r in runs for s, _, _ in r)
    assert all(h == turns.common_turns(a, b) for (a, _), (b, h) in zip(got, got[1:], strict=False))
    assert tree.compared < 9 * 50 + 360 * 8
    assert list(turns.LoserTree([])) == [] and list(turns.LoserTree([[], [(b"", 0, 1)], []])) == [(b"", 0, 1)]


def test_query_like_sql(spark):
    same_rows(spark, "/root/testdata/sf0.001", turns.query, turns.ORACLE)


def test_sql_has_crc32():
    for c in (0, 7, 123456, 9999999):
        assert duckdb.sql(f"SELECT {turns._CRC} FROM (SELECT {c} AS conv_id)").fetchall() == [(zlib.crc32(str(c).encode()),)]
