"""Decontamination, line dedup, SimHash and the pipeline's stages against brute force."""

import random
import re

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from corvane.llm import decontamination, lines, registry, simhash, similar
from corvane.llm.common import components
from tests.llm.helpers import docs, with_clashes
from tests.oracle import same_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words_of(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def spots(words, window):
    return [i for i in range(len(words) - len(window) + 1) if words[i : i + len(window)] == window]


@pytest.fixture(scope="module")
def case():
    rng = random.Random(3)

    def some(n):
        return " ".join(rng.choice("the of and Élan x1 zeta ÄB kappa".split()) for _ in range(n))

    items = [(1, some(25)), (2, "Short one, here"), (3, ""), (4, None), (5, "the the the the the the the the the the the the"), (6, "nowhere word"), (7, some(12)), (8, "solo")]
    rows = [(i, some(rng.randrange(0, 120))) for i in range(20)]
    rows += [(30, f"pre {items[0][1]} post"), (31, items[0][1][20:].upper()), (32, "a short ONE. here b"), (33, ""), (34, None), (35, "the " * 60), (36, "x SOLO y solo"), (37, "...")]
    rows += [(38, f"{items[6][1]} and {items[6][1]}"), (None, "solo"), (30, "solo twice solo")]
    return rows, items


def test_decontamination_like_a_loop(spark, case):
    rows, items = case
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontamination.report(with_clashes(docs(spark, rows)), bench).collect()
    assert len(got) == len(rows)
    left = list(got)
    for k, text in rows:
        w = words_of(text)
        hit, held = set(), set()
        for i, t in items:
            b = words_of(t)
            for a in range(max(len(b) - 9, 1)) if b else []:
                for p in spots(w, b[a : a + 10]):
                    held.add(str(i))
                    hit.update(range(p, p + len(b[a : a + 10])))
        match = [r for r in left if (r.doc_id, r.n_words, r.n_hit, r.n_items, r.contaminated) == (k, len(w), len(hit), len(held), bool(hit))]
        assert match, (k, len(w), len(hit), sorted(held))
        left.remove(match[0])
    kept = decontamination.remove_contaminated(docs(spark, rows), bench)
    assert kept.columns == docs(spark, rows).columns and {r.doc_id for r in kept.collect()} >= {33, 34, 37}


def test_decontamination_row_by_row(spark):
    bench = spark.createDataFrame([(1, "solo")], "item_id long, text string")
    rows = [(None, "solo here"), (None, "clean a"), (None, "clean b"), (7, "solo twice"), (7, "clean c"), (8, "clean d")]
    kept = decontamination.remove_contaminated(docs(spark, rows), bench).collect()
    assert sorted(r.text for r in kept) == ["clean a", "clean b", "clean c", "clean d"]


def test_proximity(spark):
    bench = spark.createDataFrame([(1, "red green blue")], "item_id long, text string")
    rows = [(1, "blue x x red y green"), (2, "red " + "x " * 20 + "green blue"), (3, "green blue"), (4, "red green blue")]
    got = decontamination.proximity_matches(docs(spark, rows), bench, slop=5).collect()
    assert {r.doc_id for r in got} == {1, 4}


def test_decontamination_without_broadcasts(spark, case, monkeypatch):
    """A benchmark too large to send is joined; the result is the same."""
    rows, bench = case if len(case) == 2 else case[:2]
    a, b = docs(spark, rows), spark.createDataFrame(bench, "item_id long, text string")
    sent = sorted(map(str, decontamination.report(a, b, 10).drop("row").collect()))
    monkeypatch.setattr(decontamination, "BROADCAST_TERMS", 1)
    monkeypatch.setattr(decontamination, "BROADCAST_WINDOWS", 1)
    assert sorted(map(str, decontamination.report(a, b, 10).drop("row").collect())) == sent and len(sent) == len(rows)


def test_decontamination_of_nothing(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert [r.n_hit for r in decontamination.report(docs(spark, [(1, "a b")]), bench).collect()] == [0]
    assert decontamination.report(docs(spark, []), bench).collect() == []


def test_lines_like_a_loop(spark):
    rows = [(i, f"Title {i}\n  Footer line \nbody {i % 2}\n\nFooter line", f"s{i % 6}") for i in range(12)]
    rows += [(20, None, None), (21, "", "s1"), (22, "only body 0", None), (23, "body 0", None), (None, "Footer line", "s9"), (0, "Footer line", "s0")]
    got = lines.remove_boilerplate(with_clashes(docs(spark, rows)), min_sites=4).collect()
    sites, first = {}, {}
    for k, t, s in rows:
        for line in t.split("\n") if t is not None else []:
            if line.strip(" "):
                sites.setdefault(line.strip(" "), set()).add(s)
                if k is not None:
                    first[line.strip(" ")] = min(first.get(line.strip(" "), k), k)
    spread = {x for x, s in sites.items() if len(s) >= 4}
    assert spread == {"Footer line", "body 0"} or spread == {"Footer line"}
    want = []
    for k, t, _ in rows:
        kept, seen = [], set()
        for line in t.split("\n") if t is not None else []:
            x = line.strip(" ")
            if x not in spread or (first[x] == k and x not in seen):
                kept.append(line)
            seen.add(x)
        want.append((k, None if t is None else "\n".join(kept)))
    assert sorted(((r.doc_id, r.text) for r in got), key=str) == sorted(want, key=str)
    assert lines.remove_boilerplate(docs(spark, [])).collect() == []


def test_near_threshold_lines_are_counted(spark):
    """Spreads on either side of the threshold are told apart exactly."""
    rows = [(100 * n + i, f"line {n}", f"s{i}") for n in range(45, 56) for i in range(n)]
    got = lines.remove_boilerplate(docs(spark, rows), min_sites=50).where("_removed > 0").select("doc_id").collect()
    assert {r.doc_id // 100 for r in got} == set(range(50, 56))


def fingerprint(text):
    w = re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    w = [x for x in w if x]
    hashes = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(ids, linked):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in linked:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_simhash_like_a_loop(spark):
    rng = random.Random(9)
    base = [str(rng.randrange(500)) for _ in range(400)]
    rows = [(0, None), (1, ""), (2, " \t"), (3, "one"), (4, "one two"), (5, "A b\vc d"), (6, "a B c\fd"), (7, "x\u00a0y z w"), (8, "é " * 5)]
    for i in range(60):
        w = list(base)
        for _ in range(i % 9):
            w[rng.randrange(len(w))] = "new"
        rows.append((100 + i, " ".join(w)))
    rows += [(300, " ".join(base * 20)), (301, " ".join(base))]
    prints = {k: fingerprint(t) for k, t in rows}
    want = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    for most in (64, 3):
        got = {r.doc_id: (r.fp & (2**64 - 1), r.component_id) for r in simhash.near_duplicates(with_clashes(docs(spark, rows)), max_cell=most).collect()}
        assert got == {k: (prints[k], want[k]) for k in prints}


def test_simhash_repeated_ids(spark):
    rows = [(5, "one two three four"), (5, "wholly other words here"), (9, "one two three four"), (None, "wholly other words here"), (7, "alone it stands now")]
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(docs(spark, rows)).collect()), key=str)
    assert got == [(5, 5), (5, 5), (7, 7), (9, 5), (None, 5)]
    assert simhash.near_duplicates(docs(spark, [])).collect() == []


def test_links_on_random_bits(spark):
    rng = random.Random(4)
    centre = rng.getrandbits(63)
    values = {centre} | {centre ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for _ in range(150)} | {rng.getrandbits(63) for _ in range(300)}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    want = roots(values, [(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2])
    for most in (1000, 5):
        found = {r.node: r.component for r in components(simhash.links(df, max_cell=most)).collect()}
        assert {v: found.get(v, v) for v in values} == want


def test_pivots_discard_pairs(spark):
    """Unequal fingerprints share cells; coordinates discard most of those pairs, bits the rest, and no link is lost."""
    rng = random.Random(8)
    values = {rng.getrandbits(63) & ~0xFFFF_FFFF | rng.getrandbits(8) for _ in range(3000)}
    values |= {v ^ (1 << rng.randrange(63)) ^ (1 << rng.randrange(63)) for v in list(values)[:200]}
    df = spark.createDataFrame([(v,) for v in values], "fp long")
    table = simhash.pivot_table(df, 6, 7).collect()
    base, *others = simhash.references(6, 7)
    assert len(others) == 31 and all([(r.fp ^ p).bit_count() for p in (base, *others)] == list(r.dist) for r in table[:50])
    assert len({tuple(r.cell_2) for r in table}) < len({r.fp >> 32 & 0xFFFF for r in table})
    met = simhash._cells(df, 6, 7)
    pairs = simhash.candidates(met, met.groupBy("cell").count().where("count > 1"), 1000).distinct().collect()
    passed = [r for r in pairs if r.gap <= 2]
    near = {(r.a, r.b) for r in passed if r.bits <= 2}
    assert len(pairs) > 5 * len(passed) > 0 and all(r.gap <= r.bits for r in pairs)
    values = sorted(values)
    assert near == {(a, b) for i, a in enumerate(values) for b in values[i + 1 :] if (a ^ b).bit_count() <= 2}


def test_query_of_fingerprints(spark):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    prints = {r.doc_id: fingerprint(r.text) for r in rows}
    want = roots(prints, [(a, b) for a in prints for b in prints if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.query(spark, sf).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((k, f"{v:016x}", want[k]) for k, v in prints.items())


def jaccard(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if (w := (t or "").lower().split()) else {()} for t in (a, b))
    return len(a & b) / len(a | b)


def test_similar_texts_like_brute_force(spark):
    rng = random.Random(12)
    rows = []
    for g in range(40):
        base = [f"w{rng.randrange(3000)}" for _ in range(250)]
        for edits in (0, 1, 2, 3, 12):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = f"x{rng.randrange(3000)}"
            rows.append((len(rows), " ".join(w)))
    base = [f"y{i}" for i in range(300)]
    for i in range(300):  # a dense group
        w = list(base)
        for _ in range(i % 5):
            w[rng.randrange(len(w))] = f"z{rng.randrange(3000)}"
        rows.append((len(rows), " ".join(w)))
    rows += [(900, ""), (901, None), (902, "one"), (903, "One"), (3, rows[3][1]), (None, rows[40][1]), (None, "no other text is like this one"), (904, "long " * 30000)]
    pairs = [(i, j, jaccard(rows[i][1], rows[j][1])) for i in range(200) for j in range(i)]
    for most in (64, 8):
        numbered = spark.createDataFrame([(i, k, t) for i, (k, t) in enumerate(rows)], "row long, doc_id long, text string")
        first = {r.row: r.first for r in similar.groups(numbered, max_cell=most).collect()}
        assert len(first) == len(rows)
        close = [first[i] == first[j] for i, j, s in pairs if s >= 0.85]
        assert len(close) > 100 and np.mean(close) >= 0.97
        assert not any(first[i] == first[j] for i, j, s in pairs if s < 0.6)
        assert len({first[i] for i in range(200, 500)}) == 1
        n = len(rows)
        assert first[n - 7] == n - 8 and first[n - 5] == n - 6 and first[n - 4] == first[3] and first[n - 3] == first[40] and first[n - 2] == n - 2
    kept = similar.keep_one(with_clashes(docs(spark, rows)))
    assert kept.columns == with_clashes(docs(spark, rows)).columns
    assert kept.count() == len(set(first.values()))
    assert similar.keep_one(docs(spark, [])).collect() == []


def test_similar_texts_are_those_whose_shingles_say_so(spark):
    """Pairs around the threshold: none below it, nearly all from it on. The bits alone passed some below."""
    rng = random.Random(8)
    rows, pairs = [], []
    for g in range(240):
        base = [f"g{g}w{i}" for i in range(400)]
        other = list(base)
        for at in range(0, rng.choice((9, 10, 11, 7, 8)) * 10, 10):
            other[at + 5] += "x"
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(other))]
        pairs.append(jaccard(rows[-2][1], rows[-1][1]))
    kept = {r.doc_id for r in similar.keep_one(docs(spark, rows)).collect()}
    assert set(range(0, 480, 2)) <= kept
    gone = [2 * g + 1 not in kept for g in range(240)]
    assert not any(x for x, s in zip(gone, pairs, strict=True) if s < 0.8) and sum(s < 0.8 for s in pairs) > 80
    assert np.mean([x for x, s in zip(gone, pairs, strict=True) if s >= 0.8]) >= 0.9


def test_pivots_of_similar_texts_lose_no_pair():
    rng = np.random.default_rng(5)
    a = rng.integers(0, 1 << 64, (500, 4), dtype=np.uint64)
    noise = np.packbits((rng.random((500, 256)) < rng.random((500, 1)) / 2).astype(np.uint8), axis=1).view(np.uint64)
    b = a ^ noise
    bits = np.bitwise_count(a ^ b).sum(1, dtype=int)
    ta, tb = similar.distances(a).astype(int), similar.distances(b).astype(int)
    pivots = similar.references()
    assert ta.shape == (500, 65) and all(ta[i, j] == np.bitwise_count(a[i] ^ pivots[j]).sum() for i in range(20) for j in range(65))
    sums = np.abs((ta[:, 1:] - ta[:, :1]) - (tb[:, 1:] - tb[:, :1])).sum(1) // 2
    assert (sums == np.bitwise_count(similar.coordinates(a) ^ similar.coordinates(b)).sum(1, dtype=int)).all()
    assert (sums <= bits).all()
    apart = np.bitwise_count(similar.coordinates(a[1:]) ^ similar.coordinates(a[:-1])).sum(1, dtype=int)
    assert (apart > 53).mean() > 0.95


def test_components_of_chains_and_hubs(spark):
    edges = [(i, i + 1) for i in range(40)] + [(1000, 1000 + i) for i in range(1, 60)] + [(2000, 2000), (3001, 3000), (3000, 3001)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{1000 + i: 1000 for i in range(60)}, 3000: 3000, 3001: 3000}
    assert components(spark.createDataFrame([], "a long, b long")).collect() == []


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_as_sql(spark, name):
    same_rows(spark, "/root/testdata/sf0.001", registry.QUERIES[name], registry.ORACLES[name])
