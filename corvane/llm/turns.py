"""Conversation prefix trie by an LCP-aware external mergesort.

A conversation is the sequence of its turns' digests (16 bytes of SHA-256 of role and text), so sequences compare as
bytes and a prefix comes first. Tasks sort runs of conversations, equal ones merged, and note how many turns each
shares with the one before it (its LCP). Splitters from a sample cut all runs into ranges. A task merges the runs'
parts of a range with a loser tree whose contenders know how many turns they share with the last output: only equal
counts are compared, from that turn on. The LCP of each output tells which nodes of the open path are finished.

A node that lies in several ranges is a prefix of a splitter; each range gives its part of such nodes, and the parts,
at most as many as ranges times turns of a splitter, are added up from the deepest on.
"""

from __future__ import annotations

import hashlib
import math
from bisect import bisect_right

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize, whole_groups

#: Bytes of a turn's digest.
TURN = 16
#: Conversations of a run, at most.
RUN_ROWS = 50_000
#: About how many bytes of runs a range has, and how many sampled conversations each splitter is chosen from.
RANGE_BYTES, SAMPLES = 32_000_000, 8
#: Turns of a sampled conversation that a splitter may have.
SPLITTER_TURNS = 512
EMPTY = hashlib.sha256(b"").hexdigest()


def common_turns(a: bytes, b: bytes, start: int = 0) -> int:
    """How many turns a and b share, of which the first start are known to be equal."""
    at, end = start * TURN, min(len(a), len(b))
    while at < end and a[at : at + TURN] == b[at : at + TURN]:
        at += TURN
    return at // TURN


def node_key(path: bytes) -> bytes:
    return hashlib.sha256(path).digest()[:TURN]


def listed(conversations: DataFrame) -> DataFrame:
    """conv_id, turns (digest, chars) of conversations (conv_id, turn, role, text).

    Turns are ordered by turn, null first, then by digest; null roles and texts are empty; a row that repeats is a turn
    of its own; rows without a conv_id are left out. Only digests and lengths leave the task that reads the texts.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    said = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(
            F.col("turn"),
            F.unhex(F.substring(F.sha2(said.cast("binary"), 256), 1, 2 * TURN)).alias("digest"),
            F.char_length(text).alias("chars"),
        ).alias("t"),
    )
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    return whole.select("conv_id", F.transform("ts", lambda t: F.struct(t["digest"].alias("digest"), t["chars"].alias("chars"))).alias("turns"))


def rebuilt(conversations: DataFrame, every: int = 100, most: int = 6) -> DataFrame:
    """conv_id, turns: the first h turns of conversation c - c % every, then the own ones after the first h; h = crc32(c) % most."""
    own = listed(conversations).select("*", (F.col("conv_id") - F.col("conv_id") % every).alias("_base"))
    heads = own.where(F.col("conv_id") % every == 0).select("_base", F.slice("turns", 1, most - 1).alias("_head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % most).cast("int")
    given = F.when(F.col("_head").isNotNull(), F.slice("_head", F.lit(1), h)).otherwise(F.slice("turns", 1, 0))
    rest = F.slice("turns", h + 1, F.size("turns"))
    return own.join(heads, "_base", "left").select("conv_id", F.concat(given, rest).alias("turns"))


RUN = "run long, path binary, chars binary, lcp int, n long, least long, key binary, ids array<long>"


def sorted_runs(sequences: DataFrame, run_rows: int = RUN_ROWS) -> DataFrame:
    """Sorted runs of sequences (conv_id, turns): each distinct sequence of a run once, with its LCP and its conv_ids."""

    def sort(batches):
        import pyarrow as pa

        part, held, k = TaskContext.get().partitionId(), [], 0

        def run():
            held.sort()
            rows: list[list] = []
            for path, conv, chars in held:
                if rows and rows[-1][1] == path:
                    rows[-1][4] += 1
                    rows[-1][7].append(conv)
                else:
                    rows.append([part << 24 | k, path, chars, common_turns(rows[-1][1], path) if rows else 0, 1, conv, node_key(path), [conv]])
            types = (pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
            names = [c.split()[0] for c in RUN.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

        for batch in batches:
            turns = batch.column("turns")
            digests, sizes = turns.flatten().field("digest").to_pylist(), turns.flatten().field("chars").to_numpy(zero_copy_only=False)
            ends = np.cumsum(turns.value_lengths().to_numpy(zero_copy_only=False))
            for conv, a, b in zip(batch.column("conv_id").to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                held.append((b"".join(digests[a:b]), conv, sizes[a:b].astype("<i4").tobytes()))
                if len(held) >= run_rows:
                    yield run()
                    held, k = [], k + 1
        if held:
            yield run()

    return materialize(sequences.select("conv_id", "turns").mapInArrow(sort, RUN), "runs")


def splitters(runs: DataFrame, range_bytes: int = RANGE_BYTES) -> list[bytes]:
    """Sequences that cut runs into ranges: of a sample's neighbours, the shortest prefixes that tell them apart."""
    total = runs.agg(F.count("*").alias("n"), F.sum(F.length("path") + F.length("chars")).alias("b")).first()
    if not total.n:
        return []
    cores = runs.sparkSession.sparkContext.defaultParallelism
    ranges = max(math.ceil((total.b or 0) / range_bytes), min(8 * cores, math.ceil(total.n / 250)))
    rate = min(1.0, SAMPLES * ranges / total.n)
    chosen = runs.where(F.pmod(F.xxhash64("path"), F.lit(1 << 30)) < int(rate * (1 << 30)))
    sample = sorted({bytes(r.p) for r in chosen.select(F.substring("path", 1, SPLITTER_TURNS * TURN).alias("p")).distinct().collect()})
    at = [len(sample) * i // ranges for i in range(1, ranges)]
    found = {sample[i][: (common_turns(sample[i - 1], sample[i]) + 1) * TURN] for i in at if i}
    return sorted(found)


class LoserTree:
    """Merges sorted streams of (path, LCP with the one before, payload); yields (path, LCP with the last output, payload)."""

    def __init__(self, streams):
        self.streams = [iter(s) for s in streams]
        n = len(self.streams)
        self.size = 1 << max(0, (n - 1).bit_length())
        self.heads = [next(s, None) for s in self.streams] + [None] * (self.size - n)
        self.shared = [0] * self.size  # turns that a head shares with the last output, or with what it lost to
        self.losers = [0] * self.size
        self.compared = 0
        self.best = self._build(1)

    def _build(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.losers[node] = self._play(self._build(2 * node), self._build(2 * node + 1))
        return winner

    def _play(self, a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's shared becomes what it shares with the winner."""
        x, y = self.heads[a], self.heads[b]
        if y is None or x is not None and self.shared[a] > self.shared[b]:
            return a, b
        if x is None or self.shared[a] < self.shared[b]:
            return b, a
        known = self.shared[a]
        both = common_turns(x[0], y[0], known)
        self.compared += both - known + 1
        p, q = x[0][both * TURN : both * TURN + TURN], y[0][both * TURN : both * TURN + TURN]
        winner, loser = (a, b) if (p, a) < (q, b) else (b, a)
        self.shared[loser] = both
        return winner, loser

    def __iter__(self):
        while self.heads[self.best] is not None:
            at = self.best
            path, _, payload = self.heads[at]
            yield path, self.shared[at], payload
            self.heads[at] = head = next(self.streams[at], None)
            self.shared[at] = head[1] if head else 0
            node = (at + self.size) // 2
            while node:
                at, self.losers[node] = self._play(at, self.losers[node])
                node //= 2
            self.best = at


class OpenPath:
    """The stack of nodes that may still get members; finished ones go to rows, parts of a splitter's prefixes to spine.

    rows: [conv_id, depth, parent's conv_id or None, n_convs, n_children, n_leaves, saved_tokens, key, parent's key].
    spine: [key, parent's key, depth, chars, n, least, children, leaves, saved], of what is not below another such node.
    """

    def __init__(self, left: bytes | None, right: bytes | None):
        self.bounds = [b for b in (left, right) if b is not None]
        self.rows: list[list] = []
        self.spine: list[list] = []
        #: of each open node: hasher, key, chars, spine?, n, least, children, leaves, saved, places of its children in rows
        self.open: list[list] = []
        self._push(hashlib.sha256(), 0, True)

    def _push(self, hasher, chars: int, spine: bool) -> None:
        self.open.append([hasher, hasher.digest()[:TURN], chars, spine, 0, math.inf, 0, 0, 0, []])

    def _pop(self) -> None:
        _, key, chars, spine, n, least, children, leaves, saved, below = self.open.pop()
        depth = len(self.open)
        up = self.open[-1] if self.open else None
        if spine:
            self.spine.append([key, up[1] if up else None, depth, chars, n, least if n else None, children, leaves, saved])
            return
        leaves = leaves if children else 1
        saved += (n - 1) * chars
        for i in below:  # now it is known who the smallest member is
            self.rows[i][2] = least
        up[9].append(len(self.rows))
        self.rows.append([least, depth, None, n, children, leaves, saved, key, up[1]])
        up[4] += n
        up[5] = min(up[5], least)
        up[6] += 1
        up[7] += leaves
        up[8] += saved

    def add(self, path: bytes, shared: int, chars: np.ndarray, n: int, least: int) -> None:
        """The next sequence, which shares so many turns with the last one, of n conversations."""
        while len(self.open) > shared + 1:
            self._pop()
        kept = max((common_turns(b, path) for b in self.bounds), default=0)
        for d in range(shared, len(path) // TURN):
            hasher = self.open[-1][0].copy()
            hasher.update(path[d * TURN : (d + 1) * TURN])
            self._push(hasher, int(chars[d]), d + 1 <= kept)
        self.open[-1][4] += n
        self.open[-1][5] = min(self.open[-1][5], least)

    def close(self) -> None:
        while self.open:
            self._pop()


NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, key binary, up binary"
SPINE = "key binary, up binary, depth long, chars long, n long, least long, children long, leaves long, saved long"


def merged(runs: DataFrame, cuts: list[bytes]) -> DataFrame:
    """Struct columns node (null in parts of the spine) and spine (null in finished nodes) of all ranges."""

    @F.pandas_udf("int")
    def place(paths: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(cuts, bytes(p)) for p in paths], dtype="int32")

    def merge(batches):
        import pyarrow as pa

        schemas = []
        for spec in (NODE, SPINE):
            schemas.append([(c.split()[0], pa.binary() if c.endswith("binary") else pa.int64()) for c in spec.split(", ")])
        types = [pa.struct([pa.field(n, t) for n, t in s]) for s in schemas]

        def out(rows, which):
            arrays = [pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), schemas[which], strict=True)]
            full = pa.StructArray.from_arrays(arrays, names=[n for n, _ in schemas[which]])
            columns = [full if i == which else pa.nulls(len(rows), types[i]) for i in (0, 1)]
            return pa.RecordBatch.from_arrays(columns, ["node", "spine"])

        for part in whole_groups(batches, ["place"]):
            at = part.column("place")[0].as_py()
            run = part.column("run").to_numpy()
            starts = [0, *(np.flatnonzero(run[1:] != run[:-1]) + 1).tolist(), len(run)]
            columns = {c: part.column(c).combine_chunks() for c in ("path", "chars", "lcp", "n", "least")}

            def stream(a, b, columns=columns):
                for i in range(a, b):
                    yield columns["path"][i].as_py(), columns["lcp"][i].as_py(), i

            stack = OpenPath(cuts[at - 1] if at else None, cuts[at] if at < len(cuts) else None)
            for path, shared, i in LoserTree(stream(a, b) for a, b in zip(starts, starts[1:], strict=False)):
                chars = np.frombuffer(columns["chars"][i].as_py(), "<i4")
                stack.add(path, shared, chars, columns["n"][i].as_py(), columns["least"][i].as_py())
            stack.close()
            if stack.rows:
                yield out(stack.rows, 0)
            yield out(stack.spine, 1)

    placed = runs.select(place("path").alias("place"), "run", "path", "chars", "lcp", "n", "least")
    ordered = placed.repartition(max(1, len(cuts) + 1), "place").sortWithinPartitions("place", "run", "path")
    return ordered.mapInArrow(merge, f"node struct<{_fields(NODE)}>, spine struct<{_fields(SPINE)}>")


def _fields(spec: str) -> str:
    return ", ".join(f"{n}: {t}" for n, t in (c.split() for c in spec.split(", ")))


def rolled_up(parts) -> list[tuple]:
    """NODE rows of the spine from its nodes' summed parts, from the deepest on."""
    nodes = {bytes(r.key): [r.n, r.least if r.least is not None else math.inf, r.children, r.leaves, r.saved] for r in parts}
    ordered = sorted(parts, key=lambda r: -r.depth)
    for r in ordered:
        n = nodes[bytes(r.key)]
        n[3] = n[3] if n[2] else 1
        n[4] += (n[0] - 1) * r.chars
        if r.up is not None:
            up = nodes[bytes(r.up)]
            up[0] += n[0]
            up[1] = min(up[1], n[1])
            up[2] += 1
            up[3] += n[3]
            up[4] += n[4]
    out = []
    for r in ordered:
        n, least, children, leaves, saved = nodes[bytes(r.key)]
        up = nodes[bytes(r.up)][1] if r.up is not None else None
        out.append((least, r.depth, up, n, children, leaves, saved, bytes(r.key), None if r.up is None else bytes(r.up)))
    return out


def ends(runs: DataFrame) -> DataFrame:
    """key, ends_sha256: of the conversations that end at a node, in the order of their ids, hashed as they stream by."""

    def hashed(batches):
        import pyarrow as pa

        key, hasher = None, None
        for batch in batches:
            keys, digests = [], []
            for k, conv in zip(batch.column("key").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
                if k == key:
                    hasher.update(b",%d" % conv)
                    continue
                if key is not None:
                    keys.append(key)
                    digests.append(hasher.hexdigest())
                key, hasher = k, hashlib.sha256(b"%d" % conv)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(digests, pa.string())], ["key", "ends_sha256"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([hasher.hexdigest()])], ["key", "ends_sha256"])

    each = runs.select("key", F.explode("ids").alias("conv_id"))
    return each.repartition("key").sortWithinPartitions("key", "conv_id").mapInArrow(hashed, "key binary, ends_sha256 string")


def trie(sequences: DataFrame, run_rows: int = RUN_ROWS, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The nodes of the prefix trie of sequences (conv_id, turns), as rebuilt() or listed() give them.

    conv_id (smallest member), depth, parent_conv_id (of the root null), n_convs, n_children, n_leaves, saved_tokens
    and ends_sha256 of every node, the root included, with key and up, which name a node and its parent. An empty
    sequence is a member of the root alone. Without sequences there is no node. Equal sequences are one entry of a run,
    however many they are; a conversation's digests lie in one row.
    """
    spark = sequences.sparkSession
    runs = sorted_runs(sequences, run_rows)
    both = materialize(merged(runs, splitters(runs, range_bytes)), "nodes")
    part = both.where("spine is not null").select("spine.*")
    first = [F.first(c).alias(c) for c in ("up", "depth", "chars")]
    sums = [F.sum(c).alias(c) for c in ("n", "children", "leaves", "saved")]
    # at most as many as ranges times turns of a splitter
    spine = rolled_up(part.groupBy("key").agg(*first, *sums, F.min("least").alias("least")).collect())
    tops = spark.createDataFrame(spine, NODE)
    names = tops.select(F.col("key").alias("up"), F.col("conv_id").alias("_up"))
    inside = both.where("node is not null").select("node.*").join(F.broadcast(names), "up", "left")
    inside = inside.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_up")).select(tops.columns)
    nodes = inside.unionByName(tops).join(ends(runs), "key", "left")
    return nodes.select(*[c for c in tops.columns if c not in ("key", "up")], F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256"), "key", "up")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op11: the trie of the rebuilt conversations."""
    return trie(rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet"))).drop("key", "up")


_BIT = "list_reduce([xor(c, b)] || range(8), lambda a, x: xor(a >> 1, 3988292384 * (a & 1)))"
_BYTES = "list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)"
_CRC = f"xor(list_reduce([4294967295] || {_BYTES}, lambda c, b: {_BIT}), 4294967295)"

ORACLE = f"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, d) AS i, d, n FROM (
    SELECT conv_id, turn, left(sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')), 32) AS d,
      length(coalesce(text, '')) AS n
    FROM conversations WHERE conv_id IS NOT NULL)
), c AS (
  SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base,
    {_CRC} % 6 AS h
  FROM t
), r AS (
  SELECT c.conv_id, t.i, t.d, t.n FROM c JOIN t ON t.conv_id = c.base AND t.i <= c.h
  UNION ALL
  SELECT c.conv_id, t.i, t.d, t.n FROM c JOIN t ON t.conv_id = c.conv_id AND t.i > c.h
), p AS (
  SELECT conv_id, n, row_number() OVER w AS depth, string_agg(d, '') OVER w AS path FROM r
  WINDOW w AS (PARTITION BY conv_id ORDER BY i ROWS UNBOUNDED PRECEDING)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c
), members AS (
  SELECT path, any_value(depth) AS depth, any_value(n) AS n, min(conv_id) AS conv_id, count(*) AS n_convs FROM p GROUP BY path
), parents AS (
  SELECT m.*, CASE WHEN depth > 0 THEN left(path, (32 * (depth - 1))::BIGINT) END AS up FROM members m
), kids AS (
  SELECT up AS path, count(*) AS n_children FROM parents WHERE up IS NOT NULL GROUP BY up
), full_nodes AS (
  SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM parents p LEFT JOIN kids k USING (path)
), above AS (
  SELECT left(path, (32 * a)::BIGINT) AS path, n_children = 0 AS leaf, (n_convs - 1) * n AS saved
  FROM full_nodes, unnest(range(depth + 1)) AS x(a)
), sums AS (
  SELECT path, count(*) FILTER (leaf) AS n_leaves, sum(saved) AS saved_tokens FROM above GROUP BY path
), last AS (
  SELECT conv_id, max_by(path, depth) AS path FROM p GROUP BY conv_id
), done AS (
  SELECT path, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256 FROM last GROUP BY path
)
SELECT f.conv_id, f.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, f.n_convs, f.n_children,
  s.n_leaves, s.saved_tokens::BIGINT AS saved_tokens, coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM full_nodes f JOIN sums s USING (path) LEFT JOIN members u ON u.path = f.up LEFT JOIN done e ON e.path = f.path
"""
