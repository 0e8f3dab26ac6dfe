"""Embedding near-duplicates by cross-polytope hashing.

A table rotates the unit vectors by three rounds of random sign flips and a fast Hadamard transform; a vector's
bucket is the nearest corner of the cross-polytope, its largest coordinate by size with the sign. It is stored in
that bucket and also probes those of its next largest coordinates. Vectors of one label that meet in a bucket, one
of them stored there, are compared by cosine in double precision; no other pair is.

Equal vectors are one entry with a weight. A bucket with more than block members is cut into blocks at random and
every pair of blocks is a group of its own, so no task holds more than two blocks of a bucket. A group hands on, not
its pairs, but for each member how many vectors it links to and one edge to its component within the group. A
pair that meets in several buckets is counted in the first of them only: each entry carries all its bucket numbers.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import components, materialize, whole_groups

COSINE = 0.93
#: The share of links at the threshold that some table finds, by which the number of tables is chosen.
RECALL = 0.9995
#: Vectors of one label above which a bucket number joins two rotations, and three.
MORE_FUNCTIONS = (60_000, 4_000_000)


def rotations(x: np.ndarray, table: int, functions: int) -> np.ndarray:
    """x (rows by a power-of-two width) under the pseudo-random rotations of a table: functions, rows, width."""
    out = []
    for f in range(functions):
        rng = np.random.default_rng([table, f, x.shape[1]])
        y = x
        for _ in range(3):
            y = y * rng.choice([-1.0, 1.0], x.shape[1])
            h = 1
            while h < y.shape[1]:
                z = y.reshape(len(y), -1, 2, h)
                y = np.stack([z[:, :, 0] + z[:, :, 1], z[:, :, 0] - z[:, :, 1]], 2).reshape(len(y), -1)
                h *= 2
            y = y / np.sqrt(y.shape[1])
        out.append(y)
    return np.stack(out)


def buckets(x: np.ndarray, tables: int, functions: int, probes: int) -> np.ndarray:
    """Bucket numbers of unit vectors x: rows by tables by (1 + functions * probes), the stored one first."""
    width = 1 << max(0, int(x.shape[1] - 1).bit_length())
    x = np.hstack([x, np.zeros((len(x), width - x.shape[1]))])
    probes = min(probes, width - 1)
    out = np.zeros((len(x), tables, 1 + functions * probes), np.int64)
    for t in range(tables):
        y = rotations(x, t, functions)
        order = np.argsort(-np.abs(y), axis=2, kind="stable")[:, :, : probes + 1]
        corner = order * 2 + (np.take_along_axis(y, order, 2) < 0)
        scale = (2 * width) ** np.arange(functions)
        stored = (corner[:, :, 0] * scale[:, None]).sum(0)
        out[:, t, 0] = stored
        for f in range(functions):
            for p in range(probes):
                out[:, t, 1 + f * probes + p] = stored + (corner[f, :, p + 1] - corner[f, :, 0]) * scale[f]
    return out


def tables_for(dim: int, functions: int, probes: int, cosine: float, recall: float = RECALL) -> int:
    """Tables by which pairs with just this cosine meet with the probability recall, from random pairs in one table."""
    rng = np.random.default_rng(93)
    a = unit(rng.normal(size=(4000, dim)))
    if dim < 2:
        return 1
    v = rng.normal(size=a.shape)
    v -= (v * a).sum(1, keepdims=True) * a
    b = cosine * a + np.sqrt(1 - cosine * cosine) * unit(v)
    x, y = (buckets(z, 1, functions, probes) for z in (a, b))
    met = ((x[:, :, :1] == y).any(2) | (y[:, :, :1] == x).any(2)).mean()
    return max(1, int(np.ceil(np.log(1 - recall) / np.log(max(1e-12, 1 - met)))))


def unit(vectors: np.ndarray) -> np.ndarray:
    x = vectors / np.abs(vectors).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _first_meeting(a: np.ndarray, b: np.ndarray, table: int, bucket: int) -> np.ndarray:
    """Whether bucket of table is the first in which the entries with bucket numbers a and b meet, row by row."""
    of_a = (a[:, :, :1] == b).any(2)  # b stored in or probing a's own bucket
    of_b = (b[:, :, :1] == a).any(2)
    first = np.argmax(of_a | of_b, 1) == table
    x, y = a[:, table, 0], b[:, table, 0]
    least = np.where(of_a[:, table] & of_b[:, table], np.minimum(x, y), np.where(of_a[:, table], x, y))
    return first & (least == bucket)


def verify(group: dict[str, np.ndarray], cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """(links of each member counted here, its component's smallest member) of one group."""
    x, keys, stored, block = group["x"], group["keys"], group["stored"], group["block"]
    near = x @ x.T >= cosine
    near &= stored[:, None] | stored[None, :]
    near &= group["id"][:, None] != group["id"][None, :]
    if group["cross"]:
        near &= block[:, None] != block[None, :]
    i, j = np.nonzero(np.triu(near, 1))
    counted = np.zeros(len(x), np.int64)
    for a in range(0, len(i), 1 << 15):
        p, q = i[a : a + (1 << 15)], j[a : a + (1 << 15)]
        new = _first_meeting(keys[p], keys[q], group["table"], group["bucket"])
        np.add.at(counted, p[new], group["weight"][q[new]])
        np.add.at(counted, q[new], group["weight"][p[new]])
    root = group["id"].copy()
    near |= np.eye(len(x), dtype=bool)
    while len(i):
        least = np.where(near, root[None, :], np.iinfo(np.int64).max).min(1)
        if (least == root).all():
            break
        root = least
    return counted, root


def links(entries: DataFrame, cosine: float, tables: int, functions: int, probes: int, block: int) -> DataFrame:
    """id, links, other: links of entry id found in one group, and an entry of the same component there.

    entries: id, label, dim, weight, vec (little-endian doubles or floats; dim of them), width (bytes of one).
    """
    slots = 1 + functions * probes

    def hashed(batches):
        import pyarrow as pa

        for batch in batches:
            dims, widths = batch.column("dim").to_numpy(), batch.column("width").to_numpy()
            for dim in np.unique(dims):
                part = batch.filter(pa.array(dims == dim))
                kind = "<f4" if widths[dims == dim][0] == 4 else "<f8"
                raw = b"".join(part.column("vec").to_pylist())
                keys = buckets(unit(np.frombuffer(raw, kind).reshape(-1, dim).astype(float)), tables, functions, probes)
                keys = keys.reshape(len(keys), -1)
                keys = np.pad(keys, ((0, 0), (0, tables * slots - keys.shape[1])), constant_values=-1)
                packed = pa.array([k.tobytes() for k in keys.astype("<i8")], pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, packed], [*part.schema.names, "keys"])

    schema = "id long, label string, dim int, width int, weight long, vec binary, keys binary"
    known = materialize(entries.select("id", "label", "dim", "width", "weight", "vec").mapInArrow(hashed, schema), "hashed")

    def placed(batches):
        import pyarrow as pa

        for batch in batches:
            keys = np.frombuffer(b"".join(batch.column("keys").to_pylist()), "<i8").reshape(-1, tables * slots)
            row = np.repeat(np.arange(len(keys)), tables * slots)
            slot = np.tile(np.arange(tables * slots), len(keys))
            flat = keys.ravel()
            ok = flat >= 0
            take = pa.array(row[ok])
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(take) for c in ("id", "label", "dim")), pa.array((slot[ok] // slots).astype(np.int32)), pa.array(flat[ok]), pa.array(slot[ok] % slots == 0)],
                ["id", "label", "dim", "tab", "bucket", "stored"],
            )

    where = ["label", "dim", "tab", "bucket"]
    spots = known.select("id", "label", "dim", "keys").mapInArrow(placed, "id long, label string, dim int, tab int, bucket long, stored boolean")
    sizes = spots.groupBy(*where).agg(F.count("*").alias("n"), F.sum(F.col("stored").cast("long")).alias("s")).where("n > 1 and s > 0")
    sizes = materialize(sizes.select(*where, F.ceil(F.col("n") / block).cast("int").alias("parts")), "buckets")
    met = spots.join(sizes, where)
    met = met.withColumn("part", F.pmod(F.xxhash64("id", "tab"), F.col("parts")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    met = met.withColumn("other", other).withColumns({"low": F.least("part", "other"), "high": F.greatest("part", "other")})
    met = met.drop("parts", "other").join(known.select("id", "width", "weight", "vec", "keys"), "id")

    def verified(batches):
        import pyarrow as pa

        for t in whole_groups(batches, [*where, "low", "high"]):
            head = {c: t.column(c)[0].as_py() for c in ("tab", "bucket", "dim", "width", "low", "high")}
            if t.num_rows < 2:
                continue
            kind = "<f4" if head["width"] == 4 else "<f8"
            group = {
                "x": unit(np.frombuffer(b"".join(t.column("vec").to_pylist()), kind).reshape(-1, head["dim"]).astype(float)),
                "keys": np.frombuffer(b"".join(t.column("keys").to_pylist()), "<i8").reshape(-1, tables, slots),
                "id": t.column("id").to_numpy(),
                "weight": t.column("weight").to_numpy(),
                "stored": t.column("stored").to_numpy(),
                "block": t.column("part").to_numpy(),
                "table": head["tab"],
                "bucket": head["bucket"],
                "cross": head["low"] != head["high"],
            }
            counted, root = verify(group, cosine)
            keep = (counted > 0) | (root != group["id"])
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(group["id"][keep]), pa.array(counted[keep]), pa.array(root[keep])], ["id", "links", "other"])

    columns = ["id", *where, "stored", "part", "low", "high", "width", "weight", "vec", "keys"]
    group_key = [*where, "low", "high"]
    dealt = met.select(*columns).repartition(*group_key).sortWithinPartitions(*group_key)
    return dealt.mapInArrow(verified, "id long, links long, other long")


def near_duplicates(
    vectors: DataFrame, cosine: float = COSINE, tables: int | None = None, functions: int | None = None, probes: int = 2, block: int = 512
) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label).

    A row whose label is null, or whose vector is null, empty, zero or has null or non-finite components, links with
    nothing; nor do vectors of different lengths. Rows that repeat a vec_id are vectors of their own; labels of any type are
    compared as text. functions is the number of rotations joined into a bucket number, from the largest number of vectors with a
    label if not given: one more divides the buckets by twice the width. tables follows from it, see tables_for().
    """
    kind = "double" if "double" in dict(vectors.dtypes)["embedding"] else "float"
    width = 8 if kind == "double" else 4
    sound = F.col("label").isNotNull() & (F.size("embedding") > 0) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    sound = F.coalesce(sound & F.exists("embedding", lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").cast("string"), F.col("embedding").cast(f"array<{kind}>"), sound.alias("sound"))

    def packed(batches):
        import pyarrow as pa

        for batch in batches:
            data = [np.array(v, f"<f{width}").tobytes() for v in batch.column("embedding").to_pylist()]
            sizes = pa.array([len(d) // width for d in data], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), sizes, pa.array(data, pa.binary())], ["vec_id", "label", "dim", "vec"])

    usable = materialize(rows.where("sound").select("vec_id", "label", "embedding").mapInArrow(packed, "vec_id long, label string, dim int, vec binary"), "vectors")
    same = usable.groupBy("label", "dim", "vec").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    entries = materialize(same.withColumn("id", F.monotonically_increasing_id()).withColumn("width", F.lit(width)), "entries")
    if functions is None or tables is None:
        most = entries.groupBy("label", "dim").count().groupBy("dim").agg(F.max("count").alias("n")).collect()  # a row for each length of vectors
        if functions is None:
            functions = 1 + sum(max((r.n for r in most), default=0) > n for n in MORE_FUNCTIONS)
        if tables is None:
            tables = max((tables_for(r.dim, functions, probes, cosine) for r in most), default=1)
    found = materialize(links(entries, cosine, tables, functions, probes, block), "found")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    groups = components(found.where("id != other").select(F.col("id").alias("a"), F.col("other").alias("b")))
    placed = entries.join(counts, "id", "left").join(groups, entries.id == groups.node, "left")
    placed = placed.select("label", "dim", "vec", "least", "weight", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("component", "id").alias("root"))
    roots = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    by_vector = placed.join(roots, "root").select("label", "dim", "vec", (F.col("links") + F.col("weight") - 1).alias("n_links"), "component_id")
    linked = usable.join(by_vector, ["label", "dim", "vec"]).select("vec_id", "n_links", "component_id")
    alone = rows.where("not sound").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.union(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op7: links and component of every vector."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
