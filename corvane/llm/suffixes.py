"""Removal of repeated byte strings by prefix-free parsing.

The corpus is its texts in ascending doc_id order; matches stay within a text. A rolling hash sets triggers that cut
each text into phrases; a phrase is the run of length-byte strings that share a trigger, so neighbouring phrases
overlap by length - 1 bytes, every string begins in exactly one phrase, and equal strings have equal triggers.

1. Parse: tasks find the phrases and hand on, for each trigger hash, phrase hash and first place in a slice of text.
2. Dictionary: equal phrases meet. All strings of one that stands earlier too are repeated; first places form the
   dictionary. A trigger with one phrase has nothing else to be compared with and is done, with no look at the text.
3. The other phrases of the dictionary are fetched, and the suffixes of those that share a trigger are sorted by
   their first length bytes: a slice of the dictionary's suffix array. Neighbours that agree there are one class.
4. Corpus order: the parse's places put each class in order; all but its first string are repeated.

The strings of a trigger that very many phrases share (the edge of a common passage) are dealt one by one, by their
hashes, the first places of each slice only, so no task gathers it. Hashes deal strings out; bytes say which are equal.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import delete_table, key_chunks, materialize, whole_groups
from corvane.llm.phrases import MAX_BUFFER, Hashes, parse
from corvane.llm.tokens import text_slices

LENGTH = 100
#: Phrases of one trigger above which its strings are dealt by their own hashes.
CROWD = 2_000
#: Crowded triggers that are sent to every task, at most; more are joined.
BROADCAST_CROWDS = 500_000
_ROW = np.dtype([("anchor", "<i8"), ("phrase", "<i8"), ("doc", "<i8"), ("row", "<i8"), ("start", "<i4"), ("n", "<i4"), ("kind", "u1")])
#: Kinds of entries: of the dictionary, of a trigger known to have more phrases, repeated in its slice.
ENTRY, SHARED, REPEATED = 0, 1, 2


def _buffers(batch, length: int):
    """Yields (bytes, ends, text of each piece, its place there) of some of the batch's texts in UTF-8.

    A text longer than half a buffer comes in pieces that overlap by length - 1 bytes: every string begins in one.
    """
    most, held, size = MAX_BUFFER // 2, [], 0

    def joined():
        ends = np.cumsum(np.array([len(x) for x, _, _ in held], np.int64))
        return np.frombuffer(b"".join(x for x, _, _ in held), np.uint8), ends, np.array([i for _, i, _ in held]), np.array([a for _, _, a in held])

    for i, text in enumerate(batch.column("text").to_pylist()):
        raw = (text or "").encode("utf-8", "surrogatepass")
        for a in range(0, max(1, len(raw) - length + 1), most):
            piece = raw[a : a + most + length - 1] if len(raw) > most else raw
            if held and size + len(piece) > MAX_BUFFER:
                yield joined()
                held, size = [], 0
            held.append((piece, i, a))
            size += len(piece)
            if len(raw) <= most:
                break
    if held:
        yield joined()


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of sorted keys is the first with its values."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return new


def _slice_entries(data: np.ndarray, ends: np.ndarray, docs: np.ndarray, rows: np.ndarray, at: np.ndarray, length: int) -> np.ndarray:
    """The entries of one buffer of pieces of texts; at: each piece's place in its text."""
    found = parse(data, ends, length)
    out = np.zeros(len(found["n"]), _ROW)
    starts = np.concatenate([[0], ends[:-1]])
    for name in ("anchor", "phrase", "n"):
        out[name] = found[name]
    out["doc"], out["row"] = docs[found["doc"]], rows[found["doc"]]
    out["start"] = found["start"] - starts[found["doc"]] + at[found["doc"]]
    out = out[np.lexsort((out["start"], out["row"], out["doc"], out["phrase"], out["anchor"]))]
    first = _first_of(out["anchor"], out["phrase"])
    out["kind"][~first] = REPEATED
    of = np.cumsum(_first_of(out["anchor"])) - 1
    several = (np.bincount(of, weights=first) > 1)[of] if len(of) else first
    out["kind"][first & several] = SHARED
    return out


def _bucket(entries: np.ndarray, count: int) -> np.ndarray:
    """By trigger; of the entries of one with several phrases in the slice, all but one by their phrase."""
    led = _first_of(entries["anchor"])
    spread = (entries["kind"] != ENTRY) & ~led
    key = np.where(spread, entries["anchor"] ^ entries["phrase"], entries["anchor"]).view(np.uint64)
    return ((key >> np.uint64(17)) % np.uint64(count)).astype(np.int64)


def _settle(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(repeated entries, entries whose trigger has several phrases) of all entries of some buckets."""
    told = e[e["kind"] == REPEATED]
    e = e[e["kind"] != REPEATED]
    e = e[np.lexsort((e["start"], e["row"], e["doc"], e["phrase"], e["anchor"]))]
    first = _first_of(e["anchor"], e["phrase"])
    of = np.cumsum(_first_of(e["anchor"])) - 1
    several = np.bincount(of, weights=first) + np.bincount(of, weights=e["kind"] == SHARED) > 1 if len(of) else np.zeros(0, bool)
    return np.concatenate([told, e[~first]]), e[first & several[of]]


def repeated_strings(docs: DataFrame, length: int, crowd: int) -> DataFrame:
    """row, start, end: stretches of bytes of the rows of docs (row, doc, text) whose strings stand earlier too."""
    spark = docs.sparkSession
    count = 8 * max(int(spark.conf.get("spark.sql.shuffle.partitions")), docs.rdd.getNumPartitions())

    def parsed(batches):
        import pyarrow as pa

        slices = text_slices(batches, ("row", "doc", "text"), size=MAX_BUFFER // 4)
        for batch, (data, ends, text, at) in ((x, y) for x in slices for y in _buffers(x, length)):
            e = _slice_entries(data, ends, batch.column("doc").to_numpy()[text], batch.column("row").to_numpy()[text], at, length)
            bucket = _bucket(e, count)
            order = np.argsort(bucket, kind="stable")
            e, bucket = e[order], bucket[order]
            cuts = np.concatenate([np.flatnonzero(_first_of(bucket)), [len(e)]])
            blobs = [e[a:b].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([pa.array(bucket[cuts[:-1]], pa.int64()), pa.array(blobs, pa.binary())], ["bucket", "entries"])

    def settled(batches):
        import pyarrow as pa

        for t in whole_groups(batches, ["bucket"]):
            again, shared = _settle(np.frombuffer(b"".join(t.column("entries").to_pylist()), _ROW))
            both = np.concatenate([again, shared])
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(np.ascontiguousarray(both[c])) for c in ("row", "start", "n", "anchor")), pa.array(np.arange(len(both)) >= len(again))],
                ["row", "start", "n", "anchor", "shared"],
            )

    entries = docs.select("row", "doc", "text").mapInArrow(parsed, "bucket long, entries binary")
    settled_schema = "row long, start int, n int, anchor long, shared boolean"
    by_bucket = entries.repartition("bucket").sortWithinPartitions("bucket")
    phrases = materialize(by_bucket.mapInArrow(settled, settled_schema), "phrases")
    again = phrases.where("not shared").select("row", "start", (F.col("start") + F.col("n") + (length - 1)).cast("int").alias("end"))

    shared = phrases.where("shared")
    crowded = materialize(shared.groupBy("anchor").agg(F.count("*").alias("size")).where(F.col("size") > crowd), "crowded")
    few = crowded.limit(BROADCAST_CROWDS + 1).count() <= BROADCAST_CROWDS
    marked = shared.join(F.broadcast(crowded) if few else crowded, "anchor", "left").select("row", F.struct("start", "n", "anchor", F.col("size").isNotNull().alias("crowded")).alias("p"))
    wanted = marked.groupBy("row").agg(F.collect_list("p").alias("wanted"))
    fetched = docs.join(wanted, "row").select("row", "doc", "text", "wanted").mapInArrow(lambda batches: _fetch(batches, length), _FETCHED)
    sorted_ = fetched.repartition("key").sortWithinPartitions("key").mapInArrow(lambda batches: _sort_suffixes(batches, length), "row long, start int, end int")
    return again.union(sorted_)


_FETCHED = "key long, row long, doc long, start int, n int, text binary"


def _fetch(batches, length: int, hashes=Hashes):
    """Bytes of the wanted phrases by trigger; of crowded triggers the first places of each string, by its hash.

    n is the number of strings in text, -1 for a string that is already known to be repeated.
    """
    import pyarrow as pa

    for batch in batches:
        out: list[list] = [[], [], [], [], [], []]
        crowds, raws = [], {}
        for r in batch.to_pylist():
            raw = (r["text"] or "").encode("utf-8", "surrogatepass")
            found = None
            for p in r["wanted"]:
                a, n = p["start"], p["n"]
                if not p["crowded"]:
                    for column, value in zip(out, (p["anchor"], r["row"], r["doc"], a, n, raw[a : a + n + length - 1]), strict=True):
                        column.append(value)
                    continue
                found = found or hashes(np.frombuffer(raw, np.uint8))
                raws[r["row"]] = raw
                at = np.arange(a, a + n)
                crowds.append(np.stack([found.of(at, at + length).view(np.int64) ^ p["anchor"], np.full(n, r["row"]), np.full(n, r["doc"]), at]))
        if crowds:
            c = np.concatenate(crowds, axis=1)
            c = c[:, np.lexsort((c[3], c[1], c[2], c[0]))]
            new = _first_of(c[0])
            first: bytes = b""
            for k, (key, row, doc, a) in enumerate(c.T.tolist()):
                string = raws[row][a : a + length]
                if new[k]:
                    first = string
                known = not new[k] and string == first
                for column, value in zip(out, (row if known else key, row, doc, a, -1 if known else 1, None if known else string), strict=True):
                    column.append(value)
        types = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, types, strict=True)], ["key", "row", "doc", "start", "n", "text"])


def _stretches(r: np.ndarray, s: np.ndarray, length: int):
    """Runs of following strings of a row as one stretch."""
    import pyarrow as pa

    order = np.lexsort((s, r))
    r, s = r[order], s[order]
    new = np.ones(len(r), bool)
    new[1:] = (r[1:] != r[:-1]) | (s[1:] > s[:-1] + length)
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(r) - 1]])
    return pa.RecordBatch.from_arrays([pa.array(r[new]), pa.array(s[new].astype(np.int32)), pa.array((s[last] + length).astype(np.int32))], ["row", "start", "end"])


def _sort_suffixes(batches, length: int, part: int = 1 << 14):
    """row, start, end of the strings of a slice of the dictionary that stand earlier in the corpus.

    Whole triggers at a time, part phrases or more; only these are held.
    """
    for table in key_chunks(batches, "key", part):
        row, doc, start, n = (table.column(c).to_numpy() for c in ("row", "doc", "start", "n"))
        known = n == -1
        if known.any():
            yield _stretches(row[known], start[known], length)
        these = np.flatnonzero(n > 0)
        if not len(these):
            continue
        raw = table.column("text").take(these).to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        begins = np.cumsum([0, *map(len, raw)])[:-1]
        of = np.repeat(np.arange(len(these)), n[these])
        inside = np.arange(len(of)) - np.repeat(np.cumsum(n[these]) - n[these], n[these])
        suffixes = np.lib.stride_tricks.sliding_window_view(data, length)[begins[of] + inside]
        suffixes = np.ascontiguousarray(suffixes).view(f"S{length}").ravel()
        r, d, s = row[these][of], doc[these][of], start[these][of] + inside
        place = np.lexsort((s, r, d))
        order = place[np.argsort(suffixes[place], kind="stable")]  # the suffix array, equal suffixes in corpus order
        later = order[~_first_of(suffixes[order])]
        if len(later):
            yield _stretches(r[later], s[later], length)


def remove_repeats(docs: DataFrame, length: int = LENGTH, crowd: int = CROWD) -> DataFrame:
    """doc_id, n_bytes, spans (start, end of the removed runs), kept (bytes that stay) for every row of docs.

    Each byte goes that a length-byte string covers which also starts earlier: in a smaller doc_id or further ahead
    in the same text. A null text is empty; a null doc_id is the smallest; rows that share a doc_id follow each other
    in the order in which they are read. Texts of less than length bytes keep everything.
    """
    doc = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    # stored: the jobs below are planned apart, and another plan of the input would number its rows otherwise
    numbered = materialize(docs.select(F.monotonically_increasing_id().alias("row"), doc.alias("doc"), "text"), "rows")
    numbered = numbered.withColumn("row", F.coalesce("row", F.lit(-1)))  # never null, so both joins below share one exchange
    places = repeated_strings(numbered, length, crowd)
    by_row = places.groupBy("row").agg(F.collect_list(F.struct("start", "end")).alias("places"))

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            spans, kept, sizes = [], [], []
            for text, places in zip(batch.column("text").to_pylist(), batch.column("places").to_pylist(), strict=True):
                raw = (text or "").encode("utf-8", "surrogatepass")
                runs: list[list[int]] = []
                for p in sorted((p["start"], p["end"]) for p in places or []):
                    if runs and p[0] <= runs[-1][1]:
                        runs[-1][1] = max(runs[-1][1], p[1])
                    else:
                        runs.append(list(p))
                edges = [0, *(x for run in runs for x in run), len(raw)]
                kept.append(b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                spans.append([{"start": a, "end": b} for a, b in runs])
                sizes.append(len(raw))
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], ["doc_id", "n_bytes", "spans", "kept"]
            )

    schema = "doc_id long, n_bytes long, spans array<struct<start:int,end:int>>, kept binary"
    joined = numbered.join(by_row, "row", "left")
    restored = F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc"))
    return joined.select(restored.alias("doc_id"), "text", "places").mapInArrow(cut, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: what stays of each document without strings of 100 bytes that stand earlier."""
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return found.select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
