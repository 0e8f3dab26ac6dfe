"""Chat formatting over a prefix tree of conversations.

Conversations that share initial turns share the nodes of a tree: a node stands for one sequence of turns from the
start, and is named by a digest of them. The tree is emitted depth-first, each node's text once; positions
count code points. A node has position ids that go on from its parent's (position .. position + length) and
attends to itself and to its ancestors, whose places in the emission are listed as intervals.

Template of a turn: <s>[ROLE]role[/ROLE]text</s>. Inside role and text a backslash becomes \\\\, < becomes \\l
and [ becomes \\b, so no control string can stand in a text, and the escape is undone exactly.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import materialize, running_start

OPEN, MID, CLOSE = "<s>[ROLE]", "[/ROLE]", "</s>"
_TURN = re.compile(r"<s>\[ROLE\]([^<\[]*)\[/ROLE\]([^<\[]*)</s>")
_UNESCAPE = re.compile(r"\\(.)", re.S)
_PLAIN = {"\\": "\\", "l": "<", "b": "["}


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace("[", "\\b")


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: _PLAIN[m[1]], text)


def _escaped(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\b"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of each turn of a formatted conversation."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn begins at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"no turn begins at {at}")
    return found


def _paths(conversations: DataFrame) -> DataFrame:
    """conv_id, depth, role, text, node, parent: each turn with the digest of its conversation up to there."""

    def chain(batches):
        import pyarrow as pa

        for batch in batches:
            rows: list[list] = [[], [], [], [], [], []]
            for conv in batch.to_pylist():
                node = ""
                for depth, t in enumerate(conv["turns"]):
                    parent, turn = node, f"{parent_key(node)}{len(t['role'])}:{t['role']}{t['text']}"
                    node = hashlib.sha256(turn.encode("utf-8", "surrogatepass")).hexdigest()[:32]
                    for column, value in zip(rows, (conv["conv_id"], depth, t["role"], t["text"], node, parent), strict=True):
                        column.append(value)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.string()) for c in rows[2:])],
                ["conv_id", "depth", "role", "text", "node", "parent"],
            )

    def parent_key(node: str) -> str:
        return f"{node}/"

    turns = conversations.select(
        F.col("conv_id").cast("long"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    listed = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    schema = "conv_id long, depth int, role string, text string, node string, parent string"
    return listed.mapInArrow(chain, schema)


def build_tree(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, paths) of conversations (conv_id, turn, role, text).

    nodes: node, parent, depth, formatted, length, loss_from, loss_to (the assistant's text within formatted, else
    both 0), start (place in the depth-first emission), position (code points before it in its conversation),
    attends (the intervals of the emission that hold its ancestors and itself, from the root on; ancestors that follow
    each other there are one interval, so a long conversation's lists stay short). paths: conv_id, depth, node.

    Turns are ordered by turn, then role, then text; null roles and texts are empty; rows with a null conv_id are
    one conversation. A row that repeats is a turn of its own.
    """
    paths = materialize(_paths(conversations), "paths")
    each = paths.groupBy("node").agg(*(F.first(c).alias(c) for c in ("parent", "depth", "role", "text")))
    head = F.concat(F.lit(OPEN), _escaped(F.col("role")), F.lit(MID))
    is_loss = F.col("role") == "assistant"
    each = each.select(
        "node",
        "parent",
        "depth",
        F.concat(head, _escaped(F.col("text")), F.lit(CLOSE)).alias("formatted"),
        F.when(is_loss, F.char_length(head)).otherwise(0).alias("loss_from"),
        F.when(is_loss, F.char_length(F.concat(head, _escaped(F.col("text"))))).otherwise(0).alias("loss_to"),
    )
    each = materialize(each.withColumn("length", F.char_length("formatted").cast("long")), "nodes")
    # depth-first: conversations in the order of their paths, each with the nodes that no earlier one has
    listed = F.transform(F.array_sort(F.collect_list(F.struct("depth", "node"))), lambda x: x["node"])
    keys = paths.groupBy("conv_id").agg(F.array_join(listed, "/").alias("path")).withColumn("one", F.lit(1))
    ranks = running_start(keys, ["path", "conv_id"], "one", "rank").select(F.col("conv_id").alias("_conv"), "rank")
    walks = materialize(paths.join(ranks, paths.conv_id.eqNullSafe(ranks._conv)).select("rank", "depth", "node"), "walks")
    owned = walks.groupBy("node").agg(F.min("rank").alias("owner"), F.first("depth").alias("depth")).join(each.select("node", "length"), "node")
    placed = materialize(running_start(owned, ["owner", "depth"], "length", "start"), "placed")
    steps = walks.join(placed.select("node", "owner", "start", "length"), "node")
    by_conv = steps.groupBy("rank").agg(F.array_sort(F.collect_list(F.struct("depth", "node", "owner", "start", "length"))).alias("steps"))
    reached = by_conv.mapInArrow(_attention, "node string, position long, attends array<struct<start:long,end:long>>")
    nodes = each.join(placed.select("node", "start"), "node").join(reached, "node")
    return materialize(nodes, "tree"), paths.select("conv_id", "depth", "node")


def _attention(batches):
    """position and attends of the nodes that a conversation is the first to have; what follows on is one interval."""
    import pyarrow as pa

    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        names, positions, attends = [], [], []
        for conv in batch.to_pylist():
            at, intervals = 0, []
            for step in conv["steps"]:
                end = step["start"] + step["length"]
                if intervals and intervals[-1]["end"] == step["start"]:
                    intervals = [*intervals[:-1], {"start": intervals[-1]["start"], "end": end}]
                else:
                    intervals = [*intervals, {"start": step["start"], "end": end}]
                if step["owner"] == conv["rank"]:
                    names.append(step["node"])
                    positions.append(at)
                    attends.append(intervals)
                at += step["length"]
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(positions, pa.int64()), pa.array(attends, span)], ["node", "position", "attends"])


def read_back(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """conv_id, formatted, loss (intervals in formatted) of each conversation, put together from the emitted tree."""
    pieces = paths.join(nodes.select("node", "formatted", "loss_from", "loss_to", "position"), "node")
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("depth", "formatted", "loss_from", "loss_to", "position"))).alias("p"))
    loss = F.transform(
        F.filter("p", lambda x: x["loss_to"] > x["loss_from"]),
        lambda x: F.struct((x["position"] + x["loss_from"]).alias("from"), (x["position"] + x["loss_to"]).alias("to")),
    )
    return whole.select("conv_id", F.array_join(F.transform("p", lambda x: x["formatted"]), "").alias("formatted"), loss.alias("loss"))


def digests(formatted: DataFrame) -> DataFrame:
    """The digest columns of read_back()'s conversations, parsed from the formatted text."""

    def rows(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for c in batch.to_pylist():
                turns = parse(c["formatted"])
                masked = "".join(unescape(c["formatted"][x["from"] : x["to"]]) for x in c["loss"])
                said = "".join(f"{role}\n{text}\n" for role, text in turns)
                digest = [hashlib.sha256(x.encode("utf-8", "surrogatepass")).hexdigest() for x in (said, masked)]
                out.append((c["conv_id"], len(turns), digest[0], len(masked), digest[1], len(c["formatted"])))
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(x, pa.string() if i in (2, 4) else pa.int64()) for i, x in enumerate(columns)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    return formatted.mapInArrow(rows, schema)


CONTROL = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4: all conversations and one that says control strings, formatted and read back."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    extra = spark.sql(f"SELECT -1L AS conv_id, turn, role, '{CONTROL}' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    nodes, paths = build_tree(rows.unionByName(extra))
    return digests(read_back(nodes, paths))


def _sql_length(column: str) -> str:
    marks = " + ".join(f"(length({column}) - length(replace({column}, '{c}', '')))" for c in ("\\", "<", "["))
    return f"length({column}) + {marks}"


ORACLE = f"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(OPEN + MID + CLOSE)} + {_sql_length("role")} + {_sql_length("text")}) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
