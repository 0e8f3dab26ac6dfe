"""Artifacts of documents as a graph: lists and their items, tables, their rows and cells; order, ids, ancestors and integrity."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.operators.windows import numbered_ranges
from corvane.session import table
from corvane.storage import stored

TABLE_ROWS = "array<struct<row_id:string,cells:array<struct<column_id:string,text:string>>>>"


def running_total(rows: DataFrame, key: str, lead: list[str], place: str, rest: list[str], weight: str) -> DataFrame:
    """Adds before, the sum of weight over the rows of key that stand before a row by lead, place and rest.

    Rows are dealt into ranges of place, a number, between bounds that are fixed first; only the ranges' sums meet in one place,
    so a key with most of the rows is not one task's work. Rows of one place share a range.
    """
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2)
    bounds = rows.agg(F.percentile_approx(place, [i / n for i in range(1, n)]).alias("b")).first().b or []
    below = F.array(*map(F.lit, sorted(set(bounds)))).cast("array<long>")
    cell = [key, *lead, "_range"]
    ranged = rows.withColumn("_range", F.size(F.filter(below, lambda b: b < F.col(place))))
    earlier = Window.partitionBy(key).orderBy(*lead, "_range").rowsBetween(Window.unboundedPreceding, -1)
    bases = ranged.groupBy(*cell).agg(F.sum(weight).alias("_n")).select(*cell, F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*cell).orderBy(place, *rest).rowsBetween(Window.unboundedPreceding, -1)
    at = ranged.withColumn("_at", F.coalesce(F.sum(weight).over(inside), F.lit(0)))
    return at.join(bases, cell).withColumn("before", F.col("_at") + F.col("_base")).drop("_range", "_at", "_base")


def _units(artifacts: DataFrame, structured: DataFrame) -> DataFrame:
    """Tops, items and table rows, each with the number of nodes it stands for (a row: itself and its cells; a top that is an artifact's: none)."""
    none = F.lit(None).cast("string")
    cells = F.array().cast("array<struct<column_id:string,text:string>>")
    tops = artifacts.where("doc_id is not null").select(
        "doc_id", F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), F.lit(0).alias("row"), F.lit(1).alias("weight"),
        F.coalesce("id", F.concat(F.lit("artifact:"), F.col("place").cast("string"))).alias("top_id"), none.alias("tail"), "kind",
        F.coalesce("text", F.lit("")).alias("text"), F.lit("document").alias("origin"), none.alias("relation"), "items",
    )
    tops = tops.withColumns({"top_part": F.col("part"), "top_place": F.col("place")})
    step = F.col("kind") == "procedure"
    items = tops.where("kind in ('list', 'procedure')").select("*", F.posexplode("items").alias("i", "item")).withColumns(
        {
            "row": F.col("i") + 1, "tail": F.concat(F.lit(":item:"), (F.col("i") + 1).cast("string")), "text": F.coalesce("item", F.lit("")),
            "kind": F.when(step, "procedure_step").otherwise("list_item"), "relation": F.when(step, "has_step").otherwise("has_item"),
        }
    )
    named = structured.where("doc_id is not null").select(
        "doc_id", F.col("place").cast("long").alias("place"), "kind", "id", F.coalesce("text", F.lit("")).alias("text"),
        F.when(F.col("kind") == "table", F.coalesce("artifact_id", "id")).when(F.col("kind") == "key_value", F.col("artifact_id")).alias("of"), F.col("rows").cast(TABLE_ROWS).alias("rows"),
    )
    owners = tops.groupBy("doc_id", F.col("top_id").alias("of")).agg(F.min("place").alias("owner"))
    own_id = F.when(F.col("kind") == "table", F.coalesce("id", F.concat(F.lit("structured:table:"), "place"))).otherwise(F.concat_ws(":", F.lit("structured"), "kind", "place"))
    held = named.join(owners, ["doc_id", "of"], "left").withColumns(
        {
            "part": F.lit(1), "row": F.lit(0), "weight": F.col("owner").isNull().cast("int"), "top_id": F.when(F.col("owner").isNull(), own_id).otherwise(F.col("of")),
            "tail": none, "origin": F.lit("structured"), "relation": none,
            "top_part": F.when(F.col("owner").isNull(), 1).otherwise(0), "top_place": F.coalesce("owner", "place"),
        }
    )
    values = held.where("kind = 'key_value' and owner is not null").withColumns(
        {"row": F.lit(1), "weight": F.lit(1), "tail": F.concat(F.lit(":key_value:"), (F.col("place") + 1).cast("string")), "relation": F.lit("contains")}
    )
    lines = held.where("kind = 'table'").select("*", F.posexplode("rows").alias("i", "r"))
    lines = lines.withColumns({"cells": F.coalesce(F.col("r.cells"), cells), "row": F.col("i") + 1}).withColumns(
        {
            "weight": F.size("cells") + 1, "kind": F.lit("table_row"), "relation": F.lit("has_row"),
            "tail": F.concat(F.lit(":row:"), F.coalesce("r.row_id", F.col("row").cast("string"))),
            "text": F.trim(F.regexp_replace(F.array_join(F.transform("cells", lambda c: F.coalesce(c["text"], F.lit(""))), " | "), r"\s+", " ")),
        }
    )
    names = ["doc_id", "part", "place", "row", "weight", "top_id", "tail", "kind", "text", "origin", "relation", "top_part", "top_place"]
    plain = [x.select(*names, cells.alias("cells")) for x in (tops, items, held, values)]
    return reduce(DataFrame.unionByName, [*plain, lines.select(*names, "cells")])


def _raw(slots: DataFrame, marks: DataFrame | None) -> DataFrame:
    """Adds up, the id of a slot's parent, and raw, its own id but for the number that tells it from earlier ones with the same."""
    if marks is None:
        slots = slots.withColumns({"top_mark": F.lit(""), "row_mark": F.lit("")})
    else:
        suffix = F.concat(F.lit("#"), F.col("n").cast("string"))
        slots = slots.join(marks.select("doc_id", F.col("order").alias("top_order"), suffix.alias("top_mark")), ["doc_id", "top_order"], "left")
        slots = slots.join(marks.select("doc_id", F.col("order").alias("row_order"), suffix.alias("row_mark")), ["doc_id", "row_order"], "left")
        slots = slots.fillna("", ["top_mark", "row_mark"])
    top = F.concat("top_id", "top_mark")
    up = F.when(F.col("depth") == 1, top).when(F.col("depth") == 2, F.concat(top, "row_tail", "row_mark"))
    return slots.withColumn("up", up).withColumn("raw", F.when(F.col("depth") == 0, F.col("top_id")).otherwise(F.concat("up", "tail"))).drop("top_mark", "row_mark")


def _marks(named: DataFrame) -> DataFrame:
    """doc_id, order, n of the nodes whose raw id an earlier node of the document has: theirs is the n-th. Only ids that repeat are numbered."""
    repeated = named.groupBy("doc_id", "raw").agg(F.count("*").alias("c")).where("c > 1").drop("c")
    again = named.select("doc_id", "raw", "order").join(repeated, ["doc_id", "raw"]).select(F.struct("doc_id", "raw").alias("k"), "order")
    again = stored(again, "repeated")
    if again.isEmpty():
        return again.select("k.doc_id", "order", F.lit(1).cast("long").alias("n"))
    return stored(numbered_ranges(again, "k", [], "order").where("rank > 1").select("k.doc_id", "order", F.col("rank").alias("n")), "marks")


def _cells_apart(units: DataFrame) -> bool:
    """Whether no cell can have an id that another node has, once rows are numbered.

    A cell's id is its row's, :cell: and its column. It is no other node's where those ids have no :cell, and no other row's cell's where they have no #
    of their own, since numbered rows then differ; a row must not have a column twice.
    """
    path = F.concat_ws(" ", "top_id", "tail")
    columns = F.transform("cells", lambda c, i: F.coalesce(c["column_id"], (i + 1).cast("string")))
    odd = F.contains(path, F.lit(":cell")) | F.contains(path, F.lit("#")) | (F.size(F.array_distinct(columns)) < F.size("cells"))
    return units.where(odd).isEmpty()


def _settled(slots: DataFrame, marks: DataFrame | None) -> DataFrame | None:
    """The marks of slots, numbered from marks on until nothing changes; None if no id repeats."""
    while True:
        fresh = _marks(_raw(slots, marks))
        if marks is None and fresh.isEmpty() or marks is not None and fresh.exceptAll(marks).isEmpty() and marks.exceptAll(fresh).isEmpty():
            return marks
        marks = fresh


def _by_rounds(artifacts: DataFrame, structured: DataFrame) -> DataFrame:
    """graph_nodes() whatever the ids: they are numbered until nothing changes, as a node's number follows from earlier nodes only. Cells only where theirs can repeat."""
    at = running_total(stored(_units(artifacts, structured), "artifacts"), "doc_id", ["part"], "place", ["row"], "weight")
    units = stored(at.where("weight > 0"), "units")
    tops = units.where("row = 0").select("doc_id", F.col("part").alias("top_part"), F.col("place").alias("top_place"), F.col("before").alias("top_order"))
    placed = units.join(tops, ["doc_id", "top_part", "top_place"])
    base = ["doc_id", "top_order", "top_id", "origin"]
    rows = placed.select(*base, "kind", "text", "relation", "tail", F.col("before").alias("order"), F.lit(None).cast("long").alias("row_order"), F.lit(None).cast("string").alias("row_tail"), (F.col("row") > 0).cast("int").alias("depth"))
    cells = placed.select(*base, F.col("before").alias("row_order"), F.col("tail").alias("row_tail"), F.posexplode("cells").alias("i", "c")).select(
        *base, F.lit("table_cell").alias("kind"), F.coalesce("c.text", F.lit("")).alias("text"), F.lit("has_cell").alias("relation"),
        F.concat(F.lit(":cell:"), F.coalesce("c.column_id", (F.col("i") + 1).cast("string"))).alias("tail"),
        (F.col("row_order") + 1 + F.col("i")).alias("order"), "row_order", "row_tail", F.lit(2).alias("depth"),
    )
    slots = stored(rows.unionByName(cells), "slots")
    marks = _settled(slots.where("depth < 2"), None)  # cells follow from rows, which are far fewer
    if not _cells_apart(units):
        marks = _settled(slots, marks)
    named = _raw(slots, marks)
    own = named.withColumn("n", F.lit(1).cast("long")) if marks is None else named.join(marks, ["doc_id", "order"], "left")
    final = F.concat("raw", F.when(F.col("n") > 1, F.concat(F.lit("#"), F.col("n").cast("string"))).otherwise(""))
    return own.select("doc_id", "order", final.alias("id"), F.col("up").alias("parent_id"), "relation", "kind", "depth", "origin", "text")


def _cells(row: Column) -> Column:
    return F.coalesce(row["cells"], F.array().cast("array<struct<column_id:string,text:string>>"))


def _entries(artifacts: DataFrame, structured: DataFrame) -> DataFrame:
    """All artifacts (part 0) and structured ones (part 1), a row each, with inner, how many nodes they hold, and odd, whether an id below them could be another node's too."""
    none = F.lit(None).cast("string")
    text, place = F.coalesce("text", F.lit("")).alias("text"), F.col("place").cast("long").alias("place")
    items = F.when(F.col("kind").isin("list", "procedure"), F.col("items")).cast("array<string>")
    rows = F.when(F.col("kind") == "table", F.col("rows")).cast(TABLE_ROWS)
    plain = artifacts.select("doc_id", F.lit(0).alias("part"), place, "kind", "id", none.alias("artifact_id"), text, items.alias("items"), F.lit(None).cast(TABLE_ROWS).alias("rows"))
    other = structured.select("doc_id", F.lit(1).alias("part"), place, "kind", "id", "artifact_id", text, F.lit(None).cast("array<string>").alias("items"), rows.alias("rows"))

    inner = F.size(F.coalesce("items", F.array().cast("array<string>"))) + F.coalesce(F.aggregate("rows", F.lit(0), lambda n, r: n + 1 + F.size(_cells(r))), F.lit(0))
    columns = F.transform("rows", lambda r: F.transform(_cells(r), lambda c, j: F.coalesce(c["column_id"], (j + 1).cast("string"))))
    both = plain.unionByName(other).where("doc_id is not null").withColumns({"inner": inner, "columns": columns})

    def marked(names):
        together = F.array_join(names, "")
        return F.contains(together, F.lit(":")) | F.contains(together, F.lit("#"))

    odd = marked(F.flatten("columns")) | marked(F.col("rows.row_id")) | F.exists("columns", lambda c: F.size(F.array_distinct(c)) < F.size(c))
    return both.withColumn("odd", F.coalesce(odd, F.lit(False))).drop("columns")


#: Ids of tops that those of children can look like. What has no id of its own is named structured:, which only a top of that name can repeat.
_CHILDLIKE = "#|^structured$|(?<!^structured):(item|row|key_value|cell):[^:]*$"


def _places(entries: DataFrame) -> DataFrame:
    """doc_id, part, place of entries, held (whether an artifact has it), top (the id it or its owner starts with), weight (its nodes) and odd.

    A document with an odd entry can have ids that look like others' children, or rows of several tables below one artifact.
    """
    place = F.col("place").cast("string")
    table_id = F.coalesce("id", F.concat(F.lit("structured:table:"), place))
    own = F.when(F.col("part") == 0, F.coalesce("id", F.concat(F.lit("artifact:"), place))).when(F.col("kind") == "table", table_id).otherwise(F.concat_ws(":", F.lit("structured"), "kind", place))
    of = F.when(F.col("part") == 0, own).when(F.col("kind") == "table", F.coalesce("artifact_id", "id")).when(F.col("kind") == "key_value", F.col("artifact_id"))
    flat = entries.select("doc_id", "part", "place", (F.col("kind") == "table").alias("table"), (F.col("kind") == "key_value").alias("value"), "inner", "odd", own.alias("own"), of.alias("of"))
    owners = flat.where("of is not null").groupBy("doc_id", "of").agg(F.min(F.when(F.col("part") == 0, F.col("place"))).alias("owner"), F.count_if((F.col("part") == 1) & F.col("table")).alias("tables"))
    held = flat.where("part = 1").join(owners.where("owner is not null"), ["doc_id", "of"], "left").withColumn("held", F.col("owner").isNotNull())
    both = flat.where("part = 0").withColumns({"held": F.lit(False), "tables": F.lit(0)}).unionByName(held.drop("owner"))
    top = F.when(F.col("held"), F.col("of")).otherwise(F.col("own"))
    weight = F.col("inner") + F.when(~F.col("held"), 1).when(F.col("value"), 1).otherwise(0)
    odd = F.col("odd") | (~F.col("held") & F.col("own").rlike(_CHILDLIKE)) | F.coalesce(F.col("held") & F.col("table") & (F.col("tables") > 1), F.lit(False))
    return both.select("doc_id", "part", "place", "held", top.alias("top"), weight.alias("weight"), odd.alias("odd"))


def _runs(values: Column, n: Column) -> Column:
    """Where in an array of n values, n over 0, a value starts that differs from the one before."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda j: (j == 0) | (F.get(values, j) != F.get(values, j - 1)))


def _by_entries(entries: DataFrame, places: DataFrame) -> DataFrame:
    """graph_nodes() of documents without odd entries: ids repeat only among the rows of one table, so each entry's nodes follow from it and from what stands before it.

    places: doc_id, part, place, held, top, before. Rows of a table with the same id are numbered by sorting them; no step takes longer than that.
    """
    at = entries.drop("inner", "odd").join(places.hint("shuffle_hash"), ["doc_id", "part", "place"])
    some = F.size("rows") > 0
    at = at.withColumn("tails", F.sort_array(F.transform("rows", lambda r, i: F.struct(F.coalesce(r["row_id"], (i + 1).cast("string")).alias("id"), i.alias("i")))))
    at = at.withColumn("names", F.transform("tails", lambda t: t["id"])).withColumn("starts", F.when(some, _runs(F.col("names"), F.size("names"))))
    each = F.transform("starts", lambda s, k: F.transform(F.sequence(s, F.coalesce(F.get("starts", k + 1), F.size("tails")) - 1), lambda j: F.struct(F.get("tails", j)["i"].alias("i"), (j - s + 1).alias("n"))))
    at = at.withColumns({"numbers": F.sort_array(F.flatten(each)), "slots": F.flatten(F.transform("rows", lambda r, i: F.array_repeat(i, F.size(_cells(r)) + 1)))})
    at = at.withColumn("firsts", F.when(some, _runs(F.col("slots"), F.size("slots"))))
    cell = "array<struct<column_id:string,text:string>>"
    step, lead = F.col("kind") == "procedure", F.when(F.col("held"), 0).otherwise(1)

    def unit(offset, tail, relation, kind, text, cells=None):
        cells = F.array().cast(cell) if cells is None else cells
        return F.struct(offset.cast("int").alias("offset"), tail.cast("string").alias("tail"), relation.cast("string").alias("relation"), kind.cast("string").alias("kind"), text.alias("text"), cells.alias("cells"))

    def line(x, i):
        mark = F.when(x["numbers"]["n"] > 1, F.concat(F.lit("#"), x["numbers"]["n"].cast("string"))).otherwise("")
        tail = F.concat(F.lit(":row:"), F.coalesce(x["rows"]["row_id"], (i + 1).cast("string")), mark)
        text = F.trim(F.regexp_replace(F.array_join(F.transform(_cells(x["rows"]), lambda c: F.coalesce(c["text"], F.lit(""))), " | "), r"\s+", " "))
        return unit(x["firsts"] + lead, tail, F.lit("has_row"), F.lit("table_row"), text, _cells(x["rows"]))

    no = F.lit(None)
    own = F.when(~F.col("held"), F.array(unit(F.lit(0), no, no, F.col("kind"), F.col("text"))))
    value = F.when(F.col("held") & (F.col("kind") == "key_value"), F.array(unit(F.lit(0), F.concat(F.lit(":key_value:"), (F.col("place") + 1).cast("string")), F.lit("contains"), F.col("kind"), F.col("text"))))
    items = F.transform("items", lambda x, i: unit(i + 1, F.concat(F.lit(":item:"), (i + 1).cast("string")), F.when(step, "has_step").otherwise("has_item"), F.when(step, "procedure_step").otherwise("list_item"), F.coalesce(x, F.lit(""))))
    lines = F.transform(F.arrays_zip("rows", "numbers", "firsts"), line)
    units = at.select("doc_id", "part", "top", "before", F.inline(F.flatten(F.array_compact(F.array(own, value, items, lines)))))
    up = F.when(F.col("tail").isNotNull(), F.col("top"))
    units = units.withColumns({"id": F.concat("top", F.coalesce("tail", F.lit(""))), "up": up, "depth": up.isNotNull().cast("int")})
    first = F.struct(F.lit(0).alias("j"), F.col("id"), F.col("up").alias("parent_id"), F.col("relation"), F.col("kind"), F.col("depth"), F.col("text"))
    below = F.transform("cells", lambda c, j: F.struct(
        (j + 1).alias("j"), F.concat("id", F.lit(":cell:"), F.coalesce(c["column_id"], (j + 1).cast("string"))).alias("id"), F.col("id").alias("parent_id"),
        F.lit("has_cell").alias("relation"), F.lit("table_cell").alias("kind"), F.lit(2).alias("depth"), F.coalesce(c["text"], F.lit("")).alias("text"),
    ))
    nodes = units.select("doc_id", "part", (F.col("before") + F.col("offset")).alias("at"), F.inline(F.concat(F.array(first), below)))
    return nodes.select("doc_id", (F.col("at") + F.col("j")).alias("order"), "id", "parent_id", "relation", "kind", "depth", F.when(F.col("part") == 0, "document").otherwise("structured").alias("origin"), "text")


def graph_nodes(artifacts: DataFrame, structured: DataFrame) -> DataFrame:
    """doc_id, order, id, parent_id, relation, kind, depth, origin, text: the nodes of each document in reading order from 0.

    artifacts: doc_id, place, id, kind, text, items; the items of lists and procedures become children. structured: doc_id, place,
    kind (table, key_value, ocr_span), id, artifact_id, text, rows (TABLE_ROWS). A table belongs to the first artifact with its
    artifact_id (null: its own id), a key_value likewise without that second choice; whatever has none is a root of its own. Rows and their cells
    follow in order. place tells the rows of a document apart on each side. An id that an earlier node of the document has gets #2, #3
    and so on, which its children's ids carry. Null: ids become the place, texts empty, items and rows none; rows without doc_id have no graph.

    What an artifact holds is shuffled once, with what stands before it. Documents whose ids can look like others' children, whose artifacts share ids or
    have several tables go through rounds over their nodes instead.
    """
    entries = stored(_entries(artifacts, structured), "entries")
    places = stored(_places(entries), "places")
    twice = places.where("not held").groupBy("doc_id", F.xxhash64("top").alias("h")).agg(F.count("*").alias("c")).where("c > 1")
    odd = stored(places.where("odd").select("doc_id").union(twice.select("doc_id")).distinct(), "odd")
    before = running_total(places.drop("odd"), "doc_id", ["part"], "place", [], "weight").drop("weight")
    if odd.isEmpty():
        return _by_entries(entries, before)
    apart = entries.join(odd, "doc_id", "left_semi")
    return _by_entries(entries, before.join(odd, "doc_id", "left_anti")).unionByName(_by_rounds(apart.where("part = 0"), apart.where("part = 1")))


def edges(nodes: DataFrame) -> DataFrame:
    """doc_id, from_id, to_id, relation of graph_nodes()."""
    return nodes.where("parent_id is not null").select("doc_id", F.col("parent_id").alias("from_id"), F.col("id").alias("to_id"), "relation")


def diagnostics(nodes: DataFrame) -> DataFrame:
    """One row a document of graph_nodes(): nodes, edges, roots, structured roots without an artifact, renamed ids, kinds (map of counts) and warnings."""
    counted = nodes.groupBy("doc_id", "kind").agg(
        F.count("*").alias("n"), F.count("parent_id").alias("e"),
        F.count_if((F.col("origin") == "structured") & F.col("parent_id").isNull()).alias("o"),
        F.count_if(F.col("id").rlike("#[0-9]+$")).alias("d"),
    )
    whole = counted.groupBy("doc_id").agg(
        F.sum("n").alias("nodes"), F.sum("e").alias("edges"), F.sum("o").alias("orphans"), F.sum("d").alias("renamed"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("kind", "n")))).alias("kinds"),
    )
    warned = F.array_compact(F.array(F.when(F.col("orphans") > 0, "orphan_structured_artifacts"), F.when(F.col("renamed") > 0, "duplicate_artifact_ids")))
    return whole.withColumn("roots", F.col("nodes") - F.col("edges")).withColumn("warnings", warned)


def ancestry(nodes: DataFrame, doc: str = "doc_id", node: str = "id", parent: str = "parent_id") -> DataFrame:
    """One row for each distinct node (doc, id): copies, parent_id, root_id, depth and state (root, child, orphan, cycle).

    A node whose parent is nowhere in its document is an orphan and the root of what is below it. Nodes on a cycle, or below one, are
    in state cycle and have no root and depth. Of several rows with one id the smallest parent counts; a null id or doc has no row.

    Every node looks at an ancestor and in each round takes over that ancestor's, so the rounds are the logarithm of the depth. Depths leave no gap: a
    round that settles nobody leaves cycles only, and ends the rounds too.
    """
    rows = nodes.select(F.col(doc).alias("doc_id"), F.col(node).alias("id"), F.col(parent).alias("parent_id")).where("doc_id is not null and id is not null")
    known = rows.groupBy("doc_id", "id").agg(F.count("*").alias("copies"), F.min("parent_id").alias("parent_id"))
    there = known.select("doc_id", F.col("id").alias("parent_id"), F.lit(True).alias("there"))
    first = known.join(there, ["doc_id", "parent_id"], "left").select(
        "doc_id", "id", "copies", "parent_id", (F.col("parent_id").isNotNull() & F.col("there").isNull()).alias("orphan"),
        F.when(F.col("there"), F.col("parent_id")).otherwise(F.col("id")).alias("at"), F.col("there").isNotNull().cast("long").alias("steps"), F.col("there").isNotNull().alias("open"),
    )
    state, left = stored(first, "ancestry"), None
    while True:
        now = state.where("open").count()
        if now == 0 or now == left:
            break
        left = now
        other = state.select("doc_id", F.col("id").alias("at"), F.col("at").alias("_at"), F.col("steps").alias("_steps"), F.col("open").alias("_open"))
        moved = state.where("open").join(other, ["doc_id", "at"]).select(
            "doc_id", "id", "copies", "parent_id", "orphan", F.col("_at").alias("at"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_open").alias("open")
        )
        state = stored(state.where("not open").unionByName(moved), "ancestry")
    settled = ~F.col("open")
    return state.select(
        "doc_id", "id", "copies", "parent_id", F.when(settled, F.col("at")).alias("root_id"), F.when(settled, F.col("steps")).alias("depth"),
        F.when(F.col("open"), "cycle").when(F.col("orphan"), "orphan").when(F.col("steps") == 0, "root").otherwise("child").alias("state"),
    )


_BLOCK = r"(?s)<h[1-6](?:\s[^>]*)?>.*?</h[1-6]>|<p(?:\s[^>]*)?>.*?</p>|<ul(?:\s[^>]*)?>.*?</ul>|<ol(?:\s[^>]*)?>.*?</ol>|<table(?:\s[^>]*)?>.*?</table>"
_ITEM = r"(?s)<li(?:\s[^>]*)?>(.*?)</li>"
_LINE = r"(?s)<tr(?:\s[^>]*)?>(.*?)</tr>"
_CELL = r"(?s)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"


def _seen(html: Column) -> Column:
    """Text between tags, white space as one space, &lt; &gt; and &amp; as what they stand for."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), r"[ \t\r\n]+", " "))
    return F.replace(F.replace(F.replace(bare, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))


def html_artifacts(pages: DataFrame, key: str, html: str) -> tuple[DataFrame, DataFrame]:
    """artifacts and structured for graph_nodes() from whole HTML: headings, paragraphs, lists and tables in order.

    A block ends at the first end tag of its kind, so of lists within lists the inner one's end ends the outer one. Null: no blocks.
    """
    blocks = pages.select(F.col(key).alias("doc_id"), F.posexplode(F.regexp_extract_all(html, F.lit(_BLOCK), F.lit(0))).alias("place", "b"))
    head = F.lower(F.substring("b", 1, 3))
    kind = F.when(head.isin("<ul", "<ol"), "list").when(head.startswith("<h"), "heading").when(head == "<ta", "table").otherwise("paragraph")
    found = blocks.withColumns({"kind": kind, "id": F.concat(F.lit("artifact-"), (F.col("place") + 1).cast("string"))})
    items = F.when(F.col("kind") == "list", F.transform(F.regexp_extract_all("b", F.lit(_ITEM), F.lit(1)), _seen))
    rows = F.transform(
        F.regexp_extract_all("b", F.lit(_LINE), F.lit(1)),
        lambda r, i: F.struct(
            (i + 1).cast("string").alias("row_id"),
            F.transform(F.regexp_extract_all(r, F.lit(_CELL), F.lit(1)), lambda c, j: F.struct((j + 1).cast("string").alias("column_id"), _seen(c).alias("text"))).alias("cells"),
        ),
    )
    tables = found.where("kind = 'table'").select("doc_id", "place", "kind", F.concat(F.lit("table-"), (F.col("place") + 1).cast("string")).alias("id"), F.col("id").alias("artifact_id"), F.lit("").alias("text"), rows.alias("rows"))
    return found.select("doc_id", "place", "id", "kind", _seen(F.col("b")).alias("text"), items.alias("items")), tables


def _shown(nodes: DataFrame) -> DataFrame:
    return nodes.select("doc_id", "order", "id", "parent_id", "relation", "kind", F.col("depth").cast("int").alias("depth"), F.md5(F.col("text").cast("binary")).alias("text_md5"))


def _sql_seen(x: str) -> str:
    bare = f"trim(regexp_replace(regexp_replace({x}, '<[^>]*>', ' ', 'g'), '[ \\t\\r\\n]+', ' ', 'g'))"
    return f"replace(replace(replace({bare}, '&lt;', '<'), '&gt;', '>'), '&amp;', '&')"


@query(
    "graph_page_artifacts",
    f"""WITH l AS (SELECT page_id, regexp_extract_all(html, '{_BLOCK}') AS b FROM pages),
    b AS (SELECT page_id AS doc_id, unnest(range(len(b))) AS place, unnest(b) AS b FROM l),
    k AS (SELECT doc_id, place, b, 'artifact-' || (place + 1) AS id, CASE WHEN b[1:3] IN ('<ul', '<ol') THEN 'list' WHEN starts_with(b, '<h') THEN 'heading' WHEN b[1:3] = '<ta' THEN 'table' ELSE 'paragraph' END AS kind FROM b),
    i AS (SELECT doc_id, place, id, unnest(range(len(x))) + 1 AS item, unnest(x) AS x FROM (SELECT *, regexp_extract_all(b, '{_ITEM}', 1) AS x FROM k WHERE kind = 'list')),
    n AS (SELECT doc_id, place, 0 AS item, id, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS relation, kind, {_sql_seen('b')} AS t FROM k
      UNION ALL SELECT doc_id, place, item, id || ':item:' || item, id, 'has_item', 'list_item', {_sql_seen('x')} FROM i)
    SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY place, item) - 1 AS "order", id, parent_id, relation, kind, CAST(parent_id IS NOT NULL AS INTEGER) AS depth, md5(t) AS text_md5 FROM n""",
)
def graph_page_artifacts(spark, sf_dir):
    """Headings, paragraphs, lists and their items of all pages as nodes in reading order. (The given pages hold no tables; the SQL leaves their rows out.)"""
    return _shown(graph_nodes(*html_artifacts(table(spark, sf_dir, "pages"), "page_id", "html")))


def _order_tables(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """Customers as documents, their orders as tables of lines whose rows go by the return flag; finished orders have an artifact too."""
    orders = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc_id"), F.col("o_orderkey").alias("place"), F.concat(F.lit("order-"), "o_orderkey").alias("id"), "o_orderstatus")
    none = F.lit(None).cast("array<string>")
    artifacts = orders.where("o_orderstatus = 'F'").select("doc_id", "place", "id", F.lit("table").alias("kind"), F.col("id").alias("text"), none.alias("items"))
    line = F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")
    lines = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("place")).agg(F.sort_array(F.collect_list(line)).alias("lines"))

    def row(x):
        cells = F.array(*(F.struct(F.lit(n).alias("column_id"), x[c].cast("string").alias("text")) for n, c in (("part", "l_partkey"), ("ship", "l_linestatus"))))
        return F.struct(x["l_returnflag"].alias("row_id"), cells.alias("cells"))

    lines = lines.select("place", F.transform("lines", row).alias("rows"))
    tables = orders.join(lines, "place", "left").select("doc_id", "place", F.lit("table").alias("kind"), "id", F.lit(None).cast("string").alias("artifact_id"), F.col("id").alias("text"), "rows")
    return artifacts, tables


_ORDER_NODES = """l AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus) AS row, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_linenumber, l_partkey, l_suppkey, l_linestatus) AS k FROM lineitem),
    r AS (SELECT o_custkey AS doc_id, o_orderkey AS place, row, l_partkey, l_linestatus, 'order-' || o_orderkey AS top, 'order-' || o_orderkey || ':row:' || l_returnflag || CASE WHEN k > 1 THEN '#' || k ELSE '' END AS id FROM l JOIN orders ON l_orderkey = o_orderkey),
    n AS (SELECT o_custkey AS doc_id, CASE WHEN o_orderstatus = 'F' THEN 0 ELSE 1 END AS part, o_orderkey AS place, 0 AS row, 0 AS cell, 'order-' || o_orderkey AS id, CAST(NULL AS VARCHAR) AS parent_id, CAST(NULL AS VARCHAR) AS relation, 'table' AS kind, 'order-' || o_orderkey AS t FROM orders
      UNION ALL SELECT doc_id, 1, place, row, 0, id, top, 'has_row', 'table_row', l_partkey || ' | ' || l_linestatus FROM r
      UNION ALL SELECT doc_id, 1, place, row, 1, id || ':cell:part', id, 'has_cell', 'table_cell', CAST(l_partkey AS VARCHAR) FROM r
      UNION ALL SELECT doc_id, 1, place, row, 2, id || ':cell:ship', id, 'has_cell', 'table_cell', l_linestatus FROM r)"""


@query(
    "graph_order_tables",
    f"""WITH {_ORDER_NODES} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY part, place, row, cell) - 1 AS "order", id, parent_id, relation, kind, CASE kind WHEN 'table' THEN 0 WHEN 'table_row' THEN 1 ELSE 2 END AS depth, md5(t) AS text_md5 FROM n""",
)
def graph_order_tables(spark, sf_dir):
    """Table, row and cell nodes of all orders, rows with a repeated id renamed."""
    return _shown(graph_nodes(*_order_tables(spark, sf_dir)))


@query(
    "graph_diagnostics",
    f"""WITH {_ORDER_NODES} SELECT doc_id, count(*) AS nodes, count(parent_id) AS edges, count(*) - count(parent_id) AS roots, count(*) FILTER (part = 1 AND parent_id IS NULL) AS orphans, count(*) FILTER (contains(split_part(id, ':cell:', 1), '#') AND kind = 'table_row') AS renamed,
    concat_ws(',', CASE WHEN count(*) FILTER (part = 1 AND parent_id IS NULL) > 0 THEN 'orphan_structured_artifacts' END, CASE WHEN count(*) FILTER (kind = 'table_row' AND contains(id, '#')) > 0 THEN 'duplicate_artifact_ids' END) AS warnings,
    count(*) FILTER (kind = 'table_cell') AS cells FROM n GROUP BY 1""",
)
def graph_diagnostics(spark, sf_dir):
    d = diagnostics(graph_nodes(*_order_tables(spark, sf_dir)))
    return d.select("doc_id", "nodes", "edges", "roots", "orphans", "renamed", F.array_join("warnings", ",").alias("warnings"), F.coalesce(F.col("kinds")["table_cell"], F.lit(0)).alias("cells"))


@query(
    "graph_ancestry",
    """WITH RECURSIVE o AS (SELECT o_custkey AS doc_id, o_orderkey AS id, o_orderstatus, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS parent_id FROM orders),
    n AS (SELECT doc_id, id, parent_id FROM o WHERE o_orderstatus <> 'P'),
    t AS (SELECT doc_id, id, parent_id, id AS root_id, CAST(0 AS BIGINT) AS depth, CASE WHEN parent_id IS NULL THEN 'root' ELSE 'orphan' END AS state FROM n WHERE parent_id IS NULL OR parent_id NOT IN (SELECT id FROM n)
      UNION ALL SELECT n.doc_id, n.id, n.parent_id, t.root_id, t.depth + 1, 'child' FROM t JOIN n ON n.doc_id = t.doc_id AND n.parent_id = t.id)
    SELECT doc_id, id, parent_id, root_id, depth, state FROM t""",
)
def graph_ancestry(spark, sf_dir):
    """Chains of a customer's orders, each below the one before; pending ones are no nodes, so what follows them is orphaned."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    chain = table(spark, sf_dir, "orders").withColumn("parent_id", F.lag("o_orderkey").over(w)).where("o_orderstatus <> 'P'")
    return ancestry(chain, "o_custkey", "o_orderkey").select("doc_id", "id", "parent_id", "root_id", "depth", "state")
