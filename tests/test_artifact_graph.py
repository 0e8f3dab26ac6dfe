"""The artifact graph against a loop over a document's artifacts, and ancestry on planted damage."""

import random

from corvane.operators.artifact_graph import TABLE_ROWS, ancestry, diagnostics, edges, graph_nodes, html_artifacts

ARTIFACTS = "doc_id long, place long, id string, kind string, text string, items array<string>"
STRUCTURED = f"doc_id long, place long, kind string, id string, artifact_id string, text string, rows {TABLE_ROWS}"


def by_loop(artifacts, structured):
    """(id, parent, relation, kind) of one document, one after the other."""
    out, seen, first = [], {}, {}

    def put(raw, parent, relation, kind):
        seen[raw] = seen.get(raw, 0) + 1
        out.append((raw if seen[raw] == 1 else f"{raw}#{seen[raw]}", parent, relation, kind))
        return out[-1][0]

    for _, place, raw, kind, _, items in sorted(artifacts, key=lambda a: a[1]):
        top = put(raw or f"artifact:{place}", None, None, kind)
        first.setdefault(raw, top)
        if kind in ("list", "procedure"):
            for i, _ in enumerate(items or []):
                put(f"{top}:item:{i + 1}", top, "has_step" if kind == "procedure" else "has_item", "procedure_step" if kind == "procedure" else "list_item")
    for _, place, kind, raw, of, _, rows in sorted(structured, key=lambda a: a[1]):
        owner = of or raw if kind == "table" else of if kind == "key_value" else None
        held = owner is not None and owner in first
        top = first[owner] if held else put(raw if kind == "table" else f"structured:{kind}:{place}", None, None, kind)
        if kind == "table":
            for i, (row_id, cells) in enumerate(rows or []):
                row = put(f"{top}:row:{row_id or i + 1}", top, "has_row", "table_row")
                for j, (column, _) in enumerate(cells or []):
                    put(f"{row}:cell:{column or j + 1}", row, "has_cell", "table_cell")
        elif kind == "key_value" and held:
            put(f"{top}:key_value:{place + 1}", top, "contains", "key_value")
    return out


def test_nodes_as_by_a_loop(spark):
    r = random.Random(5)
    # ids that repeat, and ids that look like those of children of others
    ids = ["a", "b", "a:item:1", "a#2", "t", "t:row:1", "t:row:1:cell:x", None]
    artifacts, structured = [], []
    for doc in range(25):
        for place in range(r.randrange(9)):
            artifacts.append((doc, place, r.choice(ids), r.choice(["list", "procedure", "table", "paragraph"]), "x", r.choice([None, [], ["u", None, "v"]])))
        for place in range(r.randrange(7)):
            kind = r.choice(["table", "table", "key_value", "ocr_span"])
            rows = [(r.choice(["1", "2", None]), r.choice([None, [], [("x", "1"), (r.choice(["x", None]), None)]])) for _ in range(r.randrange(4))]
            structured.append((doc, place, kind, r.choice(["t", "u"]), r.choice(["a", "t", "gone", None]), "y", r.choice([None, rows, rows])))
    nodes = graph_nodes(spark.createDataFrame(artifacts, ARTIFACTS), spark.createDataFrame(structured, STRUCTURED)).collect()
    for doc in range(25):
        mine = sorted((n for n in nodes if n.doc_id == doc), key=lambda n: n.order)
        assert [n.order for n in mine] == list(range(len(mine)))
        assert [(n.id, n.parent_id, n.relation, n.kind) for n in mine] == by_loop([a for a in artifacts if a[0] == doc], [s for s in structured if s[0] == doc])
    assert any("#" in n.id for n in nodes) and any(n.depth == 2 for n in nodes)


def test_html_tables_and_lists(spark):
    html = "<h1>T</h1><table><tr><th>k</th><th>v</th></tr><tr><td>a &amp; b</td><td> 2\n</td></tr></table><ul><li>one</li><li><b>two</b></li></ul><p class='x'>end</p>"
    pages = spark.createDataFrame([(1, html, 9), (2, None, 9), (3, "", 9)], "page_id long, html string, place int")
    nodes = graph_nodes(*html_artifacts(pages, "page_id", "html"))
    rows = sorted(nodes.collect(), key=lambda n: n.order)
    assert [(n.kind, n.text) for n in rows if n.depth == 0] == [("heading", "T"), ("table", "k v a & b 2"), ("list", "one two"), ("paragraph", "end")]
    assert [(n.id, n.text) for n in rows if n.kind == "table_cell"] == [(f"artifact-2:row:{i}:cell:{j}", t) for i, j, t in ((1, 1, "k"), (1, 2, "v"), (2, 1, "a & b"), (2, 2, "2"))]
    assert [n.text for n in rows if n.kind == "list_item"] == ["one", "two"]
    assert edges(nodes).count() == 8
    (d,) = diagnostics(nodes).collect()
    assert (d.nodes, d.edges, d.roots, d.orphans, d.renamed, d.warnings) == (12, 8, 4, 0, 0, []) and d.kinds["table_cell"] == 4


def test_ancestry_of_damaged_graphs(spark):
    chain = [(1, f"n{i}", f"n{i - 1}" if i else None) for i in range(300)]
    damage = [(2, "a", "b"), (2, "b", "c"), (2, "c", "a"), (2, "below", "a"), (2, "self", "self"), (2, "lost", "gone"), (2, "under", "lost"), (2, "under", "lost"), (2, None, "a"), (None, "a", None)]
    found = {(r.doc_id, r.id): r for r in ancestry(spark.createDataFrame(chain + damage, "doc_id long, id string, parent_id string")).collect()}
    assert all((found[1, f"n{i}"].root_id, found[1, f"n{i}"].depth, found[1, f"n{i}"].state) == ("n0", i, "child" if i else "root") for i in range(300))
    assert {k[1] for k, r in found.items() if r.state == "cycle"} == {"a", "b", "c", "below", "self"}
    assert all(r.root_id is None and r.depth is None for r in found.values() if r.state == "cycle")
    assert (found[2, "lost"].state, found[2, "under"].root_id, found[2, "under"].copies, found[2, "under"].depth) == ("orphan", "lost", 2, 1)
    assert len(found) == 307


def test_no_rows(spark):
    nodes = graph_nodes(spark.createDataFrame([], ARTIFACTS), spark.createDataFrame([], STRUCTURED))
    assert nodes.count() == 0 and ancestry(nodes).count() == 0


def test_cells_are_numbered_only_where_theirs_can_repeat(spark, monkeypatch):
    from corvane.operators import artifact_graph

    seen, marks = [], artifact_graph._marks
    monkeypatch.setattr(artifact_graph, "_marks", lambda named: seen.append(named.where("kind = 'table_cell'").count()) or marks(named))
    for row_id, column, cells_numbered in (("r", "y", False), ("r", "x", True), ("r#2", "y", True)):
        seen.clear()
        table = (1, 0, "table", "t", None, "", [("r", [("x", "1"), (column, "2")]), (row_id, [("x", "3")]), ("r", None)])
        nodes = graph_nodes(spark.createDataFrame([], ARTIFACTS), spark.createDataFrame([table], STRUCTURED)).collect()
        assert [n.id for n in sorted(nodes, key=lambda n: n.order)] == [n[0] for n in by_loop([], [table])]
        assert any(seen) == cells_numbered


def test_rounds_are_for_documents_with_odd_ids(spark, monkeypatch):
    """Ids that repeat among a table's rows need no rounds over all nodes; a document with ids like others' children, or with two tables of one artifact, does."""
    from corvane.operators import artifact_graph

    r = random.Random(9)
    asked, rounds = [], artifact_graph._by_rounds
    monkeypatch.setattr(artifact_graph, "_by_rounds", lambda a, s: asked.append(sorted({x.doc_id for y in (a, s) for x in y.select("doc_id").collect()})) or rounds(a, s))
    artifacts, structured = [], []
    for doc in range(30):
        for place in range(0, 12, 2):
            artifacts.append((doc, place, r.choice([f"a{place}", f"a:{place}", None]), r.choice(["list", "procedure", "table", "paragraph"]), "x", r.choice([None, [], ["u", None, "v"]])))
        for place in range(r.randrange(9)):
            kind = r.choice(["table", "table", "key_value", "ocr_span"])
            rows = [(r.choice(["1", "2", "A", None]), r.choice([None, [], [("x", "1"), (r.choice(["y", None]), " p  q ")]])) for _ in range(r.randrange(7))]
            of = r.choice(["a4", f"gone{place}", None]) if kind == "key_value" else r.choice([a[2] for a in artifacts[-6:] if a[1] == place] or [None])
            structured.append((doc, place, kind, f"t{place}", of, "y", r.choice([None, rows, rows, rows])))
    structured.append((30, 0, "table", "t", None, "", [(str(i % 3), [("c", str(i))]) for i in range(3000)]))
    plain = list(artifacts), list(structured)
    artifacts += [(31, 0, "a#2", "list", "", ["u"]), (32, 0, "a", "table", "", None), (33, 0, "a:item:1", "list", "", ["u"]), (34, 0, "a", "list", "", []), (34, 1, "a", "list", "", ["u"])]
    structured += [(32, i, "table", f"t{i}", "a", "", [("r", [("x", "1")])]) for i in range(2)] + [(35, 0, "table", "t", None, "", [("r", [("x", "1"), ("x", "2")])]), (36, 0, "table", "t", None, "", [("r:row:1", None)])]
    for (a, s), odd in ((plain, []), ((artifacts, structured), [[31, 32, 33, 34, 35, 36]])):
        asked.clear()
        nodes = graph_nodes(spark.createDataFrame(a, ARTIFACTS), spark.createDataFrame(s, STRUCTURED)).collect()
        assert asked == odd and any("#3" in n.id for n in nodes)
        for doc in range(37):
            mine = sorted((n for n in nodes if n.doc_id == doc), key=lambda n: n.order)
            assert [n.order for n in mine] == list(range(len(mine)))
            assert [(n.id, n.parent_id, n.relation, n.kind) for n in mine] == by_loop([x for x in a if x[0] == doc], [x for x in s if x[0] == doc])
