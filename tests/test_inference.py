"""Artifacts of whole texts against a loop over their lines, golden cases, chunks."""

import random
import re
import time

from pyspark.sql import functions as F

from corvane.operators.inference import artifact_chunks, inferred, text_graph

LINES = [
    "", "", " ", "# Guide", "## Options  and more", "### Deep", "###### six", "####### seven", "# # twice", "## https://x.org/a", "Page 3", "## Page 4", "page 0", "Page x",
    "https://a.b/c", "http://a.b c", "Rapor Mart 2024", "x" * 150 + " mart 2024", "Hafta 3 - 4", "HAZİRAN 2024", "haziran 2024 sonu", "aralık 2021", "şubat 2020",
    "- one", "* two", "+ three", "1. go", "2) stop", "Steps:", "| a | b |", "|---|---|", "| 1 | 2 |", "```", "~~~", "x = 1", "```js", "Kuyruk nedir", "NEDİR bu", "NEDIR bu", "a plain line.",
    "\u00a0indented\t", "Copyright 2024 me", "- ", "|",
]


def by_loop(text):
    """(kind, text, title, page, path, items) of a text's artifacts."""
    out, block, title, page, stack = [], [], None, None, []

    def footer(t):
        month = r"\b(?:ocak|şubat|subat|mart|nisan|mayıs|mayis|haziran|temmuz|ağustos|agustos|eylül|eylul|ekim|kasım|kasim|aralık|aralik)\s+20[0-9]{2}\b"
        ascii_edges = re.compile(month, re.I | re.A)
        return bool(re.search(r"(?i)^hafta\s+[0-9]+(\s*[-–]\s*[0-9]+)?$", t) or len(t) <= 140 and ascii_edges.search(t))

    def flush():
        if not block and text.strip():
            return
        t = "\n".join(block)
        body = block[1:] if len(block) >= 3 and block[0].endswith(":") else block
        ordered = [x for x in body if re.match(r"[0-9]+[.)]\s+\S", x)]
        marked = [x for x in body if re.match(r"([-*+]\s+|[0-9]+[.)]\s+)\S", x)]
        if len(t) >= 6 and t[:3] in ("```", "~~~") and t[-3:] == t[:3]:
            kind = "code_block"
        elif any(len(x) > 1 and x[0] == x[-1] == "|" for x in block):
            kind = "table"
        elif len(ordered) >= 2:
            kind = "procedure"
        elif len(body) >= 2 and len(marked) == len(body):
            kind = "list"
        elif re.search(r"(?a:\b)nedir(?a:\b)", t.replace("I", "ı").replace("İ", "i").lower()):
            kind = "definition"
        else:
            kind = "paragraph"
        items = [x for x in (re.sub(r"^([-*+]\s+|[0-9]+[.)]\s+)", "", b).strip() for b in body) if x] if kind in ("list", "procedure") else []
        out.append((kind, t, title, page, [h for _, h in stack], items or None))
        block.clear()

    for raw in text.split("\n"):
        t = raw.strip()
        head, mark = re.match(r"(#{1,6})\s+(.+)$", t), re.match(r"(?i)#{0,6}\s*page\s+([0-9]+)$", t)
        one = None
        if mark:
            one = "page_marker"
        elif head:
            one = "title" if len(head[1]) == 1 else "heading"
        elif re.match(r"(?i)https?://\S+$", t):
            one = "url"
        elif t and footer(t):
            one = "footer"
        if t and not one:
            block.append(t)
            continue
        if block:
            flush()
        if not one:
            continue
        shown = t
        if mark:
            page, shown = int(mark[1]) or page, re.sub(r"^#+\s*", "", t)
        if one in ("title", "heading"):
            shown = re.sub(r"^#{1,6}\s*", "", re.sub(r"[ \t]+", " ", head[2]))
            shown = "" if shown.startswith("http") else shown
            title = shown
            while stack and stack[-1][0] >= len(head[1]):
                stack.pop()
            stack.append((len(head[1]), shown))
        out.append((one, shown, title, page, [h for _, h in stack], None))
    if block or not out:
        flush()
    return out


def test_as_by_a_loop(spark):
    r = random.Random(9)
    texts = ["\n".join(r.choice(LINES) for _ in range(r.randrange(1, 40))) for _ in range(120)] + ["", None, " \n\n", "# only", "one\r\ntwo\r\n\r\nthree"]
    rows = inferred(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id", "place").collect()
    for d, text in enumerate(texts):
        mine = [x for x in rows if x.doc_id == d]
        assert [x.place for x in mine] == list(range(len(mine)))
        assert [(x.kind, x.text, x.title, x.page, x.path, x.items) for x in mine] == by_loop((text or "").replace("\r\n", "\n")), text
    assert {x.kind for x in rows} == {"title", "heading", "page_marker", "url", "footer", "table", "list", "procedure", "code_block", "definition", "paragraph"}
    assert [(x.kind, x.text, x.score) for x in rows if x.doc_id == 121] == [("paragraph", "", 0)]


def test_golden_guidance(spark):
    text = "# Handbook\n\nBir kuyruk, işleri tutan yapıyı ifade eder.\n\n## Choices\n\n- Look\n- Accept\n\n## Steps\n\n1. Open it\n2. Confirm it\n\n## Code\n\n```ts\nconst a = 1;\n```\n\n| k | v |\n|---|---|\n| a | 1 |"
    a = inferred(spark.createDataFrame([(1, text, "x")], "doc_id long, text string, kind string"))
    assert [x.kind for x in artifact_chunks(a).orderBy("chunk_index").collect()] == ["definition", "list", "procedure", "code_block", "table"]
    nodes = text_graph(a).collect()
    assert {"definition", "list", "list_item", "procedure", "procedure_step", "code_block", "table", "table_row", "table_cell"} <= {n.kind for n in nodes}
    assert len({n.id for n in nodes}) == len(nodes) and [n.text for n in sorted(nodes, key=lambda n: n.order) if n.kind == "table_cell"] == ["k", "v", "a", "1"]


def test_chunks_cover_their_artifacts(spark):
    long_table = "| k | v |\n|---|---|\n" + "\n".join(f"| row {i} | {i * 7} |" for i in range(300))
    prose = " ".join(f"Sentence number {i} says a little." for i in range(400))
    text = f"# T\n\nPage 2\n\n{long_table}\n\n## P\n\n{prose}\n\n{'y' * 2000}"
    chunks = artifact_chunks(inferred(spark.createDataFrame([(1, text), (2, "# head\nPage 3")], "doc_id long, text string"))).orderBy("chunk_index").collect()
    assert [c.chunk_index for c in chunks] == list(range(len(chunks))) and {c.doc_id for c in chunks} == {1}
    tables = [c.content for c in chunks if c.kind == "table"]
    assert all(t.startswith("| k | v |\n|---|---|\n") and len(t) <= 900 for t in tables)
    assert "\n".join(t.split("\n", 2)[2] for t in tables) == long_table.split("\n", 2)[2]
    told = [c for c in chunks if c.kind == "paragraph"]
    assert " ".join(" ".join(c.content.split()) for c in told[:-1]) == prose and told[-1].content == "y" * 2000
    assert all(c.path == ["T", "P"] and c.page == 2 and c.title == "P" for c in told)


def test_graph_stores_its_artifacts_once(spark, monkeypatch):
    from corvane.operators import inference

    named, stored = [], inference.stored
    monkeypatch.setattr(inference, "stored", lambda df, name: named.append(name) or stored(df, name))
    texts = spark.createDataFrame([(1, "# A\n\n- x\n- y\n\n| a | b |\n|---|---|\n| 1 | 2 |")], "doc_id long, text string")
    assert inference.text_graph(inference.inferred(texts)).count() > 5 and named == ["inferred"]


def test_a_text_is_looked_at_whole_once(spark):
    """A text of 40,000 lines: trimming the whole text for each line took the square of its length."""
    text = "\n".join(f"line {i} of a text without an end" if i % 7 else "" for i in range(40_000))
    begun = time.monotonic()
    rows = spark.createDataFrame([(1, text), (2, " \n\t\n"), (3, None), (4, "")], "doc_id long, text string")
    got = {r.doc_id: (r.n, r.score) for r in inferred(rows).groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("score").alias("score")).collect()}
    assert got == {1: (5715, 68 * 5715), 2: (1, 0), 3: (1, 0), 4: (1, 0)}
    assert time.monotonic() - begun < 40


def test_kinds_are_worked_out_once(spark):
    plan = artifact_chunks(inferred(spark.createDataFrame([(1, "a")], "doc_id long, text string")))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ne demek") == 1
