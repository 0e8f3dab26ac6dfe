"""Operators against plain Python on small rows."""

import json
import math

import pytest
from pyspark.sql import functions as F

from corvane.functions import numbers, overlap, text, vectors
from corvane.operators import aggregates, evidence, filters, joins, retrieval, structure, windows
from corvane.sources import readers, sinks
from corvane.streaming import state


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x"))).first()[0]


@pytest.mark.parametrize(
    ("written", "value"),
    [("1.234,56", 1234.56), ("1,234.56", 1234.56), ("(12)", -12.0), ("-3,5", -3.5), ("1.234", 1234.0), ("12,345", 12345.0), ("7 %", 7.0), ("x", None), ("", None), (None, None)],
)
def test_local_number(spark, written, value):
    assert one(spark, written, numbers.local_number) == value


def test_text_functions(spark):
    assert one(spark, "İstanbul  IŞIK, a 7!", text.normalized) == "istanbul ışık a 7"
    assert one(spark, "İstanbul IŞIK, a 7!", text.tokens) == ["istanbul", "ışık", "7"]
    assert one(spark, "a\r\nb  \n\n\n\nc​ d", text.clean_document) == "a\nb\n\nc d"
    assert one(spark, "One. Two! Three", text.sentences) == ["One.", "Two!", "Three"]
    assert one(spark, "mail a@b.org or http://x.y", text.redacted) == "mail [email] or [url]"
    assert one(spark, "Ünal's Çay", text.slug) == "unal-s-cay"
    assert one(spark, None, text.normalized) is None


def test_fnv(spark):
    def plain(s):
        h = 2166136261
        for c in s:
            h = (h ^ ord(c)) * 16777619 & 0xFFFFFFFF
        return h

    for s in ("a", "hello", "word_word"):
        assert one(spark, s, vectors.fnv1a) == plain(s)


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 0.0]), ([1.0, 2.0], [2.0, 4.0]), ([1.0], [1.0, 2.0])], "a array<double>, b array<double>")
    assert [round(r[0], 9) for r in df.select(vectors.cosine(F.col("a"), F.col("b"))).collect()] == [0.0, 1.0, 0.0]


def fold(pieces, limit, joiner):
    out = []
    for p in pieces:
        if out and len(out[-1]) + len(joiner) + len(p) <= limit:
            out[-1] += joiner + p
        else:
            out.append(p)
    return out


def test_packed_like_a_loop(spark):
    pieces = ["a" * n for n in (3, 5, 2, 9, 1, 1, 1, 12, 4)]
    got = spark.createDataFrame([(pieces,), ([],)], "x array<string>").select(structure.packed(F.col("x"), 10, "--")).collect()
    assert got[0][0] == fold(pieces, 10, "--") and got[1][0] == []


def test_chunks_stay_within_limit(spark):
    body = "First one. " * 30 + "\n\n" + "x" * 50 + "\n\n" + "word " * 300
    rows = structure.chunks(spark.createDataFrame([(1, body), (2, ""), (3, None)], "doc_id long, text string"), 200).collect()
    assert {r.doc_id for r in rows} == {1} and all(len(r.content) <= 200 for r in rows)
    assert "".join("".join(r.content for r in rows).split()) == "".join(body.split())


def test_tables_and_records(spark):
    md = "|a|b|\n|-|-|\n|1|x|\n|2|y|\n|3|z|"
    assert one(spark, md, lambda c: structure.table_chunks(c, 2)) == ["|a|b|\n|-|-|\n|1|x|\n|2|y|", "|a|b|\n|-|-|\n|3|z|"]
    assert one(spark, "top\n## a\n1\n## b\n2", structure.record_chunks) == ["top\n## a\n1\n", "top\n## b\n2"]
    cells = evidence.markdown_cells(spark.createDataFrame([(1, md)], "id long, markdown string")).collect()
    assert sorted((r.row, r.header, r.cell, r.value) for r in cells)[:2] == [(0, "a", "1", 1.0), (0, "b", "x", None)]


def test_clamped_sum_depends_on_order(spark):
    df = spark.createDataFrame([(1, 1, 0.9), (1, 2, 0.9), (1, 3, -0.5)], "k int, t int, d double")
    assert aggregates.clamped_sum(df, "k", ["t"], "d").first().total == 0.5


def test_floor_and_scale(spark):
    df = spark.createDataFrame([(1, 10, 4.0), (1, 11, 2.0), (1, 12, 1.0), (2, 13, 0.5)], "q int, d int, s double")
    assert sorted(r.d for r in filters.above_floor(df, "q", "s").collect()) == [10, 11]
    assert {r.d: r.x for r in windows.scaled(df, "q", "s", "x").collect()} == {10: 1.0, 11: pytest.approx(1 / 3), 12: 0.0, 13: 0.5}


def test_fuzzy_join_misses_no_pair(spark):
    names = ["steel bolt", "steel bolts", "brass nut", "brass nuts", "tin can", "", "steel  bolt"]
    df = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r.left_id, r.right_id) for r in joins.trigram_candidates(df, df, 0.6).collect()}
    grams = [{f" {n} "[i : i + 3] for i in range(max(len(n), 1))} for n in names]
    assert got == {(i, j) for i, a in enumerate(grams) for j, b in enumerate(grams) if len(a & b) / len(a | b) >= 0.6}


def test_bm25_like_a_loop(spark):
    docs = {1: "red fox red", 2: "blue fox", 3: "green tree tall tree"}
    queries = {7: "red fox fox", 8: "absent"}
    d = spark.createDataFrame(list(docs.items()), "doc_id long, text string")
    q = spark.createDataFrame(list(queries.items()), "query_id long, text string")
    got = {(r.query_id, r.doc_id): r.score for r in retrieval.bm25(q, d).collect()}
    mean = sum(len(t.split()) for t in docs.values()) / 3
    want = {}
    for i, t in docs.items():
        w, s, hits = t.split(), 0.0, 0
        for term, qf in (("red", 1), ("fox", 2)):
            tf, df = w.count(term), sum(term in x.split() for x in docs.values())
            if tf:
                hits += 1
                s += math.log(1 + (3 - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean)) * (1 + 0.2 * (qf - 1))
        if hits:
            want[7, i] = s + 0.75 * hits / 2
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)


def test_overlap_scores():
    a = "the cat sat on the mat".split()
    assert overlap.lcs_f1(a, a) == 1 and overlap.bleu(a, a) == pytest.approx(1)
    assert overlap.lcs_f1(a, "the mat".split()) == pytest.approx(0.5) and overlap.lcs_f1([], a) == 0 == overlap.bleu(a, [])


def test_html_text(spark):
    page = "<html><style>x{}</style><h1>Title &amp; more</h1><p>One <b>two</b></p><script>no()</script><li>three</html>"
    df = spark.createDataFrame([(page,), (None,), ("",)], "h string")
    assert [r[0] for r in df.select(readers.html_text("h")).collect()] == ["Title & more\nOne two\nthree", None, ""]


def test_readers(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id;name\n1;"x;y"\n2;z\n')
    assert [tuple(r) for r in readers.read_csv(spark, str(tmp_path / "a.csv")).collect()] == [("1", "x;y"), ("2", "z")]
    (tmp_path / "b.jsonl").write_text('{"a": 1}\nbroken\n')
    assert [r.a for r in readers.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int").collect()] == [1, None]
    (tmp_path / "c.json").write_text('{ "b" : [1, 2] }')
    assert json.loads(readers.read_json(spark, str(tmp_path / "c.json")).first().json) == {"b": [1, 2]}
    (tmp_path / "d.md").write_text("# t\n\nbody")
    assert readers.read_text(spark, str(tmp_path / "d.md")).first().text == "# t\n\nbody"


def test_uploads(spark, tmp_path):
    files = [("a.pdf", b"%PDF-1"), ("b.pdf", b"nope"), ("c.txt", b"ok"), ("d.txt", b"\xff\xfe"), ("e.json", b"{"), ("f.txt", b""), ("g.txt", b"ok")]
    df = spark.createDataFrame([(n, bytearray(b)) for n, b in files], "path string, content binary")
    got = {r.path: r.p for r in df.select("path", readers.upload_problems(F.col("path"), F.col("content")).alias("p")).collect()}
    assert got == {"a.pdf": [], "b.pdf": ["not-pdf"], "c.txt": [], "d.txt": ["not-text"], "e.json": ["not-json"], "f.txt": ["empty"], "g.txt": []}
    readers.land(df, str(tmp_path / "raw"), str(tmp_path / "bad"))
    assert spark.read.parquet(str(tmp_path / "raw")).count() == 2 and spark.read.parquet(str(tmp_path / "bad")).count() == 4


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
    assert sorted(tuple(r) for r in sinks.upsert(df, spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string"), "k").collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_folds_like_the_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = state.event_stream(spark, str(tmp_path / "in"), events.schema)
    seen: dict = {}

    def take(batch, number):
        seen.update({r.user_id: tuple(r) for r in batch.collect()})

    q = state.fold_stream(stream).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).foreachBatch(take).start()
    q.awaitTermination()
    assert seen == {r.user_id: tuple(r) for r in state.read_model(events).collect()}


def test_stream_goes_on_from_its_checkpoint(spark, tmp_path):
    schema = "id int, ts timestamp"
    rows = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:00:01"), (2, "2024-01-01 00:00:02")], "id int, ts string")
    rows = rows.select("id", F.to_timestamp("ts").alias("ts"))
    rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    got: list = []

    def run():
        stream = state.once(state.event_stream(spark, str(tmp_path / "in"), schema), "id", "ts", "1 hour")
        state.run_available(stream, str(tmp_path / "c"), lambda b, i: got.extend(r.id for r in b.collect()))

    run()
    rows.where("id = 2").union(rows.where("id = 1").selectExpr("3", "ts")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run()
    assert sorted(got) == [1, 2, 3]


def test_ingest_retries(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 2), (3, "x" * 100, 0), (4, "short", 0)], "doc_id int, text string, attempt int")
    assert {r.doc_id: r.stage for r in state.ingest(df).collect()} == {1: "RETRY", 2: "FAILED", 3: "READY", 4: "PARTIAL_READY"}


def test_unwrapped(spark):
    assert one(spark, "a long line that\ngoes on. \nNew one with a hy-\nphen\n\n- item\n- item 2\nrest", text.unwrapped) == "a long line that goes on.\nNew one with a hyphen\n\n- item\n- item 2 rest"
    assert one(spark, "", text.unwrapped) == "" and one(spark, None, text.unwrapped) is None


def test_card_fields(spark):
    card = "Topic: x: y\nTags: a, b\nSummary:\nTwo\nlines"
    assert [one(spark, card, lambda c, n=n: text.card_field(c, n, ["Topic", "Tags", "Summary"])) for n in ("Topic", "Tags", "Summary", "Other")] == ["x: y", "a, b", "Two\nlines", None]


def test_sanitized(spark):
    assert one(spark, '{"b": 1, "a": {"x": 2}, "c": null, "d": "long"}', lambda c: numbers.sanitized(c, 8, 2)) == '{"b":"1","d":"lo"}'
    assert one(spark, "no json", numbers.sanitized) in (None, "{}")


def test_records_are_numbered_without_gathering_a_source(spark, tmp_path):
    import hashlib

    rows = [(i * 7 % 101, "en" if i % 3 else "de", "a" if i % 4 else "b") for i in range(101)]
    spark.createDataFrame(rows, "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    found = structure.structure_record_chunks(spark, str(tmp_path))
    assert "collect_list" not in found._jdf.queryExecution().toString()
    want = set()
    for s in "ab":
        own = sorted(r for r in rows if r[2] == s)
        for i, (k, lang, _) in enumerate(own):
            md = f"# {s}\n## {k}\n{lang}" + ("\n" if i < len(own) - 1 else "")
            want.add((s, i, hashlib.md5(md.encode()).hexdigest()))
    assert {tuple(r) for r in found.collect()} == want


def test_no_records(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    assert structure.structure_record_chunks(spark, str(tmp_path)).collect() == []

#: A list in Turkish order.
TURKISH = ["apple", "cam", "çam", "Isparta", "ışık", "irmak", "İzmir", "ova", "öz", "sarı", "şeker", "Zor"]


def test_turkish_order(spark):
    df = spark.createDataFrame([("k", n) for n in reversed(TURKISH)] + [("j", "şa"), ("j", "sz")], "k string, name string").repartition(3)
    got = {(r.k, r["rank"]): r.name for r in windows.collated_ranks(df, "k", "name").collect()}
    assert [got["k", i + 1] for i in range(len(TURKISH))] == TURKISH and [got["j", 1], got["j", 2]] == ["sz", "şa"]


def test_identifier_beside_letters_beyond_ascii(spark, tmp_path):
    rows = [(2, "x ABCDEFGHIJK y"), (3, "ÉABCDEFGHIJKÉ"), (5, "aABCDEFGHIJK"), (7, "ABCDEFGHIJK_"), (9, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert sorted(r[0] for r in filters.filter_explicit_identifier(spark, str(tmp_path)).collect()) == [2, 3]


def test_two_stages_keep_the_first_of_equals(spark, tmp_path):
    rows = [(k, 1, 50.0, "1-URGENT") for k in range(12)] + [(k, 2, 50.0 if k < 22 else 100.0, "1-URGENT" if k < 22 else "none") for k in range(20, 24)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderpriority string").write.parquet(str(tmp_path / "orders.parquet"))
    assert sorted(map(tuple, windows.sort_two_stage(spark, str(tmp_path)).collect())) == [(1, 0), (2, 22)]


def test_copies_of_a_name_are_compared_once(spark):
    df = spark.createDataFrame([(i, "small ring") for i in range(40)] + [(100, "small rings"), (101, "anvil"), (102, None), (103, "")], "id long, name string")
    names = joins.similar_names(df.select(F.col("name").alias("l")), df.select(F.col("name").alias("r")), 0.6)
    want = {("small ring", "small ring"), ("small ring", "small rings"), ("small rings", "small ring"), ("small rings", "small rings"), ("anvil", "anvil")}
    assert {(r.l, r.r) for r in names.collect() if r.l} == want
    got = joins.trigram_candidates(df.where("id % 20 = 0"), df, 0.6)
    rows = [(r.left_id, r.right_id) for r in got.collect() if r.left_id != 103]
    assert sorted(rows) == sorted((a, b) for a in (0, 20) for b in [*range(40), 100]) + [(100, b) for b in [*range(40), 100]]


@pytest.mark.parametrize("sent", [joins.MOST_SENT, -1])
def test_blocks_of_copies_are_all_pairs(spark, monkeypatch, sent):
    """Names with fewer and with far more rows than a block, ids that repeat and null ones, with and without blocks that go to every task."""
    monkeypatch.setattr(joins, "BLOCK", 8)
    monkeypatch.setattr(joins, "MOST_SENT", sent)
    rows = [(i, "small ring") for i in range(300)] + [(500, "small rings"), (501, "anvil"), (502, None), (7, "anvil"), (None, "anvil"), (501, "anvil")]
    df = spark.createDataFrame(rows, "id long, name string")
    got = joins.trigram_candidates(df.where("id % 20 = 0"), df, 0.6, digits=2).collect()
    ring = [i for i in range(300)] + [500]
    want = [(a, b) for a in [*range(0, 300, 20), 500] for b in ring]
    assert sorted((r.left_id, r.right_id) for r in got) == sorted(want) and all(r.jaccard == round(r.jaccard, 2) for r in got)
    ids = joins.trigram_candidates(df.where("id = 501"), df, 0.6).collect()
    assert sorted(map(str, ((r.left_id, r.right_id) for r in ids))) == sorted(map(str, 2 * [(501, 501), (501, 7), (501, None), (501, 501)]))


def test_pairs_of_copies_take_little_room(spark, tmp_path):
    """The result is the square of a name's copies; as blocks its columns are runs and repeated stretches."""
    names = ["small ring", "brass bolt", "tin can", "blue anvil"]
    df = spark.range(0, 20_000, 1, 4).select("id", F.element_at(F.array(*map(F.lit, names)), (F.xxhash64("id") % 4 + 4).cast("int") % 4 + 1).alias("name"))
    joins.trigram_candidates(df.where("id % 50 = 0"), df, 0.6).write.parquet(str(tmp_path / "out"))
    files = list((tmp_path / "out").glob("*.parquet"))
    n = spark.read.parquet(str(tmp_path / "out")).count()
    assert n > 1_900_000 and sum(f.stat().st_size for f in files) < n
