"""Chat formatting as a tree, and the pipeline."""

import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st

from pyspark.sql import functions as F

import corpus_pipeline
from corvane.llm import chat, decontamination, packing, similar, toxicity
from tests.llm.helpers import CLASH, docs, with_clashes


@given(st.text(alphabet="\\<[/sROLE]>blx \n"))
def test_escape_is_undone(text):
    e = chat.escape(text)
    assert chat.unescape(e) == text and "<" not in e and "[" not in e


def formatted(turns):
    return "".join(f"<s>[ROLE]{chat.escape(r)}[/ROLE]{chat.escape(t)}</s>" for r, t in turns)


@given(st.lists(st.tuples(st.text(alphabet="user<[\\"), st.text(alphabet="\\</s>[ROLE] x\n")), max_size=5))
def test_parse(turns):
    assert chat.parse(formatted(turns)) == turns


@pytest.fixture(scope="module")
def talks():
    rows = []
    for c in range(12):
        rows.append((c, 0, "user", "hello </s>[ROLE]"))
        rows.append((c, 1, "assistant", f"answer {c % 3} \\ <"))
        rows += [(c, 2 + t, ("user", "assistant")[t % 2], f"more {c % 4} {t}") for t in range(c % 5)]
    rows += [(50, 0, "user", None), (50, 0, "user", None), (51, None, None, "x"), (None, 3, "assistant", "é𝄞"), (52, 0, "assistant", "")]
    rows += [(60, t, "user", f"t{t}") for t in range(200)]
    return rows


def test_tree(spark, talks):
    df = with_clashes(spark.createDataFrame(talks, "conv_id long, turn long, role string, text string")).repartition(3)
    nodes, paths = chat.build_tree(df)
    by = {r.node: r for r in nodes.collect()}
    places = sorted((r.start, r.start + r.length) for r in by.values())
    assert places[0][0] == 0 and all(a[1] == b[0] for a, b in zip(places, places[1:], strict=False))
    for r in by.values():
        up, x = [], r
        while True:
            up.append((x.start, x.start + x.length))
            if not x.parent:
                break
            x = by[x.parent]
            assert x.start < up[-1][0]  # a parent comes first
        assert {p for a, b in up for p in range(a, b)} == {p for s in r.attends for p in range(s.start, s.end)}
        assert r.position == sum(b - a for a, b in up[1:])
    assert max(len(r.attends) for r in by.values()) < 12
    want = {}
    for c, t, r, x in talks:
        want.setdefault(c, []).append((t, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digests(chat.read_back(nodes, paths)).collect()}
    assert got.keys() == want.keys()
    for c, turns in want.items():
        turns = [(r, x) for _, r, x in sorted(turns, key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))]
        loss = "".join(x for r, x in turns if r == "assistant")
        sha = [hashlib.sha256(s.encode()).hexdigest() for s in ("".join(f"{r}\n{x}\n" for r, x in turns), loss)]
        assert (got[c].n_turns, got[c].turns_sha256, got[c].loss_chars, got[c].loss_sha256, got[c].formatted_chars) == (len(turns), sha[0], len(loss), sha[1], len(formatted(turns)))


def test_no_conversations(spark):
    nodes, paths = chat.build_tree(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))
    assert nodes.count() == 0 and chat.digests(chat.read_back(nodes, paths)).count() == 0


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "decontamination", "packing"]


def test_texts_of_stages_are_stored_small(spark):
    from corvane.llm.common import folders, number_rows, recorded

    with recorded() as made:
        kept = decontamination.remove_contaminated(docs(spark, [(i, "a text of words") for i in range(3)]), spark.createDataFrame([(1, "none of them")], "item_id int, text string"))
    assert kept.count() == 3
    names = [f for path in made if "/numbered-" in path for f in spark.read.parquet(path).inputFiles()]
    assert names and all(".zstd." in f for f in names)
    assert all(".snappy." in f for f in number_rows(spark.range(3), "row").inputFiles()) and folders(kept)


def test_pipeline_like_its_parts(spark):
    """Each stage does to its input what its operator, held against brute force elsewhere, decides."""
    import public_tokenizers
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    bad = {r.doc_id for r in toxicity.score(d, labels).where("predicted = 1").collect()}
    one = corpus_pipeline.drop_toxic(spark, d, sf)
    assert one.columns == d.columns and {r.doc_id for r in one.collect()} == {r.doc_id for r in d.collect()} - bad
    two = corpus_pipeline.drop_boilerplate_lines(spark, one, sf)
    assert two.columns == d.columns and all(r.n_chars == len(r.text) for r in two.collect()) and two.count() == one.count()
    three = corpus_pipeline.drop_near_duplicates(spark, two, sf)
    numbered = two.select(F.col("doc_id").alias("row"), "doc_id", "text")
    groups = {r.row: r.first for r in similar.groups(numbered).collect()}
    assert three.columns == d.columns and sorted(r.doc_id for r in three.collect()) == sorted(set(groups.values()))
    exact: dict = {}
    for r in two.collect():
        exact.setdefault(r.text, []).append(r.doc_id)
    kept = {r.doc_id for r in three.collect()}
    assert all(len(kept & set(same)) <= 1 for same in exact.values())
    four = corpus_pipeline.drop_contaminated(spark, three, sf)
    leaks = {r.doc_id for r in decontamination.report(three, bench).where("contaminated").collect()}
    left = {r.doc_id: r.text for r in four.collect()}
    assert four.columns == d.columns and set(left) == {r.doc_id for r in three.collect()} - leaks
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    t.encode_special_tokens = True
    n = {k: len(t.encode(x, add_special_tokens=False).ids) + 1 for k, x in left.items()}
    got = corpus_pipeline.run(spark, sf).collect()
    lengths: dict = {}
    for r in sorted(got, key=lambda r: r.start):
        lengths.setdefault(r.doc_id, []).append(r.length)
    assert lengths == {k: packing.piece_lengths(v, 2048) for k, v in n.items()}


def test_results_of_a_stage_can_be_held(spark):
    """Two results of one stage are both readable; their tables go once they are not referenced."""
    sf = "/root/testdata/sf0.001"
    d = spark.read.parquet(f"{sf}/documents.parquet")
    even, odd = corpus_pipeline.drop_contaminated(spark, d.where("doc_id % 2 = 0"), sf), corpus_pipeline.drop_contaminated(spark, d.where("doc_id % 2 = 1"), sf)
    both = even.count() + odd.count()
    made = {p for result, paths in corpus_pipeline._LEFT if result() is not None for p in paths}
    assert both == corpus_pipeline.drop_contaminated(spark, d, sf).count() and made
    del even, odd
    corpus_pipeline.clear_unused(spark, set())
    assert not made & {p for _, paths in corpus_pipeline._LEFT for p in paths}


def test_stages_keep_columns_of_their_own_names(spark):
    """Clashing columns come out as they went in, and rows without a doc_id or that repeat one are decided one by one."""
    sf = "/root/testdata/sf0.001"
    d = with_clashes(spark.read.parquet(f"{sf}/documents.parquet").limit(40))
    texts = [f"text number {i} has {' '.join(f'{w}{i}' for w in ('red', 'green', 'blue', 'black'))} words" for i in range(3)]
    more = with_clashes(docs(spark, [(None, texts[0]), (None, texts[0]), (None, texts[1]), (9000, texts[1]), (9000, texts[2]), (None, None)]))
    df = d.union(more.select(d.columns))
    for stage in [f for _, f in corpus_pipeline.STAGES[:-1]]:
        df = stage(spark, df, sf)
        assert df.columns == d.columns
        assert {tuple(r) for r in df.select(CLASH).distinct().collect()} == {("x",) * len(CLASH)}
    left = [(r.doc_id, r.text) for r in df.collect() if r.doc_id is None or r.doc_id == 9000]
    assert sorted(left, key=str) == sorted([(None, texts[0]), (9000, texts[1]), (9000, texts[2]), (None, None)], key=str)


def test_pipeline_of_no_documents(spark, tmp_path):
    docs(spark, []).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
