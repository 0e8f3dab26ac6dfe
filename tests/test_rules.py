"""Folds, parse quality, ranking, routing and readers against plain Python and small cases."""

import random
import re
import unicodedata

import pytest
from pyspark.sql import functions as F

from corvane import registry
from corvane import registry
from corvane.functions import folds
from corvane.functions.overlap import answer_score
from corvane.operators import evidence, feedback, quality, ranking, routing
from corvane.sources import readers

SF = "/root/testdata/sf0.001"


def variants(word):
    def soft(w):
        return [w] + ([w[:-1] + {"g": "k", "b": "p", "d": "t"}[w[-1]]] if len(w) >= 4 and w[-1] in "gbd" else [])

    out = soft(word)
    drawn = re.sub(r"([^\W\d_])\1{2,}", r"\1", word)
    if drawn != word and len(drawn) >= 3:
        out += soft(drawn)
    for w in list(out):
        out += [w[: -len(e)] + full for e, n, full in folds.SPOKEN if len(w) >= n and w.endswith(e)]
    for e in folds.ENDINGS:
        if word.endswith(e) and len(word) - len(e) >= 3:
            out += soft(word[: -len(e)])
    return set(out)


def test_word_variants_like_a_loop(spark):
    words = ["kitabimizdan", "geliyom", "geliyo", "agriyon", "cokkkk", "sagliiiig", "evlerinden", "ab", "kanad", "yoyo", "dolabi", "evde", "aaaa"]
    rng = random.Random(1)
    words += ["".join(rng.choice("aeiklmnrdgbyo") for _ in range(rng.randrange(3, 6))) + rng.choice(["", *folds.ENDINGS, "iyom", "yon"]) for _ in range(300)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    for r in df.select("w", folds.word_variants(F.col("w")).alias("v")).collect():
        assert set(r.v) == variants(r.w), r.w
        assert len(set(r.v)) == len(r.v)


def test_compatibility_forms_like_the_library(spark):
    texts = ["ﬁne ①②", "Ｆｕｌｌ ｗｉｄｔｈ", "plain", "é é", None, "", "ş İ ı", "½ kg™"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", folds.nfkc(F.col("t")).alias("n"), folds.mark_fold(F.col("t")).alias("m")).collect()
    assert all(r.n == (None if r.t is None else unicodedata.normalize("NFKC", r.t)) for r in got)
    assert {r.t: r.m for r in got}["ş İ ı"] == "s i i"


def test_scrubbed_contacts(spark):
    df = spark.createDataFrame([("Call **  us.\nTel: 0312 555 - 12 now  mail: a@b.co end Randevu icin arayin",), (None,)], "t string")
    assert [r[0] for r in df.select(folds.scrub_contacts(F.col("t"))).collect()] == ["Call us. now end", None]


@pytest.mark.parametrize(
    "text, kind, chunks, average, level, has, ocr",
    [
        ("", "TEXT", 0, 0.0, "noisy", {"very_short_text", "no_chunks"}, 0),
        ("# Plan\n\n" + "- A list item with enough words to be read.\n" * 20, "MARKDOWN", 2, 400.0, "clean", set(), 0),
        ("A�b " * 200, "TEXT", 1, 800.0, "noisy", {"replacement_char_detected", "ocr_risk_high", "high_symbol_noise"}, 100),
        ("x Ã Ã Ã " + "word " * 100, "TEXT", 1, 500.0, "usable", {"possible_mojibake"}, 9),
        ("short line\n" * 40 + "z" * 200, "TEXT", 1, 640.0, "usable", {"fragmented_lines"}, 0),
        ("|a|b|\n|1|2|\n" + "12 USD gelir " * 60, "TEXT", 1, 800.0, "clean", {"table_like_content"}, 0),
        ("1234567890 ab " * 60, "TEXT", 1, 840.0, "usable", {"dense_numbers_without_table_structure", "low_structural_signal"}, 0),
    ],
)
def test_parse_quality(spark, text, kind, chunks, average, level, has, ocr):
    df = quality.parse_signals(spark.createDataFrame([(text, kind, chunks, average)], "text string, kind string, chunks int, average double"))
    score, risk, warnings = quality.parse_quality()
    r = df.select(score.alias("s"), risk.alias("o"), warnings.alias("w"), quality.level(score, quality.CLEAN, quality.USABLE).alias("l")).first()
    assert has <= set(r.w) and r.l == level and r.o == ocr and 0 <= r.s <= 100
    report = quality.ingestion_report(score, risk, warnings)
    t = df.select(*[c.alias(k) for k, c in report.items()]).first()
    assert t.thin_source == (r.s < 48 or bool({"very_short_text", "fragmented_lines"} & set(r.w))) and t.strict_eligible != t.thin_source


def test_complementary_choice_like_a_loop(spark):
    rng = random.Random(2)
    names = ["a", "b", "c", "d"]
    rows = []
    for q in range(60):
        for d in range(8):
            rows.append((q, d, round(rng.uniform(-1, 4), 3), rng.random() < 0.2, rng.random() < 0.3, rng.sample(names, rng.randrange(3))))
    df = spark.createDataFrame(rows, "query_id long, doc_id long, det_score double, strict boolean, unlike boolean, matched array<string>")
    got: dict = {}
    for r in ranking.complementary(df).collect():
        got.setdefault(r.query_id, {})[r.place] = r.doc_id
    for q in range(60):
        mine = sorted((r for r in rows if r[0] == q and (r[2] > 0 or (r[5] and not r[4]))), key=lambda r: (-r[2], r[1]))
        have, chosen = set(), []
        for r in mine:
            if r[3] or set(r[5]) - have:
                chosen.append(r[1])
                have |= set(r[5])
            if len(chosen) == 4:
                break
        chosen = chosen or [r[1] for r in mine][:4]
        assert [x for _, x in sorted(got.get(q, {}).items())] == chosen


def test_rule_score(spark):
    rows = [(1, 1, "what city is it", "the city is big", ["big"], 1.0), (1, 2, "what city is it", "scum of the road", ["city"], 1.0), (1, 3, "hello there", "licensed text hello", [], 0.5)]
    df = spark.createDataFrame(rows, "query_id long, doc_id long, query string, card string, tags array<string>, fused double")
    got = {r.doc_id: r for r in ranking.rule_scored(df).collect()}
    assert got[1].matched == ["place"] and not got[1].strict  # one of the two intents
    assert got[1].det_score == pytest.approx(1 + 0.35 * 2 + 1.2 - 2)
    assert got[2].unlike and got[2].det_score == pytest.approx(1 + 0.5 - 4 - 2.5)
    assert got[3].strict and got[3].det_score == pytest.approx(0.5 + 0.35 - 0.8)


def test_light_score(spark):
    rows = [("find part AB12CD now please?", "t", "x" * 70 + " AB12CD find", 1.0, 0.7), ("find part", "t", "nothing", 1.0, 0.0)]
    df = spark.createDataFrame(rows, "query string, title string, text string, lexical double, vector double")
    got = [r[0] for r in df.select(ranking.pre_rank_score(["find"])).collect()]
    assert got == [pytest.approx(2 + 0.35 + 0.75 + 2.1 + 10), pytest.approx(-1)]


def test_route(spark):
    rules = [
        ("medical", "pain", ["kasik", "alt karin"], ["triage"], ["pain"], ["severe"]),
        ("medical", "fever", ["fever"], ["check"], ["fever"], []),
        ("legal", "fine", ["ticket", "fine"], ["objection"], ["law"], []),
    ]
    texts = ["Kasigimda severe pain", "alt karin and fever", "a ticket, a fine", "nothing fits", "fever ticket", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: r for r in routing.route(df, "k", "t", rules, ["medical", "legal"]).collect()}
    assert (got[0].domain, got[0].subtopics, got[0].risk, got[0].confidence) == ("medical", ["pain"], "high", "medium")
    assert (got[1].domain, got[1].subtopics, got[1].hints, got[1].risk, got[1].confidence) == ("medical", ["pain", "fever"], ["triage", "check"], "medium", "high")
    assert (got[2].domain, got[2].must_include, got[2].confidence) == ("legal", ["law"], "high")
    assert (got[3].domain, got[3].risk, got[3].confidence) == ("general", "low", "low") == (got[5].domain, got[5].risk, got[5].confidence)
    assert got[4].domain == "medical"


def test_requested_fields(spark):
    fields = [("margin", ["net profit margin of the year", "Kâr-marjı"]), ("cash", ["nakit akış"]), ("of", ["of the"])]
    texts = ["The Net_Profit margin","profit margin year", "nakit ve akis", "akis only", "out of the box", "", None]
    df = spark.createDataFrame(list(enumerate(texts)), "k long, t string")
    got = {r.k: (r.fields, r.coverage) for r in evidence.requested_fields(df, "t", fields).collect()}
    assert [got[k][0] for k in range(7)] == [["margin"], ["margin"], ["cash"], [], ["of"], [], []]
    assert got[0][1] == pytest.approx(1 / 3, abs=1e-6) and got[6][1] == 0


def test_safety_gate(spark):
    schema = "k int, answer string, retrieved boolean, mode string, grounding string, candidates int, failed boolean, dropped int, usable int, sources array<string>, cited array<string>, collections array<string>, accessible array<string>"
    fine = (0, "yes", True, "auto", "high", 2, False, 0, 1, ["a"], ["a"], ["c"], ["c"])

    def but(k, **changes):
        names = [x.split()[0] for x in schema.split(", ")]
        return tuple(changes.get(n, k if n == "k" else v) for n, v in zip(names, fine, strict=True))

    rows = [
        fine,
        but(1, answer=None),
        but(2, sources=[], cited=[], usable=0),
        but(3, mode="no_source"),
        but(4, failed=True, dropped=3),
        but(5, dropped=1),
        but(6, cited=["z"]),
        but(7, collections=["c", "p"], answer=" "),
        but(8, candidates=9, mode="suggest", sources=[], retrieved=False),
        (9, *[None] * 12),
    ]
    got = {r.k: (r.reasons, r.warnings, r.status, r.fallback) for r in evidence.safety_gate(spark.createDataFrame(rows, schema)).collect()}
    assert got[0] == ([], [], "pass", None)
    assert got[1] == (["EMPTY_ANSWER"], [], "rewrite", "domain_safe")
    assert got[2] == (["MISSING_SOURCES", "NO_USABLE_FACTS"], [], "rewrite", "low_grounding")
    assert got[3] == (["NO_SOURCE_MODE_WITH_SOURCES"], [], "rewrite", "domain_safe")
    assert got[4] == (["QUERY_SOURCE_MISMATCH"], [], "rewrite", "source_suggestion")
    assert got[5] == ([], ["QUERY_SOURCE_MISMATCH"], "warn", None)
    assert got[6] == (["SOURCE_METADATA_MISMATCH"], [], "rewrite", "privacy_safe")
    assert got[7] == (["EMPTY_ANSWER", "PRIVATE_SOURCE_SCOPE_MISMATCH"], [], "block", "privacy_safe")
    assert got[8] == ([], ["SUGGEST_MODE_NO_GROUNDED_SOURCES", "TOO_MANY_CONTEXT_CHUNKS_FOR_3B"], "warn", "source_suggestion")
    assert got[9] == (["EMPTY_ANSWER"], [], "rewrite", "domain_safe")


def test_adapter_benchmark(spark):
    answers = spark.createDataFrame([("x", 1, "a b c"), ("x", 2, "d"), ("y", 1, "zzz")], "adapter string, case_id long, answer string")
    hidden = spark.createDataFrame([(1, "a b c"), (2, "e"), (3, "f")], "case_id long, reference string")
    got = {r.adapter: (r.cases, r.answered, r.score) for r in feedback.adapter_benchmark(answers, hidden).collect()}
    one = spark.createDataFrame([("a b c", "a b c")], "p string, q string").select(answer_score(F.col("p"), F.col("q"))).first()[0]
    assert got == {"x": (3, 2, round(one / 3, 4)), "y": (3, 1, 0.0)}


def test_files_have_their_own_delimiter(spark, tmp_path):
    (tmp_path / "a.csv").write_text("x,y\n1,2\n")
    (tmp_path / "b.csv").write_text('x;y\n3;"4;5"\n')
    (tmp_path / "c.csv").write_text("y\tz\n6\t7\n")
    got = {tuple(r) for r in readers.read_csv(spark, str(tmp_path)).select("x", "y", "z").collect()}
    assert got == {("1", "2", None), ("3", "4;5", None), (None, "6", "7")}
    assert [readers.column_letters(i) for i in (0, 25, 26, 27, 51, 52, 701, 702)] == ["A", "Z", "AA", "AB", "AZ", "BA", "ZZ", "AAA"]


def test_bucket_quota_like_a_loop(spark):
    got = [tuple(r) for r in registry.QUERIES["window_bucket_quota"](spark, SF).collect()]
    rows = sorted(spark.read.parquet(f"{SF}/orders.parquet").collect(), key=lambda r: (-r.o_totalprice, r.o_orderkey))
    taken: dict = {}
    for name, fits in (("large", lambda r: r.o_totalprice > 300000), ("urgent", lambda r: r.o_orderpriority == "1-URGENT"), ("filled", lambda r: r.o_orderstatus == "F")):
        for r in [r for r in rows if fits(r) and r.o_orderkey not in taken][:3]:
            taken[r.o_orderkey] = name
    for r in rows:
        if len(taken) < 20:
            taken.setdefault(r.o_orderkey, "fill")
    assert dict(got) == taken and len(got) == 20


LINES = ["a;b;c;d", "a;;b;c;d", "a,b\tc;d", "a,,,b", "a,b,c|d,e", "a,\nb,\n\nc,\nd", "a;\nb;\nc;", "x\na,b,c,d\ny", "a;\t\nb, ,\t\nc", " ,a,b", ";a;b;c;d"]


def test_delimited_lines_like_the_pattern(spark):
    """Against DuckDB's engine, which runs the pattern itself; long lines don't exhaust the stack."""
    import random

    import duckdb

    rng = random.Random(0)
    texts = LINES + ["".join(rng.choices("ab;,\t\n |", [6, 6, 2, 4, 1, 3, 2, 0.4], k=rng.randrange(1, 22))) for _ in range(3000)]
    texts += [x * 100_000 for x in (",b", "a;", "a,\n")] + ["a" + ",b" * 100_000 + "|", "a" + ";b" * 100_000, "1" + ".234" * 2_000 + " TL"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, text string").repartition(4)
    found = [quality.delimited(F.col("text")), *[quality.holds(F.col("text"), p) for p in [quality.TABLES[0], *quality.TABLES[2:], *quality.STRUCTURE]]]
    got = dict(df.select("i", F.array(*found).alias("x")).collect())
    rel = duckdb.sql("SELECT unnest(?) AS text", params=[texts])
    patterns = [quality.TABLES[1], quality.TABLES[0], *quality.TABLES[2:], *quality.STRUCTURE]
    want = rel.select(", ".join(f"regexp_matches(text, '{p}')" for p in patterns)).fetchall()
    assert [tuple(got[i]) for i in range(len(texts))] == want


@pytest.mark.parametrize("name", ["quality_ocr_risk", "quality_parse", "quality_ingestion_report"])
def test_each_pattern_is_looked_for_once(spark, name):
    plan = registry.QUERIES[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(quality.MOJIBAKE) == 1
