"""Small tables for the operators' tests."""

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use inside; an input may have them too.
CLASH = ["row", "doc", "places", "fp", "component_id", "length", "start", "ids", "hits", "n_words", "_gone", "_once", "word", "pos", "term_id", "k", "_lines", "_removed", "bucket", "block", "cell", "key", "shard", "first", "best", "_row"]


def docs(spark, rows):
    """documents of (doc_id, text) or (doc_id, text, source)."""
    full = [(r[0], r[1], "en", r[2] if len(r) > 2 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    return spark.createDataFrame(full, DOCS)


def with_clashes(df):
    from pyspark.sql import functions as F

    return df.withColumns({c: F.lit("x") for c in CLASH})
