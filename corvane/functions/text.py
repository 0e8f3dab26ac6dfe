"""Text expressions: normalising, tokenising, splitting, extracting, redacting. All are built-in column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.session import table

#: Letters that fold to ASCII.
FOLD_FROM, FOLD_TO = "çğıİöşü", "cgiiosu"
STOP_WORDS = ["the", "and", "for", "with", "that", "this", "from", "are", "was", "of", "to", "in", "is", "on", "by", "an", "as", "at"]
#: A rule set of our own: patterns of personal data and what takes their place, in the order they are applied.
PII = [
    (r"(?i)[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}", "[email]"),
    (r"(?i)https?://[^\s]+", "[url]"),
    (r"\b[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}\b", "[iban]"),
    (r"\b0x[0-9a-fA-F]{40,64}\b", "[wallet]"),
    (r"\b[0-9]{11}\b", "[national-id]"),
    (r"\+?[0-9][0-9 ()-]{8,}[0-9]", "[phone]"),
    (r"\b[0-9a-f]{16,}\b", "[hex-id]"),
]


def normalized(text: Column) -> Column:
    """Lower-cased with dotted and dotless I told apart; all but letters, digits and white space become spaces."""
    lowered = F.lower(F.translate(text, "Iİ", "ıi"))
    return F.trim(F.regexp_replace(F.regexp_replace(lowered, r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def tokens(text: Column) -> Column:
    """Words of normalized() that have two characters or a digit."""
    return F.filter(F.split(normalized(text), " "), lambda t: (F.length(t) > 1) | t.rlike("[0-9]"))


def plain_tokens(text: Column) -> Column:
    """Lower-case words of two characters or more, cut at anything but letters and digits."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: F.length(t) > 1)


def concept(text: Column) -> Column:
    """Letters folded to ASCII, then lower-cased; _ and - become spaces and white space collapses."""
    folded = F.lower(F.translate(F.translate(text, FOLD_FROM, FOLD_TO), "I", "ı"))
    return F.trim(F.regexp_replace(F.regexp_replace(folded, "[_-]+", " "), r"\s+", " "))


def clean_document(text: Column) -> Column:
    """Line ends made one kind, odd spaces plain, zero-width characters gone, at most one blank line in a row."""
    lines = F.regexp_replace(F.regexp_replace(text, "\r\n?", "\n"), "\f", "\n\n")
    spaced = F.regexp_replace(F.regexp_replace(lines, "[   ]", " "), "[​‌‍﻿]", "")
    return F.trim(F.regexp_replace(F.regexp_replace(spaced, "[ \t]+\n", "\n"), "\n{3,}", "\n\n"))


def sentences(text: Column) -> Column:
    """Sentences: cut after . ! or ? that white space follows, and at line ends."""
    marked = F.regexp_replace(text, r"([.!?])\s+", "$1\n")
    return F.filter(F.transform(F.split(marked, "\n"), lambda s: F.trim(s)), lambda s: s != "")


def trigrams(text: Column) -> Column:
    """Trigrams of the text between one space on either side, in order and with repeats."""
    padded = F.concat(F.lit(" "), F.lower(text), F.lit(" "))
    return F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - 2, F.lit(1))), lambda i: F.substring(padded, i, F.lit(3)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of two arrays' distinct members that they have in common; 0 if both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / union)


def redacted(text: Column) -> Column:
    """Personal data replaced by the names of its kinds."""
    for pattern, name in PII:
        text = F.regexp_replace(text, pattern, name)
    return text


def slug(text: Column) -> Column:
    folded = F.lower(F.translate(text, FOLD_FROM + "ÇĞÖŞÜ", FOLD_TO + "CGOSU"))
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def excerpt(text: Column, words: int) -> Column:
    return F.array_join(F.slice(F.split(F.trim(F.regexp_replace(text, r"\s+", " ")), " "), 1, words), " ")


def token_estimate(text: Column) -> Column:
    """About as many tokens as a quarter of the characters, one at least."""
    return F.greatest(F.lit(1), F.ceil(F.length(text) / 4)).cast("long")


def short_hash(text: Column) -> Column:
    return F.substring(F.sha2(F.trim(text), 256), 1, 16)


def stems(token: Column, suffixes: list[str]) -> Column:
    """The token and what is left of it, three letters or more, without each suffix that it ends with."""
    cut = F.transform(
        F.filter(F.array(*map(F.lit, suffixes)), lambda s: F.endswith(token, s) & (F.length(token) - F.length(s) >= 3)),
        lambda s: F.substring(token, F.lit(1), F.length(token) - F.length(s)),
    )
    return F.array_distinct(F.concat(F.array(token), cut))


# --- queries ---------------------------------------------------------------------------------------------------

_WORDS = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: length(t) > 1)"
_NORM = (
    "trim(regexp_replace(regexp_replace(lower(translate(text, 'Iİ', 'ıi')), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
)


@query(
    "text_normalize_tokens",
    f"""WITH n AS (SELECT doc_id, {_NORM} AS norm FROM documents)
    SELECT doc_id, md5(norm) AS norm_md5,
      CAST(len(list_filter(string_split(norm, ' '), lambda t: length(t) > 1 OR regexp_matches(t, '[0-9]'))) AS INTEGER) AS n_tokens
    FROM n""",
)
def text_normalize_tokens(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.md5(normalized(F.col("text")).cast("binary")).alias("norm_md5"), F.size(tokens(F.col("text"))).alias("n_tokens"))


@query(
    "text_concept_fold",
    """SELECT DISTINCT trim(regexp_replace(regexp_replace(lower(translate(translate(w, 'çğıİöşü', 'cgiiosu'), 'I', 'ı')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')) AS concept, w AS word
    FROM (SELECT unnest(string_split_regex(text, '[ \\n]+')) AS w FROM documents) WHERE w <> ''""",
)
def text_concept_fold(spark, sf_dir):
    words = table(spark, sf_dir, "documents").select(F.explode(F.split("text", "[ \n]+")).alias("word")).where("word != ''").distinct()
    return words.select(concept(F.col("word")).alias("concept"), "word")


@query(
    "text_sentences",
    """WITH s AS (
      SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\\s+', '\\1' || chr(10), 'g'), chr(10)), lambda s: trim(s)), lambda s: s <> '') AS s FROM documents)
    SELECT doc_id, CAST(len(s) AS INTEGER) AS n_sentences, CAST(coalesce(list_max(list_transform(s, lambda x: length(x))), 0) AS INTEGER) AS longest FROM s""",
)
def text_sentences(spark, sf_dir):
    s = table(spark, sf_dir, "documents").select("doc_id", sentences(F.col("text")).alias("s"))
    longest = F.coalesce(F.array_max(F.transform("s", lambda x: F.length(x))), F.lit(0))
    return s.select("doc_id", F.size("s").alias("n_sentences"), longest.alias("longest"))


@query(
    "text_query_terms",
    """WITH t AS (
      SELECT item_id, list_filter(list_distinct(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+')), lambda t: length(t) > 2 AND NOT list_contains(
        ['the','and','for','with','that','this','from','are','was','of','to','in','is','on','by','an','as','at'], t)) AS t FROM benchmark),
    e AS (SELECT item_id, unnest(t) AS w FROM t),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY length(w) DESC, w) AS rn FROM e)
    SELECT item_id, string_agg(w, ' ' ORDER BY rn) AS terms FROM r WHERE rn <= 8 GROUP BY item_id""",
)
def text_query_terms(spark, sf_dir):
    """Terms of a query: no stop-words, longest first, eight at most."""
    words = F.array_distinct(F.split(F.lower("text"), r"[^\p{L}\p{N}]+"))
    kept = F.filter(words, lambda t: (F.length(t) > 2) & ~t.isin(STOP_WORDS))
    ordered = F.array_sort(F.transform(kept, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    terms = F.transform(F.slice(ordered, 1, 8), lambda x: x["t"])
    return table(spark, sf_dir, "benchmark").select("item_id", F.array_join(terms, " ").alias("terms")).where("terms != ''")


@query(
    "text_trigram_similarity",
    """WITH p AS (SELECT a.p_partkey, a.p_name AS x, b.p_name AS y FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
    g AS (SELECT p_partkey,
      list_distinct([substr(' ' || lower(x) || ' ', i, 3) for i in range(1, greatest(length(x), 1) + 1)]) AS a,
      list_distinct([substr(' ' || lower(y) || ' ', i, 3) for i in range(1, greatest(length(y), 1) + 1)]) AS b FROM p)
    SELECT p_partkey, round(CAST(len(list_intersect(a, b)) AS DOUBLE) / len(list_distinct(list_concat(a, b))), 6) AS jaccard FROM g""",
)
def text_trigram_similarity(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", trigrams(F.col("p_name")).alias("g"))
    after = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("g").alias("h"))
    return parts.join(after, "p_partkey").select("p_partkey", F.round(jaccard(F.col("g"), F.col("h")), 6).alias("jaccard"))


_DUCK_PII = "text"
for _p, _n in PII:
    _DUCK_PII = f"regexp_replace({_DUCK_PII}, '{_p}', '{_n}', 'g')"


@query("text_redact_pii", f"SELECT doc_id, md5(r) AS redacted_md5, r <> text AS changed FROM (SELECT doc_id, text, {_DUCK_PII} AS r FROM documents)")
def text_redact_pii(spark, sf_dir):
    r = table(spark, sf_dir, "documents").select("doc_id", "text", redacted(F.col("text")).alias("r"))
    return r.select("doc_id", F.md5(F.col("r").cast("binary")).alias("redacted_md5"), (F.col("r") != F.col("text")).alias("changed"))


@query(
    "text_slug_excerpt_hash",
    """SELECT doc_id, regexp_replace(regexp_replace(lower(translate(substr(text, 1, 80), 'çğıİöşüÇĞÖŞÜ', 'cgiiosuCGOSU')), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug,
      md5(array_to_string(list_slice(string_split(trim(regexp_replace(text, '\\s+', ' ', 'g')), ' '), 1, 40), ' ')) AS excerpt_md5,
      greatest(1, CAST(ceil(length(text) / 4.0) AS BIGINT)) AS tokens, substr(sha256(trim(text)), 1, 16) AS content_hash
    FROM documents""",
)
def text_slug_excerpt_hash(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        slug(F.substring(t, 1, 80)).alias("slug"),
        F.md5(excerpt(t, 40).cast("binary")).alias("excerpt_md5"),
        token_estimate(t).alias("tokens"),
        short_hash(t).alias("content_hash"),
    )


@query(
    "text_identifiers",
    """WITH w AS (SELECT doc_id, list_distinct(string_split_regex(text, '[^A-Za-z0-9_]+')) AS w FROM documents)
    SELECT doc_id, CAST(len(list_filter(w, lambda t: regexp_full_match(t, '[0-9]{6,}'))) AS INTEGER) AS n_numbers,
      CAST(len(list_filter(w, lambda t: regexp_full_match(t, '[A-Z][A-Z0-9]{3,}'))) AS INTEGER) AS n_symbols FROM w""",
)
def text_identifiers(spark, sf_dir):
    """Numbers of six digits or more and upper-case symbols."""
    w = table(spark, sf_dir, "documents").select("doc_id", F.array_distinct(F.split("text", "[^A-Za-z0-9_]+")).alias("w"))
    return w.select(
        "doc_id",
        F.size(F.filter("w", lambda t: t.rlike("^[0-9]{6,}$"))).alias("n_numbers"),
        F.size(F.filter("w", lambda t: t.rlike("^[A-Z][A-Z0-9]{3,}$"))).alias("n_symbols"),
    )


@query(
    "text_language_signal",
    f"""SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 ELSE CAST(len(list_filter(w, lambda t: regexp_matches(t, '^[a-z0-9]+$'))) AS DOUBLE) / len(w) END, 6) AS ascii_ratio
    FROM (SELECT doc_id, {_WORDS} AS w FROM documents)""",
)
def text_language_signal(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select("doc_id", plain_tokens(F.col("text")).alias("w"))
    ratio = F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.filter("w", lambda t: t.rlike("^[a-z0-9]+$"))) / F.size("w"))
    return w.select("doc_id", F.round(ratio, 6).alias("ascii_ratio"))


@query(
    "text_ngrams",
    f"""WITH w AS (SELECT doc_id, {_WORDS} AS w FROM documents),
    b AS (SELECT unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))]) AS bigram FROM w WHERE len(w) > 1)
    SELECT bigram, count(*) AS n FROM b GROUP BY bigram""",
)
def text_ngrams(spark, sf_dir):
    w = table(spark, sf_dir, "documents").select(plain_tokens(F.col("text")).alias("w"))
    pairs = F.transform(F.sequence(F.lit(1), F.size("w") - 1), lambda i: F.concat_ws(" ", F.element_at("w", i), F.element_at("w", i + 1)))
    return w.where("size(w) > 1").select(F.explode(pairs).alias("bigram")).groupBy("bigram").agg(F.count("*").alias("n"))


@query(
    "text_clean_document",
    """SELECT page_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '<[^>]+>', ' ', 'g'), '[ \\t]+', ' ', 'g'), ' ?\\n ?', chr(10), 'g'), '\\n{3,}', chr(10) || chr(10), 'g'))) AS text_md5 FROM pages""",
)
def text_clean_document(spark, sf_dir):
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("html", "<[^>]+>", " "), "[ \t]+", " "), " ?\n ?", "\n")
    return table(spark, sf_dir, "pages").select("page_id", F.md5(F.trim(F.regexp_replace(bare, "\n{3,}", "\n\n")).cast("binary")).alias("text_md5"))


@query(
    "text_stems",
    """WITH w AS (SELECT DISTINCT w FROM (SELECT unnest(string_split_regex(lower(text), '[^A-Za-z]+')) AS w FROM benchmark) WHERE length(w) > 2)
    SELECT w AS word, array_to_string(list_sort(list_distinct(list_concat([w], list_transform(list_filter(['ing', 'ed', 'ly', 'es', 's'], lambda s: ends_with(w, s) AND length(w) - length(s) >= 3), lambda s: substr(w, 1, length(w) - length(s)))))), ' ') AS stems FROM w""",
)
def text_stems(spark, sf_dir):
    words = table(spark, sf_dir, "benchmark").select(F.explode(F.split(F.lower("text"), "[^A-Za-z]+")).alias("word")).where("length(word) > 2")
    return words.distinct().select("word", F.array_join(F.array_sort(stems(F.col("word"), ["ing", "ed", "ly", "es", "s"])), " ").alias("stems"))


def unwrapped(text: Column) -> Column:
    """Soft-wrapped lines joined: a line that ends in a hyphen loses it, one that ends no sentence goes on with a space.

    A blank line, a list item and a heading begin anew.
    """
    def add(done, line):
        last = F.element_at(done, -1)
        begins = (F.size(done) == 0) | (line == "") | (last == "") | line.rlike(r"^([-*•#]|[0-9]+[.)]) ?") | last.rlike(r"[.!?:;]$")
        rest = F.slice(done, F.lit(1), F.size(done) - 1)
        hyphen = last.rlike(r"\p{L}-$") & line.rlike(r"^\p{Ll}")
        joined = F.when(hyphen, F.concat(F.regexp_replace(last, "-$", ""), line)).otherwise(F.concat(last, F.lit(" "), line))
        return F.when(begins, F.concat(done, F.array(line))).otherwise(F.concat(rest, F.array(joined)))

    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    return F.array_join(F.aggregate(lines, F.array().cast("array<string>"), add), "\n")


def card_field(text: Column, label: str, labels: list[str]) -> Column:
    """What follows 'label:' up to the next of labels at a line's start, or the end; null if it is not there or empty."""
    others = "|".join(labels)
    found = F.regexp_extract(text, rf"(?is)(?:^|\n){label}[ \t]*:[ \t]*(.*?)(?=\n(?:{others})[ \t]*:|\z)", 1)
    return F.nullif(F.regexp_replace(found, r"^\s+|\s+$", ""), F.lit(""))


def inferred_concepts(text: Column, rules: list[tuple[str, str]]) -> Column:
    """Names of the rules (name, pattern) that fit the text, in the rules' order."""
    low = concept(text)
    return F.array_compact(F.array(*[F.when(low.rlike(p), n) for n, p in rules]))


CONCEPTS = [("licence", "licen[cs]e"), ("rights", "rights reserved|copyright"), ("public", r"(?:^|[^\p{L}])(?:gnu|mit)(?:[^\p{L}]|$)|apache"), ("numbers", "[0-9]{4,}")]


@query("text_soft_wraps")
def text_soft_wraps(spark, sf_dir):
    """Tests hold the fold against a plain loop."""
    u = table(spark, sf_dir, "documents").select("doc_id", unwrapped(F.col("text")).alias("u"))
    return u.select("doc_id", F.size(F.split("u", "\n")).alias("n_lines"), F.md5(F.col("u").cast("binary")).alias("md5"))


@query(
    "text_card_fields",
    """SELECT doc_id, source AS topic, lang AS tags, nullif(trim(substr(string_split(text, chr(10))[1], 1, 60)), '') AS summary FROM documents""",
)
def text_card_fields(spark, sf_dir):
    """Documents written as labelled cards and read back."""
    labels = ["Topic", "Tags", "Summary"]
    head = F.substring(F.element_at(F.split("text", "\n"), 1), 1, 60)
    card = F.concat(F.lit("Topic: "), "source", F.lit("\nTags: "), "lang", F.lit("\nSummary: "), head)
    cards = table(spark, sf_dir, "documents").select("doc_id", card.alias("c"))
    return cards.select("doc_id", *[card_field(F.col("c"), x, labels).alias(x.lower()) for x in labels])


_LOW = "trim(regexp_replace(regexp_replace(lower(translate(translate(text, 'çğıİöşü', 'cgiiosu'), 'I', 'ı')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g'))"


@query(
    "text_concepts",
    f"SELECT doc_id, array_to_string(list_filter([{', '.join(f'''CASE WHEN regexp_matches(low, '{p}') THEN '{n}' END''' for n, p in CONCEPTS)}], lambda x: x IS NOT NULL), ',') AS concepts FROM (SELECT doc_id, {_LOW} AS low FROM documents)",
)
def text_concepts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(inferred_concepts(F.col("text"), CONCEPTS), ",").alias("concepts"))
