"""Folds and word variants: compatibility forms, marks, Turkish endings, scrubbed contacts."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import FOLD_FROM, FOLD_TO, tokens
from corvane.session import table

#: Endings that are cut, longest first.
ENDINGS = (
    "larimizdan lerimizden larimiz lerimiz lariniz leriniz larindan lerinden larina lerine lardan lerden larin lerin lari leri imiz iniz indan"
    " inden undan unden lar ler nin nun im in um un si su dan den da de ya ye a e i u"
).split()
#: Spoken endings of verbs (ending, least length of the word, what it is written as).
SPOKEN = [("yo", 5, "yor"), ("iyo", 6, "iyor"), ("yom", 6, "yorum"), ("iyom", 7, "iyorum"), ("yon", 7, "yorsun"), ("iyon", 8, "iyorsun")]
#: What is cut from answers, in this order, with its replacement.
CONTACTS = [(r"\*{2,}", ""), (r"(?i)randevu.*$", ""), (r"(?i)tel\s*[: ]?\s*[0-9* -]+", ""), (r"(?i)mail\s*[: ]?\s*\S+", "")]


def _one_letter_folds() -> tuple[str, str]:
    """Letters of the Latin blocks that are one letter and marks, and these letters."""
    pairs = []
    for c in map(chr, [*range(0xC0, 0x250), *range(0x1E00, 0x1F00)]):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if len(bare) == 1 and bare != c:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


MARKED, BARE = _one_letter_folds()


def nfkc(text: Column) -> Column:
    """Compatibility composition, which no built-in function has; plain ASCII is handed back as it is."""

    @F.pandas_udf("string")
    def composed(values: pd.Series) -> pd.Series:
        return values.map(lambda t: t if t is None or t.isascii() else unicodedata.normalize("NFKC", t))

    return composed(text)


def mark_fold(text: Column) -> Column:
    """Lower case with dotted and dotless I told apart, then letters without their marks, dotless i as i."""
    lowered = F.lower(F.translate(text, "Iİ", "ıi"))
    return F.translate(F.regexp_replace(F.translate(lowered, MARKED, BARE), r"\p{M}+", ""), "ı", "i")


def scrub_contacts(text: Column) -> Column:
    """Stars, appointment lines, phone numbers and mail addresses cut out; white space collapses before and after."""
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    for pattern, instead in CONTACTS:
        text = F.regexp_replace(text, pattern, instead)
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def _softened(words: Column) -> Column:
    """Words, and for those of four letters or more that end in g, b or d the ones with k, p or t."""

    def hard(w):
        last = F.translate(F.right(w, F.lit(1)), "gbd", "kpt")
        return F.concat(F.substring(w, F.lit(1), F.length(w) - 1), last)

    changed = F.transform(F.filter(words, lambda w: (F.length(w) >= 4) & F.right(w, F.lit(1)).isin("g", "b", "d")), hard)
    return F.concat(words, changed)


def word_variants(word: Column) -> Column:
    """Forms of a folded word to look it up by: softened ends, drawn-out letters, spoken verb endings, stems."""
    drawn = F.regexp_replace(word, r"(\p{L})\1{2,}", "$1")
    short = F.when((drawn != word) & (F.length(drawn) >= 3), F.array(drawn)).otherwise(F.array().cast("array<string>"))
    forms = _softened(F.concat(F.array(word), short))

    def written(w):
        made = [F.when((F.length(w) >= n) & F.endswith(w, F.lit(end)), F.concat(F.substring(w, F.lit(1), F.length(w) - len(end)), F.lit(full))) for end, n, full in SPOKEN]
        return F.array_compact(F.array(*made))

    spoken = F.flatten(F.transform(forms, written))
    ends = F.filter(F.array(*map(F.lit, ENDINGS)), lambda e: F.endswith(word, e) & (F.length(word) - F.length(e) >= 3))
    stems = F.transform(ends, lambda e: F.substring(word, F.lit(1), F.length(word) - F.length(e)))
    return F.array_distinct(F.concat(forms, spoken, _softened(stems)))


@query("text_compatibility_forms")
def text_compatibility_forms(spark, sf_dir):
    """Tests hold it against the standard library."""
    d = table(spark, sf_dir, "documents").select("doc_id", nfkc(F.col("text")).alias("text"))
    return d.select("doc_id", F.md5(F.col("text").cast("binary")).alias("nfkc_md5"), F.size(tokens(F.col("text"))).alias("n_tokens"))


@query(
    "text_mark_fold",
    "SELECT doc_id, md5(replace(strip_accents(lower(translate(text, 'Iİ', 'ıi'))), 'ı', 'i')) AS folded_md5 FROM documents",
)
def text_mark_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(mark_fold(F.col("text")).cast("binary")).alias("folded_md5"))


_SCRUBBED = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
for _pattern, _instead in CONTACTS:
    _SCRUBBED = f"regexp_replace({_SCRUBBED}, '{_pattern}', '{_instead}', 'g')"


@query("text_scrub_contacts", f"SELECT doc_id, md5(trim(regexp_replace({_SCRUBBED}, '\\s+', ' ', 'g'))) AS scrubbed_md5 FROM documents")
def text_scrub_contacts(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(scrub_contacts(F.col("text")).cast("binary")).alias("scrubbed_md5"))


@query("text_word_variants")
def text_word_variants(spark, sf_dir):
    """Forms of every word of the documents; tests hold them against plain Python, SQL's patterns know no back-reference."""
    folded = F.lower(F.translate(F.col("text"), FOLD_FROM, FOLD_TO))
    words = table(spark, sf_dir, "documents").select(F.explode(F.filter(F.split(folded, r"[^\p{L}\p{N}]+"), lambda w: F.length(w) >= 3)).alias("word")).distinct()
    return words.select("word", F.array_join(F.array_sort(word_variants(F.col("word"))), " ").alias("variants"))
