"""Terms of a table found in texts by an Aho-Corasick automaton: concepts that a text names, and their synonyms."""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.functions.text import concept
from corvane.session import table
from corvane.storage import stored

#: Characters of terms in one automaton, which every task holds; more terms are dealt to several, run one after the other.
MOST_CHARS = 20_000_000


def folded(text: Column) -> Column:
    """concept(), with all but letters, digits and white space made spaces: the form in which texts and terms are compared."""
    return F.trim(F.regexp_replace(F.regexp_replace(concept(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def _automaton(terms: list[tuple[int, str, bool]]):
    """Of (number, folded term, open); an open term may go on to the end of its last word."""
    import ahocorasick

    held: dict[str, list[tuple[int, bool]]] = {}
    for number, term, is_open in terms:
        held.setdefault(f" {term}", []).append((number, is_open))
    automaton = ahocorasick.Automaton()
    for term, entries in held.items():
        automaton.add_word(term, (len(term), entries))
    automaton.make_automaton()
    return automaton


def found_in(automaton, text: str) -> list[tuple[int, int, int]]:
    """(start, end, number) of all terms in a folded text, between word bounds, by start; overlaps included."""
    padded, out = f" {text} ", []
    for last, (size, entries) in automaton.iter(padded):
        start, after = last - size + 1, last + 1  # start is that of the space before the term, so that of the term in text
        whole = padded[after] == " "
        for number, is_open in entries:
            if whole or is_open:
                end = after if whole else padded.index(" ", after)
                out.append((start, end - 1, number))
    return sorted(out)


def longest(found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Of matches, from the left on, the longest that begins first and overlaps none before; ties are all kept."""
    out: list[tuple[int, int, int]] = []
    for start, end, number in sorted(found, key=lambda x: (x[0], -x[1], x[2])):
        if not out or start >= out[-1][1] or (start, end) == out[-1][:2]:
            out.append((start, end, number))
    return out


def term_matches(rows: DataFrame, key: str, text: str, terms: DataFrame, overlaps: bool = False, fold_terms: bool = True) -> DataFrame:
    """key, number, start, end: the terms (number, term, open) that each row's folded text has, places counted there.

    Between word bounds; the longest from the left on, or all of them with overlaps. key tells the rows apart. A null text has none; a
    term without letters or digits is nowhere. Terms that are folded already must not be folded again (I becomes ı, which becomes i). The work per text follows its length and matches, not the number of terms.
    """
    form = folded(F.col("term")) if fold_terms else F.col("term")
    clean = stored(terms.select(F.col("number").cast("long"), form.alias("term"), F.coalesce("open", F.lit(False)).alias("open")).where("term <> ''"), "terms")
    chars = clean.agg(F.sum(F.length("term") + 1).alias("n")).first().n or 0
    parts = max(1, -(-chars // MOST_CHARS))
    texts = rows.select(F.col(key).alias("_key"), folded(F.col(text)).alias("_text"))
    schema = "array<struct<start:int,end:int,number:bigint>>"

    def search(part: int) -> DataFrame:
        # MOST_CHARS at most, as counted
        mine = [(r.number, r.term, r.open) for r in clean.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part).collect()]

        @F.arrow_udf(schema)
        def matches(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            automaton = _automaton(mine)
            for batch in batches:
                # numbers of the batch lie in arrays: as objects they would take twenty times as much
                flat, ends = array("q"), array("i", [0])
                for t in batch:
                    found = found_in(automaton, t.as_py()) if mine else []
                    if parts == 1 and not overlaps:
                        found = longest(found)
                    for match in found:
                        flat.extend(match)
                    ends.append(len(flat) // 3)
                of = np.frombuffer(flat, np.int64).reshape(-1, 3)
                columns = [pa.array(of[:, 0].astype(np.int32)), pa.array(of[:, 1].astype(np.int32)), pa.array(np.ascontiguousarray(of[:, 2]))]
                items = pa.StructArray.from_arrays(columns, names=["start", "end", "number"])
                yield pa.ListArray.from_arrays(pa.array(np.frombuffer(ends, np.int32)), items)

        return texts.select("_key", matches("_text").alias("m"))

    found = search(0)
    if parts > 1:
        each = [stored(search(p), "matches") for p in range(parts)]
        for other in each[1:]:
            each[0] = each[0].unionByName(other)
        found = each[0].groupBy("_key").agg(F.flatten(F.collect_list("m")).alias("m"))
        if not overlaps:

            @F.udf(schema)
            def pick(m):
                return [dict(zip(("start", "end", "number"), x, strict=True)) for x in longest([(r.start, r.end, r.number) for r in m])]

            found = found.select("_key", pick("m").alias("m"))
    return found.select(F.col("_key").alias(key), F.inline("m")).select(key, "number", "start", "end")


def named_concepts(rows: DataFrame, key: str, text: str, rules: DataFrame, most: int = 12, fold_terms: bool = True) -> DataFrame:
    """key, concepts: of rules (rank, concept, term, open) the concepts with a term in the text, in the order of rank, most at most."""
    found = term_matches(rows, key, text, rules.select(F.col("rank").alias("number"), "term", "open"), True, fold_terms).select(key, "number").distinct()
    named = found.join(rules.select(F.col("rank").alias("number"), "concept").distinct(), "number")
    firsts = named.groupBy(key, "concept").agg(F.min("number").alias("number"))
    return firsts.groupBy(key).agg(F.slice(F.transform(F.sort_array(F.collect_list(F.struct("number", "concept"))), lambda x: x["concept"]), 1, most).alias("concepts"))


def expanded(concepts: DataFrame, key: str, synonyms: DataFrame, most: int = 32) -> DataFrame:
    """key, terms: the concepts of named_concepts() and their synonyms (concept, place, synonym), without repeats, most at most."""
    each = concepts.select(key, F.posexplode("concepts").alias("at", "concept"))
    own = each.select(key, "at", F.lit(-1).alias("place"), F.col("concept").alias("t"))
    more = each.join(synonyms, "concept").select(key, "at", "place", F.col("synonym").alias("t"))
    ordered = F.sort_array(F.collect_list(F.struct("at", "place", "t")))
    return own.unionByName(more).groupBy(key).agg(F.slice(F.array_distinct(F.transform(ordered, lambda x: x["t"])), 1, most).alias("terms"))


def _pairs(words: Column) -> Column:
    two = F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat_ws(" ", a, b))
    return F.when(F.size(words) > 1, two)


def _benchmark_rules(spark, sf_dir) -> DataFrame:
    """Every pair of words of the benchmark as a term of the first item that has it."""
    words = F.split(folded(F.col("text")), " ")
    pairs = table(spark, sf_dir, "benchmark").select("item_id", F.explode(_pairs(words)).alias("term"))
    first = pairs.groupBy("term").agg(F.min("item_id").alias("rank"))
    return first.select("rank", F.concat(F.lit("item-"), "rank").alias("concept"), "term", F.lit(False).alias("open"))


_FOLDED = "trim(regexp_replace(regexp_replace(trim(regexp_replace(regexp_replace(lower(translate(translate(coalesce(text, ''), 'çğıİöşü', 'cgiiosu'), 'I', 'ı')), '[_-]+', ' ', 'g'), '\\s+', ' ', 'g')), '[^\\p{L}\\p{N}\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
_TWO = "unnest([w[i] || ' ' || w[i + 1] for i in range(1, len(w))])"
_NAMED = f"""r AS (SELECT term, min(item_id) AS rank FROM (SELECT item_id, {_TWO} AS term FROM (SELECT item_id, string_split({_FOLDED}, ' ') AS w FROM benchmark)) GROUP BY 1),
  d AS (SELECT doc_id, {_TWO} AS term FROM (SELECT doc_id, string_split({_FOLDED}, ' ') AS w FROM documents)), m AS (SELECT doc_id, rank, term FROM d JOIN r USING (term))"""


@query("text_term_matches", f"WITH {_NAMED} SELECT doc_id, rank AS number, count(*) AS n FROM m GROUP BY ALL")
def text_term_matches(spark, sf_dir):
    """How often each document has pairs of words of each benchmark item."""
    rules = _benchmark_rules(spark, sf_dir)
    found = term_matches(table(spark, sf_dir, "documents"), "doc_id", "text", rules.select(F.col("rank").alias("number"), "term", "open"), True, False)
    return found.groupBy("doc_id", "number").agg(F.count("*").alias("n"))


@query(
    "text_expanded_concepts",
    f"""WITH {_NAMED}, c AS (SELECT doc_id, rank, row_number() OVER (PARTITION BY doc_id ORDER BY rank) AS k FROM (SELECT DISTINCT doc_id, rank FROM m)),
    s AS (SELECT rank, term, row_number() OVER (PARTITION BY rank ORDER BY term) AS place FROM r),
    t AS (SELECT doc_id, k, 0 AS place, 'item-' || rank AS t FROM c WHERE k <= 12 UNION ALL SELECT doc_id, k, place, term FROM c JOIN s USING (rank) WHERE k <= 12 AND place <= 4),
    n AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, place) AS i FROM t)
    SELECT doc_id, string_agg(t, '|' ORDER BY i) AS terms FROM n WHERE i <= 32 GROUP BY doc_id""",
)
def text_expanded_concepts(spark, sf_dir):
    """The concepts that documents name, and up to four synonyms of each."""
    rules = stored(_benchmark_rules(spark, sf_dir), "rules")
    place = F.row_number().over(Window.partitionBy("concept").orderBy("term"))
    synonyms = rules.select("concept", place.alias("place"), F.col("term").alias("synonym")).where("place <= 4")
    named = named_concepts(table(spark, sf_dir, "documents"), "doc_id", "text", rules, fold_terms=False)
    return expanded(named, "doc_id", synonyms).select("doc_id", F.array_join("terms", "|").alias("terms"))
