"""Numbers, dates and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.catalog import query
from corvane.session import table


def clamp(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def half_up(x: Column, places: int = 0) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(x * 10**places + 0.5) / 10**places


def local_number(text: Column) -> Column:
    """1.234,56 or 1,234.56 or (12) as a double: the last separator that one or two digits follow is the decimal one.

    A separator before groups of three digits only sets off thousands. What is no number is null.
    """
    bare = F.regexp_replace(F.trim(text), r"[\s%$€₺]", "")
    negative = bare.rlike(r"^\(.*\)$") | bare.startswith("-")
    digits = F.regexp_replace(bare, r"[()+-]", "")
    comma = digits.rlike(r"^[0-9.]*,[0-9]{1,2}$")
    point = digits.rlike(r"^[0-9,]*\.[0-9]+$") & ~digits.rlike(r"^[0-9]{1,3}(\.[0-9]{3})+$")
    plain = (
        F.when(comma, F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(point, F.replace(digits, F.lit(","), F.lit("")))
        .otherwise(F.regexp_replace(digits, "[.,]", ""))
    )
    value = plain.try_cast("double")
    return F.when(negative, -value).otherwise(value)


def value_type(text: Column) -> Column:
    """empty, boolean, number, percent, date or text."""
    t = F.lower(F.trim(text))
    return (
        F.when(t == "", "empty")
        .when(t.isin("true", "false", "yes", "no"), "boolean")
        .when(t.rlike(r"^[-+(]?[0-9][0-9.,]*\)?%$"), "percent")
        .when(t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}") | t.rlike(r"^[0-9]{1,2}[./][0-9]{1,2}[./][0-9]{4}$"), "date")
        .when(t.rlike(r"^[-+(]?[0-9][0-9.,]*\)?$"), "number")
        .otherwise("text")
    )


def unit_of(text: Column) -> Column:
    t = F.lower(text)
    return F.when(t.rlike(r"%|percent"), "percent").when(t.rlike(r"\b(usd|eur|try|\$)"), "currency").when(t.rlike(r"\b(kg|g|mg)\b"), "mass").when(t.rlike(r"\b(days?|hours?|minutes?)\b"), "time")


@query(
    "number_clamp_round",
    """SELECT l_orderkey, l_linenumber, least(greatest(l_discount - l_tax, -0.02), 0.05) AS clamped,
      floor(l_extendedprice / 100 + 0.5) AS hundreds, floor(sqrt(l_quantity) * 100 + 0.5) / 100 AS root, floor(ln(l_extendedprice + 1) * 1000 + 0.5) / 1000 AS logged FROM lineitem""",
)
def number_clamp_round(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        clamp(F.col("l_discount") - F.col("l_tax"), -0.02, 0.05).alias("clamped"),
        half_up(F.col("l_extendedprice") / 100).cast("double").alias("hundreds"),
        half_up(F.sqrt("l_quantity"), 2).alias("root"),
        half_up(F.log(F.col("l_extendedprice") + 1), 3).alias("logged"),
    )


@query(
    "number_local_formats",
    "SELECT o_orderkey, o_totalprice AS from_us, o_totalprice AS from_eu, -o_totalprice AS from_brackets FROM orders",
)
def number_local_formats(spark, sf_dir):
    """Order totals written in three local formats and parsed back."""
    orders = table(spark, sf_dir, "orders").withColumn("us", F.format_number("o_totalprice", 2))
    eu = F.translate("us", ",.", ".,")
    return orders.select(
        "o_orderkey",
        local_number(F.col("us")).alias("from_us"),
        local_number(eu).alias("from_eu"),
        local_number(F.concat(F.lit("("), F.col("us"), F.lit(")"))).alias("from_brackets"),
    )


@query(
    "number_value_types",
    """WITH v AS (
      SELECT c_custkey AS id, 'name' AS field, c_name AS v FROM customer UNION ALL SELECT c_custkey, 'balance', CAST(c_acctbal AS VARCHAR) FROM customer
      UNION ALL SELECT o_orderkey, 'date', strftime(o_orderdate, '%Y-%m-%d') FROM orders)
    SELECT field, CASE WHEN regexp_matches(v, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN 'date' WHEN regexp_matches(v, '^[-+(]?[0-9][0-9.,]*\\)?$') THEN 'number' ELSE 'text' END AS kind, count(*) AS n
    FROM v GROUP BY ALL""",
)
def number_value_types(spark, sf_dir):
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    v = c.select(F.lit("name").alias("field"), F.col("c_name").alias("v"))
    v = v.union(c.select(F.lit("balance"), F.col("c_acctbal").cast("string"))).union(o.select(F.lit("date"), F.date_format("o_orderdate", "yyyy-MM-dd")))
    return v.select("field", value_type(F.col("v")).alias("kind")).groupBy("field", "kind").agg(F.count("*").alias("n"))


@query(
    "date_age_filter",
    """SELECT event_id, CAST(floor(epoch(TIMESTAMP '2024-01-31' - ts) / 3600) AS BIGINT) AS age_hours, ts < TIMESTAMP '2024-01-30' AS stale FROM events""",
)
def date_age_filter(spark, sf_dir):
    """Ages against a given moment, never against the clock."""
    asof = F.lit("2024-01-31 00:00:00").cast("timestamp_ntz")
    whole = F.floor((F.unix_micros(asof.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp"))) / 3_600_000_000)
    return table(spark, sf_dir, "events").select(
        "event_id", whole.cast("long").alias("age_hours"), (F.col("ts") < asof - F.expr("INTERVAL 24 HOURS")).alias("stale")
    )


@query(
    "json_path_aliases",
    """SELECT event_id, coalesce(json_extract_string(props, '$.missing'), json_extract_string(props, '$.k')) AS k, md5('{"event_type":"' || event_type || '","k":' || json_extract_string(props, '$.k') || '}') AS payload_md5 FROM events""",
)
def json_path_aliases(spark, sf_dir):
    """A path read under several names, and the hash of canonical JSON with sorted keys."""
    k = F.coalesce(F.get_json_object("props", "$.missing"), F.get_json_object("props", "$.k"))
    canonical = F.to_json(F.struct("event_type", k.cast("long").alias("k")))
    return table(spark, sf_dir, "events").select("event_id", k.alias("k"), F.md5(canonical.cast("binary")).alias("payload_md5"))


@query(
    "array_map_reduce",
    """WITH a AS (SELECT l_orderkey, list(l_quantity ORDER BY l_linenumber) AS q FROM lineitem GROUP BY 1)
    SELECT l_orderkey, list_sum(list_transform(q, lambda x: x * 2)) AS doubled, CAST(len(list_filter(q, lambda x: x > 25)) AS INTEGER) AS large,
      len(list_filter(q, lambda x: x > 49)) > 0 AS any_top, len(list_filter(q, lambda x: x > 0)) = len(q) AS all_positive FROM a""",
)
def array_map_reduce(spark, sf_dir):
    a = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_quantity"))).alias("q"))
    a = a.select("l_orderkey", F.transform("q", lambda x: x["l_quantity"]).alias("q"))
    return a.select(
        "l_orderkey",
        F.aggregate(F.transform("q", lambda x: x * 2), F.lit(0.0), lambda s, x: s + x).alias("doubled"),
        F.size(F.filter("q", lambda x: x > 25)).alias("large"),
        F.exists("q", lambda x: x > 49).alias("any_top"),
        F.forall("q", lambda x: x > 0).alias("all_positive"),
    )


@query(
    "map_ordered_entries",
    """WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL)
    SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS entries FROM c GROUP BY user_id""",
)
def map_ordered_entries(spark, sf_dir):
    counts = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    by_user = counts.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("m"))
    entries = F.transform(F.array_sort(F.map_entries("m")), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return by_user.select("user_id", F.array_join(entries, ",").alias("entries"))


def sanitized(json_text: Column, most_keys: int = 8, most_chars: int = 200) -> Column:
    """An object's scalar members, by sorted key, so many at most and cut to length; null for what is no object."""
    entries = F.array_sort(F.map_entries(F.from_json(json_text, "map<string,string>")))
    kept = F.slice(F.filter(entries, lambda e: e["value"].isNotNull() & ~e["value"].rlike(r"^[\[{]")), 1, most_keys)
    cut = F.transform(kept, lambda e: F.struct(F.substring(e["key"], 1, 64).alias("key"), F.substring(e["value"], 1, most_chars).alias("value")))
    return F.to_json(F.map_from_entries(cut))


@query("json_sanitize", """SELECT event_id, '{"k":"' || json_extract_string(props, '$.k') || '"}' AS clean FROM events""")
def json_sanitize(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", sanitized(F.col("props")).alias("clean"))
