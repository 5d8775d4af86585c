"""Order-dependent rules and relational joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaintscope.catalog import Tables, query
from plaintscope.functions.dates import to_date_coerce
from plaintscope.operators import ordered as O
from plaintscope.operators.scraped import enrich
from plaintscope.session import stage

COERCED = """SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE CAST(o_orderdate AS DATE) END AS d FROM orders"""


# Status P carries an unreadable date text; such rows stay in.
@query("c1_range", f"SELECT * FROM ({COERCED}) WHERE d IS NULL OR d BETWEEN DATE '1996-01-01' AND DATE '1997-12-31'")
def c1_range(t: Tables):
    text = F.when(F.col("o_orderstatus") == "P", "soon").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    o = t.orders.select("o_orderkey", to_date_coerce(text).alias("d"))
    return O.date_range(o, "d", F.lit("1996-01-01").cast("date"), F.lit("1997-12-31").cast("date"))


@query("c2_take_while", """
SELECT event_id, user_id FROM (
  SELECT *, max((value > 100)::INTEGER) OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC ROWS UNBOUNDED PRECEDING) AS stopped
  FROM events) WHERE stopped = 0
""")
def c2_take_while(t: Tables):
    newest_first = [-F.unix_micros(F.col("ts").cast("timestamp")), -F.col("event_id")]
    return O.take_while(t.events, "user_id", newest_first, F.col("value") > 100).select("event_id", "user_id")


FIRST_OF_DAY = """
SELECT user_id, CAST(ts AS DATE) - DATE '2024-01-01' AS page, arg_min(event_type, (ts, event_id)) AS first_id
FROM events GROUP BY 1, 2
"""


def _pages(t: Tables):
    e = t.events.withColumn("page", F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")).cast("bigint"))
    at = F.struct("ts", "event_id")
    return O.first_of_page(e.withColumn("at", at), "user_id", "page", "at", "event_type")


# A user's day is a page; a day that starts with the same event type as the day before
# it repeats that page, and everything from there on is cut.
@query("c3_repeat", f"""
WITH p AS ({FIRST_OF_DAY}),
l AS (SELECT *, coalesce(first_id = lag(first_id) OVER (PARTITION BY user_id ORDER BY page), FALSE) AS again FROM p),
m AS (SELECT *, max(again::INTEGER) OVER (PARTITION BY user_id ORDER BY page ROWS UNBOUNDED PRECEDING) AS cut FROM l)
SELECT user_id, page, first_id FROM m WHERE cut = 0
""")
def c3_repeat(t: Tables):
    return O.drop_repeats(_pages(t), "user_id", "page")


@query("w2_previous", f"""
SELECT user_id, page, first_id, lag(first_id) OVER (PARTITION BY user_id ORDER BY page) AS prev_first_id FROM ({FIRST_OF_DAY})
""")
def w2_previous(t: Tables):
    return O.running(stage(_pages(t)), "user_id", "page", previous=["first_id"])


@query("w1_running_total", """
SELECT o_orderkey, CAST(coalesce(sum(o_custkey) OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before_o_custkey
FROM orders
""")
def w1_running_total(t: Tables):
    o = stage(t.orders.select("o_orderkey", "o_orderpriority", "o_custkey"))
    return O.running(o, "o_orderpriority", "o_orderkey", sums=["o_custkey"]).select("o_orderkey", "before_o_custkey")


@query("w3_sequence_index", """
SELECT o_orderkey, CAST(row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) - 1 AS BIGINT) AS seq FROM orders
""")
def w3_sequence_index(t: Tables):
    return O.sequence_index(t.orders.select("o_orderkey", "o_orderstatus"), "o_orderstatus", "o_orderkey").select("o_orderkey", "seq")


@query("c4_first_n", """
SELECT o_custkey, o_orderkey FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders) WHERE rn <= 3
""")
def c4_first_n(t: Tables):
    order = [F.col("o_orderdate").asc(), F.col("o_orderkey").asc()]
    return O.limit_per_group(t.orders, "o_custkey", order, 3).select("o_custkey", "o_orderkey")


@query("w6_top_per_group", """
SELECT * FROM (SELECT c_mktsegment, c_custkey, c_acctbal,
  row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal DESC, c_custkey)::INTEGER AS rank FROM customer) WHERE rank <= 10
""")
def w6_top_per_group(t: Tables):
    order = [F.col("c_acctbal").desc(), F.col("c_custkey").asc()]
    return O.top_per_group(t.customer.select("c_mktsegment", "c_custkey", "c_acctbal"), "c_mktsegment", order, 10)


# Beyond 1,000 per group the ranking goes in two rounds.
@query("w6_top_large_n", """
SELECT l_returnflag, l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
  SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity) AS rn FROM lineitem)
WHERE rn <= 2000
""")
def w6_top_large_n(t: Tables):
    order = [F.col("l_extendedprice").desc(), *[F.col(c).asc() for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")]]
    top = O.limit_per_group(t.lineitem, "l_returnflag", order, 2000, ["l_orderkey", "l_linenumber"])
    return top.select("l_returnflag", "l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")


# Events as cards, 24 to a page, status error without a readable date.
@query("x12_coverage", """
WITH c AS (SELECT event_id // 24 AS page, event_id % 24 AS pos, CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS d FROM events)
SELECT page, arg_min(d, pos) FILTER (d IS NOT NULL) AS first_date, arg_max(d, pos) FILTER (d IS NOT NULL) AS last_date, count(*) AS cards
FROM c GROUP BY page
""")
def x12_coverage(t: Tables):
    c = t.events.select(
        F.floor(F.col("event_id") / 24).alias("page"), (F.col("event_id") % 24).alias("pos"),
        F.when(F.col("event_type") != "error", F.col("ts").cast("date")).alias("d"),
    )
    return O.page_coverage(c, "page", "pos", "d")


@query("w5_first_last", """
SELECT conv_id, arg_min(role, turn) AS first_role, arg_max(role, turn) AS last_role FROM conversations GROUP BY conv_id
""")
def w5_first_last(t: Tables):
    return t.conversations.groupBy("conv_id").agg(
        F.min_by("role", "turn").alias("first_role"), F.max_by("role", "turn").alias("last_role")
    )


@query("o1_sorted", "SELECT o_orderpriority, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def o1_sorted(t: Tables):
    return t.orders.groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("n")).orderBy("o_orderpriority")


@query("j3_enrich", """
SELECT doc_id, lang, coalesce(quality, -1) AS quality, toxic FROM documents LEFT JOIN labels USING (doc_id)
""")
def j3_enrich(t: Tables):
    return enrich(t.documents.select("doc_id", "lang"), t.labels, "doc_id", {"quality": -1})


@query("j4_full_counts", """
SELECT p_partkey, count(l_partkey) AS n FROM part LEFT JOIN lineitem ON p_partkey = l_partkey GROUP BY p_partkey
""")
def j4_full_counts(t: Tables):
    # Counted before joining: a part on a third of all lines is one row by then.
    counts = t.lineitem.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.count(F.lit(1)).alias("n"))
    return t.part.select("p_partkey").join(counts, "p_partkey", "left").fillna(0, subset=["n"])
