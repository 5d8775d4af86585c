"""Profiles: counts, rates, order statistics, summaries, trends, rank tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaintscope.catalog import Tables, query, r6
from plaintscope.functions.scalars import binarise, clip_upper, pct, round_n
from plaintscope.functions.dates import month_key
from plaintscope.functions.text import has_text, word_count
from plaintscope.operators import distribution as D, profile as P
from plaintscope.operators.ordered import last_point

# Share of labelled documents with quality 1, medians of length and words, per language.
@query("a9_summary", """
WITH d AS (
  SELECT lang, quality, n_chars,
         len(regexp_extract_all(text, '[^\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}]+')) AS words
  FROM documents LEFT JOIN labels USING (doc_id))
SELECT lang, count(*) AS n,
       round_even(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS resolved_pct,
       round_even(100.0 * count(*) FILTER (quality IS NULL) / count(*), 6) AS null_pct,
       round_even(avg(words), 6) AS mean_words,
       round_even(quantile_cont(quality, 0.5), 6) AS med_score,
       round_even(quantile_cont(quality, 0.25), 6) AS q25,
       round_even(quantile_cont(quality, 0.75), 6) AS q75,
       round_even(median(n_chars), 6) AS med_views
FROM d GROUP BY lang
""")
def a9_summary(t: Tables):
    d = t.texts("lang", "n_chars").join(t.labels, "doc_id", "left").withColumn("words", word_count("text"))
    s = P.summary(d, "lang", F.col("quality") == 1, "quality", "words", "n_chars")
    return s.select(
        "lang", "n", *[r6(c).alias(c) for c in
                       ("resolved_pct", "null_pct", "mean_words", "med_score", "q25", "q75", "med_views")]
    )


@query("a1_count", """
SELECT lang, count(*) AS n, count(quality) AS n_filled
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def a1_count(t: Tables):
    return P.count_by(t.labelled(), "lang", "quality")


@query("a2_rate", """
SELECT source, count(*) AS n, count(*) FILTER (quality = 1) AS n_pos,
       round_even(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS pct
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source
""")
def a2_rate(t: Tables):
    return P.rate_by(t.labelled(), "source", F.col("quality") == 1).withColumn("pct", r6("pct"))


@query("a3_mean", """
SELECT c_mktsegment, round_even(avg(c_acctbal), 6) AS mean FROM customer GROUP BY c_mktsegment
""")
def a3_mean(t: Tables):
    return P.mean_by(t.customer, "c_mktsegment", "c_acctbal").withColumn("mean", r6("mean"))


@query("a4_median", """
SELECT event_type, round_even(median(value), 6) AS median FROM events GROUP BY event_type
""")
def a4_median(t: Tables):
    return D.median_by(t.events, "event_type", "value").withColumn("median", r6("median"))


@query("a5_quartiles", """
SELECT event_type, round_even(quantile_cont(value, 0.25), 6) AS q25,
       round_even(quantile_cont(value, 0.75), 6) AS q75
FROM events GROUP BY event_type
""")
def a5_quartiles(t: Tables):
    q = D.quantiles_by(t.events, "event_type", "value", {"q25": 0.25, "q75": 0.75})
    return q.select("event_type", r6("q25").alias("q25"), r6("q75").alias("q75"))


@query("a6_skew", """
SELECT event_type, round_even(skewness(value), 6) AS skew, abs(skewness(value)) > 1 AS warn
FROM events GROUP BY event_type
""")
def a6_skew(t: Tables):
    return P.skew_by(t.events, "event_type", "value").withColumn("skew", r6("skew"))


@query("a7_p95", """
SELECT event_type, round_even(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type
""")
def a7_p95(t: Tables):
    return D.p95_by(t.events, "event_type", "value").withColumn("p95", r6("p95"))


@query("a8_null_profile", """
SELECT lang, count(*) AS total, count(quality) AS filled, count(*) - count(quality) AS n_null,
       round_even(100.0 * (count(*) - count(quality)) / count(*), 6) AS null_pct,
       count(*) - count(toxic) AS keywords_null,
       round_even(100.0 * (count(*) - count(toxic)) / count(*), 6) AS keywords_null_pct,
       count(source) AS replies, round_even(100.0 * count(source) / count(*), 6) AS reply_pct,
       round_even(median(quality), 6) AS median
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang
""")
def a8_null_profile(t: Tables):
    p = P.null_profile(t.labelled(), "lang", "quality", "toxic", "source")
    for c in ("null_pct", "keywords_null_pct", "reply_pct", "median"):
        p = p.withColumn(c, r6(c))
    return p


@query("r1_null_panel", """
WITH w AS (
  SELECT lang, count(*) AS total, count(*) - count(quality) AS quality,
         count(*) - count(toxic) AS toxic, count(*) - count(source) AS source
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang),
l AS (
  SELECT lang, total, 'quality' AS "column", quality AS n_null FROM w
  UNION ALL SELECT lang, total, 'toxic', toxic FROM w
  UNION ALL SELECT lang, total, 'source', source FROM w)
SELECT lang, total, "column", n_null, round_even(100.0 * n_null / total, 6) AS null_pct,
       CASE WHEN 100.0 * n_null / total > 20 THEN 'red'
            WHEN 100.0 * n_null / total > 5 THEN 'amber' ELSE 'green' END AS band
FROM l
""")
def r1_null_panel(t: Tables):
    p = P.null_panel(t.labelled(), "lang", ["quality", "toxic", "source"])
    return p.withColumn("null_pct", r6("null_pct"))


@query("a10_precheck", """
SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS n_pos,
       count(*) - count(*) FILTER (value > 50) AS n_other,
       round_even(100.0 * count(*) FILTER (value > 50) / count(*), 6) AS pct,
       count(*) - count(value) AS n_null,
       round_even(100.0 * (count(*) - count(value)) / count(*), 6) AS null_pct,
       round_even(skewness(value), 6) AS skew, round_even(median(value), 6) AS median,
       abs(skewness(value)) > 1 AS warn
FROM events GROUP BY event_type
""")
def a10_precheck(t: Tables):
    q = P.quality_precheck(t.events, "event_type", F.col("value") > 50, "value", bounded_score=False)
    for c in ("pct", "null_pct", "skew", "median"):
        q = q.withColumn(c, r6(c))
    return q


@query("a11_value_counts", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def a11_value_counts(t: Tables):
    return P.value_counts(t.orders, "o_orderstatus")


MONTH = "strftime(o_orderdate, '%Y-%m')"


@query("a12_counts_2d", f"""
SELECT {MONTH} AS month, o_orderpriority, count(*) AS n FROM orders GROUP BY 1, 2
""")
def a12_counts_2d(t: Tables):
    return P.value_counts(t.orders.withColumn("month", month_key("o_orderdate")), ["month", "o_orderpriority"])


PRIORITIES = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]


def _pivot_sql(fill: bool) -> str:
    cell = "count(*) FILTER (o_orderpriority = '{p}')"
    cell = cell if fill else f"nullif({cell}, 0)"
    columns = ", ".join(f"{cell.format(p=p)} AS \"{p}\"" for p in PRIORITIES)
    return f"SELECT strftime(o_orderdate, '%Y-%m-%d') AS day, {columns} FROM orders GROUP BY 1"


def _pivot(t: Tables, fill: bool):
    o = t.orders.withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    return P.pivot_counts(o, "day", "o_orderpriority", PRIORITIES, fill)


@query("a13_pivot", _pivot_sql(False))
def a13_pivot(t: Tables):
    return _pivot(t, False)


@query("a13_pivot_filled", _pivot_sql(True))
def a13_pivot_filled(t: Tables):
    return _pivot(t, True)


@query("a14_class_balance", """
SELECT lang, count(*) AS n, count(*) FILTER (quality = 1) AS n_pos, count(*) FILTER (quality <> 1) AS n_neg,
       round_even(100.0 * count(*) FILTER (quality = 1) / count(*), 6) AS pct
FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL GROUP BY lang
""")
def a14_class_balance(t: Tables):
    return P.class_balance(t.labelled(), "lang", "quality").withColumn("pct", r6("pct"))


@query("a15_class_gap", """
WITH m AS (
  SELECT lang, avg(n_chars) FILTER (quality = 1) AS mean1, avg(n_chars) FILTER (quality = 0) AS mean0
  FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang)
SELECT lang, round_even(mean1, 6) AS mean1, round_even(mean0, 6) AS mean0,
       round_even(mean1 - mean0, 6) AS diff,
       CASE WHEN mean1 - mean0 > 0 THEN 'positive' WHEN mean1 - mean0 IS NOT NULL THEN 'negative' END AS direction
FROM m
""")
def a15_class_gap(t: Tables):
    g = P.class_gap(t.labelled(), "lang", "quality", "n_chars")
    return g.select("lang", r6("mean1").alias("mean1"), r6("mean0").alias("mean0"), r6("diff").alias("diff"), "direction")


@query("a16_box", """
WITH q AS (
  SELECT event_type, quantile_cont(value, 0.25) AS q1, median(value) AS med, quantile_cont(value, 0.75) AS q3
  FROM events GROUP BY event_type),
j AS (
  SELECT e.event_type, value, q1, med, q3,
         value BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) AS inside
  FROM events e JOIN q USING (event_type))
SELECT event_type, round_even(max(q1), 6) AS q1, round_even(max(med), 6) AS med, round_even(max(q3), 6) AS q3,
       min(value) FILTER (inside) AS low_whisker, max(value) FILTER (inside) AS high_whisker,
       count(*) FILTER (NOT inside) AS outliers
FROM j GROUP BY event_type
""")
def a16_box(t: Tables):
    b = D.box_stats(t.events, "event_type", "value")
    return b.select("event_type", r6("q1").alias("q1"), r6("med").alias("med"), r6("q3").alias("q3"),
                    "low_whisker", "high_whisker", "outliers")


CLIPPED = """
WITH p AS (SELECT event_type, trunc(quantile_cont(value, 0.95)) AS p95 FROM events GROUP BY event_type),
c AS (SELECT event_type, least(value, p95) AS v FROM events JOIN p USING (event_type))
"""


@query("a17_hist", CLIPPED + """
, e AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM c GROUP BY event_type)
SELECT event_type, least(CAST(floor((v - lo) / ((hi - lo) / 40)) AS BIGINT), 39) AS bin, CAST(count(*) AS BIGINT) AS n
FROM c JOIN e USING (event_type) GROUP BY 1, 2
""")
def a17_hist(t: Tables):
    return D.histogram(t.events, "event_type", "value", bins=40)


@query("f23_clip", CLIPPED + """
SELECT c.event_type, round_even(sum(v), 4) AS sum_p95, max(v) AS max_p95, k.sum_const AS sum_const
FROM c JOIN (SELECT event_type, round_even(sum(least(value, 100)), 4) AS sum_const FROM events GROUP BY 1) k
  USING (event_type)
GROUP BY c.event_type, k.sum_const
""")
def f23_clip(t: Tables):
    by_p95 = D.clip_to_p95(t.events, "event_type", "value").groupBy("event_type").agg(
        F.bround(F.sum(F.col("clipped") * F.col("n")), 4).alias("sum_p95"), F.max("clipped").alias("max_p95")
    )
    const = t.events.groupBy("event_type").agg(
        F.bround(F.sum(clip_upper("value", F.lit(100.0))), 4).alias("sum_const")
    )
    return by_p95.join(const, "event_type")


@query("a18_score_dist", """
WITH m AS (SELECT p_brand, median(p_size) AS median,
                  100.0 * count(*) FILTER (p_size IS NULL) / count(*) AS null_pct FROM part GROUP BY p_brand)
SELECT p_brand, p_size, count(*) AS n, round_even(max(null_pct), 6) AS null_pct, round_even(max(median), 6) AS median
FROM part JOIN m USING (p_brand) WHERE p_size IS NOT NULL GROUP BY p_brand, p_size
""")
def a18_score_dist(t: Tables):
    s = P.score_distribution(t.part, "p_brand", "p_size")
    return s.withColumn("null_pct", r6("null_pct")).withColumn("median", r6("median"))


TREND = f"""
WITH month_counts AS (SELECT o_orderpriority, {MONTH} AS month, count(*) AS n FROM orders GROUP BY 1, 2),
month_seq AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY month) - 1 AS seq FROM month_counts),
month_line AS (SELECT o_orderpriority, count(*) AS months, regr_slope(n, seq) AS slope, regr_intercept(n, seq) AS intercept
               FROM month_seq GROUP BY 1 HAVING count(*) >= 2)
"""


def _months(t: Tables):
    return P.monthly_counts(t.orders.withColumn("month", month_key("o_orderdate")), "o_orderpriority", "month")


@query("a24_trend", TREND + """
SELECT o_orderpriority, months, round_even(slope, 6) AS slope, round_even(intercept, 6) AS intercept FROM month_line
""")
def a24_trend(t: Tables):
    return P.monthly_trend(_months(t), "o_orderpriority", "month").select(
        "o_orderpriority", "months", r6("slope").alias("slope"), r6("intercept").alias("intercept")
    )


@query("a24_trend_points", TREND + """
SELECT o_orderpriority, month, n, round_even(intercept + slope * seq, 6) AS fitted
FROM month_seq JOIN month_line USING (o_orderpriority)
""")
def a24_trend_points(t: Tables):
    return P.trend_points(_months(t), "o_orderpriority", "month").withColumn("fitted", r6("fitted"))


@query("w4_last_point", TREND + """
SELECT o_orderpriority, max(month) AS month, arg_max(n, month) AS n FROM month_counts GROUP BY 1
""")
def w4_last_point(t: Tables):
    return last_point(_months(t), "o_orderpriority", "month", "n")


@query("w3_sequence", TREND + "SELECT o_orderpriority, month, n, CAST(seq AS BIGINT) AS seq FROM month_seq")
def w3_sequence(t: Tables):
    return P.sequence_of_months(_months(t), ["o_orderpriority"], "month").withColumn("seq", F.col("seq").cast("bigint"))


# erfc by the published polynomial, as a SQL expression of x.
ERFC = ("((((1.061405429 * k - 1.453152027) * k + 1.421413741) * k - 0.284496736) * k + 0.254829592) * k"
        " * exp(-x * x)")


@query("a25_mann_whitney", f"""
WITH d AS (SELECT lang, quality, n_chars FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL),
v AS (SELECT lang, n_chars, count(*) AS t, count(*) FILTER (quality = 1) AS c1 FROM d GROUP BY 1, 2),
r AS (SELECT *, coalesce(sum(t) OVER (PARTITION BY lang ORDER BY n_chars ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
             + (t + 1) / 2.0 AS mid FROM v),
s AS (SELECT lang, sum(c1)::DOUBLE AS n1, (sum(t) - sum(c1))::DOUBLE AS n0, sum(t)::DOUBLE AS n,
             sum(mid * c1) - sum(c1) * (sum(c1) + 1) / 2.0 AS u1, sum(t * t * t - t)::DOUBLE AS ties FROM r GROUP BY lang),
z AS (SELECT *, (greatest(u1, n1 * n0 - u1) - n1 * n0 / 2 - 0.5)
             / nullif(sqrt(n1 * n0 / 12 * ((n + 1) - ties / nullif(n * (n - 1), 0))), 0) AS z FROM s),
x AS (SELECT *, z / sqrt(2.0) AS x, 1.0 / (1.0 + 0.3275911 * z / sqrt(2.0)) AS k FROM z),
p AS (SELECT *, CASE WHEN z < 0 THEN 1.0 WHEN z IS NOT NULL THEN least(1.0, {ERFC}) END AS p FROM x)
SELECT lang, n1::BIGINT AS n1, n0::BIGINT AS n0, u1::DOUBLE AS u1, round_even(z, 6) AS z, round_even(p, 6) AS p,
       CASE WHEN p < 0.001 THEN 'p < 0.001' WHEN p IS NOT NULL THEN printf('p = %.3f', p) END AS label
FROM p
""")
def a25_mann_whitney(t: Tables):
    m = D.mann_whitney(t.documents.join(t.labels, "doc_id"), "lang", "n_chars", F.col("quality") == 1)
    return m.withColumn("z", r6("z")).withColumn("p", r6("p"))


@query("a26_kpi", """
SELECT c_mktsegment, count(*) AS n,
       round_even(100.0 * count(*) FILTER (c_acctbal > 0) / count(*), 6) AS resolved_pct,
       round_even(avg(c_acctbal), 6) AS mean_score, round_even(median(c_acctbal), 6) AS med_score,
       round_even(avg(length(c_name)), 6) AS mean_words, round_even(avg(c_nationkey), 6) AS mean_views
FROM customer GROUP BY c_mktsegment
""")
def a26_kpi(t: Tables):
    c = t.customer.withColumn("words", F.length("c_name"))
    k = P.kpi_table(c, "c_mktsegment", F.col("c_acctbal") > 0, "c_acctbal", "words", "c_nationkey", bounded_score=False)
    for name in ("resolved_pct", "mean_score", "med_score", "mean_words", "mean_views"):
        k = k.withColumn(name, r6(name))
    return k


@query("a27_span", """
SELECT o_orderstatus, CAST(min(o_orderdate) AS DATE) AS first_date, CAST(max(o_orderdate) AS DATE) AS last_date
FROM orders GROUP BY o_orderstatus
""")
def a27_span(t: Tables):
    return P.date_span(t.orders.withColumn("d", F.col("o_orderdate").cast("date")), "d", "o_orderstatus")


@query("a27_distinct_groups", "SELECT DISTINCT o_orderpriority FROM orders")
def a27_distinct_groups(t: Tables):
    return t.orders.select("o_orderpriority").distinct()


@query("c5_ingest_summary", """
WITH o AS (SELECT o_orderpriority AS g, o_orderstatus AS s, o_totalprice AS v, CAST(o_orderdate AS DATE) AS d FROM orders)
SELECT 'all' AS level, NULL AS key, count(*) AS n, round_even(avg(v), 4) AS mean_score, min(d) AS first_date, max(d) AS last_date FROM o
UNION ALL SELECT 'group', g, count(*), round_even(avg(v), 4), min(d), max(d) FROM o GROUP BY g
UNION ALL SELECT 'status', s, count(*), round_even(avg(v), 4), min(d), max(d) FROM o GROUP BY s
""")
def c5_ingest_summary(t: Tables):
    s = P.ingest_summary(t.orders, "o_orderpriority", "o_orderstatus", "o_totalprice", "o_orderdate")
    return s.withColumn("mean_score", F.bround("mean_score", 4))


@query("a28_argmax", """
SELECT p_brand, arg_max(p_partkey, (p_retailprice, -p_partkey)) AS p_partkey, max(p_retailprice) AS p_retailprice
FROM part GROUP BY p_brand
""")
def a28_argmax(t: Tables):
    return P.argmax(t.part, "p_brand", "p_partkey", "p_retailprice")


@query("p4_gate", """
WITH l AS (SELECT source, doc_id FROM documents JOIN labels USING (doc_id))
SELECT source, count(*) AS n FROM l GROUP BY source HAVING count(*) >= 20
""")
def p4_gate(t: Tables):
    gated = P.gate_groups(t.documents.join(t.labels, "doc_id"), "source", 20)
    return gated.groupBy("source").agg(F.count(F.lit(1)).alias("n"))


@query("p1_filter", """
SELECT l_returnflag, count(*) AS n FROM lineitem
WHERE l_linestatus = 'F' AND l_returnflag IN ('A', 'R') GROUP BY l_returnflag
""")
def p1_filter(t: Tables):
    both = (F.col("l_linestatus") == "F") & F.col("l_returnflag").isin("A", "R")
    return P.value_counts(t.lineitem.filter(both), "l_returnflag")


@query("p2_has_text", """
SELECT o_orderkey, regexp_replace(substr(o_orderpriority, 2, 1), '-', '   ') AS rest,
       FALSE AS filled, o_orderpriority IS NOT NULL AS named
FROM orders
""")
def p2_has_text(t: Tables):
    blank = F.replace(F.substring("o_orderpriority", 2, 1), F.lit("-"), F.lit("   "))
    return t.orders.select(
        "o_orderkey", blank.alias("rest"), has_text(blank).alias("filled"), has_text("o_orderpriority").alias("named")
    )


@query("f16_binary", """
SELECT o_orderkey, CASE WHEN trim(o_orderstatus) = 'F' THEN 1 ELSE 0 END AS flag FROM orders
""")
def f16_binary(t: Tables):
    return t.orders.select("o_orderkey", binarise("o_orderstatus", "F").alias("flag"))


@query("f24_nulls", """
SELECT doc_id, coalesce(quality, 0) AS filled, quality IS NULL AS missing, toxic IS NOT NULL AS present
FROM documents LEFT JOIN labels USING (doc_id)
""")
def f24_nulls(t: Tables):
    return t.labelled().select(
        "doc_id", F.coalesce("quality", F.lit(0)).alias("filled"),
        F.col("quality").isNull().alias("missing"), F.col("toxic").isNotNull().alias("present"),
    )


@query("f24_dropna", "SELECT doc_id, quality, toxic FROM documents JOIN labels USING (doc_id) WHERE quality IS NOT NULL AND toxic IS NOT NULL")
def f24_dropna(t: Tables):
    return t.labelled().select("doc_id", "quality", "toxic").dropna(subset=["quality", "toxic"])


# Half-even in whole cents and tenths, so no binary fraction enters the SQL.
@query("f25_round", """
WITH i AS (SELECT l_orderkey, l_linenumber, CAST(round(l_extendedprice * 100) AS BIGINT) AS p,
                  CAST(round(l_quantity * 10) AS BIGINT) AS q FROM lineitem)
SELECT l_orderkey, l_linenumber,
       (p // 8 + CASE WHEN p % 8 > 4 OR (p % 8 = 4 AND (p // 8) % 2 = 1) THEN 1 ELSE 0 END) / 100.0::DOUBLE AS price,
       (q // 4 + CASE WHEN q % 4 > 2 OR (q % 4 = 2 AND (q // 4) % 2 = 1) THEN 1 ELSE 0 END) / 10.0::DOUBLE AS quantity
FROM i
""")
def f25_round(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber", round_n(F.col("l_extendedprice") / 8, 2).alias("price"),
        round_n(F.col("l_quantity") / 4, 1).alias("quantity"),
    )


@query("f28_pct", """
SELECT l_returnflag, round_even(100.0 * sum(l_discount) / nullif(sum(l_tax), 0), 6) AS pct,
       round_even(100.0 - 100.0 * count(*) FILTER (l_linestatus = 'F') / count(*), 6) AS rest
FROM lineitem GROUP BY l_returnflag
""")
def f28_pct(t: Tables):
    closed = pct(F.count_if(F.col("l_linestatus") == "F"), F.count(F.lit(1)))
    return t.lineitem.groupBy("l_returnflag").agg(
        r6(pct(F.sum("l_discount"), F.sum("l_tax"))).alias("pct"), r6(F.lit(100.0) - closed).alias("rest")
    )
