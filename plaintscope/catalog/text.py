"""Text normaliser steps, stop words, stems, categories, string rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from plaintscope.catalog import Tables, query, r6
from plaintscope.functions import text as X
from plaintscope.functions.dates import month_key, parse_tr_date, to_date_coerce
from plaintscope.functions.fixed_values import TURKISH_MONTHS
from plaintscope.functions.scalars import left_n, slug
from plaintscope.operators import categories as C, profile as P, tokens as K
from plaintscope.sources.complaints import conform, display_name, tag_and_union

# SQL spellings of the same character classes.
SPACE = "\\s\\p{Z}\\x0b\\x1c-\\x1f\\x{85}"
NOT_WS = f"[^{SPACE}]+"
SQL_STEPS = [
    (f"http{NOT_WS}|www\\.{NOT_WS}", "urls"),
    ("@[\\p{L}\\p{N}_]+", "mentions"),
    ("\\p{Nd}+", "digits"),
    (f"[^\\p{{L}}\\p{{N}}_{SPACE}]", "punctuation"),
    ("_", "underscore"),
]
STOPS = ["the", "and", "that", "les", "des", "und", "der", "que", "las", "los", "with", "from"]
STOP_LIST = ", ".join(f"'{w}'" for w in STOPS)


def cleaned_sql(column: str) -> str:
    """The chain of single replacements, one per step, as SQL."""
    expr = f"lower({column})"
    for pattern, _ in SQL_STEPS:
        expr = f"regexp_replace({expr}, '{pattern}', ' ', 'g')"
    return expr


def tokens_sql(column: str, stops: bool = True) -> str:
    """Tokens by the separate steps: clean, split, drop stops, drop short ones."""
    words = f"string_split_regex(trim(regexp_replace({cleaned_sql(column)}, '[{SPACE}]+', ' ', 'g')), ' ')"
    keep = "length(w) > 2" + (f" AND w NOT IN ({STOP_LIST})" if stops else "")
    return f"list_filter({words}, lambda w: {keep})"


@query("f2_coerce", """
SELECT o_orderkey, try_cast(CASE WHEN o_orderstatus = 'P' THEN 'bad ' ELSE '' END || strftime(o_orderdate, '%Y-%m-%d') AS DATE) AS d
FROM orders
""")
def f2_coerce(t: Tables):
    bad = F.when(F.col("o_orderstatus") == "P", "bad ").otherwise("")
    text = F.concat(bad, F.date_format("o_orderdate", "yyyy-MM-dd"))
    return t.orders.select("o_orderkey", to_date_coerce(text).alias("d"))


@query("f3_month", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month FROM orders")
def f3_month(t: Tables):
    return t.orders.select("o_orderkey", month_key("o_orderdate").alias("month"))


MONTH_LIST = ", ".join(f"'{m}'" for m in TURKISH_MONTHS)


# Order dates written as Turkish text, with the year or (status O) without, and read back.
@query("f1_tr_date", f"""
WITH o AS (SELECT o_orderkey, o_orderstatus AS s, day(o_orderdate) AS d, month(o_orderdate) AS m, CAST(o_orderdate AS DATE) AS full_date FROM orders),
b AS (SELECT *, [{MONTH_LIST}][m] AS name FROM o)
SELECT o_orderkey,
       CASE WHEN s = 'O' THEN d || ' ' || name || ' 00:14' ELSE d || ' ' || name || ' ' || year(full_date) || ' 09:30' END AS text,
       CASE WHEN s <> 'O' THEN full_date
            ELSE coalesce(
              CASE WHEN try_cast('1999-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) > DATE '1999-06-15'
                   THEN try_cast('1998-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE) END,
              try_cast('1999-' || lpad(m::VARCHAR, 2, '0') || '-' || lpad(d::VARCHAR, 2, '0') AS DATE))
       END AS parsed
FROM b
""")
def f1_tr_date(t: Tables):
    months = F.array(*[F.lit(m) for m in TURKISH_MONTHS])
    name = F.element_at(months, F.month("o_orderdate"))
    day = F.dayofmonth("o_orderdate").cast("string")
    year = F.year("o_orderdate").cast("string")
    text = F.when(F.col("o_orderstatus") == "O", F.concat(day, F.lit(" "), name, F.lit(" 00:14"))).otherwise(
        F.concat(day, F.lit(" "), name, F.lit(" "), year, F.lit(" 09:30"))
    )
    o = t.orders.select("o_orderkey", text.alias("text"))
    return o.withColumn("parsed", parse_tr_date("text", F.lit("1999-06-15").cast("date")))


@query("f4_words", f"SELECT doc_id, len(regexp_extract_all(text, '{NOT_WS}'))::INTEGER AS n FROM documents")
def f4_words(t: Tables):
    return t.texts().select("doc_id", X.word_count("text").alias("n"))


@query("f5_chars", "SELECT doc_id, coalesce(length(text), 0)::INTEGER AS n FROM documents")
def f5_chars(t: Tables):
    return t.documents.select("doc_id", X.char_count("text").alias("n"))


def digest(c):
    return F.md5(c)


# Whole texts are transformed; the digest keeps the compared rows short.
@query("f6_lower", "SELECT doc_id, md5(lower(text)) AS v FROM documents")
def f6_lower(t: Tables):
    return t.texts().select("doc_id", digest(X.lower("text")).alias("v"))


@query("f7_urls", f"SELECT page_id, regexp_replace('see ' || url || ' and www.x' || page_id || '.org/a end', '{SQL_STEPS[0][0]}', ' ', 'g') AS v FROM pages")
def f7_urls(t: Tables):
    text = F.concat(F.lit("see "), "url", F.lit(" and www.x"), F.col("page_id").cast("string"), F.lit(".org/a end"))
    return t.pages.select("page_id", X.remove_urls(text).alias("v"))


@query("f8_mentions", f"SELECT o_orderkey, regexp_replace('to @' || o_orderpriority || ', @ü_' || o_custkey || '!', '{SQL_STEPS[1][0]}', ' ', 'g') AS v FROM orders")
def f8_mentions(t: Tables):
    text = F.concat(F.lit("to @"), "o_orderpriority", F.lit(", @ü_"), F.col("o_custkey").cast("string"), F.lit("!"))
    return t.orders.select("o_orderkey", X.remove_mentions(text).alias("v"))


@query("f9_digits", f"SELECT doc_id, md5(regexp_replace(text, '{SQL_STEPS[2][0]}', ' ', 'g')) AS v FROM documents")
def f9_digits(t: Tables):
    return t.texts().select("doc_id", digest(X.remove_digits("text")).alias("v"))


@query("f10_punct", f"SELECT doc_id, md5(regexp_replace(text, '{SQL_STEPS[3][0]}', ' ', 'g')) AS v FROM documents")
def f10_punct(t: Tables):
    return t.texts().select("doc_id", digest(X.remove_punctuation("text")).alias("v"))


@query("f11_underscore", "SELECT n_nationkey, replace(n_name, '_', ' ') AS v FROM nation")
def f11_underscore(t: Tables):
    return t.nation.select("n_nationkey", X.underscores_to_spaces("n_name").alias("v"))


@query("f12_spaces", f"SELECT doc_id, md5(trim(regexp_replace(text, '[{SPACE}]+', ' ', 'g'))) AS v FROM documents")
def f12_spaces(t: Tables):
    return t.texts().select("doc_id", digest(X.collapse_spaces("text")).alias("v"))


@query("f13_tokens", f"SELECT doc_id, len(l)::INTEGER AS n, md5(array_to_string(l, ' ')) AS v FROM (SELECT doc_id, regexp_extract_all(text, '{NOT_WS}') AS l FROM documents)")
def f13_tokens(t: Tables):
    tokens = X.tokenise("text")
    return t.texts().select("doc_id", F.size(tokens).alias("n"), digest(X.join_tokens(tokens)).alias("v"))


@query("f14_clean", f"SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS v FROM documents")
def f14_clean(t: Tables):
    return t.texts().select("doc_id", X.clean_text("text", STOPS).alias("v"))


STOPPED = f"""
WITH w AS (SELECT doc_id, {tokens_sql('text', stops=False)} AS l FROM documents)
SELECT doc_id, array_to_string(list_filter(l, lambda x: x NOT IN ({STOP_LIST})), ' ') AS v FROM w
"""


def _stopped(t: Tables, **options):
    docs = t.texts().select("doc_id", X.word_tokens("text").alias("tokens"))
    stops = K.build_stopwords({"fixed": STOPS}, t.spark)
    return K.drop_tokens(docs, "tokens", stops, **options).select("doc_id", X.join_tokens("tokens").alias("v"))


@query("p5_stops", STOPPED)
def p5_stops(t: Tables):
    return _stopped(t)


# The way taken by stop tables too large to list: explode, anti-join, put back in order.
@query("j2_stop_join", STOPPED)
def j2_stop_join(t: Tables):
    return _stopped(t, max_listed=0)


@query("p3_min_len", f"""
SELECT doc_id, length(v) > 3 AS kept, length(v) > 20 AS pooled
FROM (SELECT doc_id, array_to_string({tokens_sql('text')}, ' ') AS v FROM documents)
""")
def p3_min_len(t: Tables):
    v = X.clean_text("text", STOPS)
    return t.texts().select("doc_id", X.min_len(v, 3).alias("kept"), X.min_len(v, 20).alias("pooled"))


@query("p6_token_len", f"""
SELECT doc_id, array_to_string(list_filter(regexp_extract_all(text, '{NOT_WS}'), lambda w: length(w) > 2), ' ') AS v FROM documents
""")
def p6_token_len(t: Tables):
    return t.texts().select("doc_id", X.join_tokens(X.min_token_len(X.tokenise("text"))).alias("v"))


@query("p7_min_tokens", f"SELECT doc_id, len({tokens_sql('text')})::INTEGER AS n FROM documents WHERE len({tokens_sql('text')}) >= 3")
def p7_min_tokens(t: Tables):
    docs = t.texts().select("doc_id", F.size(X.word_tokens("text", STOPS)).alias("n"))
    return docs.filter(F.col("n") >= 3)


STEM_SQL = "CASE WHEN length(w) > 5 AND right(w, 3) IN ('ing', 'ion', 'ent') THEN left(w, length(w) - 3) ELSE w END"


# The stem table is derived from the corpus itself: suffix-stripped long words.
@query("f15_stem_map", f"""
SELECT doc_id, array_to_string(list_filter(list_transform({tokens_sql('text')}, lambda w: {STEM_SQL}), lambda w: length(w) > 2), ' ') AS v
FROM documents
""")
def f15_stem_map(t: Tables):
    docs = t.texts().select("doc_id", X.word_tokens("text", STOPS).alias("tokens"))
    words = docs.select(F.explode("tokens").alias("token")).distinct()
    long = (F.length("token") > 5) & F.right("token", F.lit(3)).isin("ing", "ion", "ent")
    stems = words.filter(long).select("token", F.expr("left(token, length(token) - 3)").alias("stem"))
    stemmed = K.apply_stems(docs, "tokens", stems)
    return stemmed.select("doc_id", X.join_tokens(X.min_token_len("tokens")).alias("v"))


# Customers whose key is also a supplier's get that name, the others keep their key.
@query("f17_display_name", """
SELECT c_custkey, coalesce(s_name, c_custkey::VARCHAR) AS s_name FROM customer LEFT JOIN supplier ON c_custkey = s_suppkey
""")
def f17_display_name(t: Tables):
    dim = t.supplier.select(F.col("s_suppkey").alias("c_custkey"), "s_name")
    return display_name(t.customer.select("c_custkey"), dim, "c_custkey", "s_name")


@query("f26_left", "SELECT doc_id, substr(text, 1, 45) AS v FROM documents")
def f26_left(t: Tables):
    return t.documents.select("doc_id", left_n("text", 45).alias("v"))


@query("f27_slug", "SELECT o_orderkey, translate(replace(lower('Ö Kü ' || o_orderpriority), ' ', '_'), 'üöı', 'uoi') AS v FROM orders")
def f27_slug(t: Tables):
    return t.orders.select("o_orderkey", slug(F.concat(F.lit("Ö Kü "), "o_orderpriority")).alias("v"))


@query("f29_line", """
SELECT l_orderkey, l_linenumber, l_returnflag || ' | ' || l_linestatus || ': ' || printf('%.1f', l_quantity) AS line FROM lineitem
""")
def f29_line(t: Tables):
    return t.lineitem.select(
        "l_orderkey", "l_linenumber",
        F.format_string("%s | %s: %.1f", "l_returnflag", "l_linestatus", "l_quantity").alias("line"),
    )


@query("t3_ngrams", """
WITH g AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') AS l FROM documents),
a AS (SELECT doc_id, l || list_transform(range(1, len(l)), lambda i: l[i] || ' ' || l[i + 1]) AS terms FROM g)
SELECT doc_id, len(terms)::INTEGER AS n, md5(array_to_string(terms, '|')) AS v FROM a
""")
def t3_ngrams(t: Tables):
    terms = X.ngrams("tokens", 1, 2)
    docs = t.texts().select("doc_id", X.feature_tokens("text").alias("tokens"))
    return docs.select("doc_id", F.size(terms).alias("n"), digest(X.join_tokens(terms, "|")).alias("v"))


# --- categories -----------------------------------------------------------------------

MAPPING = [("small", "size"), ("large", "size"), ("red", "colour"), ("blue", "colour"), ("green", "colour"), ("ring", "ring")]
MAPPING_SQL = "(VALUES " + ", ".join(f"('{k}', '{c}')" for k, c in MAPPING) + ") AS m(keyword, category)"
HITS = "SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS keyword FROM part"
COUNTS = f"SELECT p_brand, coalesce(m.category, h.keyword) AS category, CAST(count(*) AS BIGINT) AS n FROM ({HITS}) h LEFT JOIN {MAPPING_SQL} USING (keyword) GROUP BY 1, 2"


def _mapping(t: Tables):
    """The same term list for every brand found in the data."""
    terms = F.explode(F.array(*[F.struct(F.lit(k).alias("keyword"), F.lit(c).alias("category")) for k, c in MAPPING]))
    return t.part.select("p_brand").distinct().select("p_brand", terms.alias("m")).select("p_brand", "m.*")


def _counts(t: Tables):
    return C.category_counts(t.part, _mapping(t), "p_brand", C.split_keywords("p_name", " "))


@query("j1_map_join", f"""
SELECT p_partkey, keyword, coalesce(m.category, h.keyword) AS category FROM ({HITS}) h LEFT JOIN {MAPPING_SQL} USING (keyword)
""")
def j1_map_join(t: Tables):
    hits = t.part.select("p_partkey", "p_brand", F.explode(C.split_keywords("p_name", " ")).alias("keyword"))
    return C.canonical_keywords(hits, _mapping(t), "p_brand").select("p_partkey", "keyword", "category")


@query("a19_categories", COUNTS)
def a19_categories(t: Tables):
    return _counts(t)


@query("a20_share", f"""
SELECT p_brand, category, n, round_even(100.0 * n / sum(n) OVER (PARTITION BY p_brand), 6) AS share FROM ({COUNTS})
""")
def a20_share(t: Tables):
    return C.category_share(_counts(t), "p_brand").withColumn("share", r6("share"))


@query("w7_share_of_total", """
WITH c AS (SELECT o_orderpriority, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2)
SELECT o_orderpriority, o_orderstatus, n, round_even(100.0 * n / sum(n) OVER (PARTITION BY o_orderpriority), 6) AS share FROM c
""")
def w7_share_of_total(t: Tables):
    counts = P.value_counts(t.orders, ["o_orderpriority", "o_orderstatus"])
    return C.share_of_total(counts, "o_orderpriority", "n").withColumn("share", r6("share"))


@query("o2_top_categories", f"""
SELECT * FROM (SELECT p_brand, category, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, category)::INTEGER AS rank FROM ({COUNTS}))
WHERE rank <= 15
""")
def o2_top_categories(t: Tables):
    return C.top_categories(_counts(t), "p_brand")


@query("o2_top_first_seen", f"""
WITH h AS (SELECT p_brand, p_partkey, unnest(string_split(p_name, ' ')) AS keyword, generate_subscripts(string_split(p_name, ' '), 1) AS pos FROM part),
c AS (SELECT p_brand, coalesce(m.category, h.keyword) AS category, CAST(count(*) AS BIGINT) AS n, min((p_partkey, pos)) AS f
      FROM h LEFT JOIN {MAPPING_SQL} USING (keyword) GROUP BY 1, 2)
SELECT p_brand, category, n, rank FROM (
  SELECT p_brand, category, n, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, f)::INTEGER AS rank FROM c) WHERE rank <= 15
""")
def o2_top_first_seen(t: Tables):
    return C.first_seen_categories(t.part, _mapping(t), "p_brand", C.split_keywords("p_name", " "), "p_partkey")


@query("a21_merged", f"""
SELECT p_brand, category, list_sort(list(DISTINCT keyword)) AS terms
FROM (SELECT DISTINCT p_brand FROM part), {MAPPING_SQL} WHERE keyword <> category GROUP BY 1, 2
""")
def a21_merged(t: Tables):
    return C.merged_categories(_mapping(t), "p_brand")


# --- corpus words -----------------------------------------------------------------------

@query("a22_top_words", f"""
WITH w AS (SELECT lang, unnest({tokens_sql('text')}) AS term FROM documents),
c AS (SELECT lang, term, count(*) AS n FROM w GROUP BY 1, 2)
SELECT * FROM (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term)::INTEGER AS rank FROM c) WHERE rank <= 100
""")
def a22_top_words(t: Tables):
    return K.top_words(t.texts("lang"), "lang", X.word_tokens("text", STOPS))


@query("a23_cleaning", f"""
WITH c AS (SELECT lang, len(regexp_extract_all(text, '{NOT_WS}')) AS before, {tokens_sql('text')} AS l FROM documents)
SELECT lang, count(*) AS n, round_even(avg(before), 6) AS words_before, round_even(avg(len(l)), 6) AS words_after,
       count(*) FILTER (len(l) = 0) AS n_blank, count(*) FILTER (length(array_to_string(l, ' ')) > 3) AS n_kept
FROM c GROUP BY lang
""")
def a23_cleaning(t: Tables):
    d = t.texts("lang").select("lang", X.word_count("text").alias("before"), X.word_tokens("text", STOPS).alias("tokens"))
    s = P.cleaning_stats(d, "lang", F.col("before"), F.size("tokens"), X.join_tokens("tokens"))
    return s.withColumn("words_before", r6("words_before")).withColumn("words_after", r6("words_after"))


@query("s6_conform", """
SELECT p_name AS title, coalesce(p_brand, '') AS operator, '' AS company_reply, p_size AS view_count FROM part
""")
def s6_conform(t: Tables):
    p = t.part.select(F.col("p_brand").alias("operator"), F.col("p_name").alias("title"), F.col("p_size").alias("view_count"))
    return conform(p, ["title", "operator", "company_reply", "view_count"])


@query("s10_terms", "SELECT DISTINCT lower(unnest(string_split(p_name || ' ' || p_type, ' '))) AS term FROM part")
def s10_terms(t: Tables):
    words = F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " "))
    lists = t.part.select(F.lit("part").alias("category"), words.alias("term"))
    return K.stopword_terms(K.build_stopwords(lists))


UNION = """
SELECT c_custkey AS key, c_name AS name, c_acctbal AS balance, 'customer' AS group_key, 'Customer' AS group_name FROM customer
UNION ALL SELECT s_suppkey, s_name, s_acctbal, 'supplier', 'Supplier' FROM supplier
"""


@query("s2_union", UNION)
def s2_union(t: Tables):
    c = t.customer.select(F.col("c_custkey").alias("key"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"))
    s = t.supplier.select(F.col("s_suppkey").alias("key"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"))
    return tag_and_union({"customer": c, "supplier": s}, {"customer": "Customer", "supplier": "Supplier"})


@query("u1_union", """
SELECT c_name AS name, c_mktsegment AS segment, 'c' AS group_key, 'c' AS group_name FROM customer
UNION ALL SELECT s_name, NULL, 's', 's' FROM supplier
""")
def u1_union(t: Tables):
    c = t.customer.select(F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"))
    return tag_and_union({"c": c, "s": t.supplier.select(F.col("s_name").alias("name"))})


LISTS = """
SELECT category, trim(lower(term)) AS term FROM (
  SELECT 'name' AS category, unnest(string_split(p_name, ' ')) AS term FROM part
  UNION ALL SELECT 'type', unnest(string_split(' ' || p_type, ' ')) FROM part
  UNION ALL SELECT 'brand', unnest(string_split(p_brand, '#')) FROM part)
WHERE trim(term) <> ''
"""


def _lists(t: Tables):
    def words(name, text, sep=" "):
        return t.part.select(F.lit(name).alias("category"), F.explode(F.split(text, sep)).alias("term"))

    return (
        words("name", F.col("p_name"))
        .unionByName(words("type", F.concat(F.lit(" "), F.col("p_type"))))
        .unionByName(words("brand", F.col("p_brand"), "#"))
    )


@query("u2_stopwords", f"SELECT DISTINCT term FROM ({LISTS})")
def u2_stopwords(t: Tables):
    return K.stopword_terms(K.build_stopwords(_lists(t)))


@query("u3_sizes", f"SELECT category, count(DISTINCT term) AS n FROM ({LISTS}) GROUP BY category")
def u3_sizes(t: Tables):
    return K.stopword_sizes(K.build_stopwords(_lists(t)))


@query("o4_sample", f"""
WITH p AS (SELECT doc_id, text, array_to_string({tokens_sql('text')}, ' ') AS clean FROM documents)
SELECT doc_id, substr(text, 1, 250) AS before, substr(clean, 1, 250) AS after FROM p WHERE length(clean) > 20
ORDER BY md5('42:' || doc_id), doc_id LIMIT 3
""")
def o4_sample(t: Tables):
    d = t.texts().select("doc_id", "text", X.clean_text("text", STOPS).alias("clean"))
    s = K.stable_sample(d, "doc_id", 3, 42, X.min_len("clean", 20))
    return s.select("doc_id", left_n("text", 250).alias("before"), left_n("clean", 250).alias("after"))


@query("o5_preview", "SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 5")
def o5_preview(t: Tables):
    return t.part.select("p_partkey", "p_name").orderBy("p_partkey").limit(5)
