"""All queries over the driver's tables, each with its SQL. The tables stand in for postings, graduates and the survey."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import complement, one_decimal
from ..operators import cleaning, gaps, governance, quality, rates, shares
from ..sources import landed, sinks
from ..sources.tables import table
from . import jobs

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Stand-ins of the queries below: fixed values.
URGENT = "1-URGENT"
NATION_GROUPS = {"group_a": 0.75, "group_b": 0.25}
CODE_RULES = [("(?i)\\bidiot|\\bmoron|\\bscum", "900001"), ("(?i)token = |password", "900002")]
CODES = [("en", "100001", "west"), ("de", "100002", "west"), ("fr", "100003", "south")]
EDUCATION = [("^(STANDARD|SMALL)", "high_school"), ("^(MEDIUM|LARGE)", "associate"), ("^ECONOMY", "no_requirement"), ("^PROMO", "bachelor_plus")]
INDUSTRIES = [("BUILD|FURNI", "construction"), ("MACHIN", "manufacturing")]
FIELDS = [("Brand#11", "engineering"), ("Brand#12", "engineering"), ("Brand#21", "education")]


def query(sql: str | None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _orders_by_nation(spark: SparkSession, d: str) -> DataFrame:
    orders = table(spark, d, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority", "o_totalprice")
    customers = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    return orders.join(customers, "o_custkey")


@query("SELECT p_type AS category, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM part GROUP BY 1")
def edu_total_distribution(spark, d):
    return shares.distribution(table(spark, d, "part"), F.col("p_type"))


@query("""
WITH c AS (SELECT count(*) AS n0, count(*) FILTER (o_orderstatus = 'F') AS n1,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS n2,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 100000) AS n3 FROM orders),
s AS (SELECT 0 AS step, 'all' AS label, n0 AS n, n0 AS f FROM c UNION ALL SELECT 1, '+ finished', n1, n0 FROM c
  UNION ALL SELECT 2, '+ urgent', n2, n0 FROM c UNION ALL SELECT 3, '+ large', n3, n0 FROM c)
SELECT step, label, n, round(100.0e0 * n / nullif(f, 0), 1) AS pct FROM s""")
def funnel_cumulative(spark, d):
    steps = [("all", F.lit(True)), ("+ finished", F.col("o_orderstatus") == "F"), ("+ urgent", F.col("o_orderpriority") == URGENT), ("+ large", F.col("o_totalprice") >= 100000)]
    return shares.funnel(table(spark, d, "orders"), steps)


@query("""
SELECT p_brand, count(*) AS n, round(100.0e0 * count(*) FILTER (p_size <= 10) / count(*), 1) AS small,
  round(100.0e0 * count(*) FILTER (p_size > 10 AND p_size <= 30) / count(*), 1) AS middle,
  round(100.0e0 * count(*) FILTER (p_size > 30) / count(*), 1) AS large, count(*) < 75 AS low_sample
FROM part GROUP BY p_brand""")
def group_class_crosstab(spark, d):
    size = F.col("p_size")
    return shares.crosstab(table(spark, d, "part"), "p_brand", {"small": size <= 10, "middle": (size > 10) & (size <= 30), "large": size > 30}, 75)


@query("""
SELECT c_mktsegment, count(*) AS n, round(100.0e0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS finished,
  round(100.0e0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 1) AS urgent, count(*) < 100 AS low_sample
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def group_conditional_rates(spark, d):
    return rates.conditional_rates(_orders_by_nation(spark, d), "c_mktsegment", {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == URGENT})


@query("""
SELECT n_name, count(*) AS n, round(100.0e0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS finished,
  round(100.0e0 * count(*) FILTER (o_orderpriority = '1-URGENT') / count(*), 1) AS urgent, count(*) < 600 AS low_sample
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def district_rates(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_name")
    rows = cleaning.lookup(_orders_by_nation(spark, d), nation, "c_nationkey")
    return rates.conditional_rates(rows, "n_name", {"finished": F.col("o_orderstatus") == "F", "urgent": F.col("o_orderpriority") == URGENT}, 600)


@query("""
WITH a AS (SELECT c_nationkey AS k, 100.0e0 * count(*) / sum(count(*)) OVER () AS s FROM customer WHERE c_nationkey <> 7 GROUP BY 1),
b AS (SELECT c_nationkey AS k, count(*) AS n, 100.0e0 * count(*) / sum(count(*)) OVER () AS s
      FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS code, round(coalesce(a.s, 0), 1) AS left_share, round(coalesce(b.s, 0), 1) AS right_share,
  round(coalesce(a.s, 0) - coalesce(b.s, 0), 1) AS diff_pp, b.n AS n_right, b.n < 600 AS low_sample
FROM a FULL JOIN b ON a.k = b.k""")
def share_difference_pp(spark, d):
    left = table(spark, d, "customer").withColumnRenamed("c_nationkey", "code")
    right = _orders_by_nation(spark, d).withColumnRenamed("c_nationkey", "code")
    return shares.share_difference(
        shares.classified_shares(left, "code", "share", F.col("code") == 7), shares.classified_shares(right, "code", "share", F.col("code") == 3), "code", 600
    )


@query("""
WITH o AS (SELECT c_nationkey AS code, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
p AS (SELECT c_nationkey AS code, count(*) AS people FROM customer WHERE c_nationkey <> 5 GROUP BY 1)
SELECT code, n, people, round(10000.0e0 * n / nullif(people, 0), 1) AS rate FROM o LEFT JOIN p USING (code)""")
def rate_per_10k(spark, d):
    counts = shares.totals(_orders_by_nation(spark, d).withColumnRenamed("c_nationkey", "code"), "code")
    people = table(spark, d, "customer").filter("c_nationkey <> 5").groupBy(F.col("c_nationkey").alias("code")).agg(F.count("*").alias("people"))
    return rates.rate_per_people(counts, people, "code")


@query("SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1")
def group_totals(spark, d):
    return shares.totals(table(spark, d, "customer"), "c_nationkey")


@query("""
WITH e AS (SELECT c_mktsegment, count(*) AS n, round(100.0e0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS exit_pct,
  round(avg(o_totalprice) FILTER (o_orderstatus <> 'F'), 1) AS stay_income, round(avg(o_totalprice) FILTER (o_orderstatus = 'F'), 1) AS leave_income
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
g AS (SELECT c_mktsegment, count(*) AS graduates FROM customer WHERE c_mktsegment <> 'FURNITURE' GROUP BY 1)
SELECT * FROM e LEFT JOIN g USING (c_mktsegment)""")
def exit_rate_income(spark, d):
    rows = rates.exit_rates(_orders_by_nation(spark, d), "c_mktsegment", F.col("o_orderstatus") == "F", F.col("o_totalprice"))
    graduates = shares.totals(table(spark, d, "customer").filter("c_mktsegment <> 'FURNITURE'"), "c_mktsegment")
    return rates.with_totals(rows, graduates, "c_mktsegment", "graduates")


@query("""
WITH s AS (SELECT c_mktsegment, avg(o_totalprice) FILTER (l) AS m1, avg(o_totalprice) FILTER (NOT l) AS m0,
  var_samp(o_totalprice) FILTER (l) / nullif(count(o_totalprice) FILTER (l), 0) AS e1,
  var_samp(o_totalprice) FILTER (NOT l) / nullif(count(o_totalprice) FILTER (NOT l), 0) AS e0,
  count(*) FILTER (l) AS n1, count(*) FILTER (NOT l) AS n0
  FROM (SELECT *, o_orderstatus = 'F' AS l FROM orders JOIN customer ON o_custkey = c_custkey) GROUP BY 1)
SELECT c_mktsegment, round(m1 - m0, 1) AS gap, round((m1 - m0) / nullif(sqrt(e1 + e0), 0), 1) AS t_stat,
  round((e1 + e0) * (e1 + e0) / nullif(e1 * e1 / nullif(n1 - 1, 0) + e0 * e0 / nullif(n0 - 1, 0), 0), 1) AS df,
  coalesce(abs((m1 - m0) / nullif(sqrt(e1 + e0), 0)) > 1.96, false) AS significant FROM s""")
def welch_gap(spark, d):
    return gaps.welch_gap(_orders_by_nation(spark, d), ["c_mktsegment"], F.col("o_orderstatus") == "F", F.col("o_totalprice"))


@query("""
SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 1) AS income, round(avg(0.25e0 * c_nationkey), 1) AS cost,
  round(avg(c_acctbal) - avg(0.25e0 * c_nationkey), 1) AS net, round(median(c_acctbal), 1) AS income_median,
  round(median(0.25e0 * c_nationkey), 1) AS cost_median FROM customer GROUP BY 1""")
def segment_mean_median(spark, d):
    return gaps.segment_stats(table(spark, d, "customer"), "c_mktsegment", F.col("c_acctbal"), F.lit(0.25) * F.col("c_nationkey"))


@query("""
WITH m AS (SELECT l_returnflag AS flag, avg(l_extendedprice) AS i, avg(l_extendedprice - l_extendedprice * l_discount) AS n FROM lineitem GROUP BY 1),
g AS (SELECT flag, i - (SELECT i FROM m WHERE flag = 'N') AS gi, n - (SELECT n FROM m WHERE flag = 'N') AS gn FROM m WHERE flag <> 'N')
SELECT flag, round(gi, 1) AS gap, round(gn, 1) AS net_gap, round(100.0e0 * gn / nullif(gi, 0), 1) AS retained_pct FROM g""")
def retained_gap(spark, d):
    lines = table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "flag")
    return gaps.retained_gap(lines, "flag", "N", F.col("l_extendedprice"), F.col("l_extendedprice") * F.col("l_discount"))


@query("""
WITH v AS (SELECT event_type = 'purchase' AS l, value AS v FROM events WHERE value IS NOT NULL AND event_type IS NOT NULL),
p AS (SELECT quantile_cont(v, 0.01) AS a, quantile_cont(v, 0.25) AS b, quantile_cont(v, 0.75) AS c, quantile_cont(v, 0.99) AS d FROM v),
t AS (SELECT l, v, CASE WHEN v BETWEEN a AND d THEN v END AS tr, least(greatest(v, a), d) AS cl,
      CASE WHEN v BETWEEN b - 1.5e0 * (c - b) AND c + 1.5e0 * (c - b) THEN v END AS iq FROM v, p)
SELECT 'raw' AS treatment, count(v) AS n, round(avg(v) FILTER (l) - avg(v) FILTER (NOT l), 1) AS gap FROM t
UNION ALL SELECT 'trimmed', count(tr), round(avg(tr) FILTER (l) - avg(tr) FILTER (NOT l), 1) FROM t
UNION ALL SELECT 'clipped', count(cl), round(avg(cl) FILTER (l) - avg(cl) FILTER (NOT l), 1) FROM t
UNION ALL SELECT 'iqr', count(iq), round(avg(iq) FILTER (l) - avg(iq) FILTER (NOT l), 1) FROM t
UNION ALL SELECT 'median', count(v), round(median(v) FILTER (l) - median(v) FILTER (NOT l), 1) FROM t""")
def outlier_sensitivity(spark, d):
    return gaps.outlier_sensitivity(table(spark, d, "events"), F.col("event_type") == "purchase", F.col("value"))


@query("""
SELECT event_id, user_id FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(ts AS DATE)
  ORDER BY ts DESC, event_id) AS k FROM events) WHERE k = 1""")
def dedupe_latest(spark, d):
    events = table(spark, d, "events").select("event_id", "user_id", "event_type", "ts", F.col("ts").cast("date").alias("day"))
    newest_first = -F.unix_micros(F.col("ts").cast("timestamp"))
    return cleaning.latest(events, ["user_id", "event_type", "day"], [newest_first, F.col("event_id")]).select("event_id", "user_id")


@query("SELECT user_id, event_type, count(*) AS n, max(event_id) AS last_id, CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS total_cents FROM events GROUP BY 1, 2")
def merge_items(spark, d):
    return cleaning.merge_items(table(spark, d, "events"), ["user_id", "event_type"], n=F.count("*"), last_id=F.max("event_id"), total_cents=F.sum(F.round(F.col("value") * 100).cast("long")))


@query(r"""
WITH c AS (SELECT doc_id, text, nullif(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '') AS clean FROM documents)
SELECT doc_id, md5(clean) AS clean_md5, CASE WHEN text IS NULL THEN 'missing' WHEN clean IS NULL THEN 'blank' WHEN length(clean) < 20 THEN 'short' END AS reason FROM c""")
def normalise_text(spark, d):
    rows = cleaning.normalise(table(spark, d, "documents").select("doc_id", "text"), "text", 20)
    return rows.select("doc_id", F.md5("clean").alias("clean_md5"), "reason")


@query(r"""
WITH c AS (SELECT doc_id, CASE WHEN text = 'That it.' THEN '900000' END AS e,
  CASE WHEN regexp_matches(text, '(?i)\bidiot|\bmoron|\bscum') THEN '900001' WHEN regexp_matches(text, '(?i)token = |password') THEN '900002' END AS r, text FROM documents)
SELECT doc_id, coalesce(coalesce(e, r), 'unclassified') AS code,
  CASE WHEN e IS NOT NULL THEN 'high' WHEN r IS NOT NULL THEN 'medium' ELSE 'none' END AS confidence,
  CASE WHEN coalesce(e, r) IS NOT NULL THEN NULL WHEN text IS NULL OR text = '' THEN 'no text' ELSE 'no rule' END AS reason FROM c""")
def classify_with_reason(spark, d):
    rows = cleaning.classify(table(spark, d, "documents").select("doc_id", "text"), F.col("text"), {"That it.": "900000"}, CODE_RULES)
    return rows.select("doc_id", cleaning.kept_group(F.col("code")).alias("code"), "confidence", "reason")


@query("SELECT o_orderkey FROM orders WHERE CAST(o_orderdate AS DATE) <= DATE '1996-06-30' AND CAST(o_orderdate AS DATE) + 30 >= DATE '1996-06-30'")
def asof_snapshot(spark, d):
    orders = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").cast("date").alias("opens"))
    return cleaning.as_of(orders.withColumn("closes", F.date_add("opens", 30)), "opens", "closes", "1996-06-30").select("o_orderkey")


@query("SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def code_crosswalk_unmatched(spark, d):
    return cleaning.unmatched(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("""
WITH codes(lang, code6, major) AS (VALUES ('en', '100001', 'west'), ('de', '100002', 'west'), ('fr', '100003', 'south'))
SELECT coalesce(major, 'unclassified') AS major, count(*) AS n FROM documents LEFT JOIN codes USING (lang) GROUP BY 1""")
def code_lookup_groups(spark, d):
    codes = spark.createDataFrame(CODES, "lang string, code6 string, major string")
    rows = cleaning.lookup(table(spark, d, "documents").select("lang"), codes, "lang")
    return shares.totals(rows.select(cleaning.kept_group(F.col("major")).alias("major")), "major")


@query("""
WITH w(c_mktsegment, target, weight) AS (SELECT s, t, w FROM (SELECT DISTINCT c_mktsegment AS s FROM customer), (VALUES ('group_a', 0.75e0), ('group_b', 0.25e0)) v(t, w))
SELECT target, sum(n * weight) AS value FROM (SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1) JOIN w USING (c_mktsegment) GROUP BY 1""")
def bridge_distribution(spark, d):
    customers = table(spark, d, "customer")
    spread = F.array(*[F.struct(F.lit(k).alias("target"), F.lit(v).alias("weight")) for k, v in NATION_GROUPS.items()])
    weights = customers.select("c_mktsegment").distinct().select("c_mktsegment", F.inline(spread))
    return rates.bridge(shares.totals(customers, "c_mktsegment"), weights, "c_mktsegment", "target")


@query("SELECT 'customer' AS source, c_custkey AS key, c_acctbal AS acctbal FROM customer UNION ALL SELECT 'supplier', s_suppkey, s_acctbal FROM supplier")
def union_sources(spark, d):
    a = table(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_acctbal").alias("acctbal"))
    b = table(spark, d, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_acctbal").alias("acctbal"))
    return landed.combined({"customer": a, "supplier": b}, "source")


@query("SELECT source, count(*) AS n FROM documents WHERE source NOT IN ('src3', 'src7') GROUP BY 1")
def excluded_sources(spark, d):
    excluded = spark.createDataFrame([("src3",), ("src7",)], "source string")
    return shares.totals(landed.without_sources(table(spark, d, "documents").select("source"), excluded, "source"), "source")


@query("""
WITH c AS (SELECT count(*) AS n0, count(*) FILTER (length(text) >= 20) AS n1, count(*) FILTER (length(text) >= 20 AND n_chars < 20000) AS n2,
  count(*) FILTER (length(text) >= 20 AND n_chars < 20000 AND lang = 'en') AS n3 FROM documents)
SELECT 0 AS stage_no, 'collected' AS stage, n0 AS n FROM c UNION ALL SELECT 1, 'normalised', n1 FROM c
UNION ALL SELECT 2, 'merged', n2 FROM c UNION ALL SELECT 3, 'region', n3 FROM c""")
def stage_counts(spark, d):
    stages = [("collected", F.lit(True)), ("normalised", F.length("text") >= 20), ("merged", F.col("n_chars") < 20000), ("region", F.col("lang") == "en")]
    return quality.stage_counts(table(spark, d, "documents"), stages)


@query("""
SELECT lang, count(*) FILTER (toxic = 1) AS num, count(*) AS den_all, count(toxic) AS den_stated,
  round(100.0e0 * count(*) FILTER (toxic = 1) / count(*), 1) AS rate_all,
  round(100.0e0 * count(*) FILTER (toxic = 1) / nullif(count(toxic), 0), 1) AS rate_stated
FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def two_denominators(spark, d):
    rows = table(spark, d, "documents").select("doc_id", "lang").join(table(spark, d, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return quality.two_denominators(rows, "lang", F.col("toxic") == 1, F.col("toxic").isNotNull())


@query("""
SELECT 75 AS min_sample, coalesce(string_agg(p_brand, ',' ORDER BY p_brand), '') AS low_groups
FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) WHERE n < 75""")
def low_sample_groups(spark, d):
    return quality.low_groups(shares.totals(table(spark, d, "part"), "p_brand"), "p_brand", 75)


@query("SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host FROM pages")
def page_fields(spark, d):
    pages = table(spark, d, "pages")
    return pages.select("page_id", *[c.alias(k) for k, c in cleaning.page_fields(F.col("html"), F.col("url")).items()])


@query("""
SELECT CASE WHEN grouping(p_type) = 1 THEN '(all)' ELSE p_type END AS subset, count(*) AS n,
  round(corr(p_size::DOUBLE, p_retailprice) * 100, 1) + 0.0e0 AS corr_pct FROM part GROUP BY ROLLUP (p_type)""")
def relationship_robustness(spark, d):
    return gaps.robustness(table(spark, d, "part"), "p_type", F.col("p_size"), F.col("p_retailprice"))


@query("""
SELECT 'orders have a customer' AS "check", 0.0e0 AS expected, (count(*) - count(c_custkey))::DOUBLE AS actual, count(*) = count(c_custkey) AS ok
FROM orders LEFT JOIN customer ON o_custkey = c_custkey
UNION ALL SELECT 'shares add up', 100.0e0, sum(p), abs(100 - sum(p)) < 1e-6 FROM (SELECT 100.0e0 * count(*) / sum(count(*)) OVER () AS p FROM part GROUP BY p_type)
UNION ALL SELECT 'keys are unique', count(*)::DOUBLE, count(DISTINCT o_orderkey)::DOUBLE, count(*) = count(DISTINCT o_orderkey) FROM orders""")
def quality_checks(spark, d):
    orders = table(spark, d, "orders")
    joined = orders.join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"), "left")
    parts = shares.classified_shares(table(spark, d, "part"), "p_type", "share", F.lit(False))
    return quality.checks(
        [
            ("orders have a customer", joined, F.lit(0.0), F.count("*") - F.count("c_custkey")),
            ("shares add up", parts, F.lit(100.0), F.round(F.sum("share"), 6)),
            ("keys are unique", orders, F.count("*"), F.count_distinct("o_orderkey")),
        ]
    )


@query("""
SELECT CASE WHEN c_nationkey IN (0, 1, 2) THEN 'stay' WHEN c_nationkey IN (3, 4) THEN 'capital' ELSE 'other' END AS segment, count(*) AS n,
  round(100.0e0 - 100.0e0 * count(*) FILTER (c_acctbal < 0) / count(*), 1) AS not_negative FROM customer GROUP BY 1""")
def segment_labels(spark, d):
    rows = table(spark, d, "customer").withColumn("segment", cleaning.segment(F.col("c_nationkey"), [0, 1, 2], [3, 4]))
    share = F.lit(100.0) * F.count_if(F.col("c_acctbal") < 0) / F.count("*")
    return rows.groupBy("segment").agg(F.count("*").alias("n"), one_decimal(complement(share)).alias("not_negative"))


@query("SELECT n_regionkey, count(*) AS people FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1")
def population_rollup(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = cleaning.lookup(table(spark, d, "customer").select("c_nationkey"), nation, "c_nationkey")
    return shares.totals(rows, "n_regionkey").withColumnRenamed("n", "people")


@query("SELECT strftime(date_trunc('month', CAST(o_orderdate AS DATE)), '%Y-%m') AS month, count(*) AS n FROM orders WHERE date_trunc('month', CAST(o_orderdate AS DATE)) BETWEEN DATE '1995-08-01' AND DATE '1996-07-01' GROUP BY 1")
def monthly_openings(spark, d):
    rows = landed.months(table(spark, d, "orders"), "o_orderdate", "1995-08-01", "1996-07-01")
    return shares.totals(rows.select(F.date_format("o_orderdate", "yyyy-MM").alias("month")), "month")


@query("SELECT count(*) AS n, round(sum(s_acctbal), 1) AS total FROM supplier")
def policy_totals(spark, d):
    return table(spark, d, "supplier").agg(F.count("*").alias("n"), one_decimal(F.sum("s_acctbal")).alias("total"))


@query("SELECT p_brand, n FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) ORDER BY n DESC, p_brand LIMIT 10")
def top_groups(spark, d):
    return shares.top(shares.totals(table(spark, d, "part"), "p_brand"), "n", "p_brand", 10)


@query("""
WITH l AS (SELECT count(*) AS den, count(*) FILTER (toxic = 1) AS num FROM labels), o AS (SELECT count(*) AS den, count(*) FILTER (o_orderstatus = 'F') AS num FROM orders)
SELECT 'finished orders' AS metric, round(100.0e0 * num / den, 1) AS value, num AS numerator, den AS denominator, 'all orders' AS basis FROM o""")
def metric_register(spark, d):
    """The registered numbers that may be used, with what they were made of."""
    finished = table(spark, d, "orders").agg(F.count_if(F.col("o_orderstatus") == "F").alias("num"), F.count("*").alias("den"))
    toxic = table(spark, d, "labels").agg(F.count_if(F.col("toxic") == 1).alias("num"), F.count("*").alias("den"))
    row = lambda df, metric, basis, allowed, reason: df.select(
        F.lit(metric).alias("metric"), one_decimal(F.lit(100.0) * F.col("num") / F.col("den")).alias("value"), F.col("num").alias("numerator"),
        F.col("den").alias("denominator"), F.lit(basis).alias("basis"), F.lit(allowed).alias("allowed"), F.lit(reason).alias("reason"),
    )
    registered = row(finished, "finished orders", "all orders", True, "").union(row(toxic, "toxic documents", "labelled only", False, "basis not stated in the text"))
    return governance.usable(registered).drop("allowed", "reason")


@query("""
WITH a AS (SELECT c_nationkey AS k, 100.0e0 * count(*) / sum(count(*)) OVER () AS s FROM customer GROUP BY 1),
b AS (SELECT c_nationkey AS k, 100.0e0 * count(*) / sum(count(*)) OVER () AS s FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_nationkey <> 3 GROUP BY 1)
SELECT coalesce(a.k, b.k) AS key, round(coalesce(a.s, 0) - coalesce(b.s, 0), 1) AS diff_pp FROM a FULL JOIN b ON a.k = b.k""")
def governed_comparison(spark, d):
    """A year's flow and a day's stock compare in percentage points only, joined by code and rounded last."""
    nobody = F.lit(False)
    a = shares.classified_shares(table(spark, d, "customer"), "c_nationkey", "share", nobody)
    b = shares.classified_shares(_orders_by_nation(spark, d).filter("c_nationkey <> 3"), "c_nationkey", "share", nobody)
    return governance.compare(governance.Measure(a, "c_nationkey", "share", "percent", "flow", "code"), governance.Measure(b, "c_nationkey", "share", "percent", "stock", "code"))


@query("""
WITH c AS (SELECT CASE WHEN regexp_matches(p_type, '^(STANDARD|SMALL)') THEN 'high_school' WHEN regexp_matches(p_type, '^(MEDIUM|LARGE)') THEN 'associate'
  WHEN regexp_matches(p_type, '^ECONOMY') THEN 'no_requirement' WHEN regexp_matches(p_type, '^PROMO') THEN 'bachelor_plus' ELSE 'unstated' END AS education FROM part)
SELECT education AS category, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM c GROUP BY 1""")
def education_classes(spark, d):
    return shares.distribution(table(spark, d, "part"), cleaning.first_class(F.col("p_type"), EDUCATION, "unstated"))


@query("""
SELECT CASE WHEN regexp_matches(c_mktsegment, 'BUILD|FURNI') THEN 'construction' WHEN regexp_matches(c_mktsegment, 'MACHIN') THEN 'manufacturing' ELSE '(unknown)' END AS industry,
  count(*) AS n, round(100.0e0 * count(*) FILTER (o_orderstatus = 'F') / count(*), 1) AS finished, count(*) < 100 AS low_sample
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1""")
def industry_buckets(spark, d):
    rows = _orders_by_nation(spark, d).withColumn("industry", cleaning.first_class(F.col("c_mktsegment"), INDUSTRIES, "(unknown)"))
    return rates.conditional_rates(rows, "industry", {"finished": F.col("o_orderstatus") == "F"})


@query("""
WITH known(district) AS (VALUES ('en'), ('de'), ('fr')), f AS (SELECT regexp_extract(url, '^[a-z]+://[^/]+/([a-z]+)', 1) AS found FROM pages)
SELECT coalesce(district, '(unknown)') AS district, count(*) AS n FROM f LEFT JOIN known ON found = district GROUP BY 1""")
def district_from_address(spark, d):
    known = spark.createDataFrame([("en",), ("de",), ("fr",)], "district string")
    found = F.regexp_extract("url", "^[a-z]+://[^/]+/([a-z]+)", 1)
    return shares.totals(cleaning.validated(table(spark, d, "pages").select("url"), found, known, "district"), "district")


@query("""
WITH fields(p_brand, field) AS (VALUES ('Brand#11', 'engineering'), ('Brand#12', 'engineering'), ('Brand#21', 'education'))
SELECT coalesce(field, '(unknown)') AS field, CAST(sum(p_size) AS BIGINT) AS n FROM part LEFT JOIN fields USING (p_brand) GROUP BY 1""")
def graduates_by_field(spark, d):
    """Majors go to fields by code; a field's graduates are the sum of a column, not of rows."""
    rows = cleaning.lookup(table(spark, d, "part").select("p_brand", "p_size"), spark.createDataFrame(FIELDS, "p_brand string, field string"), "p_brand")
    return shares.totals(rows.select(cleaning.kept_group(F.col("field"), "(unknown)").alias("field"), "p_size"), "field", F.col("p_size"))


@query("""
SELECT n_regionkey, CAST(sum(CAST(round(c_acctbal * 100) AS BIGINT)) AS BIGINT) AS people
FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def population_by_region(spark, d):
    """Small areas with their numbers of people are summed up to larger ones."""
    nation = table(spark, d, "nation").select(F.col("n_nationkey").alias("c_nationkey"), "n_regionkey")
    rows = cleaning.lookup(table(spark, d, "customer").select("c_nationkey", "c_acctbal"), nation, "c_nationkey")
    return shares.totals(rows, "n_regionkey", F.round(F.col("c_acctbal") * 100).cast("long")).withColumnRenamed("n", "people")


@query("""
SELECT p_brand, n, row_number() OVER (ORDER BY n DESC, p_brand) AS position FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1)""")
def sorted_result_set(spark, d):
    return shares.ranked(shares.totals(table(spark, d, "part"), "p_brand"), "n", "p_brand")


@query(r"""
WITH c AS (SELECT doc_id, lang, source, nullif(trim(regexp_replace(lower(text), '\s+', ' ', 'g')), '') AS clean FROM documents),
n AS (SELECT * FROM c WHERE length(clean) >= 20),
m AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY clean, source ORDER BY doc_id) AS k FROM n) WHERE k = 1),
r AS (SELECT * FROM m WHERE lang = 'en'),
k AS (SELECT * FROM r WHERE regexp_matches(clean, '(?i)\bidiot|\bmoron|\bscum|token = |password'))
SELECT 0 AS stage_no, 'collected' AS stage, count(*) AS n FROM documents UNION ALL SELECT 1, 'normalised', count(*) FROM n
UNION ALL SELECT 2, 'merged', count(*) FROM m UNION ALL SELECT 3, 'region', count(*) FROM r UNION ALL SELECT 4, 'classified', count(*) FROM k""")
def whole_run(spark, d):
    """From landed rows to classified items, a table for each stage, in the session's shared folder or its warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    rules = jobs.Rules("text", ["clean", "source"], [F.col("doc_id")], F.col("lang") == "en", {}, CODE_RULES, 20)
    return jobs.prepare(table(spark, d, "documents").select("doc_id", "text", "lang", "source"), rules, f"{base}/whole_run-{uuid.uuid4().hex}")


@query("""
WITH t AS (SELECT p_type AS category, count(*) AS n, round(100.0e0 * count(*) / sum(count(*)) OVER (), 1) AS pct FROM part GROUP BY 1),
c AS (SELECT count(*) AS n0, count(*) FILTER (o_orderstatus = 'F') AS n1,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT') AS n2,
  count(*) FILTER (o_orderstatus = 'F' AND o_orderpriority = '1-URGENT' AND o_totalprice >= 100000) AS n3 FROM orders),
s AS (SELECT 0 AS step, 'all' AS label, n0 AS n, n0 AS f FROM c UNION ALL SELECT 1, '+ finished', n1, n0 FROM c
  UNION ALL SELECT 2, '+ urgent', n2, n0 FROM c UNION ALL SELECT 3, '+ large', n3, n0 FROM c),
f AS (SELECT step, label, n, round(100.0e0 * n / nullif(f, 0), 1) AS pct FROM s),
l AS (SELECT coalesce(string_agg(p_brand, ',' ORDER BY p_brand), '') AS low_groups FROM (SELECT p_brand, count(*) AS n FROM part GROUP BY 1) WHERE n < 75)
SELECT CAST(to_json(struct_pack(
  edu_total := (SELECT list(struct_pack(category := category, n := n, pct := pct) ORDER BY pct DESC, category) FROM t),
  funnel := (SELECT list(struct_pack(label := label, n := n, pct := pct) ORDER BY step) FROM f),
  quality := (SELECT struct_pack(min_sample := 75, low_groups := low_groups) FROM l))) AS VARCHAR) AS document""")
def json_document(spark, d):
    """One JSON document of several result sets."""
    total = sinks.as_array(edu_total_distribution(spark, d), "edu_total", [-F.col("pct"), F.col("category")], ["category", "n", "pct"])
    funnel = sinks.as_array(funnel_cumulative(spark, d), "funnel", [F.col("step")], ["label", "n", "pct"])
    low = low_sample_groups(spark, d).select(F.struct("min_sample", "low_groups").alias("quality"))
    return sinks.json_document([total, funnel, low])
