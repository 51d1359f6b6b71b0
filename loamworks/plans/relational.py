"""Catalogue: reads, reports, ledgers and versions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.operators import relational as R
from loamworks.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query over named tables: its parameters are the tables."""

    def register(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read_table(spark, sf_dir, n) for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


SIGNED = "CASE WHEN event_type = 'purchase' THEN value WHEN event_type = 'refund' THEN -value ELSE 0 END"


@query("SELECT o_orderkey, o_totalprice, o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50")
def history_filter_topn(orders: DataFrame) -> DataFrame:
    return R.newest(orders, "o_orderdate", "o_orderkey", 50, F.col("o_orderstatus") == "O").select("o_orderkey", "o_totalprice", "o_orderdate")


@query("SELECT p_partkey, p_name, p_brand, p_type FROM part WHERE p_name ILIKE '%st%' OR p_brand ILIKE '%#1%' OR p_type ILIKE '%steel%'")
def history_search_ilike(part: DataFrame) -> DataFrame:
    return R.search(part.select("p_partkey", "p_name", "p_brand", "p_type"), "st", ["p_name"]).unionByName(R.search(part.select("p_partkey", "p_name", "p_brand", "p_type"), "#1", ["p_brand"])).unionByName(R.search(part.select("p_partkey", "p_name", "p_brand", "p_type"), "steel", ["p_type"])).distinct()


@query("SELECT p_partkey, p_name, p_size, p_retailprice, (SELECT count(*) FROM part WHERE p_size >= 10 AND p_retailprice <= 1500) AS total FROM part WHERE p_size >= 10 AND p_retailprice <= 1500 ORDER BY p_retailprice DESC, p_partkey OFFSET 20 LIMIT 20")
def market_search_page(part: DataFrame) -> DataFrame:
    found = R.market(part, at_least={"p_size": 10}, at_most={"p_retailprice": 1500})
    return R.page(found.select("p_partkey", "p_name", "p_size", "p_retailprice"), "p_retailprice", "p_partkey", True, 20, 20)


@query("SELECT * FROM orders WHERE o_orderkey = 7")
def point_lookup(orders: DataFrame) -> DataFrame:
    return orders.where(F.col("o_orderkey") == 7)


@query("SELECT o_orderkey, o_orderstatus, count(l_linenumber) AS creators FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def preview_redact(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    return orders.join(lineitem, F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderkey", "o_orderstatus").agg(F.count("l_linenumber").alias("creators"))


@query("SELECT doc_id, CASE WHEN length(text) > 120 THEN substring(text, 1, 120) || '…' ELSE text END AS preview, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS longer FROM documents")
def preview_truncate(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", R.ellipsis(F.col("text"), 120).alias("preview"), R.ellipsis(F.col("text"), 200).alias("longer"))


@query("SELECT o_orderkey, CASE WHEN o_totalprice <= 0 THEN 'not positive' WHEN o_totalprice > 1000000 THEN 'too large' WHEN o_totalprice > 2 * 150000.0::DOUBLE THEN 'above twice the list price' END AS refused, round(o_totalprice, 2) AS cents FROM orders")
def request_validation(orders: DataFrame) -> DataFrame:
    return orders.select("o_orderkey", R.price_check(F.col("o_totalprice"), F.lit(150000.0)).alias("refused"), F.round("o_totalprice", 2).alias("cents"))


@query("SELECT doc_id, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def materials_semi(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels, "doc_id", "left_semi").select("doc_id", "source")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def materials_anti(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels, "doc_id", "left_anti").select("doc_id", "source")


@query("SELECT doc_id FROM labels EXCEPT SELECT doc_id FROM documents WHERE lang = 'en'")
def requested_not_found(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return labels.select("doc_id").subtract(documents.where(F.col("lang") == "en").select("doc_id"))


@query("SELECT doc_id, coalesce(quality, -1) AS quality, source FROM documents LEFT JOIN labels USING (doc_id) WHERE quality IS DISTINCT FROM 1")
def left_with_default(documents: DataFrame, labels: DataFrame) -> DataFrame:
    return documents.join(labels, "doc_id", "left").where(~F.col("quality").eqNullSafe(1)).select("doc_id", F.coalesce("quality", F.lit(-1)).alias("quality"), "source")


@query("SELECT coalesce(a.lang, b.lang) AS lang, coalesce(a.n, 0) AS good, coalesce(b.n, 0) AS toxic FROM (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE quality = 1 GROUP BY lang) a FULL JOIN (SELECT lang, count(*) AS n FROM documents JOIN labels USING (doc_id) WHERE toxic = 1 GROUP BY lang) b ON a.lang = b.lang")
def full_outer_fusion(documents: DataFrame, labels: DataFrame) -> DataFrame:
    both = documents.join(labels, "doc_id")
    good, bad = (both.where(F.col(c) == 1).groupBy("lang").agg(F.count("*").alias(n)) for c, n in (("quality", "good"), ("toxic", "toxic")))
    return good.join(bad, "lang", "full").na.fill(0, ["good", "toxic"])


@query("SELECT l_orderkey, l_linenumber, coalesce(p_retailprice, 0) AS backfilled FROM lineitem LEFT JOIN part ON l_partkey = p_partkey AND p_size < 25")
def backfill_update_join(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    some = part.where("p_size < 25").select("p_partkey", "p_retailprice")
    return lineitem.join(some, F.col("l_partkey") == F.col("p_partkey"), "left").select("l_orderkey", "l_linenumber", F.coalesce("p_retailprice", F.lit(0.0)).alias("backfilled"))


@query("SELECT o_orderpriority AS modality, count(*) AS n, round(avg(CASE WHEN o_totalprice > 0 THEN o_totalprice END), 2) AS avg_price, max(o_totalprice) AS max_price FROM orders GROUP BY 1")
def modality_stats(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.col("o_orderpriority").alias("modality")).agg(F.count("*").alias("n"), F.round(F.avg(F.when(F.col("o_totalprice") > 0, F.col("o_totalprice"))), 2).alias("avg_price"), F.max("o_totalprice").alias("max_price"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 4) AS avg_value FROM events WHERE event_type <> '' GROUP BY event_type ORDER BY n DESC, event_type LIMIT 10")
def top_scenes(events: DataFrame) -> DataFrame:
    counts = events.where("event_type <> ''").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 4).alias("avg_value"))
    return R.top(counts, "n", "event_type", 10)


@query("SELECT round(avg(l_quantity) FILTER (WHERE l_quantity > 0), 4) AS avg_quality, count(*) AS n FROM lineitem")
def average_quality(lineitem: DataFrame) -> DataFrame:
    return lineitem.agg(F.round(F.avg(F.when(F.col("l_quantity") > 0, F.col("l_quantity"))), 4).alias("avg_quality"), F.count("*").alias("n"))


@query("SELECT (SELECT count(*) FROM documents) AS materials, (SELECT count(*) FROM conversations) AS samples, (SELECT count(*) FROM part) AS packages, (SELECT count(*) FROM customer) AS buyers, (SELECT round(sum(o_totalprice), 2) FROM orders) AS revenue")
def platform_counts(documents: DataFrame, conversations: DataFrame, part: DataFrame, customer: DataFrame, orders: DataFrame) -> DataFrame:
    out = documents.agg(F.count("*").alias("materials"))
    for df, name in ((conversations, "samples"), (part, "packages"), (customer, "buyers")):
        out = out.join(F.broadcast(df.agg(F.count("*").alias(name))))
    return out.join(F.broadcast(orders.agg(F.round(F.sum("o_totalprice"), 2).alias("revenue"))))


@query("SELECT count(DISTINCT l_suppkey) AS creators, count(DISTINCT l_partkey) AS packages FROM lineitem")
def distinct_creators(lineitem: DataFrame) -> DataFrame:
    return lineitem.agg(F.countDistinct("l_suppkey").alias("creators"), F.countDistinct("l_partkey").alias("packages"))


@query("SELECT l_suppkey, round(sum(l_extendedprice), 2) AS total, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'F'), 0), 2) AS settled, round(coalesce(sum(l_extendedprice) FILTER (WHERE l_linestatus = 'O'), 0), 2) AS pending FROM lineitem GROUP BY 1")
def conditional_sums(lineitem: DataFrame) -> DataFrame:
    of = lambda s: F.round(F.sum(F.when(F.col("l_linestatus") == s, F.col("l_extendedprice")).otherwise(0)), 2)
    return lineitem.groupBy("l_suppkey").agg(F.round(F.sum("l_extendedprice"), 2).alias("total"), of("F").alias("settled"), of("O").alias("pending"))


@query(f"SELECT user_id, round(sum({SIGNED}), 4) AS balance FROM events GROUP BY user_id")
def ledger_balance(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.round(F.sum(F.expr(SIGNED)), 4).alias("balance"))


@query(f"SELECT event_id, user_id, round(sum({SIGNED}) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 4) AS balance_after FROM events")
def ledger_running(events: DataFrame) -> DataFrame:
    return R.running_balance(events, "user_id", "ts", "event_id", F.expr(SIGNED)).select("event_id", "user_id", F.round("balance_after", 4).alias("balance_after"))


@query("WITH b AS (SELECT user_id, round(sum(value), 4) AS pending FROM events WHERE event_type = 'purchase' GROUP BY 1) SELECT *, CASE WHEN pending >= 10 THEN pending ELSE 0 END AS settled, CASE WHEN pending >= 10 THEN 0 ELSE pending END AS pending_after FROM b")
def settle(events: DataFrame) -> DataFrame:
    return R.settle(events.where("event_type = 'purchase'").groupBy("user_id").agg(F.round(F.sum("value"), 4).alias("pending")))


@query("SELECT l_suppkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS earned FROM lineitem GROUP BY 1 ORDER BY earned DESC, l_suppkey LIMIT 20")
def leaderboard(lineitem: DataFrame) -> DataFrame:
    sums = lineitem.groupBy("l_suppkey").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("earned"))
    return R.top(sums, "earned", "l_suppkey", 20)


@query("SELECT l_suppkey, strftime(l_shipdate, '%Y-%m') AS month, round(sum(l_extendedprice), 2) AS earned, count(DISTINCT l_partkey) AS packages FROM lineitem GROUP BY 1, 2")
def monthly_earnings(lineitem: DataFrame) -> DataFrame:
    return lineitem.groupBy("l_suppkey", F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(F.round(F.sum("l_extendedprice"), 2).alias("earned"), F.countDistinct("l_partkey").alias("packages"))


@query("SELECT user_id, event_id, ts, turn FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS turn FROM events) WHERE turn <= 10")
def latest_records(events: DataFrame) -> DataFrame:
    return R.first_n(events, "user_id", 10, F.desc("ts"), F.asc("event_id")).select("user_id", "event_id", "ts", "turn")


@query("SELECT lang, source, count(*) AS n, round(avg(n_chars), 4) AS avg_chars FROM documents GROUP BY ALL")
def market_distribution(documents: DataFrame) -> DataFrame:
    return documents.groupBy("lang", "source").agg(F.count("*").alias("n"), F.round(F.avg("n_chars"), 4).alias("avg_chars"))


@query("SELECT p_brand, p_type, count(*) AS n, round(sum(p_retailprice), 2) AS listed, grouping(p_brand)::INT AS g_brand, grouping(p_type)::INT AS g_type FROM part GROUP BY ROLLUP (p_brand, p_type)")
def market_rollup(part: DataFrame) -> DataFrame:
    return part.rollup("p_brand", "p_type").agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("listed"), F.grouping("p_brand").cast("int").alias("g_brand"), F.grouping("p_type").cast("int").alias("g_type"))


@query("SELECT p_brand, coalesce(p_size, -1) AS p_size, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_size)")
def market_cube(part: DataFrame) -> DataFrame:
    return part.cube("p_brand", "p_size").agg(F.count("*").alias("n")).withColumn("p_size", F.coalesce("p_size", F.lit(-1)))


@query("SELECT CASE WHEN p_retailprice >= 1500 THEN 'high' WHEN p_retailprice >= 1200 THEN 'good' WHEN p_retailprice >= 1000 THEN 'fair' ELSE 'low' END AS bucket, count(*) AS n FROM part GROUP BY 1")
def quality_buckets(part: DataFrame) -> DataFrame:
    p = F.col("p_retailprice")
    return part.groupBy(F.when(p >= 1500, "high").when(p >= 1200, "good").when(p >= 1000, "fair").otherwise("low").alias("bucket")).agg(F.count("*").alias("n"))


@query("WITH e AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) SELECT least(floor((o_totalprice - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM orders, e GROUP BY 1")
def price_histogram(orders: DataFrame) -> DataFrame:
    return R.histogram(orders, "o_totalprice")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def share_of_total(orders: DataFrame) -> DataFrame:
    return R.shares(orders, "o_orderpriority")


@query("SELECT round(sum(a * n) / sum(n), 4) AS mean FROM (SELECT avg(o_totalprice) AS a, count(*) AS n FROM orders GROUP BY o_orderstatus)")
def weighted_mean(orders: DataFrame) -> DataFrame:
    each = orders.groupBy("o_orderstatus").agg(F.avg("o_totalprice").alias("a"), F.count("*").alias("n"))
    return each.agg(F.round(F.sum(F.col("a") * F.col("n")) / F.sum("n"), 4).alias("mean"))


VERSIONS = "SELECT o_orderpriority AS name, date_trunc('month', o_orderdate)::DATE AS month, count(*) AS samples, round(avg(o_totalprice), 4) AS quality FROM orders GROUP BY 1, 2"


def _versions(orders: DataFrame) -> DataFrame:
    month = F.trunc("o_orderdate", "month").alias("month")
    return orders.groupBy(F.col("o_orderpriority").alias("name"), month).agg(F.count("*").alias("samples"), F.round(F.avg("o_totalprice"), 4).alias("quality"))


@query(f"SELECT name, month::VARCHAR AS month, samples, quality, '1.0.' || (row_number() OVER w - 1) AS version, samples - coalesce(lag(samples) OVER w, 0) AS delta_samples, round(quality - coalesce(lag(quality) OVER w, 0), 4) AS delta_quality, (lag(month) OVER w)::VARCHAR AS previous FROM ({VERSIONS}) WINDOW w AS (PARTITION BY name ORDER BY month)")
def version_snapshot(orders: DataFrame) -> DataFrame:
    return R.snapshots(_versions(orders), "name", "month", ["samples", "quality"]).withColumns({"month": F.col("month").cast("string"), "previous": F.col("previous").cast("string")})


@query(f"WITH v AS ({VERSIONS}), x AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY month) AS k FROM v) SELECT a.name, b.samples - a.samples AS samples, round(b.quality - a.quality, 4) AS quality FROM x a JOIN x b ON a.name = b.name AND a.k = 1 AND b.k = 5")
def version_diff(orders: DataFrame) -> DataFrame:
    x = _versions(orders).withColumn("k", F.row_number().over(Window.partitionBy("name").orderBy("month")))
    a, b = x.where("k = 1").alias("a"), x.where("k = 5").alias("b")
    return a.join(b, F.col("a.name") == F.col("b.name")).select(F.col("a.name").alias("name"), (F.col("b.samples") - F.col("a.samples")).alias("samples"), F.round(F.col("b.quality") - F.col("a.quality"), 4).alias("quality"))


STAGES = "SELECT date_trunc('day', ts)::DATE::VARCHAR AS job, CASE event_type WHEN 'view' THEN 'safety' WHEN 'click' THEN 'annotation' WHEN 'purchase' THEN 'scoring' ELSE 'packaging' END AS stage, count(*) AS rows_in, count(*) FILTER (WHERE value > 20) AS rows_out, round(avg(value) / 10, 4) AS score, round(sum(value) / 20, 4) AS seconds FROM events GROUP BY 1, 2"


def _stages(events: DataFrame) -> DataFrame:
    stage = F.when(F.col("event_type") == "view", "safety").when(F.col("event_type") == "click", "annotation").when(F.col("event_type") == "purchase", "scoring").otherwise("packaging")
    rows = events.groupBy(F.to_date("ts").cast("string").alias("job"), stage.alias("stage"))
    return rows.agg(F.count("*").alias("rows_in"), F.count(F.when(F.col("value") > 20, 1)).alias("rows_out"), F.round(F.avg("value") / 10, 4).alias("score"), F.round(F.sum("value") / 20, 4).alias("seconds"))


@query(f"SELECT job, sum(rows_in)::BIGINT AS rows_in, sum(rows_out)::BIGINT AS rows_out, ((2 * sum(round(score * 10000)::BIGINT) FILTER (WHERE score > 0) + count(*) FILTER (WHERE score > 0)) // nullif(2 * count(*) FILTER (WHERE score > 0), 0))::DOUBLE / 10000 AS avg_score, ((sum(round(seconds * 10000)::BIGINT) + 50) // 100)::DOUBLE / 100 AS seconds, round(coalesce(sum(rows_out) / nullif(sum(rows_in), 0), 0), 4) AS pass_rate FROM ({STAGES}) GROUP BY job")
def job_rollup(events: DataFrame) -> DataFrame:
    return R.job_rollup(_stages(events))


@query(f"WITH s AS (SELECT job, stage, seconds, score, 100.0::DOUBLE * (rows_in - rows_out) / rows_in AS f, 100.0::DOUBLE * rows_out / rows_in AS p FROM ({STAGES})) SELECT job, stage, 'slow' AS alert FROM s WHERE seconds > 60 UNION ALL SELECT job, stage, 'low_score' FROM s WHERE score > 0 AND score < 3 UNION ALL SELECT job, stage, 'failures' FROM s WHERE f > 40 UNION ALL SELECT job, stage, 'low_pass' FROM s WHERE stage = 'scoring' AND p < 60")
def stage_alerts(events: DataFrame) -> DataFrame:
    rows = _stages(events).withColumn("failed_pct", 100.0 * (F.col("rows_in") - F.col("rows_out")) / F.col("rows_in")).withColumn("pass_pct", 100.0 * F.col("rows_out") / F.col("rows_in"))
    return R.stage_alerts(rows, seconds=60, passed=60).select("job", "stage", "alert")


@query("SELECT event_id, CASE WHEN event_type = 'purchase' AND value > 90 THEN 'approved' ELSE event_type END AS status, CASE WHEN event_type = 'purchase' AND value > 90 THEN 'reviewer' END AS reviewer FROM events")
def review_update(events: DataFrame) -> DataFrame:
    rows = events.select("event_id", "value", F.col("event_type").alias("status"), F.lit(None).cast("string").alias("reviewer"))
    return R.updated(rows, (F.col("status") == "purchase") & (F.col("value") > 90), reviewer=F.lit("reviewer"), status=F.lit("approved")).select("event_id", "status", "reviewer")


@query("SELECT event_id, ts FROM events WHERE NOT (ts < TIMESTAMP '2024-01-10')")
def delete_by_age(events: DataFrame) -> DataFrame:
    return R.without(events, F.col("ts") < F.to_timestamp(F.lit("2024-01-10"))).select("event_id", "ts")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 2 = 0 UNION ALL SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey % 3 = 0 AND o_orderkey % 2 <> 0")
def bulk_insert_ignore(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_totalprice")
    return R.insert_ignore(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0"), "o_orderkey")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 ELSE o_totalprice END AS o_totalprice FROM orders WHERE o_orderkey % 2 = 0 OR o_orderkey % 3 = 0")
def upsert_by_key(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_totalprice")
    return R.upsert(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 3 = 0").withColumn("o_totalprice", F.lit(0.0)), "o_orderkey")


@query("SELECT '# HELP orders_' || lower(o_orderstatus) || ' rows' || chr(10) || '# TYPE orders_' || lower(o_orderstatus) || ' gauge' || chr(10) || 'orders_' || lower(o_orderstatus) || ' ' || count(*) AS line FROM orders GROUP BY o_orderstatus")
def metrics_exposition(orders: DataFrame) -> DataFrame:
    return R.exposition(orders.groupBy(F.concat(F.lit("orders_"), F.lower("o_orderstatus")).alias("metric")).agg(F.count("*").alias("value")).withColumn("help", F.lit("rows")))


@query("SELECT 'sft' AS kind, conv_id AS id, text FROM conversations WHERE role = 'user' UNION ALL SELECT 'dpo', conv_id, text FROM conversations WHERE role <> 'user'")
def union_previews(conversations: DataFrame) -> DataFrame:
    rows = lambda kind, where: conversations.where(where).select(F.lit(kind).alias("kind"), F.col("conv_id").alias("id"), "text")
    return rows("sft", "role = 'user'").unionByName(rows("dpo", "role <> 'user'"), allowMissingColumns=True)


@query("SELECT row_number() OVER (ORDER BY ts, event_id) AS k, strftime(ts, '%m-%d') AS day, round(value, 2) AS price FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 60)")
def trend_projection(events: DataFrame) -> DataFrame:
    last = events.orderBy(F.desc("ts"), F.desc("event_id")).limit(60)
    return last.select(F.row_number().over(Window.orderBy("ts", "event_id")).alias("k"), F.date_format("ts", "MM-dd").alias("day"), F.round("value", 2).alias("price"))


@query("SELECT event_id, event_type, round(quantile_cont(value, 0.15) OVER (PARTITION BY event_type), 6) AS p15 FROM events")
def percentile_window(events: DataFrame) -> DataFrame:
    edges = events.groupBy("event_type").agg(F.round(F.percentile("value", 0.15), 6).alias("p15"))
    return events.select("event_id", "event_type").join(F.broadcast(edges), "event_type")


@query("SELECT strftime(o_orderdate, '%Y') AS year, count(*) FILTER (WHERE o_orderstatus = 'F') AS F, count(*) FILTER (WHERE o_orderstatus = 'O') AS O, count(*) FILTER (WHERE o_orderstatus = 'P') AS P FROM orders GROUP BY 1")
def status_pivot(orders: DataFrame) -> DataFrame:
    return orders.groupBy(F.date_format("o_orderdate", "yyyy").alias("year")).pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count("o_orderkey")).na.fill(0)


@query("SELECT c_custkey, c_name, n_name, r_name, orders, spent FROM (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS spent FROM orders GROUP BY 1) JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def buyer_report(orders: DataFrame, customer: DataFrame, nation: DataFrame, region: DataFrame) -> DataFrame:
    spent = orders.groupBy("o_custkey").agg(F.count("*").alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("spent"))
    out = spent.join(customer, F.col("o_custkey") == F.col("c_custkey")).join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    return out.select("c_custkey", "c_name", "n_name", "r_name", "orders", "spent")
