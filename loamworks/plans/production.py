"""Catalogue: samples from models' answers, issues, the deduplication cascade, accounts, and features of the SQL surface."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamworks.functions import fixed, registry, sketches
from loamworks.operators import dedup, ledgers
from loamworks.operators import relational as R
from loamworks.operators import texts as X
from loamworks.plans.texts import PAIRED, SETS, _paired, _sql_qc
from loamworks.session import Workspace, read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    """Registers a query over named tables: its parameters are the tables."""

    def register(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read_table(spark, sf_dir, n) for n in names])
        SQL[f.__name__] = sql
        return f

    return register


ASKED = f"'{fixed.ASK_SFT}' || replace(substring(text, 1, 80), chr(10), ' ')"


def _sql_greedy(rows: str, least: float) -> str:
    """CTEs s (rows of doc_id and content with 3-grams), e (similar pairs) and lost: ids dropped in order, by a walk over pairs' later ends."""
    return f"""cut AS MATERIALIZED (SELECT doc_id, substring(replace(coalesce(content, ''), ' ', ''), 1, 2000) AS t FROM {rows}),
s AS MATERIALIZED (SELECT doc_id, list_distinct(list_transform(range(1, length(t) - 1), lambda i: hash(substring(t, i, 3)))) AS g FROM cut),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, len(a.g) + len(b.g) AS total, len(list_intersect(a.g, b.g)) AS shared FROM s a JOIN s b
  ON a.doc_id < b.doc_id AND len(a.g) > 0 AND least(len(a.g), len(b.g)) >= {least} * greatest(len(a.g), len(b.g))),
e AS MATERIALIZED (SELECT a, b FROM p WHERE shared / (total - shared) >= {least}),
n AS MATERIALIZED (SELECT b, list(a) AS earlier, row_number() OVER (ORDER BY b) AS i FROM e GROUP BY b),
walk AS (SELECT 0::BIGINT AS i, []::BIGINT[] AS dropped UNION ALL
  SELECT n.i, CASE WHEN len(list_filter(n.earlier, lambda x: NOT list_contains(w.dropped, x))) > 0 THEN list_append(w.dropped, n.b) ELSE w.dropped END FROM walk w JOIN n ON n.i = w.i + 1),
lost AS (SELECT unnest(dropped) AS doc_id FROM walk WHERE i = (SELECT max(i) FROM walk))"""


CASCADE = f"""WITH RECURSIVE made AS (SELECT doc_id, {ASKED} || substring(text, 1, 600) AS content FROM documents),
once AS (SELECT min(doc_id) AS doc_id, any_value(content) AS content FROM made GROUP BY md5(coalesce(content, ''))),
{_sql_greedy('once', 0.85)},
fuzzy AS (SELECT doc_id, embedding::DOUBLE[] AS v FROM once LEFT JOIN embeddings ON vec_id = doc_id WHERE doc_id NOT IN (SELECT doc_id FROM lost)),
close AS (SELECT doc_id FROM fuzzy x WHERE EXISTS (SELECT 1 FROM fuzzy y WHERE y.doc_id < x.doc_id AND list_cosine_similarity(y.v, x.v) >= 0.92))
SELECT *, input_count - exact_removed - fuzzy_removed - semantic_removed AS output_count FROM (SELECT (SELECT count(*) FROM made) AS input_count, (SELECT count(*) FROM made) - (SELECT count(*) FROM once) AS exact_removed,
  (SELECT count(*) FROM lost) AS fuzzy_removed, (SELECT count(*) FROM close) AS semantic_removed)"""


@query(CASCADE)
def dedup_cascade(documents: DataFrame, embeddings: DataFrame) -> DataFrame:
    made = documents.select("doc_id", X.annotate_sft(F.col("text"), F.col("lang")).alias("s"))
    made = made.select("doc_id", F.concat("s.instruction", "s.output").alias("content"))
    vectors = embeddings.select(F.col("vec_id").alias("doc_id"), "embedding")
    return dedup.cascade(made.join(vectors, "doc_id", "left"), "doc_id", "content", "embedding")[1]


HARD = f"""list_filter([CASE WHEN i = '' THEN '{fixed.SFT_ISSUES["empty"]}' WHEN length(i) < 5 THEN '{fixed.SFT_ISSUES["short"]}' END, CASE WHEN length(o) < 10 THEN '{fixed.SFT_ISSUES["short_output"]}' END,
  CASE WHEN NOT regexp_matches(i || o, '[\\x{{4e00}}-\\x{{9fff}}a-zA-Z]') THEN '{fixed.SFT_ISSUES["no_letters"]}' END], lambda x: x IS NOT NULL)"""
REPORT = f"""WITH p AS (SELECT conv_id, turn, text AS i, reply AS o, ({_sql_qc('text', 'reply')}) AS mean FROM ({PAIRED})),
q AS (SELECT *, turn % 2 = 0 AND i <> '' AS asked, {HARD} AS own, CASE WHEN turn % 4 = 0 THEN ['vague'] ELSE ['vague', '{fixed.SFT_ISSUES["short_output"]}'] END AS says FROM p),
r AS (SELECT *, CASE WHEN asked THEN list_filter(own, lambda x: NOT list_contains(says, x)) ELSE [] END AS missed FROM q),
t AS (SELECT *, CASE WHEN i = '' THEN 0 WHEN asked THEN round(greatest(0, round(round(length(i) % 11 * 0.6::DOUBLE + (mean + (6 - 7.0::DOUBLE) / 6) * 0.4::DOUBLE, 9), 2) - 0.5::DOUBLE * len(missed)), 2)
  ELSE round(round(greatest(0, least(10, mean * 0.6::DOUBLE + 2.2::DOUBLE)), 9), 2) END AS qc_score, CASE WHEN asked THEN list_concat(says, missed) ELSE own END AS list FROM r)
SELECT conv_id, turn, qc_score::DOUBLE AS qc_score, array_to_string(list, '|') AS issues, CASE WHEN asked THEN 'model' ELSE 'rule' END AS scored_by,
  qc_score >= 5 AND NOT contains(array_to_string(list, '|'), '{fixed.EMPTY}') AND NOT contains(array_to_string(list, '|'), '{fixed.SHORT}') AS passed FROM t"""


@query(REPORT)
def qc_issues(conversations: DataFrame) -> DataFrame:
    unknown = F.lit(None).cast("double")
    says = F.when(F.col("turn") % 4 == 0, F.array(F.lit("vague"))).otherwise(F.array(F.lit("vague"), F.lit(fixed.SFT_ISSUES["short_output"])))
    scores = [unknown.alias(k) for k in ("completeness", "output_quality", "language_fluency", "instruction_clarity", "relevance")]
    model = F.struct(*scores, F.lit(6.0).alias("factuality"), (F.length("text") % 11).cast("double").alias("overall"), says.alias("issues"))
    pairs = _paired(conversations).withColumn("model", F.when(F.col("turn") % 2 == 0, model))
    report = X.qc_sft_report(F.col("text"), F.col("reply"), F.lit(5.5), F.col("model"))
    return pairs.select("conv_id", "turn", report.alias("r")).select("conv_id", "turn", "r.qc_score", F.array_join("r.issues", "|").alias("issues"), "r.scored_by", "r.passed")


ALIKE = fixed.DPO_ISSUES["alike"]
CHARS = SETS.replace("substring({0}, 1, 200)", "{0}")
JUDGED = f"""WITH p AS (SELECT conv_id, turn, text AS c, CASE WHEN turn % 5 = 0 THEN text ELSE reply END AS r FROM ({PAIRED})),
k AS (SELECT *, {CHARS.format('c')} AS x, {CHARS.format('r')} AS y FROM p),
j AS (SELECT *, CASE WHEN c <> '' AND r <> '' THEN len(list_intersect(x, y)) / (len(x) + len(y) - len(list_intersect(x, y))) END AS alike FROM k),
o AS (SELECT *, list_filter([CASE WHEN c = '' THEN 'chosen {fixed.EMPTY}' END, CASE WHEN r = '' THEN 'rejected {fixed.EMPTY}' END, CASE WHEN c <> '' AND r <> '' AND c = r THEN '{fixed.DPO_ISSUES["same"]}' END,
  CASE WHEN alike > 0.9 THEN '{ALIKE[0]}' || round_even(alike * 100, 0)::INT || '{ALIKE[1]}' END], lambda z: z IS NOT NULL) AS own FROM j),
i AS (SELECT *, turn % 2 = 0 AND len(own) = 0 AS asked, CASE WHEN turn % 2 = 0 AND len(own) = 0 THEN ['weak {fixed.PREFERENCE}', 'other'] ELSE own END AS list FROM o)
SELECT conv_id, turn, CASE WHEN c = '' OR r = '' THEN 0 WHEN asked THEN 6.5 ELSE 5 - len(list) END::DOUBLE AS qc_score, array_to_string(list, '|') AS issues, CASE WHEN asked THEN 'model' ELSE 'rule' END AS scored_by,
  c <> '' AND r <> '' AND (asked OR len(list) = 0) AS passed FROM i"""


@query(JUDGED)
def qc_dpo_issues(conversations: DataFrame) -> DataFrame:
    pairs = _paired(conversations).withColumn("rejected", F.when(F.col("turn") % 5 == 0, F.col("text")).otherwise(F.col("reply")))
    model = F.struct(F.lit(7.5).alias("overall"), F.array(F.lit(f"weak {fixed.PREFERENCE}"), F.lit("other")).alias("issues"))
    report = X.qc_dpo_report(F.lit("?"), F.col("text"), F.col("rejected"), F.lit(5.0), F.when(F.col("turn") % 2 == 0, model))
    return pairs.select("conv_id", "turn", report.alias("r")).select("conv_id", "turn", "r.qc_score", F.array_join("r.issues", "|").alias("issues"), "r.scored_by", "r.passed")


READ = "doc_id % 5 IN (0, 1)"


@query(
    f"SELECT doc_id, CASE WHEN {READ} THEN 'about ' || source ELSE {ASKED} END AS instruction, CASE WHEN {READ} THEN lang ELSE substring(text, 1, 600) END AS output, "
    f"CASE WHEN {READ} THEN 'general' ELSE coalesce(lang, 'general') END AS domain, CASE doc_id % 5 WHEN 0 THEN 7.5 WHEN 1 THEN 6 ELSE 5.5 END::DOUBLE AS annot_score, "
    f"CASE WHEN doc_id % 5 = 0 THEN 'gold' ELSE 'silver' END AS tier, CASE WHEN {READ} THEN 'model' ELSE 'rule' END AS annotated_by FROM documents"
)
def annotate_from_model(documents: DataFrame) -> DataFrame:
    said = F.concat(F.lit("about "), F.coalesce("source", F.lit("")))
    scored = F.to_json(F.struct(said.alias("instruction"), F.coalesce("lang", F.lit("")).alias("output"), F.lit(7.5).alias("quality_score")))
    bare = F.to_json(F.struct(said.alias("instruction"), F.coalesce("lang", F.lit("")).alias("output")))
    kind = F.col("doc_id") % 5
    raw = F.when(kind == 0, F.concat(F.lit("```json\n"), scored, F.lit("\n```"))).when(kind == 1, bare).when(kind == 2, F.lit('{"instruction": ')).when(kind == 3, F.lit("{}"))
    made = documents.select("doc_id", X.annotated_sft(raw, F.col("text"), F.col("lang")).alias("s"))
    return made.select("doc_id", "s.instruction", "s.output", "s.domain", "s.annot_score", "s.tier", "s.annotated_by")


@query(
    "SELECT event_id::VARCHAR AS entry_id, user_id::VARCHAR AS creator_id, value AS amount, 0.0::DOUBLE AS balance_after, 'credit' AS entry_type, md5(event_id::VARCHAR) AS reference_id, "
    "'package ' || substring(md5(event_id::VARCHAR), 1, 8) || '…' AS note, ts AS created_at FROM events WHERE event_type = 'purchase' ORDER BY ts DESC, event_id LIMIT 50"
)
def ledger_entries(events: DataFrame) -> DataFrame:
    records = R.newest(events, "ts", "event_id", 50, F.col("event_type") == "purchase")
    package = F.md5(F.col("event_id").cast("string")).alias("package_id")
    return R.ledger_entries(records.select(F.col("event_id").alias("record_id"), F.col("user_id").alias("creator_id"), F.col("value").alias("creator_share"), package, F.col("ts").alias("created_at")))


@query("SELECT doc_id, source, lang, n_chars FROM documents WHERE source = (SELECT min(source) FROM documents) ORDER BY doc_id DESC LIMIT 50")
def materials_by_creator(documents: DataFrame) -> DataFrame:
    creator = documents.agg(F.min("source").alias("source"))
    own = documents.select("doc_id", "source", "lang", "n_chars").join(F.broadcast(creator), "source")  # one row
    return R.newest(own, "doc_id", "doc_id", 50).select("doc_id", "source", "lang", "n_chars")


@query("SELECT user_id, arg_max(event_type, (ts, event_id)) AS event_type, arg_max(value, (ts, event_id)) AS value, count(*) AS changes FROM events WHERE NOT coalesce(value < 10, false) GROUP BY user_id")
def latest_state(events: DataFrame) -> DataFrame:
    return R.latest_state(events, "user_id", "ts", "event_id", ["event_type", "value"], F.col("value") < 10)


@query("SELECT o_orderkey, o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS has_alert FROM orders")
def open_jobs(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    alerts = lineitem.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("l_returnflag") != "R").alias("resolved"))
    return R.open_jobs(orders.select("o_orderkey"), alerts, "o_orderkey", "resolved")


@query("SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '1.0.' || (doc_id + 1) WHEN 1 THEN '2.' || (doc_id + 1) ELSE '1.0.0' END AS next FROM documents")
def next_version(documents: DataFrame) -> DataFrame:
    n, kind = F.col("doc_id").cast("string"), F.col("doc_id") % 4
    now = F.when(kind == 0, F.concat(F.lit("1.0."), n)).when(kind == 1, F.concat(F.lit("2."), n)).when(kind == 2, F.concat(F.lit("1.0.rc"), n))
    return documents.select("doc_id", R.next_version(now).alias("next"))


@query("SELECT event_id, user_id FROM events WHERE substring(md5(event_id::VARCHAR), 1, 6) < '400000'")
def hash_sample(events: DataFrame) -> DataFrame:
    return R.hash_sample(events.select("event_id", "user_id"), "event_id", 0.25)


KMV = """WITH d AS (SELECT DISTINCT event_type, ('0x' || substring(md5(user_id::VARCHAR || ':' || props), 1, 15))::BIGINT AS digest FROM events),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY digest) AS i FROM d),
s AS (SELECT event_type, count(*) AS n, max(digest) AS last FROM r WHERE i <= 256 GROUP BY event_type)
SELECT event_type, CASE WHEN n < 256 THEN n::DOUBLE ELSE round(255 / (last / 1152921504606846976::DOUBLE), 2) END AS kinds FROM s"""


@query(KMV)
def approximate_kinds(events: DataFrame) -> DataFrame:
    """Distinct pairs of user and properties by kind, estimated from daily sketches that are stored and merged."""
    pairs = events.select("event_type", F.to_date("ts").alias("day"), F.concat_ws(":", "user_id", "props").alias("pair"))
    stored = Workspace(events.sparkSession, "sketches").table(sketches.distinct_sketch(pairs, ["event_type", "day"], "pair"), "days")
    return sketches.distinct_counts(sketches.merged_distinct(stored, ["event_type"]), ["event_type"])


BUCKETS = """WITH v AS (SELECT event_type, round(value * 100)::BIGINT AS v FROM events),
b AS (SELECT event_type, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS bucket FROM v),
r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY bucket) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM b)
SELECT event_type, share::DOUBLE AS share, min(bucket)::BIGINT AS value FROM r, (SELECT unnest([0.5::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS share) WHERE i >= ceil(share * n) GROUP BY ALL"""


@query(BUCKETS)
def merged_quantiles(events: DataFrame) -> DataFrame:
    """Quantiles of cents by kind, from daily sketches that are stored and merged."""
    cents = events.select("event_type", F.to_date("ts").alias("day"), F.round(F.col("value") * 100).alias("cents"))
    stored = Workspace(events.sparkSession, "sketches").table(sketches.quantile_sketch(cents, ["event_type", "day"], F.col("cents")), "days")
    return sketches.quantiles(sketches.merged_quantiles(stored, ["event_type"]), ["event_type"], [0.5, 0.9, 0.99])


@query(
    """WITH t AS (SELECT user_id, epoch_us(ts) / 1e6 AS t FROM events),
m AS (SELECT *, coalesce(t - lag(t) OVER (PARTITION BY user_id ORDER BY t) >= 21600, true)::INT AS fresh FROM t),
v AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY t ROWS UNBOUNDED PRECEDING) AS visit FROM m)
SELECT user_id::VARCHAR AS key, min(t) AS since, max(t) AS until, count(*) AS n FROM v GROUP BY user_id, visit"""
)
def visit_table(events: DataFrame) -> DataFrame:
    """A table function of this library, called from SQL for each user's rows in order."""
    spark = events.sparkSession
    registry.register_visits(spark, "lw_visits", 21_600.0)
    rows = events.select(F.col("user_id").cast("string").alias("key"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    return spark.sql("SELECT * FROM lw_visits(TABLE(SELECT * FROM {rows}) PARTITION BY key ORDER BY t)", rows=rows)


@query(
    """WITH RECURSIVE e AS (SELECT event_id, user_id % 10 AS contract, event_type AS kind, user_id // 10 % 4 AS actor, event_id % 4 AS target,
    row_number() OVER (PARTITION BY user_id % 10 ORDER BY ts, event_id) AS i FROM events),
s AS (SELECT contract, 0::BIGINT AS i, NULL::BIGINT AS event_id, true AS ok, 0::BIGINT AS admin, NULL::BIGINT AS pending, false AS paused FROM (SELECT DISTINCT contract FROM e)
  UNION ALL SELECT e.contract, e.i, e.event_id,
    CASE e.kind WHEN 'purchase' THEN coalesce(e.actor = s.pending, false) WHEN 'signup' THEN true ELSE e.actor = s.admin END,
    CASE WHEN e.kind = 'purchase' AND e.actor = s.pending THEN s.pending ELSE s.admin END,
    CASE WHEN e.kind = 'click' AND e.actor = s.admin THEN e.target WHEN e.kind = 'purchase' AND e.actor = s.pending THEN NULL ELSE s.pending END,
    CASE WHEN e.kind = 'error' AND e.actor = s.admin THEN true WHEN e.kind = 'view' AND e.actor = s.admin THEN false ELSE s.paused END
  FROM s JOIN e ON e.contract = s.contract AND e.i = s.i + 1)
SELECT event_id, contract, ok, admin, pending, paused FROM s WHERE i > 0"""
)
def admin_steps(events: DataFrame) -> DataFrame:
    """Hand-overs in two steps and pauses of ten contracts; other kinds of events change nothing."""
    kind = F.when(F.col("event_type") == "click", "transfer").when(F.col("event_type") == "purchase", "accept").when(F.col("event_type") == "error", "pause").when(F.col("event_type") == "view", "unpause").otherwise("none")
    rows = events.select("event_id", "ts", (F.col("user_id") % 10).alias("contract"), kind.alias("kind"), (F.floor(F.col("user_id") / 10) % 4).alias("actor"), (F.col("event_id") % 4).alias("target"))
    return ledgers.administered(rows, "contract", "ts", "event_id", 0)


@query("WITH u AS (SELECT o_custkey, o_totalprice AS p FROM orders WHERE o_orderpriority LIKE '1-%') SELECT o_custkey, count(*) FILTER (WHERE p >= 1000) AS n, round(coalesce(sum(p) FILTER (WHERE p >= 1000), 0), 2) AS spent FROM u GROUP BY o_custkey HAVING max(p) >= 1000")
def parameterised_sql(orders: DataFrame) -> DataFrame:
    """A view, and a statement over it whose values and table name are parameters."""
    orders.createOrReplaceTempView("lw_orders")
    statement = "SELECT o_custkey, count(*) AS n, round(sum(o_totalprice), 2) AS spent FROM IDENTIFIER(:orders) WHERE o_totalprice >= :least AND o_orderpriority = :kind GROUP BY o_custkey"
    return orders.sparkSession.sql(statement, args={"orders": "lw_orders", "least": 1000, "kind": "1-URGENT"})


@query("SELECT o_custkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def partitioned_table(orders: DataFrame) -> DataFrame:
    """Written by status and read again: the filter on the partition column leaves the other folders unread."""
    work = Workspace(orders.sparkSession, "partitioned")
    orders.select("o_custkey", "o_totalprice", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(f"{work.at}/orders")
    return orders.sparkSession.read.parquet(f"{work.at}/orders").where("o_orderstatus = 'F'").select("o_custkey", "o_totalprice")


@query("SELECT c_custkey AS custkey FROM customer INTERSECT SELECT o_custkey FROM orders WHERE o_orderstatus = 'O' EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def set_operations(customer: DataFrame, orders: DataFrame) -> DataFrame:
    having = lambda status: orders.where(F.col("o_orderstatus") == status).select("o_custkey")
    return customer.select(F.col("c_custkey").alias("custkey")).intersect(having("O")).subtract(having("F"))


@query(
    "SELECT doc_id, i - 1 AS paragraph, CASE WHEN length(p) > 40 THEN substring(p, 1, 40) || '…' ELSE p END AS preview, CASE WHEN n_chars / 100.0::DOUBLE >= 9 THEN 'platinum' WHEN n_chars / 100.0::DOUBLE >= 7 THEN 'gold' WHEN n_chars / 100.0::DOUBLE >= 5 THEN 'silver' ELSE 'rejected' END AS tier "
    "FROM (SELECT doc_id, n_chars, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE length(trim(p)) >= 10"
)
def sql_functions(documents: DataFrame) -> DataFrame:
    spark = documents.sparkSession
    registry.register(spark)
    return spark.sql(
        "SELECT doc_id, CAST(paragraph AS BIGINT) AS paragraph, lw_preview(body, 40) AS preview, lw_tier(n_chars / 100.0D) AS tier "
        "FROM (SELECT doc_id, n_chars, lw_paragraph_list(text, 10) AS parts FROM {docs}) LATERAL VIEW inline(parts) p AS paragraph, body", docs=documents
    )


FUZZY = f"WITH RECURSIVE once AS (SELECT min(doc_id) AS doc_id, any_value(text) AS content FROM documents GROUP BY md5(coalesce(text, ''))), {_sql_greedy('once', 0.85)} SELECT doc_id FROM once WHERE doc_id NOT IN (SELECT doc_id FROM lost)"


@query(FUZZY)
def dedup_fuzzy_greedy(documents: DataFrame) -> DataFrame:
    return dedup.fuzzy(documents.select("doc_id", "text"), "doc_id", "text").select("doc_id")
