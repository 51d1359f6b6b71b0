"""Catalogue: vectors, prices, revenue, duplicates and time joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loamworks.functions import fixed, text as T
from loamworks.operators import dedup, joins
from loamworks.operators import relational as R
from loamworks.operators import valuation as V
from loamworks.plans.texts import WORDS
from loamworks.session import read_table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        names = f.__code__.co_varnames[: f.__code__.co_argcount]
        QUERIES[f.__name__] = lambda spark, sf_dir: f(*[read_table(spark, sf_dir, n) for n in names])
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


SIM = "SELECT q.vec_id AS query, c.vec_id AS id, list_cosine_similarity(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) AS sim FROM embeddings q JOIN embeddings c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id"
NEAR = f"SELECT query, id, 1 - sim AS distance, row_number() OVER (PARTITION BY query ORDER BY round(1 - sim, 12), id) AS rank FROM ({SIM})"


def _queries(embeddings: DataFrame) -> DataFrame:
    return embeddings.where("vec_id % 100 = 0")


@query(f"SELECT query, id, rank::INT AS rank, round(distance, 6) AS distance FROM ({NEAR}) WHERE rank <= 8")
def knn_top8(embeddings: DataFrame) -> DataFrame:
    near = joins.neighbours(_queries(embeddings), embeddings, 8)
    each = near.select("query", F.posexplode("near").alias("i", "x"))
    return each.select("query", F.col("x.id").alias("id"), (F.col("i") + 1).alias("rank"), F.round("x.distance", 6).alias("distance"))


@query(f"SELECT query, id, rank::INT AS rank, round(distance, 6) AS distance FROM ({NEAR.replace('q.vec_id % 100 = 0 AND ', '')}) WHERE rank <= 3")
def knn_join(embeddings: DataFrame) -> DataFrame:
    near = joins.neighbours(embeddings, embeddings, 3)
    each = near.select("query", F.posexplode("near").alias("i", "x"))
    return each.select("query", F.col("x.id").alias("id"), (F.col("i") + 1).alias("rank"), F.round("x.distance", 6).alias("distance"))


@query(f"SELECT query, count(*) FILTER (WHERE distance < 0.55)::INT AS duplicates, count(*) FILTER (WHERE distance >= 0.55 AND distance < 0.65)::INT AS high, count(*) FILTER (WHERE distance >= 0.65 AND distance < 0.75)::INT AS similar, round(1 - min(distance), 6) AS max_similarity, CASE WHEN min(distance) < 0.55 THEN 'COLLISION' WHEN min(distance) < 0.65 THEN 'HIGH_RISK' WHEN min(distance) < 0.75 THEN 'SIMILAR' ELSE 'SAFE' END AS verdict FROM ({NEAR}) WHERE rank <= 8 GROUP BY query")
def collision_report(embeddings: DataFrame) -> DataFrame:
    return V.collisions(joins.neighbours(_queries(embeddings), embeddings, 8), 0.55, 0.65, 0.75)


@query(f"SELECT query, round(greatest(0.05::DOUBLE, least(0.98::DOUBLE, avg(distance) / 2)), 4) AS scarcity FROM ({NEAR}) WHERE rank <= 5 GROUP BY query")
def scarcity(embeddings: DataFrame) -> DataFrame:
    return joins.neighbours(_queries(embeddings), embeddings, 5).select("query", V.scarcity(F.col("near")).alias("scarcity"))


def _sql_shapley(weight: str) -> str:
    return f"""WITH near AS ({NEAR}), top AS (SELECT query, sum(w * distance) / sum(w) AS phi FROM (SELECT *, {weight} AS w FROM near WHERE rank <= 5) GROUP BY query),
sp AS (SELECT query, stddev_pop(sim) AS sd FROM ({SIM}) GROUP BY query),
total AS (SELECT i, sum(x) AS s, count(*) AS n FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY i),
rest AS (SELECT e.vec_id AS query, list((t.s - e.embedding[t.i]::DOUBLE) / (t.n - 1) ORDER BY t.i) AS c FROM embeddings e, total t WHERE e.vec_id % 100 = 0 GROUP BY 1),
g AS (SELECT vec_id AS query, greatest(0, least(1, (1 - list_cosine_similarity(embedding::DOUBLE[], c)) / 2)) AS gap FROM embeddings JOIN rest ON vec_id = query)
SELECT query, round(greatest(10::DOUBLE, least(100::DOUBLE, 10 + 90 * (0.55::DOUBLE * greatest(0, least(1, phi)) + 0.30::DOUBLE * gap + 0.15::DOUBLE * least(1, 5 * sd)))), 2) AS score, round(0.4::DOUBLE + 0.6::DOUBLE * gap, 3) AS confidence FROM top JOIN sp USING (query) JOIN g USING (query)"""


@query(_sql_shapley("1.0::DOUBLE / (rank + 1)"))
def knn_shapley(embeddings: DataFrame) -> DataFrame:
    return V.shapley_scores(_queries(embeddings), embeddings)


@query(_sql_shapley("1.0::DOUBLE / (rank + 1) * pow(greatest(1e-8, least(1 - 1e-8, rank / 5.0::DOUBLE)), 3) * pow(1 - greatest(1e-8, least(1 - 1e-8, rank / 5.0::DOUBLE)), 0)"))
def beta_shapley(embeddings: DataFrame) -> DataFrame:
    return V.shapley_scores(_queries(embeddings), embeddings, alpha=4.0, beta=1.0)


def sql_bootstrap(rounds: int, corpus: str = "embeddings") -> str:
    """Mean gain over subsets of a corpus for each of its rows divisible by 100."""
    return f"""(WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS e, unnest(range(1, {rounds + 1})) AS b FROM {corpus}),
s AS (SELECT * FROM m WHERE ('0x' || substring(md5('1:' || b || ':' || vec_id), 1, 8))::BIGINT % 1000 < 700),
q AS (SELECT * FROM m WHERE vec_id % 100 = 0),
best AS (SELECT q.vec_id AS query, q.b, max(list_cosine_similarity(q.e, s.e)) AS best FROM q JOIN s ON s.b = q.b AND s.vec_id <> q.vec_id GROUP BY ALL),
sums AS (SELECT b, i, sum(x) AS x FROM (SELECT b, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM s) GROUP BY ALL),
rest AS (SELECT q.vec_id AS query, q.b, q.e, list(t.x - CASE WHEN o.vec_id IS NULL THEN 0 ELSE q.e[t.i] END ORDER BY t.i) AS c FROM q JOIN sums t ON t.b = q.b LEFT JOIN s o ON o.b = q.b AND o.vec_id = q.vec_id GROUP BY ALL),
g AS (SELECT query, 0.6::DOUBLE * greatest(0, least(2, 1 - list_cosine_similarity(e, c))) / 2 + 0.4::DOUBLE * greatest(0, least(1, (1 - best) / 2)) AS gain FROM rest JOIN best USING (query, b))
SELECT query, round(greatest(10::DOUBLE, least(100::DOUBLE, 10 + 90 * avg(gain))), 2) AS score, round(greatest(0::DOUBLE, least(1::DOUBLE, 1 - stddev_pop(gain) / greatest(avg(gain), 1e-6))), 3) AS confidence FROM g GROUP BY query)"""


@query(f"SELECT * FROM {sql_bootstrap(10)}")
def data_oob(embeddings: DataFrame) -> DataFrame:
    return V.bootstrap_scores(_queries(embeddings), embeddings)


@query("SELECT i - 1 AS i, round(avg(x), 6) AS x FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1")
def centroid(embeddings: DataFrame) -> DataFrame:
    return V.centroid(embeddings).select(F.posexplode("centroid").alias("i", "x")).select(F.col("i").cast("long").alias("i"), F.round("x", 6).alias("x"))


#: Corpora of the first so many vectors, for each way of the dispatcher.
SIZES = (0, 3, 40, 300, 1 << 40)


def _sql_of(sql: str, corpus: str) -> str:
    return sql.replace("FROM embeddings", f"FROM {corpus}").replace("JOIN embeddings", f"JOIN {corpus}")


def _sql_dispatched() -> str:
    knn = _sql_shapley("1.0::DOUBLE / (rank + 1)")
    beta = _sql_shapley("1.0::DOUBLE / (rank + 1) * pow(greatest(1e-8, least(1 - 1e-8, rank / 5.0::DOUBLE)), 3) * pow(1 - greatest(1e-8, least(1 - 1e-8, rank / 5.0::DOUBLE)), 0)")
    few, some, many, every = (f"(SELECT * FROM embeddings WHERE vec_id < {n})" for n in SIZES[1:])
    mean = f"(SELECT list(x ORDER BY i) AS c FROM (SELECT i, avg(x) AS x FROM (SELECT unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM {few}) GROUP BY i))"
    return f"""SELECT 0 AS corpus, vec_id AS query, 75.0::DOUBLE AS score FROM embeddings WHERE vec_id = 0
UNION ALL SELECT 3, vec_id, round(greatest(10::DOUBLE, least(100::DOUBLE, 10 + 90 * (1 - list_cosine_similarity(embedding::DOUBLE[], c)) / 2)), 2) FROM {few}, {mean} WHERE vec_id % 100 = 0
UNION ALL SELECT 40, query, score FROM {sql_bootstrap(10, some)}
UNION ALL SELECT 300, query, floor(round((0.65::DOUBLE * b.score + (1 - 0.65::DOUBLE) * o.score) * 100, 4) + 0.5) / 100 FROM ({_sql_of(beta, many)}) b JOIN {sql_bootstrap(8, many)} o USING (query)
UNION ALL SELECT {SIZES[-1]}, query, floor(round((0.5::DOUBLE * b.score + 0.5::DOUBLE * o.score) * 100, 4) + 0.5) / 100 FROM ({_sql_of(beta, every)}) b JOIN ({_sql_of(knn, every)}) o USING (query)"""


@query(_sql_dispatched())
def shapley_dispatch(embeddings: DataFrame) -> DataFrame:
    """Vectors whose id is divisible by 100, each in corpora of five sizes that it is in (and in none)."""
    out = None
    for n in SIZES:
        corpus = embeddings.where(F.col("vec_id") < n)
        mine = _queries(corpus) if n else embeddings.where("vec_id = 0")
        some = V.dispatch_scores(mine, corpus).select(F.lit(n).cast("long").alias("corpus"), "query", "score")
        out = some if out is None else out.unionByName(some)
    return out


CURVE = "(VALUES " + ", ".join(f"('{s}', {d}.0::DOUBLE, {a}.0::DOUBLE, {fixed.MULTIPLIER.get(s, 1.0)}::DOUBLE)" for s, (d, a) in fixed.CURVE.items()) + ") AS c(scene, demand, slope, multiplier)"


@query(f"SELECT event_id, CASE event_type WHEN 'view' THEN 'photo' WHEN 'click' THEN 'legal_doc' ELSE event_type END AS scene, demand, slope FROM events LEFT JOIN {CURVE} ON c.scene = CASE event_type WHEN 'view' THEN 'photo' WHEN 'click' THEN 'legal_doc' ELSE 'general' END")
def scene_lookup_default(events: DataFrame) -> DataFrame:
    scene = F.when(F.col("event_type") == "view", "photo").when(F.col("event_type") == "click", "legal_doc").otherwise(F.col("event_type"))
    return V.with_scene(events.select("event_id", scene.alias("scene"))).select("event_id", "scene", "demand", "slope")


def _assets(embeddings: DataFrame) -> DataFrame:
    m = F.array(*[F.round(F.abs(F.col("embedding")[i].cast("double")) * 100 + 40, 6) for i in range(6)])
    scene = F.when(F.col("label") % 3 == 0, "medical_sft").when(F.col("label") % 3 == 1, "code_tech").otherwise("cinematic")
    return V.with_scene(embeddings.select("vec_id", m.alias("m"), scene.alias("scene")))


WEIGHT = "CASE scene WHEN 'medical_sft' THEN {} WHEN 'code_tech' THEN {} ELSE {} END"
QUALITY = " + ".join(f"round(abs(embedding[{i + 1}]::DOUBLE) * 100 + 40, 6) * ({WEIGHT.format(*(f'{fixed.WEIGHTS[s][i]}::DOUBLE' for s in ('medical_sft', 'code_tech', 'cinematic')))})" for i in range(6))
ASSETS = f"SELECT a.vec_id, a.scene, q, demand, slope, CASE WHEN q < 35 THEN 0 ELSE q * 50 * multiplier * 2 END AS base FROM (SELECT vec_id, scene, {QUALITY} AS q FROM (SELECT *, CASE label % 3 WHEN 0 THEN 'medical_sft' WHEN 1 THEN 'code_tech' ELSE 'cinematic' END AS scene FROM embeddings)) a JOIN {CURVE} ON a.scene = c.scene"
PRICE = "base * (1000 + demand * (1 + 0.1::DOUBLE * greatest(0, (0.85::DOUBLE - 0.7::DOUBLE) / 0.3::DOUBLE)) * slope) / 1000 * (0.7::DOUBLE + 0.3::DOUBLE * 500 / (sqrt(base) + 500))"


@query(f"SELECT vec_id, scene, round(q, 4) AS quality, round(base, 3) AS base, round(round({PRICE}, 2), 1) AS price, round(round(72 + 18 * q / 100, 4), 3) AS creator_ratio FROM ({ASSETS})")
def composite_price(embeddings: DataFrame) -> DataFrame:
    rows = _assets(embeddings).withColumn("q", V.composite(F.col("m"), F.col("weights")))
    rows = rows.withColumn("base", V.base_value(F.col("q"), F.lit(fixed.UNITS["image"]), F.col("multiplier")))
    price = F.round(V.curve_price(F.col("base"), F.col("demand"), F.col("slope"), F.lit(0.85)), 1)
    return rows.select("vec_id", "scene", F.round("q", 4).alias("quality"), F.round("base", 3).alias("base"), price.alias("price"), F.round(V.creator_ratio(F.col("q")), 3).alias("creator_ratio"))


@query(
    f"""SELECT p_partkey, scene, d::INT AS demand, round(round(p_retailprice * (1000 + d * slope) / 1000 * (0.7::DOUBLE + 0.3::DOUBLE * 500 / (sqrt(p_retailprice) + 500)), 2), 1) AS price
FROM (SELECT *, CASE p_size % 3 WHEN 0 THEN 'medical_sft' WHEN 1 THEN 'code_tech' ELSE 'cinematic' END AS s FROM part) JOIN {CURVE} ON c.scene = s, range(0, 61, 2) AS r(d)"""
)
def bonding_curve(part: DataFrame) -> DataFrame:
    """Prices of parts as assets, along their scenes' curves."""
    scene = F.when(F.col("p_size") % 3 == 0, "medical_sft").when(F.col("p_size") % 3 == 1, "code_tech").otherwise("cinematic")
    curves = V.curve_table(V.with_scene(part.select("p_partkey", "p_retailprice", scene.alias("scene"))), F.col("p_retailprice"))
    return curves.select("p_partkey", "scene", "demand", F.round("price", 1).alias("price"))


SIGMA = "greatest(0.08::DOUBLE, least(0.92::DOUBLE, 0.08::DOUBLE + 0.52::DOUBLE * round(abs(embedding[4]::DOUBLE) * 100 + 40, 6) / 100 + 0.30::DOUBLE * round(abs(embedding[6]::DOUBLE) * 100 + 40, 6) / 100))"


def _sql_cdf(x: str) -> str:
    """The normal distribution by its series: z times the sum of products of z * z / (2 j + 1)."""
    z = f"greatest(-6::DOUBLE, least(6::DOUBLE, {x}))"
    terms = f"list_transform(range(0, 91), lambda k: coalesce(list_product(list_transform(range(1, k + 1), lambda j: {z} * {z} / (2 * j + 1))), 1))"
    return f"(0.5::DOUBLE + {z} * list_sum({terms}) * exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()))"


@query(
    f"""WITH s AS (SELECT vec_id, {SIGMA} AS sigma FROM embeddings), d AS (SELECT *, (ln(1 / 0.6::DOUBLE) + (0.03::DOUBLE + sigma * sigma / 2)) / sigma AS d1 FROM s)
SELECT vec_id, round(sigma, 6) AS sigma, round(10000 * {_sql_cdf('d1')} - 10000 * 0.6::DOUBLE * exp(-0.03::DOUBLE) * {_sql_cdf('(d1 - sigma)')}, 2) AS option FROM d"""
)
def option_value(embeddings: DataFrame) -> DataFrame:
    sigma = V.volatility(F.col("m")[3], F.col("m")[5], F.lit(0.5))
    return _assets(embeddings).select("vec_id", F.round(sigma, 6).alias("sigma"), V.option_value(F.lit(10_000.0), sigma).alias("option"))


@query()
def commitment(orders: DataFrame) -> DataFrame:
    rows = orders.select("o_orderkey", "o_orderpriority", "o_totalprice", F.md5(F.col("o_orderkey").cast("string")).alias("salt"), "o_custkey", F.floor(F.unix_timestamp("o_orderdate") / 3600).alias("hour"))
    return V.commitment(rows, "o_orderkey", "o_orderpriority", "o_totalprice", "salt", "o_custkey", "hour")


@query(
    f"""WITH w AS (SELECT conv_id, turn, md5(unnest({WORDS.format("coalesce(text, '')")})) AS m FROM conversations),
b AS (SELECT conv_id, turn, i, sum(CASE WHEN (('0x' || substring(m, 17 + (63 - i) // 4, 1))::INT >> (i % 4)::INT) & 1 = 1 THEN 1 ELSE -1 END) > 0 AS one FROM w, range(64) AS r(i) GROUP BY ALL),
s AS (SELECT conv_id, turn, sum(CASE WHEN one THEN CASE WHEN i = 63 THEN -9223372036854775808::HUGEINT ELSE (1::HUGEINT << i::INT) END ELSE 0 END)::BIGINT AS simhash FROM b GROUP BY ALL)
SELECT conv_id, turn, coalesce(simhash, 0) AS simhash FROM conversations LEFT JOIN s USING (conv_id, turn)"""
)
def simhash(conversations: DataFrame) -> DataFrame:
    return conversations.select("conv_id", "turn", V.simhash(T.words(F.coalesce("text", F.lit("")))).alias("simhash"))


@query("SELECT page_id, upper(substring(sha256(url), 1, 16)) AS print FROM pages")
def fingerprint(pages: DataFrame) -> DataFrame:
    return pages.select("page_id", V.fingerprint(F.col("url")).alias("print"))


CONTRIBUTION = "CASE l_returnflag WHEN 'A' THEN 3.0::DOUBLE * 1.5 WHEN 'N' THEN 2.0::DOUBLE * 1.8 ELSE l_quantity / 512 * 0.8::DOUBLE END"


@query(f"SELECT l_suppkey, round(sum({CONTRIBUTION}), 6) AS amount, round(sum({CONTRIBUTION}) / sum(sum({CONTRIBUTION})) OVER (), 6) AS ratio FROM lineitem GROUP BY 1")
def contributions(lineitem: DataFrame) -> DataFrame:
    flag = F.col("l_returnflag")
    amount = F.when(flag == "A", fixed.TIER_WEIGHT["platinum"] * fixed.KIND_WEIGHT["sft"]).when(flag == "N", fixed.TIER_WEIGHT["gold"] * fixed.KIND_WEIGHT["dpo"]).otherwise(F.col("l_quantity") / 512 * fixed.KIND_WEIGHT["pretrain"])
    return R.share_of_sum(lineitem, "l_suppkey", amount)


@query("SELECT source, count(*) AS samples, count(*) FILTER (WHERE lang = 'en') AS sft, count(*) FILTER (WHERE lang <> 'en') AS dpo, round(avg(n_chars / 1000), 2) AS avg_quality FROM documents GROUP BY source")
def package_summary(documents: DataFrame) -> DataFrame:
    kind = lambda c, n: F.count(F.when(c, 1)).alias(n)
    return documents.groupBy("source").agg(F.count("*").alias("samples"), kind(F.col("lang") == "en", "sft"), kind(F.col("lang") != "en", "dpo"), F.round(F.avg(F.col("n_chars") / 1000), 2).alias("avg_quality"))


@query("WITH r AS (SELECT l_orderkey, l_suppkey, sum(l_quantity) AS q FROM lineitem GROUP BY ALL), s AS (SELECT *, round(q / sum(q) OVER (PARTITION BY l_orderkey), 6) AS ratio FROM r) SELECT o_orderkey, l_suppkey::VARCHAR AS creator, round(round((o_totalprice * 0.7::DOUBLE)::DECIMAL(28,10), 4)::DECIMAL(18,4) * ratio::DECIMAL(9,6), 4)::DOUBLE AS creator_share FROM s JOIN orders ON o_orderkey = l_orderkey")
def revenue_split(lineitem: DataFrame, orders: DataFrame) -> DataFrame:
    sums = lineitem.groupBy("l_orderkey", "l_suppkey").agg(F.sum("l_quantity").alias("q"))
    share = F.round(F.col("q") / F.sum("q").over(Window.partitionBy("l_orderkey")), 6)
    ratios = sums.withColumn("r", share).groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.col("l_suppkey").cast("string"), "r"))).alias("ratios"))
    sales = orders.join(ratios, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "o_totalprice", "ratios")
    return V.split_revenue(sales, "o_totalprice", "ratios").select("o_orderkey", "creator", F.col("creator_share").cast("double").alias("creator_share"))


@query("SELECT event_id, event_type, row_number() OVER w - 1 AS demand, (1000 * (1000 + (row_number() OVER w - 1) * 25) // 1000)::BIGINT AS price FROM events WHERE event_type IN ('purchase', 'view') WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id)")
def amm_ledger(events: DataFrame) -> DataFrame:
    rows = events.where(F.col("event_type").isin("purchase", "view"))
    return V.demand_ledger(rows, "event_type", "ts", "event_id", F.lit(1000), F.lit(25)).select("event_id", "event_type", "demand", "price")


@query("WITH v AS (SELECT o_orderkey, floor(o_totalprice)::BIGINT AS v, 720 + o_custkey % 181 AS r FROM orders), c AS (SELECT *, v * r // 1000 AS creator FROM v) SELECT o_orderkey, creator::BIGINT AS creator, ((v - creator) * 60 // 100)::BIGINT AS platform, (v - creator - (v - creator) * 60 // 100)::BIGINT AS fund FROM c")
def onchain_split(orders: DataFrame) -> DataFrame:
    s = V.split_on_chain(F.floor("o_totalprice").cast("long"), 720 + F.col("o_custkey") % 181)
    return orders.select("o_orderkey", s.alias("s")).select("o_orderkey", "s.creator", "s.platform", "s.fund")


@query("WITH c AS (SELECT * FROM events WHERE event_type = 'view'), p AS (SELECT user_id, ts, event_id, value FROM events WHERE event_type = 'purchase'), j AS (SELECT c.event_id, c.user_id, c.ts, p.ts AS g, p.value FROM c ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM p GROUP BY ALL) p ON c.user_id = p.user_id AND c.ts >= p.ts), v AS (SELECT *, coalesce(ts < g + INTERVAL 5 DAY AND value > 10, false) AS good FROM j) SELECT event_id, user_id, good AND sum(good::INT) OVER (PARTITION BY user_id, g ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) <= 2 AS granted FROM v")
def token_quota(events: DataFrame) -> DataFrame:
    calls = events.where("event_type = 'view'").select("user_id", "ts", "event_id")
    days = F.col("ts") + F.expr("INTERVAL 5 DAYS")
    tokens = events.where("event_type = 'purchase'").select("user_id", "ts", F.col("ts").alias("granted_at"), days.alias("expires_at"), (F.col("value") <= 10).alias("revoked"))
    tokens = tokens.groupBy("user_id", "ts", "granted_at", "expires_at").agg(F.min("revoked").alias("revoked"))
    valid = (F.col("ts") < F.col("expires_at")) & ~F.col("revoked")
    return joins.token_access(calls, tokens, ["user_id"], "ts", 2, valid).select("event_id", "user_id", "granted")


@query("SELECT a.event_id, b.event_id AS purchase FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_type = 'click' AND b.event_type = 'purchase' AND a.ts >= b.ts AND a.ts < b.ts + INTERVAL 1 HOUR")
def access_windows(events: DataFrame) -> DataFrame:
    a = events.where("event_type = 'click'").select("user_id", "event_id", "ts")
    b = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("purchase"), F.col("ts").alias("start"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("stop"))
    return joins.interval_join(a, b, ["user_id"], "ts", "start", "stop", 3600).select("event_id", "purchase")


@query("WITH h AS (SELECT doc_id, lang, ('0x' || substring(md5(text), 1, 15))::BIGINT AS b FROM documents) SELECT doc_id, lang, coalesce((SELECT min(o.doc_id) FROM h o WHERE o.lang = h.lang AND o.doc_id < h.doc_id AND bit_count(xor(o.b, h.b)) <= 5), -1) AS earlier FROM h")
def hamming_dups(documents: DataFrame) -> DataFrame:
    bits = F.conv(F.substring(F.md5("text"), 1, 15), 16, 10).cast("long")
    found = joins.hamming_first(documents, "doc_id", bits, ["lang"])
    return found.select("doc_id", "lang", F.coalesce("earlier", F.lit(-1)).cast("long").alias("earlier"))


@query("SELECT min(doc_id) AS doc_id, md5(coalesce(text, '')) AS digest FROM documents GROUP BY 2")
def dedup_exact_sft(documents: DataFrame) -> DataFrame:
    return dedup.exact(documents, F.coalesce("text", F.lit("")), "doc_id").select("doc_id", F.md5(F.coalesce("text", F.lit(""))).alias("digest"))


@query("SELECT min(doc_id) AS doc_id, md5(substring(coalesce(text, ''), 1, 200)) AS digest FROM documents GROUP BY 2")
def dedup_exact_chunk(documents: DataFrame) -> DataFrame:
    first = F.substring(F.coalesce("text", F.lit("")), 1, 200)
    return dedup.exact(documents, first, "doc_id").select("doc_id", F.md5(first).alias("digest"))


@query(
    """WITH w AS (SELECT doc_id, list_distinct(string_split_regex(trim(text), '[ \\t\\n]+')) AS w, min(doc_id) OVER (PARTITION BY text) AS first FROM documents), s AS (SELECT * FROM w WHERE first = doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, len(a.w) AS n, len(b.w) AS m, len(list_intersect(a.w, b.w)) AS i FROM s a JOIN s b ON a.doc_id < b.doc_id AND least(len(a.w), len(b.w)) >= greatest(len(a.w), len(b.w)) * 0.85)
SELECT a, b, round(i / (n + m - i), 6) AS similarity FROM p WHERE i / (n + m - i) >= 0.85 UNION ALL SELECT first, doc_id, 1 FROM w WHERE first < doc_id"""
)
def jaccard_pairs(documents: DataFrame) -> DataFrame:
    """Pairs of different texts by their words, and each text's first document with its copies."""
    words = F.array_distinct(F.split(F.trim("text"), "[ \t\n]+"))
    pairs = joins.jaccard_classes(documents.select("doc_id", "text", words.alias("w")), "doc_id", "w", 0.85, "text")
    return pairs.select("a", "b", F.round("similarity", 6).alias("similarity"))


@query("SELECT vec_id FROM embeddings e WHERE NOT EXISTS (SELECT 1 FROM embeddings o WHERE o.vec_id < e.vec_id AND list_cosine_similarity(o.embedding::DOUBLE[], e.embedding::DOUBLE[]) >= 0.92)")
def dedup_semantic_greedy(embeddings: DataFrame) -> DataFrame:
    return dedup.semantic(embeddings, "vec_id", "embedding").select("vec_id")


@query(
    """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: abs(x::DOUBLE)) AS r FROM embeddings), b AS (SELECT vec_id, list_transform(r, lambda x: (x > list_sum(r) / len(r))::INT) AS b FROM e),
h AS (SELECT vec_id, array_to_string(list_transform(range(0, len(b), 4), lambda i: substring('0123456789ABCDEF', (8 * b[i + 1] + 4 * b[i + 2] + 2 * b[i + 3] + b[i + 4] + 1)::INT, 1)), '') AS h FROM b)
SELECT vec_id, '0xAFP_' || upper(substring(sha256(unhex(h)), 1, 12)) AS print FROM h"""
)
def acoustic_print(embeddings: DataFrame) -> DataFrame:
    return embeddings.select("vec_id", V.acoustic_print(F.transform("embedding", lambda x: F.abs(x.cast("double")))).alias("print"))


PROTOTYPES = "SELECT label % 3 AS scene, list(x ORDER BY i) AS prototype FROM (SELECT label, i, avg(x) AS x FROM (SELECT label % 3 AS label, unnest(embedding::DOUBLE[]) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL) GROUP BY label"


@query(f"WITH p AS ({PROTOTYPES}), s AS (SELECT vec_id, label % 4 AS want, scene, greatest(0, least(100::DOUBLE, (list_cosine_similarity(embedding::DOUBLE[], prototype) + 1) / 2 * 100)) AS a FROM embeddings, p) SELECT vec_id, round(CASE WHEN want < 3 THEN max(a) FILTER (WHERE scene = want) ELSE max(a) END, 4) AS align FROM s GROUP BY vec_id, want")
def prototype_alignment(embeddings: DataFrame) -> DataFrame:
    each = embeddings.select((F.col("label") % 3).alias("scene"), F.posexplode("embedding").alias("i", "x")).groupBy("scene", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    table = each.groupBy("scene").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("prototype"))
    return V.alignment(embeddings.withColumn("want", F.col("label") % 4), table, "embedding", "want").select("vec_id", F.round("align", 4).alias("align"))


@query(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), v AS (SELECT *, o_totalprice BETWEEN 1000 AND 300000 AS ok FROM r WHERE i <= 10)
SELECT o_custkey, count(*) AS total, count(*) FILTER (WHERE ok) AS ok, count(*) FILTER (WHERE NOT ok) AS errors, any_value(n) > 10 AS truncated, coalesce(sum(floor(o_totalprice * 1250 / 1000)) FILTER (WHERE ok), 0)::BIGINT AS worth
FROM v JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) USING (o_custkey) GROUP BY o_custkey"""
)
def batch_report(orders: DataFrame) -> DataFrame:
    """Customers' orders as batches of assets, ten of each valued; prices out of bounds fail alone."""
    price = V.chain_price(F.col("o_totalprice"), F.lit(10), F.lit(25))
    why = V.refused(F.col("o_totalprice"), 1000, 300_000)
    rows = V.batch_valued(orders, "o_custkey", "o_orderkey", price, why, limit=10)
    return V.batch_report(rows, "o_custkey", worth="value")
