"""More queries of the catalog: answers, traps, accounts, fielded search, stateful streams. Importing this module registers them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import accounts, answers, evidence, ranking, traps
from lodestone.plans import catalog
from lodestone.plans import views as V
from lodestone.plans.catalog import query
from lodestone.session import load
from lodestone.streaming import counters, stateful

# ---------------------------------------------------------------- answers

_CONFIDENCE = f"""{catalog.EVIDENCE}, b AS (SELECT claim, source, relation, max(round(trust * strength, 9)::DECIMAL(20, 9)) AS m FROM evidence GROUP BY ALL),
m AS (SELECT claim, (coalesce(sum(m) FILTER (relation = 'supports'), 0) + 0.3 * coalesce(sum(m) FILTER (relation = 'explains'), 0))::DOUBLE AS s,
  coalesce(sum(m) FILTER (relation = 'contradicts'), 0)::DOUBLE AS c FROM b GROUP BY 1),
conf AS (SELECT claim, round(s / (s + c + 0.5::DOUBLE), 4) AS confidence, s >= 0.4 AND c >= 0.4 AS disputed FROM m)"""


@query(
    f"""WITH {_CONFIDENCE},
r AS (SELECT claim // 20 AS answer, claim, 'claim ' || claim AS text, disputed, row_number() OVER (PARTITION BY claim // 20 ORDER BY disputed DESC, confidence DESC, claim) AS place FROM conf QUALIFY place <= 6),
told AS (SELECT DISTINCT claim, source, CASE relation WHEN 'supports' THEN 0 ELSE 1 END AS side FROM evidence WHERE relation IN ('supports', 'contradicts')),
t AS (SELECT * FROM told UNION ALL SELECT DISTINCT user_id, event_id % 50, 0 FROM events WHERE event_id % 10 = 0 AND user_id NOT IN (SELECT claim FROM told WHERE side = 0)),
u AS (SELECT answer, claim, place, source, side FROM r JOIN t USING (claim)),
l AS (SELECT answer, source, row_number() OVER (PARTITION BY answer ORDER BY f) AS label FROM (SELECT answer, source, min((place, side, source)) AS f FROM u GROUP BY 1, 2)),
g AS (SELECT answer, claim, string_agg('[S' || label || ']', '' ORDER BY label) FILTER (side = 0) AS held, string_agg('[S' || label || ']', '' ORDER BY label) FILTER (side = 1) AS against FROM u JOIN l USING (answer, source) GROUP BY 1, 2),
s AS (SELECT answer, place, disputed AND against IS NOT NULL AS split, CASE WHEN disputed AND against IS NOT NULL THEN 'Sources disagree on this: some hold that ' || text || ' ' || coalesce(held, '') || ', while others contradict it ' || against || '.'
  WHEN held IS NOT NULL THEN text || '. ' || held END AS sentence FROM g JOIN r USING (answer, claim))
SELECT answer, coalesce(string_agg(sentence, ' ' ORDER BY place), '') AS text, count(sentence) AS claims, count(*) FILTER (split) AS disputed, any_value(n) AS sources
FROM s JOIN (SELECT answer, count(DISTINCT source) AS n FROM l GROUP BY 1) USING (answer) GROUP BY answer"""
)
def cited_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An answer for each twenty claims, by id."""
    rows = V.evidence(spark, sf_dir)
    claims = evidence.confidence(rows.select("claim").distinct(), rows)
    claims = claims.select(F.floor(F.col("claim") / 20).alias("answer"), "claim", F.concat(F.lit("claim "), F.col("claim").cast("string")).alias("text"), "confidence", "disputed")
    found = load(spark, sf_dir, "events").where("event_id % 10 = 0").select(F.col("user_id").alias("claim"), (F.col("event_id") % 50).alias("source"))
    return answers.synthesized(claims, answers.sides(rows, found))


# ---------------------------------------------------------------- traps

_SAID = ("use the new api", "the old api is deprecated", "the old api works", "nothing to say")
_TRAPS = f"""d AS (SELECT doc_id % 40 AS trap, lower([{', '.join(repr(s) for s in _SAID)}][CAST(doc_id % 4 + 1 AS INT)] || ' ' || coalesce(text, '')) AS t, doc_id % 97 = 0 AS outdated FROM documents),
o AS (SELECT trap, bool_or(contains(t, CASE WHEN trap % 2 = 0 THEN 'new api' ELSE 'nothing to say' END)) AS c, bool_or(contains(t, 'old api')) AS s, bool_or(contains(t, 'deprecated') OR contains(t, 'no longer')) AS q, count(*) FILTER (outdated) AS outdated FROM d GROUP BY 1),
f AS (SELECT *, outdated > 0 OR (s AND q) AS flagged FROM o)"""


@query(f"WITH {_TRAPS} SELECT trap, CASE WHEN trap % 3 = 0 THEN 'recent' ELSE 'classic' END AS cohort, c AS surfaces_current, s AS repeats_stale, flagged AS flags_stale, c AND flagged AS passes, s AND NOT flagged AS silent_stale, outdated FROM f")
def trap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, trap = load(spark, sf_dir, "documents"), F.col("doc_id") % 40
    rows = docs.select(trap.alias("trap")).distinct()
    current = F.when(F.col("trap") % 2 == 0, F.array(F.lit("New API"))).otherwise(F.array(F.lit("nothing to say")))
    rows = rows.withColumns({"cohort": F.when(F.col("trap") % 3 == 0, "recent").otherwise("classic"), "current": current, "stale": F.array(F.lit("old api"))})
    lead = F.element_at(F.array(*map(F.lit, _SAID)), (F.col("doc_id") % 4 + 1).cast("int"))
    results = docs.select(trap.alias("trap"), lead.alias("title"), F.coalesce("text", F.lit("")).alias("snippet"), (F.col("doc_id") % 97 == 0).alias("outdated"))
    none = results.where(F.lit(False)).select("trap", F.col("title").alias("text"), F.lit(None).cast("long").alias("superseded_by"), F.lit(None).cast("string").alias("valid_until"))
    out = traps.score_traps(rows, traps.said(results, none, none), ["deprecated", "no longer"])
    return out.select("trap", "cohort", "surfaces_current", "repeats_stale", "flags_stale", "passes", "silent_stale", "outdated")


@query(
    r"""WITH c AS (SELECT item_id AS claim, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS t FROM benchmark),
p AS (SELECT doc_id % 200 AS claim, doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS d FROM documents),
b AS (SELECT c.claim, max(len(list_intersect(list_distinct(t), list_distinct(d)))::DOUBLE / len(list_distinct(t))) AS o, max(CASE WHEN doc_id % 3 = 0 THEN 1 END) AS g, count(doc_id) AS n FROM c LEFT JOIN p USING (claim) GROUP BY 1)
SELECT count(*) AS claims, count(*) FILTER (n = 0) AS orphans, round(avg(o), 4) AS overlap, round(avg(CASE WHEN o >= 0.5 THEN 1.0::DOUBLE ELSE 0 END), 4) AS well_grounded,
  round(avg(CASE WHEN g = 1 THEN 1.0::DOUBLE ELSE 0 END), 4) AS from_relevant, round(avg(CASE WHEN claim % 4 = 0 THEN 1.0::DOUBLE ELSE 0 END), 4) AS disputed FROM b"""
)
def claim_grounding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lodestone.functions import text as T

    claims = load(spark, sf_dir, "benchmark").select(F.col("item_id").alias("claim"), T.tokens(F.col("text")).alias("tokens"), (F.col("item_id") % 4 == 0).alias("disputed"))
    docs = load(spark, sf_dir, "documents")
    found = docs.select((F.col("doc_id") % 200).alias("claim"), F.col("doc_id").alias("chunk"), T.tokens(F.col("text")).alias("tokens"))
    return traps.claim_accuracy(claims, found, docs.where("doc_id % 3 = 0").select(F.col("doc_id").alias("chunk")))


# ---------------------------------------------------------------- accounts

_PATHS = ("/search", "/v1/web_search", "/v1/extract", "/research", "/chunk/3", "/other")
_COST = f"""p AS (SELECT *, [{', '.join(repr(p) for p in _PATHS)}][CAST(event_id % 6 + 1 AS INT)] AS path FROM events),
k AS (SELECT *, CAST(CASE path WHEN '/research' THEN least(25, 10 + 5 * greatest(event_id % 12 - 6, 0)) WHEN '/v1/extract' THEN greatest(event_id % 4, 1) WHEN '/search' THEN 1 WHEN '/v1/web_search' THEN 1 ELSE 0 END AS INT) AS cost FROM p)"""


def _costed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.element_at(F.array(*map(F.lit, _PATHS)), (F.col("event_id") % 6 + 1).cast("int"))
    return load(spark, sf_dir, "events").withColumn("path", path).withColumn("cost", accounts.cost_for_path(F.col("path"), (F.col("event_id") % 12).cast("int"), (F.col("event_id") % 4).cast("int")))


@query(f"WITH {_COST} SELECT event_id, path, cost, path = '/chunk/3' AS free FROM k")
def call_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _costed(spark, sf_dir).select("event_id", "path", "cost", accounts.is_free(F.col("path")).alias("free"))


@query(
    f"""WITH {_COST} SELECT event_id, CASE WHEN user_id % 7 = 0 OR user_id % 11 = 0 THEN 'invalid_key' WHEN event_id % 120 >= 100 THEN 'quota_exceeded'
  WHEN user_id % 3 <> 0 AND event_id % 1005 + cost > 1000 AND cost > 0 THEN 'credits_exhausted' WHEN event_id % 70 >= 60 THEN 'rate_limited' ELSE 'ok' END AS verdict FROM k"""
)
def call_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, u = F.col("event_id"), F.col("user_id")
    calls = _costed(spark, sf_dir).withColumns(
        {"known": u % 7 != 0, "revoked": u % 11 == 0, "requests": e % 120, "quota": F.lit(100), "used": e % 1005, "included": F.when(u % 3 != 0, 1000), "in_window": e % 70, "rate": F.lit(60)}
    )
    return accounts.admission(calls).select("event_id", "verdict")


@query(f"WITH {_COST} SELECT user_id AS key, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, path AS endpoint, count(*) AS calls, CAST(sum(cost) AS BIGINT) AS credits FROM k GROUP BY ALL")
def ledger_charges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger of one half of the calls, after the other half."""
    calls = _costed(spark, sf_dir).select("event_id", F.col("user_id").alias("key"), F.to_date("ts").cast("string").alias("day"), F.col("path").alias("endpoint"), F.col("cost").alias("credits"))
    first = accounts.charged(spark.createDataFrame([], "key long, day string, endpoint string, calls long, credits long"), calls.where("event_id % 2 = 0"))
    return accounts.charged(first, calls.where("event_id % 2 = 1"))


@query("WITH h AS (SELECT unnest(['chk', 'doc']) AS kind, unnest([event_id, user_id]) AS target FROM events) SELECT kind, target, count(*) AS votes FROM h GROUP BY ALL")
def feedback_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    handles = F.array(F.concat(F.lit("chk_"), "event_id"), F.lit("run_1"), F.concat(F.lit("doc_"), "user_id"), F.lit("chk_x"))
    rows = load(spark, sf_dir, "events").select(F.inline(accounts.parse_targets(handles)))
    return rows.groupBy("kind", "target").agg(F.count(F.lit(1)).alias("votes"))


@query(
    f"""SELECT user_id AS key, CASE WHEN m < TIMESTAMP '{V.AS_OF}' - INTERVAL 30 DAY THEN 0 ELSE n END AS used,
  CASE WHEN user_id % 3 <> 0 THEN greatest(1000 - CASE WHEN m < TIMESTAMP '{V.AS_OF}' - INTERVAL 30 DAY THEN 0 ELSE n END, 0) END AS remaining
FROM (SELECT user_id, min(ts) AS m, count(*) AS n FROM events GROUP BY 1)"""
)
def account_balances(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = load(spark, sf_dir, "events").groupBy(F.col("user_id").alias("key")).agg(F.min(F.col("ts").cast("timestamp")).alias("period_start"), F.count(F.lit(1)).alias("used"))
    rows = rows.withColumn("included", F.when(F.col("key") % 3 != 0, F.lit(1000).cast("long")))
    return accounts.account_view(rows, V.AS_OF).select("key", F.col("used").cast("long").alias("used"), F.col("remaining").cast("long").alias("remaining"))


# ---------------------------------------------------------------- search over fields

_FIELDED = (
    catalog._BM25.replace("SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text)", "SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text || ' ' || 'src' || item_id % 4)")
    .replace("t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS toks FROM documents)", "t AS (SELECT doc_id AS id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}_]+') AS body, regexp_extract_all(lower(coalesce(source, '')), '[\\p{L}\\p{N}_]+') AS head, list_concat(body, head) AS toks FROM documents)")
    .replace("p AS (SELECT id, term, dl, count(*)::DOUBLE AS tf FROM (SELECT id, len(toks)::DOUBLE AS dl, unnest(toks) AS term FROM t) GROUP BY ALL)", "p AS (SELECT id, term, dl, sum(w)::DOUBLE AS tf FROM (SELECT id, len(toks)::DOUBLE AS dl, unnest(body) AS term, 1 AS w FROM t UNION ALL SELECT id, len(toks)::DOUBLE, unnest(head), 10 FROM t) GROUP BY ALL)")
)


@query(f"WITH {_FIELDED} SELECT query_id, id, round(score, 4) AS score, matched, rank FROM kw")
def bm25_fielded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's source is its title here, and counts ten times as much as its text."""
    asked = V.bench_queries(spark, sf_dir).withColumn("text", F.concat("text", F.lit(" src"), (F.col("query_id") % 4).cast("string")))
    hits = ranking.bm25(load(spark, sf_dir, "documents"), asked, fields={"source": 10.0, "text": 1.0})
    return hits.select("query_id", "id", F.round("score", 4).alias("score"), "matched", "rank")


# ---------------------------------------------------------------- streams


@query(catalog.oracle_sql()["request_snapshot"])
def stream_last_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last figures of each route after the whole stream."""
    events = counters.events_stream(spark, f"{sf_dir}/events.parquet")
    status = F.when(F.col("event_type") == "error", 500).otherwise(200)
    log = events.select(F.col("event_type").alias("route"), F.col("ts").alias("at"), F.col("event_id").alias("id"), F.col("value").alias("ms"), status.alias("status"))
    return counters.run_available(stateful.last_requests(log), ["route"])


@query()
def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decisions of a limit of three calls an hour; a test holds them to the walk over a sorted table."""
    events = counters.events_stream(spark, f"{sf_dir}/events.parquet")
    calls = events.select(F.col("user_id").alias("key"), F.col("ts").alias("at"), F.col("event_id").alias("id"))
    return counters.run_available(stateful.rate_limited(calls, 3, 3600), None, "append")

