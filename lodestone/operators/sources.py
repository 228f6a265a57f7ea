"""Where documents come from: host policy, discovery ranking, safety scan, upsert, freshness, eviction."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed as C
from lodestone.operators.understanding import host


def policy(spark: SparkSession) -> DataFrame:
    """The host table: suffix, tier, prior, kind. A fixed number of rows."""
    rows = [(h, tier, C.TIER_PRIORS[tier], kind) for h, (tier, kind) in C.HOSTS.items()]
    rows += [(h, "blocked", 0.0, "blog") for h in C.BLOCKED]
    return spark.createDataFrame(rows, "suffix string, tier string, prior double, kind string")


def classified(pages: DataFrame, key: str = "page_id", url: str = "url") -> DataFrame:
    """Adds host, tier, prior and source_type: the longest suffix of the host that the table has decides."""
    rows = pages.withColumn("host", host(F.col(url)))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    found = rows.select(key, F.posexplode(suffixes).alias("at", "suffix")).join(F.broadcast(policy(pages.sparkSession)), "suffix")
    best = found.groupBy(key).agg(F.min(F.struct("at", "tier", "prior", "kind")).alias("b"))
    path = F.lower(F.coalesce(F.try_parse_url(F.col(url), F.lit("PATH")), F.lit("")))
    kind = F.when((F.col("b.tier") == "repo") & path.contains("/issues/"), "github_issue").when((F.col("b.tier") == "repo") & (path.contains("/pull/") | path.contains("/merge_requests/")), "github_pr").otherwise(F.coalesce("b.kind", F.lit("blog")))
    return rows.join(best, key, "left").withColumns({"tier": F.coalesce("b.tier", F.lit("unknown")), "prior": F.coalesce("b.prior", F.lit(C.TIER_PRIORS["unknown"])), "source_type": kind}).drop("b")


def ranked_candidates(candidates: DataFrame, most: int = 6, group: str = "query_id") -> DataFrame:
    """Discovery results (group, rank, host, tier, prior) in fetch order, without blocked hosts: two pages a host first, then the rest."""
    order = [F.desc("prior"), F.col("rank")]
    nth = F.row_number().over(Window.partitionBy(group, "host").orderBy(*order))
    rows = candidates.where("tier != 'blocked'").withColumn("extra", nth > C.PER_HOST)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("extra", *order))).where(F.col("place") <= most).drop("extra")


def domain_confidence(candidates: DataFrame, top: int = 8, group: str = "query_id") -> DataFrame:
    """(group, confidence, off_domain): mean prior of the first results."""
    first = candidates.withColumn("n", F.row_number().over(Window.partitionBy(group).orderBy("rank"))).where(F.col("n") <= top)
    return first.groupBy(group).agg(F.avg("prior").alias("confidence")).withColumn("off_domain", F.col("confidence") < C.OFF_DOMAIN)


def first_of_url(candidates: DataFrame, most: int, group: str = "query_id") -> DataFrame:
    """Discovery results with an http(s) URL, the first of each URL, renumbered."""
    rows = candidates.where(F.col("url").rlike("^https?://"))
    rows = rows.withColumn("n", F.row_number().over(Window.partitionBy(group, "url").orderBy("rank"))).where("n = 1").drop("n")
    return rows.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("rank"))).where(F.col("place") <= most)


def injection(text: Column) -> Column:
    """Sorted categories of prompt-injection signs in a text."""
    body = F.coalesce(text, F.lit(""))
    found = [F.when(_any(body, patterns), F.lit(name)) for name, patterns in C.INJECTION.items()]
    hidden = F.length(body) - F.length(F.translate(body, C.ZERO_WIDTH, ""))
    return F.array_sort(F.array_compact(F.array(*found, F.when(hidden >= C.ZERO_WIDTH_LEAST, F.lit("hidden_text")))))


def _any(text: Column, patterns: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def content_hash(*fields: Column) -> Column:
    """SHA-256 of the fields that make a document another one."""
    return F.sha2(F.to_json(F.array(*(F.coalesce(f.cast("string"), F.lit("\0")) for f in fields))), 256)


def upsert(stored: DataFrame, incoming: DataFrame, key: str, hash_col: str, refreshed: tuple[str, ...]) -> DataFrame:
    """The table after a batch, with ``outcome``: inserted, updated, unchanged (only ``refreshed`` columns change) or kept."""
    columns = [c for c in stored.columns if c != key]
    s, i = stored.alias("s"), incoming.alias("i")
    there, here = F.col(f"s.{key}").isNotNull(), F.col(f"i.{key}").isNotNull()
    same = there & here & F.col(f"s.{hash_col}").eqNullSafe(F.col(f"i.{hash_col}"))
    outcome = F.when(~here, "kept").when(~there, "inserted").when(same, "unchanged").otherwise("updated")
    value = lambda c: F.when(here & (~same | F.lit(c in refreshed)), F.col(f"i.{c}")).otherwise(F.col(f"s.{c}"))
    return s.join(i, F.col(f"s.{key}") == F.col(f"i.{key}"), "full").select(F.coalesce(f"s.{key}", f"i.{key}").alias(key), *(value(c).alias(c) for c in columns), outcome.alias("outcome"))


def fresh(tier: Column, fetched_at: Column, as_of: Column) -> Column:
    """Whether a stored copy is younger than the cache life of its tier."""
    pairs = [F.lit(x) for kv in C.TTL_HOURS.items() for x in kv]
    life = F.coalesce(F.try_element_at(F.create_map(*pairs), tier), F.lit(C.TTL_HOURS["unknown"]))
    hours = (F.unix_timestamp(as_of) - F.unix_timestamp(fetched_at)) / 3600.0
    return F.coalesce(hours < life, F.lit(False))


def evicted(live: DataFrame, protected: DataFrame, excess: int, key: str = "id") -> DataFrame:
    """The ``excess`` longest-stored documents that nothing protects."""
    return live.join(protected.select(key).distinct(), key, "left_anti").orderBy("fetched_at", key).limit(max(excess, 0))


def missing(wanted: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    return wanted.join(stored.select(key).distinct(), key, "left_anti")


def canonical(chunks: DataFrame, key: str = "id", text: str = "text") -> DataFrame:
    """Adds the smallest id with the same text; null where that is the row's own. Groups meet by hash, partly aggregated."""
    first = chunks.groupBy(F.sha2(F.coalesce(text, F.lit("")), 256).alias("h")).agg(F.min(key).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = chunks.withColumn("h", F.sha2(F.coalesce(text, F.lit("")), 256)).join(first.select("h", "first"), "h", "left")
    return rows.withColumn("canonical", F.when(F.col("first") != F.col(key), F.col("first"))).drop("h", "first")
