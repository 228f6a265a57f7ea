"""One facade over the operators: the verbs of the engine for a batch of queries at a time."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed as C
from lodestone.functions import text as T
from lodestone.functions.embed import Embedder, HashedEmbedder, embedded
from lodestone.operators import claims as K
from lodestone.operators import evaluate, evidence, graph, ranking, research, shaping, understanding, usage
from lodestone.operators.edges import EdgeTable
from lodestone.session import shared_dir
from lodestone.tables import written


@dataclass
class Engine:
    """``chunks``: id, document, ordinal, heading, text; ``documents``: document, url, title, source_type, trust, published_at."""

    chunks: DataFrame
    documents: DataFrame
    as_of: str
    embedder: Embedder = field(default_factory=HashedEmbedder)
    edges: DataFrame | None = None
    feedback_counts: DataFrame | None = None

    def __post_init__(self):
        # the index: written once, read by every search
        self.vectors = written(embedded(self.chunks.select("id", "text"), self.embedder).select("id", "vector"), "vectors")
        self.marks = written(self.chunks.select("id", T.simhash_bits(F.transform(T.shingle_texts(F.col("text")), T.half_md5)).alias("mark")), "marks")
        self.fields = {"title": C.FIELD_WEIGHTS["title"], "heading": C.FIELD_WEIGHTS["heading"], "text": C.FIELD_WEIGHTS["body"]}
        self.edge_table = EdgeTable(self.chunks.sparkSession, f"{shared_dir(self.chunks.sparkSession)}/edges-{uuid.uuid4().hex}")
        self.tokens = ranking.tokenised(self.chunks.join(self.documents.select("document", "title"), "document"), "id", self.fields)

    def allowed(self, source_types: list[str] | None = None, since: str | None = None, parsed: understanding.Parsed | None = None) -> DataFrame | None:
        """Ids of chunks that pass the filters, null without any: source types, earliest date, and the site, phrases and exclusions of a parsed query."""
        types, first = source_types or (parsed.source_types if parsed else None), since or (parsed.since if parsed else None)
        if not (types or first or (parsed and parsed.has_post_filters)):
            return None
        rows = self.chunks.join(self.documents.select("document", "url", "source_type", "published_at"), "document")
        rows = rows.where(F.col("source_type").isin(types)) if types else rows
        rows = rows.where(F.col("published_at") >= F.lit(first).cast("timestamp")) if first else rows
        rows = rows.where(understanding.passes(parsed, F.col("text"), F.col("url"))) if parsed else rows
        return written(rows.select("id"), "allowed")

    def search_one(self, query: str, k: int = 10, variants: bool = True) -> DataFrame:
        """One query with its operators (type:, since:, site:, phrases, exclusions) and other wordings of it."""
        parsed, spark = understanding.parse(query), self.chunks.sparkSession
        one = spark.createDataFrame([(1, parsed.text or query)], "query_id int, text string")
        kind = one.select(understanding.intent(F.col("text")).alias("k")).first()["k"]
        names = list(dict.fromkeys(C.ENTITY_ALIASES[w] for w in re.findall(r"\w+", parsed.text.lower()) if w in C.ENTITY_ALIASES))
        other = understanding.wordings_of(spark, parsed.text, names, kind) if variants else []
        return self.search(one, k, allowed=self.allowed(parsed=parsed), variants=spark.createDataFrame([(1, v) for v in other], "query_id int, text string"))

    def understand(self, queries: DataFrame) -> DataFrame:
        return understanding.routed(queries)

    def search(self, queries: DataFrame, k: int = 10, allowed: DataFrame | None = None, variants: DataFrame | None = None) -> DataFrame:
        """Ranked hits (query_id, id, rank, fused, alternates, text, url, ...) of a batch of queries (query_id, text).

        A query that names a version of a product raises hits about that version and lowers those about older ones only.

        ``allowed`` (id) filters before ranking. ``variants`` (query_id, text) are other wordings; each has rankings of its own that vote like the query's.
        """
        plan = self.understand(queries)
        asked = plan.select("query_id", "text") if variants is None else plan.select("query_id", "text").unionByName(variants.select("query_id", "text"))
        asked = written(asked.withColumn("wording", F.row_number().over(Window.partitionBy("query_id").orderBy("text"))), "asked")
        each = asked.select(F.struct("query_id", "wording").alias("query_id"), "text")
        tokens = self.tokens if allowed is None else self.tokens.join(allowed, "id", "left_semi")
        of = lambda hits: hits.select("query_id.query_id", "id", "rank")
        words = of(ranking.bm25(self.chunks, each, id_col="id", fields=self.fields, tokens=tokens))
        near = of(ranking.neighbours(self.vectors, embedded(asked, self.embedder).select(F.struct("query_id", "wording").alias("query_id"), "vector"), id_col="id", vector_col="vector", allowed=allowed))
        weights = plan.select("query_id", "vector_weight", "keyword_weight", "intent")
        votes = words.select("query_id", "id", "rank").join(weights, "query_id").select("query_id", "id", "rank", F.col("keyword_weight").alias("weight"))
        votes = votes.unionByName(near.select("query_id", "id", "rank").join(weights, "query_id").select("query_id", "id", "rank", F.col("vector_weight").alias("weight")))
        rows = self.chunks.join(self.documents, "document")
        boost = F.lit(1.0)
        for kind, table in C.BOOSTS.items():
            for source, factor in table.items():
                boost = F.when((F.col("intent") == kind) & (F.col("source_type") == source), F.lit(factor)).otherwise(boost)
        merged = ranking.rank_fusion(votes).join(rows, "id").join(weights.select("query_id", "intent"), "query_id").withColumn("rrf", F.col("rrf") * boost)
        order = Window.partitionBy("query_id").orderBy(F.desc("rrf"), "id")
        merged = merged.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= 2 * C.K_EACH)
        folded = ranking.collapsed(merged.select("query_id", "id", "rank").join(self.marks, "id").withColumn("canonical", F.lit(None).cast(dict(self.chunks.dtypes)["id"])))
        hits = merged.join(folded, ["query_id", "id"]).join(queries.select("query_id", understanding.query_products(F.col("text")).alias("products")), "query_id")
        body = F.concat_ws(" ", "title", "heading", "url", "text")
        hits = hits.withColumns({"others": F.col("alternates"), "alternates": F.size("alternates"), "on_focus": (F.size("products") == 0) | understanding.mentions_product(body, F.col("products"))})
        if self.feedback_counts is None:
            hits = hits.withColumn("net", F.lit(None).cast("double"))
        else:
            net = usage.chunk_usefulness(self.chunks.select(F.col("id").alias("chunk"), "document"), usage.net_signal(self.feedback_counts))
            hits = hits.join(net.withColumnRenamed("chunk", "id"), "id", "left")
        best = Window.partitionBy("query_id").orderBy(F.desc("fused"), "id")
        asks = queries.select("query_id", understanding.query_constraint(F.col("text")).alias("constraint"))
        out = understanding.annotated(ranking.fused(hits, self.as_of).join(asks, "query_id"))
        out = out.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
        return out.select("query_id", "id", "document", "rank", "fused", F.col("others").alias("alternates"), "heading", "text", "url", "title", "mentions", "match", "outdated")

    def web_search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        hits = ranking.best_per(self.search(queries, 3 * k), ["query_id", "document"], F.col("rank")).where(F.col("rank") <= 3 * k)
        return hits.select("query_id", "rank", "title", "url", T.snippet(F.col("text")).alias("snippet"))

    def highlights(self, queries: DataFrame, hits: DataFrame) -> DataFrame:
        return K.highlights(hits, self.embedder, embedded(queries.select("query_id", "text"), self.embedder))

    def claims(self, queries: DataFrame, merge: float = K.MERGE_COSINE, ground: float = 0.0) -> DataFrame:
        """(query_id, key, text, chunks): what the found chunks state."""
        hits = self.search(queries).select("query_id", F.col("id").alias("chunk"), "rank", "text")
        found = K.candidates(hits, tuple(C.ENTITY_ALIASES))
        return K.in_version_time(K.merged(found, self.embedder, self.vectors.withColumnRenamed("id", "chunk"), ground, merge))

    def evidence(self, queries: DataFrame, claims: DataFrame) -> DataFrame:
        """(claim, chunk, relation, strength, source): claims against the chunks found for their query and their own, assertion by assertion.

        Edges are kept: a claim that was judged before is judged again only against chunks that are new to it or have changed.
        """
        hits = self.search(queries, 6).select("query_id", F.col("id").alias("chunk"))
        asked = written(claims.select("query_id", F.col("key").alias("claim"), "text", "chunks"), "claims")
        own = asked.select("claim", F.explode("chunks").alias("chunk")).distinct()
        first = asked.groupBy("claim").agg(F.min("text").alias("text"), F.min(F.element_at("chunks", 1)).alias("first"))
        bodies = self.chunks.select(F.col("id").alias("chunk"), F.col("text").alias("body"), F.col("document").alias("source"))
        named = first.join(bodies.select(F.col("chunk").alias("first"), "source"), "first").select("claim", "text", "source")
        found = asked.select("query_id", "claim").join(hits, "query_id").select("claim", "chunk").unionByName(own).distinct()
        sim = F.round(T.jaccard(T.tokens(F.col("text")), T.tokens(F.col("body"))), 6)
        pairs = found.join(named, "claim").join(bodies.drop("source"), "chunk").select("claim", "chunk", sim.alias("sim"))
        self.edge_table.link(named, bodies, written(pairs, "pairs"), own)
        edges = self.edge_table.edges().join(asked.select("claim").distinct(), "claim", "left_semi")
        return edges.join(bodies.select("chunk", "source"), "chunk")

    def confidence(self, claims: DataFrame, edges: DataFrame) -> DataFrame:
        trusted = edges.join(self.documents.select(F.col("document").alias("source"), "trust"), "source")
        return evidence.confidence(claims.select(F.col("key").alias("claim")).distinct(), trusted)

    def contradictions(self, edges: DataFrame) -> DataFrame:
        return edges.where("relation = 'contradicts'").select("claim").distinct()

    def fetch(self, handle: str) -> DataFrame:
        """A document (doc_N) or chunk (chk_N with its neighbours)."""
        kind, _, number = handle.partition("_")
        if kind == "doc":
            return self.documents.where(F.col("document") == int(number))
        return shaping.with_context(self.chunks).where(F.col("id") == int(number)) if kind == "chk" else self.chunks.limit(0)

    def expand(self, node, most: int = 50) -> DataFrame:
        return graph.neighbours(self.edges, node, most=most)

    def graph(self, starts: DataFrame, depth: int = 2, most: int = 100) -> tuple[DataFrame, DataFrame]:
        return graph.subgraph(self.edges, starts, depth, most)

    def research(self, question: str, steps: int = research.MOST_STEPS) -> research.Run:
        """A run of the research loop; each step is one batch of Spark jobs."""
        spark = self.chunks.sparkSession
        kind = spark.range(1).select(understanding.intent(F.lit(question)).alias("k")).first()["k"]
        names = list(dict.fromkeys(C.ENTITY_ALIASES[w] for w in re.findall(r"\w+", question.lower()) if w in C.ENTITY_ALIASES))
        core = understanding.wordings_of(self.chunks.sparkSession, question, [], "")[:1] or [question]

        def answer(q: str) -> list[dict]:
            one = spark.createDataFrame([(1, q)], "query_id int, text string")
            found = self.claims(one).cache()
            scored = self.confidence(found, self.evidence(one, found)).withColumnRenamed("claim", "key")
            rows = [r.asDict() for r in found.join(scored, "key").select("key", "text", "confidence", "disputed").collect()]  # a dozen claims of one query
            found.unpersist()
            return rows

        asked = [s["question"] for s in research.plan(core[0], names, kind)["sub_questions"]]
        return research.loop(research.Run(question), asked, answer, lambda q: understanding.wordings_of(self.chunks.sparkSession, q, names, kind), steps)

    def evaluate(self, queries: DataFrame, judgments: DataFrame, k: int = 10) -> DataFrame:
        return evaluate.retrieval_metrics(self.search(queries, k).select("query_id", "id", "rank"), judgments, k)
