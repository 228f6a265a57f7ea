"""The entity graph: stored directed, walked in both directions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.tables import written


def both_ways(edges: DataFrame) -> DataFrame:
    """(at, to, kind, edge) of edges (edge, subject, object, kind)."""
    out = edges.select(F.col("subject").alias("at"), F.col("object").alias("to"), "kind", "edge")
    return out.unionByName(edges.select(F.col("object").alias("at"), F.col("subject").alias("to"), "kind", "edge"))


def neighbours(edges: DataFrame, node, kinds: list[str] | None = None, most: int = 50) -> DataFrame:
    """One hop around a node: (edge, node, kind), in the order of edges, at most ``most`` edges."""
    rows = both_ways(edges).where(F.col("at") == F.lit(node))
    rows = rows if kinds is None else rows.where(F.col("kind").isin(kinds))
    return rows.dropDuplicates(["edge"]).orderBy("edge").limit(most).select("edge", F.col("to").alias("node"), "kind")


def reachable(edges: DataFrame, starts: DataFrame, depth: int) -> DataFrame:
    """(start, node, depth) with the smallest depth. Each step joins the frontier only, drops what was seen and is written, so the work of a step is its own."""
    links = written(both_ways(edges).select("at", "to").distinct(), "links")
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth"))
    frontier = seen
    for d in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["at"]).select("start", F.col("to").alias("node")).distinct()
        frontier = written(step.join(seen.select("start", "node"), ["start", "node"], "left_anti").withColumn("depth", F.lit(d)), "frontier")
        seen = seen.unionByName(frontier)
    return seen


def subgraph(edges: DataFrame, starts: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """The nearest ``most`` nodes and all edges among them."""
    nodes = reachable(edges, starts, depth).groupBy("node").agg(F.min("depth").alias("depth")).orderBy("depth", "node").limit(most)
    inner = edges.join(nodes.select(F.col("node").alias("subject")), "subject", "left_semi").join(nodes.select(F.col("node").alias("object")), "object", "left_semi")
    return nodes, inner


def shortest_paths(edges: DataFrame, source, target, hops: int = 5) -> DataFrame:
    """(path, hops): the shortest path, of several the smallest. Walks meet each node once, with its smallest path."""
    links = written(both_ways(edges).select("at", "to").distinct(), "links")
    seen = frontier = edges.sparkSession.range(1).select(F.lit(source).alias("node"), F.array(F.lit(source)).alias("path"))
    for _ in range(hops):
        step = frontier.join(links, frontier["node"] == links["at"]).select(F.col("to").alias("node"), F.concat("path", F.array("to")).alias("path"))
        frontier = written(step.groupBy("node").agg(F.min("path").alias("path")).join(seen.select("node"), "node", "left_anti"), "frontier")
        seen = seen.unionByName(frontier)
    return seen.where(F.col("node") == F.lit(target)).select("path", (F.size("path") - 1).alias("hops"))


def added(edges: DataFrame) -> DataFrame:
    """Edges after inserts (seq, subject, object, kind, strength, source): no loops, the largest strength, the first source."""
    rows = edges.where(F.col("subject") != F.col("object"))
    return rows.groupBy("subject", "object", "kind").agg(F.max("strength").alias("strength"), F.min(F.struct("seq", "source")).alias("f")).select("subject", "object", "kind", "strength", F.col("f.source").alias("source"))


def resolved(names: DataFrame, entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(name, id): by canonical name, else by alias, in any case."""
    table = entities.select(F.lower("name").alias("k"), "id", F.lit(0).alias("p")).unionByName(aliases.select(F.lower("alias").alias("k"), "id", F.lit(1).alias("p")))
    best = table.groupBy("k").agg(F.min(F.struct("p", "id")).alias("b"))
    return names.join(best, F.lower("name") == F.col("k"), "left").select("name", F.col("b.id").alias("id"))


def linked_claims(claims: DataFrame, aliases: DataFrame) -> DataFrame:
    """(claim, entity): aliases (of one word) that stand in a claim as a whole word, met by equality of words."""
    found = claims.select("claim", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0)))).alias("alias"))
    return found.join(aliases, "alias").select("claim", "entity").distinct()


def co_mentions(mentions: DataFrame, kind: str = "alternative-to", strength: float = 0.5) -> DataFrame:
    """Pairs of entities that one document (document, entity) names, with the first such document."""
    rows = mentions.distinct()
    a, b = rows.alias("a"), rows.alias("b")
    pairs = a.join(b, (F.col("a.document") == F.col("b.document")) & (F.col("a.entity") < F.col("b.entity")))
    return pairs.groupBy(F.col("a.entity").alias("subject"), F.col("b.entity").alias("object")).agg(F.min("a.document").alias("source")).withColumns({"kind": F.lit(kind), "strength": F.lit(strength)})


def upserted(entities: DataFrame, aliases: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, aliases) after a batch of entities (name, kind, description, aliases: array).

    An incoming entity is a stored one (id, name, kind, description) if its name or an alias (entity, alias) is known, in any
    case; else it is new, with ids after the largest one, in the order of names. Unknown aliases are added; an
    empty description is filled.
    """
    known = aliases.select("entity", F.lower("alias").alias("k")).unionByName(entities.select(F.col("id").alias("entity"), F.lower("name").alias("k"))).groupBy("k").agg(F.min("entity").alias("entity"))
    words = incoming.select("name", F.explode(F.array_distinct(F.transform(F.concat(F.array("name"), "aliases"), lambda a: F.lower(a)))).alias("k"))
    found = words.join(known, "k").groupBy("name").agg(F.min("entity").alias("entity"))
    rows = written(incoming.join(found, "name", "left"), "incoming")
    fresh = rows.where("entity is null").groupBy(F.lower("name").alias("k")).agg(F.min(F.struct("name", "kind", "description")).alias("r"))
    top = entities.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))  # one row
    order = F.row_number().over(Window.orderBy("k"))  # the new entities of one batch
    new = written(fresh.withColumn("n", order).join(F.broadcast(top), F.lit(True)).select((F.col("top") + F.col("n")).alias("id"), "k", "r.*"), "entities")
    backfill = rows.where("entity is not null").groupBy("entity").agg(F.max("description").alias("more"))
    old = entities.join(backfill, F.col("id") == F.col("entity"), "left").withColumn("description", F.coalesce(F.nullif("description", F.lit("")), "more")).select("id", "name", "kind", "description")
    named = rows.select("name", "entity", "aliases").join(new.select("k", "id"), F.lower("name") == F.col("k"), "left")
    added_ = named.select(F.coalesce("entity", "id").alias("entity"), F.explode(F.concat(F.array("name"), "aliases")).alias("alias"))
    fresh_aliases = added_.join(known.select("k"), F.lower("alias") == F.col("k"), "left_anti").dropDuplicates(["entity", "alias"])
    return old.unionByName(new.select("id", "name", "kind", "description")), aliases.select("entity", "alias").unionByName(fresh_aliases)


def with_claims(nodes: DataFrame, edges: DataFrame, claims: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes (node) with their surest claims, and edges (subject, object) with the claims that both ends share; ``claims``: entity, claim, confidence."""
    place = F.row_number().over(Window.partitionBy("entity").orderBy(F.desc_nulls_last("confidence"), "claim"))
    best = claims.withColumn("place", place).where(F.col("place") <= most).groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("place", "claim"))).alias("c")).select("entity", F.col("c.claim").alias("claims"))
    of = lambda x: best.select(F.col("entity").alias(x), F.col("claims").alias(f"{x}_claims"))
    none = F.array().cast(best.schema["claims"].dataType)
    told = nodes.join(best, nodes["node"] == best["entity"], "left").drop("entity").withColumn("claims", F.coalesce("claims", none))
    linked = edges.join(of("subject"), "subject", "left").join(of("object"), "object", "left")
    return told, linked.withColumn("claims", F.coalesce(F.array_intersect("subject_claims", "object_claims"), none)).drop("subject_claims", "object_claims")


def seeds_of(queries: DataFrame, aliases: DataFrame, most: int = 12) -> DataFrame:
    """(query_id, seed, place): entities that the words of each query (query_id, text) name by an alias (alias, entity), in the order in which they come."""
    words = queries.select("query_id", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}_]+"), F.lit(0))).alias("at", "alias"))
    found = words.join(aliases, "alias").groupBy("query_id", F.col("entity").alias("seed")).agg(F.min("at").alias("at"))
    order = Window.partitionBy("query_id").orderBy("at", "seed")
    return found.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("query_id", "seed", "place")


def for_queries(edges: DataFrame, seeds: DataFrame, depth: int = 1, cap: int = 60, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """The neighbourhoods of a whole batch of queries: nodes (query_id, node, depth, place) and edges (query_id and the columns of ``edges``).

    ``seeds``: query_id, seed, place. One walk goes on from all seeds of all queries at once. Each seed has its
    share of the cap (``least`` at least), which is kept at every step, nearest nodes first and the smallest of one step, so a walk
    holds no more than its share. The walks of a query are merged in the order of its seeds up to ``cap`` nodes, numbered
    by ``place``; edges are those among the nodes that stay.

    Of a node's neighbours, only the smallest that two full shares could need are ever looked at: one share may have been
    seen before, and one is what a step can add. So a node with very many edges is a short list.
    """
    share = F.greatest(F.floor(F.lit(cap) / F.count(F.lit(1)).over(Window.partitionBy("query_id"))), F.lit(least)).cast("int")
    walks = written(seeds.select("query_id", "seed", F.col("place").alias("turn"), share.alias("share")), "walks")
    top = walks.agg(F.max("share")).first()[0] or least
    links = both_ways(edges).select("at", "to").distinct()
    near = F.row_number().over(Window.partitionBy("at").orderBy("to"))
    links = written(links.withColumn("n", near).where(F.col("n") <= 2 * top + 1).drop("n"), "links")
    seen = frontier = written(walks.withColumn("node", F.col("seed")).withColumn("depth", F.lit(0)), "seen")
    walk = ["query_id", "seed"]
    for d in range(1, depth + 1):
        step = frontier.join(links, frontier["node"] == links["at"]).select(*walk, "turn", "share", F.col("to").alias("node")).distinct()
        step = step.join(seen.select(*walk, "node"), [*walk, "node"], "left_anti")
        held = seen.groupBy(*walk).agg(F.count(F.lit(1)).alias("held"))
        first = F.row_number().over(Window.partitionBy(*walk).orderBy("node"))
        step = step.join(held, walk).withColumn("n", first).where(F.col("n") <= F.col("share") - F.col("held"))
        frontier = written(step.select(*walk, "turn", "share", "node", F.lit(d).alias("depth")), "frontier")
        seen = seen.unionByName(frontier)
    met = seen.groupBy("query_id", "node").agg(F.min(F.struct("turn", "depth")).alias("m"))
    order = Window.partitionBy("query_id").orderBy("m.turn", "m.depth", "node")
    nodes = written(met.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap).select("query_id", "node", F.col("m.depth").alias("depth"), "place"), "nodes")
    end = lambda x: nodes.select("query_id", F.col("node").alias(x))
    return nodes, end("subject").join(edges, "subject").join(end("object"), ["query_id", "object"], "left_semi")


def claims_attached(nodes: DataFrame, edges: DataFrame, claims: DataFrame, most: int = 5) -> tuple[DataFrame, DataFrame]:
    """Nodes with the ids of their surest claims, and edges with the claims about both ends; ``claims``: entity, claim, confidence. Ids of queries stay."""
    return with_claims(nodes, edges, claims, most)
