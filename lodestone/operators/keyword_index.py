"""A stored keyword index with posting blocks and exact, pruned top-k.

Documents are dealt to blocks of about ``BLOCK_DOCS``. For each term and block one row holds the
postings (ids, frequencies, lengths) and what bounds their scores: the largest frequency and the
smallest length. A search first reads the bounds alone, which are far fewer than the
postings. The blocks of a query with the largest sums of bounds are scored; the k-th score
found there is a floor, and of the other blocks only those whose bound reaches it are scored
too. Nothing that could be among the k best is left out, so the rows are those of
``ranking.bm25``: documents with all terms first, the others topping up, each by score. To be scored, a block's postings of all
queries' terms meet once, with the ids that are gone from it, and a task sends the k best of each query.

The index is kept in versions. ``refresh`` writes the postings of new and changed documents as a segment of
its own and marks the older ones as gone; counts of terms, documents and lengths are kept as
differences. No older posting is read or written. ``build`` starts over with one segment.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed as C
from lodestone.functions import text as T
from lodestone.operators import ranking
from lodestone.tables import written
from lodestone.versions import Versions

#: Documents of a block, about, and blocks of each query that set the floor.
BLOCK_DOCS, SEEDS = 64, 4
#: Tokens of a partition of a build, about, and rows that a task of a search unfolds at once.
PART_TOKENS, UNFOLDED = 1 << 24, 1 << 22
#: Added to the score of a document with all terms; larger than any score.
_ALL = ranking.ALL_TERMS


def _share(tf, length, mean: float):
    """What a term adds to a score, before its rarity counts; grows with ``tf`` and falls with ``length``; of columns or of arrays."""
    return tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * length / mean))


class KeywordIndex:
    """The index under ``root``; ``fields``: weights of the text columns."""

    def __init__(self, spark: SparkSession, root: str, fields: dict[str, float] | None = None):
        self.spark, self.versions, self.fields = spark, Versions(spark, root), fields or {"text": 1.0}

    # -- maintenance ----------------------------------------------------------

    def build(self, docs: DataFrame, id_col: str = "id") -> None:
        """Indexes ``docs`` from nothing; ids are integers, one row each."""
        tables, notes = self.built(docs, id_col)
        self.versions.commit(tables, notes=notes)

    def built(self, docs: DataFrame, id_col: str = "id") -> tuple[dict, dict]:
        """The written tables of a build and its notes, for a commit that may take in other tables."""
        tables, notes = self._segment(docs, id_col, 1)
        gone = self.versions.write(self.spark.range(0).select("id", F.lit(1).alias("segment")), "gone")
        return tables | {"gone": gone}, notes | {"segment": 1}

    def refresh(self, docs: DataFrame, removed: DataFrame | None = None, id_col: str = "id") -> None:
        """Takes in new and changed documents (``docs``) and drops those in ``removed`` (id); one in both stays, as ``docs`` has it."""
        tables, append, notes = self.refreshed(docs, removed, id_col)
        self.versions.commit(tables, append, notes)

    def refreshed(self, docs: DataFrame, removed: DataFrame | None = None, id_col: str = "id") -> tuple[dict, tuple[str, ...], dict]:
        """The written tables of a refresh, those that add to what is there, and its notes."""
        before = self.versions.manifest()["notes"]
        tables, notes = self._segment(docs, id_col, before["segment"] + 1)
        touched = docs.select(F.col(id_col).cast("long").alias("id"))
        touched = (touched if removed is None else touched.unionByName(removed.select(F.col("id").cast("long")))).distinct()
        old = written(self.versions.read("forward").join(self.versions.read("gone"), ["id", "segment"], "left_anti").join(touched, "id", "left_semi"), "old")
        lost = old.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0.0))).first()
        fewer = old.select(F.explode(F.array_distinct(F.concat(*self._fields()))).alias("term")).groupBy("term").agg((-F.count(F.lit(1))).alias("n"))
        tables["gone"] = self.versions.write(old.select("id", "segment"), "gone")
        tables["terms"] = self.versions.write(self._read(tables["terms"]).unionByName(fewer), "terms")
        notes = {"segment": before["segment"] + 1, "n": before["n"] - lost[0] + notes["n"], "length": before["length"] - lost[1] + notes["length"], "blocks": before["blocks"] | notes["blocks"]}
        return tables, ("postings", "forward", "terms", "gone"), notes

    def _read(self, table: dict) -> DataFrame:
        return self.spark.read.schema(table["schema"]).parquet(*table["folders"])

    def _fields(self) -> list[str]:
        return [f"f{i}" for i in range(len(self.fields))]

    def _segment(self, docs: DataFrame, id_col: str, segment: int) -> tuple[dict, dict]:
        """Tokens are written once, dealt by block, and gathered there; words are unfolded as the postings of a block, never one by one."""
        tokens = ranking.cut(docs, id_col, self.fields)
        forward = self.versions.write(tokens.select(F.col("id").cast("long").alias("id"), F.lit(segment).alias("segment"), F.col("dl").alias("length"), *self._fields()), "forward")
        tokens = self._read(forward)
        n, length = tokens.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0.0))).first()
        count = max(1, -(-n // BLOCK_DOCS))
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-int(length) // PART_TOKENS))
        block = F.pmod(F.xxhash64("id"), F.lit(count)) + F.lit(segment << 32)
        dealt = tokens.withColumn("block", block).repartition(parts, "block").groupBy("block").agg(F.collect_list(F.struct("id", "length", *self._fields())).alias("docs"))
        weights = list(self.fields.values())

        def run(batches):
            for batch in batches:
                yield _postings(batch["block"], batch["docs"], weights)

        rows = dealt.mapInArrow(run, f"term string, blocks array<{_BLOCK}>")
        rows = rows.repartition(parts, "term").select("term", F.explode("blocks").alias("b")).select("term", "b.*")  # a frequent term is many rows
        postings = self.versions.write(rows.sortWithinPartitions("term", "block"), "postings")
        terms = self._read(postings).groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("n"))
        return {"postings": postings, "forward": forward, "terms": self.versions.write(terms, "terms")}, {"n": n, "length": length, "blocks": {str(segment): count}}

    # -- search ---------------------------------------------------------------

    def search(self, queries: DataFrame, k: int = C.K_EACH, allowed: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, matched, n_terms, rank) of the k best of each query (query_id, text) among ``allowed`` (id)."""
        return self.searched(queries, k, allowed)[0]

    def searched(self, queries: DataFrame, k: int = C.K_EACH, allowed: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
        """The hits, and for each query how many blocks hold any of its terms and how many were scored."""
        notes = self.versions.manifest()["notes"]
        n, mean = notes["n"], (notes["length"] / notes["n"] if notes["n"] else 0) or 1.0
        asked = queries.select("query_id", F.explode(F.array_distinct(T.tokens(F.col("text")))).alias("term"))
        sizes = asked.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_terms"))
        df = self.versions.read("terms").join(ranking.bounded(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.sum("n").alias("df")).where("df > 0")
        rarity = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(C.IDF_FLOOR))
        terms = written(asked.join(sizes, "query_id").join(df, "term").select("query_id", "n_terms", "term", rarity.alias("idf")), "terms")
        groups = max(1, -(-terms.count() // ranking.BROADCAST_ROWS))  # of queries, whose terms go along with the function
        out = None
        for g in range(groups):
            some = self._group(terms if groups == 1 else terms.where(F.pmod(F.xxhash64("query_id"), F.lit(groups)) == g), k, mean, allowed)
            out = some if out is None else tuple(a.unionByName(b) for a, b in zip(out, some))
        return out

    def _group(self, terms: DataFrame, k: int, mean: float, allowed: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        """``searched`` of queries whose terms (query_id, n_terms, term, idf) are few."""
        postings, few = self.versions.read("postings"), F.broadcast(terms)
        bounds = postings.select("term", "block", "most", "least").join(few, "term")
        reach = F.sum(F.col("idf") * _share(F.col("most"), F.col("least"), mean)) + F.when(F.count(F.lit(1)) == F.max("n_terms"), F.lit(_ALL)).otherwise(0.0) + 1e-6
        bounds = written(bounds.groupBy("query_id", "block").agg(reach.alias("reach")), "bounds")
        first = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("reach"), "block"))
        seeds = written(bounds.withColumn("place", first).where(F.col("place") <= SEEDS).select("query_id", "block"), "seeds")
        asked = _Asked(terms.toArrow(), k, mean)
        begun = written(self._scored(postings, terms, asked.only(seeds.toArrow()), allowed, seeds.select("block").distinct()), "begun")
        worth = F.col("score") + F.when(F.col("matched") == F.col("n_terms"), F.lit(_ALL)).otherwise(0.0)
        nth = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("worth")))
        floor = begun.withColumn("worth", worth).withColumn("nth", nth).where(F.col("nth") == k).select("query_id", F.col("worth").alias("floor"))
        floor = written(floor, "floor")
        hits = self._scored(postings, terms, asked.above(floor.toArrow()), allowed)
        order = Window.partitionBy("query_id").orderBy((F.col("matched") == F.col("n_terms")).desc(), F.desc("score"), "id")
        hits = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        read = bounds.join(F.broadcast(floor), "query_id", "left").join(seeds.withColumn("seed", F.lit(True)), ["query_id", "block"], "left")
        read = read.groupBy("query_id").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.expr("coalesce(seed, false) OR floor IS NULL OR reach >= floor")).alias("read"))
        return hits.select("query_id", "id", "score", "matched", "n_terms", "rank"), read

    def _block_of(self) -> Column:
        """The block of a row (id, segment)."""
        count = F.create_map(*(F.lit(x) for s, n in self.versions.manifest()["notes"]["blocks"].items() for x in (int(s), n)))
        return F.pmod(F.xxhash64("id"), F.element_at(count, F.col("segment"))) + F.shiftleft(F.col("segment").cast("long"), 32)

    def _scored(self, postings: DataFrame, terms: DataFrame, asked: _Asked, allowed: DataFrame | None, blocks: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, matched, n_terms): the k best of each query and task, of the blocks that ``asked`` takes.

        The postings of the queries' terms meet in the order of blocks, each once for all queries, with the ids that are gone from a block.
        """
        rows = postings.join(F.broadcast(terms.select("term").distinct()), "term", "left_semi").select("block", F.lit(1).alias("kind"), "term", "most", "least", "docs")
        gone = self.versions.read("gone")
        ids = gone.select("id", "segment", F.lit(0).alias("kind"))
        if allowed is not None:
            live = self.versions.read("forward").select("id", "segment").join(gone, ["id", "segment"], "left_anti")
            ids = ids.unionByName(live.join(allowed.select("id"), "id", "left_semi").select("id", "segment", F.lit(2).alias("kind")))
        zero = F.lit(0.0)
        marks = ids.select(self._block_of().alias("block"), "kind", F.lit("").alias("term"), zero.alias("most"), zero.alias("least"), F.array(F.struct("id", zero.alias("tf"), zero.alias("dl"))).alias("docs"))
        rows = rows.unionByName(marks)
        rows = rows if blocks is None else rows.join(ranking.bounded(blocks), "block", "left_semi")
        parts = max(int(self.spark.conf.get("spark.sql.shuffle.partitions")), -(-int(self.versions.manifest()["notes"]["length"]) // (2 * PART_TOKENS)))
        choose = allowed is not None

        def run(batches):
            best, held = ranking.Best(len(asked.names), asked.k, 4), None
            for batch in batches:
                held = batch if held is None else pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
                block = held["block"].to_numpy()
                whole = int(np.searchsorted(block, block[-1])) if len(block) else 0  # the last block may go on
                asked.score(held.slice(0, whole), best, choose)
                held = held.slice(whole)
            if held is not None:
                asked.score(held, best, choose)
            yield asked.hits(best)

        kind = dict(terms.dtypes)["query_id"]
        return rows.repartition(parts, "block").sortWithinPartitions("block").mapInArrow(run, f"query_id {kind}, id long, score double, matched long, n_terms long")


_DOCS = "array<struct<id: long, tf: double, dl: double>>"
_BLOCK = f"struct<block: long, most: double, least: double, docs: {_DOCS}>"


def _postings(block: pa.Array, docs: pa.ListArray, weights: list[float]) -> pa.RecordBatch:
    """(term, blocks) of blocks of documents: for each term its blocks, with what bounds their scores and the documents by id."""
    each = docs.flatten()
    at = np.repeat(np.arange(len(docs)), pc.list_value_length(docs).to_numpy(zero_copy_only=False))
    ids, lengths = each.field("id").to_numpy(zero_copy_only=False), each.field("length").to_numpy(zero_copy_only=False)
    order = np.lexsort((lengths, ids, at))
    new = np.ones(len(order), bool)  # rows that share id and length count as one document
    new[1:] = (np.diff(at[order]) != 0) | (np.diff(ids[order]) != 0) | (np.diff(lengths[order]) != 0)
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(new) - 1
    first, n = order[new], max(int(new.sum()), 1)
    lists = [each.field(f"f{i}") for i in range(len(weights))]
    sizes = [pc.fill_null(pc.list_value_length(x), 0).to_numpy(zero_copy_only=False) for x in lists]
    words = pa.chunked_array([x.flatten() for x in lists], pa.string()).combine_chunks()
    words = (words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words).dictionary_encode()
    owner, w = np.concatenate([np.repeat(code, s) for s in sizes]), np.repeat(weights, [s.sum() for s in sizes])
    keys, place = np.unique(words.indices.to_numpy(zero_copy_only=False).astype(np.int64) * n + owner, return_inverse=True)
    tf, term, doc = np.bincount(place, w, len(keys)), keys // n, first[keys % n]
    starts = lambda x: np.nonzero(np.append(True, x[1:]))[0] if len(x) else np.zeros(0, np.int64)
    group = starts(np.append(True, (np.diff(term) != 0) | (np.diff(at[doc]) != 0)) if len(term) else term)
    rare = starts(np.append(True, np.diff(term[group]) != 0) if len(group) else group)
    reduced = lambda f, x: f.reduceat(x, group) if len(group) else x
    nested = pa.ListArray.from_arrays(pa.array(np.append(group, len(keys)), pa.int32()), pa.StructArray.from_arrays([pa.array(ids[doc]), pa.array(tf), pa.array(lengths[doc])], ["id", "tf", "dl"]))
    blocks = pa.StructArray.from_arrays([block.take(pa.array(at[doc[group]])), pa.array(reduced(np.maximum, tf)), pa.array(reduced(np.minimum, lengths[doc])), nested], ["block", "most", "least", "docs"])
    blocks = pa.ListArray.from_arrays(pa.array(np.append(rare, len(group)), pa.int32()), blocks)
    return pa.RecordBatch.from_arrays([words.dictionary.take(pa.array(term[group[rare]])).cast(pa.string()), blocks], ["term", "blocks"])


class _Asked:
    """Queries as terms with their queries, and which blocks they take: those named, or those whose bound reaches a floor."""

    def __init__(self, terms: pa.Table, k: int, mean: float):
        terms = terms.combine_chunks()
        one = lambda c: c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
        names, words = one(terms["query_id"]).dictionary_encode(), one(terms["term"]).dictionary_encode()
        query, word = (x.indices.to_numpy(zero_copy_only=False).astype(np.int64) for x in (names, words))
        order = np.argsort(word, kind="stable")
        self.k, self.mean, self.names, self.terms = k, mean, names.dictionary, words.dictionary
        self.queries, self.idf = query[order], one(terms["idf"]).to_numpy(zero_copy_only=False)[order]
        self.n_terms = np.zeros(len(self.names), np.int64)
        self.n_terms[query] = one(terms["n_terms"]).to_numpy(zero_copy_only=False)
        self.counts = np.bincount(word, minlength=len(self.terms))
        self.starts = np.cumsum(self.counts) - self.counts
        self.floor, self.seeds = np.full(len(self.names), -np.inf), None

    def _with(self, rows: pa.Table) -> tuple[_Asked, np.ndarray]:
        other = object.__new__(_Asked)
        other.__dict__ |= self.__dict__
        return other, pc.index_in(rows["query_id"], value_set=self.names).to_numpy()

    def only(self, seeds: pa.Table) -> _Asked:
        other, query = self._with(seeds)
        blocks, place = np.unique(seeds["block"].to_numpy(), return_inverse=True)
        other.seeds = blocks, np.sort(place * len(self.names) + query)
        return other

    def above(self, floor: pa.Table) -> _Asked:
        other, query = self._with(floor)
        other.floor = self.floor.copy()
        other.floor[query] = floor["floor"].to_numpy()
        return other

    def score(self, rows: pa.RecordBatch, best: ranking.Best, choose: bool) -> None:
        """Scores whole blocks (block, kind, term, most, least, docs), some at once; kind 0 are ids that are gone, kind 2, if ``choose``, the only ones that count."""
        if rows.num_rows and len(self.names):
            code = pc.fill_null(pc.index_in(rows["term"], value_set=self.terms), -1).to_numpy(zero_copy_only=False)
            size = pc.list_value_length(rows["docs"]).to_numpy(zero_copy_only=False)
            work = np.cumsum(np.where(code >= 0, self.counts[code], 0) * size + size)
            block = rows["block"].to_numpy()
            ends = np.append(np.nonzero(np.diff(block))[0] + 1, len(block))
            at = 0
            while at < len(block):
                fits = np.searchsorted(work[ends - 1], (work[at - 1] if at else 0) + UNFOLDED, "right")
                end = int(ends[max(int(fits) - 1, int(np.searchsorted(ends, at, "right")))])
                self._blocks(rows.slice(at, end - at), code[at:end].astype(np.int64), best, choose)
                at = end

    def _blocks(self, rows: pa.RecordBatch, code: np.ndarray, best: ranking.Best, choose: bool) -> None:
        queries = len(self.names)
        names, block = np.unique(rows["block"].to_numpy(), return_inverse=True)
        kind, docs = rows["kind"].to_numpy(), rows["docs"]
        size, flat = pc.list_value_length(docs).to_numpy(zero_copy_only=False).astype(np.int64), docs.flatten()
        first, row = np.cumsum(size) - size, np.repeat(np.arange(len(size)), size)
        known, ids = np.unique(flat.field("id").to_numpy(zero_copy_only=False), return_inverse=True)
        doc = block[row] * len(known) + ids
        live = (kind[row] == 1) & ~np.isin(doc, doc[kind[row] == 0])
        live = live & np.isin(doc, doc[kind[row] == 2]) if choose else live
        held = np.nonzero(kind == 1)[0]
        n = self.counts[code[held]]
        of = np.repeat(held, n)  # a row for each term and query of a block
        entry = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n) + self.starts[code[of]]
        most, least = (rows[c].to_numpy()[of] for c in ("most", "least"))
        pair, place = np.unique(block[of] * queries + self.queries[entry], return_inverse=True)
        query = pair % queries
        reach = np.bincount(place, self.idf[entry] * _share(most, least, self.mean), len(pair)) + 1e-6
        reach += np.where(np.bincount(place, minlength=len(pair)) == self.n_terms[query], _ALL, 0.0)
        if self.seeds is None:
            keep = reach >= self.floor[query]
        else:
            at = np.minimum(np.searchsorted(self.seeds[0], names), len(self.seeds[0]) - 1) if len(self.seeds[0]) else np.zeros(len(names), np.int64)
            keep = np.isin(at[pair // queries] * queries + query, self.seeds[1]) if len(self.seeds[0]) else np.zeros(len(pair), bool)
            keep &= (self.seeds[0][at] == names)[pair // queries] if len(self.seeds[0]) else True
        of, entry = of[keep[place]], entry[keep[place]]
        each = np.repeat(np.arange(len(of)), size[of])  # a row for each of their documents
        posting = np.arange(len(each)) - np.repeat(np.cumsum(size[of]) - size[of], size[of]) + first[of[each]]
        each, posting = each[live[posting]], posting[live[posting]]
        tf, dl = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("tf", "dl"))
        share = _share(tf, dl, self.mean)
        cell, place = np.unique(self.queries[entry[each]] * (len(names) * len(known)) + doc[posting], return_inverse=True)
        score = np.bincount(place, self.idf[entry[each]] * share[posting], len(cell))
        matched, query = np.bincount(place, minlength=len(cell)), cell // (len(names) * len(known))
        worth = np.floor(score * 1e6 + 0.5) / 1e6 + np.where(matched == self.n_terms[query], _ALL, 0.0)
        some = worth >= best.least[query]
        best.put(query[some], worth[some], known[cell[some] % len(known)], matched[some])

    def hits(self, best: ranking.Best) -> pa.RecordBatch:
        query, worth, ids, matched = best.cut()
        query, n_terms = query.astype(np.int64), self.n_terms[query.astype(np.int64)]
        score = np.round(worth - np.where(matched == n_terms, _ALL, 0.0), 6)
        columns = [self.names.take(pa.array(query)), pa.array(ids.astype(np.int64)), pa.array(score.astype(np.float64)), pa.array(matched.astype(np.int64)), pa.array(n_terms)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score", "matched", "n_terms"])
