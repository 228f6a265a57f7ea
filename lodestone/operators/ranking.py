"""Index search and ranking: BM25, vector neighbours, reciprocal rank fusion, signal fusion."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed as C
from lodestone.functions import text as T
from lodestone.tables import written

#: Rows of a side that may be broadcast. Larger sides are shuffled.
BROADCAST_ROWS = 100_000
#: Queries that meet all vectors at once, about; 1024 vectors of 1024 floats are 4 MB.
QUERY_BLOCK = 1024
#: Of the keyword search: documents and tokens of a part, queries of a block (about), terms of a matrix, and what a document with all terms gets, which is more than any score.
PART_DOCS, PART_TOKENS, SEARCH_BLOCK, MATRIX_TERMS, ALL_TERMS = 1024, 1 << 20, 8192, 512, 1e8
#: A term is frequent if its share of documents times its share of queries is above 1 / ``DENSE``; scores of documents and queries held at once.
DENSE, CELLS = 200, 1 << 19
#: Types of ids that can be kept in matrices.
INTEGERS = ("tinyint", "smallint", "int", "bigint")


def bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it is counted and has few rows."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def tokenised(docs: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """(id, dl, f0, f1, ...): the tokens of each field and their number, written once; later steps read them and no text."""
    return written(cut(docs, id_col, fields), "tokens")


def cut(docs: DataFrame, id_col: str, fields: dict[str, float]) -> DataFrame:
    """``tokenised``, not written."""
    cut = docs.select(F.col(id_col).alias("id"), *(T.tokens(F.col(c)).alias(f"f{i}") for i, c in enumerate(fields)))
    length = F.lit(0)
    for i in range(len(fields)):
        length = length + F.size(f"f{i}")
    return cut.withColumn("dl", length.cast("double"))


def postings(tokens: DataFrame, weights: list[float], terms: DataFrame | None = None) -> DataFrame:
    """(id, dl, term, tf): term counts, each field with its weight; of ``terms`` (term) only, if given."""
    parts = [tokens.select("id", "dl", F.explode(f"f{i}").alias("term"), F.lit(float(w)).alias("w")) for i, w in enumerate(weights)]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows if terms is None else rows.join(bounded(terms), "term")
    return rows.groupBy("id", "dl", "term").agg(F.sum("w").alias("tf"))


def bm25(docs: DataFrame, queries: DataFrame, k: int = C.K_EACH, id_col: str = "doc_id", fields: dict[str, float] | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, matched, n_terms, rank): documents with all terms first, then by Okapi score.

    ``queries``: query_id, text. ``fields``: weights of columns; a term counts as often as it stands in each, times the weight. Texts are read
    once and kept as postings of some hundred documents; these meet the queries in blocks of about ``SEARCH_BLOCK``, and a task
    sends the k best of each query, so no row for a document and a query is shuffled. ``tokens`` (from ``tokenised``)
    spares batches of queries the reading. Rows that share an id, or have none, and ids that are no integers are added up by aggregation.
    """
    fields = fields or {"text": 1.0}
    weights = list(fields.values())
    tokens = cut(docs, id_col, fields) if tokens is None else tokens
    blocks = _blocks(queries)
    words = blocks.select(F.explode("words").alias("term"))
    rows = blocks.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    few = words.distinct().limit(BROADCAST_ROWS + 1).toArrow()["term"].combine_chunks() if rows <= 4 * BROADCAST_ROWS else None
    single, shared = _apart(tokens)
    parts = written(_parts(single, weights, few if few is not None and len(few) <= BROADCAST_ROWS else None), "parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("length"), F.lit(0.0))).first()
    df = parts.select(F.explode(F.arrays_zip("terms", "sizes")).alias("t")).select("t.terms", "t.sizes").groupBy("terms").agg(F.sum("sizes").alias("df")).toDF("term", "df")
    if shared is not None:
        more = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum("dl"), F.lit(0.0))).first()
        total = (total[0] + more[0], total[1] + more[1])
        found = written(postings(shared, weights, words.distinct()), "postings")
        df = df.unionByName(found.groupBy("term").agg(F.count(F.lit(1)).alias("df"))).groupBy("term").agg(F.sum("df").alias("df"))
    n, mean = total[0], (total[1] / total[0] if total[0] else 0) or 1.0
    idf = F.greatest(F.log((n - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(C.IDF_FLOOR))
    kind, hits = dict(tokens.dtypes)["id"], _searched(parts, blocks, df.select("term", idf.alias("idf")), k, mean)
    if shared is not None:
        part = F.col("idf") * F.col("tf") * (C.BM25_K1 + 1) / (F.col("tf") + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * F.col("dl") / mean))
        asked = _unfolded(blocks).join(df.select("term", idf.alias("idf")), "term")
        sums = found.join(bounded(asked), "term").groupBy("query_id", "id").agg(F.round(F.sum(part), 6).alias("score"), F.count(F.lit(1)).alias("matched"), F.max("n_terms").alias("n_terms"))
        hits = hits.unionByName(sums) if kind in INTEGERS else sums
    order = Window.partitionBy("query_id").orderBy((F.col("matched") == F.col("n_terms")).desc(), F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("id").cast(kind).alias("id"), "score", "matched", "n_terms", "rank")


def _apart(tokens: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows whose id is an integer of their own, and the other ones or None if there are none."""
    if dict(tokens.dtypes)["id"] not in INTEGERS:
        return tokens.where(F.lit(False)).withColumn("id", F.lit(0).cast("long")), tokens
    again = written(tokens.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1 OR id IS NULL").select("id"), "again")
    if again.isEmpty():
        return tokens, None
    again = bounded(again)
    return tokens.where("id IS NOT NULL").join(again, "id", "left_anti"), tokens.where("id IS NULL").unionByName(tokens.join(again, "id", "left_semi").select(*tokens.columns))


def _parts(tokens: DataFrame, weights: list[float], only: pa.Array | None) -> DataFrame:
    """Postings of up to ``PART_DOCS`` documents a row: their number and length, ids, lengths, terms (of ``only``, if given), and for each term its documents and counts."""

    def run(batches):
        for batch in batches:
            lengths = batch["dl"].to_numpy(zero_copy_only=False)
            ends = np.cumsum(lengths)
            at = 0
            while at < batch.num_rows:
                most = np.searchsorted(ends, (ends[at - 1] if at else 0) + PART_TOKENS, "right")
                n = min(max(int(most) - at, 1), PART_DOCS, batch.num_rows - at)
                yield _part(batch.slice(at, n), weights, only)
                at += n

    schema = "n long, length double, ids array<long>, lengths array<double>, terms array<string>, sizes array<int>, docs array<int>, tf array<double>"
    return tokens.withColumn("id", F.col("id").cast("long")).mapInArrow(run, schema)


def _part(batch: pa.RecordBatch, weights: list[float], only: pa.Array | None) -> pa.RecordBatch:
    flats, docs, w = [], [], []
    for i, weight in enumerate(weights):
        lists = batch[f"f{i}"]
        flats.append(lists.flatten())
        sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
        docs.append(np.repeat(np.arange(len(lists)), sizes))
        w.append(np.full(len(flats[-1]), weight))
    words = pa.chunked_array(flats, pa.string()).combine_chunks()
    words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
    if only is None:
        coded = words.dictionary_encode()
        names, codes = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    else:
        names, codes = only, pc.fill_null(pc.index_in(words, value_set=only), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    keep = codes >= 0
    n = batch.num_rows
    keys, place = np.unique(codes[keep] * n + np.concatenate(docs)[keep], return_inverse=True)
    tf = np.bincount(place, np.concatenate(w)[keep], len(keys))
    term, sizes = np.unique(keys // n, return_counts=True)
    lengths = batch["dl"].to_numpy(zero_copy_only=False)
    one = lambda x: pa.array([x])
    columns = [one(n), one(float(lengths.sum())), _one(batch["id"], pa.int64()), _one(lengths, pa.float64()), _one(names.take(pa.array(term)), pa.string()), _one(sizes, pa.int32()), _one(keys % n, pa.int32()), _one(tf, pa.float64())]
    return pa.RecordBatch.from_arrays(columns, ["n", "length", "ids", "lengths", "terms", "sizes", "docs", "tf"])


def _blocks(queries: DataFrame) -> DataFrame:
    """(block, names, widths, words, codes), written: queries of about ``SEARCH_BLOCK`` a row, with the number of terms of each, all their terms once, and the place of each term there."""
    asked = queries.where("query_id IS NOT NULL").select("query_id", F.array_distinct(T.tokens(F.col("text"))).alias("words"))
    if not queries.groupBy("query_id").count().where("query_id IS NOT NULL AND count > 1").isEmpty():
        asked = asked.groupBy("query_id").agg(F.flatten(F.collect_list("words")).alias("words"))  # rows of one query are one query
    asked, kind, most, wide = asked.where(F.size("words") > 0), dict(queries.dtypes)["query_id"], SEARCH_BLOCK, 64 * SEARCH_BLOCK

    def run(batches):
        held, rows, terms = [], 0, 0

        def row():
            words = pa.chunked_array([b["words"].flatten() for b in held]).combine_chunks().dictionary_encode()
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            ids = pa.chunked_array([b["query_id"] for b in held]).combine_chunks()
            sizes = np.concatenate([pc.list_value_length(b["words"]).to_numpy(zero_copy_only=False) for b in held])
            columns = [_one(ids, ids.type), _one(sizes, pa.int32()), _one(words.dictionary, pa.string()), _one(words.indices, pa.int32())]
            return pa.RecordBatch.from_arrays(columns, ["names", "widths", "words", "codes"])

        for batch in batches:
            ends, at = np.cumsum(pc.list_value_length(batch["words"]).to_numpy(zero_copy_only=False)), 0
            while at < batch.num_rows:
                before = int(ends[at - 1]) if at else 0
                n = min(int(np.searchsorted(ends, before + wide - terms, "right")) - at, most - rows, batch.num_rows - at)
                n = n if rows else max(n, 1)
                if n > 0:
                    held.append(batch.slice(at, n))
                    rows, terms, at = rows + n, terms + int(ends[at + n - 1]) - before, at + n
                if at < batch.num_rows:
                    yield row()
                    held, rows, terms = [], 0, 0
        if held:
            yield row()

    made = asked.mapInArrow(run, f"names array<{kind}>, widths array<int>, words array<string>, codes array<int>")
    return written(made.withColumn("block", F.monotonically_increasing_id()), "blocks")


def _unfolded(blocks: DataFrame) -> DataFrame:
    """(query_id, n_terms, term) of ``_blocks``."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                names, sizes, words, codes = (batch[c][at].values for c in ("names", "sizes", "words", "codes"))
                owner = pa.array(np.repeat(np.arange(len(sizes)), sizes.to_numpy(zero_copy_only=False)))
                yield pa.RecordBatch.from_arrays([names.take(owner), sizes.take(owner).cast(pa.int64()), words.take(codes)], ["query_id", "n_terms", "term"])

    return blocks.select("names", F.col("widths").alias("sizes"), "words", "codes").mapInArrow(run, f"query_id {dict(blocks.dtypes)['names'][6:-1]}, n_terms long, term string")


def _one(x, kind: pa.DataType) -> pa.ListArray:
    """A column of one row that holds a list."""
    x = x if isinstance(x, pa.Array) else pa.array(x, kind)
    return pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x if x.type == kind else x.cast(kind))


def _searched(parts: DataFrame, blocks: DataFrame, rarity: DataFrame, k: int, mean: float) -> DataFrame:
    """(query_id, id, score, matched, n_terms): the k best of each query and task; ``rarity``: term, idf. Only places of terms come back from the terms' own shuffle."""
    n, queries = blocks.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("names")), F.lit(0))).first()
    at = blocks.select("block", F.posexplode("words").alias("at", "term")).join(rarity, "term").select("block", "at", "idf")
    # blocks and what comes back meet where a task takes them; twice as many places, so few blocks share one
    known = at.repartition(2 * n, "block").groupBy("block").agg(F.collect_list(F.struct("at", "idf")).alias("rare")) if n else at.select("block", F.array(F.struct("at", "idf")).alias("rare"))
    each = (blocks.repartition(2 * n, "block") if n else blocks).join(known, "block")
    parts = parts.drop("n", "length")
    if queries <= BROADCAST_ROWS // 8:
        pairs = parts.crossJoin(F.broadcast(each))
    else:  # a task for each block and share of the parts; fewer shares if there are many blocks, since each sends k rows a query
        wide = parts.sparkSession.sparkContext.defaultParallelism
        pairs = parts.coalesce(max(1, -(-4 * wide // n))).hint("shuffle_replicate_nl").crossJoin(each)
    kind = dict(blocks.dtypes)["names"][6:-1]

    def run(batches):
        begun: dict = {}
        for batch in batches:
            for at in range(batch.num_rows):
                name = batch["block"][at].as_py()
                if name not in begun:
                    begun[name] = _Block(*(batch[c][at].values for c in ("names", "widths", "words", "codes", "rare")), k)
                begun[name].add(*(batch[c][at].values for c in ("ids", "lengths", "terms", "sizes", "docs", "tf")), mean)
        for block in begun.values():
            yield block.hits()

    return pairs.mapInArrow(run, f"query_id {kind}, id long, score double, matched long, n_terms long")


def _spread(n: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of runs of ``n`` places from ``first`` on: the run and the place of each."""
    each = np.repeat(np.arange(len(n)), n)
    return each, np.arange(len(each)) + np.repeat(first - (np.cumsum(n) - n), n)


class _Entries:
    """Terms of queries, in the order of queries."""

    def __init__(self, query: np.ndarray, term: np.ndarray, idf: np.ndarray, queries: int):
        self.term, self.idf, self.counts = term, idf, np.bincount(query, minlength=queries)
        self.starts = np.cumsum(self.counts) - self.counts

    def of(self, queries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The terms of some queries: the place in ``queries`` and the place here."""
        return _spread(self.counts[queries], self.starts[queries])


class _Block:
    """A block of queries as terms with their queries, and the best documents so far."""

    def __init__(self, ids: pa.Array, sizes: pa.Array, terms: pa.Array, codes: pa.Array, rare: pa.StructArray, k: int):
        sizes, codes, at = (x.to_numpy(zero_copy_only=False) for x in (sizes, codes, rare.field("at")))
        self.names, self.n_terms, idf = ids, sizes.astype(np.int64), np.full(len(terms), np.nan)
        idf[at] = rare.field("idf").to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        known = ~np.isnan(idf[codes])  # a term of no document counts in n_terms only
        self.terms, self.k, self.queries, self.codes, self.idf = terms, k, owner[known], codes[known].astype(np.int64), idf[codes[known]]
        self.counts = np.bincount(self.codes, minlength=len(terms))
        self.best = Best(len(self.names), k, 4)

    def add(self, ids, lengths, terms, sizes, docs, tf, mean: float) -> None:
        """Scores a part. Terms that many documents and queries share are frequent: what they may add at most is known without scoring.

        Once a query has k documents, the other terms are counted up first, and the frequent ones only for documents that they can lift to the k best;
        before, and where they always could, they are multiplied as matrices.
        """
        ids, lengths, sizes, docs, tf = (x.to_numpy(zero_copy_only=False) for x in (ids, lengths, sizes, docs, tf))
        if not len(self.terms) or not len(sizes):
            return
        code = pc.fill_null(pc.index_in(terms, value_set=self.terms), -1).to_numpy(zero_copy_only=False)
        queries, share = len(self.names), tf * (C.BM25_K1 + 1) / (tf + C.BM25_K1 * (1 - C.BM25_B + C.BM25_B * lengths[docs] / mean))
        first = np.cumsum(sizes) - sizes
        place = np.full(len(self.terms), -1)  # of a term of the queries its place in the part
        place[code[code >= 0]] = np.nonzero(code >= 0)[0]
        weight = np.where(code >= 0, sizes * self.counts[code].astype(np.int64), 0)
        dense = weight > len(ids) * queries / DENSE
        if dense.sum() > MATRIX_TERMS:
            dense &= weight > np.partition(weight, -MATRIX_TERMS - 1)[-MATRIX_TERMS - 1]
        column = np.where(dense, np.cumsum(dense) - 1, -1)
        owner = np.repeat(np.arange(len(code)), sizes)  # of each posting its term
        big, width = dense[owner], int(dense.sum())
        left = np.zeros((len(ids), width))
        left[docs[big], column[owner[big]]] = share[big]
        here = np.nonzero(place[self.codes] >= 0)[0]
        query, term, idf = self.queries[here], place[self.codes[here]], self.idf[here]
        often = dense[term]
        lift = np.bincount(query[often], idf[often] * np.maximum.reduceat(share, first)[term[often]], queries)
        least = np.bincount(query, np.where(often, 0.0, idf * np.minimum.reduceat(share, first)[term]), queries)  # what a document with all terms has of the rare ones
        every = np.bincount(query, minlength=queries) == self.n_terms
        floor = self.best.least
        full = np.where(every, least, np.inf)
        bound = np.where(floor >= ALL_TERMS / 2, np.maximum(floor - ALL_TERMS - lift, full), np.minimum(floor - lift, full)) - 1e-6
        rare = _Entries(query[~often], term[~often], idf[~often], queries)
        frequent = _Entries(query[often], column[term[often]], idf[often], queries)
        hot = np.nonzero((bound <= 0) & (rare.counts + frequent.counts > 0))[0]
        cold = np.nonzero((bound > 0) & np.isfinite(bound) & (rare.counts > 0))[0]
        there, keys = (left > 0).astype(np.float32), owner * len(ids) + docs  # postings stand by term and document
        step = max(1, CELLS // len(ids))
        for a in range(0, len(hot), step):
            some = hot[a : a + step]
            right, named = np.zeros((width, len(some))), np.zeros((width, len(some)), np.float32)
            of, at = frequent.of(some)
            np.add.at(right, (frequent.term[at], of), frequent.idf[at])
            np.add.at(named, (frequent.term[at], of), 1)
            of, at = rare.of(some)
            each, posting = _spread(sizes[rare.term[at]], first[rare.term[at]])
            cell, shape = of[each] * len(ids) + docs[posting], (len(some), len(ids))
            score = (left @ right).T + np.bincount(cell, rare.idf[at][each] * share[posting], len(some) * len(ids)).reshape(shape)
            matched = (there @ named).T + np.bincount(cell, minlength=len(some) * len(ids)).reshape(shape)
            worth = np.where(matched > 0, score + np.where(matched == self.n_terms[some][:, None], ALL_TERMS, 0.0), -np.inf)
            kth = np.partition(worth, -self.k, 1)[:, -self.k] if len(ids) > self.k else np.full(len(some), -np.inf)
            row, doc = np.nonzero((worth >= np.maximum(kth, floor[some])[:, None] - 1e-6) & (matched > 0))
            self._put(some[row], score[row, doc], ids[doc], matched[row, doc].astype(np.int64))
        for a in range(0, len(cold), step):
            some = cold[a : a + step]
            of, at = rare.of(some)
            each, posting = _spread(sizes[rare.term[at]], first[rare.term[at]])
            score = np.bincount(of[each] * len(ids) + docs[posting], rare.idf[at][each] * share[posting], len(some) * len(ids)).reshape(len(some), len(ids))
            row, doc = np.nonzero(score >= bound[some][:, None])
            score = score[row, doc]
            of, at = frequent.of(some[row])
            score += np.bincount(of, frequent.idf[at] * left[doc[of], frequent.term[at]], len(row))
            able = np.where(floor[some] >= ALL_TERMS / 2, floor[some] - ALL_TERMS, np.minimum(floor[some], full[some]))  # a document with all terms may have less
            keep = score >= able[row] - 1e-6
            row, doc, score = row[keep], doc[keep], score[keep]
            of, at = frequent.of(some[row])
            matched = np.bincount(of, left[doc[of], frequent.term[at]] > 0, len(row))
            of, at = rare.of(some[row])
            sought = rare.term[at] * len(ids) + doc[of]
            found = keys[np.minimum(np.searchsorted(keys, sought), len(keys) - 1)] == sought
            matched = (matched + np.bincount(of, found, len(row))).astype(np.int64)
            self._put(some[row], score, ids[doc], matched)
        if self.best.size > 2 * self.k * queries:
            self.best.cut()

    def _put(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, matched: np.ndarray) -> None:
        worth = np.floor(score * 1e6 + 0.5) / 1e6 + np.where(matched == self.n_terms[query], ALL_TERMS, 0.0)
        some = worth >= self.best.least[query]
        self.best.put(query[some], worth[some], ids[some], matched[some])

    def hits(self) -> pa.RecordBatch:
        query, worth, ids, matched = self.best.cut()
        n_terms = self.n_terms[query]
        score = np.round(worth - np.where(matched == n_terms, ALL_TERMS, 0.0), 6)
        columns = [self.names.take(pa.array(query)), pa.array(ids.astype(np.int64)), pa.array(score), pa.array(matched), pa.array(n_terms)]
        return pa.RecordBatch.from_arrays(columns, ["query_id", "id", "score", "matched", "n_terms"])


def cosine(a: Column, b: Column) -> Column:
    """Dot product of two arrays, in double precision; vectors are expected to have length 1."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def _unit(arrays: pa.Array) -> np.ndarray:
    """Rows of a matrix from a column of arrays of one length."""
    flat = arrays.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
    return flat.reshape(len(arrays), -1) if len(arrays) else np.zeros((0, 0))


class Best:
    """The k best (score down, id up) of every query, of any number of scored blocks; holds a few times k for each query."""

    def __init__(self, queries: int, k: int, columns: int = 3):
        self.k, self.queries, self.columns, self.held = k, queries, columns, []
        self.least = np.full(queries, -np.inf)
        self.size = 0

    def add(self, ids: np.ndarray, scores: np.ndarray, owner: np.ndarray | None = None) -> None:
        """``scores`` has a column for each query, or for each of ``owner``."""
        least = self.least if owner is None else self.least[owner]
        row, column = np.nonzero(scores >= least)
        self.put(column if owner is None else owner[column], scores[row, column], ids[row])

    def put(self, *columns: np.ndarray) -> None:
        """Queries, scores, ids and further columns that stay with them."""
        self.held.append(columns)
        self.size += len(columns[0])
        if self.size > 4 * self.k * self.queries + 100_000:
            self.cut()

    def cut(self) -> tuple[np.ndarray, ...]:
        columns = [np.concatenate(x) for x in zip(*self.held)] if self.held else [np.zeros(0, np.float64 if i == 1 else np.int64) for i in range(self.columns)]
        order = np.lexsort((columns[2], -columns[1], columns[0]))
        columns = [x[order] for x in columns]
        place = np.arange(len(order)) - np.searchsorted(columns[0], columns[0])
        keep = place < self.k
        columns, place = tuple(x[keep] for x in columns), place[keep]
        self.least[columns[0][place == self.k - 1]] = columns[1][place == self.k - 1]
        self.held, self.size = [columns], len(place)
        return columns


def neighbours(vectors: DataFrame, queries: DataFrame, k: int = C.K_EACH, id_col: str = "vec_id", vector_col: str = "embedding", allowed: DataFrame | None = None) -> DataFrame:
    """(query_id, id, score, rank): the exact k nearest by cosine of every query (query_id, vector); ids are integers.

    The stated queries meet all vectors in blocks of ``QUERY_BLOCK``, whose matrix goes along with the function;
    rows and queries are multiplied as matrices, and a task keeps and sends the k best of each query. A filter
    (``allowed``: id) is applied before ranking, so k hits come back if there are k. Null vectors are left out.
    Scores are rounded once, to six places. Beyond some thousand queries, ``vector_index`` reads less.
    """
    pool = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).alias("v")).where("v IS NOT NULL")
    pool = pool if allowed is None else pool.join(allowed.select("id"), "id", "left_semi")
    asked = written(queries.where("vector is not null").select("query_id", "vector"), "queries")
    blocks = max(1, -(-asked.count() // QUERY_BLOCK))
    out = None
    for b in range(blocks):
        block = asked if blocks == 1 else asked.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b)
        best = _block(pool, block, k)
        out = best if out is None else out.unionByName(best)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _block(pool: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(query_id, id, score): of each task's rows of ``pool`` (id, v), the k best for each of a block of queries."""
    table = queries.toArrow()  # about QUERY_BLOCK rows
    names, matrix = table["query_id"].combine_chunks(), _unit(table["vector"].combine_chunks())

    def run(batches):
        best = Best(len(names), k)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                rows = batch.slice(at, 512)
                if len(names):
                    best.add(rows["id"].to_numpy(), np.round(_unit(rows["v"]) @ matrix.T, 6))
        query, score, ids = best.cut()
        yield pa.RecordBatch.from_arrays([names.take(pa.array(query)), pa.array(ids.astype(np.int64)), pa.array(score)], ["query_id", "id", "score"])

    return pool.select(F.col("id").cast("long").alias("id"), "v").mapInArrow(run, f"query_id {queries.schema['query_id'].dataType.simpleString()}, id long, score double")


def rank_fusion(rankings: DataFrame, boosts: DataFrame | None = None) -> DataFrame:
    """(query_id, id, rrf) from (query_id, id, rank, weight); ``boosts`` (query_id, id, factor) multiply the sum."""
    out = rankings.groupBy("query_id", "id").agg(F.sum(F.col("weight") / (C.RRF_K + F.col("rank"))).alias("rrf"))
    if boosts is None:
        return out
    return out.join(boosts, ["query_id", "id"], "left").select("query_id", "id", (F.col("rrf") * F.coalesce("factor", F.lit(1.0))).alias("rrf"))


def recency_factor(published: Column, as_of: str) -> Column:
    """1 for undated and new content, 5 % less for each year, 0.85 at least."""
    days = F.greatest(F.datediff(F.to_date(F.lit(as_of)), F.to_date(published)), F.lit(0))
    return F.when(published.isNull(), F.lit(1.0)).otherwise(F.greatest(F.lit(0.85), 1.0 - 0.05 * days / 365.25))


def usefulness_factor(net: Column, weight: float = 0.15, smooth: float = 3.0) -> Column:
    """1 plus or minus up to ``weight``, half of it at a net signal of ``smooth``."""
    magnitude = F.log2(1 + F.abs(net))
    return F.when(net.isNull() | (net == 0), F.lit(1.0)).otherwise(1.0 + weight * magnitude / (magnitude + F.log2(F.lit(1 + smooth))) * F.signum(net))


def fused(hits: DataFrame, as_of: str) -> DataFrame:
    """Adds ``fused`` and its factors to hits with rrf, trust, alternates (a count), published_at, net and on_focus."""
    trust = 1 + 0.5 * (F.coalesce("trust", F.lit(0.5)) - 0.5)
    corroboration = 1 + 0.15 * F.log2(1 + F.col("alternates"))
    recency, useful = recency_factor(F.col("published_at"), as_of), usefulness_factor(F.col("net"))
    focus = F.when(F.col("on_focus"), F.lit(1.0)).otherwise(F.lit(0.5))
    out = hits.withColumns({"trust_f": trust, "corroboration_f": corroboration, "recency_f": recency, "usefulness_f": useful, "focus_f": focus})
    return out.withColumn("fused", F.col("rrf") * F.col("trust_f") * F.col("corroboration_f") * F.col("recency_f") * F.col("usefulness_f") * F.col("focus_f"))


def collapsed(hits: DataFrame, bits: int = C.SIMHASH_BITS) -> DataFrame:
    """Near copies folded into the best-ranked hit: query_id, id, alternates.

    ``hits``: query_id, id, rank, mark (SimHash) and canonical (id or null). The greedy walk needs
    rank order, so each query's few dozen hits are one group.
    """
    kinds = dict(hits.dtypes)

    def walk(pdf):
        kept: list[list] = []
        for row in pdf.sort_values(["rank", "id"]).itertuples():
            for own in kept:
                if row.canonical == own[0] or bin((int(row.mark) ^ own[1]) & (2**64 - 1)).count("1") <= bits:
                    own[2].append(row.id)
                    break
            else:
                kept.append([row.id, int(row.mark), []])
        out = pdf.head(0)[["query_id", "id"]].copy()
        import pandas as pd

        rows = [(pdf["query_id"].iloc[0], i, alts) for i, _, alts in kept]
        return pd.DataFrame(rows, columns=["query_id", "id", "alternates"]) if rows else out.assign(alternates=[])

    return hits.select("query_id", "id", "rank", "mark", "canonical").groupBy("query_id").applyInPandas(walk, f"query_id {kinds['query_id']}, id {kinds['id']}, alternates array<{kinds['id']}>")


def reranked(hits: DataFrame, order: DataFrame) -> DataFrame:
    """Hits in a given order (query_id, id, place); hits that it leaves out follow in their old order."""
    out = hits.join(order, ["query_id", "id"], "left")
    by = Window.partitionBy("query_id").orderBy(F.col("place").asc_nulls_last(), "rank", "id")
    return out.withColumn("new_rank", F.row_number().over(by)).drop("place")


def best_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")
