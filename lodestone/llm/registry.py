"""Queries of the training-data operators and the SQL for those that SQL can express."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import chat_format, decontaminate, exact_dedup, language_id, line_dedup, mixing, ngram_join, packing, prefix_trie, quality, resample, secret_scan, substring_dedup
from lodestone.session import load, shared_dir


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    base = tuple(r.kind for r in secret_scan.RULES)
    ledger = secret_scan.Ledger(spark, f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}")  # one that has seen nothing
    return ledger.update(docs).select(
        "doc_id",
        "n_assign",
        "n_access",
        "n_hex",
        F.sha2(secret_scan.spans_text(F.col("spans"), base), 256).alias("base_sha256"),
        secret_scan.spans_text(F.col("spans")).alias("spans"),
    )


def _fold(of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; null for a null id."""
    return F.crc32(F.col("doc_id").cast("string")) % of


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = language_id.train(docs.where(_fold(5) != 0))
    held_out = F.coalesce(_fold(5) == 0, F.lit(False))
    return language_id.predict(docs, model, keep=(F.col("doc_id"), held_out), names=("doc_id", "held_out"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.near_duplicates(load(spark, sf_dir, "documents"), k=4, percent=85)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    model = quality.train(docs, load(spark, sf_dir, "labels").where(_fold(3) != 1))
    held_out = F.coalesce(_fold(3) == 1, F.lit(False))
    return quality.score(docs, model, keep=(F.col("doc_id"), held_out), names=("doc_id", "held_out"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.remove_repeats(load(spark, sf_dir, "documents"), window=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(load(spark, sf_dir, "documents"), keep="max")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.remove_lines(load(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "</s>[INST] ok [/INST]"
    probe = spark.createDataFrame([(-1, 0, "user", text), (-1, 1, "assistant", text)], turns.schema)
    out = chat_format.format_chats(turns.unionByName(probe))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("turns"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = decontaminate.find_leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "first_word", F.round("similarity", 6).alias("similarity"))


def op10_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.mix(load(spark, sf_dir, "documents"))
    out = plan.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken", F.round("position", 6).alias("position"))
    return out.repartitionByRange("position", "doc_id").sortWithinPartitions("position", "doc_id")


def op11_importance_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"), percent=25, least_words=20, seed=7)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(load(spark, sf_dir, "conversations"))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(load(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def queries() -> dict:
    return {f.__name__: f for f in (op1_secret_scan, op2_language_id, op3_ngram_jaccard, op4_quality, op5_substring_dedup, op6_exact_dedup, op7_line_dedup, op8_chat_format, op9_decontaminate, op10_mix, op11_importance_resample, op12_prefix_trie, op13_packing)}


_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
k AS (
  SELECT doc_id, text, kind, place, pattern, grp, least FROM d, (VALUES
    ('assign', 0, '(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 1, 6),
    ('access', 1, '(AKIA[A-Z0-9]{16,})', 1, 20),
    ('hex', 2, '([0-9a-f]{24,})', 1, 24)) AS r(kind, place, pattern, grp, least)),
m AS (
  SELECT doc_id, kind, place, least, regexp_extract_all(text, pattern, 0) AS w, regexp_extract_all(text, pattern, 1) AS p,
         string_split_regex(text, pattern) AS g FROM k),
e AS (
  SELECT doc_id, kind, place, least, w[i] AS w, p[i] AS p,
         sum(length(g[i]) + length(w[i])) OVER (PARTITION BY doc_id, kind ORDER BY i) AS stop
  FROM m, unnest(range(1, len(w) + 1)) AS u(i)),
f AS (SELECT doc_id, kind, place, CAST(stop - length(w) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM e WHERE length(p) >= least),
s AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
         count(*) FILTER (kind = 'hex') AS n_hex,
         string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, place) AS spans FROM f GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN s ON d.doc_id = s.doc_id
"""

_OP6 = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
g AS (SELECT text, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.text) AS text_sha256
FROM d JOIN g ON d.text = g.text
"""

_OP8 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (
  SELECT *, regexp_matches(text, '\[/?INST\]|<</?SYS>>|</?s>|\\[blk]') AS esc,
    len(regexp_extract_all(text, '\[/?INST\]|<</?SYS>>|</?s>')) + (length(text) - length(replace(text, '\', ''))) AS more,
    CASE role WHEN 'user' THEN 15 WHEN 'assistant' THEN 9 ELSE 18 + length(role) END AS frame FROM t)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(text) + frame + CASE WHEN esc THEN more ELSE 0 END) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP10 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, 3 * source_size AS cap,
    [5, 2, 1][1 + CAST((row_number() OVER (ORDER BY source IS NULL, encode(source)) - 1) % 3 AS INT)] AS weight FROM s),
r AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, cap ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (ORDER BY cap / weight, cap ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
    row_number() OVER (ORDER BY cap / weight, cap) AS k FROM w),
l AS (SELECT arg_min(level, k) FILTER (cap >= level * weight) AS level FROM r),
t AS (SELECT w.*, least(CAST(cap AS DOUBLE), l.level * weight) AS target FROM w, l),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.weight,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5(coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    CASE WHEN t.source_size > 0 THEN CAST(floor(floor(t.target) / t.source_size) AS BIGINT) ELSE 0 END AS passes
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (
  SELECT *, CAST(passes * size + greatest(0, least(size, CAST(floor(target) AS BIGINT) - passes * source_size - before)) AS BIGINT) AS taken,
    CAST(before AS DOUBLE) / target AS y,
    CASE weight WHEN 5 THEN 1.5::DOUBLE WHEN 2 THEN 1.0::DOUBLE ELSE 0.5::DOUBLE END AS a,
    CASE weight WHEN 5 THEN -1.0::DOUBLE WHEN 2 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS b FROM o)
SELECT doc_id, size, source_size, target, taken,
  CASE WHEN taken > 0 THEN round(least(2.0::DOUBLE * y / (a + sqrt(a * a + 2 * b * y)), 1.0::DOUBLE), 6) END AS position
FROM k
"""

_OP11 = r"""
WITH words AS (
  SELECT doc_id, kind, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (SELECT doc_id, text, 's' AS kind FROM documents UNION ALL SELECT item_id, text, 't' FROM benchmark)),
runs AS (
  SELECT doc_id, kind, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM words),
bytes AS (SELECT f, hex(encode(f)) AS x FROM (SELECT DISTINCT f FROM runs)),
nibbles AS (
  SELECT f, list_transform(range(1, len(x) + 1), lambda i: CAST(instr('0123456789ABCDEF', x[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS UBIGINT)) AS n FROM bytes),
buckets AS (
  SELECT f, CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, n), lambda c, b: xor(c >> 4,
    ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
      3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::UBIGINT[])[CAST(xor(c, b) & 15 AS INT) + 1])), 4294967295::UBIGINT) % 10000 AS INT) AS bucket
  FROM nibbles),
sizes AS (
  SELECT bucket, count(*) FILTER (kind = 's') AS s, count(*) FILTER (kind = 't') AS t FROM runs JOIN buckets USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE))) AS BIGINT) AS gain FROM sizes),
weights AS (
  SELECT doc_id, count(*) AS n_features, CAST(floor(sum(gain)::DOUBLE / count(*)) AS BIGINT) AS weight
  FROM runs JOIN buckets USING (f) JOIN gains USING (bucket) WHERE kind = 's' GROUP BY doc_id),
drawn AS (
  SELECT doc_id, list_reduce(list_transform(range(1, 9), lambda i: CAST(instr('0123456789abcdef', sha256('7:' || doc_id)[i]) - 1 AS UBIGINT)), lambda a, b: a * 16 + b) AS h FROM documents),
scored AS (
  SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score
  FROM drawn d LEFT JOIN weights w ON d.doc_id = w.doc_id),
placed AS (
  SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS place, count(*) OVER () AS n FROM scored WHERE n_features >= 39)
SELECT s.doc_id, n_features, weight, score, CASE WHEN place <= 25 * n // 100 THEN place END AS rank
FROM scored s LEFT JOIN placed p ON s.doc_id = p.doc_id
"""

_OP12 = r"""
WITH t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS place, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base,
    CAST(xor(list_reduce(list_prepend(4294967295::UBIGINT, n), lambda c, b: xor(c >> 4,
      ([0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
        3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108]::UBIGINT[])[CAST(xor(c, b) & 15 AS INT) + 1])), 4294967295::UBIGINT) % 6 AS BIGINT) AS h
  FROM (SELECT conv_id, list_transform(range(1, 2 * length(CAST(conv_id AS VARCHAR)) + 1), lambda i: CAST(instr('0123456789ABCDEF',
      hex(encode(CAST(conv_id AS VARCHAR)))[CASE WHEN i % 2 = 1 THEN i + 1 ELSE i - 1 END]) - 1 AS UBIGINT)) AS n
    FROM (SELECT DISTINCT conv_id FROM t))),
r AS (
  SELECT c.conv_id, 0 AS own, place, role, text FROM c JOIN t ON t.conv_id = c.base WHERE place < h
  UNION ALL SELECT c.conv_id, 1, place, role, text FROM c JOIN t ON t.conv_id = c.conv_id WHERE place >= h),
p AS (
  SELECT conv_id, row_number() OVER w AS depth, length(text) AS chars, md5(string_agg(length(role) || ':' || length(text) || ':' || role || text, '') OVER w) AS node
  FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY own, place ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
  UNION ALL SELECT conv_id, 0, 0, '' FROM c),
q AS (
  SELECT *, lag(node) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM p),
n AS (
  SELECT depth, node, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, min(chars) AS chars,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM q GROUP BY depth, node),
k AS (SELECT depth - 1 AS depth, above, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY depth, above),
m AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN k ON k.depth = n.depth AND k.above = n.node),
s AS (
  SELECT q.depth, q.node, count(*) FILTER (m.n_children = 0) AS n_leaves, sum((m.n_convs - 1) * m.chars) AS saved_tokens
  FROM m JOIN q ON q.conv_id = m.conv_id AND q.depth <= m.depth GROUP BY q.depth, q.node)
SELECT m.conv_id, m.depth, a.conv_id AS parent_conv_id, m.n_convs, m.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (depth, node) LEFT JOIN m a ON a.depth = m.depth - 1 AND a.node = m.above
"""


def oracle_sql() -> dict:
    return {"op1_secret_scan": _OP1, "op6_exact_dedup": _OP6, "op8_chat_format": _OP8, "op10_mix": _OP10, "op11_importance_resample": _OP11, "op12_prefix_trie": _OP12}
