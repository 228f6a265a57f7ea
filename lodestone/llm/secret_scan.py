r"""Secret scan with an incremental blob ledger.

Every text version is content-addressed by its SHA-256 (a blob). The ledger holds the
(blob, rule, version) pairs that were scanned, found or not; the findings hold spans by
blob. A scan takes each distinct blob once, however many paths have it, leaves out the
pairs the ledger has, and joins findings back to every path.

Texts are written once and stay where they are (``placed``). Rows are told apart by their hashes:
only hashes are grouped and held against the ledger, and a text is read again only if its blob is
unseen, at the one row that stands for it. A scan of known blobs moves and scans no text. A text
that a third of all rows share meets itself in a partial aggregation. Findings go back to rows by
a join with one line per blob with findings, whose other side adaptive execution can split. Span
positions come from running sums over the pieces between matches, in a window per blob and rule,
so the work is linear in the matches.

Everything is DataFrame expressions. Null text counts as empty. Rows may repeat: each gets
the findings of its text. Offsets are code points, end exclusive. A path column with the name of a
column of the result comes out with ``path_`` before its name.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestone.llm.placed import placed
from lodestone.llm.store import Steps, stored


@dataclass(frozen=True)
class Rule:
    """``kind`` is found by ``pattern``; a match counts if its capture ``group`` has ``least`` characters or more.

    A match that does not count still uses up its text. Where a pattern takes whole runs of one
    character class, the least length can stand in the pattern: what begins later in too short a
    run is shorter still.
    """

    kind: str
    version: int
    pattern: str
    group: int
    least: int


#: The base rules, in the order in which kinds at one start are listed.
RULES = (
    Rule("assign", 1, r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]{16,}", 0, 20),
    Rule("hex", 1, r"[0-9a-f]{24,}", 0, 24),
)
#: What a text must hold for a rule to be tried at all; a cheap test that loses no match that counts.
_HINTS = {"assign": r"(?i)passw|secret|token|api_?key"}

LEDGER = "blob binary, rule string, version int"
FINDINGS = "blob binary, rule string, version int, start long, end long"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def unseen_blobs(hashes: DataFrame, rules: tuple[Rule, ...], ledger: DataFrame | None) -> DataFrame:
    """(row, blob, todo) of blobs that the ledger does not have for some of the rules, at the first of their rows; ``hashes``: row and blob."""
    blobs = hashes.groupBy("blob").agg(F.min("row").alias("row"))
    wanted = F.array(*(F.lit(f"{r.kind}:{r.version}") for r in rules))
    if ledger is None:
        return blobs.withColumn("todo", wanted)
    seen = ledger.groupBy("blob").agg(F.collect_set(F.concat_ws(":", "rule", "version")).alias("seen"))  # at most one entry for each rule version
    todo = F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))
    return blobs.join(seen, "blob", "left").withColumn("todo", todo).where(F.size("todo") > 0).select("blob", "row", "todo")


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings (blob, rule, version, start, end) of the rules that each blob still needs."""
    tried = []
    for r in rules:
        need = F.array_contains("todo", f"{r.kind}:{r.version}")
        if r.kind in _HINTS:
            need = need & F.col("text").rlike(_HINTS[r.kind])
        whole = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(0))
        part = F.regexp_extract_all("text", F.lit(r.pattern), F.lit(r.group)) if r.group else whole
        gaps = F.split("text", r.pattern, -1)
        cut = F.transform(F.arrays_zip(whole.alias("w"), part.alias("p"), F.slice(gaps, 1, F.size(whole)).alias("g")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("len"), (F.length(x["p"]) >= r.least).alias("good")))
        tried.append(F.struct(F.lit(r.kind).alias("rule"), F.lit(r.version).alias("version"), F.when(need, cut).alias("cuts")))
    rows = blobs.select("blob", F.explode(F.array(*tried)).alias("t")).select("blob", "t.rule", "t.version", F.posexplode("t.cuts").alias("at", "cut"))
    before = Window.partitionBy("blob", "rule", "version").orderBy("at")
    end = F.sum(F.col("cut.gap") + F.col("cut.len")).over(before.rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("end", end.cast("long")).where("cut.good").select("blob", "rule", "version", (F.col("end") - F.col("cut.len")).alias("start"), "end")


def by_blob(findings: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """One row per blob with findings: a count per kind and all spans in order of start, then kind as listed."""
    place = F.coalesce(*(F.when(F.col("rule") == r.kind, F.lit(i)) for i, r in enumerate(rules)))
    spans = F.sort_array(F.collect_list(F.struct(F.col("start"), place.alias("place"), F.col("end"), F.col("rule"))))
    counts = [F.count_if(F.col("rule") == r.kind).alias(f"n_{r.kind}") for r in rules]
    return findings.groupBy("blob").agg(spans.alias("spans"), *counts)


def spans_text(spans: Column, kinds: tuple[str, ...] | None = None) -> Column:
    """``kind:start:end`` of spans (of the given kinds), comma-joined."""
    kept = spans if kinds is None else F.filter(spans, lambda s: s["rule"].isin(*kinds))
    return F.array_join(F.transform(kept, lambda s: F.concat_ws(":", s["rule"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan(docs: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None, findings: DataFrame | None = None, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(every path with its findings, new ledger rows, new findings), each a table in the shared folder.

    ``ledger`` and ``findings`` are those of earlier scans; findings of other rule versions are left out.
    """
    steps = Steps()
    keyed = placed(docs.select(*(F.col(f"`{c}`").alias(f"_p{i}") for i, c in enumerate(path_cols)), F.coalesce(F.col(text_col), F.lit("")).alias("text")))
    hashes = steps(keyed.df.select("row", blob_of(F.col("text")).alias("blob")), "hashes")
    todo = steps(unseen_blobs(hashes, rules, ledger), "todo")
    unseen = keyed.view(text="text").beside(keyed.per_row(todo, F.first("blob").alias("blob"), F.first("todo").alias("todo")))
    new = stored(scan_blobs(unseen.select("blob", "text", "todo"), rules), "findings").df
    kinds = todo.select("blob", F.explode("todo").alias("t"))
    pairs = stored(kinds.select("blob", F.substring_index("t", ":", 1).alias("rule"), F.substring_index("t", ":", -1).cast("int").alias("version")), "pairs").df
    current = new
    if findings is not None:
        live = F.concat_ws(":", "rule", "version").isin(*(f"{r.kind}:{r.version}" for r in rules))
        current = findings.where(live).unionByName(new).distinct()
    found = steps(by_blob(current, rules), "found")  # a table of its own, so that the join's other side can be split
    names = [f"n_{r.kind}" for r in rules]
    rows = hashes.join(found, "blob").select("row", F.struct(*names, "spans").alias("found"))
    lines = keyed.per_row(rows, F.first("found").alias("found"))
    paths = keyed.view(**{f"_p{i}": f"_p{i}" for i in range(len(path_cols))}).beside(keyed.per_row(hashes, F.first("blob").alias("blob")))
    paths = paths.join(lines.hint("shuffle_hash"), ["part", "row"], "left")
    none = F.array().cast(found.schema["spans"].dataType)
    joined = paths.select(
        *(F.col(f"_p{i}").alias(f"path_{c}" if c in (*names, "blob", "spans") else c) for i, c in enumerate(path_cols)),
        "blob",
        *(F.coalesce(F.col(f"found.{n}"), F.lit(0)).cast("long").alias(n) for n in names),
        F.coalesce("found.spans", none).alias("spans"),
    )
    joined = stored(joined, "paths").df
    steps.drop()
    keyed.drop()
    return joined, pairs, new


class Ledger:
    """A ledger kept as Parquet under one folder, grown by each ``update``."""

    def __init__(self, spark: SparkSession, path: str, rules: tuple[Rule, ...] = RULES):
        self.spark, self.path, self.rules = spark, path.rstrip("/"), rules

    def _read(self, name: str, schema: str) -> DataFrame:
        empty = self.spark.createDataFrame([], schema)
        at = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        there = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{name}") if there else empty

    def update(self, docs: DataFrame, path_cols: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
        """Scan what is unseen, add it to the ledger, and return all paths with their findings.

        Findings are added before ledger rows. A run that dies between the two leaves findings
        without ledger rows; the next run scans those blobs again, and repeated findings count once.
        """
        paths, pairs, new = scan(docs, self.rules, self._read("ledger", LEDGER), self._read("findings", FINDINGS), path_cols, text_col)
        new.write.mode("append").parquet(f"{self.path}/findings")
        pairs.write.mode("append").parquet(f"{self.path}/ledger")
        return paths
