"""Research runs: a plan of sub-questions, a loop that follows gaps and disputes, runs kept as rows, structured output."""

from __future__ import annotations

import time
import uuid
from collections import deque
from collections.abc import Callable
from dataclasses import asdict, dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions import fixed as C
from lodestone.operators.ranking import best_per

#: Limits of a run.
MOST_STEPS, MOST_SECONDS, LEAST_CLAIMS, LOW_CONFIDENCE, MOST_CHASES, ALIKE, MOST_SUB_QUESTIONS = 8, 30.0, 2, 0.45, 3, 0.85, 6
#: Axes of a comparison.
AXES = ("performance", "reliability and durability", "features and capabilities", "operational complexity", "ecosystem and tooling")


def plan(core: str, names: list[str], kind: str) -> dict:
    """Sub-questions by intent, and where answers are likely; the choice of a comparison rests on all of its axes."""
    between = kind == "comparison" and len(names) > 1
    if between:
        each, choice = C.PLAN_QUESTIONS["comparison"]
        asks = [each.format(a=names[0], b=names[1], axis=axis) for axis in AXES[:3]] + [choice.format(a=names[0], b=names[1])]
    else:
        templates = C.PLAN_QUESTIONS["why" if kind == "comparison" else kind] if kind in C.PLAN_QUESTIONS else C.PLAN_QUESTIONS["why"]
        asks = [t.format(core=core, head=names[0] if names else core) for t in templates]
    rests = {len(asks): list(range(1, len(asks)))} if between else {}
    return {"sub_questions": backward([{"question": q, "depends_on": rests.get(i, [])} for i, q in enumerate(asks, 1)]), "targets": list(C.BOOSTS.get(kind, {})) or ["docs", "blog", "so_answer", "github_issue"]}


def backward(raw: list, most: int = MOST_SUB_QUESTIONS) -> list[dict]:
    """Numbered sub-questions; only references to earlier ones stay."""
    asked = [x if isinstance(x, dict) else {"question": x} for x in raw if isinstance(x, (dict, str))]
    asked = [x for x in asked if isinstance(x.get("question"), str) and x["question"].strip()][:most]
    return [{"id": i, "question": x["question"].strip(), "depends_on": sorted({d for d in x.get("depends_on") or [] if isinstance(d, int) and 0 < d < i})} for i, x in enumerate(asked, 1)]


def alike(a: str, b: str) -> float:
    x, y = set(a.lower().split()), set(b.lower().split())
    return len(x & y) / len(x | y) if x and y else 0.0


@dataclass
class Run:
    question: str
    run_id: str = field(default_factory=lambda: uuid.uuid4().hex)
    status: str = "running"
    steps: list[dict] = field(default_factory=list)
    claims: dict = field(default_factory=dict)


def loop(run: Run, questions: list[str], answer: Callable[[str], list[dict]], rephrase: Callable[[str], list[str]], steps: int = MOST_STEPS, seconds: float = MOST_SECONDS) -> Run:
    """Ask in order under a budget of steps and time; ``answer`` gives claims (key, text, confidence, disputed).

    A step with few or unsure claims adds a rewording not asked yet; a disputed claim adds a
    question about it, a few times; what was asked before, or nearly so, is not asked again.
    """
    queue, began, chases = deque((q, "plan") for q in questions), time.monotonic(), 0
    while queue and len(run.steps) < steps and time.monotonic() - began < seconds:
        q, why = queue.popleft()
        asked = [s["query"] for s in run.steps]
        if any(q.lower() == a.lower() or (why != "plan" and alike(q, a) >= ALIKE) for a in asked):
            continue
        found = answer(q)
        run.steps.append({"query": q, "why": why, "claims": len(found)})
        run.claims |= {c["key"]: c for c in found}
        if len(found) < LEAST_CLAIMS or max((c["confidence"] or 0.0 for c in found), default=0.0) < LOW_CONFIDENCE:
            other = next((v for v in rephrase(q) if all(v.lower() != a.lower() for a in [*asked, q])), None)
            if other:
                queue.append((other, "gap"))
        for c in found:
            if c["disputed"] and chases < MOST_CHASES:
                chases += 1
                queue.append((f"evidence against: {c['text']}", "dispute"))
    run.status = "partial" if queue else "done"
    return run


RUNS = "run_id string, question string, status string, at timestamp, steps int, claims int"


def save(spark: SparkSession, run: Run, path: str) -> None:
    """Append the state of a run; reading takes the last one."""
    row = (run.run_id, run.question, run.status, len(run.steps), len(run.claims))
    spark.createDataFrame([row], "run_id string, question string, status string, steps int, claims int").withColumn("at", F.current_timestamp()).write.mode("append").parquet(path)


def runs(spark: SparkSession, path: str) -> DataFrame:
    return best_per(spark.read.schema(RUNS).parquet(path), ["run_id"], F.desc("at"), F.desc("steps"))


def fill(schema: dict, findings: list[str], least: float = 0.6) -> dict:
    """A caller's JSON schema filled from findings: each leaf takes the finding that shares most words with its name, or null."""

    def best(name: str):
        words = set(name.replace("_", " ").lower().split())
        share = lambda f: len(words & set(f.lower().split())) / max(len(words), 1)
        top = max(findings, key=share, default=None)
        return top if top is not None and share(top) >= least else None

    def walk(node: dict, name: str):
        if node.get("type") == "object":
            return {k: walk(v, k) for k, v in (node.get("properties") or {}).items()}
        if node.get("type") == "array":
            one = walk(node.get("items") or {}, name)
            return [] if one is None else [one]
        return best(name) if node.get("type") == "string" else None

    return walk(schema, "")


def as_dict(run: Run) -> dict:
    return asdict(run)
