"""Pages and question threads as documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions import fixed as C
from lodestone.operators.sources import classified
from lodestone.operators.understanding import host

#: Author roles by association, and question sites by host.
AUTHOR_ROLE = {"OWNER": "maintainer", "MEMBER": "maintainer", "COLLABORATOR": "maintainer", "CONTRIBUTOR": "contributor"}
QUESTION_SITES = {"stackoverflow.com": "stackoverflow", "serverfault.com": "serverfault", "superuser.com": "superuser", "askubuntu.com": "askubuntu", "mathoverflow.net": "mathoverflow"}


def author_role(association: Column) -> Column:
    pairs = [F.lit(x) for kv in AUTHOR_ROLE.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), F.upper(association)), F.lit("none"))


def code_languages(html: Column) -> Column:
    """Sorted languages that code classes name."""
    found = F.regexp_extract_all(F.coalesce(html, F.lit("")), F.lit(C.CODE_CLASS), F.lit(1))
    return F.array_sort(F.array_distinct(F.transform(found, lambda x: F.lower(x))))


def relevant(text: Column, keywords: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for k in keywords:
        out = out | F.lower(text).contains(k.lower())
    return out


def question_ref(url: Column) -> Column:
    """(site, question id) of a question URL, null for others."""
    at = host(url)
    pairs = [F.lit(x) for kv in QUESTION_SITES.items() for x in kv]
    sub = F.regexp_extract(at, r"^(.+)\.stackexchange\.com$", 1)
    site = F.coalesce(F.try_element_at(F.create_map(*pairs), at), F.when((sub != "") & ~sub.rlike(r"^meta(\.|$)"), sub))
    number = F.regexp_extract(F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit("")), r"^/(?:questions|q)/(\d+)", 1)
    return F.when(site.isNotNull() & (number != ""), F.struct(site.alias("site"), number.cast("long").alias("question")))


def threads(questions: DataFrame, answers: DataFrame, most: int = 4) -> DataFrame:
    """One text per question (question, title, body) with its best answers (question, answer, score, body)."""
    best = answers.withColumn("n", F.row_number().over(Window.partitionBy("question").orderBy(F.desc("score"), "answer"))).where(F.col("n") <= most)
    told = best.groupBy("question").agg(F.array_sort(F.collect_list(F.struct("n", "body"))).alias("a"))
    parts = F.concat(F.array(F.concat(F.lit("# "), "title"), F.col("body")), F.coalesce(F.transform("a", lambda x: F.concat(F.lit("## Answer "), x["n"], F.lit("\n\n"), x["body"])), F.array().cast("array<string>")))
    return questions.join(told, "question", "left").select("question", F.array_join(parts, "\n\n").alias("text"))


def prechecked(requests: DataFrame, most: int = 10) -> DataFrame:
    """Requested URLs (page_id, url) with ``verdict``: ok, duplicate, bad_scheme, blocked or over_limit."""
    rows = classified(requests).withColumns({"nth": F.row_number().over(Window.partitionBy("url").orderBy("page_id")), "place": F.row_number().over(Window.orderBy("page_id"))})  # one caller's request, a few URLs
    verdict = F.when(F.col("place") > most, "over_limit").when(~F.coalesce(F.col("url").rlike(r"(?i)^https?://"), F.lit(False)), "bad_scheme").when(F.col("nth") > 1, "duplicate").when(F.col("tier") == "blocked", "blocked").otherwise("ok")
    return rows.withColumn("verdict", verdict).drop("nth", "place")
