"""Questions with reference answers, for measuring how well questions are bound."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FIELDS = ("question", "db_id", "evidence", "SQL", "difficulty")


def questions(spark: SparkSession, path: str) -> DataFrame:
    """(question, db_id, evidence, SQL, difficulty) of a JSON-lines file; fields that it lacks are null."""
    rows = spark.read.json(path)
    return rows.select(*((F.col(f) if f in rows.columns else F.lit(None)).cast("string").alias(f) for f in FIELDS))


def gold_parts(spark: SparkSession, sql: str) -> tuple[set[str], set[str]]:
    """(tables, columns) that a query names, from the tree of Spark's parser; both empty if it doesn't parse."""
    quoted: list[str] = []

    def plain(m: re.Match) -> str:
        quoted.append(m[1])
        return f"q__{len(quoted) - 1}"

    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parsePlan(re.sub("`([^`]+)`", plain, sql)).toString()
    except Exception:  # noqa: BLE001 - reference answers may be of another dialect
        return set(), set()
    named = lambda x: quoted[int(x[3:])] if x.startswith("q__") else x
    steps = set(re.findall(r"^\W*'([A-Z]\w+)", tree, re.M))
    names = {n.rsplit(".", 1)[-1] for n in re.findall(r"'(\w+(?:\.\w+)*)(?![\w(])", tree)} - steps
    return {named(t) for t in re.findall(r"'UnresolvedRelation \[(\w+)\]", tree)}, {named(n) for n in names}
