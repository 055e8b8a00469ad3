"""All registered queries and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from triplewright.plans import answering, candidates, evaluation, graph, learning, ranking, relations, text
from triplewright.plans.base import Query

_GROUPS = (graph.group, text.group, ranking.group, evaluation.group, candidates.group, relations.group, answering.group, learning.group)

QUERIES: dict[str, Query] = {name: f for g in _GROUPS for name, f in g.queries.items()}
ORACLES: dict[str, str] = {name: sql for g in _GROUPS for name, sql in g.sql.items()}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of "which region is … in" for the nations, linked, looked up and named."""
    return graph.answer_region_questions(spark, sf_dir)
