"""Named queries of the program-analysis engine and their SQL statements."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from ..operators import callgraph, cfg, chains, closures, conditions, lint, locks, objects, patches, paths, program, repairs, reports, syncgraph, values
from ..sources import facts
from .shared import SHARED


OPERATORS = (cfg, locks, program, paths, lint, syncgraph, chains, conditions, callgraph, values, patches, objects, closures, repairs, reports)


def _shared(text: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return facts.run_sql(spark, sf_dir, text)


def queries() -> dict:
    out: dict = {name: partial(_shared, text) for name, (_, text) in SHARED.items()}
    for module in OPERATORS:
        out |= module.QUERIES
    return out


def oracle_sql() -> dict[str, str]:
    out = {name: facts.duck_sql(text) for name, (_, text) in SHARED.items()}
    for module in OPERATORS:
        out |= module.SQL
    return out
