"""All queries of the engine itself, with the DuckDB SQL that each is compared with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from glimmer.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "flagship"]


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["rel_identity_union"](spark, sf_dir)
