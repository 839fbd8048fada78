"""All registered queries of the library, by name, and the SQL that states each of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lodestar.plans import audits, derivations, extras, figures, ingestion, layers, relational, samples, scoring, screening, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**scoring.QUERIES, **derivations.QUERIES, **relational.QUERIES, **audits.QUERIES, **samples.QUERIES, **extras.QUERIES, **layers.QUERIES, **spatial.QUERIES, **ingestion.QUERIES, **screening.QUERIES, **figures.QUERIES}
ORACLES: dict[str, str] = {**scoring.ORACLES, **derivations.ORACLES, **relational.ORACLES, **audits.ORACLES, **samples.ORACLES, **extras.ORACLES, **layers.ORACLES, **spatial.ORACLES, **ingestion.ORACLES, **screening.ORACLES, **figures.ORACLES}


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of predictions by relation type, by difficulty and overall, in one pass."""
    return scoring.ev_accuracy(spark, sf_dir)
