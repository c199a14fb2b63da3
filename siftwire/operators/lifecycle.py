"""Counters of what becomes of items, taken on their way and not in a pass of their own."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, by: Observation | str, states: Mapping[str, Column]) -> DataFrame:
    """``rows`` as they are, with the number of rows in each state counted when they are computed.

    An Observation holds the counts after the first action of a batch; a name finds them in a stream's progress.
    """
    return rows.observe(by, *(F.count_if(F.coalesce(state, F.lit(False))).alias(name) for name, state in states.items()))


def of_summaries() -> dict[str, Column]:
    """States of enriched items: a model's summary, or the fallback."""
    rated = F.col("relevance_score").isNotNull()
    return {"SUMMARIZED": rated, "FAILED": ~rated}


def of_scores() -> dict[str, Column]:
    return {"SCORED": F.col("score").isNotNull()}


def of_decisions(kinds: Sequence[str]) -> dict[str, Column]:
    """States of the gate's decisions, one for each kind."""
    return {f"GATED:{kind}": F.col("decision") == kind for kind in kinds}


def of_digests() -> dict[str, Column]:
    """Items that a digest receives; their number when it is composed."""
    return {"RECEIVED": F.lit(True), "COMPOSED": F.lit(True)}
