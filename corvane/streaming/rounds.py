"""Regression detection over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import rounds
from .approvals import run_to_end


def regressions_to_end(raw: DataFrame, state: DataFrame) -> DataFrame:
    """The state after all micro-batches of a stream of observations, each one an import. A key's latest
    round is kept in Spark's state store and only keys of the state are; a batch writes the keys whose
    latest round it has moved, and reads no other. What a round means for a key does not depend on
    the batches between, as a later round can only make it regress, so the table of marks is met once."""
    known = state.select(*rounds.KEY).distinct()
    latest = raw.select(*rounds.KEY, "round").join(known, rounds.KEY, "left_semi").groupBy(*rounds.KEY).agg(F.max("round").alias("round"))
    return rounds.regressions(run_to_end(latest, rounds.KEY), state).select(state.columns)
