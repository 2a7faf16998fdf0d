"""From check outcomes to new claims."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..badges import setting

IDENTITY = ("subject", "check", "verifier", "result", "downgraded_from", "detail")


def downgrade(outcomes: DataFrame, config: Mapping[str, Mapping[str, bool]]) -> DataFrame:
    """A failure of a check that may not fail becomes inconclusive and says so."""
    held_back = (F.col("result") == "fail") & ~setting(config, "emit_fail", default=False)
    return outcomes.withColumn("downgraded_from", F.when(held_back, "fail").otherwise("")).withColumn(
        "result", F.when(held_back, "inconclusive").otherwise(F.col("result"))
    )


def unissued(outcomes: DataFrame, logged: DataFrame, identity: Sequence[str] = IDENTITY) -> DataFrame:
    """Claims not logged before, first occurrence of each; safe to run again."""
    first = outcomes.groupBy(*identity).agg(F.min("issued_at").alias("issued_at"))
    return first.join(logged.select(*identity).distinct(), list(identity), "left_anti")
