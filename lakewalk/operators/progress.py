"""Progress of a running write: totals that Spark counts along the way, without another pass."""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def observed(rows: DataFrame, name: str) -> tuple[DataFrame, Observation]:
    """``rows`` to be written in place of the original, and where their number and bytes are found afterwards. A task that
    is tried again may count twice; use ``profile.summary`` for exact figures."""
    observation = Observation(name)
    size = F.coalesce(F.sum("size"), F.lit(0)) if "size" in rows.columns else F.lit(0)
    return rows.observe(observation, F.count(F.lit(1)).alias("entries"), size.alias("bytes")), observation
