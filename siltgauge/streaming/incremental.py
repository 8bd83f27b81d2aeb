"""The stateless rules over a stream of fact rows; beyond what batch parity asks for.

Coupling, dead weight and clones look at the whole corpus and have no streaming form here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.rules import run_rules
from ..thresholds import NORMAL, Limits


def stream_rules(facts: DataFrame, sink: str, checkpoint: str, limits: Limits = NORMAL) -> StreamingQuery:
    """Findings of all rows that have arrived, appended as Parquet; ends when nothing is left."""
    return run_rules(facts, limits).writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
