"""Parse interpretations as they arrive.

The parsers are projections without state, so they run unchanged on a
streaming DataFrame; delivery guarantees come from the sink's checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from whyframe.operators.interpretations import long_groups, parse_interpretations


def parse_stream(questions: DataFrame, columns: list[str], path: str, checkpoint: str, keys: list[str]) -> StreamingQuery:
    """Append ``(keys, group_idx, pos, feature, value)`` rows to a table of files, then stop when input is used up."""
    parsed = long_groups(parse_interpretations(questions, columns), keys)
    return (
        parsed.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
