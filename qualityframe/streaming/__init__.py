"""Streaming use of the row-local operators.

The reference is batch-only. Nothing here adds an operator: ``item_facts`` (rule
classification) is a pure projection and the daily trend (Q4) is a tumbling one-day
bucket, so both run unchanged on a Structured Streaming DataFrame. ``daily_trend_stream``
adds the watermark that lets Spark finalise a day and drop its state.
"""

from qualityframe.streaming.incremental import daily_trend_stream, read_table_stream

__all__ = ["daily_trend_stream", "read_table_stream"]
