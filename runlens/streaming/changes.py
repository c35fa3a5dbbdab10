"""Streaming snapshot diff, reply classification and ledger append."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from runlens.functions import fixed_values as fv
from runlens.functions.text import ReplyRules, reply_verdict
from runlens.operators.listings import snapshot_diff
from runlens.session import checkpoint_location
from runlens.sources.sinks import write_ledger_batch
from runlens.sources.traces import reply_text


def stream_changes(listings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Files of each incoming listing that are new, grown or touched against a kept baseline."""
    return snapshot_diff(listings, baseline).where(F.col("change_kind") != "same")


def stream_replies(events: DataFrame, rules: ReplyRules = ReplyRules()) -> DataFrame:
    """Stopping replies of the main agent with their verdict; a stateless map."""
    stop = (
        (F.col("agent_role") == fv.MAIN_ROLE)
        & (F.col("event") == fv.MODEL_OUTPUT)
        & (F.col("stop_reason") == fv.TERMINAL_REASONS[0])
    )
    return events.where(stop).withColumn("reply", reply_text(F.col("content"))).where(
        F.col("reply").isNotNull()
    ).withColumn("verdict", reply_verdict(F.col("reply"), rules))


def start_ledger(runs: DataFrame, path: str, checkpoint: str | None = None, **trigger) -> StreamingQuery:
    """Append a stream of finished runs to the ledger, exactly once per micro-batch."""
    return (
        runs.writeStream.foreachBatch(lambda df, batch_id: write_ledger_batch(df, batch_id, path))
        .option("checkpointLocation", checkpoint or checkpoint_location(runs.sparkSession, "ledger"))
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
