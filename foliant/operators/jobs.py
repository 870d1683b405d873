"""Document state as an append-only log of events, and the transitions that are allowed.

events: event_id, doc_id, ts, op, payload. The current row of a document is its latest event;
a delete is a tombstone. All rules are set-based over the log, so that a batch of requests is
one plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINISHED = ("done", "failed")


def current(events: DataFrame) -> DataFrame:
    """doc_id, status, since, n_events: the state after the last event; deleted documents are gone."""
    last = events.groupBy("doc_id").agg(F.max_by(F.struct("op", "ts"), F.struct("ts", "event_id")).alias("e"), F.count("*").alias("n_events"))
    return last.filter("e.op <> 'deleted'").select("doc_id", F.col("e.op").alias("status"), F.col("e.ts").alias("since"), "n_events")


def requeue(state: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """doc_id, queued: which of the asked documents (all, without ids) may start again."""
    asked = state if ids is None else state.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return asked.select("doc_id", F.col("status").isin(*FINISHED).alias("queued"))


def recover(state: DataFrame) -> DataFrame:
    """After a restart: half-imported documents fail, other unfinished ones wait again."""
    return state.withColumn("status", F.when(F.col("status") == "importing", "failed").when(~F.col("status").isin("done", "failed"), "queued").otherwise(F.col("status")))


def cascade_delete(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows (with doc_id) that remain when these documents are deleted; unknown and repeated ids don't matter."""
    return rows.join(ids.select("doc_id").distinct(), "doc_id", "left_anti")


def progress_floor(reports: DataFrame) -> DataFrame:
    """reports: doc_id, at, frac -> shown: never less than before."""
    so_far = Window.partitionBy("doc_id").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    return reports.withColumn("shown", F.max("frac").over(so_far))


def still_running(results: DataFrame, state: DataFrame) -> DataFrame:
    """Results whose document still runs; others were requeued or deleted meanwhile."""
    return results.join(state.filter("status = 'running'").select("doc_id"), "doc_id", "left_semi")


def summary_queued(state: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """state: doc_id, status, summary -> doc_id of those asked (all, without ids) whose summary is to be made: only parsed documents."""
    asked = state if ids is None else state.join(ids.select("doc_id").distinct(), "doc_id", "left_semi")
    return asked.filter("status = 'done'").select("doc_id")


def recover_summaries(state: DataFrame) -> DataFrame:
    """After a restart summaries that were being written wait again."""
    return state.withColumn("summary", F.when(F.col("summary") == "running", "queued").otherwise(F.col("summary")))


def changed(state: DataFrame, changes: DataFrame, stamp) -> tuple[DataFrame, DataFrame]:
    """changes: doc_id and some of state's columns, null where nothing changes. The state with them and the time of change (updated_at), and doc_id, exists for each change."""
    names = [c for c in changes.columns if c != "doc_id"]
    new = changes.select("doc_id", *[F.col(c).alias(f"_{c}") for c in names], F.lit(True).alias("_hit"))
    rows = state.join(new, "doc_id", "left")
    kept = [c for c in state.columns if c not in (*names, "updated_at")]
    old = F.col("updated_at") if "updated_at" in state.columns else F.lit(None)
    after = rows.select(*kept, *[F.coalesce(f"_{c}", c).alias(c) for c in names], F.when(F.col("_hit"), stamp).otherwise(old).alias("updated_at"))
    known = state.select("doc_id", F.lit(True).alias("_known"))
    return after, changes.select("doc_id").join(known, "doc_id", "left").select("doc_id", F.coalesce("_known", F.lit(False)).alias("exists"))
