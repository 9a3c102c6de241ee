"""What people say of events: signed annotations, and decisions of review."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# The closed vocabularies.
REVIEW_STATES = ("draft", "published", "retracted")
REVIEW_DECISIONS = ("confirmed", "dismissed", "escalated")


def _judged(rows: DataFrame, column: str, vocabulary: tuple[str, ...], events: DataFrame) -> DataFrame:
    known = rows.join(events.select(F.col("id").alias("event_id"), F.lit(True).alias("_known")).distinct(), "event_id", "left")
    bad = F.when(~F.coalesce(F.col(column).isin(*vocabulary), F.lit(False)), F.lit(f"{column} must be one of {', '.join(vocabulary)}")).when(F.col("_known").isNull(), "no event with this id")
    return known.withColumn("rejected", bad).drop("_known")


def annotated(annotations: DataFrame, new: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """annotations(event_id, author, body, review_state, written_at) with the new ones, and the new ones that are rejected, with
    the reason: an unknown state or an unknown event. Nothing is replaced."""
    columns = annotations.columns
    judged = _judged(new.withColumn("review_state", F.coalesce("review_state", F.lit("draft"))), "review_state", REVIEW_STATES, events)
    return annotations.unionByName(judged.where("rejected IS NULL").select(*columns)), judged.where("rejected IS NOT NULL")


def reviewed(events: DataFrame, decisions: DataFrame) -> tuple[DataFrame, DataFrame]:
    """events with reviewed_by, reviewed_at and review_decision of the latest of decisions(event_id, reviewed_by, decision,
    reviewed_at), and the decisions that are rejected. A review adds no annotation."""
    judged = _judged(decisions, "decision", REVIEW_DECISIONS, events)
    w = Window.partitionBy("event_id").orderBy(F.desc("reviewed_at"), "reviewed_by", "decision")
    last = judged.where("rejected IS NULL").withColumn("_n", F.row_number().over(w)).where("_n = 1").select(F.col("event_id").alias("id"), F.col("reviewed_by").alias("_by"), F.col("reviewed_at").alias("_at"), F.col("decision").alias("_decision"))
    told = events.join(last, "id", "left")
    new = {"reviewed_by": "_by", "reviewed_at": "_at", "review_decision": "_decision"}
    return told.select(*[F.coalesce(F.col(new[c]), F.col(c)).alias(c) if c in new else F.col(c) for c in events.columns]), judged.where("rejected IS NOT NULL")


def by_event(annotations: DataFrame) -> DataFrame:
    """Each event's annotations in the order of their writing: event_id, annotations."""
    item = F.struct("written_at", "author", "body", "review_state")
    return annotations.groupBy("event_id").agg(F.array_sort(F.collect_list(item)).alias("annotations"))
