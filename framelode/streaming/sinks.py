"""Sinks of streams that a replay leaves as they are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Decisions that a review may hold: fixed values.
DECISIONS = ("correct", "incorrect", "unresolved")
#: What a review is bound to; all of it must be as it is now.
BOUND = ("run_id", "run_manifest_sha256", "frame_index", "frame_record_sha256", "gallery_index", "view", "selected_image")


def judged_reviews(events: DataFrame, bindings: DataFrame) -> DataFrame:
    """events (BOUND, decision, reviewer, notes) with review_id, trimmed reviewer and notes, and reason.

    The first reason counts: a decision that isn't one, no reviewer, or a binding that isn't that of the run's gallery as it
    is (run, frame record, place in the gallery, view and image). Null: the review holds. review_id follows from the event,
    so that an event that comes again has the same.
    """
    now = bindings.select(*(F.col(c).alias(f"_{c}") for c in BOUND))
    met = (F.col("run_id") == F.col("_run_id")) & (F.col("gallery_index") == F.col("_gallery_index"))
    both = events.join(now, met, "left")
    same = F.lit(True)
    for c in BOUND:
        same &= F.col(c).eqNullSafe(F.col(f"_{c}"))
    reviewer = F.trim(F.coalesce("reviewer", F.lit("")))
    reason = F.when(~F.coalesce(F.col("decision").isin(*DECISIONS), F.lit(False)), "unsupported decision").when(reviewer == "", "reviewer missing").when(~same, "stale binding")
    identity = F.sha2(F.to_json(F.struct(*BOUND, "decision", "reviewer", "notes")), 256)
    return both.select(identity.alias("review_id"), *BOUND, "decision", reviewer.alias("reviewer"), F.trim(F.coalesce("notes", F.lit(""))).alias("notes"), reason.alias("reason"))


def append_once(stream: DataFrame, folder: str, checkpoint: str, by: str | None = None) -> None:
    """Append all that a stream has now to JSON lines below folder, each micro-batch exactly once.

    A batch is written under its number. If the same number comes again (the run broke off between the write and the commit,
    or the checkpoint was lost and the source is replayed) its lines take the place of those that are there; a batch that
    broke off half-way leaves none behind. by: a column that parts each batch into folders.
    """

    def write(batch: DataFrame, number: int) -> None:
        out = batch.coalesce(8).write.mode("overwrite")
        (out.partitionBy(by) if by else out).json(f"{folder}/batch={number:08d}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
