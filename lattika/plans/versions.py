"""Staged versions of a set of files: diff, merge, publish, roll back."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattika.operators.hashing import ordered_hash
from lattika.operators.merging import last_writer_wins, semantic_diff


def root_hashes(files: DataFrame, *keys: str) -> DataFrame:
    """keys, root_hash: a hash of the sorted `path:hash` lines of each version."""
    lines = files.select(*keys, F.concat("path", F.lit(":"), "hash", F.lit("\n")).alias("line"))
    return ordered_hash(lines, list(keys), ["line"], F.col("line").cast("binary")).withColumnRenamed("hash", "root_hash")


def stage_status(stages: DataFrame, active: DataFrame) -> DataFrame:
    """stages with is_current (the active revision is theirs) and is_stale (a draft whose base is no longer active). active: one row per app."""
    now = active.select("appKey", F.col("graphRevision").alias("__revision"), F.col("rootHash").alias("__root"))
    joined = stages.join(now, "appKey", "left")
    stale = (F.col("status") == "draft") & ~F.col("baseRootHash").eqNullSafe(F.col("__root"))
    return joined.withColumn("is_current", F.col("graphRevision").eqNullSafe(F.col("__revision")) & F.col("__revision").isNotNull()).withColumn("is_stale", stale).drop("__revision", "__root")


def merge_stages(stage_files: DataFrame, active: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(files, conflicts) of several stages over the active files: path, hash, stageId.

    Files equal to the active ones are no writes. Of several writes to a path the latest wins; each change of what was
    written before is a conflict.
    """
    old = active.select("path", F.col("hash").alias("__old"))
    writes = stage_files.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("__old"))).drop("__old")
    winners, conflicts = last_writer_wins(writes, "path", "hash", "createdAt", "pos")
    untouched = active.select("path", "hash").join(winners.select("path"), "path", "left_anti").withColumn("stageId", F.lit(None).cast("string"))
    return untouched.unionByName(winners.select("path", "hash", "stageId")), conflicts


def publishable(stages: DataFrame, active: DataFrame) -> DataFrame:
    """stage, ok, reason: a draft that is valid and whose base is what is active now."""
    known = stage_status(stages, active)
    reason = F.when(F.col("status") != "draft", "not a draft").when(~F.col("valid"), "invalid").when(F.col("is_stale"), "base has changed")
    return known.select("stageId", reason.isNull().alias("ok"), reason.alias("reason"))


def publish(stages: DataFrame, active: DataFrame, stage_id: str) -> DataFrame:
    """stages after a publication: the stage is published, the one published before is archived; unchanged where it may not be."""
    ok = publishable(stages.where(F.col("stageId") == stage_id), active).where("ok").select(F.lit(True).alias("__ok"))
    app = stages.where(F.col("stageId") == stage_id).select(F.col("appKey").alias("__app"))
    gate = F.broadcast(app.crossJoin(ok))  # one row at most: a stage id is unique
    joined = stages.join(gate, F.col("appKey") == F.col("__app"), "left")
    status = F.when(F.col("__ok") & (F.col("stageId") == stage_id), "published").when(F.col("__ok") & (F.col("status") == "published"), "archived").otherwise(F.col("status"))
    return joined.withColumn("status", status).drop("__ok", "__app")


def archived(stages: DataFrame, stage_id: str, now: str) -> tuple[DataFrame, DataFrame]:
    """(stages, refused): a published stage is archived at a time; a stage of another status is refused."""
    asked = F.col("stageId") == stage_id
    fits = asked & (F.col("status") == "published")
    out = stages.withColumn("archivedAt", F.when(fits, F.lit(now)).otherwise(F.col("archivedAt"))).withColumn("status", F.when(fits, "archived").otherwise(F.col("status")))
    return out, stages.where(asked & ~F.coalesce(F.col("status") == "published", F.lit(False)))


def deleted(stages: DataFrame, stage_id: str) -> tuple[DataFrame, DataFrame]:
    """(stages, refused): a draft goes; a stage of another status stays and is refused."""
    asked, draft = F.col("stageId") == stage_id, F.coalesce(F.col("status") == "draft", F.lit(False))
    return stages.where(~F.coalesce(asked, F.lit(False)) | ~draft), stages.where(asked & ~draft)


def rollback(versions: DataFrame, to: str, new: str) -> DataFrame:
    """Files (stageId, path, hash) of a new version that repeats an old one."""
    return versions.where(F.col("stageId") == to).withColumn("stageId", F.lit(new))


def changes(active: DataFrame, staged: DataFrame) -> DataFrame:
    """Added and updated files of a stage, and one row for its manifest, whether or not the stage holds files."""
    manifest = staged.sparkSession.range(1).select(F.lit("manifest").alias("path"), F.lit("update").alias("change"))
    return semantic_diff(active, staged, "path", "hash").unionByName(manifest)
