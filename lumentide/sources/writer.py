"""The end of a job: frames in order, one size for all, and either the whole output or none of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def frame_errors(frames: DataFrame) -> DataFrame:
    """Frames (job_id, n, width, height, ...) with ``error``: kInvalidFrameDimensions from the first one on that is empty or of another size than the job's first."""
    by_number = Window.partitionBy("job_id").orderBy("n")
    size = F.struct("width", "height")
    wrong = (F.coalesce("width", F.lit(0)) <= 0) | (F.coalesce("height", F.lit(0)) <= 0) | (size != F.first(size).over(by_number))
    failed = F.max(F.coalesce(wrong, F.lit(True)).cast("int")).over(by_number) == 1
    return frames.withColumn("error", F.when(failed, "kInvalidFrameDimensions").otherwise("kOk"))


def finalised(frames: DataFrame, terminals: DataFrame) -> DataFrame:
    """One row for each job of ``terminals`` (job_id, state): error, written_frames, committed. A job that didn't succeed, had a wrong frame or none at all leaves nothing."""
    told = frame_errors(frames).groupBy("job_id").agg(F.max(F.when(F.col("error") != "kOk", F.col("error"))).alias("error"), F.sum((F.col("error") == "kOk").cast("long")).alias("written_frames"))
    out = terminals.join(told, "job_id", "left").select("job_id", "state", F.coalesce("error", F.lit("kOk")).alias("error"), F.coalesce("written_frames", F.lit(0).cast("long")).alias("written_frames"))
    return out.withColumn("committed", F.coalesce((F.col("state") == "kSucceeded") & (F.col("error") == "kOk") & (F.col("written_frames") > 0), F.lit(False)))


def write_jobs(frames: DataFrame, terminals: DataFrame, path: str) -> None:
    """The frames of jobs that are committed, as a table."""
    done = finalised(frames, terminals).where("committed").select("job_id")
    write_frames(frames.join(done, "job_id", "left_semi"), path, order="n")


def write_frames(frames: DataFrame, path: str, job: str = "job_id", order: str = "pts_us") -> None:
    """Frames as a table split by job, in order within; a large job is several files of following ranges. Only partitions of jobs that are written are replaced, and Spark's committer leaves nothing of a write that failed."""
    ranged = frames.repartitionByRange(F.col(job), F.col(order)).sortWithinPartitions(job, order)
    ranged.write.partitionBy(job).mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)


def outcome(pipeline_ok: Column, pipeline_error: Column, writer_error: Column, finalized: Column, file_size: Column) -> Column:
    """(status, exit_code, error_code, cause) of a run: a success needs the pipeline, the writer, its end and a file with content. ``file_size`` is null where there is no file."""
    good = pipeline_ok & (writer_error == "kOk") & finalized & (F.coalesce(file_size, F.lit(0)) > 0)
    cause = F.when(good, None).when(~pipeline_ok, "pipeline").when(writer_error != "kOk", "writer").when(~finalized, "not finalized").when(file_size.isNull(), "missing file").otherwise("empty file")
    code = F.when(good, None).when(pipeline_ok, "WriterOutputInvalid").otherwise(pipeline_error)
    return F.struct(F.when(good, "success").otherwise("error").alias("status"), F.when(good, 0).otherwise(1).alias("exit_code"), code.alias("error_code"), cause.alias("cause"))
