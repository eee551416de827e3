"""Writers. All write in parallel, one partition per task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granulite.fixed import ARCHIVE_CODES
from granulite.functions.scalars import safe_float
from granulite.operators.segment import mask_lines
from granulite.sources.text import PRESET_NUMBERS, settings_json


def write_settings(settings: DataFrame, path: str) -> None:
    """Nested JSON text, one document per ``path`` value (or one in all)."""
    settings_json(settings).select("value").write.mode("overwrite").text(path)


def valid_presets(df: DataFrame) -> DataFrame:
    """Presets whose four numbers are all finite."""
    ok = F.lit(True)
    for c in PRESET_NUMBERS:
        v = F.col(c)
        ok = ok & v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    return df.filter(ok).withColumn("camera_profile_path", F.coalesce("camera_profile_path", F.lit("")))


def write_presets(df: DataFrame, path: str) -> None:
    """Presets as JSON lines; rows with a non-finite number are left out."""
    valid_presets(df).select("camera_profile_path", *PRESET_NUMBERS).write.mode("overwrite").json(path)


def archive_name(stage="stage", z="z", idx="idx"):
    """File name of an archived frame."""
    return F.concat(F.coalesce(F.col(stage), F.lit("unk")), F.lit("_z"), safe_float(F.coalesce(F.col(z), F.lit(0.0))),
                    F.lit("_i"), F.format_string("%02d", F.coalesce(F.col(idx), F.lit(0))), F.lit(".png"))


def archive_frames(frames: DataFrame, verdicts: DataFrame, profile: str = "automatic") -> DataFrame:
    """Frames of runs that failed with a code worth keeping.

    ``verdicts(run_id, tablet_id, code, failed_at)`` is filtered before the join.
    """
    v = verdicts.filter(F.col("code").isin(*ARCHIVE_CODES[profile])).select(
        "run_id", "tablet_id", F.col("code").alias("error_code"),
        F.date_format("failed_at", "yyyyMMdd_HHmmss").alias("archived_at"))
    return frames.join(v, ["run_id", "tablet_id"]).withColumn("file_name", archive_name())


def archive_summary(archived: DataFrame) -> DataFrame:
    """Frame count per archived failure."""
    return archived.groupBy("error_code", "archived_at").agg(F.count("*").alias("frames"))


def write_error_archive(frames: DataFrame, verdicts: DataFrame, path: str, profile: str = "automatic") -> None:
    """Archive partitioned by code and time, with the summary beside it."""
    a = archive_frames(frames, verdicts, profile)
    a.write.mode("append").partitionBy("error_code", "archived_at").parquet(f"{path}/frames")
    archive_summary(a).write.mode("append").partitionBy("error_code").parquet(f"{path}/summary")


def masked_name(path) -> Column:
    """Path of the masked copy of an image: ``_masked`` before the extension."""
    p = F.col(path) if isinstance(path, str) else path
    ext = F.regexp_extract(p, r"(\.[^./\\]*)$", 1)
    return F.concat(F.substring(p, F.lit(1), F.length(p) - F.length(ext)), F.lit("_masked"), ext)


def write_masked(lines: DataFrame, spans: DataFrame, captures: DataFrame, path: str) -> None:
    """Masked lines with the name their image gets, as Parquet. Frames without a mask are skipped."""
    have = spans.select("frame_id").distinct()
    m = mask_lines(lines.join(have, "frame_id", "left_semi"), spans)
    names = captures.select("frame_id", masked_name("path").alias("path"))
    m.join(names, "frame_id").select("frame_id", "path", "height", "y", "vals").write.mode("overwrite").parquet(path)


def write_requests(df: DataFrame, path: str) -> None:
    """Step requests or responses as JSON lines."""
    df.write.mode("overwrite").json(path)
