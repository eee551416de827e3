"""Settings, limits and presets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlay(defaults: DataFrame, stored: DataFrame, keys: list[str]) -> DataFrame:
    """Stored values beat defaults, key by key; keys of either side survive."""
    d = defaults.select(*keys, F.col("value").alias("default_value"))
    s = stored.select(*keys, F.col("value").alias("stored_value"))
    return d.join(s, keys, "full_outer").withColumn("value", F.coalesce("stored_value", "default_value"))


SECTION_ORDER = ("camera_params_dome", "camera_params_bar", "camera")


def first_section(settings: DataFrame, by: str | None = None, order=SECTION_ORDER) -> DataFrame:
    """The rows of the first section that has any, in the given order."""
    rank = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("category"))
    r = settings.withColumn("_rank", rank).filter("_rank > 0")
    if by is None:
        return r.filter(F.col("_rank") == r.groupBy().agg(F.min("_rank")).scalar()).drop("_rank")
    best = r.groupBy(by).agg(F.min("_rank").alias("_best"))
    return r.join(best, by).filter("_rank = _best").drop("_rank", "_best")


def snap_value(v: Column, lo: Column, hi: Column, inc: Column) -> Column:
    """Nearest allowed step, half to even; above the range the last whole step."""
    step = F.when(F.coalesce(inc, F.lit(0.0)) == 0, F.lit(1.0)).otherwise(inc)
    near = lo + F.rint((v - lo) / step) * step
    last = lo + F.floor((hi - lo) / step) * step
    return F.bround(F.when(v < lo, lo).when(v > hi, last).otherwise(near), 6)


def snap(values: DataFrame, value: str = "value") -> DataFrame:
    """``snapped`` and ``adjusted`` for rows that carry ``min, max, inc``."""
    s = snap_value(F.col(value), F.col("min"), F.col("max"), F.col("inc"))
    return values.withColumn("snapped", s).withColumn("adjusted", F.col("snapped") != F.col(value))


def check_limits(settings: DataFrame, limits: DataFrame) -> DataFrame:
    """Settings with their limits applied; unknown names and values that are no number are errors."""
    j = settings.join(limits.withColumn("_known", F.lit(True)), "name", "left")
    v = F.col("value").try_cast("double")
    j = j.withColumn("number", v)
    s = snap_value(F.col("number"), F.col("min"), F.col("max"), F.col("inc"))
    err = F.when(F.col("number").isNull(), F.concat(F.lit("Invalid parameter value for "), F.col("name"))) \
        .when(F.col("_known").isNull(), F.concat(F.lit("Property '"), F.col("name"),
                                                 F.lit("' not found in camera properties.")))
    return j.withColumn("error", err).withColumn("snapped", F.when(F.col("error").isNull(), s)) \
        .withColumn("adjusted", F.col("snapped") != F.col("number")).drop("_known")


def settings_for_light(captures: DataFrame, settings: DataFrame,
                       names=("ExposureTime", "Gain", "Gamma")) -> DataFrame:
    """Settings of the light each capture used, one column per name, dome when none is named.

    Settings are folded to one row per light before the join.
    """
    light = F.regexp_extract("category", "^camera_params_(.+)$", 1)
    wide = settings.withColumn("light", light).filter("light <> ''").groupBy("light").agg(
        *[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    c = captures.withColumn("light", F.coalesce("light", F.lit("dome")))
    return c.join(wide, "light", "left")
