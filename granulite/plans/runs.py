"""Whole reports: a measured run from requests to totals, and autofocus from sweep frames to heights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from granulite.operators import contours as C
from granulite.operators import focus as FO
from granulite.operators import outcomes as O
from granulite.operators import planes as P
from granulite.operators import planning as PL
from granulite.operators import segment as S
from granulite.operators import verdicts as V
from granulite.operators.lineage import settle, written
from granulite.thresholds import AUTOMATIC, CHECK_ONLY, Thresholds


def presence_check(lines: DataFrame, thr: Thresholds = CHECK_ONLY, frames: DataFrame | None = None) -> DataFrame:
    """Frame verdict, then position; the first failing one gives ``(frame_id, status, code)``.

    Only frames that pass the verdict are segmented. Pass ``frames`` to get E2005 for those without usable pixels.
    """
    # one small row per frame, read by several joins below
    v = settle(V.frame_verdict(lines, frames, thr).select("frame_id", "status", "code"))
    good = v.filter("status = 'OK'").select("frame_id")
    p = C.position_check(lines.join(good, "frame_id", "left_semi"), thr, "check_only") \
        .select("frame_id", F.col("code").alias("p_code"))
    j = v.join(p, "frame_id", "left").withColumn("code", F.coalesce("code", "p_code"))
    return j.select("frame_id", F.when(F.col("code").isNull(), "OK").otherwise("ERROR").alias("status"), "code")


def measure_run(requests: DataFrame, checks: DataFrame, captures: DataFrame, msgs: DataFrame) -> DataFrame:
    """Outcome per requested tablet.

    ``requests`` are step requests with ``run_id``; ``checks(run_id, tablet_id, step_status, code)`` hold the
    result of the step each tablet got; ``captures(run_id, tablet_id, seq, path)`` the saved images.
    Refused requests have no step. All joins are on ``(run_id, tablet_id)``.
    """
    r = PL.plan_steps(PL.validate_request(requests)).withColumn("tablet_id", F.col("tablet_index"))
    img = O.tablet_images(captures).select("run_id", "tablet_id", "images")
    j = r.join(checks, ["run_id", "tablet_id"], "left").join(img, ["run_id", "tablet_id"], "left") \
        .withColumn("images", F.coalesce("images", F.array().cast("array<string>"))) \
        .withColumn("step_status", F.coalesce("step_status", F.lit("OK")))
    s = O.step_response(j, msgs)
    state = F.when(F.col("error").isNotNull(), "refused").otherwise(F.col("outcome"))
    return s.select("run_id", "tablet_id", state.alias("state"), F.col("af_error_code").alias("error_code"),
                    F.coalesce("error", "af_error_message").alias("message"),
                    F.when(F.col("error").isNull(), F.col("saved_images")).alias("images"))


def autofocus(lines: DataFrame, frames: DataFrame, thr: Thresholds = AUTOMATIC, k: int = 500, **scan) -> DataFrame:
    """Focus decision per scan from recorded sweep frames ``frames(frame_id, scan_id, z)``.

    The first frame (greatest height) of a scan passes the exposure gate and sets the region
    for all of them; scans that fail there get that code, E2005 if that frame has no usable pixels. ``scan`` are the
    thresholds of the decision.
    """
    first = frames.groupBy("scan_id").agg(F.max_by("frame_id", F.struct("z", (-F.col("frame_id")).alias("n"))).alias("frame_id"))
    head = written(lines.join(first.select("frame_id"), "frame_id", "left_semi"))  # one frame per scan, read by every check
    facts = first.join(V.frame_verdict(head, None, thr), "frame_id", "left").join(P.frame_sizes(head), "frame_id", "left") \
        .withColumn("code", F.when(F.col("status").isNull(), "E2005").otherwise(F.col("code")))
    facts = settle(facts)  # one row per scan
    need = facts.filter("NOT is_uniform AND exp_code = 'EXP_OK'").select("frame_id")
    blob = S.blob_boxes(head.join(need, "frame_id", "left_semi"), thr.otsu_blur, thr.box_pad) \
        .withColumnRenamed("box", "blob_box")
    roi = V.choose_roi(facts.withColumnRenamed("code", "gate_code").join(blob, "frame_id", "left"), thr)
    roi = settle(roi.withColumn("code", F.coalesce("gate_code", "code")).select("scan_id", "is_uniform", "code", "box"))
    open_ = roi.filter("code IS NULL")
    boxes = frames.join(open_, "scan_id").select("frame_id", "box")
    scored = frames.join(open_.select("scan_id"), "scan_id", "left_semi")
    points = FO.scan_metrics(lines, scored, boxes, k)  # only frames with a box are cut
    points = settle(points)  # one row per height, read by every step of the decision
    d = FO.focus_decision(points, open_.select("scan_id", F.col("is_uniform").alias("uniform")), **scan)
    shut = roi.filter("code IS NOT NULL").select("scan_id", F.lit("ERROR").alias("status"), "code")
    return d.unionByName(shut, allowMissingColumns=True)
