"""Detections: the best box of an image, and its crop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def best_box(detections: DataFrame, image: str = "image_id") -> DataFrame:
    """The box with the highest score of each image; ties: the smallest box."""
    best = detections.groupBy(image).agg(F.max_by(F.struct("score", "x0", "y0", "x1", "y1"), F.struct("score", -F.col("x0"), -F.col("y0"), -F.col("x1"), -F.col("y1"))).alias("b"))
    return best.select(image, "b.*")


def clamp(boxes: DataFrame, width: str = "width", height: str = "height", threshold: float = 0.3) -> DataFrame:
    """Adds cropped and the crop's corners: the box within the image, or the whole image if the score is low or the box empty."""
    to_int = lambda c, hi: F.greatest(F.lit(0), F.least(F.col(hi), F.col(c).cast("int")))
    inside = boxes.withColumns({"_x0": to_int("x0", width), "_y0": to_int("y0", height), "_x1": to_int("x1", width), "_y1": to_int("y1", height)})
    good = F.coalesce((F.col("score") >= threshold) & (F.col("_x1") > F.col("_x0")) & (F.col("_y1") > F.col("_y0")), F.lit(False))
    pick = lambda c, whole: F.when(good, F.col(c)).otherwise(whole)
    return inside.select(
        *boxes.columns, good.alias("cropped"), pick("_x0", F.lit(0)).alias("crop_x0"), pick("_y0", F.lit(0)).alias("crop_y0"),
        pick("_x1", F.col(width)).alias("crop_x1"), pick("_y1", F.col(height)).alias("crop_y1"),
    )
