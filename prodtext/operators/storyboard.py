"""Storyboard rows and clip timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prodtext.functions.constants import INTRO, MAX_CAPTIONS

def brand_model(catalog: DataFrame) -> DataFrame:
    """Brand and model (= title) per product."""
    return catalog.select("product_id", "brand", F.col("title").alias("model"))


def storyboard(aligned: DataFrame, key: str = "product_id", max_captions: int = MAX_CAPTIONS) -> DataFrame:
    """One slide per sentence: paragraph title, captions = the first ``max_captions`` features
    matched so far in the paragraph, narration = sentence; slide_no continuous per product."""
    # windows inside a product: sentences that lie by product stay there
    w = Window.partitionBy(key, "para_ord").orderBy("sent_ord")
    before = F.coalesce(F.sum(F.size("features")).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    new = aligned.withColumn("_new", F.slice("features", F.lit(1), F.greatest(F.lit(max_captions) - before, F.lit(0)).cast("int")))
    # only sentences with new captions are collected: max_captions of them at most
    out = new.withColumn("captions", F.flatten(F.collect_list(F.when(F.size("_new") > 0, F.col("_new"))).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))))
    ws = Window.partitionBy(key).orderBy("para_ord", "sent_ord")
    return out.select(key, (F.row_number().over(ws) - 1).cast("int").alias("slide_no"), "para_ord", "sent_ord",
                      F.col("para_title").alias("title"), "captions", F.col("sentence").alias("narration"))


def storyboard_intro(models: DataFrame, key: str = "product_id") -> DataFrame:
    """The first slide (slide_no -1): model as title, fixed intro narration."""
    return models.select(key, F.lit(-1).alias("slide_no"), F.col("model").alias("title"),
                         F.array().cast("array<string>").alias("captions"),
                         F.concat(F.lit(INTRO[0]), F.col("model"), F.lit(INTRO[1])).alias("narration"))


def slide_timeline(slides: DataFrame, key: str = "product_id", chars_per_second: float = 15.0) -> DataFrame:
    """Clips back to back; duration from narration length; background = total + 3 s.
    Running totals are summed as integer character counts and divided once, so the
    result does not depend on summation order."""
    d = slides.withColumn("_chars", F.length("narration").cast("bigint"))
    w = Window.partitionBy(key).orderBy("slide_no")
    run = w.rowsBetween(Window.unboundedPreceding, -1)
    cps = F.lit(chars_per_second)
    return (d.withColumn("duration_s", F.col("_chars") / cps)
             .withColumn("start_s", F.coalesce(F.sum("_chars").over(run), F.lit(0)) / cps)
             .withColumn("music_s", F.sum("_chars").over(Window.partitionBy(key)) / cps + 3.0)
             .drop("_chars"))
