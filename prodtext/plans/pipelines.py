"""The product lifecycle in one call: prompts and reviews to timeline rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prodtext.operators import align as AL
from prodtext.operators import render as R
from prodtext.operators import storyboard as SB


def product_review_storyboard(prompts: DataFrame, reviews: DataFrame, models: DataFrame,
                              threshold: float = 0.5) -> DataFrame:
    """prompts (product_id, group_ord, category, input), reviews (product_id, review),
    models (product_id, brand, model) -> timeline rows incl. the intro slide."""
    feats = R.feature_sentences(R.extract_features(prompts.where(F.col("group_ord") > 0)))
    sents = AL.paragraph_sentences(AL.parse_review_paragraphs(reviews))
    aligned = AL.align_features(sents, AL.text_pairs(sents, feats, threshold))
    slides = SB.storyboard(aligned).select("product_id", "slide_no", "title", "captions", "narration")
    intro = SB.storyboard_intro(models.join(reviews.select("product_id"), "product_id", "left_semi"))
    return SB.slide_timeline(intro.unionByName(slides))
