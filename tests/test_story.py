"""Reviews, features and slides meet inside a product: its texts are dealt out once, and no word is a row."""

import math
import re
from collections import Counter

from prodtext.operators import align as AL
from prodtext.operators import storyboard as SB


def _sentences(spark):
    rows = [("1", 1, i + 1, s) for i, s in enumerate(["this product has a red seal", "nothing", "", "seal seal seal, RED seal", "this product has"])]
    rows += [("1", 2, 1, "red red"), ("2", 1, 1, "this product has a red seal"), (None, 1, 1, "red seal")]
    return spark.createDataFrame([(*r, "t") for r in rows], "product_id string, para_ord int, sent_ord int, sentence string, para_title string")


def _features(spark):
    rows = [("1", f, f"this product has {f}.") for f in ("red", "red seal", "seal seal", "this thing", "--")] + [(None, "red", "this product has red."), ("3", "red", "this product has red.")]
    return spark.createDataFrame(rows, "product_id string, feature string, feature_sentence string")


def _words(text):
    return Counter(w for w in re.split(r"[^a-z0-9]+", text.lower()) if w)


def test_text_pairs_are_all_pairs_above(spark):
    sents, feats = _sentences(spark), _features(spark)
    for threshold in (0.0, 0.25, 0.6, 0.9):
        want = {}
        for s in sents.collect():
            for f in feats.collect():
                a, b = _words(s.sentence), _words(f.feature_sentence)
                if s.product_id is not None and s.product_id == f.product_id and a and b:
                    sim = sum(a[w] * b[w] for w in a) / (math.sqrt(sum(v * v for v in a.values())) * math.sqrt(sum(v * v for v in b.values())))
                    if sim > threshold:
                        want[s.product_id, s.para_ord, s.sent_ord, f.feature] = round(sim, 9)
        got = {(r.product_id, r.para_ord, r.sent_ord, r.feature): round(r.sim, 9) for r in AL.text_pairs(sents, feats, threshold).collect()}
        assert got == want and got


def test_every_sentence_stays_and_captions_end_at_the_limit(spark):
    sents = _sentences(spark)
    aligned = AL.align_features(sents, AL.text_pairs(sents, _features(spark), 0.25))
    got = {(r.product_id, r.para_ord, r.sent_ord): r.features for r in aligned.collect()}
    assert len(got) == sents.count() and got["2", 1, 1] == got[None, 1, 1] == got["1", 1, 2] == []
    assert got["1", 1, 1] == ["--", "red", "red seal", "seal seal", "this thing"] and got["1", 1, 4] == []
    slides = {r.slide_no: r.captions for r in SB.storyboard(aligned, max_captions=3).where("product_id = '1'").collect()}
    assert slides == {**{k: ["--", "red", "red seal"] for k in range(5)}, 5: ["red", "red seal"]}


def test_texts_are_dealt_out_by_product_only(spark):
    reviews = spark.createDataFrame([("1", "# t\n<h2> a\nthis product has red. b.")], "product_id string, review string")
    sents = AL.paragraph_sentences(AL.parse_review_paragraphs(reviews))
    slides = SB.storyboard(AL.align_features(sents, AL.text_pairs(sents, _features(spark), 0.25)))
    plan = slides._jdf.queryExecution().executedPlan().toString()
    # of the reviews for the sentences and for their words, which is one when it runs, and of the features
    assert plan.count("Exchange hashpartitioning") == 3
    assert [(r.slide_no, r.captions) for r in slides.orderBy("slide_no").collect()] == [(0, ["--", "red", "red seal", "seal seal", "this thing"]), (1, ["--", "red", "red seal", "seal seal", "this thing"])]
