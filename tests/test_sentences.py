"""Learned sentence boundaries: planted abbreviations end no sentence; statistics against plain Python."""

import math
import random
import re
from collections import Counter

import pytest

from prodtext.operators import sentences as S

PLAIN = "valve gasket bearing washer bolt bracket hinge spring lever flange housing spindle coupling".split()


def corpus():
    """Sentences that begin with The or It; "approx.", "dr." and "z.b." stand inside them, before names and
    numbers, and now and then end one."""
    rnd = random.Random(3)
    texts, want = [], []
    for _ in range(150):
        out = []
        for _ in range(rnd.randrange(3, 8)):
            words = [rnd.choice(("The", "It"))] + rnd.choices(PLAIN, k=rnd.randrange(4, 9))
            words.insert(rnd.randrange(2, len(words)), rnd.choice(("approx. 5 mm", "Dr. Miller", "z.b. so", "no", "of")))
            out.append(" ".join(words) + rnd.choice((".", ".", "!", "?", " dr.")))
        texts.append("  ".join(out))
        want.append(out)
    return texts, want


@pytest.fixture(scope="module")
def learned(spark):
    texts, want = corpus()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(900, None), (901, ""), (902, " \n ")], "doc_id long, text string")
    types = S.token_types(df)
    abbreviations = S.learn_abbreviations(types)
    return df, types, abbreviations, S.learn_starters(df, types, abbreviations), texts, want


def test_types_and_scores(learned):
    _, types, abbreviations, _, texts, _ = learned
    n, dot = Counter(), Counter()
    for token in " ".join(texts).split():
        word = token.lower().rstrip(".!?")
        if re.search("[a-z]", word):
            n[word] += 1
            dot[word] += token.endswith(".")
    assert {r.word: (r.n, r.n_dot) for r in types.collect()} == {w: (n[w], dot[w]) for w in n}
    p = sum(dot.values()) / sum(n.values())
    score = {}
    for w in n:
        ll = 2 * (dot[w] * math.log(0.99 / p) + (n[w] - dot[w]) * math.log(0.01 / (1 - p)))
        size = len(w.replace(".", ""))
        score[w] = ll * math.exp(-size) * (w.count(".") + 1) * float(size) ** -(n[w] - dot[w]) if dot[w] else 0
    got = {r.word: r.score for r in abbreviations.collect()}
    assert set(got) == {w for w in score if score[w] >= S.ABBREVIATION_FROM} == {"approx", "dr", "z.b"}
    assert all(math.isclose(got[w], score[w], rel_tol=1e-9) for w in got)


def test_starters(learned):
    assert {r.word for r in learned[3].collect()} == {"the", "it"}


def test_abbreviations_end_no_sentence(learned):
    df, _, abbreviations, starters, _, want = learned
    got = {r.doc_id: r.sentences for r in S.split_learned(df, "doc_id", abbreviations, starters).collect()}
    assert [got[i] for i in range(len(want))] == want
    assert got[900] is None and got[901] == got[902] == []


def test_repeated_and_null_keys(learned, spark):
    """Rows of one key, or of no key, keep sentences of their own; other columns stay."""
    _, _, abbreviations, starters, texts, want = learned
    df = spark.createDataFrame([(None if i % 2 else 7, i, t) for i, t in enumerate(texts)], "doc_id long, word int, text string")
    got = {r.word: r.sentences for r in S.split_learned(df, "doc_id", abbreviations, starters).collect()}
    assert [got[i] for i in range(len(want))] == want


def test_nothing_to_learn(spark):
    for texts in ([], ["no end here"], ["a. b. c."], [None, ""]):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
        types = S.token_types(df)
        abbreviations = S.learn_abbreviations(types)
        assert abbreviations.count() == 0
        starters = S.learn_starters(df, types, abbreviations)
        assert S.split_learned(df, "doc_id", abbreviations, starters).count() == len(texts)
