"""Rollups against counting anew; idempotent and broken commits; pieces of long texts."""

import base64
import shutil
from collections import Counter

import tiktoken

from prodtext.llm import tokencounts as K
from prodtext.llm.common import shared_dir
from prodtext.llm.queries import PATTERN, TOKENIZERS


def coder(version):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(TOKENIZERS[version], "rb"))}
    return tiktoken.Encoding(version, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def totals(rollup):
    return {(r.source, r.lang, r.version): (r.documents, r.tokens, r.bytes) for r in rollup.totals().collect()}


def counted(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, text string").selectExpr("*", "coalesce(octet_length(text), 0) AS b").selectExpr("doc_id", "source", "lang", "text", "cast(b AS long) AS bytes")
    return K.token_counts(df, TOKENIZERS, PATTERN, ["doc_id", "source", "lang", "bytes"])


def brute(rows):
    out = {}
    for v in TOKENIZERS:
        c = coder(v)
        for _, s, l, t in rows:
            d, n, b = out.get((s, l, v), (0, 0, 0))
            out[(s, l, v)] = (d + 1, n + len(c.encode_ordinary(t or "")), b + len((t or "").encode()))
    return out


A = [(1, "a", "en", "Hello world, it's  me\n\n"), (2, "a", "en", None), (3, None, None, "éü 😀 123"), (4, "b", "de", ""), (4, "b", "de", "")]
B = [(5, "a", "en", "more text"), (6, "c", "fr", "bonjour")]


def test_batches_add_up(spark, tmp_path):
    r = K.Rollup(spark, f"file://{tmp_path}/r")
    v = list(TOKENIZERS)
    assert totals(r) == {} and r.committed() == []
    assert r.commit("1", K.signed(counted(spark, A), v, 1)) and totals(r) == brute(A)
    assert r.commit("2", K.signed(counted(spark, B), v, 1)) and totals(r) == brute(A + B)
    # document 3 goes, 6 moves to another source with another text
    change = K.signed(counted(spark, [A[2], B[1]]), v, -1).unionByName(K.signed(counted(spark, [(6, "a", "fr", "salut")]), v, 1))
    assert r.commit("3", change)
    want = brute([A[0], A[1], A[3], A[4], B[0], (6, "a", "fr", "salut")])
    assert totals(r) == want  # groups without documents are gone
    assert r.committed() == ["1", "2", "3"]


def test_a_batch_counts_once(spark, tmp_path):
    r = K.Rollup(spark, f"file://{tmp_path}/r")
    rows = K.signed(counted(spark, A), list(TOKENIZERS), 1)
    assert r.commit("x", rows) is True and r.commit("x", rows) is False
    assert totals(r) == brute(A)
    (tmp_path / "r" / "batch=x" / "_SUCCESS").unlink()  # as if the writing had broken off
    assert totals(r) == {} and r.commit("x", rows) is True and totals(r) == brute(A)
    shutil.rmtree(tmp_path / "r")
    assert shared_dir(spark)


def test_pieces_have_the_tokens_of_the_whole():
    texts = ["word " * 50 + "  \n x", "a  b   c \n\n d" * 40, "don't 12 345 !? é😀 " * 30, " " * 300, "x" * 500, "", "tail   "]
    for v in TOKENIZERS:
        c = coder(v)
        for t in texts:
            for size in (7, 31, 100):
                parts = list(K.pieces(t, size))
                assert "".join(parts) == t
                assert [x for p in parts for x in c.encode_ordinary(p)] == c.encode_ordinary(t)


def test_edges(spark, edge_docs, empty_docs, tmp_path):
    docs = edge_docs.selectExpr("*", "cast(coalesce(octet_length(text), 0) AS long) AS bytes")
    rows = K.token_counts(docs, TOKENIZERS, PATTERN, ["doc_id", "source", "lang", "bytes"])
    r = K.Rollup(spark, f"file://{tmp_path}/e")
    r.commit("1", K.signed(rows, list(TOKENIZERS), 1))
    want = Counter((x.source, x.lang) for x in edge_docs.collect())
    assert {(s, l): d for (s, l, v), (d, _, _) in totals(r).items() if v == "bpe_50k"} == dict(want)
    none = K.token_counts(empty_docs.selectExpr("*", "0L AS bytes"), TOKENIZERS, PATTERN, ["doc_id", "source", "lang", "bytes"])
    assert none.count() == 0
    r.commit("2", K.signed(none, list(TOKENIZERS), 1))
    assert {(s, l): d for (s, l, v), (d, _, _) in totals(r).items() if v == "bpe_50k"} == dict(want)


def test_query_against_plain_batches(spark, tmp_path):
    """Insert all, drop copies, tidy repeated lines: with repeated and null ids, nulls and ties."""
    from prodtext.llm.queries import op1_token_counts
    rows = [(5, "a\na", "s", "en"), (5, "bb cc dd", "s", "en"), (6, "ee", "s", "en"), (7, "a\na", "t", "de"), (7, "a\na", "t", "de"), (None, "ee", "t", None), (None, "x\nx\ny", None, "fr"),
            (None, "x\nx\ny", None, "fr"), (8, None, "s", "en"), (9, None, "u", "en"), (10, "", "s", "en"), (11, "one\ntwo\none", "v", "es")]
    spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, lang string, row int").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    last = {}
    for i, (d, t, s, lang) in enumerate(rows):
        if t not in last or (d if d is not None else -1) >= last[t][0]:
            last[t] = (d if d is not None else -1, s, lang)
    want = Counter()
    for t, (_, s, lang) in last.items():
        tidy = "\n".join(dict.fromkeys((t or "").split("\n")))
        for v in TOKENIZERS:
            n = len(coder(v).encode_ordinary(tidy))
            want[s, lang, v, "documents"] += 1
            want[s, lang, v, "tokens"] += n
            want[s, lang, v, "bytes"] += len(tidy.encode())
    got = {(r.source, r.lang, r.version, m): r[m] for r in op1_token_counts(spark, str(tmp_path)).collect() for m in ("documents", "tokens", "bytes")}
    assert got == dict(want)
