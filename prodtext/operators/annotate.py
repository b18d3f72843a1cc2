"""Annotation: tags -> entity spans, gold tables, and a fold-aware dictionary extractor.

Everything is keyed by ``doc_id``; per-document work (token offsets, occurrence
offsets) runs in windows partitioned by document, so no group is larger than
one document.
"""

from __future__ import annotations

import zlib
from itertools import zip_longest

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from prodtext.functions.constants import ENTITY_TAGS
from prodtext.functions.text import replace_all
from prodtext.session import cut_lineage


# ---- N1 / C8 -------------------------------------------------------------------------------
def strip_tags_expr(c):
    out = replace_all(c, [(">.", "> ."), (">,", "> ,")])
    for open_t, close_t, _ in ENTITY_TAGS:
        out = replace_all(out, [(open_t, ""), (close_t, "")])
    return out


def strip_tags(tagged: DataFrame, col: str = "tagged_text", out: str = "text") -> DataFrame:
    return tagged.withColumn(out, strip_tags_expr(F.col(col)))


# ---- N2 / N3 -------------------------------------------------------------------------------
def tagged_entities(tagged: DataFrame, col: str = "tagged_text") -> DataFrame:
    """Every tagged surface (non-greedy, in text order) -> (doc_id, label, ent_ord, entity)."""
    outs = []
    for i, (open_t, close_t, label) in enumerate(ENTITY_TAGS):
        found = F.regexp_extract_all(F.col(col), F.lit(f"{open_t}([^\n]+?){close_t}"), 1)
        outs.append(tagged.select("doc_id", F.lit(i + 1).alias("tag_ord"), F.lit(label).alias("label"),
                                  F.posexplode(found).alias("pos", "entity")))
    u = outs[0]
    for o in outs[1:]:
        u = u.unionByName(o)
    return u.select("doc_id", "tag_ord", "label", (F.col("pos") + 1).cast("int").alias("ent_ord"), "entity")


# ---- N4 / J5 / C9 --------------------------------------------------------------------------
POSITIONS = T.StructType([T.StructField("tag_ord", T.IntegerType()), T.StructField("label", T.StringType()), T.StructField("entity", T.StringType()),
                          T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _tag_struct(tag_ord: int, label: str):
    def f(e):
        return F.struct(F.lit(tag_ord).alias("tag_ord"), F.lit(label).alias("label"), e.alias("entity"))
    return f


FEW_SURFACES = 8


def _starts(text: str, surface: str) -> list[int]:
    starts, at = [], text.find(surface)
    while at >= 0:
        starts.append(at)
        at = text.find(surface, at + len(surface))
    return starts


def occurrences(text: str, surfaces: list[str]) -> dict[str, list[int]]:
    """Starts of every surface in the text, left to right and not overlapping itself: each of a few
    surfaces is searched for by itself, more in one pass over the text by an Aho-Corasick automaton of all."""
    if len(surfaces) <= FEW_SURFACES:
        return {surface: starts for surface in surfaces if (starts := _starts(text, surface))}
    import ahocorasick

    machine = ahocorasick.Automaton()
    for surface in surfaces:
        machine.add_word(surface, surface)
    found: dict[str, list[int]] = {}
    if len(machine):
        machine.make_automaton()
        for last, surface in machine.iter(text):
            starts, start = found.setdefault(surface, []), last + 1 - len(surface)
            if not starts or start >= starts[-1] + len(surface):
                starts.append(start)
    return found


def entity_positions(tagged: DataFrame, col: str = "tagged_text") -> DataFrame:
    """Each distinct tagged surface, located literally in the stripped text: every
    non-overlapping left-to-right occurrence (including untagged ones).  Offsets are
    code points, end exclusive.  A text is read once, whatever the number of its surfaces.  Documents
    are dealt out by id first, as a file's row groups can be fewer than the cores."""
    tg = F.col("_tg")
    ents = []
    for i, (open_t, close_t, label) in enumerate(ENTITY_TAGS):
        found = F.array_distinct(F.regexp_extract_all(tg, F.lit(f"{open_t}([^\n]+?){close_t}"), 1))
        ents.append(F.transform(found, _tag_struct(i + 1, label)))
    # no filter on the surfaces: pushed below the projections, it would find them a second time
    x = tagged.select("doc_id", F.col(col).alias("_tg")).repartition("doc_id").select("doc_id", strip_tags_expr(tg).alias("text"), F.concat(*ents).alias("ents"))
    out = T.StructType([tagged.schema["doc_id"], *POSITIONS])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])

    def run(batches):
        for b in batches:
            columns: list[list] = [[] for _ in out]
            for doc_id, text, ents in zip(*(c.to_pylist() for c in b.columns)):
                if not ents:
                    continue
                found = occurrences(text, [e["entity"] for e in ents])
                for e in ents:
                    for start in found.get(e["entity"], ()):
                        for column, v in zip(columns, (doc_id, e["tag_ord"], e["label"], e["entity"], start, start + len(e["entity"]))):
                            column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return x.mapInArrow(run, out)


# ---- X3 / N6 -------------------------------------------------------------------------------
def gold_spans(positions: DataFrame, metric_tags=("ATTR", "PROD")) -> DataFrame:
    """Per document: ATTR spans then PROD spans (by offset) -> span_ord.  The surface text
    (``entity``) is carried along: a span is an occurrence of that literal."""
    rank = F.when(F.col("label") == metric_tags[0], 1).otherwise(2)
    w = Window.partitionBy("doc_id").orderBy(rank, "start", "end")
    # the surface is determined by (doc, start, end): a plain distinct (hash aggregate) suffices
    return (positions.select("doc_id", "start", "end", "label", "entity").distinct()
            .withColumn("span_ord", F.row_number().over(w).cast("int"))
            .select("doc_id", "span_ord", "start", "end", "label", "entity"))


# ---- N5 ------------------------------------------------------------------------------------
def gold_table(text: DataFrame, spans: DataFrame) -> DataFrame:
    """(id, Description, Attributes, Product, Attributes_pos, Product_pos), lists in span order."""
    s = spans.withColumnRenamed("entity", "surface")

    def lst(label, field):
        return F.transform(
            F.array_sort(F.collect_list(F.when(F.col("label") == label, F.struct("span_ord", field)))),
            lambda x: x[field])

    pos = F.struct("start", "end", "label").alias("pos")
    g = s.select("doc_id", "span_ord", "label", "surface", pos).groupBy("doc_id").agg(
        lst("ATTR", "surface").alias("Attributes"), lst("PROD", "surface").alias("Product"),
        lst("ATTR", "pos").alias("Attributes_pos"), lst("PROD", "pos").alias("Product_pos"))
    return text.select(F.col("doc_id").alias("id"), F.col("text").alias("Description"), "doc_id").join(
        g, "doc_id", "left").drop("doc_id")


# ---- N7 (re-aimed): dictionary extractor -----------------------------------------------------
def gazetteer_train(spans: DataFrame, folds: DataFrame | None = None, fold_col: str | None = "fold") -> DataFrame:
    """Dictionary (surface_lc, label) -> set of folds where it was seen as gold.
    ``spans`` carry their surface (``entity``); ``folds`` maps doc_id -> fold."""
    s = spans.join(folds.select("doc_id", fold_col), "doc_id") if fold_col else spans
    s = s.select(F.lower("entity").alias("surface_lc"), "label",
                 (F.col(fold_col) if fold_col else F.lit(0)).alias("fold")).distinct()
    return s.groupBy("surface_lc", "label").agg(
        F.array_sort(F.collect_set("fold")).alias("folds"),
        F.size(F.split(F.first("surface_lc"), " ")).alias("n_tokens"))


MANY_TOKENS = 4


def gazetteer_index(dictionary: DataFrame) -> DataFrame:
    """One row per surface: (surface_lc, n_tokens, head, n_head, entries array<struct<label, folds>>).
    ``head`` is what texts are searched for, ``n_head`` tokens long: the whole surface up to ``MANY_TOKENS``
    tokens; of a longer one, as many first tokens as the largest power of two below or at its length."""
    entries = dictionary.groupBy("surface_lc", "label").agg(F.flatten(F.collect_list("folds")).alias("folds"))
    index = entries.groupBy("surface_lc").agg(F.array_sort(F.collect_list(F.struct("label", "folds"))).alias("entries"))
    tokens = F.split("surface_lc", " ", -1)
    n = F.size(tokens)
    whole = F.expr(f"1 << int(length(bin(size(split(surface_lc, ' ', -1)))) - 1)")
    n_head = F.when(n <= MANY_TOKENS, n).otherwise(whole)
    return index.select("surface_lc", "entries", n.alias("n_tokens"), n_head.alias("n_head"),
                        F.array_join(F.slice(tokens, 1, n_head), " ").alias("head"))


MARK_BITS = 24  # 64 places a row: at most 2^18 rows of two longs


def _place(head):
    return F.crc32(F.col(head).cast("binary")).bitwiseAND(F.lit((1 << MARK_BITS) - 1))  # one that Python has, too


def head_marks(index: DataFrame) -> DataFrame:
    """(word, bits): a bit is set where a surface's head falls by hash.  Of bounded size, however large
    the index is; what begins no surface mostly meets a bit that is not set."""
    return (index.select(_place("head").alias("place")).groupBy(F.shiftright("place", 6).alias("word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, int(place & 63))")).alias("bits")))


def _marked(grams: DataFrame, marks: DataFrame) -> DataFrame:
    """The rows whose ``head`` falls on a set bit: all heads of the index, and few others.  The bits, of
    bounded size, go to the tasks (2 MB), so rows that fall on none are not shuffled to meet them."""
    bits = np.zeros(1 << (MARK_BITS - 6), dtype="int64")
    for r in marks.collect():
        bits[r["word"]] = r["bits"]
    low, column = (1 << MARK_BITS) - 1, grams.columns.index("head")

    def run(batches):
        for b in batches:
            head = b.column(column)
            place = np.fromiter(map(zlib.crc32, head.drop_null().cast(pa.binary()).to_pylist()), dtype="int64", count=len(head) - head.null_count) & low
            kept = np.zeros(len(head), dtype=bool)
            kept[np.asarray(head.is_valid())] = (bits[place >> 6] >> (place & 63)) & 1
            yield b.filter(pa.array(kept))

    return grams.mapInArrow(run, grams.schema)


@F.pandas_udf(T.ArrayType(T.LongType()))
def offsets_udf(lengths: pd.Series) -> pd.Series:
    """Where each token begins: the sum of the lengths before it."""
    return lengths.map(lambda x: np.cumsum(x, dtype="int64") - x)


def _tokens(text: DataFrame, extra) -> DataFrame:
    """Single-space tokens with their code-point offset and the token that follows.  ``text`` is
    partitioned by doc_id and its tokens stay so; they are placed within their document's row, without
    a sort of all tokens of a partition.  Texts of one id follow each other token by token."""
    texts = text.groupBy("doc_id", *extra).agg(F.collect_list(F.split("text", " ", -1)).alias("t"))
    rows = F.flatten(F.transform("t", lambda toks, d: F.transform(toks, lambda tok, i: F.struct(i.alias("i"), d.alias("d"), tok.alias("tok")))))
    one = F.when(F.size("t") == 1, F.get("t", F.lit(0))).otherwise(F.transform(F.array_sort(rows), lambda x: x["tok"]))
    docs = texts.select("doc_id", *extra, one.alias("toks"))
    docs = docs.withColumn("starts", offsets_udf(F.transform("toks", lambda tok: F.length(tok) + 1)))
    toks = docs.select("doc_id", *extra, "toks", "starts", F.posexplode_outer("toks").alias("i", "tok")).where(F.col("i").isNotNull())
    return toks.select("doc_id", *extra, "tok", F.get("starts", F.col("i")).alias("start"), F.get("toks", F.col("i") + 1).alias("next"))


BLOCK_BYTES = 4 << 20  # texts that meet their part of the dictionary together


def _one_text(docs: pa.Table) -> pa.Table:
    """One row per document: the texts of one id (and fold) follow each other token by token."""
    names = [c for c in docs.column_names if c not in ("block", "text", "lowered")]
    rows: dict = {}
    for at, i in enumerate(zip(*(docs[c].to_pylist() for c in names))):
        rows.setdefault(i, []).append(at)
    if len(rows) == docs.num_rows:
        return docs
    whole = docs.take([found[0] for found in rows.values()])
    for c in ("text", "lowered"):
        texts = docs[c].to_pylist()
        mixed = [" ".join(t for at in zip_longest(*(texts[k].split(" ") for k in found)) for t in at if t is not None) for found in rows.values()]
        whole = whole.set_column(whole.schema.get_field_index(c), c, pa.array(mixed, docs.schema.field(c).type))
    return whole


def _cut(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All single-space tokens of the texts, and how many each has."""
    cut = pc.split_pattern(pa.concat_arrays(texts.chunks), " ") if texts.num_chunks else pa.array([], pa.list_(pa.string()))
    return cut.flatten(), np.asarray(pc.list_value_length(cut), dtype="int64")


def _runs(toks: pa.Array, at: np.ndarray, n: int) -> pa.Array:
    """The runs of n tokens that begin at these places."""
    return toks.take(pa.array(at)) if n == 1 else pc.binary_join_element_wise(*(toks.take(pa.array(at + k)) for k in range(n)), " ")


def _block_heads(lengths: list[int]):
    """The distinct runs of so many tokens in a block's texts.  A run's number comes from those of
    its two halves, so only distinct runs are ever written out."""
    def run(key, docs):
        toks, counts = _cut(_one_text(docs)["lowered"])
        left = np.repeat(np.cumsum(counts), counts) - np.arange(len(toks))  # tokens to the end of the text, this one included
        numbers = {1: np.asarray(toks.dictionary_encode().indices, dtype="int64")}

        def number(n: int) -> np.ndarray:
            if n not in numbers:
                half = 1 << ((n - 1).bit_length() - 1)
                first, second = number(half), number(n - half)
                pairs = np.full(len(toks), -1, dtype="int64")
                here = np.flatnonzero(left >= n)
                _, pairs[here] = np.unique(first[here] * len(toks) + second[here + half], return_inverse=True)
                numbers[n] = pairs
            return numbers[n]

        heads = []
        for n in lengths:
            found, at = np.unique(number(n), return_index=True)
            heads.append(_runs(toks, at[found >= 0], n))
        head = pa.concat_arrays(heads).cast(pa.string()) if heads else pa.array([], pa.string())
        head = head.filter(pc.not_equal(head, ""))
        return pa.table({"block": pa.array(np.full(len(head), key[0].as_py(), dtype="int32")), "head": head})

    return run


def _block_spans(schema: pa.Schema, fold_col: str | None):
    """Places a block's part of the dictionary in its texts: at each token the longest surface, if it
    ends behind all before it."""
    def run(docs, words):
        docs, words = _one_text(docs), words.combine_chunks()
        (toks, counts), (low, _) = _cut(docs["text"]), _cut(docs["lowered"])
        doc, places = np.repeat(np.arange(len(counts)), counts), np.arange(len(toks))
        behind = np.repeat(np.cumsum(counts), counts)  # where the text ends
        width = np.asarray(pc.utf8_length(toks), dtype="int64") + 1
        start = np.cumsum(width) - width  # over all texts of the block, one behind the other
        if fold_col:  # folds as numbers, the same for documents and entries
            folds = pa.concat_arrays([c for t, name in ((docs, fold_col), (words, "low"), (words, "high")) for c in t[name].chunks])
            folds = np.asarray(folds.dictionary_encode().indices.fill_null(-1), dtype="int64")
            fold, least, most = np.split(folds, [docs.num_rows, docs.num_rows + words.num_rows])
        longest, tag = np.zeros(len(toks), dtype="int64"), np.zeros(len(toks), dtype="int64")
        sizes, label = np.asarray(words["n_tokens"], dtype="int64"), words["label"].to_pylist()
        labels = sorted(set(label))
        of_label = np.asarray([labels.index(x) for x in label], dtype="int64")
        coded = low.dictionary_encode()
        word, vocabulary = np.asarray(coded.indices, dtype="int64"), coded.dictionary
        for n in np.unique(sizes):  # a longer surface, then an earlier label, takes the place
            n_rows = np.flatnonzero(sizes == n)
            surfaces = pa.concat_arrays(words["surface_lc"].chunks).take(pa.array(n_rows))
            if n == 1:
                at = places
            else:
                ends, _ = _cut(pa.chunked_array([surfaces]))
                ends = [ends.take(pa.array(np.arange(k, len(ends), n))) for k in (0, n - 1)]
                first, last = (np.asarray(pc.is_in(vocabulary, value_set=x), dtype=bool) for x in ends)
                at = places[places + n <= behind]
                at = at[first[word[at]] & last[word[at + n - 1]]]
            for k in range(len(labels) - 1, -1, -1):
                rows = n_rows[of_label[n_rows] == k]
                mine = surfaces.filter(pa.array(of_label[n_rows] == k))
                if n == 1:
                    found = np.asarray(pc.index_in(vocabulary, value_set=mine).fill_null(-1), dtype="int64")[word[at]]
                else:
                    found = np.asarray(pc.index_in(_runs(low, at, n), value_set=mine).fill_null(-1), dtype="int64")
                hit = found >= 0
                if fold_col and len(rows):  # seen in another fold
                    mine_fold, row = fold[doc[at]], rows[found]
                    hit &= (mine_fold >= 0) & ((least[row] != mine_fold) | (most[row] != mine_fold))
                longest[at[hit]], tag[at[hit]] = n, k
        at = np.flatnonzero(longest)
        end = start[at + longest[at] - 1] + width[at + longest[at] - 1] - 1
        before = np.concatenate([[-1], np.maximum.accumulate(end)[:-1]]) if len(at) else end
        kept = end > before
        at, end = at[kept], end[kept]
        parts = [np.flatnonzero(longest[at] == n) for n in np.unique(longest[at])]
        entity = pa.concat_arrays([_runs(toks, at[p], int(longest[at[p[0]]])) for p in parts]) if parts else pa.array([], pa.string())
        entity = entity.take(pa.array(np.argsort(np.concatenate(parts), kind="stable"))) if parts else entity
        base = start[(np.cumsum(counts) - counts)[doc[at]]]
        ids = [pa.concat_arrays(docs[f.name].chunks).take(pa.array(doc[at])) if docs.num_rows else pa.array([], f.type) for f in list(schema)[:-4]]
        spans = [pa.array((start[at] - base).astype("int32")), pa.array((end - base).astype("int32")), pa.array(labels, pa.string()).take(pa.array(tag[at])), entity.cast(pa.string())]
        return pa.Table.from_arrays(ids + spans, schema=schema)

    return run


def gazetteer_predict(text: DataFrame, dictionary: DataFrame, fold_col: str | None = "fold") -> DataFrame:
    """Dictionary matches -> predicted spans (doc_id, start, end, label[, fold]).

    Documents are dealt by id to blocks of about ``BLOCK_BYTES`` of text, however many there are.  The
    distinct runs of tokens of a block, as long as the heads of surfaces are, meet the index; most that
    begin no surface are dropped by ``head_marks`` before they are shuffled.  So a word is
    looked up once a block, not at each place it stands at, and a block gets the part of the
    dictionary that its own words call for, which is placed in its texts token by token.

    With ``fold_col`` an entry counts only if its surface was seen in another fold
    (k-fold without training k dictionaries).  Matches contained in an earlier or
    longer match are dropped; ATTR wins a label tie."""
    extra = [fold_col] if fold_col else []
    # feeds the marks, the lengths and the join
    index = cut_lineage(gazetteer_index(dictionary))
    marks = head_marks(index)
    lengths = sorted(r["n_head"] for r in index.select("n_head").distinct().collect())
    texts = text.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull()).select("doc_id", *extra, "text")
    blocks = 1 + (texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0) // BLOCK_BYTES
    docs = (texts.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)).cast("int")).repartition("block")
            .withColumn("lowered", F.lower("text")))
    heads = docs.groupBy("block").applyInArrow(_block_heads(lengths), "block int, head string")
    words = (_marked(heads, marks).join(index, "head").select("block", "surface_lc", "n_tokens", F.explode("entries").alias("e"))
             .select("block", "surface_lc", "n_tokens", "e.label", F.array_min("e.folds").alias("low"), F.array_max("e.folds").alias("high"))
             .where(F.col("label").isNotNull() & (F.lit(not fold_col) | F.col("low").isNotNull())))
    out = T.StructType([docs.schema[c] for c in ("doc_id", *extra)]
                       + [T.StructField(c, t) for c, t in (("start", T.IntegerType()), ("end", T.IntegerType()), ("label", T.StringType()), ("entity", T.StringType()))])
    schema = pa.schema([(f.name, to_arrow_type(f.dataType)) for f in out])
    return docs.groupBy("block").cogroup(words.groupBy("block")).applyInArrow(_block_spans(schema, fold_col), out)


# ---- N8 / A4 / C7 --------------------------------------------------------------------------
def clean_parentheses(c):
    """Strings starting with '(' or ')' lose every '('; others are unchanged."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c.startswith("(") | c.startswith(")"), F.replace(c, F.lit("("), F.lit(""))).otherwise(c)


def attr_list(predictions: DataFrame, key: str = "doc_id") -> DataFrame:
    """Distinct cleaned ATTR surfaces per document, sorted (the source's set order is undefined)."""
    a = predictions.where(F.col("label") == "ATTR").select(key, clean_parentheses("entity").alias("attr"))
    return a.groupBy(key).agg(F.array_sort(F.collect_set("attr")).alias("att_list"))
