"""Language identification by interpolated Kneser-Ney character models.

Each language has a model of ``ORDER`` characters, counted over all of its training texts.
The highest order uses the counts themselves, lower orders the number of different characters
that come before; each order gives up one discount, estimated from the numbers of n-grams
seen once and twice, to the next lower one, and the lowest to a uniform share.  Texts are
reduced to lower-case letters and single blanks.

Tasks count the n-grams of their texts, Spark sums them and derives everything else; all
n-grams of all orders are kept, in tables of the shared folder.  To judge texts, the distinct
n-grams that occur in them are joined to these tables order by order, which gives each its
log-probability in every language.  The result is dealt by hash into slices of at most
``SLICE_BYTES``; the texts are read once for each slice, a sorted hash array of which is all that
goes to the tasks, and what the slices say is summed.  So memory is bounded and the model grows with
the corpus.  A text gets the language of the lowest cross-entropy per character.
Rejection is calibrated on all training texts: a text is rejected if its cross-entropy exceeds
what all but a share ``reject`` of its language's training texts reach, rounded up to 1/``STEPS`` nat.

Defined results: null texts and texts without a letter are ``und`` with score 0; without any
training text every text is ``und``; ties go to the language that comes first by code point;
repeated rows are judged alike; an empty table gives an empty result; a long text is read in
pieces, whose n-grams are those of the whole text; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prodtext.llm.common import cut, free_name, gathered, release, ship

ORDER = 4  # of 16-bit characters: an n-gram is one 64-bit integer
CHUNK = 1 << 21  # characters handled at once
STEPS = 10_000  # in a nat, of the counts that rejection limits come from
SLICE_BYTES = 32 << 20  # of n-grams and their log-probabilities, shipped at once
_FOLD: list[np.ndarray] = []


def _fold() -> np.ndarray:
    """Code point to itself in lower case if it is a letter, else to a blank.  Letters beyond
    16 bits share the 6400 code points of the private use area."""
    if not _FOLD:
        table = np.full(0x110000, 32, dtype=np.uint16)
        for c in range(0x110000):
            x = chr(c)
            if x.isalpha():
                low = x.lower()
                c = ord(low) if len(low) == 1 else c
                table[ord(x)] = c if c < 0x10000 else 0xE000 + c % 6400
        _FOLD.append(table)
    return _FOLD[0]


def _codes(text: str, after_blank: bool) -> np.ndarray:
    """Folded code points, words apart by one blank."""
    codes = _fold()[np.frombuffer(text.encode("utf-32-le", "replace"), dtype=np.uint32)]
    blank = codes == 32
    return codes[~(blank & np.concatenate(([after_blank], blank[:-1])))]


def letters(text: str) -> np.ndarray:
    """Folded code points, words apart by one blank, ORDER - 1 blanks before and one behind;
    empty if there is no letter."""
    codes = _codes(text, True) if text else np.empty(0, np.uint16)
    if not len(codes):
        return codes
    ends = [] if codes[-1] == 32 else [32]
    return np.concatenate((np.full(ORDER - 1, 32, np.uint16), codes, ends)).astype(np.uint16)


def grams(codes: np.ndarray) -> np.ndarray:
    """Every ORDER-gram as a 64-bit integer, the first character highest."""
    out = codes[:len(codes) - ORDER + 1].astype(np.uint64)
    for i in range(1, ORDER):
        out = out << np.uint64(16) | codes[i:len(codes) - ORDER + 1 + i]
    return out


def pieces(text: str) -> Iterator[np.ndarray]:
    """``grams(letters(text))``, CHUNK characters of the text at a time."""
    last = np.full(ORDER - 1, 32, np.uint16)
    any_letter = False
    for at in range(0, len(text), CHUNK):
        codes = _codes(text[at:at + CHUNK], last[-1] == 32)
        if len(codes):
            any_letter = True
            codes = np.concatenate((last, codes))
            yield grams(codes)
            last = codes[len(codes) - ORDER + 1:]
    if any_letter and last[-1] != 32:
        yield grams(np.append(last, np.uint16(32)))


def _gram_counts(train: DataFrame) -> DataFrame:
    """(lang, gram, n) of all training texts (lang, text): one row for each task and n-gram."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: dict[str, list[np.ndarray]] = {}
        counted: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

        def count(lang: str) -> None:
            parts = pending.pop(lang, [])
            if parts:
                counted.setdefault(lang, []).append(np.unique(np.concatenate(parts), return_counts=True))
            if len(counted.get(lang, [])) > 8:
                counted[lang] = [merged(lang)]

        def merged(lang: str) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([k for k, _ in counted[lang]]), return_inverse=True)
            return keys, np.bincount(place, np.concatenate([n for _, n in counted[lang]])).astype(np.int64)

        def rows(langs) -> Iterator[pa.RecordBatch]:
            for lang in langs:
                count(lang)
                keys, n = merged(lang) if lang in counted else (np.empty(0, np.uint64), np.empty(0, np.int64))
                counted.pop(lang, None)
                for at in range(0, len(keys), 1 << 16):
                    k = keys[at:at + (1 << 16)]
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.view(np.int64)), pa.array(n[at:at + (1 << 16)])], ["lang", "gram", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text")):
                for piece in pieces(text.as_py()):
                    pending.setdefault(lang, []).append(piece)
                    if sum(map(len, pending[lang])) > CHUNK:
                        count(lang)
            if sum(len(k) for c in counted.values() for k, _ in c) > 4_000_000:  # bounds a task's memory
                yield from rows(list(counted))
        yield from rows(sorted({*pending, *counted}))

    return train.select("lang", "text").mapInArrow(run, "lang string, gram long, n long")


def _mask(n: int) -> Column:
    return F.lit((1 << 16 * n) - 1)


def _by_lang(values: dict) -> Column:
    """The value of the row's language, as a literal: a language is never a join key."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), F.col("lang"))


@dataclass
class Model:
    """Languages in code-point order, their rejection limits (nats a character), the number of
    different characters, and for each order from 1 up two tables in the shared folder: (gram,
    values), by language the discounted share of the n-gram after its context, and (context,
    values), by language the share that the context gives to the next lower order."""

    langs: list[str]
    characters: int = 0
    tables: list[tuple[DataFrame, DataFrame]] = field(default_factory=list)
    limit: list[float] = field(default_factory=list)


def _values(df: DataFrame, key: str, value: Column) -> DataFrame:
    """(key, values): a map from language number to value, one entry for each language at most."""
    return df.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(F.col("place"), value))).alias("values"))


def learn(train: DataFrame) -> Model:
    """The model of (lang, text) rows, without rejection limits.  Only some figures for each
    language come to the driver."""
    table = cut(_gram_counts(gathered(train)).groupBy("lang", "gram").agg(F.sum("n").alias("n")), "langid-grams")
    types = table.count()
    langs = sorted((r[0] for r in table.select("lang").distinct().collect()), key=lambda x: x.encode("utf-8", "surrogatepass"))
    model = Model(langs, limit=[float("inf")] * len(langs))
    if not langs:
        return model
    seen = lambda k: F.sum((F.col("n") == k).cast("long"))
    whole = Window.partitionBy("place", "context")  # at most as many rows as there are characters
    for n in range(ORDER, 0, -1):
        spare = {lang: min(max(ones / max(ones + 2 * twos, 1), 0.1), 0.9) for lang, ones, twos in table.groupBy("lang").agg(seen(1), seen(2)).collect()}
        rows = table.select(_by_lang({x: i for i, x in enumerate(langs)}).alias("place"), _by_lang(spare).alias("spare"), "gram", "n", F.shiftrightunsigned("gram", 16).alias("context"))
        shares = _values(rows.withColumn("all", F.sum("n").over(whole)), "gram", F.greatest(F.col("n") - F.col("spare"), F.lit(0.0)) / F.col("all"))
        gives = rows.groupBy("place", "context").agg((F.first("spare") * F.count(F.lit(1)) / F.sum("n")).alias("give"))
        model.tables.insert(0, (cut(shares, "langid-shares", rows=types), cut(_values(gives, "context", F.col("give")), "langid-gives", rows=types)))
        if n > 1:
            table = cut(table.groupBy("lang", F.col("gram").bitwiseAND(_mask(n - 1)).alias("gram")).agg(F.count(F.lit(1)).alias("n")), "langid-grams", rows=types)
    model.characters = model.tables[0][0].count()
    return model


def log_probabilities(grams: DataFrame, model: Model) -> DataFrame:
    """(gram, logp): for each distinct ORDER-gram, its log-probability by language."""
    wanted = [grams.select("gram")]
    for n in range(ORDER - 1, 0, -1):
        wanted.insert(0, wanted[0].select(F.col("gram").bitwiseAND(_mask(n)).alias("gram")).distinct())
    lower = None
    for n, (want, (shares, gives)) in enumerate(zip(wanted, model.tables), 1):
        rows = (want.withColumn("context", F.shiftrightunsigned("gram", 16)).withColumn("rest", F.col("gram").bitwiseAND(_mask(n - 1)))
                .join(shares.withColumnRenamed("values", "shares"), "gram", "left").join(gives.withColumnRenamed("values", "gives"), "context", "left"))
        if lower is None:
            rows = rows.withColumn("lower", F.array_repeat(F.lit(1.0 / (model.characters + 1)), len(model.langs)))
        else:
            rows = rows.join(lower.select(F.col("gram").alias("rest"), F.col("p").alias("lower")), "rest")
        of = lambda c, i, default: F.coalesce(F.try_element_at(F.col(c), i), F.lit(default))
        lower = rows.select("gram", F.transform("lower", lambda x, i: of("shares", i, 0.0) + of("gives", i, 1.0) * x).alias("p"))
    return lower.select("gram", F.transform("p", lambda x: F.log(x).cast("float")).alias("logp"))


_ODD = np.uint64(0x9E3779B97F4A7C15)


class HashArray:
    """Sorted 64-bit hashes (an odd multiple of the n-gram, so different n-grams never share
    one) with an index by their first bits."""

    def __init__(self, keys: np.ndarray):
        self.hashes = np.sort(keys.astype(np.uint64) * _ODD)
        self.bits = max(1, int(len(keys)).bit_length() + 1)
        firsts = np.arange(1 << self.bits, dtype=np.uint64) << np.uint64(64 - self.bits)
        self.first = np.searchsorted(self.hashes, firsts).astype(np.int64)
        self.keys = self.hashes * np.uint64(pow(int(_ODD), -1, 1 << 64))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Place of each key, -1 if absent."""
        if not len(self.hashes):
            return np.full(len(keys), -1, dtype=np.int64)
        h = keys * _ODD
        at = self.first[(h >> np.uint64(64 - self.bits)).astype(np.int64)]
        last = len(self.hashes) - 1
        seen = self.hashes[np.minimum(at, last)]
        behind = np.flatnonzero((seen < h) & (at < last))
        while len(behind):
            at[behind] += 1
            behind = behind[(self.hashes[at[behind]] < h[behind]) & (at[behind] < last)]
        at = np.minimum(at, last)
        return np.where(self.hashes[at] == h, at, -1)


class Slice:
    """A sorted hash array of n-grams with their log-probabilities by language."""

    def __init__(self, keys: np.ndarray, logp: np.ndarray):
        self.index = HashArray(keys)
        self.logp = logp[np.argsort(keys * _ODD)]

    def sums(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Characters predicted of each text, and sums (text, language) over those in this slice."""
        n, total = np.zeros(len(texts), dtype=np.int64), np.zeros((len(texts), self.logp.shape[1]))
        held, of, size = [], [], 0

        def flush():
            nonlocal held, of, size
            if held:
                at = self.index.find(np.concatenate(held))
                logs = np.where((at >= 0)[:, None], self.logp[at], np.float32(0)) if len(self.logp) else np.zeros((len(at), self.logp.shape[1]))
                firsts = np.concatenate(([0], np.cumsum([len(x) for x in held])[:-1]))
                np.add.at(total, of, np.add.reduceat(logs, firsts, axis=0, dtype=np.float64))
            held, of, size = [], [], 0

        for i, text in enumerate(texts):
            for piece in pieces(text or ""):
                held.append(piece)
                of.append(i)
                n[i] += len(piece)
                size += len(piece)
                if size > CHUNK // 4:
                    flush()
        flush()
        return n, total


def entropies(docs: DataFrame, model: Model, keep: str, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Column ``keep`` of (keep, text) rows, n (characters predicted) and entropy (nats a character, by
    language).  A slice's rows pass the driver, at most ``slice_bytes`` of them."""
    spark, n_langs = docs.sparkSession, len(model.langs)
    docs = docs.select(keep, "text")
    occurring = _gram_counts(gathered(docs.where("text IS NOT NULL").select(F.lit("").alias("lang"), "text"))).select("gram").distinct()
    scores = cut(log_probabilities(cut(occurring, "langid-occurring"), model), "langid-scores")
    slices = max(1, -(-scores.count() * (8 + 4 * n_langs) // slice_bytes))
    row = free_name(docs, "row")
    if slices > 1:  # the sums of several slices meet by a written id
        docs = cut(gathered(docs).withColumn(row, F.monotonically_increasing_id()), "langid-rows")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text")
    parts = []
    for i in range(slices):
        found = scores.where(F.pmod(F.xxhash64("gram"), F.lit(slices)) == i).toArrow()
        logp = found.column("logp").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n_langs)
        shared = ship(spark, Slice(found.column("gram").to_numpy().view(np.uint64), logp))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            part = shared()
            for b in batches:
                n, total = part.sums(b.column("text").to_pylist())
                b = b.drop_columns("text")
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(n), pa.array(list(total), pa.list_(pa.float64()))], [*b.schema.names, "n", "total"])

        part = docs.mapInArrow(run, f"{kinds}, n long, total array<double>")
        if slices > 1:
            part = cut(part.withColumn("slice", F.lit(i)), "langid-sums")
            release(spark, shared)
        parts.append(part)
    if slices > 1:
        every = parts[0]
        for part in parts[1:]:
            every = every.unionByName(part)
        nothing = F.array_repeat(F.lit(0.0), n_langs)
        sums = F.aggregate(F.array_sort("totals"), nothing, lambda a, x: F.zip_with(a, x["total"], lambda u, v: u + v))
        every = every.groupBy(keep, row).agg(F.first("n").alias("n"), F.collect_list(F.struct("slice", "total")).alias("totals")).withColumn("total", sums)
    else:
        every = parts[0]
    return every.select(keep, "n", F.transform("total", lambda x: -x / F.greatest(F.col("n"), F.lit(1))).alias("entropy"))


def limits(own: DataFrame, reject: float) -> DataFrame:
    """(lang, limit) of (lang, own) rows: the least step that all but a share ``reject`` of a language's
    rows stay at or below.  Every row counts; a language has as many counts as it has steps, not rows."""
    steps = own.groupBy("lang", F.ceil(F.col("own") * STEPS).alias("step")).agg(F.count(F.lit(1)).alias("n"))
    whole = Window.partitionBy("lang")
    steps = steps.withColumn("below", F.sum("n").over(whole.orderBy("step"))).withColumn("all", F.sum("n").over(whole))
    return steps.where(F.col("below") >= F.col("all") * (1.0 - reject) - 1e-6).groupBy("lang").agg((F.min("step") / STEPS).alias("limit"))


def fit(docs: DataFrame, train: Column, reject: float = 0.01) -> Model:
    """The model of all languages, from all rows of (doc_id, lang, text) that ``train`` marks."""
    train_rows = docs.where(train & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    model = learn(train_rows)
    if not model.langs:
        return model
    place = {x: i for i, x in enumerate(model.langs)}
    own = entropies(train_rows, model, "lang").where("n > 0").withColumn("own", F.element_at("entropy", _by_lang({x: i + 1 for x, i in place.items()})))
    for lang, limit in limits(own, reject).collect():
        model.limit[place[lang]] = limit
    return model


def identify(docs: DataFrame, model: Model, slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: share of the language if 20 characters spoke as the
    whole text does on average), cross_entropy and rejected of every document."""
    if not model.langs:
        return docs.select("doc_id", F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(None).cast("double").alias("cross_entropy"), F.lit(True).alias("rejected"))
    found = entropies(docs, model, "doc_id", slice_bytes).withColumn("least", F.array_min("entropy")).withColumn("place", F.array_position("entropy", F.col("least")).cast("int"))
    others = F.aggregate("entropy", F.lit(0.0), lambda a, x: a + F.exp(20 * (F.col("least") - x)))
    of = lambda values: F.element_at(F.array(*[F.lit(x) for x in values]), F.col("place"))
    known = F.col("n") > 0
    return found.select("doc_id", F.when(known, of(model.langs)).otherwise("und").alias("lang_pred"), F.when(known, 1 / others).otherwise(0.0).alias("score"),
                        F.when(known, F.col("least")).alias("cross_entropy"), F.when(known, F.col("least") > of(model.limit)).otherwise(True).alias("rejected"))
