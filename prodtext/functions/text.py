"""Column expressions shared by the operators (all JVM-side, codegen friendly)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Python's str.title()/istitle() treat every non-cased character as a word break.
_CASED = r"\p{Lu}\p{Ll}\p{Lt}"
# istitle() as three searches without a repeated group, linear in the text on either engine:
# some cased letter; no upper-case letter behind a cased one; no lower-case one elsewhere
ISTITLE_CASED = rf"[{_CASED}]"
ISTITLE_BROKEN = rf"[{_CASED}][\p{{Lu}}\p{{Lt}}]|(^|[^{_CASED}])\p{{Ll}}"
# fixed values: what Python's str.split() and str.strip() take as white space
WS = r"[\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
SENTENCE_BREAK = rf"([.!?]){WS}+"
SEP = "\u0001"


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def title_case(c) -> Column:
    """Python ``str.title()``: capitalise after every non-letter, lower the rest."""
    chunks = F.regexp_extract_all(col(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(chunks, lambda x: F.initcap(x)), "")


def is_title(c) -> Column:
    """Python ``str.istitle()`` (false for strings without cased letters)."""
    return col(c).rlike(ISTITLE_CASED) & ~col(c).rlike(ISTITLE_BROKEN)


def replace_all(c, pairs) -> Column:
    out = col(c)
    for a, b in pairs:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def sentence_split(c) -> Column:
    """Split after ., ! or ? followed by whitespace (punctuation kept on the left piece)."""
    marked = F.regexp_replace(col(c), SENTENCE_BREAK, "$1" + SEP)
    return F.split(marked, SEP)


def word_array(c) -> Column:
    """Python ``str.split()``: split on runs of whitespace, no empty words."""
    return F.filter(F.split(col(c), WS + "+"), lambda w: w != "")


def syllable_estimate(c) -> Column:
    """Vowel-group count, at least 1."""
    return F.greatest(F.lit(1), F.regexp_count(F.lower(col(c)), F.lit("[aeiouy]+")))


def metric_normalize(c) -> Column:
    """Drop <h2>, </h2>, <br>; trim; lower; collapse runs of >= 2 whitespace to one space."""
    t = replace_all(col(c), [("<h2>", ""), ("</h2>", ""), ("<br>", "")])
    return F.regexp_replace(F.lower(strip_ws(t)), f"{WS}{WS}+", " ")


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (not only spaces)."""
    return F.regexp_replace(col(c), rf"^{WS}+|{WS}+\z", "")


def hash_bucket(seed, *keys) -> Column:
    """Deterministic 32-bit bucket: first 8 hex digits of md5(seed|key...)."""
    parts = [F.lit(str(seed))] + [col(k).cast("string") for k in keys]
    h = F.md5(F.concat_ws("|", *parts))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("bigint")


def ordered_join(struct_list: Column, field: str, sep: str) -> Column:
    """array_join of ``field`` after sorting a collected array of structs by its first field."""
    return F.array_join(F.transform(F.array_sort(struct_list), lambda s: s[field]), sep)
