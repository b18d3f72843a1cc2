r"""Chat formatting with a grammar round trip.

    conversation := turn+        turn := "<|im_start|>" role "\n" text "<|im_end|>" "\n"

A conversation is rendered as it stands and read back by a deterministic parser.  If the
turns read back differ from the source, because a role or text holds control strings, it is
rendered again with these escaped, and read back once more.  Escaping adds one backslash
between "<" and "|" (also where some stand there already), so it is reversible and no
control string is left; a line end in a role becomes "<|nl|>".

Only DataFrame operations are used.  A conversation is one row of the result, so its turns
meet in one row; everything before that is per turn.

Defined results: null role and null text count as empty; turns are ordered by turn (null
first), then role and text; repeated rows are turns of their own; rows of null conv_id are
one conversation; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END, LINE = "<|im_start|>", "<|im_end|>\n", "<|nl|>"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit(LINE))


def render_turn(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"), text, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>>, or null where the grammar does not hold: a piece that does
    not begin a turn, control strings inside a role or text, or a last turn without its end."""
    pieces = F.split(formatted, r"<\|im_end\|>\n", -1)
    turns = F.slice(pieces, F.lit(1), F.size(pieces) - 1)
    after = lambda x: F.substr(x, F.lit(len(START) + 1))
    role = lambda x: F.substring_index(after(x), "\n", 1)
    text = lambda x: F.substr(x, F.length(role(x)) + len(START) + 2)
    sound = lambda x: F.startswith(x, F.lit(START)) & F.contains(after(x), F.lit("\n")) & ~F.contains(text(x), F.lit("<|")) & ~F.contains(F.replace(role(x), F.lit(LINE), F.lit("\n")), F.lit("<|"))
    read = F.transform(turns, lambda x: F.struct(unescape(F.replace(role(x), F.lit(LINE), F.lit("\n"))).alias("role"), unescape(text(x)).alias("text")))
    return F.when((F.element_at(pieces, -1) == "") & F.forall(turns, sound), read)


def format_conversations(turns: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, escaped (whether control strings had to
    be escaped), loss_spans (start, stop: code points of ``formatted`` that a loss covers, the
    texts of ``loss_roles``), parsed (the turns read back from ``formatted``) and identical
    (whether they equal the source)."""
    src = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    role, text = F.col("role"), F.col("text")
    spans = {}
    for kind, r, t in (("plain", role, text), ("safe", escape_role(role), escape(text))):
        stop = F.sum(F.length(r) + F.length(t) + len(START) + 1 + len(END)).over(upto) - len(END)
        spans[kind] = F.struct((stop - F.length(t)).alias("start"), stop.alias("stop"))
    rows = src.select("conv_id", "role", "text", F.row_number().over(order).alias("n"), *[s.alias(k) for k, s in spans.items()])
    conv = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("n", "role", "text", "plain", "safe"))).alias("turns"))
    source = F.transform("turns", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text")))
    whole = lambda f, g: F.array_join(F.transform("turns", lambda x: render_turn(f(x["role"]), g(x["text"]))), "")
    same = lambda x: x
    conv = conv.withColumn("plain", whole(same, same)).withColumn("escaped", ~parse(F.col("plain")).eqNullSafe(source))
    conv = conv.withColumn("formatted", F.when(F.col("escaped"), whole(escape_role, escape)).otherwise(F.col("plain")))
    loss = F.transform(F.filter("turns", lambda x: x["role"].isin(*loss_roles)), lambda x: F.when(F.col("escaped"), x["safe"]).otherwise(x["plain"]))
    conv = conv.withColumn("loss_spans", loss).withColumn("parsed", parse(F.col("formatted"))).withColumn("identical", F.col("parsed").eqNullSafe(source))
    return conv.select("conv_id", "formatted", "escaped", "loss_spans", "parsed", "identical")


def digest(formatted: DataFrame) -> DataFrame:
    """Columns of the contract, all read back from the formatted text: turns from the parser,
    the loss text from the code points under ``loss_spans``."""
    spoken = F.array_join(F.transform("parsed", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    masked = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), (s["stop"] - s["start"]).cast("int")))), "")
    return (formatted.withColumn("masked", masked)
            .select("conv_id", F.size("parsed").cast("long").alias("n_turns"), F.sha2(spoken, 256).alias("turns_sha256"),
                    F.length("masked").cast("long").alias("loss_chars"), F.sha2("masked", 256).alias("loss_sha256"),
                    F.length("formatted").cast("long").alias("formatted_chars"), "escaped", "identical"))
