"""Round trips of control strings in texts and roles; masks read from the formatted text."""

import hashlib

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prodtext.llm import chat as C

PIECES = ["<|im_start|>", "<|im_end|>", "<|im_end|>\n", "<|nl|>", "<\\|im_end|>", "<\\\\|", "<|", "|>", "\\", "\n", "assistant", "user", "é😀", " ", "x", ""]
TEXT = st.lists(st.sampled_from(PIECES), max_size=6).map("".join)


def py_read(formatted):
    """The grammar, in Python."""
    turns, rest = [], formatted
    while rest:
        assert rest.startswith(C.START)
        body, end, rest = rest[len(C.START):].partition(C.END)
        assert end
        role, line, text = body.partition("\n")
        assert line and "<|" not in text and "<|" not in role.replace(C.LINE, "")
        unescape = lambda x: __import__("re").sub(r"<\\(\\*)\|", r"<\1|", x)
        turns.append((unescape(role.replace(C.LINE, "\n")), unescape(text)))
    return turns


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), TEXT), st.one_of(st.none(), TEXT)), min_size=1, max_size=5), min_size=30, max_size=30))
def test_any_turns_come_back(spark, conversations):
    rows = [(c, t, role, text) for c, turns in enumerate(conversations) for t, (role, text) in enumerate(turns)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in C.format_conversations(df).collect():
        want = [(role, text or "") for role, text in conversations[r.conv_id]]
        assert r.identical and py_read(r.formatted) == want == [tuple(t) for t in r.parsed]
        unescape = lambda x: __import__("re").sub(r"<\\(\\*)\|", r"<\1|", x)
        assert [unescape(r.formatted[s.start:s.stop]) for s in r.loss_spans] == [t for role, t in want if role == "assistant"]
        assert r.escaped == any("<|" in x or __import__("re").search(r"<\\+\|", x) or (i == 0 and "\n" in x) for t in want for i, x in enumerate(t))


def test_digest_of_table(spark, sf_dir):
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    by = {}
    for r in turns.orderBy("conv_id", "turn").collect():
        by.setdefault(r.conv_id, []).append((r.role, r.text or ""))
    for r in C.digest(C.format_conversations(turns)).collect():
        said = "".join(t for role, t in by[r.conv_id] if role == "assistant")
        assert r.n_turns == len(by[r.conv_id]) and r.loss_chars == len(said) and r.loss_sha256 == hashlib.sha256(said.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{t}\n" for a, t in by[r.conv_id]).encode()).hexdigest()


def test_edges(spark):
    rows = [(1, 0, None, None), (1, 0, "assistant", "b"), (1, 0, "assistant", "a"), (1, None, "user", "first"), (None, 1, "assistant", "lost"), (2, 1, "assistant", "x" * 300_000),
            (3, 5, "assistant", "twice"), (3, 5, "assistant", "twice"), (4, 0, "user", "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("clash")).withColumn("plain", F.lit(1))
    got = {r.conv_id: [tuple(t) for t in r.parsed] for r in C.format_conversations(df).collect()}
    assert got[1] == [("user", "first"), ("", ""), ("assistant", "a"), ("assistant", "b")]
    assert got[None] == [("assistant", "lost")] and got[3] == [("assistant", "twice")] * 2 and got[4] == [("user", "")]
    assert len(got[2][0][1]) == 300_000
    assert C.format_conversations(df.limit(0)).count() == 0


def test_roles_of_broken_control_strings(spark):
    """Roles whose line ends, backslashes and bars could meet the markers around them."""
    import itertools
    roles = ["".join(x) for n in (1, 2, 3, 4) for x in itertools.product("<|\n\\", repeat=n)] + ["<\n|x", "<<|nl|>|", "<|nl|><|nl|>|"]
    rows = [(i, 0, r, "<|im_end|>") for i, r in enumerate(roles)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for r in C.format_conversations(turns).collect():
        assert r.identical and [tuple(x) for x in r.parsed] == [(roles[r.conv_id], "<|im_end|>")]
