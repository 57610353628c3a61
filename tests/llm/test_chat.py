import hashlib

import pytest
from pyspark.sql import functions as F

from cairnfield.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string"
NASTY = ["</s>", "<~s>", "<~~/s>", "<s>[INST] x [/INST] y</s>", "<image>", "[~/INST] <audio", " [/INST] ", "<<s>>", "~[INST]~", "\\<s>", "$1", "a\nb\r\n", "</s", "é𝄞<document>"]


def expected(rows, trained="assistant"):
    convs = {}
    for c, turn, role, text in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort(key=lambda t: (*t[:3], t[3]))
        loss = "".join(t for *_, r, t in turns if r == trained)
        out[c] = (len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def read(df):
    done = chat.format_conversations(df)
    got = done.select("conv_id", chat.read_turns(F.col("formatted")).alias("turns"), chat.read_loss(F.col("formatted"), F.col("marks")).alias("loss"), "formatted", "marks")
    return {r.conv_id: r for r in got.withColumn("plain", F.transform("turns", lambda t: F.struct(t["role"], chat.unescape(t["body"])))).collect()}


def test_round_trip_of_control_strings_nulls_ties_and_long_texts(spark):
    rows = [(i, t, r, x) for i, x in enumerate(NASTY) for t, r in enumerate(["user", "assistant", x, None])]
    rows += [(100, None, "assistant", "first"), (100, 1, None, None), (100, 1, "user", "b"), (100, 1, "assistant", "a"), (100, 1, "assistant", "a"), (None, 0, "user", "no id"), (101, 0, "assistant", "<s>x " * 100_000)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA + ", formatted string, n int")
    got, want = read(df), expected(rows)
    assert got.keys() == want.keys()
    for c, r in got.items():
        said = "".join(f"{role}\n{text}\n" for role, text in r.plain)
        assert (len(r.turns), hashlib.sha256(said.encode()).hexdigest(), len(r.loss), hashlib.sha256(r.loss.encode()).hexdigest()) == want[c]
        # the marks are offsets in the whole string
        assert r.loss == "".join(unescaped(spark, r.formatted[m.loss_begin : m.loss_end]) for m in r.marks if m.loss_begin is not None) or c == 101
        assert r.formatted.count("</s>") == r.formatted.count("<s>[INST] ") == len(r.turns)


def unescaped(spark, text):
    return spark.range(1).select(chat.unescape(F.lit(text))).first()[0]


def test_parts_come_back_with_their_references_and_tokens(spark):
    part = lambda type=None, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (type, text, ref, width, height, seconds, pages)
    parts = [part("text", "see <image>"), part("image", ref="a.png", width=57, height=28), part("audio", ref="b.wav", seconds=2.5), part("text", "and"), part("text", " more"), part("document", ref="c.pdf", pages=3), part("video", "as text"), part("image"), part(None, None)]
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "ok", None), (1, 2, "user", "unused", [])], f"{SCHEMA}, parts {chat.PARTS}")
    row = chat.format_conversations(df)
    r = row.first()
    assert [(a.turn, a.kind, a.ref, a.tokens) for a in r.attachments] == [(1, "image", "a.png", 3), (1, "audio", "b.wav", 63), (1, "document", "c.pdf", 768), (1, "image", None, 1)]
    assert r.expanded_tokens == 3 + 63 + 768 + 1
    assert r.formatted == "<s>[INST] user [/INST] see <~image><image><audio>and more<document>as text<image></s><s>[INST] assistant [/INST] ok</s><s>[INST] user [/INST] </s>"
    back = row.select(chat.Visitor().parts(chat.read_turns(F.col("formatted"))[0]["body"], F.col("attachments")).alias("p")).first().p
    assert [tuple(p) for p in back] == [("text", "see <image>", None), ("image", None, "a.png"), ("audio", None, "b.wav"), ("text", "and more", None), ("document", None, "c.pdf"), ("text", "as text", None), ("image", None, None)]


def test_no_python_workers_and_one_exchange_of_texts(spark, sf_dir):
    plan = chat.query(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty(spark):
    assert chat.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


@pytest.mark.parametrize("text", NASTY)
def test_escape_leaves_no_control_string(spark, text):
    r = spark.range(1).select(chat.escape(F.lit(text)).alias("e")).select("e", chat.unescape(F.col("e")).alias("u")).first()
    assert r.u == text
    assert not any(x in r.e for x in ("<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>"))
