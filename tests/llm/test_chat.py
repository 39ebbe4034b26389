import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from possum.llm import chat

ROWS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "a <s>[INST] \\ b"), (1, 2, "assistant", "</s>[/INST]<<SYS>>\\\\"),
    (2, 0, "assistant", "first"), (2, 1, "user", None), (2, 1, "user", None),
    (3, 5, "tool[INST]", "x"), (3, None, None, "no turn"), (None, 0, "user", ""), (None, 1, "assistant", "é" * 10), (4, 0, "user", "alone"),
]


def turns(rows):
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or ""))
    return [(r[2] or "", r[3] or "") for r in order]


def test_digests_match_the_input(spark):
    df = spark.createDataFrame([(*r, "x") for r in ROWS], "conv_id long, turn long, role string, text string, state string")
    got = {r.conv_id: r for r in chat.conversation_digests(chat.format_turns(df)).collect()}
    assert set(got) == {1, 2, 3, 4, None}
    for conv in got:
        t = turns([r for r in ROWS if r[0] == conv])
        loss = "".join(x for role, x in t if role == "assistant")
        assert got[conv].n_turns == len(t)
        assert got[conv].turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest()
        assert (got[conv].loss_chars, got[conv].loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
        assert got[conv].formatted_chars > sum(len(x) for _, x in t)
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: False, 3: False, 4: False, None: True}


def test_empty(spark):
    df = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.conversation_digests(chat.format_turns(df)).count() == 0


PIECES = st.lists(st.sampled_from([*chat.Template().marks, "\\", "<", "[", "s>", "INST]", "/", "a", " ", "\n", "é"]), max_size=12).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool"]) | PIECES, PIECES), max_size=6))
def test_round_trip(conversation):
    m = chat.Machine(chat.Template())
    segments = [s for role, text in conversation for s in m.segments(role, text)]
    assert list(m.read("".join(x for x, _ in segments))) == conversation
    assert "".join(m.unescape(x) for x, loss in segments if loss) == "".join(t for r, t in conversation if r == "assistant")


@pytest.mark.parametrize("text", ["x", "[INST]a", "[INST]a</s>", "[INST]a[/INST]b", "[/INST]", "<<ROLE>>r<</TURN>>"])
def test_text_that_is_no_conversation(text):
    with pytest.raises(ValueError):
        list(chat.Machine(chat.Template()).read(text))


def test_own_template(spark):
    t = chat.Template(turns={"user": ("<u>", "</u>"), "bot": ("<b>", "</b>")}, loss_roles=frozenset({"bot", "user"}), order={"start": {"user": "u"}, "u": {"bot": "start"}}, final=frozenset({"start"}))
    df = spark.createDataFrame([(1, 0, "user", "<u>"), (1, 1, "bot", "ok")], "conv_id long, turn long, role string, text string")
    r = chat.conversation_digests(chat.format_turns(df, t), t).first()
    assert r.valid and r.loss_chars == 5 and r.formatted_chars == len("<u><\\u></u><b>ok</b>")


def test_marks_that_run_into_each_other_are_refused():
    for marks in (("##", "@@"), ("<a>", "><"), ("<a>", "x<a>y"), ("ab", "bc"), ("<b>", "<b>>")):
        with pytest.raises(ValueError):
            chat.Machine(chat.Template(turns={"user": marks}))
    chat.Machine(chat.Template())
