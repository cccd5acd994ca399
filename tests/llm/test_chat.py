"""Preferences: prefixes, masks and odd conversations."""

import pytest

from heddle.llm.chat import conversations, format_preferences, worse_replies

SCHEMA = "id long, chosen array<struct<role:string,text:string>>, rejected array<struct<role:string,text:string>>, prompt string"


def render(turns):
    return "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for r, t in turns)


def brute(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n, render(a[:n]), render(a[n:]), render(b[n:])


@pytest.mark.parametrize(
    "a,b",
    [
        ([("user", "q"), ("assistant", "x")], [("user", "q"), ("assistant", "y")]),
        ([("user", "q")], [("user", "other"), ("assistant", "é漢🙂")]),
        ([("user", "q"), ("assistant", "x")], [("user", "q")]),
        ([("user", "q"), ("assistant", "x"), ("user", "z"), ("assistant", "w")], [("user", "q"), ("assistant", "x"), ("user", "z"), ("assistant", "v"), ("assistant", "u")]),
        ([("user", "q")], [("user", "q")]),
        ([], [("assistant", "x")]),
        ([], []),
    ],
)
def test_pairs(spark, a, b):
    r = format_preferences(spark.createDataFrame([(1, a, b, "old")], SCHEMA)).first()
    assert (r.n_prompt_turns, r.prompt, r.chosen_text, r.rejected_text) == brute(a, b)
    assert r.identical == (a == b)
    for text, mask, turns in ((r.chosen_text, r.chosen_mask, a), (r.rejected_text, r.rejected_mask, b)):
        spans = [text[int(x) : int(y)] for x, y in (s.split("-") for s in mask.split(",") if s)]
        assert spans == [f"{t}<|im_end|>" for role, t in turns[r.n_prompt_turns :] if role == "assistant"]


def test_null_conversations(spark):
    r = format_preferences(spark.createDataFrame([(1, None, [("user", "a")], None)], SCHEMA)).first()
    assert (r.n_prompt_turns, r.prompt, r.chosen_text, r.rejected_text) == (0, "", "", render([("user", "a")]))


def test_worse_replies_and_odd_turns(spark):
    rows = [
        (1, 1, "assistant", "a1"), (1, 0, "user", "u"), (1, 2, "user", "v"), (1, 3, "assistant", "a2"), (1, 4, "user", "bye"),
        (2, 0, "user", "only <|im_end|> user"), (3, 0, "assistant", None), (4, 0, None, "x"), (4, None, "assistant", "late"),
        (5, 0, "user", "q"), (5, 0, "user", "q"), (5, 1, "assistant", "q"), (None, 0, "user", "nobody"),
    ]
    df = spark.createDataFrame([(*r, 1) for r in rows], "conv_id long, turn long, role string, text string, turns int")
    got = {r.id: (r.chosen, r.rejected) for r in worse_replies(conversations(df)).collect()}
    plain = lambda ts: [(t.role, t.text) for t in ts]
    assert plain(got[1][1]) == [("user", "u"), ("assistant", "a1"), ("user", "v"), ("assistant", "a1")]
    assert plain(got[1][0])[-1] == ("user", "bye")
    assert plain(got[2][0]) == plain(got[2][1]) == [("user", "only < |im_end|> user")]
    assert plain(got[3][0]) == plain(got[3][1]) == [("assistant", "")]
    assert plain(got[4][1]) == [("unknown", "x"), ("assistant", "x")]
    assert plain(got[5][0]) == plain(got[5][1]) and len(got[5][0]) == 3
    assert plain(got[None][0]) == [("user", "nobody")]
    assert worse_replies(conversations(df.limit(0))).count() == 0


def test_very_long_turns(spark):
    long = "<|word " * 300_000
    turns = [(1, 0, "user", long), (1, 1, "assistant", "short"), (1, 2, "user", "more"), (1, 3, "assistant", long)]
    got = format_preferences(worse_replies(conversations(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")))).first()
    assert got.n_prompt_turns == 3 and got.rejected_text == "<|im_start|>assistant\nshort<|im_end|>\n"
    assert got.chosen_text == "<|im_start|>assistant\n" + long.replace("<|", "< |") + "<|im_end|>\n" and got.prompt.startswith("<|im_start|>user\n< |word < |word")
