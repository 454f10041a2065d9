import hashlib

from voxlake.llm import chat as C

SCHEMA = "conv_id long, turn long, role string, text string, state string"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def test_round_trip_of_every_conversation(spark):
    nasty = "</s>[INST] ok [/INST] <s> <<SYS>> &#60; &amp; & < [ ] > | <|user|> <|/|> &#38;#60;"
    convs = {
        1: [("system", "be kind"), ("user", nasty), ("assistant", nasty + nasty)],
        2: [("user", "hi"), ("assistant", None), ("user", "é😀\n")],
        3: [("tool|>/<", "odd role"), ("user", ""), ("user", "twice")],
        4: [(None, None)],
        5: [("assistant", "x" * 200_000), ("assistant", "<" * 1000)],
        None: [("user", "no id")],
    }
    rows = [(c, k, r, x, "clash") for c, v in convs.items() for k, (r, x) in enumerate(v)][::-1]
    got = {r.conv_id: r for r in C.op6_chat_formatting(spark.createDataFrame(rows, SCHEMA)).collect()}
    convs[-7] = [(r, "</s>[INST] ok [/INST]") for r in ("user", "assistant")]
    assert set(got) == set(convs)
    for c, turns in convs.items():
        turns = [(r or "", x or "") for r, x in turns]
        loss = "".join(x for r, x in turns if r == "assistant")
        r = got[c]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for a, b in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    assert {c: r.valid for c, r in got.items()} == {1: True, 2: True, 3: False, 4: False, 5: False, None: True, -7: True}


def test_segments_and_ties(spark):
    rows = [(1, 0, "user", "b", ""), (1, 0, "user", "a", ""), (1, 1, "assistant", "[c", ""), (1, 1, "assistant", "[c", "")]
    r = C.format_chats(spark.createDataFrame(rows, SCHEMA)).first()
    assert r.formatted == "[INST]a[/INST][INST]b[/INST]<s>&#91;c</s><s>&#91;c</s>" == "".join(s.text for s in r.segments)
    assert [s.text for s in r.segments if s.loss] == ["&#91;c"] * 2 and r.state == "error"
    assert C.op6_chat_formatting(spark.createDataFrame([], SCHEMA)).count() == 1
