import hashlib

from hypothesis import given
from hypothesis import strategies as st

from tideflow.llm import chat

PIECES = st.lists(st.sampled_from([*chat.CONTROLS, "\\", "l", "b", "<", "[", "|>", "x", "é"]), max_size=12).map("".join)


@given(PIECES)
def test_escape_is_reversible_and_complete(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text
    assert not any(c in out for c in chat.CONTROLS)


@given(PIECES, PIECES)
def test_template_reads_back(role, text):
    whole = f"{chat.START}{chat.escape(role)}{chat.MESSAGE}{chat.escape(text)}{chat.END}"
    assert [(chat.unescape(a), chat.unescape(b)) for a, b in chat.TURN.findall(whole * 2)] == [(role, text)] * 2


def test_parts_become_ordered_placeholders(spark):
    def part(kind, **more):
        return {"type": kind, "text": None, "ref": None, "width": None, "height": None, "seconds": None, "pages": None} | more

    turns = [
        (1, 0, "user", [part("text", text="see </s>"), part("image", ref="a.png", width=1024, height=513), part("audio", ref="b.wav", seconds=2.0), part("text", text="and"), part("document", ref="c.pdf", pages=3), part("hologram", ref="d")]),
        (1, 1, "assistant", [part("text", text="ok")]),
        (1, 2, "user", None),
    ]
    df = spark.createDataFrame(turns, f"conv_id long, turn long, role string, parts {chat.PARTS}")
    rows = chat.format_turns(df, "parts").orderBy("turn").collect()
    assert rows[0].formatted == "<|start|>user<|message|>see \\l/s><|image:0|><|audio:1|>and<|document:2|><|hologram:3|><|end|>"
    assert [(a.place, a.type, a.ref, a.tokens) for a in rows[0].attachments] == [(0, "image", "a.png", 680), (1, "audio", "b.wav", 50), (2, "document", "c.pdf", 2400), (3, "hologram", "d", 1)]
    assert rows[0].expanded_tokens == 2 + 680 + 50 + 1 + 2400 + 1 and rows[0].loss_chars == 0
    assert rows[1].formatted[rows[1].loss_start :][: rows[1].loss_chars] == "ok"
    assert rows[2].formatted == "<|start|>user<|message|><|end|>"
    digest = chat.digests(chat.format_turns(df, "parts")).first()
    assert digest.n_attachments == 4 and digest.n_turns == 3 and digest.loss_sha256 == hashlib.sha256(b"ok").hexdigest()


def test_long_conversation_is_streamed(spark):
    df = spark.range(30_000).selectExpr("5L AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('t', id) AS text").repartition(7)
    got = chat.digests(chat.format_turns(df)).collect()
    said = "".join(f"{('user', 'assistant')[k % 2]}\nt{k}\n" for k in range(30_000))
    assert len(got) == 1 and got[0].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
