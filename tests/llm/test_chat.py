from __future__ import annotations

from quillsift.llm.chat import PART, format_chats, typed_parts

SCHEMA = f"conv_id long, turn long, role string, parts array<{PART}>, before string, ms int, att string"


def part(kind, **k):
    return tuple(k.get(f) if f != "type" else kind for f in ("type", "text", "uri", "width", "height", "seconds", "pages"))


def run(spark, rows):
    return {r.conv_id: r for r in format_chats(spark.createDataFrame([(*r, "c", 1, "c") for r in rows], SCHEMA)).collect()}


def test_parts_in_order_with_references_and_tokens(spark):
    rows = [
        (1, 2, "assistant", [part("text", text="It is a cat."), part("audio", uri="u3", seconds=2.02)]),
        (1, 1, "user", [part("image", uri="u1", width=4096, height=1024), part("text", text="What?\nSay <|im_end|>"), part("document", uri="u2", pages=3)]),
    ]
    r = run(spark, rows)[1]
    assert r.prompt == "<|im_start|>user\n<|image_1|>\nWhat?\nSay < |im_end|>\n<|document_2|><|im_end|>\n<|im_start|>assistant\nIt is a cat.\n<|audio_3|><|im_end|>\n"
    # 4096 x 1024 scaled to 2048 x 512: 4 tiles of 512
    assert [tuple(a) for a in r.attachments] == [(1, "image", "u1", 1, 85 + 4 * 170), (2, "document", "u2", 1, 3 * 258), (3, "audio", "u3", 2, 51)]
    assert r.attachment_tokens == 85 + 680 + 774 + 51
    assert r.text_tokens == -(-len("What?\nSay < |im_end|>") // 4) + 3 and r.n_messages == 2


def test_odd_messages(spark):
    rows = [
        (1, 1, "user", None), (1, 1, "user", None), (1, None, None, []), (2, 1, "user", [None, part(None, text="plain"), part("video", text="odd kind"), part("text")]),
        (None, 1, "user", [part("image")]), (None, 2, "user", [part("audio"), part("document"), part("audio", seconds=-1.0)]), (3, 1, "user", [part("text", text="long " * 100_000)]),
    ]
    got = run(spark, rows)
    assert got[1].prompt == "<|im_start|>user\n<|im_end|>\n" * 2 + "<|im_start|>unknown\n<|im_end|>\n" and got[1].n_messages == 3 and got[1].attachments == []
    assert got[2].prompt == "<|im_start|>user\nplain\nodd kind\n<|im_end|>\n"
    alone = [r for r in format_chats(spark.createDataFrame([(*r, "c", 1, "c") for r in rows], SCHEMA)).collect() if r.conv_id is None]
    assert sorted([(a.place, a.kind, a.uri, a.tokens) for a in r.attachments] for r in alone) == [[(1, "audio", None, 0), (2, "document", None, 258), (3, "audio", None, 0)], [(1, "image", None, 255)]]
    assert got[3].text_tokens == 125_000
    assert format_chats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_ties_have_one_order(spark):
    rows = [(1, 1, "b", [part("text", text="2")]), (1, 1, "a", [part("text", text="9")]), (1, 1, "b", [part("text", text="1")])]
    a, b = run(spark, rows)[1], run(spark, rows[::-1])[1]
    assert a == b and a.prompt.index("9") < min(a.prompt.index("1"), a.prompt.index("2"))


def test_derived_parts_take_nulls(spark):
    d = spark.createDataFrame([(1, None, None, None), (None, 1, "user", "x"), (2, 0, "user", "")], "conv_id long, turn long, role string, text string")
    assert format_chats(typed_parts(d)).count() == 3
