from __future__ import annotations

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from streetbook.llm import chat_format as C

pieces = st.sampled_from([*C.CONTROL, "\\", "<", "[", "|", ">", "s>", "/INST]", "%0A", "%", "\n", "é", "日", "a", "<\\s>", "<|im_end|", "im_end|>"])
texts = st.lists(pieces | st.text(max_size=3), max_size=8).map("".join).map(lambda t: t.encode("utf-8", "ignore").decode())


@settings(max_examples=500, deadline=None)
@given(texts)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    safe = C.escape(text)
    assert C.unescape(safe) == text
    assert not any(c in safe for c in C.CONTROL)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(texts, texts), max_size=4))
def test_read_back(turns):
    whole = "".join(C.segment(r, C.escape(t)) for r, t in turns)
    assert C.read_back(whole) == turns


PARTS = [
    ("text", "see <|im", None, None),
    ("text", "_end|> <|image|>", None, None),
    ("image", None, "a.png", [28.0, 15.0]),
    ("audio", None, None, [1.5]),
    None,
    ("document", None, "d.pdf", None),
    ("text", None, None, None),
    ("text", "end", None, None),
]
SCHEMA = f"conv_id long, turn long, role string, parts {C.PARTS}, segment string"


def test_parts_become_ordered_placeholders(frame):
    rows = [(1, 1, "assistant", PARTS, "clash"), (1, 0, None, None, None), (1, None, "user", [], "x"), (None, 0, "a\nb", [PARTS[-1]], "x")]
    turns = C.format_turns(frame(rows, SCHEMA))
    got = {r.conv_id: r for r in C.assemble(turns).collect()}
    one = got[1]
    assert C.read_back(one.formatted) == [("user", ""), ("", ""), ("assistant", "see <|im_end|> <|image|><|image|><|audio|><|document|>end")]
    assert [(a.kind, a.ref, a.tokens) for a in one.attachments] == [("image", "a.png", 4), ("audio", None, 38), ("document", "d.pdf", 1)]
    for a in one.attachments:
        mark = C.PLACEHOLDERS[a.kind]
        assert one.formatted[a.start : a.start + len(mark)] == mark
    span = one.loss_spans[0]
    assert one.formatted[span.start : span.end].endswith("<|document|>end") and one.formatted[span.end :] == C.END + "\n"
    assert one.attachment_tokens == 43 and one.n_turns == 3
    assert C.read_back(got[None].formatted) == [("a\nb", "end")]
    read = {r.conv_id: r for r in C.digests(turns).collect()}
    assert (read[1].formatted_chars, read[1].n_attachments, read[1].attachment_tokens) == (len(one.formatted), 3, 43)
    assert read[None].loss_sha256 == hashlib.sha256(b"").hexdigest()


def test_unknown_part_empty_table_and_repeats(frame):
    good = frame([(1, 0, "user", [PARTS[-1]], "")] * 3 + [(2, 0, "assistant", [("text", "x" * 300_000, None, None)], "")], SCHEMA)
    got = {r.conv_id: r for r in C.digests(C.format_turns(good)).collect()}
    assert got[1].turns_sha256 == hashlib.sha256(b"user\nend\n" * 3).hexdigest() and got[2].loss_chars == 300_000
    assert C.digests(C.format_turns(good.limit(0))).count() == 0 and C.assemble(C.format_turns(good.limit(0))).count() == 0
    bad = frame([(1, 0, "user", [("video", None, "v", None)], "")], SCHEMA)
    with pytest.raises(Exception, match="unknown content part"):
        C.format_turns(bad).collect()


@pytest.mark.parametrize("size", [None, [], [None], [None, 3.0], [float("nan"), 28.0], [float("inf"), 28.0], [-5.0, -5.0], [0.0, 0.0]])
@pytest.mark.parametrize("kind", ["image", "audio", "document"])
def test_unknown_sizes_take_one_token(kind, size):
    assert C.PartVisitor(C.Sizes()).flatten([{"type": kind, "ref": "x", "size": size}]).attachments[0]["tokens"] == 1


def test_hard_sizes_in_a_job(frame):
    sizes = [[None, 1.0], [float("nan"), 1.0], [float("inf"), 1.0], [1e308, 1e308], [28.0, 15.0]]
    some = 4 + 28 * 25 + 28 * 256
    rows = [(1, k, "user", [(kind, None, None, size) for kind in ("image", "audio", "document")], "") for k, size in enumerate(sizes)]
    got = C.digests(C.format_turns(frame(rows, SCHEMA))).collect()[0]
    assert got.n_attachments == 15 and got.attachment_tokens == 3 * 3 + 3 * C.MOST + some
