import re

import pytest

from salvora.functions import flow, words as w
from salvora.functions.streams import box_texts, footnote, header_lines, item_list, item_paths, root_name
from tests.fixtures import ADV, WRAP, body, enc, header, para, raw, record, row, section, span


def numbered(style, level=None, restart=False):
    return record(0x10, 0, 0x26, 5, 0xA3, 2, style, *([0x7FFF] if restart else []), *([0x50, 2, level] if level else []), 0xFFFF, 0)


def test_runs_and_raw():
    assert w.plain_text(body(0x1F, "銀河鉄道")) == "銀河鉄道"
    assert w.plain_text(raw("生の本文\0のこり")) == "生の本文"
    assert w.plain_text(raw("三つ", 3)) == "三つ"
    assert w.plain_text(b"") == "" and w.plain_text(b"x") == ""


def test_inline_shown_and_hidden():
    shown = [0x1C, 1, 7, 0, 0, 1, 0x1D, "見える", 0x1E]
    hidden = [0x1C, 1, 7, 0, 1, 2, 0x1D, "ルビ", 0x1E]
    got = w.elements(body(0x1F, "前", shown, 0x1F, "中", hidden, 0x1F, "後"))
    assert [(e.kind, e.text) for e in got if e.kind != "boundary"] == [("run", "前"), ("inline", "見える"), ("run", "中"), ("skipped", "ルビ"), ("run", "後")]
    far = w.elements(body(0x1F, "前", hidden[:7], "あ" * 300, 0x1E))
    assert not [e for e in far if e.kind == "skipped"]


def test_lengths_that_look_like_markers():
    """A declared length of 31 words is 0x1F, that of 29 words 0x1D; neither is a part of the text."""
    for n in range(1, 40):
        text = "字" * n
        got = w.elements(raw(w.words_of(enc("前置", para(), text)), 3))
        assert "".join(e.text for e in got) == "前置" + text and not [e for e in got if e.kind == "boundary"]


def test_numbering():
    heads = [(1, 1), (1, 2), (1, 3), (2, None), (2, None), (8, 1), (8, 2), (3, None), (4, None)]
    text = w.plain_text(body(*[[numbered(s, lv), "x", ADV] for s, lv in heads]))
    assert re.split("x", text)[:-1] == ["第1章 ", "1.1 ", "1.1.1 ", "(1) ", "(2) ", "① ", "①-1 ", "(a) ", "1. "]
    assert w.plain_text(body(numbered(2), "x", ADV, numbered(2, restart=True), "y")) == "(1) x(1) y"
    assert w.circled(21) == "(21)" and w.lettered(27) == "(27)"


def test_stray_run_marker_is_no_run():
    assert w.plain_text(body(0x1F, "本文" + "。" * 20, 0x0B, "zzzz" * 5, 0x1F, "尾")) == "本文" + "。" * 20


def test_region_is_skipped_and_tail_trimmed():
    assert w.plain_text(body(0x1F, "あ", 0xFE01, 3, 2, "いう")) == "あいう"
    assert w.trim_tail("本文 \ufe14\u0490 ") == "本文" and w.trim_tail("本文 \n") == "本文 \n"


def test_prologue():
    data = b"SsmgV.01" + enc([0] * 5, 3) + b"TextV.01" + enc(0, 5, "前置", 0x1F, "本文")
    assert w.plain_text(data).startswith("前置")


def test_salvage():
    a, b = body(0x1F, "一つ目の行"), body(0x1F, "二つ目の行")
    found = w.salvage(b"junk" + a + b + a)
    assert found[1] == "一つ目の行\n二つ目の行" and found[0] == a + b"\0\0" + b
    assert w.salvage(b"nothing") is None
    assert not w.likely_line("  ") and w.likely_line("abcd\u0416") and not w.likely_line("abc\u0416")


def test_events():
    got = flow.events(body(para(), "段落", ADV, header(2), span(8, 40, 3, 2), "甲", WRAP, span(41, 80), "乙", ADV, section()))
    assert [e.kind for e in got] == ["ParagraphHeader", "Text", "RowAdvance", "RowHeader", "SpanDeclaration", "Text", "Wrap", "SpanDeclaration", "Text", "RowAdvance", "SectionTransition"]
    assert got[3].n == 2 and (got[4].left, got[4].right, got[4].flags, got[4].flags2) == (8, 40, 3, 2)
    assert [flow.declared(x) for x in (3, 7, 8, 2)] == [1, 2, None, None]


def test_concatenated_streams_number_anew():
    one = body(numbered(2), "x", ADV)
    assert [e.text for e in flow.events(one + one) if e.kind == "Text"] == ["(1) x", "(1) x"]


def test_walls():
    got = flow.walls(b"\x00\x09\xfe\x02\x02\x00\x03\x03\x02\x00\x01\x07")
    assert [(e.orientation, e.weight, e.side) for e in got] == [("Vertical", "Thick", "Leading"), ("Horizontal", "Thin", "Unknown")]


def test_events_keep_all_text():
    data = body(para(), "あ", row((8, 40, "甲"), (41, 80, "乙")), row((8, 40, "丙"), (41, 80, "丁")), para(), "終")
    assert "".join(e.text for e in flow.events(data) if e.kind == "Text") == re.sub(r"\s", "", w.plain_text(data))


def slot(text, size=None):
    units = b"TextV.01" + enc(0, len(text) if size is None else size, text)
    return units.ljust(256, b"\0")


def test_header_and_boxes():
    head = b"SsmgV.01" + enc([0] * 5, 2)
    assert header_lines(head + slot("- ? -") + slot("左\r\n")) == ["- 1 -", "左"]
    assert header_lines(head) is None and header_lines(head + b"TextV.01" + enc(0, 500, "x")) is None
    assert box_texts(head + slot("枠一") + slot("枠二")) == ["枠一", "枠二"]
    assert box_texts(b"SsmgV.01" + enc([0] * 5, 0)) == []
    assert box_texts(head + slot("枠一")) is None and box_texts(head + bytes(512)) is None


def test_footnote():
    label = [0x1C, 1, 7, 0, 0, 1, 0x1D, "*1", 0x1E]
    assert footnote(body(0x1F, label, 0x1F, "注釈", 0x0B, 0x1E, 0x1F, "続き", label, 0x1F, "次")) == "*1 注釈 続き\n*1 次"


def test_sheet_streams():
    name = "表紙"
    entry = lambda n, i: b"\1\0\0\0" + len(n).to_bytes(4, "little") + n.encode("utf-16-le") + i.to_bytes(4, "little") + bytes(26)
    assert item_list(b"\2\0\0\0" + entry("一", 3) + entry("二", 12)[:-20]) == [("一", 3), ("二", 12)]
    with pytest.raises(Exception):
        item_list(b"\2\0\0\0" + entry("一", 3))
    assert root_name(bytes(16) + len(name).to_bytes(4, "little") + name.encode("utf-16-le")) == name
    path = "C:\\a.jtd"
    assert item_paths(b"\0\0" + len(path).to_bytes(4, "little") + path.encode("utf-16-le")) == [path]


def test_odd_streams_take_linear_time():
    import time

    began = time.time()
    for data in (body(0x1F, "字", *[[0x1C, 0x1D, "x"]] * 20_000), body(0x1F, "字", *[0xFE01] * 100_000), body(0x1F, "字", *[[0xFE01, 3, 0x1F]] * 20_000), body(*[[0x1F, "字"]] * 20_000), body(*[[0x1C, 0x30, 9]] * 20_000)):
        w.elements(data)
        flow.events(data)
    assert time.time() - began < 20
