import re

import pytest

from salvora.functions import flow, words as w
from salvora.functions.render import markdown, plain, xhtml
from salvora.functions.tables import assemble
from tests.fixtures import ADV, WRAP, body, header, para, row, section, span


def show(*units):
    data = body(*units)
    blocks = assemble(flow.events(data))
    html = xhtml(blocks)
    text = re.sub("<br/>|<[^>]*>", "", html)
    count = lambda s: sorted(re.sub(r"\s", "", s))
    assert count(text) == count(w.plain_text(data))  # no text is lost
    for t in re.findall("<table>.*?</table>", html):
        widths = grid_widths(t)
        assert len(set(widths)) == 1, (widths, t)  # every row covers the grid
    return html


def grid_widths(table):
    held, out = {}, []
    for r, tr in enumerate(re.findall("<tr>(.*?)</tr>", table)):
        n = held.get(r, 0)
        for attrs in re.findall("<td([^>]*)>", tr):
            c = int(re.search('colspan="(\\d+)"', attrs).group(1)) if "colspan" in attrs else 1
            rs = int(re.search('rowspan="(\\d+)"', attrs).group(1)) if "rowspan" in attrs else 1
            n += c
            for k in range(1, rs):
                held[r + k] = held.get(r + k, 0) + c
        out.append(n)
    return out


A, B, C = (8, 40), (41, 80), (81, 120)


def test_stable_grid_between_paragraphs():
    html = show(para(), "はじめ", row((*A, "銀河帯"), (*B, "けぶった")), row((*A, "天上"), (*B, "白い")), para(), "おわり")
    assert html == "<p>はじめ</p><table><tbody><tr><td>銀河帯</td><td>けぶった</td></tr><tr><td>天上</td><td>白い</td></tr></tbody></table><p>おわり</p>"


def test_row_header_opens_a_table():
    html = show(row((*A, "甲"), (*B, "乙"), head=2), section(), para(), "後")
    assert html == "<table><tbody><tr><td>甲</td><td>乙</td></tr></tbody></table><p>後</p>"


def test_no_false_table():
    assert "<table>" not in show(para(), "本文", ADV, row((*A, "ただ一つ")), para(), "次", ADV)
    assert "<table>" not in show(row((*A, "甲"), (*B, "乙")), para(), "続き")


def test_tall_row_merges_with_a_seam():
    html = show(row((*A, "一"), (*B, "長い"), wraps=(1,), head=2), row((*A, ""), (*B, "続き"), head=2), row((*A, "二"), (*B, "次"), head=2))
    assert html == "<table><tbody><tr><td>一</td><td>長い<br/>続き</td></tr><tr><td>二</td><td>次</td></tr></tbody></table>"


def test_merge_of_two_full_rows():
    html = show(row((*A, "一"), (*B, "長い"), wraps=(0, 1), head=2), row((*A, "目"), (*B, "続き"), head=2), section())
    assert html == "<table><tbody><tr><td>一<br/>目</td><td>長い<br/>続き</td></tr></tbody></table>"


def test_closed_cell_begins_a_new_row():
    html = show(row((*A, "一"), (*B, "済"), wraps=(0,), head=2), row((*A, "二"), (*B, "次"), head=2, flags=((0xFF,), (3,))), section())
    assert html.count("<tr>") == 2


def test_colspan_and_padding():
    html = show(row((*A, "一"), (*B, "二"), (*C, "三"), head=3), row((8, 80, "広い"), (*C, "右"), head=2), row((*A, "左"), (*C, "端"), head=2))
    rows = re.findall("<tr>(.*?)</tr>", html)
    assert rows[1] == '<td colspan="2">広い</td><td>右</td>' and rows[2] == "<td>左</td><td></td><td>端</td>"


def test_rowspan_by_slot_drop():
    html = show(row((*A, "高い"), (*B, "一"), (*C, "x"), head=3), row((*B, "二"), (*C, "y"), head=2), row((*B, "三"), (*C, "z"), head=2), section())
    assert '<td rowspan="3">高い</td>' in html


def test_single_cell_row_inside_a_table():
    html = show(row((*A, "一"), (*B, "二"), head=2), row((8, 80, "全幅")), row((*A, "三"), (*B, "四"), head=2), section())
    assert html.count("<tr>") == 3 and '<td colspan="2">全幅</td>' in html


def test_pending_head_row_is_adopted():
    assert show(row((*A, "見出し"), (*B, "列")), row((*A, "一"), (*B, "二"), head=2), section()).count("<tr>") == 2
    assert show(row((9, 40, "関係"), (42, 80, "なし")), row((*A, "一"), (*B, "二"), head=2), section()).startswith("<p>関係なし</p>")


def test_vertical_band():
    html = show(row((*A, "時"), (*B, "一"), head=2), row((*A, "天"), (*B, "国"), wraps=(0, 1)), row((*A, "気"), (*B, "語"), wraps=(0,)), row((*A, "輪"), (*B, "算数")), section())
    assert "天気" in html


def test_phantom_edge_column_goes():
    html = show(row((0, 6, ""), (*A, "一"), (*B, "二"), head=3), row((0, 6, ""), (*A, "三"), (*B, "四"), head=3), section())
    assert html == "<table><tbody><tr><td>一</td><td>二</td></tr><tr><td>三</td><td>四</td></tr></tbody></table>"


def test_escapes_and_other_renderings():
    blocks = assemble(flow.events(body(row((*A, "<a&b>"), (*B, "二"), head=2), row((*A, "三"), (*B, "四"), head=2))))
    assert "&lt;a&amp;b&gt;" in xhtml(blocks)
    assert markdown(blocks) == "| <a&b> | 二 |\n| --- | --- |\n| 三 | 四 |"
    assert plain(blocks) == "<a&b>\t二\n三\t四"


def test_random_streams_lose_no_text():
    import random

    rng = random.Random(4)
    for _ in range(300):
        units = []
        for _ in range(rng.randint(1, 14)):
            k = rng.random()
            if k < 0.15:
                units += [para(), rng.choice(["段落", "", " "]), ADV]
            elif k < 0.2:
                units += [section()]
            else:
                xs = sorted(rng.sample(range(32, 152, 8), rng.randint(1, 4)))
                cells = [(x, x + rng.choice((3, 6, 7, 15, 30)), rng.choice(["字", "二字", "", "12", "ab", " 下げ", " "])) for x in xs]
                units += row(*cells, wraps=[i for i in range(len(cells)) if rng.random() < 0.4], head=rng.choice((0, len(cells))), flags=[(rng.choice((0xFF, 3, 1)), rng.choice((0, 2)))] * len(cells))
        data = body(units)
        html = xhtml(assemble(flow.events(data)))
        count = lambda s: sorted(re.sub(r"\s", "", s))
        assert count(re.sub("<[^>]*>", "", html)) == count(w.plain_text(data))
