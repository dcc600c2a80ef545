import io

import pytest
from pyspark.sql import functions as F

from salvora import cli
from salvora.functions import page_grid
from salvora.functions.page_grid import Rule, cluster, page_tables, pipe
from salvora.functions.scrape import anchor, tables
from salvora.operators import alignment, corpus, flow_relational, grids, streams
from salvora.operators.components import connected_components
from salvora.plans import harness_catalog
from salvora.sources import sinks
from salvora.streaming.ingest import ingest
from tests.test_documents import PLAIN, WITH_TABLE


def test_normal_form_and_coverage(spark):
    one = spark.createDataFrame([("ＡＢＣ 　１２３\\-4\\-&#12;ｶﾅ**太字**─",)], "t string")
    assert one.select(corpus.normal_form(F.col("t"), export=True)).first()[0] == "ABC123カナ太字"
    odd = spark.createDataFrame([("a\u200bb\\\\–12\\—c\\-3-d &#x; **e\x00\x85\u00a0\u2591",)], "t string")
    assert odd.select(corpus.normal_form(F.col("t"), export=True)).first()[0] == "abc\\-3-d&#x;e"
    assert odd.select(corpus.strip_for_comparison(F.col("t"))).first()[0] == "ab\\\\–12\\—c\\-3-d&#x;**e"
    pairs = spark.createDataFrame([(1, "abc", "abcdef"), (2, "abcdefghij", "abcdefgh"), (3, "aaab", "aab"), (4, "", "x"), (5, None, None), (6, "ＡＢ　１", "AB 1"), (7, "\\-1-a**b", "x"), (8, "字字a", "字a")], "k int, a string, b string")
    assert [round(r.coverage, 4) for r in corpus.coverage(pairs, "k", "a", "b").orderBy("k").collect()] == [1.0, 0.8, 0.75, 1.0, 1.0, 1.0, 0.0, 0.6667]
    texts = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, None)], "k int, o int, t string")
    assert {tuple(r) for r in corpus.joined_exports(texts, "k", "o", "t").collect()} == {(1, "a\nb"), (2, "")}
    s = corpus.summary(spark.createDataFrame([("x", 1.0), ("x", 0.5), ("y", 0.96)], "category string, coverage double")).collect()
    assert {(r.category, r.files, r.passed) for r in s} == {("x", 2, 1), ("y", 1, 1), ("(all)", 3, 2)}
    assert corpus.report(spark.createDataFrame(s)).count() == 5


def test_pairs_and_categories(spark):
    docs = spark.createDataFrame([("d", "a"), ("d", "b"), ("e", "a")], "folder string, base string")
    exports = spark.createDataFrame([("d", "a"), ("d", "a_one_two"), ("d", "ab"), ("e", "x_a")], "folder string, base string")
    assert {tuple(r) for r in corpus.pair_by_name(docs, exports).collect()} == {("d", "a", "a"), ("d", "a", "a_one_two")}
    one, two = "e\u0301", "\u00e9"  # the same name, composed and not
    assert {tuple(r) for r in corpus.pair_by_name(spark.createDataFrame([("d", one)], "folder string, base string"), spark.createDataFrame([("d", f"{two}_x")], "folder string, base string")).collect()} == {("d", one, f"{two}_x")}
    lines = spark.createDataFrame([("# no",), ("",), ("one\tfolder",), ("short",)], "value string")
    assert [tuple(r) for r in corpus.configured_categories(lines).collect()] == [("one", "folder")]
    assert corpus.configured_categories(lines, spark.createDataFrame([("other",)], "folder string")).count() == 0
    named = spark.createDataFrame([("a", "x"), ("b", "/abs"), ("c", "y"), ("d", "z")], "category string, folder string")
    there = spark.createDataFrame([("/r/c/x",), ("/r/x",), ("/abs",), ("/y",), ("/r/y",)], "folder string")
    assert {tuple(r) for r in corpus.category_folders(named, there, "/r/c", "/r").collect()} == {("a", "/r/c/x"), ("b", "/abs"), ("c", "/r/y")}


def test_alignment(spark):
    assert alignment.match_names("文", ["一", "二", "三"], ["文_二シート", "文_一", "x三y", "z"]) == [1, 0, 2]
    assert alignment.match_names("x", ["概要"], ["x概要版", "概要"]) == [0]  # the first that fits by any rule
    assert alignment.match_names("x", ["概要", "概要"], ["概"]) == [None, None]
    sheets = spark.createDataFrame([("d", "d", 0, "一"), ("d", "d", 1, "二"), ("e", "e", 0, "q"), ("f", "f", 0, "s")], "doc_id string, base string, sheet_idx int, sheet string")
    exports = spark.createDataFrame([("d", 5, "他"), ("d", 7, "d_一"), ("f", 1, "f_s"), ("g", 1, "lone")], "doc_id string, export_idx int, export string")
    got = alignment.align(sheets, exports)
    assert {(r.doc_id, r.ord, r.sheet, r.export) for r in got.collect()} == {("d", 0, "一", "d_一"), ("d", 1, "二", None), ("d", 2, None, "他"), ("e", 0, "q", None), ("f", 0, "s", "f_s"), ("g", 0, None, "lone")}
    assert {tuple(r) for r in alignment.status(got).collect()} == {("d", "partial", 1, 2), ("e", "none", 0, 1), ("f", "full", 1, 1)}
    no_export, no_sheet = alignment.missing(got)
    assert sorted(r.line for r in alignment.report(got).collect()) == ["- d (partial): without export: 二; without sheet: 他", "- e (none): without export: q; without sheet: -"]
    assert no_export.count() == 2 and sorted(r.export for r in no_sheet.collect()) == ["lone", "他"]


def test_scrape(spark):
    html = "<tr><td>x</td></tr><table><tr><td rowspan=2>a \n b</td><td colspan='3'> c&amp;d&nbsp;</td><td> </td></tr><tr><th>x<br>y</td></th></tr><tr><td>open<td colspan=x>z</td></tr></table><table><tr></tr></table>"
    assert tables(html) == [[[("a b", 2, 1), ("c&d", 1, 3), ("", 1, 1)], [("xy", 1, 1)], [("z", 1, 1)]], [[]]]
    assert anchor(tables(html)[0][0]) == "ab|c&d" and anchor([]) == ""
    assert alignment.table_rows(spark.createDataFrame([(1, html), (2, None)], "k int, h string"), "k", "h").count() == 4


RULES = [Rule("h", y, 0, 100) for y in (0, 20.5, 40)] + [Rule("v", x, 0, 40) for x in (0, 100)] + [Rule("v", 50, 20, 40)]


def test_page_grid(spark):
    assert cluster([1, 1.5, 9, 10]) == [1.25, 9.5] and cluster([]) == []
    found, loose = page_tables(RULES, [(50, 10, "head"), (20, 30, "left"), (70, 30, "right"), (300, 300, "away")])
    assert len(found) == 1 and loose == ["away"]
    assert [(c.row, c.col, c.rowspan, c.colspan, c.texts) for c in found[0]] == [(0, 0, 1, 2, ["head"]), (1, 0, 1, 1, ["left"]), (1, 1, 1, 1, ["right"])]
    assert pipe(found[0]) == "| head |\n|---|---|\n| left | right |"
    pages = spark.createDataFrame([("d", 1, [(r.axis, float(r.at), float(r.low), float(r.high)) for r in RULES], [(20.0, 30.0, "left")])], "doc_id string, page int, rules array<struct<axis:string,at:double,low:double,high:double>>, spans array<struct<x:double,y:double,text:string>>")
    assert [r.text for r in alignment.page_cells(pages).orderBy("row", "col").collect()] == ["", "left", ""]


def slow_cells(rules):
    """All rectangles of structural axes, by the definition."""
    from salvora.functions import page_grid as g

    xs, ys = (g.axes([r for r in rules if r.axis == axis]) for axis in "vh")
    out = []
    for i, x0 in enumerate(xs):
        for j in range(i + 1, len(xs)):
            for k, y0 in enumerate(ys):
                for m in range(k + 1, len(ys)):
                    x1, y1 = xs[j], ys[m]
                    if any(x.covers(y0.at, y1.at) for x in xs[i + 1 : j]) or any(y.covers(x0.at, x1.at) for y in ys[k + 1 : m]):
                        continue
                    if (y0.covers(x0.at, x1.at) or y1.covers(x0.at, x1.at)) and (x0.covers(y0.at, y1.at) or x1.covers(y0.at, y1.at)):
                        out.append((x0.at, y0.at, x1.at, y1.at))
    out.sort(key=lambda c: -((c[2] - c[0]) * (c[3] - c[1])))
    kept = []
    for c in out:
        if not any(o[0] <= c[0] + 1 and o[1] <= c[1] + 1 and c[2] <= o[2] + 1 and c[3] <= o[3] + 1 for o in kept):
            kept.append(c)
    return {(c[2] - c[0]) * (c[3] - c[1]) for c in kept}, set(kept)


def test_page_cells_match_all_rectangles():
    import random

    rng = random.Random(3)
    for _ in range(300):
        rules = [Rule(rng.choice("hv"), rng.choice((0, 1, 10, 20, 30, 50)), a, a + rng.choice((2, 5, 10, 20, 40, 60))) for a in (rng.choice((0, 2, 10, 20, 26)) for _ in range(rng.randint(0, 14)))]
        areas, want = slow_cells(rules)
        got = page_grid.cells(rules)
        assert {c.area for c in got} == areas and len(got) == len(want)


def test_dots_corners_and_slack():
    dots = [Rule("h", 0, x, x + 2) for x in range(0, 60, 4)]
    box = [Rule("v", 0, 0, 30), Rule("v", 60, 0, 30), Rule("h", 30, 0, 60)]
    assert len(page_grid.cells(dots + box)) == 1 and not page_grid.axes(dots[:2]) and not page_grid.Axis(0, dots=[(0, 2), (3, 5), (6, 8)]).stands
    gap = page_grid.Axis(0, solid=[(0, 30), (31, 60)])
    assert gap.covers(0, 30) and not gap.covers(0, 60)  # rules do not join over a gap
    corner = [page_grid.GridCell(0, 0, 10, 10), page_grid.GridCell(10, 10, 20, 20), page_grid.GridCell(20, 12, 30, 18)]
    assert [len(g) for g in page_grid.groups(corner)] == [1, 2]
    assert page_tables(RULES, [(-0.5, 10, "out by half a point")])[0][0][0].texts == ["out by half a point"]


def test_grid_relations(spark):
    cells = spark.createDataFrame([(1, 1, 0.0, 0.0, 10.0, 10.0), (1, 2, 10.0, 0.0, 20.0, 10.0), (1, 3, 50.0, 50.0, 60.0, 60.0)], "page int, cell_id bigint, x0 double, y0 double, x1 double, y1 double")
    spans = spark.createDataFrame([(1, 7, 5.0, 5.0), (1, 8, 30.0, 30.0)], "page int, span_id int, x double, y double")
    took = grids.smallest_cells(cells, spans)
    assert {(r.span_id, r.cell_id) for r in took.collect()} == {(7, 1), (8, None)} and grids.unassigned(spans, took).count() == 1
    assert {tuple(r) for r in connected_components(grids.touching(cells)).collect()} == {(1, 1), (2, 1)}
    kind = "array<struct<low:double,high:double>>"
    axis = spark.createDataFrame([([(0.0, 8.0)], []), ([(0.0, 5.0), (5.5, 9.0)], []), ([], [(0.0, 2.0), (4.0, 6.0), (8.0, 9.0)]), ([], [(0.0, 2.0), (8.0, 9.0)])], f"s {kind}, d {kind}")
    assert [r[0] for r in axis.select(grids.axis_covers(F.col("s"), F.col("d"), F.lit(0.0), F.lit(9.0))).collect()] == [True, False, True, False]
    rows = spark.createDataFrame([(1, 2, [(5,), (6,), (7,)]), (1, 1, [(1,), (9,), (1,), (1,)]), (1, 3, [(0,), (6,), (0,)]), (1, 0, [(1,), (2,)])], "tbl int, row_idx int, spans array<struct<w:int>>")
    assert [tuple(r) for r in grids.band_widths(rows).orderBy("ord").collect()] == [(1, 0, 1), (1, 1, 6)]
    diff = grids.anchor_diff(spark.createDataFrame([("a",), ("b",), ("c",), ("",)], "x string"), spark.createDataFrame([("a",), ("d",)], "x string"), "x")
    assert tuple(grids.anchor_share(diff).first()) == (1, 3, 33)


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}


def test_numbers(spark):
    n = spark.range(30)
    got = {r.id: (r.a, r.b) for r in n.select("id", streams.circled(F.col("id").cast("int")).alias("a"), streams.lettered(F.col("id").cast("int")).alias("b")).collect()}
    assert got[1] == ("①", "(a)") and got[20][0] == "⑳" and got[21][0] == "(21)" and got[26][1] == "(z)" and got[27][1] == "(27)" and got[0] == ("(0)", "(0)")
    assert [r[0] for r in n.select(flow_relational.declared_spans(F.col("id"))).limit(9).collect()] == [None, None, None, 1, None, None, None, 2, None]


def test_size_guards_round_prices(spark, tmp_path):
    """Prices become whole numbers as in the SQL: the nearest, of two equally near ones the even one."""
    rows = [(1, 262144.6), (2, 262144.4), (3, 262144.5), (4, 262145.5), (5, 65536.5), (6, 65536.51), (29_999, 119996.7), (29_999, 119996.2), (7, None)]
    spark.createDataFrame(rows, "o_orderkey bigint, o_totalprice double").write.parquet(f"{tmp_path}/orders.parquet")
    got = [tuple(r) for r in harness_catalog.size_guards(spark, str(tmp_path)).collect()]
    big, ratio = "LH5 decompressed bytes", "LH5 expansion ratio output"
    assert sorted(got, key=str) == sorted([(1, big), (2, ratio), (3, ratio), (4, big), (5, None), (6, ratio), (29_999, ratio), (29_999, None), (7, None)], key=str)


def test_sinks_and_stream(spark, tmp_path):
    page = spark.createDataFrame([("<html><head></head></html>",), ("<body>x",), ("<html>y",), ("z",)], "x string")
    assert [r[0] for r in page.select(sinks.styled(F.col("x"), "c")).collect()] == ["<html><head><style>c</style></head></html>", "<style>c</style><body>x", "<html><style>c</style>y", "<style>c</style>z"]
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.jtd").write_bytes(PLAIN)
    put = lambda: ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    put()
    (tmp_path / "in/b.jtd").write_bytes(WITH_TABLE)
    put()
    docs = spark.read.parquet(str(tmp_path / "out"))
    assert docs.count() == 2
    sinks.write_golden(docs, str(tmp_path / "golden"))
    assert spark.read.csv(str(tmp_path / "golden/manifest.tsv"), sep="\t").count() == 2


@pytest.mark.parametrize(("args", "code"), [([], 2), (["-q", "x"], 2), (["-t", "/nothing"], 1), (["-h"], 0)])
def test_cli_codes(args, code):
    assert cli.run(args, io.StringIO(), io.StringIO()) == code


def test_cli(tmp_path):
    (tmp_path / "a.jtd").write_bytes(WITH_TABLE)
    outs = {}
    for what in ("-t", "-x", "-m", "-J", "list", "magic", "dump"):
        outs[what] = io.StringIO()
        assert cli.run([what, str(tmp_path / "a.jtd"), str(tmp_path / "dumped")], outs[what], io.StringIO()) == 0
    assert "銀河帯" in outs["-t"].getvalue() and "<table>" in outs["-x"].getvalue() and "/DocumentText" in outs["list"].getvalue()
    assert (tmp_path / "dumped/_DocumentText").is_file()
    (tmp_path / "b.jtd").write_bytes(b"broken")
    assert cli.run(["-t", str(tmp_path / "b.jtd")], io.StringIO(), io.StringIO()) == 1
