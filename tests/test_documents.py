import re

import pytest

from salvora.functions import embedded
from salvora.functions.document import LOOSE, OTHER, PACKED, TEXT, UNKNOWN, detect_format, read_document
from salvora.functions.limits import Limits
from salvora.sources import documents as src
from salvora.sources.compound import MAGIC, CompoundFile, write_compound
from tests.fixtures import body, enc, para, row, section, wrapped
from tests.test_text import slot

TABLE = body(para(), "はじめ", row((8, 40, "銀河帯"), (41, 80, "けぶった"), head=2), row((8, 40, "天上"), (41, 80, "白い"), head=2), section())
PLAIN = write_compound({"/DocumentText": body(0x1F, "銀河鉄道の夜")})
WITH_TABLE = write_compound({"/DocumentText": TABLE, "/Header": b"SsmgV.01" + enc([0] * 5, 1) + slot("頁 ?"), "/LayoutBoxText": b"SsmgV.01" + enc([0] * 5, 1) + slot("枠"), "/Footnote": body(0x1F, "注")})
COMPRESSED = write_compound({"/JSCompDocument": wrapped(PLAIN)})


def sheet_file():
    entry = lambda n, i: b"\1\0\0\0" + len(n).to_bytes(4, "little") + n.encode("utf-16-le") + i.to_bytes(4, "little") + bytes(26)
    root = bytes(16) + (2).to_bytes(4, "little") + "表紙".encode("utf-16-le")
    return write_compound({"/DocumentText": body(0x1F, "根"), "/ObjectSheets/SheetInfo": root, "/ObjectSheets/DocSheet/DocItemInfo": b"\1\0\0\0" + entry("内訳", 7), "/ObjectSheets/DocSheet/DOCS_0007/DocumentText": body(0x1F, "枝")})


def damaged():
    data = bytearray(PLAIN)
    fat = 512 + 512 * int.from_bytes(data[76:80], "little")
    first_dir = int.from_bytes(data[48:52], "little")
    data[fat + 4 * first_dir : fat + 4 * first_dir + 4] = b"\xff\xff\xff\x7f"
    return bytes(data)


def test_formats():
    assert [detect_format(x) for x in (PLAIN, COMPRESSED, b"text", MAGIC + bytes(600), damaged(), write_compound({"/x": b"SsmgV.01"}))] == [TEXT, PACKED, UNKNOWN, OTHER, LOOSE, LOOSE]


def test_bodies():
    assert read_document(PLAIN).text == read_document(COMPRESSED).text == "銀河鉄道の夜"
    d = read_document(damaged())
    assert (d.text, d.source) == ("銀河鉄道の夜", "/EmbeddedDocumentText")


def test_errors_are_columns():
    assert read_document(b"text").error_kind == "Unsupported"
    assert read_document(write_compound({"/x": b"SsmgV.01"})).error_kind == "NotFound"
    d = read_document(PLAIN, Limits(input_bytes=10))
    assert (d.error_kind, d.limit_resource, d.limit_value, d.limit_actual) == ("ResourceLimit", "input bytes", 10, len(PLAIN))
    assert read_document(COMPRESSED, Limits(total_bytes=5)).error_kind == "ResourceLimit"


def test_xhtml_of_a_whole_document():
    d = read_document(WITH_TABLE)
    assert d.xhtml == "頁 1\n\n<p>はじめ</p><table><tbody><tr><td>銀河帯</td><td>けぶった</td></tr><tr><td>天上</td><td>白い</td></tr></tbody></table>\n\n<p>注</p>\n※枠内テキスト\n<div class=\"layout-box\"><p>枠</p></div>"
    assert d.combined.endswith("\n\n注") and d.markdown.startswith("頁 1")


def test_sheets():
    d = read_document(sheet_file())
    assert d.combined == "表紙\n根\n\n内訳\n枝"
    assert re.findall("<h2>(.*?)</h2>", d.xhtml) == ["表紙", "内訳"] and d.xhtml.count('<div class="sheet">') == 2


def objects_file():
    emf = b"\1\0\0\0" + bytes(36) + b" EMF" + bytes(60)
    return write_compound({
        "/DocumentText": body(0x1F, "x"), "/Objects/Embedding 2/Contents": b"12345\x89PNG\r\n\x1a\nrest", "/Objects/Embedding 1/Workbook": b"\x09\x08" + bytes(20), "/Objects/Embedding 1/\x03EmbeddedPress": b"METAFILE\0\0" + emf,
        "/Objects/OleItem/Contents": b"no image", "/Objects/Embedding 2/deep/Contents": b"\xff\xd8\xff", "/Other/Contents": b"GIF89a",
    })


def test_objects():
    got = embedded.objects(CompoundFile(objects_file()))
    assert [(o.idx, o.name, o.path) for o in got] == [(1, "embedded-1.xls", "/Objects/Embedding 1/Workbook"), (2, "embedded-2.emf", "/Objects/Embedding 1/\x03EmbeddedPress"), (3, "embedded-3.png", "/Objects/Embedding 2/Contents")]
    assert CompoundFile(got[0].payload).read("/Workbook")[:2] == b"\x09\x08"
    many = write_compound({f"/Embedding {i:03d}/Contents": b"GIF89a" for i in range(70)})
    assert len(embedded.objects(CompoundFile(many))) == 64
    assert len(embedded.objects(CompoundFile(objects_file()), lambda t: t == "image/png")) == 1


MAGICS = [b"", b"M\0A\0T\0H\0.\0V\0A\0F\0", b"JSSnapShot32", b"METAFILE", b"\1\0\x09\0", b"\1\0\0\0" + (88).to_bytes(4, "little") + bytes(80), b"\1\0\0\0" + bytes(84), b"zz\x89PNG\r\n\x1a\n", b"x\xff\xd8\xff", b"xxGIF8", b"a%PDF", b"abcd\1\0\x09\0", b"ab\1\0\x09\0", b"nothing", b"x" * 510 + b"GIF8"]


def test_magic(spark):
    want = ["EMPTY", "MATH.VAF", "JSSnapShot32", "METAFILE", "WMF", "EMF", "UNKNOWN", "PNG", "JPEG", "GIF", "PDF", "WMF", "UNKNOWN", "UNKNOWN", "UNKNOWN"]
    assert [embedded.detect(m)[0] for m in MAGICS] == want
    df = spark.createDataFrame([(i, bytearray(m)) for i, m in enumerate(MAGICS)], "i int, content binary")
    assert [r.m for r in df.select("i", src.stream_magic(df.content).alias("m")).orderBy("i").collect()] == want


@pytest.fixture
def files(spark, tmp_path):
    for name, data in {"a.jtd": PLAIN, "b.jtd": WITH_TABLE, "c.jttc": COMPRESSED, "d.jtd": damaged(), "e.jtt": sheet_file(), "f.jtd": b"broken", "g.txt": PLAIN, "sub/h.jtd": objects_file()}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(data)
    return str(tmp_path)


def test_dataframes(spark, files):
    found, rejected = src.read_files(spark, files, limits=Limits(input_bytes=max(len(PLAIN), len(WITH_TABLE), len(COMPRESSED), len(sheet_file()), len(objects_file()))))
    docs = {r.doc_id.rsplit("/", 1)[1]: r for r in src.documents(found).collect()}
    assert set(docs) == {"a.jtd", "b.jtd", "c.jttc", "d.jtd", "e.jtt", "f.jtd", "h.jtd"} and rejected.count() == 0
    assert docs["a.jtd"].text == docs["c.jttc"].text == "銀河鉄道の夜"
    assert docs["f.jtd"].status == "error" and docs["f.jtd"].error_kind == "Unsupported"
    assert docs["e.jtt"].sheets == ["表紙", "内訳"] and docs["h.jtd"].n_objects == 3
    few, many = src.read_files(spark, files, limits=Limits(input_bytes=10))
    assert few.count() == 1 and many.count() == 6
    streams = src.streams(found)
    assert streams.filter("error is not null").count() == 2
    bodies = src.bodies(streams)
    cells = src.cells(bodies)
    assert [r.text for r in cells.filter("kind = 'table'").orderBy("row_idx", "cell_idx").collect()] == ["銀河帯", "けぶった", "天上", "白い"]
    assert src.flow_events(bodies).filter("kind = 'SpanDeclaration'").count() == 4
    assert src.elements(bodies).filter("kind = 'run'").count() >= 5
    assert src.objects(found).count() == 3 and src.entries(found).filter("kind = 'DIR'").count() > 3
    written, skipped = src.dump(streams, 100)
    assert skipped.count() > 0 and written.filter("file = '_Objects_Embedding_1_%03EmbeddedPress'").count() == 0
    assert src.dump(streams)[0].filter("file = '_Objects_Embedding_1_%03EmbeddedPress'").count() == 1
    src.register(spark)
    found.createOrReplaceTempView("files")
    assert spark.sql("select s.stream_path from files, lateral cfb_streams(content) s where doc_id like '%/a.jtd'").first()[0] == "/DocumentText"
