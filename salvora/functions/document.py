"""One document from its bytes: format, body, parts, blocks and rendered text, or a typed error."""

from __future__ import annotations

from dataclasses import dataclass, field
from html import escape

from salvora.functions import embedded, lha, render, streams, words
from salvora.functions.errors import DocumentError, LimitExceeded, NotFound, Unsupported
from salvora.functions.flow import events
from salvora.functions.limits import Limits
from salvora.functions.streams import BODY, BOX_TITLE, BOXES, COMPRESSED, HEADER, Sheet, stripped
from salvora.functions.tables import Block, assemble, is_space
from salvora.sources.compound import MAGIC, CompoundError, CompoundFile

# Format codes.
UNKNOWN, TEXT, PACKED, LOOSE, OTHER = "unknown", "cfb-document-text", "cfb-just-compressed-document", "cfb-embedded-document-text", "cfb-unknown"
LOOSE_SOURCE = "/EmbeddedDocumentText"
# Anything the container reader may trip over in damaged bytes.
DAMAGE = (CompoundError, ValueError, IndexError, KeyError, OverflowError)


@dataclass
class SheetBody:
    name: str
    blocks: list[Block]
    text: str
    notes: str | None


@dataclass
class Document:
    format: str = UNKNOWN
    status: str = "ok"
    error_kind: str | None = None
    error_message: str | None = None
    limit_resource: str | None = None
    limit_value: int | None = None
    limit_actual: int | None = None
    source: str | None = None
    body: bytes = b""
    text: str = ""
    header: list[str] = field(default_factory=list)
    boxes: list[str] = field(default_factory=list)
    blocks: list[Block] = field(default_factory=list)
    sheets: list[SheetBody] = field(default_factory=list)
    notes: str | None = None
    objects: list[embedded.Object] = field(default_factory=list)
    combined: str = ""
    xhtml: str = ""
    markdown: str = ""


def _open(data: bytes) -> CompoundFile | None:
    try:
        return CompoundFile(data)
    except DAMAGE:
        return None


def detect_format(data: bytes, file: CompoundFile | None = None) -> str:
    """The format code of a file; a container that cannot be read is told by the body's magic somewhere in it."""
    if not data.startswith(MAGIC):
        return UNKNOWN
    loose = LOOSE if words.BODY_MAGIC in data else OTHER
    file = file or _open(data)
    try:
        if file is None:
            return loose
        if file.read(BODY) is not None:
            return TEXT
        packed = file.read(COMPRESSED)
        return PACKED if packed is not None and lha.is_wrapped(packed) else loose
    except DAMAGE:
        return loose


def payload(data: bytes, file: CompoundFile | None, limits: Limits) -> tuple[str, bytes, str]:
    """(source, bytes, text) of the body: its stream, else that of the compressed document inside, else what lies about in the bytes."""
    if file is not None:
        body = file.read(BODY)
        if body is not None:
            return BODY, body, words.plain_text(body)
        packed = file.read(COMPRESSED)
        if packed is not None and lha.is_wrapped(packed):
            inner = CompoundFile(lha.unwrap(packed, limits.budget())).read(BODY)
            if inner is None:
                raise NotFound(f"stream `{BODY}`")
            return BODY, inner, words.plain_text(inner)
    found = words.salvage(data)
    if found is None:
        raise NotFound(f"stream `{BODY}`")
    return LOOSE_SOURCE, *found


def _quiet(read, default=None):
    """Parts whose failure leaves the rest of the document as it is."""
    try:
        return read()
    except (*DAMAGE, DocumentError):
        return default


def _stream(file: CompoundFile | None, path: str) -> bytes | None:
    return None if file is None else file.read(path)


def _part(file: CompoundFile | None, path: str, parse, default=None):
    def read():
        data = _stream(file, path)
        return default if data is None else parse(data)

    return _quiet(read, default)


def read_document(data: bytes, limits: Limits | None = None, with_objects: bool = True) -> Document:
    """All of a document; a failure that leaves no body is its status, never an exception."""
    limits = limits or Limits()
    doc = Document()
    try:
        limits.check_input(len(data))
        file = _open(data)
        doc.format = detect_format(data, file)
        if doc.format in (UNKNOWN, OTHER):
            raise Unsupported(f"format {doc.format}")
        try:
            doc.source, doc.body, doc.text = payload(data, file, limits)
        except CompoundError as e:
            raise Unsupported(str(e)) from e
        except (NotFound, LimitExceeded):
            raise
        except DocumentError as e:
            raise Unsupported(str(e)) from e
    except DocumentError as e:
        doc.status, doc.error_kind, doc.error_message = "error", e.kind, str(e)
        if isinstance(e, LimitExceeded):
            doc.limit_resource, doc.limit_value, doc.limit_actual = e.resource, e.limit, e.actual
        return doc
    doc.header = _part(file, HEADER, streams.header_lines) or []
    doc.boxes = _part(file, BOXES, streams.box_texts) or []
    doc.blocks = _quiet(lambda: assemble(events(doc.body)), [])
    listed = _quiet(lambda: streams.sheets(lambda p: _stream(file, p)), [])
    doc.notes = _part(file, streams.FOOTNOTE, streams.footnote)
    if len(listed) > 1:
        doc.sheets = _quiet(lambda: [_sheet(doc, file, s) for s in listed], [])
        doc.combined = "\n\n".join(_sheet_text(doc, file, s) for s in listed)
    else:
        doc.combined = doc.text + ("" if doc.notes is None else f"\n\n{doc.notes}")
    if with_objects and file is not None:
        doc.objects = _quiet(lambda: embedded.objects(file), [])
    doc.xhtml, doc.markdown = _xhtml(doc), _markdown(doc)
    return doc


def _sheet(doc: Document, file: CompoundFile | None, s: Sheet) -> SheetBody:
    body = doc.body if not s.storage else _stream(file, s.body)
    text = doc.text if not s.storage else "" if body is None else _quiet(lambda: words.plain_text(body), "")
    return SheetBody(s.name, [] if body is None else assemble(events(body)), stripped(text), _part(file, s.notes, streams.footnote))


def _sheet_text(doc: Document, file: CompoundFile | None, s: Sheet) -> str:
    text = doc.text if not s.storage else _part(file, s.body, words.plain_text, "")
    notes = _part(file, s.notes, streams.footnote)
    return f"{s.name}\n{stripped(text)}" + ("" if notes is None else f"\n\n{notes}")


def _box_texts(doc: Document) -> list[str]:
    return [b for b in doc.boxes if not is_space(b)]


def _xhtml(doc: Document) -> str:
    p = lambda t: f"<p>{escape(t, quote=False)}</p>"
    boxes = "".join(map(p, _box_texts(doc)))
    boxes = boxes and f'\n{BOX_TITLE}\n<div class="layout-box">{boxes}</div>'
    head = "".join(escape("\n".join(doc.header), quote=False) + "\n\n" for _ in doc.header[:1])
    if doc.sheets:
        parts = (f'<div class="sheet"><h2>{escape(s.name, quote=False)}</h2>' + (render.xhtml(s.blocks) if s.blocks else p(s.text) if s.text else "") + (p(s.notes) if s.notes else "") + "</div>" for s in doc.sheets)
        return head + "".join(parts) + boxes
    if doc.blocks:
        return head + render.xhtml(doc.blocks) + ("" if doc.notes is None else f"\n\n{p(doc.notes)}") + boxes
    return head + escape(plain_view(doc), quote=False)


def plain_view(doc: Document) -> str:
    """The flat text with the boxes' behind it."""
    joined = "\n".join(doc.boxes)
    return doc.combined + (f"\n{BOX_TITLE}\n{joined}" if doc.combined and not is_space(joined) else "")


def _markdown(doc: Document) -> str:
    parts = ["\n".join(doc.header)] if doc.header else []
    for s in doc.sheets:
        parts += [f"## {s.name}", render.markdown(s.blocks) if s.blocks else s.text, s.notes or ""]
    if not doc.sheets:
        parts += [render.markdown(doc.blocks) if doc.blocks else doc.text, doc.notes or ""]
    return "\n\n".join(x for x in [*parts, *_box_texts(doc)] if x)
