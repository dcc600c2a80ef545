"""The smaller streams of a document: header, text boxes, footnotes and sheets."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from salvora.functions import words as w
from salvora.functions.errors import DocumentError
from salvora.functions.tables import is_space

# Where the streams are.
HEADER, BOXES, FOOTNOTE, BODY, COMPRESSED = "/Header", "/LayoutBoxText", "/Footnote", "/DocumentText", "/JSCompDocument"
SHEET_INFO, ITEM_INFO, ITEM_PATHS, SHEET_PREFIX = "/ObjectSheets/SheetInfo", "/ObjectSheets/DocSheet/DocItemInfo", "/ObjectSheets/DocSheet/DocItemInfo2", "/ObjectSheets/DocSheet/DOCS_"
BOX_TITLE, ROOT_NAME = "※枠内テキスト", "タイトル"
SLOT, FIRST_SLOT, NAME_AND_HEAD = 128, 10, 6
TRAILER = 26

_NAME = w.words_of(w.SEGMENT)


def stripped(text: str) -> str:
    return re.sub(f"^[{w.SPACE}]+|[{w.SPACE}]+\\Z", "", text)


def span_text(words: str, start: int, end: int) -> tuple[str, str, bool]:
    """Raw text before the first marker of a span, text after it, and whether there is a marker."""
    mark = w.MARKER.search(words, start, end)
    head = w.decode_head(words, start, mark.start() if mark else end)
    tail = w.plain_text(w.bytes_of(words[mark.start() : end])) if mark else ""
    return head[0] if head else "", tail, mark is not None


def header_lines(data: bytes) -> list[str] | None:
    """Lines of a header stream, one for each named span; None without any or where a span is cut off. A page mark '?' in a raw span is page 1."""
    words = w.words_of(data)
    if not data.startswith(w.BODY_MAGIC) or len(words) < FIRST_SLOT:
        return None
    lines, at = [], FIRST_SLOT
    while (hit := words.find(_NAME, at)) >= 0:
        if len(words) <= hit + 4:
            return None
        if words[hit + 4] != "\0":
            at = hit + 1
            continue
        start = hit + NAME_AND_HEAD
        if len(words) < start:
            return None
        size = ord(words[start - 1])
        if size == 0:
            at = hit + 1
            continue
        if start + size > len(words):
            return None
        head, tail, marked = span_text(words, start, start + size)
        line = (tail if marked else head.replace("?", "1")).rstrip("\r\n")
        if not is_space(line):
            lines.append(line)
        at = start + size
    return lines or None


def box_texts(data: bytes) -> list[str] | None:
    """Texts of the boxes of a layout stream; None if it is cut off or does not begin with a named slot."""
    words = w.words_of(data)
    if not data.startswith(w.BODY_MAGIC) or len(words) < FIRST_SLOT:
        return None
    count = ord(words[FIRST_SLOT - 1])
    end = FIRST_SLOT + count * SLOT
    if count == 0:
        return []
    if len(words) < end:
        return None
    out: list[str] = []
    for at in _slots(words, end):
        if at is None:
            return None
        start = at + NAME_AND_HEAD
        stop = start + ord(words[start - 1])
        head, tail, _ = span_text(words, start, stop)
        out.append(head + tail)
    return out


def _slots(words: str, end: int):
    """Positions of the named slots, each after the pitch that the span before it reaches; None where the layout breaks."""
    at = FIRST_SLOT
    if not words.startswith(_NAME, at):
        yield None
        return
    while at < end:
        stop = at + NAME_AND_HEAD + ord(words[at + NAME_AND_HEAD - 1])
        if stop > end:
            yield None
            return
        yield at
        at = FIRST_SLOT + -(-(stop - FIRST_SLOT) // SLOT) * SLOT
        while at < end and not words.startswith(_NAME, at):
            at += SLOT


def footnote(data: bytes) -> str | None:
    """A label and the run after it make a line; runs without a label go on; None if nothing is left."""
    out, label = "", None
    for e in w.elements(data):
        text = stripped(e.text) if e.kind == "run" else ""
        if e.kind == "inline" and e.selector == 1:
            label = e.text
        elif text and label is not None:
            out, label = out + ("\n" if out else "") + f"{label} {text}", None
        elif text:
            out += " " + text
    return stripped(out) or None


@dataclass(frozen=True)
class Sheet:
    index: int
    name: str
    storage: str = ""
    original: str | None = None

    @property
    def body(self) -> str:
        return self.storage.rstrip("/") + BODY

    @property
    def notes(self) -> str:
        return self.storage.rstrip("/") + FOOTNOTE


def _utf16(data: bytes) -> str | None:
    try:
        return data.decode("utf-16-le")
    except UnicodeDecodeError:
        return None


def root_name(data: bytes) -> str | None:
    """The last counted string of a sheet info stream."""
    for at in range(len(data) - 8, 3, -2) if len(data) >= 12 else ():
        n = int.from_bytes(data[at : at + 4], "little")
        raw = data[at + 4 : at + 4 + 2 * n]
        if 1 <= n <= 64 and len(raw) == 2 * n:
            units = struct.unpack(f"<{n}H", raw)
            if all(0x20 <= u < 0xD800 for u in units):
                return "".join(map(chr, units))
    return None


def item_list(data: bytes) -> list[tuple[str, int]]:
    """(name, id) of the sheets below the root; the last entry's trailer may be short."""
    if len(data) < 4:
        raise DocumentError("sheet list is too short")
    count, at, out = int.from_bytes(data[:4], "little"), 4, []
    for k in range(count):
        if at + 8 > len(data):
            raise DocumentError("sheet list ends within an entry")
        size = 2 * int.from_bytes(data[at + 4 : at + 8], "little")
        at += 8
        if at + size + 4 > len(data):
            raise DocumentError("sheet list ends within a name")
        name = _utf16(data[at : at + size])
        if name is None:
            raise DocumentError("sheet name is not UTF-16")
        out.append((name, int.from_bytes(data[at + size : at + size + 4], "little")))
        at += size + 4
        if at + TRAILER > len(data) and k + 1 < count:
            raise DocumentError("sheet list ends within a trailer")
        at = min(at + TRAILER, len(data))
    return out


def item_paths(data: bytes) -> list[str]:
    """Counted strings that look like paths."""
    out, at = [], 0
    while at + 4 <= len(data):
        n = int.from_bytes(data[at : at + 4], "little")
        text = _utf16(data[at + 4 : at + 4 + 2 * n]) if 1 <= n <= 512 and at + 4 + 2 * n <= len(data) else None
        if text is not None and re.search(r"[\\/]|\.jtd", text):
            out.append(text)
            at += 4 + 2 * n
        else:
            at += 2
    return out


def sheets(read) -> list[Sheet]:
    """The sheets of a document whose streams read(path) gives, the root first; none if it has a single body."""
    info, items = read(SHEET_INFO), read(ITEM_INFO)
    if info is None and items is None:
        return []
    paths = read(ITEM_PATHS)
    originals = item_paths(paths) if paths is not None else []
    name = root_name(info) if info is not None else None
    out = [Sheet(0, ROOT_NAME if name is None else name)]
    for k, (name, number) in enumerate(item_list(items) if items is not None else []):
        out.append(Sheet(k + 1, name, f"{SHEET_PREFIX}{number:04d}", originals[k] if k < len(originals) else None))
    return out
