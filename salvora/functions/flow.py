"""Flow events: what a body stream says about paragraphs, rows, cells and breaks, in order."""

from __future__ import annotations

import re
from typing import NamedTuple

from salvora.functions import words as w

ROW_HEADER = 0x8F
STOPS = re.compile("[\x0a\x0c\x0e\x10\x1c\x1d\x1f]")
RUN_OF_TEXT = re.compile(f"[^\x0a{w.CONTROL}{w.INVALID}\ufe00-\ufe0f]+")
#: Words after which reading goes on, and the event of each.
ADVANCES = {"\x0e": "RowAdvance", "\x0a": "Wrap", "\x0c": None, "\x10": None}

# Marker bytes of wall styles, and the side of a vertical rule.
WALL_IDS = b"\x01\x03\x09\x0c\x0e\x12\x96"
SIDES = {0x09: "Leading", 0x01: "Trailing"}


class Event(NamedTuple):
    kind: str
    w4: int | None = None
    n: int | None = None
    left: int | None = None
    right: int | None = None
    flags: int | None = None
    flags2: int | None = None
    text: str | None = None
    orientation: str | None = None
    weight: str | None = None
    side: str | None = None


def declared(w5: int) -> int | None:
    """Spans a row header announces: w5 is 3, 7, 11 and so on."""
    return (w5 + 1) // 4 if w5 % 4 == 3 else None


def record_end(s: str, at: int) -> int | None:
    """The last word of the valid record that opens at s[at]."""
    if at + 2 >= len(s) or s[at + 1] not in w.CLASSES:
        return None
    size = ord(s[at + 2])
    end = at + size - 1
    if size < 8 or end >= len(s) or s[end - 3 : end + 1] != s[at + 2] + "\0" + s[at + 1] + w.RUN:
        return None
    # an empty inline within the body gives away a chance match; its closing word may be the footer's first
    empty = s.find("\x1d\x1e", at + 3, end - 2)
    return end if empty < 0 else None


def record_event(s: str, at: int) -> Event | None:
    kind, a, b = s[at + 1], ord(s[at + 4]), ord(s[at + 5])
    if kind == "\x30":
        return Event("SpanDeclaration", left=a, right=b, flags=ord(s[at + 6]), flags2=ord(s[at + 7]))
    if kind == "\x20":
        return Event("SectionTransition")
    if kind == "\x10":
        return Event("RowHeader", a, declared(b)) if a == ROW_HEADER else Event("ParagraphHeader", a)
    return None


def unnamed_prologue(data: bytes, s: str) -> str | None:
    """Text between the stream's header and the first marker where the segment has no name; one odd word spoils it."""
    if not data.startswith(w.BODY_MAGIC) or data[20:28] == w.SEGMENT:
        return None
    mark = w.MARKER.search(s, 10)
    if not mark:
        return None
    text = re.split("[\r\n]", s[10 : mark.start()])[0].replace("\0", "")
    return text if text.strip(" \u3000") and re.fullmatch(f"[{w.VISIBLE}]+", text) else None


def magic_words(data: bytes) -> list[int]:
    """Where the body's mark begins at a whole word, counted in words, with another word behind it."""
    return [m.start() // 2 for m in re.finditer(re.escape(w.BODY_MAGIC), data) if m.start() % 2 == 0 and m.end() + 2 <= len(data)]


def events(data: bytes) -> list[Event]:
    """The events of all streams in data, one after another; numbering begins anew in each."""
    starts = [2 * at for at in magic_words(data)]
    if len(starts) < 2:
        return _events(data)
    parts = (data[a:b] for a, b in zip(starts, [*starts[1:], len(data)]))
    return [e for part in parts for e in _events(part)]


def _events(data: bytes) -> list[Event]:
    s = w.words_of(data)
    if w.is_raw(data, s):
        text = w.raw_text(s)
        return [Event("Text", text=text)] if text else []
    out: list[Event] = []
    for head in (w.prologue(data, s), unnamed_prologue(data, s)):
        if head is not None:
            out.append(Event("Text", text=head))
    limit, numbers, held = w.word_limit(data, s), w.Numbering(), []
    regions = w.Regions(s, limit)
    reading, at = False, 0

    def flush() -> None:
        if text := "".join(held):
            out.append(Event("Text", text=text))
        held.clear()

    while at < limit:
        if not reading:
            found = STOPS.search(s, at, limit)
            if not found:
                break
            at = found.start()
        elif plain := RUN_OF_TEXT.match(s, at, limit):
            held.append(plain.group())
            at = plain.end()
            continue
        c = s[at]
        if "\ufe00" <= c <= "\ufe0f":
            on = regions.after(at)
            if on is None:
                held.append(c)
            at = at + 1 if on is None else on
            continue
        flush()
        if c in ADVANCES:
            if ADVANCES[c]:
                out.append(Event(ADVANCES[c]))
            reading, at = True, at + 1
        elif c == w.RUN:
            held.append(numbers.prefix(s, at))
            reading, at = True, at + 1
        elif c == w.INLINE:
            before = s[max(0, at - 6) : at]
            shown = w.SHOWN.search(before)
            reading = False
            if shown or w.HIDDEN.search(before):
                text, at, _ = w.inline_end(s, at)
                if shown and text:
                    out.append(Event("Text", text=text))
            else:
                at += 1
        elif c == w.RECORD and (end := record_end(s, at)) is not None:
            event = record_event(s, at)
            if event:
                out.append(event)
            held.append(numbers.prefix(s, end))
            reading, at = True, end + 1
        else:
            reading, at = False, at + 1
    flush()
    return out + walls(data)


def walls(data: bytes) -> list[Event]:
    """Rules about cells: entries of axis and style behind each fence byte that a known marker byte comes before."""
    fences = [m.start() for m in re.finditer(b"\xfe", data) if m.start() > 0]
    out = []
    for fence, after in zip(fences, [*(f - 1 for f in fences[1:]), len(data)]):
        marker = data[fence - 1]
        if marker not in WALL_IDS:
            continue
        for m in re.finditer(b"(?s)([\x01-\x03])\x02(..)", data[fence + 1 : max(after, fence + 1)]):
            if m.group(1) == b"\x01":
                continue
            upright = m.group(1) == b"\x02"
            out.append(Event("WallRule", orientation="Vertical" if upright else "Horizontal", weight="Thick" if m.group(2) == b"\0\3" else "Thin", side=SIDES.get(marker, "Unknown") if upright else "Unknown"))
    return out
