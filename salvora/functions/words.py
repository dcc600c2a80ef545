"""Body text: a stream of big-endian 16-bit words, read as a string with one character for each word.

So that runs, inlines and regions are regular expressions over that string instead of a loop over words, surrogates stay single characters here; text
never holds any.
"""

from __future__ import annotations

import re
import struct
from array import array
from dataclasses import dataclass, field
from sys import byteorder

# Names in the streams, and words that open, close and part things.
BODY_MAGIC, SEGMENT = b"SsmgV.01", b"TextV.01"
RECORD, INLINE, INLINE_END, RUN = "\x1c", "\x1d", "\x1e", "\x1f"
CLASSES = "\x00\x10\x20\x30"
HEAD_WORDS = 16
MAX_SKIPPED, MAX_REGION = 256, 32768
CIRCLED = "①②③④⑤⑥⑦⑧⑨⑩⑪⑫⑬⑭⑮⑯⑰⑱⑲⑳"

CONTROL = "\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f"
INVALID = "\ud800-\udfff\uffff"
SPACE = " \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\t-\r\x1c-\x1f"
PLAIN = re.compile(f"[^{CONTROL}{INVALID}\ufe00-\ufe0f]+")
NOT_TEXT = re.compile(f"[{CONTROL}{INVALID}]")
NEXT_START = re.compile("[\x1d\x1f]")
MARKER = re.compile("[\x1c\x1d\x1f]")
VISIBLE = "\u3000-\u9fff\uff01-\uff5e\x20-\x7e"
TWO_VISIBLE = re.compile(f"[{VISIBLE}]{{2}}")
PRINTABLE = re.compile(f"[^{CONTROL}{INVALID}\x20\t\n\r\u1680\u2000-  -\u200a\u2028\u2029\u205f\u3000]")
TAIL = re.compile(f"[{SPACE}]*[\u0400\u0490\ufe14][{SPACE}\u0400\u0490\ufe14]*\\Z")
SHOWN = re.compile("\x1c\x01\x07\x00\x00[\x01\x03\x13]\\Z")
HIDDEN = re.compile("(?s)\x1c\x01\x07\x00\x01.\\Z")


def words_of(data: bytes) -> str:
    """One character for each word; an odd last byte is dropped."""
    units = array("H", data[: len(data) // 2 * 2])
    if byteorder == "little":
        units.byteswap()
    return "".join(map(chr, units))


def bytes_of(words: str) -> bytes:
    return b"".join(struct.pack(">H", ord(c)) for c in words)


@dataclass(frozen=True)
class Element:
    """kind: run, inline, skipped or boundary."""

    kind: str
    text: str = ""
    selector: int | None = None
    raw: bytes | None = None
    code: int | None = None


def is_segment(data: bytes) -> bool:
    return data.startswith(BODY_MAGIC) and data[20:28] == SEGMENT


def is_raw(data: bytes, words: str) -> bool:
    """A body without markers: one segment, or none of the marker words within its declared length."""
    return is_segment(data) and (words[9:10] == "\x01" or (0 < _span(words) and not MARKER.search(words, HEAD_WORDS, HEAD_WORDS + _span(words))))


def _span(words: str) -> int:
    """The declared length of the segment, 0 if it is not plausible."""
    if len(words) < HEAD_WORDS or words[14] != "\0":
        return 0
    return ord(words[15]) if ord(words[15]) <= len(words) - HEAD_WORDS else 0


def raw_text(words: str) -> str:
    """The text of a body without markers, up to the first zero word."""
    if len(words) < HEAD_WORDS:
        return ""
    return re.sub(f"[{INVALID}]", "", words[HEAD_WORDS : HEAD_WORDS + ord(words[15])].partition("\0")[0])


def word_limit(data: bytes, words: str) -> int:
    """Words that belong to the body: as the content header says, else all."""
    if not is_segment(data) or len(data) < 2 * HEAD_WORDS:
        return len(words)
    return min(HEAD_WORDS + struct.unpack_from(">i", data, 28)[0], len(words))


def decode_head(words: str, start: int, end: int) -> tuple[str, int] | None:
    """Text before the first marker and where it ends: zeros are skipped, controls and what is no character end it."""
    stop = re.compile(f"[{CONTROL[3:]}\x01-\x08{INVALID}]").search(words, start, end)
    at = stop.start() if stop else end
    text = words[start:at].replace("\0", "")
    return (text, at) if text else None


def prologue(data: bytes, words: str) -> str | None:
    """Text between the content header and the first marker, if there is a printable character."""
    span = _span(words) if is_segment(data) else 0
    mark = MARKER.search(words, HEAD_WORDS, HEAD_WORDS + span) if span else None
    if not mark or mark.start() == HEAD_WORDS or not PRINTABLE.search(words, HEAD_WORDS, mark.start()):
        return None
    head = decode_head(words, HEAD_WORDS, mark.start())
    return head[0] if head else None


class Regions:
    """Where text goes on behind rule regions: at two visible words in a row, which are looked for once."""

    def __init__(self, words: str, limit: int):
        self.words, self.limit, self.pair = words, min(limit, len(words)), -1

    def after(self, at: int) -> int | None:
        if self.pair <= at:
            found = TWO_VISIBLE.search(self.words, at + 1, self.limit)
            self.pair = found.start() if found else self.limit
        return self.pair if self.pair + 2 <= min(at + MAX_REGION, self.limit) else None


def record_before(words: str, at: int) -> str | None:
    """The record whose footer ends at the run marker words[at], from its opener to the marker; None if the echo does not hold."""
    if at < 4 or words[at - 2] != "\0" or words[at - 1] not in CLASSES:
        return None
    size = ord(words[at - 3])
    record = words[at + 1 - size : at + 1] if 4 <= size <= at + 1 else ""
    return record if record[:3] == RECORD + words[at - 1] + words[at - 3] else None


def starts_run(words: str, at: int, prose: bool) -> bool:
    """Whether the run marker at `at` opens a run, or is a number that happens to look like one."""
    near = words[max(0, at - 12) : at]
    return not prose or RECORD in near or near[-1:] in ("\x1d", "\x1e") or near[-4:-3] == INLINE_END or record_before(words, at) is not None or (at <= 16 and not re.search("[\x1c\x1f]", words[:at]))


def circled(n: int) -> str:
    return CIRCLED[n - 1] if 1 <= n <= 20 else f"({n})"


def lettered(n: int) -> str:
    return f"({chr(96 + n)})" if 1 <= n <= 26 else f"({n})"


@dataclass
class Numbering:
    """Counters of automatic numbers in one stream."""

    heads: list[int] = field(default_factory=lambda: [0, 0, 0])
    rings: list[int] = field(default_factory=lambda: [0, 0])
    list_style: int | None = None
    count: int = 0

    def prefix(self, words: str, at: int) -> str:
        """What the paragraph whose record ends at words[at] is numbered with; the empty string for nothing."""
        record = record_before(words, at)
        if record is None or record[1] != "\x10":
            return ""
        style, level = _argument(record, "\xa3"), _argument(record, "\x50")
        if style is None:
            self.list_style, self.count = None, 0
        elif style == 1 and level is not None:
            self.list_style, self.count = None, 0
            return self._head(level)
        elif style == 8:
            return self._ring(1 if level is None else level)
        elif style in (2, 3, 4):
            fresh = self.list_style != style or f"\xa3\x02{chr(style)}\u7fff" in record
            self.list_style, self.count = style, 1 if fresh else self.count + 1
            return {2: f"({self.count}) ", 3: f"{lettered(self.count)} ", 4: f"{self.count}. "}[style]
        return ""

    def _head(self, level: int) -> str:
        if not 1 <= level <= 3:
            return f"(level {level}) "
        self.heads[level - 1] += 1
        self.heads[level:] = [0] * (3 - level)
        return f"第{self.heads[0]}章 " if level == 1 else ".".join(map(str, self.heads[:level])) + " "

    def _ring(self, level: int) -> str:
        if level == 1:
            self.rings = [self.rings[0] + 1, 0]
            return f"{circled(self.rings[0])} "
        self.rings[1] += 1
        return f"{circled(self.rings[0])}-{self.rings[1]} "


def _argument(record: str, code: str) -> int | None:
    at = record.find(code + "\x02", 0, len(record) - 1)
    return ord(record[at + 2]) if at >= 0 else None


def inline_end(words: str, at: int, most: int | None = None) -> tuple[str, int, bool]:
    """Text of the inline that begins at words[at], where reading goes on, and whether it was closed, within `most` words if given."""
    end = words.find(INLINE_END, at + 1, len(words) if most is None else at + most + 1)
    if end < 0 and most is not None:
        return "", at + 1, False
    stop = end if end >= 0 else len(words)
    return NOT_TEXT.sub("", words[at + 1 : stop]), stop + (end >= 0), end >= 0


def elements(data: bytes) -> list[Element]:
    """The elements of a body stream in order."""
    words = words_of(data)
    if is_raw(data, words):
        text = raw_text(words)
        return [Element("run", text)] if text else []
    out: list[Element] = []
    head = prologue(data, words)
    if head is not None:
        out.append(Element("run", head))
    numbers, limit, run = Numbering(), word_limit(data, words), []
    regions = Regions(words, limit)
    # a length or count in the header may look like a marker; the published scan begins at the first word and then reads the prologue twice
    prose, reading, at = head is not None, False, HEAD_WORDS if is_segment(data) else 0

    def close() -> None:
        if text := "".join(run):
            out.append(Element("run", text))
        run.clear()

    while at < limit:
        if not reading:
            found = NEXT_START.search(words, at, limit)
            if not found:
                break
            at = found.start()
        c = words[at]
        if c == RUN:
            if starts_run(words, at, prose):
                close()
                run.append(numbers.prefix(words, at))
                reading = prose = True
            at += 1
        elif c == INLINE:
            close()
            reading = False
            before = words[max(0, at - 6) : at]
            shown = SHOWN.search(before)
            hidden = not shown and (before[-1:] == RECORD or HIDDEN.search(before))
            text, stop, closed = inline_end(words, at, None if shown else MAX_SKIPPED) if shown or hidden else ("", at + 1, False)
            if shown:
                if text:
                    out.append(Element("inline", text, ord(before[-1])))
                prose = True
            elif hidden and closed:
                out.append(Element("skipped", text, ord(before[-1]), bytes_of(before + words[at:stop])))
            else:
                out.append(Element("boundary", code=0x1D))
                stop = at + 1
            at = stop
        elif plain := PLAIN.match(words, at, limit):
            run.append(plain.group())
            prose, at = True, plain.end()
        elif "\ufe00" <= c <= "\ufe0f":
            on = regions.after(at)
            if on is None:
                run.append(c)
                prose, on = True, at + 1
            at = on
        else:
            close()
            out.append(Element("boundary", code=ord(c)))
            reading = c in "\x0c\x0e\x10"
            at += 1
    close()
    return out


def trim_tail(text: str) -> str:
    """Without a tail of white space and end marks, if there is an end mark in it."""
    return TAIL.sub("", text)


def plain_text(data: bytes) -> str:
    return trim_tail("".join(e.text for e in elements(data) if e.kind in ("run", "inline")))


# ------------------------------------------------------------------ salvage

MAX_SPAN = 64 * 1024
_SPACES = re.compile(f"[{SPACE}]")
# Characters that salvaged text may have.
_LIKELY = re.compile("[!-~\u3000-\u30ff\u31f0-\u31ff\u3200-\u33ff\u4e00-\u9fff\uff00-\uffef→←↑↓…◎○●◆☆★※]")


def likely_line(line: str) -> bool:
    bare = _SPACES.sub("", line)
    return bool(bare) and len(_LIKELY.findall(bare)) * 100 >= len(bare) * 80


def clean_lines(text: str) -> str:
    return "\n".join(x for x in (line.strip("\0") for line in re.split("[\r\n]", text)) if likely_line(x))


def magic_offsets(data: bytes) -> list[int]:
    return [m.start() for m in re.finditer(b"(?=" + re.escape(BODY_MAGIC) + b")", data)]


def salvage(data: bytes) -> tuple[bytes, str] | None:
    """Bytes and text of all bodies that lie about in data, each text once; None without any."""
    starts = magic_offsets(data)
    kept: dict[str, bytes] = {}
    for a, b in zip(starts, [*starts[1:], len(data)]):
        part = data[a : min(b, a + MAX_SPAN)]
        text = clean_lines(plain_text(part))
        if _SPACES.sub("", text):
            kept.setdefault(text, part)
    return (b"\0\0".join(kept.values()), "\n".join(kept)) if kept else None
