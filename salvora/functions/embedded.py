"""Embedded objects: workbooks, images and metafiles in object storages."""

from __future__ import annotations

import re
import struct
from dataclasses import dataclass

from salvora.functions.words import SPACE
from salvora.sources.compound import MAGIC, CompoundError, CompoundFile, write_compound

MAX_DEPTH, MAX_OBJECTS = 8, 64
IMAGE_WINDOW, METAFILE_WINDOW = 512, 256
#: Image heads by which contents are cut: name, type, pattern.
_IMAGE = re.compile(rb"(?s)(?P<jpg>\xff\xd8\xff)|(?P<png>\x89PNG(?=.{4}))|(?P<gif>GIF8)|(?P<bmp>BM(?=.{12}[\x28\x6c\x7c]\0\0\0))")
_METAFILE = re.compile(rb"(?s)(?P<wmf>\x01\0\x09\0)|(?P<emf>\x01\0\0\0(?=.{36} EMF))")
TYPES = {"xls": "application/vnd.ms-excel", "jpg": "image/jpeg", "png": "image/png", "gif": "image/gif", "bmp": "image/bmp", "wmf": "image/wmf", "emf": "image/emf"}


@dataclass(frozen=True)
class Object:
    idx: int
    name: str
    content_type: str
    path: str
    payload: bytes


def kind_of(name: str) -> int | None:
    """0 for a workbook, 1 for contents, 2 for a press, None for what is no object."""
    bare = re.sub(f"^[{SPACE}]*[\x00-\x1f]*|[{SPACE}]+\\Z", "", name).lower()
    return 0 if bare == "workbook" else 1 if bare == "contents" else 2 if bare.startswith("embeddedpress") else None


def is_object_storage(name: str) -> bool:
    return bool(re.match(f"[{SPACE}]*(?:embedding|oleitem)", name.lower()))


def image(raw: bytes) -> tuple[str, bytes] | None:
    """The first image in the head of contents, with all behind it."""
    last = min(len(raw) - 4, IMAGE_WINDOW)
    found = _IMAGE.search(raw)
    return (found.lastgroup, raw[found.start() :]) if found and found.start() <= last else None


def metafile(raw: bytes) -> tuple[str, bytes] | None:
    """The first metafile at an even distance behind the head of a press."""
    last = min(len(raw) - 4, 8 + METAFILE_WINDOW)
    if raw.startswith(b"METAFILE"):
        for at in range(8, last + 1, 2):
            if found := _METAFILE.match(raw, at):
                return found.lastgroup, raw[at:]
    return None


def workbook(raw: bytes) -> tuple[str, bytes] | None:
    """A workbook as a compound file; a bare record stream is put into one."""
    if raw[:2] == b"\x09\x08":
        return "xls", write_compound({"/Workbook": raw})
    return ("xls", raw) if raw.startswith(MAGIC) else None


def objects(file: CompoundFile, accept=lambda content_type: True) -> list[Object]:
    """Objects in order: storages depth first by lower-cased name, in each the workbooks, contents and presses. Numbers go to accepted ones only, up to a cap."""
    storages: dict[str, list[tuple[int, str, str]]] = {}
    for e in file.entries():
        *folders, name = e.path[1:].split("/")
        inside = next((k for k, f in enumerate(folders) if is_object_storage(f)), None)
        kind = kind_of(name)
        if e.kind == "DOC" and inside == len(folders) - 1 and len(folders) <= MAX_DEPTH and kind is not None:
            storages.setdefault("/".join(folders), []).append((kind, name.lower(), e.path))
    out: list[Object] = []
    for entries in storages.values():
        for kind, _, path in sorted(entries):
            if len(out) == MAX_OBJECTS:
                return out
            try:
                raw = file.read(path)
            except CompoundError:
                continue
            cut = (workbook, image, metafile)[kind](raw) if raw else None
            if cut and accept(TYPES[cut[0]]):
                n = len(out) + 1
                out.append(Object(n, f"embedded-{n}.{cut[0]}", TYPES[cut[0]], path, cut[1]))
    return out


# Magics at the start of a stream, and those that may lie anywhere in its first 512 bytes.
_AT_START = (("MATH.VAF", "MATH.VAF".encode("utf-16-le")), ("JSSnapShot32", b"JSSnapShot32"), ("METAFILE", b"METAFILE"), ("WMF", b"\x01\0\x09\0"))
_ANYWHERE = (("PNG", b"\x89PNG\r\n\x1a\n"), ("JPEG", b"\xff\xd8\xff"), ("GIF", b"GIF8"), ("PDF", b"%PDF"), ("WMF", b"\x01\0\x09\0"))


def detect(head: bytes) -> tuple[str, int]:
    """Label and offset of a stream's magic, by priority; EMPTY or UNKNOWN without one."""
    first, second = struct.unpack_from("<Ii", head.ljust(8, b"\0"))
    window = head[:512]
    found = [(label, 0) for label, mark in _AT_START if head.startswith(mark)]
    found += [("EMF", 0)] * (len(head) >= 88 and first == 1 and second >= 88)
    found += [(label, window.index(mark)) for label, mark in _ANYWHERE if mark in window and (label != "WMF" or len(head) >= 8)]
    return found[0] if found else ("UNKNOWN" if head else "EMPTY", 0)
