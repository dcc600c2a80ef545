"""Command line: text, markup and metadata of one file, and a look into containers.

python -m salvora.cli [-t | -x | -m | -J] FILE;  python -m salvora.cli list | magic | dump FILE [FOLDER]
Exit codes: 0 done (also where the reader of the output went away), 1 failure, 2 usage.
"""

from __future__ import annotations

import json
import sys
from pathlib import Path

from salvora.functions.document import DAMAGE, plain_view, read_document
from salvora.functions.embedded import detect
from salvora.sources.compound import MAX_STREAM, CompoundFile

VIEWS = {"-t": lambda d: "\n".join(d.header) + "\n\n" * bool(d.header) + plain_view(d), "-x": lambda d: d.xhtml, "-m": lambda d: f"X-Format: {d.format}", "-J": lambda d: json.dumps({"format": d.format, "text": d.text, "objects": [o.name for o in d.objects]}, ensure_ascii=False)}


def safe_name(path: str) -> str:
    return "".join("_" if c == "/" or c.isspace() else f"%{ord(c):02X}" if 0 < ord(c) < 32 else c for c in path)


def run(args: list[str], out=None, err=None) -> int:
    out, err = out or sys.stdout, err or sys.stderr
    try:
        if args[:1] == ["-h"]:
            print(__doc__, file=out)
            return 0
        if len(args) < 2:
            print(__doc__, file=err)
            return 2
        what, path = args[0], Path(args[1])
        if what not in (*VIEWS, "list", "magic", "dump"):
            print(__doc__, file=err)
            return 2
        if not path.is_file():
            print(f"no such file: {path}", file=err)
            return 1
        data = path.read_bytes()
        if what in VIEWS:
            doc = read_document(data)
            if doc.status != "ok":
                print(f"{doc.error_kind}: {doc.error_message}", file=err)
                return 1
            print(VIEWS[what](doc), file=out)
            return 0
        file = CompoundFile(data)
        for e in file.entries():
            if what == "list":
                print(e.kind, e.path, e.size, sep="\t", file=out)
            elif e.kind == "DOC" and what == "magic":
                print(e.path, *detect(file.read(e.path)[:512]), sep="\t", file=out)
            elif e.kind == "DOC" and e.size <= MAX_STREAM:
                folder = Path(args[2] if len(args) > 2 else ".")
                folder.mkdir(parents=True, exist_ok=True)
                (folder / safe_name(e.path)).write_bytes(file.read(e.path))
        return 0
    except BrokenPipeError:
        return 0
    except DAMAGE as e:
        print(e, file=err)
        return 1


if __name__ == "__main__":
    sys.exit(run(sys.argv[1:]))
