"""Blocks as XHTML, Markdown and plain text."""

from __future__ import annotations

from html import escape

from salvora.functions.tables import Block, OutCell


def xhtml_parts(parts: list, in_cell: bool) -> str:
    kinds = {"wrap": " " if in_cell else "<br/>", "seam": "<br/>"}
    return "".join(escape(t, quote=False) if kind == "text" else kinds[kind] for kind, t in parts)


def xhtml_cell(c: OutCell) -> str:
    spans = "".join(f' {name}="{n}"' for name, n in (("rowspan", c.rowspan), ("colspan", c.colspan)) if n > 1)
    return f"<td{spans}>{xhtml_parts(c.parts, True)}</td>"


def xhtml_block(block: Block) -> str:
    if block.kind == "paragraph":
        return f"<p>{xhtml_parts(block.parts, False)}</p>"
    rows = "".join(f"<tr>{''.join(map(xhtml_cell, row))}</tr>" for row in block.rows)
    return f"<table><tbody>{rows}</tbody></table>"


def xhtml(blocks: list[Block]) -> str:
    return "".join(map(xhtml_block, blocks))


def text_parts(parts: list) -> str:
    return "".join({"text": t, "wrap": " ", "seam": "\n"}[kind] for kind, t in parts)


def plain(blocks: list[Block]) -> str:
    out = []
    for b in blocks:
        out += ["\t".join(text_parts(c.parts) for c in row) for row in b.rows] if b.kind == "table" else [text_parts(b.parts)]
    return "\n".join(out)


def markdown(blocks: list[Block]) -> str:
    """Pipe tables whose first row is the head; spans are flattened and short rows stay short."""
    out = []
    for b in blocks:
        if b.kind == "paragraph":
            out.append(text_parts(b.parts))
            continue
        lines = ["| " + " | ".join(text_parts(c.parts).replace("\n", " ").replace("|", "\\|") for c in row) + " |" for row in b.rows]
        out.append("\n".join([lines[0], "|" + " --- |" * len(b.rows[0]), *lines[1:]]))
    return "\n\n".join(out)
