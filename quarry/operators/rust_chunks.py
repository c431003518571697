"""Chunks of Rust source, by a scanner that knows strings, comments, lifetimes and braces."""

from __future__ import annotations

import re

Chunk = tuple[int, int, str, str]  # line_start, line_end, chunk_type, name

_SKIP = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*)|(?P<raw>b?r(?P<hash>\#*)"(?:.|\n)*?"(?P=hash))|(?P<str>b?"(?:\\.|[^"\\])*")|(?P<char>b?'(?:\\(?:x[0-9a-fA-F]{2}|u\{[^}]*\}|.)|[^'\\\n])')""",
    re.DOTALL,
)
_ITEM = re.compile(
    r"""\s*(?:pub(?:\s*\([^)]*\))?\s+)?(?:default\s+)?(?:(?:const|async|unsafe|extern(?:\s*\S?\s*)?)\s+)*(?P<kind>fn|struct|enum|trait|impl)\b(?P<rest>.*)""",
    re.DOTALL,
)
_NAME = re.compile(r"\s*(?:r\#)?([^\W\d]\w*)")


def _blanked(source: str) -> str:
    """The source with comments, strings and character literals as spaces, newlines kept."""
    out, at = [], 0
    while m := _SKIP.search(source, at):
        end = m.end()
        if m.lastgroup == "block" or m["block"]:
            depth, end = 1, m.end()
            while depth and (n := re.compile(r"/\*|\*/").search(source, end)):
                depth += 1 if n[0] == "/*" else -1
                end = n.end()
            if depth:
                end = len(source)
        out += [source[at : m.start()], re.sub(r"[^\n]", " ", source[m.start() : end])]
        at = end
    return "".join(out) + source[at:]


def rust_chunks(source: str, stem: str) -> list[Chunk]:
    """Spans of the chunks in order: module docs, functions, structs, enums, traits and impls with their methods."""
    rows = source.split("\n")
    out: list[Chunk] = []
    docs = []
    for i, row in enumerate(rows):
        text = row.strip()
        if text.startswith("//!"):
            docs.append(i + 1)
        elif text and not (text.startswith("//") and not text.startswith("///")):
            break
    if docs:
        out.append((docs[0], docs[-1], "module", stem))
    code = _blanked(source)
    _items(code, rows, 0, len(code), "function", out)
    return out


def _items(code: str, rows: list[str], lo: int, hi: int, function: str, out: list[Chunk]) -> None:
    """Items between two places, at the depth there."""
    at = start = lo
    while at < hi:
        c = code[at]
        if c == "#" and not code[start:at].strip():  # an attribute stands before an item
            at = start = _closing(code, at, hi, "[", "]")
        elif c == "{" or c == ";":
            end = _closing(code, at, hi, "{", "}") if c == "{" else at + 1
            _item(code, rows, start, at, end, c == "{", function, out)
            at = start = end
        elif c == "}":
            at = start = at + 1
        elif c in "([":
            at = _closing(code, at, hi, c, ")" if c == "(" else "]")
        else:
            at += 1
    if code[start:hi].strip():  # an unclosed item at the end
        _item(code, rows, start, hi, hi, False, function, out)


def _closing(code: str, at: int, hi: int, opening: str, closing: str) -> int:
    depth = 0
    for i in range(at, hi):
        if code[i] == opening:
            depth += 1
        elif code[i] == closing:
            depth -= 1
            if depth <= 0:
                return i + 1
    return hi


def _item(code: str, rows: list[str], start: int, body: int, end: int, braced: bool, function: str, out: list[Chunk]) -> None:
    head = code[start:body]
    m = _ITEM.match(head)
    if not m:
        return
    kind, name = m["kind"], _name(m["kind"], m["rest"])
    if not name or (kind == "fn" and not braced) or (function == "method" and kind != "fn"):
        return
    first = code.count("\n", 0, start + len(head) - len(head.lstrip()))
    last = code.count("\n", 0, max(start, end - 1))
    while first and re.match(r"\s*(?:#!?\[|///)", rows[first - 1]):
        first -= 1
    out.append((first + 1, last + 1, {"fn": function}.get(kind, "class"), name))
    if kind in ("trait", "impl") and braced:
        _items(code, rows, body + 1, end - 1 if code[end - 1 : end] == "}" else end, "method", out)


def _name(kind: str, rest: str) -> str:
    if kind != "impl":
        m = _NAME.match(rest)
        return m[1] if m else ""
    depth, plain = 0, []
    for c in rest.split(" where ")[0].replace("->", "  "):
        depth += (c == "<") - (c == ">")
        if c not in "<>" and not depth:
            plain.append(c)
    parts = [re.findall(r"[^\W\d]\w*", p.replace("&", " ").replace("dyn ", " ").replace("mut ", " ")) for p in re.split(r"\bfor\b", "".join(plain))]
    names = [p[-1] for p in parts if p]
    return " for ".join(names[:2])
