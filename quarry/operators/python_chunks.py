"""Chunks of Python source: module docstring, top-level functions and classes, methods, nested classes."""

from __future__ import annotations

import ast
import re

Chunk = tuple[int, int, str, str]  # line_start, line_end, chunk_type, name

_DEFINITION = re.compile(r"^(\s*)(?:async\s+)?(def|class)\s+([^\W\d]\w*)")


def python_chunks(source: str, stem: str) -> list[Chunk]:
    """Spans of the chunks in order. Source that does not parse is read by its indentation."""
    try:
        tree = ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return _by_indentation(source)
    out: list[Chunk] = []
    first = tree.body[0] if tree.body else None
    if isinstance(first, ast.Expr) and (isinstance(first.value, ast.JoinedStr) or isinstance(first.value, ast.Constant) and isinstance(first.value.value, str | bytes)):
        out.append((first.lineno, first.end_lineno, "module", stem))
    for node in tree.body:
        _definition(node, "function", out)
    return out


def _definition(node: ast.stmt, kind: str, out: list[Chunk]) -> None:
    if not isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
        return
    start = min([node.lineno, *(d.lineno for d in node.decorator_list)])
    if isinstance(node, ast.ClassDef):
        out.append((start, node.end_lineno, "class", node.name))
        for child in node.body:
            _definition(child, "method", out)
    else:
        out.append((start, node.end_lineno, kind, node.name))


def _by_indentation(source: str) -> list[Chunk]:
    """Definitions at the top and directly within classes, each up to the next line of no deeper indentation."""
    rows = source.split("\n")
    out: list[Chunk] = []
    classes: list[int] = []
    functions: list[int] = []
    for i, row in enumerate(rows):
        m = _DEFINITION.match(row)
        depth = len(row) - len(row.lstrip())
        if row.strip() and not row.lstrip().startswith(("#", ")", "]", "}")):
            classes = [c for c in classes if c < depth]
            functions = [f for f in functions if f < depth]
        if not m or functions or (depth and not classes):
            continue
        start = i
        while start and rows[start - 1].strip().startswith("@") and len(rows[start - 1]) - len(rows[start - 1].lstrip()) == depth:
            start -= 1
        end = i
        for j in range(i + 1, len(rows)):
            if rows[j].strip():
                if len(rows[j]) - len(rows[j].lstrip()) <= depth and rows[j].lstrip()[:1] not in (")", "]", "}"):
                    break
                end = j
        if m[2] == "class":
            out.append((start + 1, end + 1, "class", m[3]))
            classes.append(depth)
        else:
            out.append((start + 1, end + 1, "method" if classes else "function", m[3]))
            functions.append(depth)
    return out
