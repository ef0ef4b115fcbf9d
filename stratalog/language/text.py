"""Splitting of source text that minds strings and brackets."""

from __future__ import annotations

OPEN, CLOSE = "([{", ")]}"


def split_top(text: str, separator: str) -> list[str]:
    """Parts between separators outside strings and brackets; a space separator swallows runs of white space."""
    parts, depth, quoted, start = [], 0, False, 0
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted and c in OPEN:
            depth += 1
        elif not quoted and c in CLOSE:
            depth -= 1
            if depth < 0:
                raise ValueError("unbalanced brackets")
        elif not quoted and depth == 0 and (c.isspace() if separator == " " else c == separator):
            parts.append(text[start:i])
            start = i + 1
    if quoted or depth:
        raise ValueError("unclosed string" if quoted else "unbalanced brackets")
    parts.append(text[start:])
    parts = [p.strip() for p in parts]
    if separator == " ":
        return [p for p in parts if p]
    return parts if parts != [""] else []


def without_comment(line: str) -> str:
    """The line up to ``//`` outside strings."""
    quoted = False
    for i, c in enumerate(line):
        if c == '"':
            quoted = not quoted
        elif not quoted and line.startswith("//", i) and (i == 0 or line[i - 1] != ":"):
            return line[:i]
    return line


def first_open(text: str, mark: str) -> int:
    """Place of the first ``mark`` outside strings, -1 if there is none."""
    quoted = False
    for i, c in enumerate(text):
        if c == '"':
            quoted = not quoted
        elif not quoted and c == mark:
            return i
    return -1
