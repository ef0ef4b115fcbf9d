"""Rule libraries in the surface language: macros that give facts names, and rules over them."""

from __future__ import annotations

from pathlib import Path


def names() -> list[str]:
    return sorted(p.stem for p in Path(__file__).parent.glob("*.rel"))


def library(*wanted: str) -> list[tuple[str, str]]:
    """(name, source) of libraries, as ``parse`` takes them."""
    return [(n, (Path(__file__).parent / f"{n}.rel").read_text()) for n in wanted]
