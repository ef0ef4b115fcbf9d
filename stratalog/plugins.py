"""Extensions: named objects with a version and capabilities; one that fails to start is set aside, the others go on."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from importlib.metadata import entry_points
from typing import Any

#: What an extension may provide.
CAPABILITIES = ("source", "codec", "evidence", "command", "store")


@dataclass(frozen=True)
class Extension:
    name: str
    version: str
    capabilities: tuple[str, ...]
    start: Callable[[], dict[str, Any]]  # capability -> what it provides


@dataclass
class Registry:
    active: dict[str, Extension] = field(default_factory=dict)
    provided: dict[str, dict[str, Any]] = field(default_factory=dict)
    set_aside: dict[str, str] = field(default_factory=dict)

    def add(self, extension: Extension) -> bool:
        """Starts an extension; False and a reason in ``set_aside`` if it cannot be used."""
        try:
            if extension.name in self.active:
                raise ValueError("its name is taken")
            unknown = set(extension.capabilities) - set(CAPABILITIES)
            if unknown or not extension.capabilities:
                raise ValueError(f"unknown capabilities: {', '.join(sorted(unknown)) or 'none given'}")
            given = extension.start()
            if set(given) != set(extension.capabilities):
                raise ValueError("it does not provide what it declares")
        except Exception as e:
            self.set_aside[extension.name] = str(e) or type(e).__name__
            return False
        self.active[extension.name] = extension
        for capability, value in given.items():
            self.provided.setdefault(capability, {})[extension.name] = value
        return True

    def load(self, group: str = "stratalog.extensions", found: Iterable | None = None) -> None:
        """Adds the installed extensions of an entry point group."""
        for point in entry_points(group=group) if found is None else found:
            try:
                extension = point.load()
            except Exception as e:
                self.set_aside[point.name] = str(e) or type(e).__name__
            else:
                self.add(extension)

    def of(self, capability: str) -> dict[str, Any]:
        return self.provided.get(capability, {})
