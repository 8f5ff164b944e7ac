"""Named extensions: formats, transports, stores, writers and credentials that a user may add beside the built-in ones."""

from __future__ import annotations

from collections.abc import Mapping

from .codecs import Unsupported
from .errors import NotRegistered

STATUSES = ("implemented", "stub")


class Registry(Mapping):
    """A mapping from names to callables. The same entry may be added twice; another one under a taken name is refused."""

    def __init__(self, kind: str, **entries):
        self.kind, self._entries = kind, {}
        for name, entry in entries.items():
            self.register(name, entry)

    def register(self, name: str, entry=None, status: str = "implemented", note: str = "") -> None:
        if status not in STATUSES:
            raise ValueError(f"no status {status!r}; known: {list(STATUSES)}")
        if (status == "implemented") != callable(entry):
            raise ValueError(f"{self.kind} {name!r}: implemented entries are callable, stubs have none")
        new = (entry, status, note)
        if self._entries.setdefault(name, new) != new:
            raise ValueError(f"{self.kind} {name!r} is registered already")

    def __getitem__(self, name: str):
        if name not in self._entries:
            raise NotRegistered(f"no {self.kind} {name!r}; known: {list(self)}")
        entry, status, note = self._entries[name]
        if status == "stub":
            raise Unsupported(f"{self.kind} {name!r} is a stub. {note}".strip())
        return entry

    def __contains__(self, name) -> bool:
        return name in self._entries

    def __iter__(self):
        return iter(sorted(self._entries))

    def __len__(self) -> int:
        return len(self._entries)

    def describe(self) -> list[dict]:
        return [{"kind": self.kind, "name": n, "status": self._entries[n][1], "note": self._entries[n][2]} for n in self]

    def implemented(self) -> dict:
        """Plain name -> callable, fit to travel to the tasks of a job."""
        return {n: e for n, (e, status, _) in self._entries.items() if status == "implemented"}
