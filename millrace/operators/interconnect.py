"""Modules that call each other by name, as whole frames: a registry of normal and session modules.

A call between modules is a run of the one on the other's rows, under the same index, never a call from inside a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from millrace.operators import module as modules
from millrace.operators.module import Module
from millrace.streaming import session


class Interconnect:
    def __init__(self, *known: Module):
        self.modules: dict[str, Module] = {m.name: m for m in known}
        self.sessions: dict[str, tuple[Callable, bool]] = {}

    def register(self, m: Module) -> None:
        self.modules[m.name] = m

    def register_session(self, name: str, function: Callable, diff: bool = False) -> None:
        self.sessions[name] = (function, diff)

    def specs(self) -> list[dict]:
        """What can be called, by name."""
        sessions = [{"name": n, "kind": "session_diff" if diff else "session", "doc": f.__doc__ or ""} for n, (f, diff) in self.sessions.items()]
        return sorted([*(m.spec() for m in self.modules.values()), *sessions], key=lambda s: s["name"])

    def spec(self, name: str) -> dict:
        found = [s for s in self.specs() if s["name"] == name]
        if not found:
            raise KeyError(f"no module {name}")
        return found[0]

    def call(self, name: str, rows: DataFrame, index: str = "index") -> DataFrame:
        """Records of the named module on ``rows``."""
        self.spec(name)
        return modules.run(rows, self.modules[name], index)

    def call_session(self, name: str, rows: DataFrame, session_id: str = "session_id", turn: str = "turn", row: str = "input", prior: DataFrame | None = None) -> DataFrame:
        """Calls of the named session module, each row in the session that it names."""
        self.spec(name)
        function, diff = self.sessions[name]
        return session.calls(rows, function, session_id, turn, row, diff, prior)
