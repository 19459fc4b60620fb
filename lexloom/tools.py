"""Named read-only queries with typed arguments: a call gives rows or a reason, never an exception for wrong arguments."""

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame


@dataclass
class ToolResult:
    ok: bool
    rows: DataFrame | None = None
    error: str | None = None


class Gateway:
    def __init__(self):
        self.tools: dict[str, tuple[Callable[..., DataFrame], dict[str, type]]] = {}

    def add(self, **arguments: type):
        """Register a function (spark, sf_dir, **arguments) under its name."""

        def keep(f: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
            self.tools[f.__name__] = (f, arguments)
            return f

        return keep

    def call(self, name: str, spark, sf_dir: str, **given) -> ToolResult:
        if name not in self.tools:
            return ToolResult(False, error=f"no tool {name}")
        f, arguments = self.tools[name]
        wrong = sorted({k for k in arguments if not isinstance(given.get(k), arguments[k])} | (set(given) - set(arguments)))
        return ToolResult(False, error=f"wrong arguments: {', '.join(wrong)}") if wrong else ToolResult(True, f(spark, sf_dir, **given))
