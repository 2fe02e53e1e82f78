"""A pipeline: named steps in a graph, checked when it is built. Steps run lazily; see run.py."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field
from typing import Any

KINDS = ("source", "sql", "python", "sink")


class PipelineError(Exception):
    """What is wrong with a pipeline; code: a short fixed name for programs."""

    def __init__(self, code: str, message: str):
        super().__init__(f"{code}: {message}")
        self.code = code


@dataclass
class Step:
    """One step. source: location (path, or catalog and table, with format and options) with columns, filter, limit, and watermark, a column
    by which only new rows are read; sql: text; python: function(s); sink: target and strategy."""

    name: str
    kind: str
    upstream: list[str] = field(default_factory=list)
    sql: str | None = None
    function: Callable[..., Any] | str | None = None
    path: str | None = None
    catalog: str | None = None
    table: str | None = None
    format: str | None = None
    options: dict[str, str] = field(default_factory=dict)
    columns: list[str | dict[str, str]] = field(default_factory=list)
    filter: str | None = None
    limit: int | None = None
    watermark: str | None = None
    strategy: str = "replace"
    strategy_options: dict[str, Any] = field(default_factory=dict)
    checks: list[dict[str, Any]] = field(default_factory=list)
    tags: list[str] = field(default_factory=list)
    eager: bool = False
    description: str | None = None


class Pipeline:
    """Validated steps by name; raises PipelineError (DUPLICATE_NAME, UNKNOWN_UPSTREAM, SOURCE_WITH_UPSTREAM, SINK_WITHOUT_UPSTREAM, CYCLE)."""

    def __init__(self, steps: Iterable[Step]):
        self.steps: dict[str, Step] = {}
        for s in steps:
            if s.kind not in KINDS:
                raise PipelineError("UNKNOWN_KIND", f"{s.name}: {s.kind}")
            if s.name in self.steps:
                raise PipelineError("DUPLICATE_NAME", s.name)
            self.steps[s.name] = s
        for s in self.steps.values():
            if unknown := [u for u in s.upstream if u not in self.steps]:
                raise PipelineError("UNKNOWN_UPSTREAM", f"{s.name} reads {', '.join(unknown)}")
            if s.kind == "source" and s.upstream:
                raise PipelineError("SOURCE_WITH_UPSTREAM", s.name)
            if s.kind == "sink" and not s.upstream:
                raise PipelineError("SINK_WITHOUT_UPSTREAM", s.name)
        self.waves()

    def waves(self) -> list[list[str]]:
        """Steps that need nothing from each other, wave by wave; within a wave by name."""
        left = {n: set(s.upstream) for n, s in self.steps.items()}
        out = []
        while left:
            ready = sorted(n for n, up in left.items() if not up)
            if not ready:
                raise PipelineError("CYCLE", ", ".join(sorted(left)))
            out.append(ready)
            left = {n: up - set(ready) for n, up in left.items() if n not in ready}
        return out

    def order(self) -> list[str]:
        """Upstream before downstream, names in alphabetical order among equals."""
        import heapq

        need = {n: len(set(s.upstream)) for n, s in self.steps.items()}
        readers = self.readers()
        heap = [n for n, k in need.items() if not k]
        heapq.heapify(heap)
        out = []
        while heap:
            out.append(n := heapq.heappop(heap))
            for r in readers[n]:
                need[r] -= 1
                if not need[r]:
                    heapq.heappush(heap, r)
        return out

    def readers(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {n: [] for n in self.steps}
        for s in self.steps.values():
            for u in dict.fromkeys(s.upstream):
                out[u].append(s.name)
        return out

    def select(self, sinks: Iterable[str] | None = None, tags: Iterable[str] | None = None, match_all: bool = False) -> Pipeline:
        """The part that these sinks, and sinks with any (or all) of these tags, need; everything if neither is given."""
        if sinks is None and tags is None:
            return self
        wanted = set(sinks or ())
        if unknown := sorted(w for w in wanted if w not in self.steps):
            raise PipelineError("UNKNOWN_TARGET", ", ".join(unknown))
        if tags is not None:
            asked = set(tags)
            hit = {n for n, s in self.steps.items() if (asked <= set(s.tags) if match_all else asked & set(s.tags))}
            wanted = wanted & hit if sinks is not None else hit
        if not wanted:
            raise PipelineError("NOTHING_SELECTED", "no step has these names and tags")
        stack, keep = list(wanted), set()
        while stack:
            n = stack.pop()
            if n not in keep:
                keep.add(n)
                stack += self.steps[n].upstream
        return Pipeline(s for n, s in self.steps.items() if n in keep)
