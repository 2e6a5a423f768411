"""Processors: named steps over DataFrames with validated parameters."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame


@dataclass(frozen=True)
class Param:
    """One parameter: its type, default, and the range or choices it must keep to."""

    kind: type
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def validate(self, name: str, value: object) -> object:
        if self.kind is float and isinstance(value, (int, bool)):
            value = float(value)
        if not isinstance(value, self.kind) or (self.kind is int and isinstance(value, bool)):
            raise TypeError(f"{name} must be {self.kind.__name__}, not {type(value).__name__}")
        if (self.low is not None and value < self.low) or (self.high is not None and value > self.high):
            raise ValueError(f"{name} = {value!r} lies outside {self.low}..{self.high}")
        if self.choices and value not in self.choices:
            raise ValueError(f"{name} = {value!r} is none of {self.choices}")
        return value


@dataclass(frozen=True)
class Processor:
    """A function from a DataFrame to a DataFrame with declared parameters."""

    name: str
    apply: Callable[..., DataFrame]
    params: dict[str, Param] = field(default_factory=dict)
    version: str = "1.0.0"
    tags: tuple[str, ...] = ()

    def __call__(self, df: DataFrame, **given) -> DataFrame:
        if unknown := set(given) - set(self.params):
            raise TypeError(f"{self.name} has no parameter {', '.join(sorted(unknown))}")
        values = {n: p.validate(n, given.get(n, p.default)) for n, p in self.params.items()}
        return self.apply(df, **values)


class Pipeline:
    """Processors in order; Catalyst plans them as one query."""

    def __init__(self, steps: Sequence[Processor]):
        if not steps:
            raise ValueError("a pipeline needs a step")
        self.steps = tuple(steps)

    def __call__(self, df: DataFrame, progress: Callable[[float], None] | None = None) -> DataFrame:
        for k, step in enumerate(self.steps, 1):
            df = step(df)
            if progress:
                progress(k / len(self.steps))
        return df


class Registry:
    """Processors by name."""

    def __init__(self):
        self.known: dict[str, Processor] = {}

    def register(self, processor: Processor, overwrite: bool = False) -> Processor:
        if processor.name in self.known and not overwrite:
            raise ValueError(f"{processor.name} is registered")
        self.known[processor.name] = processor
        return processor

    def get(self, name: str) -> Processor:
        return self.known[name]

    def tagged(self, tag: str) -> list[str]:
        return sorted(n for n, p in self.known.items() if tag in p.tags)

    def table(self, spark) -> DataFrame:
        rows = [(p.name, p.version, list(p.tags)) for _, p in sorted(self.known.items())]
        return spark.createDataFrame(rows, "name string, version string, tags array<string>")
