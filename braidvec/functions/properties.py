"""User hooks: named properties, filters, transforms and scores."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PropertyFn = Callable[[DataFrame], Column]


@dataclass
class PropertyRegistry:
    """Named properties; each is a function from a DataFrame to a Column (built-in or pandas UDF)."""

    known: dict[str, PropertyFn] = field(default_factory=dict)

    def register_property(self, name: str, fn: PropertyFn) -> None:
        self.known[name] = fn

    def get_property(self, name: str) -> PropertyFn:
        if name not in self.known:
            raise KeyError(f"unknown property {name!r}; known: {sorted(self.known)}")
        return self.known[name]

    def property_vector(self, df: DataFrame, names: Sequence[str]) -> Column:
        """Several properties as one array of doubles."""
        return F.array(*[self.get_property(n)(df).cast("double") for n in names])


def target_vector(names: Sequence[str], target: Mapping[str, float] | Sequence[float] | float) -> list[float]:
    """Target values in the order of the names; a scalar needs exactly one name."""
    if isinstance(target, Mapping):
        missing = [n for n in names if n not in target]
        if missing:
            raise ValueError(f"no target for {missing}")
        return [float(target[n]) for n in names]
    values = [float(target)] if isinstance(target, (int, float)) else [float(v) for v in target]
    if len(values) != len(names):
        raise ValueError(f"{len(values)} target values for {len(names)} properties")
    return values


@dataclass(frozen=True)
class Hooks:
    """Optional filter and transform applied to a table before it is used."""

    pre_filter: Callable[[DataFrame], Column] | None = None
    pre_transform: Callable[[DataFrame], DataFrame] | None = None

    def apply(self, df: DataFrame) -> DataFrame:
        if self.pre_filter is not None:
            df = df.filter(self.pre_filter(df))
        return df if self.pre_transform is None else df.transform(self.pre_transform)
