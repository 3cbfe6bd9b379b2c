"""Table layouts and frozen configurations."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import types as T

NODES = T.StructType(
    [
        T.StructField("graph_id", T.LongType()),
        T.StructField("node_id", T.IntegerType()),
        T.StructField("feat", T.ArrayType(T.IntegerType())),
    ]
)
EDGES = T.StructType(
    [
        T.StructField("graph_id", T.LongType()),
        T.StructField("src", T.IntegerType()),
        T.StructField("dst", T.IntegerType()),
        T.StructField("bond", T.IntegerType()),
    ]
)
# One row per graph: the form used by streams and by the batch numpy helpers.
NESTED_GRAPH = T.StructType(
    [
        T.StructField("graph_id", T.LongType()),
        T.StructField("nodes", T.ArrayType(T.StructType([T.StructField("node_id", T.IntegerType()), T.StructField("feat", T.ArrayType(T.IntegerType()))]))),
        T.StructField("edges", T.ArrayType(T.StructType([T.StructField("src", T.IntegerType()), T.StructField("dst", T.IntegerType())]))),
    ]
)

# Bin sizes of the two published molecule layouts.
BINS_SMALL = (4, 5, 3, 5)
BINS_LARGE = (9, 6, 3, 4, 2)

VSA_KINDS = ("MAP", "HRR", "FHRR")


@dataclass(frozen=True)
class WalkConfig:
    """Random-walk features: walk lengths, number of bins, optional boundaries per length, optional clip range."""

    ks: tuple[int, ...] = (3, 6)
    num_bins: int = 10
    boundaries: dict[int, tuple[float, ...]] | None = None
    clip: tuple[float, float] | None = None


@dataclass(frozen=True)
class EncoderConfig:
    """Everything needed to rebuild an encoder."""

    bins: tuple[int, ...]
    dim: int = 256
    depth: int = 3
    vsa: str = "HRR"
    seed: int = 42
    normalize: bool = True
    normalize_graph: bool = False
    isolated: str = "zero"
    kind: str = "graph"
    walk: WalkConfig | None = None
    members: tuple[tuple[int, int], ...] = field(default=())

    def __post_init__(self) -> None:
        if self.vsa not in VSA_KINDS:
            raise ValueError(f"unknown vsa {self.vsa!r}; known: {VSA_KINDS}")
        if self.isolated not in ("zero", "identity"):
            raise ValueError("isolated must be 'zero' or 'identity'")

    def all_bins(self) -> tuple[int, ...]:
        """Bin sizes with one extra position per walk length."""
        if self.walk is None:
            return self.bins
        return self.bins + (self.walk.num_bins,) * len(self.walk.ks)

    def to_json(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def from_json(text: str) -> "EncoderConfig":
        raw = json.loads(text)
        walk = raw.pop("walk")
        if walk is not None:
            bounds = walk["boundaries"]
            walk = WalkConfig(
                ks=tuple(walk["ks"]),
                num_bins=walk["num_bins"],
                boundaries=None if bounds is None else {int(k): tuple(v) for k, v in bounds.items()},
                clip=None if walk["clip"] is None else tuple(walk["clip"]),
            )
        raw["bins"] = tuple(raw["bins"])
        raw["members"] = tuple(tuple(m) for m in raw["members"])
        return EncoderConfig(walk=walk, **raw)
