"""What a query asks for, as plain values."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class SampleSpec:
    """hops 0 means the seeds only; fanout None means all neighbours; a null cutoff means no time filter."""

    hops: int = 2
    fanout: int | None = 10
    seed: int = 42


@dataclass(frozen=True)
class FewShotSpec:
    """k examples per root (0: none); the best k by dot product out of k * rerank_factor draws."""

    k: int = 3
    rerank_factor: int = 1
    seed: int = 42


@dataclass(frozen=True)
class BatchSpec:
    size: int = 512
    shuffle: bool = False
    ratio: float | None = None
    number: int | None = None
    seed: int = 42


@dataclass(frozen=True)
class TaskSpec:
    name: str
    task_type: str
    seed_type: str
    target_type: str
    metric: str
    all_features: tuple[str, ...] = ()
    allowed_features: tuple[str, ...] = ()
    time_column: str | None = None
    classes: int = 1

    def __post_init__(self) -> None:
        if self.task_type not in ("retrieval", "regression"):
            raise ValueError(f"{self.name}: task type {self.task_type}")


@dataclass(frozen=True)
class ModelSpec:
    width: int = 16
    layers: int = 2
    heads: int = 4
    use_reverse: bool = True
    use_gate: bool = True


@dataclass(frozen=True)
class Edge:
    """A relation head:name:tail; keys are columns of one edge table."""

    head: str
    name: str
    tail: str

    @property
    def edge_type(self) -> str:
        return f"{self.head}:{self.name}:{self.tail}"


@dataclass(frozen=True)
class Graph:
    """node types with their key and time columns, and relations given by foreign keys."""

    nodes: dict[str, tuple[str, str | None]]
    edges: tuple[tuple[Edge, str], ...] = field(default=())
