"""Options of a mining or sampling run, checked."""

from __future__ import annotations

from dataclasses import dataclass, replace

NO_BOUND = 2**31 - 1
COUNT_MODES = ("mni", "fis", "gis")


def bounds(least: int, most: int) -> tuple[int, int]:
    """Size bounds: a maximum of 0 or less is none; a minimum above the maximum becomes the maximum less one."""
    most = NO_BOUND if most <= 0 else most
    return (most - 1 if least > most else least), most


@dataclass(frozen=True)
class ItemsetOptions:
    support: int
    min_items: int = 0
    max_items: int = 0
    strict_singletons: bool = True
    dedupe: bool = True

    def __post_init__(self) -> None:
        if self.support <= 0:
            raise ValueError("support must be positive")
        low, high = bounds(self.min_items, self.max_items)
        object.__setattr__(self, "min_items", low)
        object.__setattr__(self, "max_items", high)


@dataclass(frozen=True)
class DigraphOptions:
    support: int
    min_edges: int = 0
    max_edges: int = 0
    min_vertices: int = 0
    max_vertices: int = 0
    count_mode: str = "mni"
    extend_from: str = "embeddings"
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()

    def __post_init__(self) -> None:
        if self.support <= 0:
            raise ValueError("support must be positive")
        if self.count_mode not in COUNT_MODES:
            raise ValueError(f"count mode must be one of {COUNT_MODES}")
        if self.extend_from not in ("embeddings", "freq-edges"):
            raise ValueError("extend from embeddings or freq-edges")
        for what in ("edges", "vertices"):
            low, high = bounds(getattr(self, f"min_{what}"), getattr(self, f"max_{what}"))
            object.__setattr__(self, f"min_{what}", low)
            object.__setattr__(self, f"max_{what}", high)

    def with_support(self, support: int) -> DigraphOptions:
        return replace(self, support=support)
