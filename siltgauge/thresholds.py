"""Threshold profiles; every limit can be replaced."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Limits:
    line_count: int = 500
    fan_in: int = 10
    fan_out: int = 15
    reexport: int = 10
    branch_density: float = 12
    nesting_depth: int = 6
    type_depth: int = 4
    comment_ratio_min: float = 0.03
    comment_ratio_max: float = 0.30
    decorator_density: float = 0.50
    empty_catch: int = 2
    dangerous_pattern: int = 5
    string_comparison: int = 10
    import_domain: int = 10

    def but(self, **changes) -> Limits:
        return replace(self, **changes)


NORMAL = Limits()
STRICT = Limits(300, 5, 10, 5, 8, 4, 3, 0.03, 0.20, 0.33, 1, 3, 5, 8)
RELAXED = Limits(1000, 20, 25, 20, 16, 8, 5, 0.01, 0.40, 0.75, 3, 10, 15, 15)
PROFILES = {"strict": STRICT, "normal": NORMAL, "relaxed": RELAXED}

#: Cells that nothing published determines; they are choices of this engine.
CHOSEN = {
    "strict": ("branch_density", "type_depth"),
    "normal": (),
    "relaxed": ("branch_density", "type_depth", "comment_ratio_max", "decorator_density", "import_domain"),
}


def profile(name: str) -> Limits:
    if name not in PROFILES:
        raise ValueError(f"no such profile: {name}; there are {', '.join(PROFILES)}")
    return PROFILES[name]
