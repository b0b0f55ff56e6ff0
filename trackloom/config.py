"""Error bounds, the quantization steps that follow from them, and checks of what a caller may ask for."""

from __future__ import annotations

import math
from dataclasses import dataclass

#: Fixed values of the format: attribute ids and channels.
ATTRS = {"pos": 0, "rot": 1, "rgb": 2, "alpha": 3, "scale": 4}
CHANNELS = {"pos": 3, "rot": 4, "rgb": 3, "alpha": 1, "scale": 3}

#: Fixed values: (least, most) of each parameter that a request may set.
LIMITS = {"pos_mm": (0.1, 50.0), "color_levels": (0, 32), "rot_steps": (0, 8), "scale_pct": (0.1, 25.0), "gop": (5, 300), "zstd_level": (0, 19)}


def clamp_request(**given) -> dict:
    """Every parameter moved into its limits; unknown names are an error."""
    return {k: min(max(v, LIMITS[k][0]), LIMITS[k][1]) for k, v in given.items()}


@dataclass(frozen=True)
class Bounds:
    pos_m: float = 0.002
    scale_rel: float = 0.02
    rgb: int = 4
    alpha: int = 4
    rot: int = 0

    def __post_init__(self):
        if not (self.pos_m > 0 and self.scale_rel > 0) or min(self.rgb, self.alpha, self.rot) < 0:
            raise ValueError("float bounds must be above 0, integer bounds not below 0")

    @property
    def steps(self) -> Steps:
        log = math.log(1 + self.scale_rel)
        return Steps(2 * self.pos_m, self.pos_m, 2 * log, log, 2 * self.rgb + 1, 2 * self.alpha + 1, 2 * self.rot + 1)

    def of(self, attr: str):
        """(step, pitch of the static grid, bound) of an attribute."""
        s = self.steps
        return {"pos": (s.pos, s.base_pos, self.pos_m), "scale": (s.scale_log, s.base_scale_log, math.log(1 + self.scale_rel)), "rgb": (s.rgb, 1, self.rgb), "alpha": (s.alpha, 1, self.alpha), "rot": (s.rot, 1, self.rot)}[attr]


@dataclass(frozen=True)
class Steps:
    pos: float
    base_pos: float
    scale_log: float
    base_scale_log: float
    rgb: int
    alpha: int
    rot: int


def check_gop(gop: int) -> int:
    if gop < 1:
        raise ValueError("a frame group has one frame at least")
    return gop


def human_bytes(n: float) -> str:
    """Decimal units, two digits after the point from kilobytes on."""
    for unit in ("B", "KB", "MB"):
        if n < 1000:
            return f"{n:.0f} B" if unit == "B" else f"{n:.2f} {unit}"
        n /= 1000
    return f"{n:.2f} GB"
