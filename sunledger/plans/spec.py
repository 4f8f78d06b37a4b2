"""What a frame is held to: plain data that checks compile into plans."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields, replace

from sunledger.operators.runs import GAP_FACTOR, MAX_STALL_US
from sunledger.schema import ALL_SIGNALS


def _merged(self, changes: dict):
    """Mappings are merged, everything else is replaced."""
    new = {}
    for name, value in changes.items():
        old = getattr(self, name)
        new[name] = {**old, **value} if isinstance(old, Mapping) and isinstance(value, Mapping) else value
    return replace(self, **new)


@dataclass(frozen=True)
class SolarAngles:
    """Where a site is (degrees, or names of columns that say so) and which columns record the sun's angles."""

    latitude: float | str
    longitude: float | str
    elevation: str | None = None
    azimuth: str | None = None
    zenith: str | None = None
    tolerance: float = 0.5
    utc_offset_us: int | None = None
    refract: bool = True

    def override(self, **changes) -> SolarAngles:
        return _merged(self, changes)

    def angles(self) -> dict[str, str]:
        return {k: v for k in ("elevation", "azimuth", "zenith") if (v := getattr(self, k))}

    def columns(self) -> list[str]:
        return [*self.angles().values(), *(c for c in (self.latitude, self.longitude) if isinstance(c, str))]


@dataclass(frozen=True)
class Spec:
    ranges: Mapping[str, tuple[float, float]] = field(default_factory=dict)
    equivalent: tuple[tuple[str, str], ...] = ()
    lesser: tuple[tuple[str, str], ...] = ()
    dynamic: tuple[str, ...] = ()
    constant: tuple[str, ...] = ()
    expected: Mapping[str, float | str] = field(default_factory=dict)
    unused: tuple[str, ...] = ()
    sentinel: float | Mapping[str, float] = -99.0
    max_stall_us: int = MAX_STALL_US
    stall_windows: Mapping[str, int] = field(default_factory=dict)
    stall_decimals: int | None = None
    gaps: bool = True
    gap_factor: float = GAP_FACTOR
    eps: float = 0.0
    solar: SolarAngles | None = None

    def override(self, **changes) -> Spec:
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise TypeError(f"no such field: {sorted(unknown)}")
        return _merged(self, changes)

    def required(self) -> set[str]:
        """All signals that some check reads."""
        pairs = [s for p in (*self.equivalent, *self.lesser) for s in p]
        return {*self.ranges, *pairs, *self.dynamic, *self.constant, *self.expected, *self.unused, *(self.solar.columns() if self.solar else ())}

    def tested(self) -> list[tuple[str, str]]:
        """(check, signal) of everything that is tested; missing signals are listed by their own check only."""
        out = [("gap", ALL_SIGNALS)] if self.gaps else []
        out += [("range", s) for s in self.ranges]
        out += [("equivalent", f"{a} vs {b}") for a, b in self.equivalent] + [("lesser", f"{a} vs {b}") for a, b in self.lesser]
        out += [("stall", s) for s in self.dynamic] + [("constant", s) for s in self.constant] + [("expected", s) for s in self.expected] + [("sentinel", s) for s in self.unused]
        if self.solar:
            out += [("solar", s) for s in self.solar.angles().values()]
            if self.solar.utc_offset_us is None:
                out += [("utc", ALL_SIGNALS), ("clock", ALL_SIGNALS)]
        return out
