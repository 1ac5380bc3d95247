"""Small descriptions of grids and variogram models; literals in column expressions."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class GridSpec:
    """Corner origin, cell sizes and cell counts of an unrotated grid; rows run i fastest, then j, then k."""

    nx: int
    ny: int
    nz: int = 1
    x0: float = 0.0
    y0: float = 0.0
    z0: float = 0.0
    dx: float = 1.0
    dy: float = 1.0
    dz: float = 1.0

    @property
    def cells(self) -> int:
        return self.nx * self.ny * self.nz


@dataclass(frozen=True)
class Structure:
    """One nested structure: kind is spherical, exponential, gaussian, power or hole."""

    kind: str
    sill: float
    ranges: tuple[float, float, float]
    azimuth: float = 0.0
    dip: float = 0.0
    roll: float = 0.0


@dataclass(frozen=True)
class VariogramModel:
    nugget: float
    structures: tuple[Structure, ...]

    @property
    def sill(self) -> float:
        return self.nugget + sum(s.sill for s in self.structures)
