"""Transverse Mercator as column expressions, by Krueger's series in the third flattening (to its fourth power: well under a micrometre)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Semi-major axis in metres and inverse flattening (fixed values).
GRS80 = (6_378_137.0, 298.257222101)
#: Metres of a US survey foot (fixed value).
FOOT = 1200 / 3937


@dataclass(frozen=True)
class TransverseMercator:
    """Degrees to a plane and back. ``unit`` is the plane's, in metres; the false origin is in it."""

    lon0: float
    lat0: float
    scale: float
    false_x: float = 0.0
    false_y: float = 0.0
    ellipsoid: tuple[float, float] = GRS80
    unit: float = 1.0

    @property
    def _n(self) -> float:
        f = 1 / self.ellipsoid[1]
        return f / (2 - f)

    @property
    def _radius(self) -> float:
        """The rectifying radius, scaled, in the plane's unit."""
        n = self._n
        return self.scale * self.ellipsoid[0] / (1 + n) * (1 + n**2 / 4 + n**4 / 64) / self.unit

    def _forth(self) -> list[float]:
        n = self._n
        return [
            n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180,
            13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
            61 * n**3 / 240 - 103 * n**4 / 140,
            49561 * n**4 / 161280,
        ]

    def _back(self) -> list[float]:
        n = self._n
        return [
            n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360,
            n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
            17 * n**3 / 480 - 37 * n**4 / 840,
            4397 * n**4 / 161280,
        ]

    def _latitude(self) -> list[float]:
        """From the conformal latitude to the geodetic one."""
        n = self._n
        return [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]

    @property
    def _origin(self) -> float:
        """Distance of the origin's parallel from the equator along the central meridian, as an angle of the rectifying sphere."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - e * math.atanh(e * s)))
        return xi + sum(a * math.sin(2 * (j + 1) * xi) for j, a in enumerate(self._forth()))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        """``x`` and ``y`` of a point within some tens of degrees of the central meridian."""
        e = 2 * math.sqrt(self._n) / (1 + self._n)
        s, d = F.sin(F.radians(lat)), F.radians(lon - self.lon0)
        t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
        xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
        up = sum((a * F.sin(2 * (j + 1) * xi) * F.cosh(2 * (j + 1) * eta) for j, a in enumerate(self._forth())), xi)
        across = sum((a * F.cos(2 * (j + 1) * xi) * F.sinh(2 * (j + 1) * eta) for j, a in enumerate(self._forth())), eta)
        return self.false_x + self._radius * across, self.false_y + self._radius * (up - self._origin)

    def inverse(self, x: Column, y: Column) -> tuple[Column, Column]:
        """Longitude and latitude in degrees."""
        up, across = (y - self.false_y) / self._radius + self._origin, (x - self.false_x) / self._radius
        xi = sum((-b * F.sin(2 * (j + 1) * up) * F.cosh(2 * (j + 1) * across) for j, b in enumerate(self._back())), up)
        eta = sum((-b * F.cos(2 * (j + 1) * up) * F.sinh(2 * (j + 1) * across) for j, b in enumerate(self._back())), across)
        chi = F.asin(F.sin(xi) / F.cosh(eta))
        lat = sum((c * F.sin(2 * (j + 1) * chi) for j, c in enumerate(self._latitude())), chi)
        return self.lon0 + F.degrees(F.atan2(F.sinh(eta), F.cos(xi))), F.degrees(lat)


#: The state plane of the modelled coast, in US survey feet.
STATE_PLANE = TransverseMercator(-74.5, 38 + 50 / 60, 0.9999, 492_125.0, 0.0, GRS80, FOOT)
