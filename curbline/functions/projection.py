"""Lambert conformal conic projection between WGS84 degrees and planar metres (PRJ1)."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from curbline.functions.geometry import col


@dataclass(frozen=True)
class Lambert:
    # Fixed values of the state-plane system in metres (EPSG:32136): ellipsoid axis and
    # inverse flattening, the two standard parallels, origin latitude and longitude, offsets.
    axis: float = 6378137.0
    inverse_flattening: float = 298.257222101
    parallel_1: float = 36.4166666667
    parallel_2: float = 35.25
    origin_lat: float = 34.3333333333
    origin_lon: float = -86.0
    false_east: float = 600000.0
    false_north: float = 0.0

    @property
    def ecc(self) -> float:
        f = 1.0 / self.inverse_flattening
        return math.sqrt(f * (2.0 - f))

    def _iso(self, lat_deg: float) -> float:
        lat, e = math.radians(lat_deg), self.ecc
        s = e * math.sin(lat)
        return math.tan(math.pi / 4 - lat / 2) / ((1 - s) / (1 + s)) ** (e / 2)

    def _radius(self, lat_deg: float) -> float:
        lat, e = math.radians(lat_deg), self.ecc
        return math.cos(lat) / math.sqrt(1 - (e * math.sin(lat)) ** 2)

    @property
    def cone(self) -> float:
        top = math.log(self._radius(self.parallel_1) / self._radius(self.parallel_2))
        return top / math.log(self._iso(self.parallel_1) / self._iso(self.parallel_2))

    @property
    def scale(self) -> float:
        return self.axis * self._radius(self.parallel_1) / (self.cone * self._iso(self.parallel_1) ** self.cone)

    @property
    def origin_rho(self) -> float:
        return self.scale * self._iso(self.origin_lat) ** self.cone


DEFAULT = Lambert()


def to_plane(lat="lat", lon="lon", crs: Lambert = DEFAULT) -> tuple[Column, Column]:
    phi = F.radians(col(lat))
    s = F.lit(crs.ecc) * F.sin(phi)
    iso = F.tan(F.lit(math.pi / 4) - phi / 2) / F.pow((1 - s) / (1 + s), F.lit(crs.ecc / 2))
    rho = F.lit(crs.scale) * F.pow(iso, F.lit(crs.cone))
    theta = F.lit(crs.cone) * (F.radians(col(lon)) - math.radians(crs.origin_lon))
    return (
        F.lit(crs.false_east) + rho * F.sin(theta),
        F.lit(crs.false_north + crs.origin_rho) - rho * F.cos(theta),
    )


def to_degrees(x="x", y="y", crs: Lambert = DEFAULT, rounds: int = 8) -> tuple[Column, Column]:
    east, north = col(x) - crs.false_east, F.lit(crs.origin_rho + crs.false_north) - col(y)
    rho = F.sqrt(east * east + north * north)
    iso = F.pow(rho / crs.scale, F.lit(1.0 / crs.cone))

    def refine(phi, _):
        s = F.lit(crs.ecc) * F.sin(phi)
        return F.lit(math.pi / 2) - 2 * F.atan(iso * F.pow((1 - s) / (1 + s), F.lit(crs.ecc / 2)))

    start = F.lit(math.pi / 2) - 2 * F.atan(iso)
    phi = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, refine)
    lon = F.atan2(east, north) / crs.cone + math.radians(crs.origin_lon)
    return F.degrees(phi), F.degrees(lon)
