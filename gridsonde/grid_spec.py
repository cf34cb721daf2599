"""Regular latitude/longitude grids described by numbers, not by tables.

Cell centres, spacings and areas of a regular grid are closed-form functions of the integer
indices, so attaching them to a row is a projection: no dimension table, no join, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridsonde import constants as K


@dataclass(frozen=True)
class GridSpec:
    lat_start: float
    lon_start: float
    resolution: float
    n_lat: int
    n_lon: int

    def __post_init__(self) -> None:
        if self.resolution <= 0 or self.n_lat < 1 or self.n_lon < 1:
            raise ValueError("a grid needs a positive resolution and at least one cell per axis")

    @classmethod
    def tiling(cls, box: dict[str, float], resolution: float, lat_start: float, lon_start: float,
               n_lat: int, n_lon: int) -> "GridSpec":
        """A grid whose last cell edges must fall on the upper edges of ``box``."""
        spec = cls(lat_start, lon_start, resolution, n_lat, n_lon)
        for name, start, n in (("lat", lat_start, n_lat), ("lon", lon_start, n_lon)):
            edge = start + resolution * (n - 1) + resolution / 2.0
            if abs(edge - box[f"{name}_max"]) > 1e-6:
                raise ValueError(f"{name} axis ends at {edge}, box ends at {box[f'{name}_max']}")
        return spec

    def lat(self, iy: Column | str = "iy") -> Column:
        return F.lit(self.lat_start) + F.lit(self.resolution) * _col(iy)

    def lon(self, ix: Column | str = "ix") -> Column:
        return F.lit(self.lon_start) + F.lit(self.resolution) * _col(ix)

    def dx(self, iy: Column | str = "iy") -> Column:
        """East-west spacing of cell centres in metres."""
        return F.lit(K.EARTH_RADIUS_M) * F.cos(F.radians(self.lat(iy))) * F.radians(F.lit(self.resolution))

    def dy(self) -> Column:
        """North-south spacing of cell centres in metres."""
        return F.lit(K.EARTH_RADIUS_M) * F.radians(F.lit(self.resolution))

    @property
    def lat_last(self) -> float:
        return self.lat_start + self.resolution * (self.n_lat - 1)

    @property
    def lon_last(self) -> float:
        return self.lon_start + self.resolution * (self.n_lon - 1)


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


BASIN_GRID = GridSpec.tiling(
    K.BASIN_BOX, K.GRID_RESOLUTION, K.GRID_LAT_START, K.GRID_LON_START, K.GRID_N_LAT, K.GRID_N_LON
)
