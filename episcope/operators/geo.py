"""Map coordinates and point density."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The WGS84 ellipsoid and the transverse Mercator grid, lengths in kilometres.
SEMI_MAJOR, FLATTENING = 6378.137, 1 / 298.257223563
SCALE, FALSE_EASTING, FALSE_NORTHING_SOUTH = 0.9996, 500.0, 10000.0

_N = FLATTENING / (2 - FLATTENING)
_A = SEMI_MAJOR / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
# Third-order series of the projection (published expansion in the third flattening).
_ALPHA = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16, 13 * _N ** 2 / 48 - 3 * _N ** 3 / 5, 61 * _N ** 3 / 240)
_BETA = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96, _N ** 2 / 48 + _N ** 3 / 15, 17 * _N ** 3 / 480)
_DELTA = (2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3, 7 * _N ** 2 / 3 - 8 * _N ** 3 / 5, 56 * _N ** 3 / 15)
_ECC = 2 * math.sqrt(_N) / (1 + _N)


def _meridian(zone: int) -> float:
    return math.radians(6 * zone - 183)


def lonlat_to_utm(df: DataFrame, lon: str, lat: str, zone: int, south: bool = False, easting: str = "easting",
                  northing: str = "northing") -> DataFrame:
    """Longitude and latitude in degrees to grid kilometres of a zone."""
    phi, lam = F.radians(F.col(lat)), F.radians(F.col(lon)) - F.lit(_meridian(zone))
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - F.lit(_ECC) * F.atanh(F.lit(_ECC) * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x, y = eta, xi
    for j, a in enumerate(_ALPHA, start=1):
        x = x + F.lit(a) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        y = y + F.lit(a) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
    base = FALSE_NORTHING_SOUTH if south else 0.0
    return df.withColumns({easting: F.lit(FALSE_EASTING) + F.lit(SCALE * _A) * x,
                           northing: F.lit(base) + F.lit(SCALE * _A) * y})


def utm_to_lonlat(df: DataFrame, easting: str, northing: str, zone: int, south: bool = False, lon: str = "longitude",
                  lat: str = "latitude") -> DataFrame:
    """Grid kilometres of a zone to longitude and latitude in degrees."""
    base = FALSE_NORTHING_SOUTH if south else 0.0
    xi = (F.col(northing) - F.lit(base)) / F.lit(SCALE * _A)
    eta = (F.col(easting) - F.lit(FALSE_EASTING)) / F.lit(SCALE * _A)
    xi0, eta0 = xi, eta
    for j, b in enumerate(_BETA, start=1):
        xi0 = xi0 - F.lit(b) * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        eta0 = eta0 - F.lit(b) * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi: Column = F.asin(F.sin(xi0) / F.cosh(eta0))
    phi = chi
    for j, d in enumerate(_DELTA, start=1):
        phi = phi + F.lit(d) * F.sin(2 * j * chi)
    return df.withColumns({lon: F.degrees(F.lit(_meridian(zone)) + F.atan2(F.sinh(eta0), F.cos(xi0))),
                           lat: F.degrees(phi)})


def density_grid(df: DataFrame, x: str, y: str, cell: float, bandwidth: float, reach: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a grid of ``cell``-sized squares.

    Points are counted per cell first; each occupied cell then adds its count to the fixed stencil of cells within
    ``reach`` bandwidths. The cost follows the number of occupied cells, not of points or pairs.
    """
    r = int(math.ceil(reach * bandwidth / cell))
    offsets = range(-r, r + 1)
    weight = {(i, j): math.exp(-0.5 * ((i * cell) ** 2 + (j * cell) ** 2) / bandwidth ** 2)
              for i in offsets for j in offsets}
    norm = 2 * math.pi * bandwidth ** 2
    stencil = F.array(*[F.struct(F.lit(i).cast("long").alias("dx"), F.lit(j).cast("long").alias("dy"),
                                 F.lit(w / norm).alias("w")) for (i, j), w in weight.items()])
    points = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    cells = points.groupBy(F.floor(F.col(x) / cell).alias("cx"), F.floor(F.col(y) / cell).alias("cy")).agg(
        F.count(F.lit(1)).alias("n"))
    spread = cells.withColumn("s", F.explode(stencil))
    total = cells.select(F.sum("n")).scalar()
    return spread.groupBy((F.col("cx") + F.col("s.dx")).alias("cx"), (F.col("cy") + F.col("s.dy")).alias("cy")).agg(
        (F.sum(F.col("n") * F.col("s.w")) / total).alias("density")).select(
        "cx", "cy", ((F.col("cx") + 0.5) * cell).alias("x"), ((F.col("cy") + 0.5) * cell).alias("y"), "density")
