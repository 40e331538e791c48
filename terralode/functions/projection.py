"""Projections and lengths on the ellipsoid, as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 and the transverse Mercator's scale and shift.
A, FLATTENING, SCALE, FALSE_EASTING, FALSE_NORTHING = 6378137.0, 1 / 298.257223563, 0.9996, 500_000.0, 10_000_000.0


def transverse_mercator(lon: Column, lat: Column, central: Column | float, south: bool = True) -> tuple[Column, Column]:
    """Easting and northing by Krueger's series to the third order (millimetres within a zone)."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    alpha = (n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240)
    e = 2 * math.sqrt(n) / (1 + n)
    phi, dl = F.radians(lat), F.radians(lon - central)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    east = eta + sum((a * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    north = xi + sum((a * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, a in enumerate(alpha, 1)), F.lit(0.0))
    return FALSE_EASTING + SCALE * radius * east, (FALSE_NORTHING if south else 0.0) + SCALE * radius * north


def inverse_mercator(east: Column, north: Column, central: Column | float, south: bool = True) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of an easting and northing, by Krueger's inverse series to the third order."""
    n = FLATTENING / (2 - FLATTENING)
    radius = A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    beta = (n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480)
    delta = (2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15)
    xi, eta = (north - (FALSE_NORTHING if south else 0.0)) / (SCALE * radius), (east - FALSE_EASTING) / (SCALE * radius)
    xi1 = xi - sum((b * F.sin(2 * j * xi) * F.cosh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    eta1 = eta - sum((b * F.cos(2 * j * xi) * F.sinh(2 * j * eta) for j, b in enumerate(beta, 1)), F.lit(0.0))
    chi = F.asin(F.sin(xi1) / F.cosh(eta1))
    lat = chi + sum((d * F.sin(2 * j * chi) for j, d in enumerate(delta, 1)), F.lit(0.0))
    return central + F.degrees(F.atan2(F.sinh(eta1), F.cos(xi1))), F.degrees(lat)


def utm_central(lon: Column) -> Column:
    return F.floor((lon + 180) / 6) * 6 - 177


def geodesic(a: Column, b: Column) -> Column:
    """Metres on WGS84 between points in degrees: Andoyer and Lambert's correction of the sphere, which is right to some
    metres in a thousand kilometres; 0 between equal points."""
    f = FLATTENING
    beta = lambda p: F.atan((1 - f) * F.tan(F.radians(p["y"])))
    p, q = (beta(a) + beta(b)) / 2, (beta(b) - beta(a)) / 2
    dl = F.radians(b["x"] - a["x"]) / 2
    h = F.pow(F.sin(q), 2) + F.cos(beta(a)) * F.cos(beta(b)) * F.pow(F.sin(dl), 2)
    sigma = 2 * F.asin(F.sqrt(F.least(h, F.lit(1.0))))
    x = (sigma - F.sin(sigma)) * F.pow(F.sin(p) * F.cos(q), 2) / F.pow(F.cos(sigma / 2), 2)
    y = (sigma + F.sin(sigma)) * F.pow(F.cos(p) * F.sin(q), 2) / F.nullif(F.pow(F.sin(sigma / 2), 2), F.lit(0.0))
    return F.when(sigma == 0, 0.0).otherwise(A * (sigma - f / 2 * (x + y)))


def degrees_area(width_deg: Column, height_deg: Column, lat: Column) -> Column:
    """Hectares of a cell in degrees, at 111,320 m for a degree."""
    return width_deg * 111_320 * F.cos(F.radians(lat)) * height_deg * 111_320 / 10_000
