"""Map projections in closed form: transverse Mercator zones and the European equal-area grid, from lon/lat degrees."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Semi-major axis and inverse flattening of GRS80, which all of these grids use.
AXIS, INVERSE = 6_378_137.0, 298.257222101
E2 = (2 - 1 / INVERSE) / INVERSE
E1 = math.sqrt(E2)

#: EPSG code, central meridian, scale and false easting and northing of the zones in use.
ZONES = {25831: (3, 0.9996, 500_000, 0), 25832: (9, 0.9996, 500_000, 0), 25833: (15, 0.9996, 500_000, 0), 3067: (27, 0.9996, 500_000, 0), 2180: (19, 0.9993, 500_000, -5_300_000), 3794: (15, 0.9999, 500_000, -5_000_000)}


def transverse_mercator(lat: Column, lon: Column, epsg: int) -> tuple[Column, Column]:
    """(easting, northing), by Krueger's series in the third flattening; millimetres within a zone."""
    meridian, scale, east, north = ZONES[epsg]
    n = (1 / INVERSE) / (2 - 1 / INVERSE)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    phi, lam = F.radians(lat), F.radians(lon - meridian)
    s = F.sin(phi)
    t = F.sinh(F.atanh(s) - E1 * F.atanh(E1 * s))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    x = eta + sum(a * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, a in enumerate(series))
    y = xi + sum(a * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, a in enumerate(series))
    return east + scale * radius * x, north + scale * radius * y


def in_zone(df: DataFrame, lat: str, lon: str, epsg: str) -> DataFrame:
    """df with easting and northing of its places, each in the zone that the column `epsg` names; null for codes that
    ZONES does not know. One formula whose constants are looked up, in steps, so that no step is worked out twice."""
    n = (1 / INVERSE) / (2 - 1 / INVERSE)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    series = [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16, 13 * n**2 / 48 - 3 * n**3 / 5, 61 * n**3 / 240]
    known = F.create_map(*[F.lit(v) for code, z in ZONES.items() for v in (code, [float(c) for c in z])])
    out = df.withColumn("__z", F.try_element_at(known, F.col(epsg)))
    out = out.withColumn("__s", F.sin(F.radians(lat))).withColumn("__l", F.radians(F.col(lon) - F.get("__z", F.lit(0))))
    out = out.withColumn("__t", F.sinh(F.atanh("__s") - E1 * F.atanh(E1 * F.col("__s"))))
    out = out.withColumn("__xi", F.atan2("__t", F.cos("__l"))).withColumn("__eta", F.atanh(F.sin("__l") / F.sqrt(1 + F.col("__t") * F.col("__t"))))
    wave = lambda k: 2.0 * (k + 1)
    x = F.col("__eta") + sum(a * F.cos(wave(k) * F.col("__xi")) * F.sinh(wave(k) * F.col("__eta")) for k, a in enumerate(series))
    y = F.col("__xi") + sum(a * F.sin(wave(k) * F.col("__xi")) * F.cosh(wave(k) * F.col("__eta")) for k, a in enumerate(series))
    scale = F.get("__z", F.lit(1)) * radius
    out = out.withColumn("easting", F.get("__z", F.lit(2)) + scale * x).withColumn("northing", F.get("__z", F.lit(3)) + scale * y)
    return out.drop("__z", "__s", "__l", "__t", "__xi", "__eta")


def in_degrees(df: DataFrame, easting: str, northing: str, epsg: str) -> DataFrame:
    """df with lat and lon of its places, each from the grid that the column `epsg` names: a zone of ZONES, 3035 (equal
    area), or degrees (4326 and other geographic codes of the same ellipsoids); null for codes that are not known."""
    n = (1 / INVERSE) / (2 - 1 / INVERSE)
    radius = AXIS / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    back = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96, n**2 / 48 + n**3 / 15, 17 * n**3 / 480]
    lift = [2 * n - 2 * n**2 / 3 - 2 * n**3, 7 * n**2 / 3 - 8 * n**3 / 5, 56 * n**3 / 15]
    known = F.create_map(*[F.lit(v) for code, z in ZONES.items() for v in (code, [float(c) for c in z])])
    wave = lambda k: 2.0 * (k + 1)
    out = df.withColumn("__z", F.try_element_at(known, F.col(epsg))).withColumn("__x", F.col(easting).cast("double")).withColumn("__y", F.col(northing).cast("double"))
    scale = F.get("__z", F.lit(1)) * radius
    out = out.withColumn("__xi", (F.col("__y") - F.get("__z", F.lit(3))) / scale).withColumn("__eta", (F.col("__x") - F.get("__z", F.lit(2))) / scale)
    xi = F.col("__xi") - sum(b * F.sin(wave(k) * F.col("__xi")) * F.cosh(wave(k) * F.col("__eta")) for k, b in enumerate(back))
    eta = F.col("__eta") - sum(b * F.cos(wave(k) * F.col("__xi")) * F.sinh(wave(k) * F.col("__eta")) for k, b in enumerate(back))
    out = out.withColumn("__u", xi).withColumn("__v", eta)
    out = out.withColumn("__chi", F.asin(F.sin("__u") / F.cosh("__v")))
    lat = F.degrees(F.col("__chi") + sum(d * F.sin(wave(k) * F.col("__chi")) for k, d in enumerate(lift)))
    lon = F.get("__z", F.lit(0)) + F.degrees(F.atan2(F.sinh("__v"), F.cos("__u")))
    elat, elon = equal_area_degrees(F.col("__x"), F.col("__y"))
    plain = F.col(epsg).isin(4326, 4258, 4269)
    pick = lambda zone, area, own: F.when(F.col("__z").isNotNull(), zone).when(F.col(epsg) == 3035, area).when(plain, own)
    out = out.withColumn("lat", pick(lat, elat, F.col("__y"))).withColumn("lon", pick(lon, elon, F.col("__x")))
    return out.drop("__z", "__x", "__y", "__xi", "__eta", "__u", "__v", "__chi")


def equal_area_degrees(x: Column, y: Column) -> tuple[Column, Column]:
    """(lat, lon) of a place on the equal-area grid of Europe, EPSG 3035; the latitude by its series in the
    eccentricity."""
    authalic = lambda s: (1 - E2) * (s / (1 - E2 * s * s) + math.atanh(E1 * s) / E1)
    phi0 = math.radians(52)
    qp, q0 = authalic(1.0), authalic(math.sin(phi0))
    b0, rq = math.asin(q0 / qp), AXIS * math.sqrt(qp / 2)
    d = AXIS * math.cos(phi0) / (math.sqrt(1 - E2 * math.sin(phi0) ** 2) * rq * math.cos(b0))
    u, v = (x - 4_321_000) / d, (y - 3_210_000) * d
    rho = F.sqrt(u * u + v * v)
    c = 2 * F.asin(rho / (2 * rq))
    beta = F.asin(F.cos(c) * math.sin(b0) + F.when(rho > 0, v * F.sin(c) * math.cos(b0) / rho).otherwise(0.0))
    east = F.atan2(u * F.sin(c), rho * math.cos(b0) * F.cos(c) - v * math.sin(b0) * F.sin(c))
    series = [E2 / 3 + 31 * E2**2 / 180 + 517 * E2**3 / 5040, 23 * E2**2 / 360 + 251 * E2**3 / 3780, 761 * E2**3 / 45360]
    lat = beta + sum(a * F.sin(2.0 * (k + 1) * beta) for k, a in enumerate(series))
    return F.degrees(lat), 10 + F.degrees(F.when(rho > 0, east).otherwise(0.0))


def equal_area(lat: Column, lon: Column) -> tuple[Column, Column]:
    """(easting, northing) on the equal-area grid of Europe, EPSG 3035."""
    authalic = lambda s: (1 - E2) * (s / (1 - E2 * s * s) + (F if isinstance(s, Column) else math).atanh(E1 * s) / E1)
    phi0, lam0 = math.radians(52), math.radians(10)
    qp, q0 = authalic(1.0), authalic(math.sin(phi0))
    b0, rq = math.asin(q0 / qp), AXIS * math.sqrt(qp / 2)
    d = AXIS * math.cos(phi0) / (math.sqrt(1 - E2 * math.sin(phi0) ** 2) * rq * math.cos(b0))
    beta = F.asin(authalic(F.sin(F.radians(lat))) / qp)
    lam = F.radians(lon) - lam0
    b = rq * F.sqrt(2 / (1 + math.sin(b0) * F.sin(beta) + math.cos(b0) * F.cos(beta) * F.cos(lam)))
    x = b * d * F.cos(beta) * F.sin(lam)
    y = b / d * (math.cos(b0) * F.sin(beta) - math.sin(b0) * F.cos(beta) * F.cos(lam))
    return 4_321_000 + x, 3_210_000 + y


def tile_code(lat: Column, lon: Column, size: int = 50_000) -> Column:
    """Name of the grid square of the equal-area grid that holds a point."""
    x, y = equal_area(lat, lon)
    side = lambda v: (F.floor(v / size) * size).cast("string")
    return F.concat(F.lit(f"CRS3035RES{size}mN"), side(y), F.lit("E"), side(x))


def parsed_tile_code(text: Column) -> Column:
    """struct(size, north, east) of the first grid square named in a text; null if there is none."""
    pattern = r"CRS3035RES(\d+)mN(\d+)E(\d+)"
    part = lambda i: F.regexp_extract(text, pattern, i).try_cast("long")
    return F.when(text.rlike(pattern), F.struct(part(1).alias("size"), part(2).alias("north"), part(3).alias("east")))


def pixels(degrees: Column, metres_per_degree: float) -> Column:
    """Whole metres, halves to even."""
    return F.bround(degrees * metres_per_degree, 0).cast("long")
