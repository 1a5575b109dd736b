"""Text of times, distances, grades, names and colours, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Gradient in percent, and the colour there.
STOPS = [
    (-25, 100, 0, 180), (-15, 40, 80, 255), (-10, 0, 140, 255), (-5, 0, 200, 220), (0, 0, 210, 80),
    (5, 150, 220, 0), (10, 255, 200, 0), (15, 255, 110, 0), (20, 255, 20, 20), (25, 200, 0, 80),
]


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def time_short(sec: Column) -> Column:
    """m:ss; seconds may read 60."""
    return F.format_string("%d:%02d", F.floor(sec / 60), half_up(sec - 60 * F.floor(sec / 60)))


def time_long(sec: Column) -> Column:
    h, m = F.floor(sec / 3600), F.floor(sec / 60) % 60
    return F.when(h > 0, F.format_string("%dh %dm", h, m)).otherwise(F.format_string("%dm %02ds", m, half_up(sec - 60 * F.floor(sec / 60))))


def distance(m: Column, decimals: int = 1) -> Column:
    return F.when(m >= 1000, F.format_string(f"%.{decimals}f km", m / 1000)).otherwise(F.format_string("%.0f m", m))


def kilometres(m: Column) -> Column:
    return F.format_string("%.2f km", m / 1000)


def elevation(m: Column, decimals: int = 0) -> Column:
    return F.format_string(f"%.{decimals}f m", m)


def grade(p: Column, decimals: int = 1) -> Column:
    return F.concat(F.format_string(f"%.{decimals}f", p), F.lit("%"))


def thousands(n: Column) -> Column:
    return F.format_number(n, 0)


def file_size(n: Column) -> Column:
    return (
        F.when(n < 1024, F.format_string("%d B", n)).when(n < 1048576, F.format_string("%.0f KB", n / 1024.0)).otherwise(F.format_string("%.1f MB", n / 1048576.0))
    )


def gradient_colour(percent: Column, stops: list[tuple] = STOPS) -> Column:
    """rgb(r,g,b) between the stops that the gradient lies between, and that of the end stops beyond."""
    out = F.lit(None).cast("string")
    rgb = lambda *c: F.concat(F.lit("rgb("), F.concat_ws(",", *[half_up(x).cast("long").cast("string") for x in c]), F.lit(")"))
    last = stops[-1]
    out = F.when(percent >= last[0], rgb(*[F.lit(float(c)) for c in last[1:]]))
    for lo, hi in reversed(list(zip(stops, stops[1:], strict=False))):
        t = (percent - lo[0]) / float(hi[0] - lo[0])
        out = F.when((percent >= lo[0]) & (percent < hi[0]), rgb(*[a + t * float(b - a) for a, b in zip(lo[1:], hi[1:], strict=True)])).otherwise(out)
    first = stops[0]
    return F.when(percent < first[0], rgb(*[F.lit(float(c)) for c in first[1:]])).otherwise(out)


def file_part(v: Column) -> Column:
    """Text fit for a file name: no separators or control characters, single spaces."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.coalesce(v, F.lit("")), r'[<>:"/\\|?*\x00-\x1F]', " "), r"\s+", " "))


def clip(v: Column, most: int = 48) -> Column:
    return F.trim(F.substring(v, 1, most))


def place_label(address: Column, display: Column) -> Column:
    """The most telling part of an address map, else the first part of the display name."""
    roads = ["road", "pedestrian", "footway", "path", "cycleway", "residential"]
    areas = ["neighbourhood", "suburb", "hamlet", "village", "town", "city"]
    known = F.nullif(file_part(F.coalesce(*[F.nullif(address[k], F.lit("")) for k in roads + areas])), F.lit(""))
    first = F.nullif(file_part(F.split_part(display, F.lit(","), F.lit(1))), F.lit(""))
    return clip(F.coalesce(known, first, file_part(display)))


def download_name(start: Column, end: Column, fallback: Column) -> Column:
    """start-end, start-loop where both are one place, else the fallback."""
    a, b = F.nullif(clip(file_part(start)), F.lit("")), F.nullif(clip(file_part(end)), F.lit(""))
    return F.when(a.isNull() | b.isNull(), file_part(fallback)).when(F.lower(a) == F.lower(b), F.concat(a, F.lit("-loop"))).otherwise(F.concat_ws("-", a, b))


def coordinate_key(lat: Column, lon: Column) -> Column:
    return F.format_string("%.5f,%.5f", lat, lon)


def structure_name(tags: Column) -> Column:
    """Name of a bridge or tunnel from its tags."""
    named = [F.nullif(F.trim(tags[k]), F.lit("")) for k in ("name", "name:en", "ref", "bridge:name", "tunnel:name")]
    return F.coalesce(*named, capital(F.nullif(tags["highway"], F.lit(""))), F.when(tags["bridge"].isNotNull() | (tags["man_made"] == "viaduct"), "Bridge").otherwise("Tunnel"))


def capital(v: Column) -> Column:
    """The first letter in upper case."""
    return F.concat(F.upper(F.substring(v, 1, 1)), F.substring(v, 2, 1 << 30))


def safe_name(v: Column) -> Column:
    return F.regexp_replace(v, r"[^A-Za-z0-9._-]+", "_")


def safe_path(v: Column, fallback: Column) -> Column:
    """A relative path without parent steps; else the fallback."""
    p = F.ltrim(F.trim(F.coalesce(v, F.lit(""))), F.lit("/"))
    return F.when((p == "") | F.array_contains(F.split(p, "/"), ".."), fallback).otherwise(p)


def nice_step(rough: Column) -> Column:
    """1, 2, 5 or 10 times a power of ten, whichever is near; 1 for what is not positive."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.when(rough > 0, rough))))
    n = rough / power
    return F.coalesce(power * F.when(n < 1.5, 1.0).when(n < 3, 2.0).when(n < 7, 5.0).otherwise(10.0), F.lit(1.0))


def source_counts(header: Column) -> Column:
    """name:count pairs to a map; pairs without a count are left out."""
    return F.map_filter(F.transform_values(F.str_to_map(header, F.lit(","), F.lit(":")), lambda k, v: v.try_cast("long")), lambda k, v: v.isNotNull() & (F.trim(k) != ""))
