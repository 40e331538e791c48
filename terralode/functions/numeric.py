"""Column functions on numbers: tolerant casts, scores, classes and indices."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Weights of the indices.
CRITICALITY = {"slope": 0.15, "flow": 0.30, "twi": 0.25, "distance": 0.15, "history": 0.15}
CANAL_PRIORITY = {"flow": 0.40, "slope": 0.30, "critical_zone": 0.30}
ROAD_RISK = {"flow": 0.30, "slope": 0.25, "twi": 0.25, "drainage": 0.20}
MAINTENANCE = {"centrality": 0.30, "flow_acc": 0.25, "upstream_hci": 0.25, "conflict_count": 0.20}
# Points and factors of the flood risk, by bands of each metric; the first band that holds counts.
FLOOD_POINTS = {
    "hand": [("<", 0.5, 40, "HAND muy bajo (<0.5m): zona extremadamente baja"), ("<", 1.0, 30, "HAND bajo (<1m): zona baja, susceptible a inundación"), ("<", 2.0, 15, "HAND moderado (<2m)")],
    "twi": [(">", 14, 30, "TWI alto (>14): alta acumulación de agua"), (">", 11, 20, "TWI moderado (>11): acumulación moderada"), (">", 8, 5, None)],
    "flow": [(">", 100_000, 20, "Flow accumulation extremo: recibe mucha agua upstream"), (">", 10_000, 10, "Flow accumulation alto")],
    "slope": [("<", 0.3, 10, "Pendiente muy baja (<0.3°): agua no drena"), ("<", 0.5, 5, None)],
}
# Runoff coefficients (per cent) of land-cover classes.
LAND_COVER_C = {10: 20, 20: 35, 30: 40, 40: 55, 50: 75, 60: 65, 70: 10, 80: 5, 90: 15, 95: 20, 100: 30}


def safe_double(c: Column) -> Column:
    """A number, or 0 for null and for what isn't one."""
    return F.coalesce(c.try_cast("double"), F.lit(0.0))


def hectares(m2: Column) -> Column:
    """Square metres as hectares to one decimal; null stays null."""
    return F.round(m2.try_cast("double") / 10_000, 1)


def percent(part: Column, whole: Column, digits: int = 1) -> Column:
    """0 where the whole isn't positive."""
    return F.when(whole > 0, F.round(100.0 * part / whole, digits)).otherwise(F.lit(0.0))


def clamp(c: Column, low: float, high: float) -> Column:
    """Null stays null."""
    return F.when(c.isNotNull(), F.least(F.greatest(c, F.lit(low)), F.lit(high)))


def score(c: Column) -> Column:
    return F.round(clamp(c, 0.0, 100.0), 2)


def min_max(c: Column, low: Column, high: Column) -> Column:
    """0 where all values are equal."""
    return F.when(high == low, F.lit(0.0)).otherwise((c - low) / (high - low))


def weighted(parts: Iterable[tuple[Column, float]]) -> Column:
    return sum((c * w for c, w in parts), F.lit(0.0))


def criticality(slope: Column, flow: Column, twi: Column, distance: Column, history: Column) -> Column:
    """The hydric criticality index, 0 to 100, of five factors from 0 to 1."""
    return score(100 * weighted(zip((slope, flow, twi, distance, history), CRITICALITY.values(), strict=True)))


def near(distance_m: Column, reach: float = 5000.0) -> Column:
    """1 at no distance, 0 from reach on."""
    return F.greatest(1 - distance_m / reach, F.lit(0.0))


def risk_level(c: Column) -> Column:
    return F.when(c >= 75, "critico").when(c >= 50, "alto").when(c >= 25, "medio").otherwise("bajo")


def conflict_severity(accumulation: Column, slope: Column) -> Column:
    return F.when((accumulation > 5000) | (slope < 0.5), "alta").when((accumulation > 2000) | (slope < 2), "media").otherwise("baja")


def canal_priority(max_flow: Column, mean_slope: Column, zone_m: Column) -> Column:
    """0 to 100 from the greatest flow (of 10,000), the mean slope (of 10 degrees) and the nearness of a critical zone
    (1 km; null: none is known); 0 where flow or slope wasn't sampled."""
    zone = F.coalesce(F.greatest(1 - zone_m / 1000.0, F.lit(0.0)), F.lit(0.0))
    parts = (F.least(max_flow / 10_000.0, F.lit(1.0)), F.least(mean_slope / 10.0, F.lit(1.0)), zone)
    known = max_flow.isNotNull() & mean_slope.isNotNull()
    return F.when(known, score(100 * weighted(zip(parts, CANAL_PRIORITY.values(), strict=True)))).otherwise(F.lit(0.0))


def road_risk(max_flow: Column, mean_slope: Column, mean_twi: Column, drainage_m: Column) -> Column:
    """0 to 100; a flat and wet road near a drain (500 m; null: none is known) is at risk; 0 where a raster wasn't sampled."""
    drain = F.coalesce(F.greatest(1 - drainage_m / 500.0, F.lit(0.0)), F.lit(0.0))
    parts = (F.least(max_flow / 10_000.0, F.lit(1.0)), F.greatest(1 - mean_slope / 5.0, F.lit(0.0)), clamp(mean_twi / 15.0, 0.0, 1.0), drain)
    known = max_flow.isNotNull() & mean_slope.isNotNull() & mean_twi.isNotNull()
    return F.when(known, score(100 * weighted(zip(parts, ROAD_RISK.values(), strict=True)))).otherwise(F.lit(0.0))


def gap_severity(hci: Column, km: Column) -> Column:
    return F.when((hci > 80) & (km > 5), "critico").when((hci > 60) & (km > 3), "alto").otherwise("moderado")


def zonal_share(mean: Column, most: float) -> Column:
    """A zonal mean as a share of its greatest value, 0 to 1; 0.5 where there is none."""
    return F.coalesce(clamp(mean / most, 0.0, 1.0), F.lit(0.5))


def runoff_c(land_class: Column) -> Column:
    """The runoff coefficient of a land-cover class; 0.4 for unknown ones."""
    known = F.create_map([F.lit(x) for pair in LAND_COVER_C.items() for x in pair])
    return F.coalesce(known[land_class.cast("int")], F.lit(40)) / 100.0


def rational_flow(c: Column, mm_per_hour: Column, hectares: Column) -> Column:
    """Cubic metres a second by the rational method."""
    return c * mm_per_hour * hectares / 360.0


def kirpich(length_m: Column, slope: Column) -> Column:
    """Minutes of concentration; slope as a share, at least 0.0001."""
    return 0.0195 * F.pow(length_m, F.lit(0.77)) * F.pow(F.greatest(slope, F.lit(1e-4)), F.lit(-0.385))


def flood_points(hand: Column, twi: Column, flow: Column, slope: Column) -> tuple[Column, Column]:
    """Points (capped at 100) and the factors that gave them; metrics that are null give none."""
    points, factors = F.lit(0), []
    for c, bands in zip((hand, twi, flow, slope), FLOOD_POINTS.values(), strict=True):
        holds = [(c < edge if sign == "<" else c > edge) for sign, edge, _, _ in bands]
        won, factor = F.lit(0), F.lit(None).cast("string")
        for h, (_, _, n, name) in reversed(list(zip(holds, bands, strict=True))):
            won, factor = F.when(h, n).otherwise(won), F.when(h, F.lit(name).cast("string")).otherwise(factor)
        points = points + won
        factors.append(factor)
    return F.least(points, F.lit(100)), F.array_compact(F.array(*factors))


def flood_level(points: Column) -> Column:
    return F.when(points >= 70, "critico").when(points >= 50, "alto").when(points >= 30, "moderado").otherwise("bajo")


def trend(first: Column, last: Column, dead_band: float = 1.0) -> Column:
    return F.when(last > first + dead_band, "increasing").when(last < first - dead_band, "decreasing").otherwise("stable")


def first_last_change(rows: DataFrame, group: str, day: str, area: str, share: str) -> DataFrame:
    """(group, from_date, to_date, area_change, share_change, trend) between the first and the last successful day of each group
    with two at least; changes are rounded to two digits, the trend is judged before."""
    ends = rows.groupBy(group).agg(F.min(F.struct(day, area, share)).alias("first"), F.max(F.struct(day, area, share)).alias("last"), F.count("*").alias("n")).where("n > 1")
    change = lambda c: F.round(F.col(f"last.{c}") - F.col(f"first.{c}"), 2)
    return ends.select(
        group, F.col(f"first.{day}").alias("from_date"), F.col(f"last.{day}").alias("to_date"), change(area).alias("area_change"), change(share).alias("share_change"),
        trend(F.col(f"first.{share}"), F.col(f"last.{share}")).alias("trend"),
    )


def land_class(sar: Column, ndvi: Column) -> Column:
    """1 water, 2 dense and 4 sparse vegetation, 3 bare soil, 0 unknown; water by radar goes before the index."""
    return F.when(sar < -15.0, 1).when(ndvi > 0.5, 2).when(ndvi > 0.2, 4).when(ndvi > -0.1, 3).otherwise(0)


def vegetation_class(ndvi: Column, ndwi: Column) -> Column:
    """Classes by index: water, dense and sparse vegetation, bare soil."""
    return F.when(ndwi > 0.3, "agua").when(ndvi > 0.5, "vegetacion_densa").when(ndvi > 0.2, "vegetacion_rala").otherwise("suelo_desnudo")


def rescaled(c: Column, low: float, high: float) -> Column:
    """A range as whole numbers from 0 to 255, clipped."""
    return F.floor(clamp((c - low) / (high - low), 0.0, 1.0) * 255).cast("int")


def log_rescaled(c: Column, high: float = 13.0) -> Column:
    """The logarithm of 1 + value as 0 to 255; 0 for what isn't positive."""
    return rescaled(F.when(c > 0, F.log1p(c)).otherwise(F.lit(0.0)), 0.0, high)


def ratio_index(a: Column, b: Column) -> Column:
    """(a - b) / (a + b), 0 where the sum is 0: NDWI, NDVI and their like."""
    return F.when(a + b == 0, F.lit(0.0)).otherwise((a - b) / (a + b))


def pixel_to_world(col: Column, row: Column, left: float, top: float, size: float) -> tuple[Column, Column]:
    """The place of a pixel's corner; rows grow downwards."""
    return left + col * size, top - row * size


def world_to_pixel(x: Column, y: Column, left: float, top: float, size: float) -> tuple[Column, Column]:
    """Column and row of the pixel that holds a place."""
    return F.floor((x - left) / size).cast("long"), F.floor((top - y) / size).cast("long")


def in_ranges(c: Column, ranges: Sequence[tuple[float, float | None]], chosen: Sequence[int]) -> Column:
    """Whether a value lies in one of the chosen ranges, which are half-open; the last one has no end. Null does not."""
    hit = F.lit(False)
    for i in chosen:
        low, high = ranges[i]
        hit = hit | ((c >= low) if i == len(ranges) - 1 or high is None else (c >= low) & (c < high))
    return F.coalesce(hit, F.lit(False))


def segmentation(rows: DataFrame, group: str, pred: Column, target: Column, valid: Column) -> DataFrame:
    """By group: overlap, F1, precision and recall of the valid pixels, the weight of the rarer class (dry over wet, at most
    100) and how often wet samples are repeated to balance them."""
    n = lambda c, name: F.count_if(valid & c).alias(name)
    m = rows.groupBy(group).agg(n(pred & target, "tp"), n(pred & ~target, "fp"), n(~pred & target, "fn"), n(target, "wet"), n(~target, "dry"))
    tp, fp, fn, wet, dry = (F.col(c) for c in ("tp", "fp", "fn", "wet", "dry"))
    p, r = tp / (tp + fp + 1e-8), tp / (tp + fn + 1e-8)
    weight = F.when(wet > 0, F.least(dry / F.nullif(wet, F.lit(0)), F.lit(100.0))).otherwise(100.0)
    copies = F.when(wet > 0, F.greatest(F.floor(dry / F.nullif(wet, F.lit(0))), F.lit(1))).otherwise(1).cast("long")
    return m.select(
        group, F.round(tp / (tp + fp + fn + 1e-8), 4).alias("iou"), F.round(2 * p * r / (p + r + 1e-8), 4).alias("f1"), F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"),
        F.round(weight, 4).alias("pos_weight"), copies.alias("copies"),
    )


def terrain_rgb(height: Column) -> tuple[Column, Column, Column]:
    """A height in metres as three bytes: (h + 10000) * 10, clipped to 24 bits."""
    code = F.greatest(F.least(F.floor((height + 10_000) * 10), F.lit((1 << 24) - 1)), F.lit(0)).cast("long")
    return F.shiftright(code, 16).cast("int"), (F.shiftright(code, 8) % 256).cast("int"), (code % 256).cast("int")


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = (F.floor((lon + 180) / 6) + 1).cast("int")
    return F.when(lat >= 0, 32600 + zone).otherwise(32700 + zone)
