"""Rasters as pixel tables: one row per pixel and scene, bands as columns, null for no data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.functions.values import exact_avg, mapped, safe_ratio
from sitelens.operators.graph import components
from sitelens.operators.storage import drop, numbered, settle

CLASSES = {1: "vegetacao_densa", 2: "vegetacao_rala", 3: "solo_exposto_obras", 4: "construida_urbana", 5: "agua"}
# Codes of three land cover products in our five classes; other codes are no data (0).
NINE_CLASSES = {0: 5, 1: 1, 2: 2, 3: 5, 4: 2, 5: 2, 6: 4, 7: 3, 8: 5}
WORLD_COVER = {10: 1, 20: 2, 30: 2, 40: 2, 50: 4, 60: 3, 70: 0, 80: 5, 90: 0, 95: 0, 100: 0}
MAPBIOMAS = {1: 1, 3: 1, 4: 1, 5: 1, 6: 1, 49: 1, 10: 2, 11: 0, 12: 2, 32: 3, 29: 3, 50: 2, 14: 2, 15: 2, 18: 2, 19: 2, 39: 2, 20: 2, 40: 2, 62: 2, 41: 2, 36: 2, 46: 2, 47: 2, 35: 2, 48: 2, 9: 1, 21: 2, 22: 3, 23: 3, 24: 4, 30: 3, 25: 3, 26: 5, 33: 5, 31: 5, 27: 0}
# Years that both sensors cover, and slope and offset of each band of the newer sensor on the older one's scale.
OVERLAP = (2019, 2020, 2021)
BANDPASS = {"blue": (0.9778, -0.0040), "green": (1.0053, -0.0009), "red": (0.9765, 0.0009), "nir": (0.9983, -0.0001), "swir1": (0.9987, -0.0011), "swir2": (1.0030, -0.0012)}
BANDS = ["blue", "green", "red", "nir", "swir1", "swir2"]
INDICES = ["ndvi", "evi", "ndwi", "mndwi", "ndbi", "bsi", "ndmi"]
#: Bits 1 to 4 of the quality band: dilated cloud, cirrus, cloud and shadow. Dating looks at bits 3 and 4 only.
CLOUD_MASK, DATING_MASK = 30, 24


def landsat_reflectance(dn: Column) -> Column:
    return dn * F.lit(0.0000275) - F.lit(0.2)


def sentinel_reflectance(dn: Column, slope: float = 1.0, offset: float = 0.0) -> Column:
    return dn / F.lit(10000.0) * F.lit(slope) + F.lit(offset)


def harmonized(dn: Column, band: str) -> Column:
    """Reflectance of one of BANDS from the newer sensor, on the older one's scale."""
    return sentinel_reflectance(dn, *BANDPASS[band])


def remap_table(source: str) -> dict[int, int]:
    """The class table of a source of labels; an unknown one is an error."""
    tables = {"dynamic_world": NINE_CLASSES, "worldcover": WORLD_COVER, "mapbiomas": MAPBIOMAS}
    if source not in tables:
        raise ValueError(f"source {source}: one of {sorted(tables)}")
    return tables[source]


def celsius(dn: Column) -> Column:
    return dn * F.lit(0.02) - F.lit(273.15)


def indices(pixels: DataFrame, names: list[str] = INDICES) -> DataFrame:
    """Adds spectral indices; a pixel with any null band or too small a denominator has all of them null."""
    b, g, r, n, s1, _ = (F.col(x) for x in BANDS)
    known = {
        "ndvi": safe_ratio(n - r, n + r),
        "evi": safe_ratio((n - r) * F.lit(2.5), n + r * F.lit(6.0) - b * F.lit(7.5) + F.lit(1.0), high=2.5),
        "ndwi": safe_ratio(g - n, g + n),
        "mndwi": safe_ratio(g - s1, g + s1),
        "ndbi": safe_ratio(s1 - n, s1 + n),
        "bsi": safe_ratio((s1 + r) - (n + b), (s1 + r) + (n + b)),
        "ndmi": safe_ratio(n - s1, n + s1),
    }
    made = {c: known[c] for c in names}
    out = pixels.withColumns(made)
    sound = F.lit(True)
    for c in [*BANDS, *made]:
        sound = sound & F.col(c).isNotNull()
    return out.withColumns({c: F.when(sound, F.col(c)) for c in made})


def composite(pixels: DataFrame, pixel: list[str], bands: list[str]) -> DataFrame:
    """Per-pixel median of each band over time."""
    return pixels.groupBy(*pixel).agg(*[F.median(b).alias(b) for b in bands])


def mode(pixels: DataFrame, pixel: list[str], code: str) -> DataFrame:
    """Per-pixel most frequent code; ties go to the least."""
    counts = pixels.where(F.col(code).isNotNull()).groupBy(*pixel, code).agg(F.count("*").alias("n"))
    return counts.groupBy(*pixel).agg(F.min_by(F.struct(code, "n"), F.struct((-F.col("n")).alias("o"), code)).alias("b")).select(*pixel, f"b.{code}", "b.n")


def histogram(pixels: DataFrame, by: list[str], code: str) -> DataFrame:
    """Pixels of classes 1 to 5 by group, zeros included, with shares of all and of valid pixels."""
    counts = pixels.groupBy(*by).agg(*[F.count(F.when(F.col(code) == k, 1)).alias(str(k)) for k in CLASSES], F.count("*").alias("n_total"))
    wide = counts.withColumn("n_valid", sum(F.col(str(k)) for k in CLASSES))
    rows = wide.unpivot([*by, "n_total", "n_valid"], [str(k) for k in CLASSES], "classe", "n").withColumn("classe", F.col("classe").cast("int"))
    share = lambda d: F.when(F.col(d) > 0, F.col("n").cast("double") * F.lit(100.0) / F.col(d))
    return rows.withColumn("pct_total", share("n_total")).withColumn("pct_validos", share("n_valid"))


def areas(counts: DataFrame, resolution: float, factors: DataFrame) -> DataFrame:
    """Square metres and hectares by class, multiplied by the class's sensor factor where there is one (classe, fator)."""
    out = counts.join(F.broadcast(factors), "classe", "left")
    return out.withColumn("area_m2", F.col("n").cast("double") * F.lit(resolution * resolution)).withColumn("area_ha", F.col("area_m2") / F.lit(10000.0)).withColumn("area_ha_corrigida", F.col("area_ha") * F.coalesce("fator", F.lit(1.0)))


def checked(counts: DataFrame, by: list[str]) -> DataFrame:
    """Fails where the shares of a group with valid pixels do not add up to 100 within 0.01."""
    total = counts.groupBy(*by).agg(F.sum("pct_validos").alias("s"))
    return total.withColumn("ok", F.when(F.col("s").isNull() | (F.abs(F.col("s") - 100) <= 0.01), True).otherwise(F.raise_error(F.lit("class shares do not add up to 100")).cast("boolean")))


def zonal(zones: DataFrame, points: DataFrame, km: float, value: str) -> DataFrame:
    """Mean, sum, and count of points' values within km of each zone's centre (zone, lat, lon), through grid cells.

    Points of one place go in as their sum and count, and centres of one place are searched for once, so work follows the places that differ, not rows times rows.
    """
    exact = F.col(value).cast("decimal(28,6)")
    near = geo.around(zones.select("lat", "lon").distinct(), "lat", "lon", km * (1 + 1e-9))
    spots = points.groupBy(F.col("lat").alias("plat"), F.col("lon").alias("plon")).agg(F.sum(exact).alias("s"), F.count(value).alias("c"))
    own = geo.placed(spots, "plat", "plon", km * (1 + 1e-9))
    met = near.join(own, ["cy", "cx"]).where(geo.haversine(F.col("lat"), F.col("lon"), F.col("plat"), F.col("plon")) <= km)
    told = met.groupBy("lat", "lon").agg(F.sum("s").alias("s"), F.sum("c").alias("c"))
    sums = zones.select("zone", "lat", "lon").join(told, ["lat", "lon"]).groupBy("zone").agg(F.sum("s").cast("double").alias("sum_v"), F.sum("c").alias("n"))
    return sums.select("zone", F.try_divide("sum_v", F.col("n").cast("double")).alias("mean_v"), "sum_v", "n")


def widened(rows: DataFrame, by: list[str], month: str, valid: str, first: int, last: int, widths: tuple[int, ...] = (0, 1, 2), least: float = 90.0) -> DataFrame:
    """Valid percentage within the narrowest month window that reaches `least`, else within the widest."""
    m = F.col(month)
    picks = [F.coalesce(F.try_divide(F.count(F.when(m.between(first - w, last + w) & F.col(valid), 1)).cast("double") * F.lit(100.0), F.count(F.when(m.between(first - w, last + w), 1)).cast("double")), F.lit(0.0)) for w in widths]
    stats = rows.groupBy(*by).agg(F.array(*picks).alias("p"))
    chosen = F.lit(len(widths) - 1)
    for k in reversed(range(len(widths) - 1)):
        chosen = F.when(F.col("p")[k] >= least, F.lit(k)).otherwise(chosen)
    return stats.withColumn("width", F.array(*[F.lit(w) for w in widths])[chosen]).withColumn("pct_valid", F.col("p")[chosen]).drop("p")


def labelled(pixels: DataFrame, by: list[str], code: str, scenes: int = 1 << 20) -> DataFrame:
    """Pixels (columns row, col) with id and component: the least id of their 4-connected patch of equal code.

    A pixel is named by the number of its scene (values of `by` and code) and its packed place, so no two share a name: up to
    `scenes` scenes, rows below 2**21 and columns below 2**21 - 1; beyond either it is an error.
    """
    known = numbered(pixels.select(*by, code).distinct(), [*by, code], "_scene")
    at = F.expr("(_scene << 42) | (cast(row as bigint) << 21) | cast(col as bigint)")
    sound = F.expr(f"_scene < {scenes} and row between 0 and 2097151 and col between 0 and 2097150")
    same = [F.col(f"p.{c}").eqNullSafe(F.col(f"s.{c}")) for c in (*by, code)]
    named = pixels.alias("p").join(known.alias("s"), same).select("p.*", "s._scene")
    named = named.withColumn("id", F.when(sound, at).otherwise(F.raise_error(F.lit("too many scenes, or a pixel out of bounds")).cast("bigint"))).drop("_scene")
    steps = named.select("id", F.explode(F.array(F.col("id") + 1, F.col("id") + F.lit(1 << 21))).alias("to"))
    edges = steps.join(named.select(F.col("id").alias("to")), "to").select(F.col("id").alias("a"), F.col("to").alias("b"))
    return named.join(components(edges), "id", "left").withColumn("component", F.coalesce("component", "id"))


def patches(pixels: DataFrame, by: list[str], code: str, least: float, resolution: float) -> DataFrame:
    """4-connected patches of equal code (see labelled): area by group and code of those of at least `least` square metres."""
    out = labelled(pixels, by, code)
    sizes = out.groupBy(*by, code, "component").agg((F.count("*") * F.lit(resolution * resolution)).alias("area_m2"))
    return sizes.where(F.col("area_m2") >= least).groupBy(*by, code).agg(F.sum("area_m2").alias("area_m2"), F.count("*").alias("n_patches"))


def valid_percent(pixels: DataFrame, by: list[str], band: str) -> DataFrame:
    """Percentage of pixels whose first band is not null; 0 for none."""
    return pixels.groupBy(*by).agg(F.coalesce(F.try_divide(F.count(band).cast("double") * F.lit(100.0), F.count("*").cast("double")), F.lit(0.0)).alias("pct_valid"))


def distribution(pixels: DataFrame, by: list[str], code: str) -> DataFrame:
    """Pixels of each code that occurs, 0 (no data) too, with shares of all and of valid pixels; the latter is null for 0."""
    sizes = pixels.groupBy(*by, code).agg(F.count("*").alias("n"))
    group = Window.partitionBy(*by)
    out = sizes.withColumn("n_total", F.sum("n").over(group)).withColumn("n_valid", F.sum(F.when(F.col(code) != 0, F.col("n")).otherwise(0)).over(group))
    pct = lambda d: F.col("n").cast("double") * F.lit(100.0) / F.col(d)
    return out.withColumn("pct_total", pct("n_total")).withColumn("pct_validos", F.when((F.col(code) != 0) & (F.col("n_valid") > 0), pct("n_valid")))


def series_band(sensor: Column, year: Column, treatment: Column, factor: Column) -> tuple[Column, Column]:
    """The factor of a class's area and the name of the part of the series it is in.

    Only years of the older sensor before the overlap are corrected, where the class's treatment is `b` and its site has a factor.
    """
    newer, overlap = sensor == "sentinel2", year.isin(*OVERLAP)
    corrected = ~newer & ~overlap & F.coalesce((treatment == "b") & factor.isNotNull(), F.lit(False))
    name = F.when(newer, "sentinel2_oficial_2019_2025").when(overlap, "landsat_overlap_referencia").when(corrected, "landsat_pre2019_corrigido_sv20").otherwise("landsat_pre2019_nao_corrigido")
    return F.when(corrected, factor).otherwise(F.lit(1.0)), name


def area_series(counts: DataFrame, factors: DataFrame, resolution: float) -> DataFrame:
    """Area rows (site, sensor, ano, classe, n, n_valid) with m2, ha, % valid, the sensor's factor, corrected ha and the band of the series.

    factors has classe, tratamento, site, fator; a class or site without one has factor 1.
    """
    joined = counts.join(factors, ["classe", "site"], "left")
    factor, band = series_band(F.col("sensor"), F.col("ano"), F.col("tratamento"), F.col("fator"))
    m2 = F.col("n").cast("double") * F.lit(resolution * resolution)
    out = joined.withColumns({"area_m2": m2, "area_ha": m2 / F.lit(10000.0), "pct_validos": F.try_divide(F.col("n").cast("double") * F.lit(100.0), F.col("n_valid")), "fator_correcao_sensor": factor, "faixa_serie": band})
    return out.withColumn("area_ha_corrigida", F.col("area_ha") * F.col("fator_correcao_sensor")).drop("tratamento", "fator", "n", "n_valid")


def mean_celsius(scenes: DataFrame, pixel: list[str], dn: str) -> DataFrame:
    """Per-pixel mean of scaled surface temperature over time, in degrees Celsius."""
    return scenes.groupBy(*pixel).agg(celsius(exact_avg(F.col(dn))).alias("celsius"))


def zone_classes(histogram: DataFrame, table: dict[int, int]) -> DataFrame:
    """Pixels by zone and our class from (zone, code, n): codes without class are left out, and counts are rounded before they are added."""
    classe = mapped(F.col("code"), table, F.lit(0))
    return histogram.withColumn("classe", classe).where("classe <> 0").groupBy("zone", "classe").agg(F.sum(F.bround("n").cast("long")).alias("n"))


def vegetation_check(pixels: DataFrame, by: list[str], least: float = 0.5) -> DataFrame:
    """Median red and near infrared of pixels whose NDVI is above `least`, by group."""
    ndvi = safe_ratio(F.col("nir") - F.col("red"), F.col("nir") + F.col("red"))
    return pixels.where(ndvi > least).groupBy(*by).agg(F.median("red").alias("red"), F.median("nir").alias("nir"), F.count("*").alias("n"))


def resampled(points: DataFrame, grid: tuple[float, float, float, int, int], code: str) -> DataFrame:
    """Codes of points (x, y) on a grid (west, north, step, columns, rows) by the nearest cell centre: row, col, code.

    Of several points in a cell the one nearest its centre counts, then the least code. Never an average: codes are categories.
    """
    west, north, step, columns, rows = grid
    col, row = F.floor((F.col("x") - F.lit(west)) / F.lit(step)).cast("int"), F.floor((F.lit(north) - F.col("y")) / F.lit(step)).cast("int")
    own = points.withColumns({"row": row, "col": col}).where((F.col("row") >= 0) & (F.col("row") < rows) & (F.col("col") >= 0) & (F.col("col") < columns))
    off = lambda v, k: v - (k + F.lit(0.5)) * F.lit(step)
    dx, dy = off(F.col("x") - F.lit(west), F.col("col")), off(F.lit(north) - F.col("y"), F.col("row"))
    return own.withColumn("_d", dx * dx + dy * dy).groupBy("row", "col").agg(F.min_by(code, F.struct("_d", code)).alias(code))


def better_window(rows: DataFrame, by: list[str], month: str, valid: str, first: int, last: int, least: float = 90.0) -> DataFrame:
    """Valid percentage within the months, or within one more on both sides if it is below `least` there and above it here: only a better one is kept."""
    m = F.col(month)
    share = lambda w: F.coalesce(F.try_divide(F.count(F.when(m.between(first - w, last + w) & F.col(valid), 1)).cast("double") * F.lit(100.0), F.count(F.when(m.between(first - w, last + w), 1)).cast("double")), F.lit(0.0))
    both = rows.groupBy(*by).agg(share(0).alias("p0"), share(1).alias("p1"))
    wider = (F.col("p0") < least) & (F.col("p1") > F.col("p0"))
    return both.select(*by, wider.cast("int").alias("width"), F.when(wider, F.col("p1")).otherwise(F.col("p0")).alias("pct_valid"))


def stretched(rows: DataFrame, band: str, low: float, high: float) -> DataFrame:
    """Adds `stretched`: the band from its exact low to its high percentile as 0 to 1, clipped.

    Percentiles are interpolated between the two values around them. Equal values are counted before they are dealt by ranges;
    the driver gets one sum per range, and only ranges that hold a wanted place are looked at again.
    """
    values = rows.where(F.col(band).isNotNull()).groupBy(F.col(band).cast("double").alias("v")).agg(F.count("*").alias("c"))
    dealt = settle(values.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    before, n = [], 0
    for r in dealt.groupBy("part").agg(F.sum("c").alias("c"), F.min("v").alias("lo")).orderBy("lo").collect():
        before.append((r.part, n, n + r.c))
        n += r.c
    if not n:
        return rows.withColumn("stretched", F.lit(None).cast("double"))
    spots = [p * (n - 1) for p in (low, high)]
    at = {}
    for k in sorted({int(x) for x in spots} | {min(n - 1, int(x) + 1) for x in spots}):
        part, start, _ = next(x for x in before if k < x[2])
        upto = F.sum("c").over(Window.partitionBy("part").orderBy("v")) + start
        at[k] = dealt.where(F.col("part") == part).withColumn("upto", upto).where(F.col("upto") > k).agg(F.min("v")).first()[0]
    lo, hi = (at[int(x)] + (x - int(x)) * (at[min(n - 1, int(x) + 1)] - at[int(x)]) for x in spots)
    drop(dealt)
    return rows.withColumn("stretched", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.try_divide(F.col(band) - F.lit(lo), F.lit(hi - lo)))))
