"""Collections of images as scene or pixel tables, and the panels of remote query services over local tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.values import bits_clear
from sitelens.operators import raster
from sitelens.operators.storage import settle


def season(scenes: DataFrame, ts: str, year: int | Column, first_month: int, last_month: int, last_day: Column | None = None) -> DataFrame:
    """Scenes of a year within calendar months. The end of the year is exclusive, so its last day is left out, as in the services that these come from.

    With `last_day`, that day of the last month is the exclusive end instead (labels end on the 30th).
    """
    y = F.lit(year) if isinstance(year, int) else year
    start, end = F.make_timestamp_ntz(y, F.lit(1), F.lit(1), F.lit(0), F.lit(0), F.lit(0)), F.make_timestamp_ntz(y, F.lit(12), F.lit(31), F.lit(0), F.lit(0), F.lit(0))
    if last_day is not None:
        end = F.make_timestamp_ntz(y, F.lit(last_month), last_day, F.lit(0), F.lit(0), F.lit(0))
    t = F.col(ts).cast("timestamp_ntz")
    return scenes.where((t >= start) & (t < end) & F.month(ts).between(first_month, last_month))


def effective_year(year: Column, last: int) -> tuple[Column, Column]:
    """The year whose labels stand for `year`, and how many years off they are."""
    own = F.least(year, F.lit(last))
    return own, year - own


def nearest_in_time(rows: DataFrame, others: DataFrame, key: str, ts: str, value: str) -> DataFrame:
    """rows with the value of `others` nearest in time under the same key, either way, and how far: _near (null for none) and _gap in microseconds.

    Of values at the same distance the greater one counts. An as-of merge: both tables are dealt by ranges of key, time and a hash, so a
    single key is spread like many; a row finds the last value before it and the first one after it in its own range, and what lies over the
    range's borders comes from one row for each range. No pair of a row and a value is ever made but these two. Every row stays once, equal ones too; those with a null key or time
    have no value.
    """
    spark = rows.sparkSession
    t = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    kind = dict(others.select(key, value).dtypes)[value]
    values = others.where(F.col(key).isNotNull() & F.col(ts).isNotNull() & F.col(value).isNotNull()).groupBy(F.col(key).alias("k"), t(ts).alias("t")).agg(F.max(value).alias("v"))
    own = rows.select(F.col(key).alias("k"), t(ts).alias("t"), F.lit(None).cast(kind).alias("v"), F.struct(*rows.columns).alias("row"))
    values = values.select("k", "t", "v", F.lit(None).cast(own.schema["row"].dataType).alias("row"))
    both = own.unionAll(values).withColumn("salt", F.when(F.col("row").isNull(), F.lit(-(2**63))).otherwise(F.xxhash64("row")))
    dealt = settle(both.repartitionByRange("k", "t", "salt").withColumn("part", F.spark_partition_id()))
    spot = F.when(F.col("row").isNull(), F.struct("k", "t", "v"))
    ends = {r.part: (r.first, r.last) for r in dealt.groupBy("part").agg(F.min(spot).alias("first"), F.max(spot).alias("last")).collect()}
    carried, before = {}, None
    for part in sorted(ends):
        carried[part] = [part, before, None]
        before = ends[part][1] or before
    after = None
    for part in sorted(ends, reverse=True):
        carried[part][2] = after
        after = ends[part][0] or after
    shape = dealt.select(spot.alias("s")).schema["s"].dataType
    borders = spark.createDataFrame([tuple(x) for x in carried.values()], T.StructType([T.StructField("part", T.IntegerType()), T.StructField("before", shape), T.StructField("after", shape)]))
    up = Window.partitionBy("part").orderBy("k", "t", "salt").rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("part").orderBy(F.desc("k"), F.desc("t"), F.desc("salt")).rowsBetween(Window.unboundedPreceding, 0)
    met = dealt.withColumns({"p": F.last(spot, ignorenulls=True).over(up), "n": F.last(spot, ignorenulls=True).over(down)}).where(F.col("row").isNotNull())
    met = met.join(F.broadcast(borders), "part")  # one row for each range
    side = lambda c, border: F.coalesce(c, border)
    met = met.select("row", "k", "t", side(F.col("p"), F.col("before")).alias("p"), side(F.col("n"), F.col("after")).alias("n"))
    found = [F.when((F.col(f"{c}.k") == F.col("k")) & F.col("t").isNotNull(), F.struct((-F.abs(F.col("t") - F.col(f"{c}.t"))).alias("g"), F.col(f"{c}.v").alias("v"))) for c in "pn"]
    best = F.greatest(*found)
    return met.select("row.*", best["v"].alias("_near"), (-best["g"]).alias("_gap"))


def cloud_scored(images: DataFrame, scores: DataFrame, index: str, ts: str, score: str, least: float = 0.60, hours: int = 24) -> DataFrame:
    """images with the score nearest in time among those of the same index within `hours`, where it is `least` or more; ties by the higher score.

    Images without such a score are left out; equal images stay apart.
    """
    near = nearest_in_time(images, scores, index, ts, score).where((F.col("_gap") <= hours * 3_600_000_000) & (F.col("_near") >= least))
    return near.withColumn("cs_cdf", F.col("_near")).drop("_near", "_gap")


def both_sensors(newer: DataFrame, scores: DataFrame, older: DataFrame, index: str, ts: str, score: str, bands: list[str], least: float = 0.60, hours: int = 24, quality: str = "qa_pixel", saturated: str = "qa_radsat") -> DataFrame:
    """One collection of both sensors' images in the older one's scale: index, ts, sensor and the bands as reflectances.

    The newer sensor's are masked by the cloud score nearest in time and harmonised; the older one's by their quality bits and saturation. Null bands stay null.
    """
    new = cloud_scored(newer, scores, index, ts, score, least, hours)
    old = older.where(bits_clear(F.col(quality), raster.CLOUD_MASK) & (F.col(saturated) == 0))
    told = lambda df, name, scale: df.select(index, ts, F.lit(name).alias("sensor"), *[scale(b).alias(b) for b in bands])
    return told(new, "sentinel2", lambda b: raster.harmonized(F.col(b), b)).unionAll(told(old, "landsat", lambda b: raster.landsat_reflectance(F.col(b))))


def year_band(rows: DataFrame, prefix: str, year: Column, last: int) -> Column:
    """The value of the band `prefix`<year> for the year whose labels stand for `year` (see effective_year); null for a year without a band."""
    years = [c for c in rows.columns if c.startswith(prefix) and c[len(prefix) :].isdigit()]
    own = effective_year(year, last)[0]
    return F.coalesce(*[F.when(own == int(c[len(prefix) :]), F.col(c)) for c in years], F.lit(None))


def exact_or_newest(images: DataFrame, group: str, year: str, wanted: int, columns: list[str]) -> DataFrame:
    """By group the image of the wanted year, or else the newest."""
    rank = F.struct((F.col(year) == wanted).cast("int"), F.col(year))
    return images.groupBy(group).agg(F.max_by(F.struct(year, *columns), rank).alias("b")).select(group, "b.*")


def newest(images: DataFrame, group: str, ts: str, columns: list[str]) -> DataFrame:
    """The last image of each group; equal times by the greatest of the columns."""
    return images.groupBy(group).agg(F.max(F.struct(ts, *columns)).alias("b")).select(group, "b.*")


def painted(zones: DataFrame, pixels: DataFrame, code: str, cell: float = 1.0) -> DataFrame:
    """Pixels (x, y) with the code of the rectangle (west, south, east, north) they are in; of several the last one painted (greatest ordem).

    Both meet by grid cells of `cell`, so a pixel is compared with the rectangles of its own cell alone.
    """
    at = lambda c: F.floor(F.col(c) / F.lit(cell))
    z = zones.withColumn("cx", F.explode(F.sequence(at("west"), at("east")))).withColumn("cy", F.explode(F.sequence(at("south"), at("north"))))
    p = pixels.withColumns({"cx": at("x"), "cy": at("y")})
    inside = F.expr("p.cx = z.cx and p.cy = z.cy and p.x >= z.west and p.x < z.east and p.y >= z.south and p.y < z.north")
    met = p.alias("p").join(z.alias("z"), inside)
    return met.groupBy("p.x", "p.y").agg(F.max_by(f"z.{code}", "z.ordem").alias(code))


def monthly(rows: DataFrame, ts: str, by: list[str], value: Column, first: int, last: int) -> DataFrame:
    """Sums by month and group within years, both bounds included."""
    out = rows.where(F.year(ts).between(first, last)).withColumns({"ano": F.year(ts).cast("int"), "mes": F.month(ts).cast("int")})
    return out.groupBy("ano", "mes", *by).agg(value.alias("valor"))


def sensor_years(years: Column, sensor: str) -> Column:
    """The years of a sensor from a map of sensors to arrays of years."""
    return F.coalesce(F.try_element_at(years, F.lit(sensor)), F.array().cast("array<int>"))


def ranked(rows: DataFrame, group: str, *order: Column) -> Column:
    """A row's place in its group."""
    return F.row_number().over(Window.partitionBy(group).orderBy(*order))
