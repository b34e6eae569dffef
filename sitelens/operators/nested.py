"""Nested records: null-aware merges, embedded page data, features, address components and fetch tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def deep_merge(base: Column, first: Column, schema: T.StructType) -> Column:
    """Field by field, the value of `first` where it is not null, else that of `base`; structs within are merged too."""
    fields = []
    for f in schema.fields:
        a, b = base.getField(f.name), first.getField(f.name)
        fields.append((deep_merge(a, b, f.dataType) if isinstance(f.dataType, T.StructType) else F.coalesce(b, a)).alias(f.name))
    return F.when(base.isNotNull() | first.isNotNull(), F.struct(*fields))


def page_data(html: Column) -> Column:
    """The JSON text of the page's embedded data, null where there is none."""
    return F.nullif(F.regexp_extract(html, r'(?s)<script[^>]*id="__NEXT_DATA__"[^>]*>(.*?)</script>', 1), F.lit(""))


def page_props(html: Column) -> Column:
    """props.pageProps of the embedded data as a variant; null where it is absent or can't be parsed."""
    return F.try_variant_get(F.try_parse_json(page_data(html)), "$.props.pageProps", "variant")


def rate_limited(props: Column) -> Column:
    """Whether the page says that too many pages were viewed."""
    text = lambda p: F.try_variant_get(props, p, "string")
    return F.coalesce((text("$.pageId") == "rate-limited") | (text("$.pageTitle") == "Page View Limit Reached"), F.lit(False))


def features(rows: DataFrame, column: str) -> DataFrame:
    """One row per feature of a GeoJSON collection: its properties, lon and lat."""
    f = rows.select(F.explode(f"{column}.features").alias("f"))
    at = F.col("f.geometry.coordinates")
    return f.select("f.properties.*", F.get(at, 0).alias("lon"), F.get(at, 1).alias("lat"))


def component(parts: Column, kind: str, name: str = "long_name") -> Column:
    """The name of the first address component of a kind."""
    return F.get(F.filter(parts, lambda c: F.array_contains(c["types"], kind)), 0)[name]


def municipality(parts: Column) -> Column:
    return F.coalesce(component(parts, "administrative_area_level_2"), component(parts, "locality"))


def pending(tasks: DataFrame, done: DataFrame, keys: list[str], force: bool = False) -> DataFrame:
    """Tasks that have no record of status ok; all of them by force."""
    return tasks if force else tasks.join(done.where("status = 'ok'").select(*keys).distinct(), keys, "left_anti")


def entity_tasks(entities: DataFrame, key: str, tabs: list[str], done: DataFrame, limit: int | None = None, force: bool = False) -> DataFrame:
    """Pending (entity, tab) tasks; the limit counts entities in key order, not tasks."""
    tasks = entities.select(key, F.explode(F.array(*[F.lit(t) for t in tabs])).alias("tab"))
    left = pending(tasks, done, [key, "tab"], force)
    return left if limit is None else left.join(F.broadcast(left.select(key).distinct().orderBy(key).limit(limit)), key, "left_semi")


def precedence(first: DataFrame, second: DataFrame, key: str, value: str, names: tuple[str, str]) -> DataFrame:
    """Value of the first source where it has one, else of the second, and which it was."""
    a, b = first.select(key, F.col(value).alias("_a")), second.select(key, F.col(value).alias("_b"))
    return a.join(b, key, "full").select(key, F.coalesce("_a", "_b").alias(value), F.when(F.col("_a").isNotNull(), names[0]).when(F.col("_b").isNotNull(), names[1]).alias("fonte"))
