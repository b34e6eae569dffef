"""Records of scraped places: flattening, links, imports of saved pages, and enrichment of a finished base."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.functions.values import fold
from sitelens.operators import nested
from sitelens.operators.impact import first_wins

# The flat columns of a place, by where they are in the record (dc) and its service plan (plan).
FLAT = {
    "nome_datacenter": "dc.name", "operadora": "dc.company.name", "endereco": "dc.address", "cep": "dc.postal", "cidade": "dc.city", "estado": "dc.state", "pais": "dc.country",
    "latitude": "dc.latitude", "longitude": "dc.longitude", "status": "dc.status", "stage": "dc.stage", "tipo_listagem": "dc.listingtype", "tipo_capacidade": "dc.capacitytype",
    "mw_construido": "dc.meta_capacity.mw_builtout", "mw_referenciado": "dc.meta_capacity.mw_referenced", "whitespace_construido_m": "dc.meta_capacity.whitespace_builtout", "whitespace_referenciado_m": "dc.meta_capacity.whitespace_referenced",
    "ano_operacional": "dc.meta_building.year_operational", "tipo_construcao": "dc.meta_building.construction", "tipo_ocupacao": "dc.meta_building.tenancy_text", "carga_piso_max_kg_m": "dc.meta_building.floor_load",
    "redundancia_refrigeracao": "dc.meta_power.cooling_redundancy", "cctv": "dc.meta_security.cctv", "controle_acesso_cartao": "dc.meta_security.keycard", "biometria": "dc.meta_security.biometric",
    "tier_projetado": "dc.meta_standards.tier_designed", "tier_certificado": "dc.meta_standards.tier_certified", "pci_dss": "dc.meta_standards.pci",
    "iso9001": "dc.meta_standards.iso9001", "iso14001": "dc.meta_standards.iso14001", "iso22301": "dc.meta_standards.iso22301", "iso27001": "dc.meta_standards.iso27001", "iso45001": "dc.meta_standards.iso45001", "iso50001": "dc.meta_standards.iso50001",
    "soc1": "dc.meta_standards.soc1", "soc2": "dc.meta_standards.soc2", "soc3": "dc.meta_standards.soc3",
    "colo_suites": "plan.services.colo.suites", "colo_cages": "plan.services.colo.cages", "colo_cabinets": "plan.services.colo.cabinets", "colo_partial_cabinets": "plan.services.colo.partialcabinets", "colo_shared_rackspace": "plan.services.colo.sharedrackspace", "colo_footprints": "plan.services.colo.footprints", "colo_remote_hands": "plan.services.colo.remotehands", "colo_build_to_suit": "plan.services.colo.buildtosuit",
    "cloud_gpu": "plan.services.cloud.gpu", "cloud_managed": "plan.services.cloud.managed", "cloud_baremetal": "plan.services.cloud.baremetal", "cloud_public_cloud": "plan.services.cloud.publiccloud",
    "qtd_ixps": "dc.meta_stats.ixps", "qtd_clouds": "dc.meta_stats.clouds", "qtd_redes_presentes": "dc.meta_stats.networkpresence", "qtd_provedores_rede": "dc.meta_stats.networkproviders", "qtd_provedores_servico": "dc.meta_stats.serviceproviders",
    "codigo_site": "dc.meta_references.provider_id", "peeringdb_id": "dc.meta_references.peeringdb_id",
}


def truthy(c: Column, kind: T.DataType | None = None) -> Column:
    """Neither null nor empty; for numbers not 0, for booleans true."""
    if isinstance(kind, T.BooleanType):
        return F.coalesce(c, F.lit(False))
    if isinstance(kind, T.NumericType):
        return F.coalesce(c != 0, F.lit(False))
    return F.coalesce(c != "", F.lit(False))


def site_link(base: str, *parts: Column) -> Column:
    """base/part/part/.../ if no part is null or empty, else null."""
    sound = F.lit(True)
    for p in parts:
        sound = sound & truthy(p)
    return F.when(sound, F.concat(F.lit(base.rstrip("/") + "/"), F.concat_ws("/", *parts), F.lit("/")))


def _has(schema: T.StructType, path: str) -> bool:
    node: T.DataType = schema
    for name in path.split("."):
        if not isinstance(node, T.StructType) or name not in node.names:
            return False
        node = node[name].dataType
    return True


def flattened(rows: DataFrame, base: str) -> DataFrame:
    """One flat row per record (dc, plan, status_overview, status_specs): the columns of FLAT, tags, link, and both statuses.

    A struct that is null gives nulls below it; a field that no record has gives a null column.
    """
    flat = [(F.col(path) if _has(rows.schema, path) else F.lit(None).cast("string")).alias(name) for name, path in FLAT.items()]
    tags = F.array_join(F.coalesce("dc.tags", F.array().cast("array<string>")), ", ") if _has(rows.schema, "dc.tags") else F.lit("")
    link = site_link(base, F.col("dc.countrylink"), F.col("dc.marketlink"), F.col("dc.link"))
    return rows.select(*flat, tags.alias("tags"), link.alias("link_datacenter"), F.col("status_overview").alias("cache_overview_status"), F.col("status_specs").alias("cache_specs_status"))


def regions(country: DataFrame, base: str) -> DataFrame:
    """Regions of a country's record (geos: array): those with a link, with their address, sorted."""
    g = country.select("pais", F.explode("geos").alias("g")).where(truthy(F.col("g.link")))
    return g.select(F.col("g.link").alias("regiao"), F.col("g.name").alias("nome"), F.col("g.datacenters").alias("qtd_datacenters_informada"), F.col("g.latitude").alias("latitude"), F.col("g.longitude").alias("longitude"), F.concat(F.lit(base.rstrip("/") + "/"), "pais", F.lit("/"), "g.link", F.lit("/")).alias("url")).orderBy("regiao")


def place_links(found: DataFrame, base: str) -> DataFrame:
    """Places of all regions (regiao, status, dcs: array) whose record is ok: each link once, from the first region in order."""
    d = found.where("status = 'ok'").select("regiao", F.posexplode("dcs").alias("pos", "dc")).where(truthy(F.col("dc.link")))
    rows = d.select(F.col("dc.link").alias("slug"), "regiao", "pos", F.col("dc.name").alias("nome"), F.when(truthy(F.col("dc.url")), F.concat(F.lit(base.rstrip("/")), "dc.url")).alias("url"))
    return first_wins(rows, "slug", ["regiao", "pos"]).drop("pos")


def imported(pages: DataFrame, name: str = "name", html: str = "html") -> DataFrame:
    """Saved pages as records: chave, aba, status and dados (a variant).

    A name `regiao_<slug>` or `datacenter_<slug>[_specs]` gives key and tab; other names are left out. Pages without readable data have
    status `erro`, those that say that too many were viewed `bloqueado`, both without data.
    """
    n = F.col(name)
    kind, stem = F.regexp_extract(n, "^(regiao|datacenter)_(.+?)(\\.html)?$", 1), F.regexp_extract(n, "^(regiao|datacenter)_(.+?)(\\.html)?$", 2)
    tab = F.when(kind == "regiao", F.lit("regiao")).when(stem.endswith("_specs"), F.lit("specs")).otherwise(F.lit("overview"))
    out = pages.select(kind.alias("tipo"), F.when(tab == "specs", F.regexp_replace(stem, "_specs$", "")).otherwise(stem).alias("chave"), tab.alias("aba"), nested.page_props(F.col(html)).alias("props")).where("tipo <> ''")
    status = F.when(F.col("props").isNull(), "erro").when(nested.rate_limited(F.col("props")), "bloqueado").otherwise("ok")
    return out.select("tipo", "chave", "aba", status.alias("status"), F.when(status == "ok", F.col("props")).alias("dados"))


def status_counts(rows: DataFrame, states: tuple[str, ...] = ("ok", "bloqueado", "erro")) -> DataFrame:
    """Records by status; a status without any has 0."""
    wide = rows.agg(*[F.count(F.when(F.col("status") == s, 1)).alias(s) for s in states])
    return wide.unpivot([], list(states), "status", "n")


def enriched(base: DataFrame, found: DataFrame, key: str, columns: list[str], only: Column) -> tuple[DataFrame, DataFrame]:
    """base with columns overwritten by the found values that are neither null nor empty, on rows where `only` holds; and how often each was."""
    joined = base.join(found.select(key, *[F.col(c).alias(f"_new_{c}") for c in columns]), key, "left")
    kinds = {f.name: f.dataType for f in found.schema}
    hit = {c: only & truthy(F.col(f"_new_{c}"), kinds[c]) for c in columns}
    out = joined.withColumns({c: F.when(hit[c], F.col(f"_new_{c}")).otherwise(F.col(c) if c in base.columns else F.lit(None)) for c in columns})
    counts = joined.agg(*[F.count(F.when(hit[c], 1)).alias(c) for c in columns]).unpivot([], columns, "coluna", "preenchidos")
    return out.drop(*[f"_new_{c}" for c in columns]), counts


def column_after(rows: DataFrame, name: str, value: Column, after: str) -> DataFrame:
    """rows with a column put right after another one."""
    rest = [c for c in rows.columns if c != name]
    at = rest.index(after) + 1
    return rows.select(*[F.col(c) for c in rest[:at]], value.alias(name), *[F.col(c) for c in rest[at:]])


def batched(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds lote, the number of the batch of `size` rows in the order of the columns."""
    from sitelens.operators.storage import numbered

    return numbered(rows, order, "_place").withColumn("lote", F.expr(f"int(_place div {int(size)})")).drop("_place")


def name_join(rows: DataFrame, places: DataFrame, name: str, state: str, columns: list[str]) -> DataFrame:
    """rows with the columns of the place of their name in their state, and found; accents and case do not count.

    Homonyms of other states are told apart by the state. Of several places with one name in one state the first by its columns counts, so every row stays once; a row without
    name, state or match has found = false. Places are made one per name before they are met.
    """
    key = lambda df: (fold(F.trim(df[name])).alias("_n"), F.col(state).alias("_s"))
    known = places.select(*key(places), F.struct(*columns).alias("_p")).where("_n <> '' and _s is not null").groupBy("_n", "_s").agg(F.min("_p").alias("_p"))
    met = rows.withColumns({"_k": fold(F.trim(rows[name])), "_u": F.col(state)}).join(known, (F.col("_k") == F.col("_n")) & (F.col("_u") == F.col("_s")), "left")
    return met.select(*rows.columns, *[F.col(f"_p.{c}").alias(c) for c in columns], F.col("_p").isNotNull().alias("found"))


def tabs(records: DataFrame, documents: DataFrame) -> DataFrame:
    """records (chave) with both tabs of the cached documents (chave, aba, status, dados): status_overview and status_specs, `ausente` where there is no document, and
    overview and specs, the data of those that are ok."""
    side = lambda t: documents.where(F.col("aba") == t).groupBy("chave").agg(F.max_by(F.struct("status", "dados"), "status").alias(t))
    out = records.join(side("overview"), "chave", "left").join(side("specs"), "chave", "left")
    status = lambda t: F.coalesce(F.col(f"{t}.status"), F.lit("ausente"))
    read = lambda t: F.when(F.col(f"{t}.status") == "ok", F.col(f"{t}.dados"))
    return out.select(*records.columns, status("overview").alias("status_overview"), status("specs").alias("status_specs"), read("overview").alias("overview"), read("specs").alias("specs"))


def merged(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """left and right by equal keys, where a null key equals a null key, as in data frame libraries (SQL's = never finds one): the keys once, then the other columns.

    Many null keys on both sides make as many pairs as they are many times over, like any key.
    """
    own = right.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    met = left.join(own, [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys], how)
    found = [F.coalesce(F.col(k), F.col(f"_{k}")).alias(k) if how in ("right", "full", "outer") else F.col(k) for k in keys]
    return met.select(*found, *[c for c in left.columns if c not in keys], *[c for c in right.columns if c not in keys])
