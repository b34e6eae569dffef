"""Small text columns: trimming, labels, padded numbers, addresses, codes of places and names of classes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of the biomes that occur, by number.
BIOMES = {1: "Floresta tropical úmida", 2: "Floresta tropical seca", 4: "Floresta temperada decídua", 5: "Floresta temperada de coníferas", 6: "Taiga", 7: "Savana tropical", 8: "Campos temperados", 9: "Campos alagáveis", 10: "Campos montanos", 11: "Tundra", 12: "Mata mediterrânea", 13: "Deserto e arbustal xérico", 14: "Manguezal"}

# States of the United States by name and by number, and the regions of the census.
STATES = {"Alabama": "AL", "Alaska": "AK", "Arizona": "AZ", "Arkansas": "AR", "California": "CA", "Colorado": "CO", "Connecticut": "CT", "Delaware": "DE", "District of Columbia": "DC", "Florida": "FL", "Georgia": "GA", "Hawaii": "HI", "Idaho": "ID", "Illinois": "IL", "Indiana": "IN", "Iowa": "IA", "Kansas": "KS", "Kentucky": "KY", "Louisiana": "LA", "Maine": "ME", "Maryland": "MD", "Massachusetts": "MA", "Michigan": "MI", "Minnesota": "MN", "Mississippi": "MS", "Missouri": "MO", "Montana": "MT", "Nebraska": "NE", "Nevada": "NV", "New Hampshire": "NH", "New Jersey": "NJ", "New Mexico": "NM", "New York": "NY", "North Carolina": "NC", "North Dakota": "ND", "Ohio": "OH", "Oklahoma": "OK", "Oregon": "OR", "Pennsylvania": "PA", "Rhode Island": "RI", "South Carolina": "SC", "South Dakota": "SD", "Tennessee": "TN", "Texas": "TX", "Utah": "UT", "Vermont": "VT", "Virginia": "VA", "Washington": "WA", "West Virginia": "WV", "Wisconsin": "WI", "Wyoming": "WY"}
STATE_NUMBERS = {"01": "AL", "02": "AK", "04": "AZ", "05": "AR", "06": "CA", "08": "CO", "09": "CT", "10": "DE", "11": "DC", "12": "FL", "13": "GA", "15": "HI", "16": "ID", "17": "IL", "18": "IN", "19": "IA", "20": "KS", "21": "KY", "22": "LA", "23": "ME", "24": "MD", "25": "MA", "26": "MI", "27": "MN", "28": "MS", "29": "MO", "30": "MT", "31": "NE", "32": "NV", "33": "NH", "34": "NJ", "35": "NM", "36": "NY", "37": "NC", "38": "ND", "39": "OH", "40": "OK", "41": "OR", "42": "PA", "44": "RI", "45": "SC", "46": "SD", "47": "TN", "48": "TX", "49": "UT", "50": "VT", "51": "VA", "53": "WA", "54": "WV", "55": "WI", "56": "WY"}
REGIONS = {"Northeast": ("CT", "ME", "MA", "NH", "RI", "VT", "NJ", "NY", "PA"), "Midwest": ("IL", "IN", "MI", "OH", "WI", "IA", "KS", "MN", "MO", "NE", "ND", "SD"), "South": ("DE", "FL", "GA", "MD", "NC", "SC", "VA", "DC", "WV", "AL", "KY", "MS", "TN", "AR", "LA", "OK", "TX"), "West": ("AZ", "CO", "ID", "MT", "NV", "NM", "UT", "WY", "AK", "CA", "HI", "OR", "WA")}


def trimmed(rows: DataFrame) -> DataFrame:
    """All text columns without blanks around them."""
    return rows.withColumns({f.name: F.trim(f.name) for f in rows.schema if isinstance(f.dataType, T.StringType)})


def label(name: Column, group: Column) -> Column:
    """`name (group)`, with nothing for a null."""
    return F.format_string("%s (%s)", F.coalesce(name, F.lit("")), F.coalesce(group, F.lit("")))


def padded(prefix: str, number: Column, digits: int) -> Column:
    """The prefix and the number with zeros before it; longer numbers stay whole."""
    return F.concat(F.lit(prefix), F.format_string(f"%0{digits}d", number.cast("long")))


def joined_url(base: Column, *parts: Column) -> Column:
    """base without slashes at its end, and the parts, one slash before each."""
    return F.concat(F.rtrim(base, F.lit("/")), *[x for p in parts for x in (F.lit("/"), p)])


def fips(code: Column) -> Column:
    """State and county of a five-digit code; null for any other."""
    return F.when(F.length(code) == 5, F.struct(F.substring(code, 1, 2).alias("estado"), F.substring(code, 3, 3).alias("condado")))


def region_of(code: Column, regions: dict[str, tuple[str, ...]], default: str = "") -> Column:
    """The first region that has the code, else the default."""
    out = F.lit(default)
    for name, codes in reversed(regions.items()):
        out = F.when(code.isin(*codes), F.lit(name)).otherwise(out)
    return out


def state_of(name: Column | None = None, county: Column | None = None) -> Column:
    """The code of a state by its name, or by the first two digits of a five-digit county code; empty for any other."""
    keys, table = (name, STATES) if county is None else (F.when(F.length(county) == 5, F.substring(county, 1, 2)), STATE_NUMBERS)
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, keys), F.lit(""))


def census_region(state: Column) -> Column:
    """The census region of a state's code; empty for any other."""
    return region_of(F.coalesce(state, F.lit("")), REGIONS)


def population_source(country: Column, county: Column, population: Column, estimate: Column, year: int) -> tuple[Column, Column]:
    """The population and where it is from: in the United States the county's survey of that year if there is one, which replaces what was there; elsewhere what
    was there, under the estimate's own name or else as the municipality's; no name where there is none.

    county and estimate are what other tables have for the row, or null.
    """
    usa, known = country == "EUA", F.coalesce(F.trim(population) != "", F.lit(False))
    surveyed = usa & F.coalesce(county != "", F.lit(False))
    label = F.when(surveyed, F.lit(f"ACS {year} 5-year (condado)")).when(~usa & known, F.coalesce(F.nullif(F.trim(estimate), F.lit("")), F.lit("IBGE (municipio)"))).otherwise(F.lit(""))
    return F.when(surveyed, county).otherwise(population), label


def whole(c: Column) -> Column:
    """Half-even rounding to an integer."""
    return F.bround(c).cast("long")


def biome(number: Column) -> Column:
    """The name of a biome; a number without name is named by itself, null stays null."""
    pairs = F.create_map(*[F.lit(x) for kv in BIOMES.items() for x in kv])
    n = number.cast("int")
    return F.when(n.isNotNull(), F.coalesce(F.try_element_at(pairs, n), F.format_string("RESOLVE biome %d", n)))
