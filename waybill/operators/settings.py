"""Settings and accounts kept as JSON texts: defaults, merging, migration of the first version, validity.

A table of stored texts has a row per user with ``v2`` (current), ``v1`` (legacy) and ``account``. Leaves are read from a
variant, so an unknown leaf does no harm and a leaf of another type counts as missing.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waybill.operators.changes import nav_app

VERSION = 2
DEFAULT_FEE = 15000.0
#: Leaves with their types and defaults (fixed values); fees of districts are maps beside them.
LEAVES: dict[str, tuple[str, object]] = {
    "business.targetArrivalMinutesBeforeEvent": ("double", 30.0),
    "business.defaultInstallationMinutes": ("double", 20.0),
    "business.completionRequiresPhoto": ("boolean", False),
    "business.completionRequiresTimestamp": ("boolean", True),
    "fees.defaultFee": ("double", DEFAULT_FEE),
    "fees.feeCalculationMode": ("string", "district"),
    "costs.vehicleModel": ("string", "현대 포터2"),
    "costs.fuelEfficiency": ("double", 12.4),
    "costs.fuelTankCapacity": ("double", 65.0),
    "costs.fuelType": ("string", "diesel"),
    "costs.profitBasis": ("string", "daily"),
    "appearance.themeMode": ("string", "system"),
    "route.navApp": ("string", "google"),
}
REGIONS = ("Seoul", "Gyeonggi", "Incheon", "custom")
#: Leaves of the first version and where they go now (fixed values).
MOVED = {"costs.vehicleModel": "vehicleModel", "costs.fuelEfficiency": "fuelEfficiency", "costs.fuelTankCapacity": "fuelTankCapacity", "appearance.themeMode": "themeMode"}


def _leaf(stored: Column, path: str, kind: str) -> Column:
    v = F.try_variant_get(stored, f"$.{path}", "variant")
    of = F.schema_of_variant(v)
    fits = {"double": of.rlike("^(BIGINT|DECIMAL|DOUBLE|FLOAT)"), "boolean": of == "BOOLEAN", "string": of == "STRING"}[kind]
    return F.when(fits, F.try_variant_get(stored, f"$.{path}", kind))


def _alias(path: str) -> str:
    return path.replace(".", "_")


def _object(stored: Column) -> Column:
    return F.coalesce(F.schema_of_variant(stored).startswith("OBJECT"), F.lit(False))


def _numbers(stored: Column, path: str) -> Column:
    """The numbers of an object of numbers."""
    return F.map_filter(F.coalesce(F.try_variant_get(stored, f"$.{path}", "map<string,double>"), F.create_map().cast("map<string,double>")), lambda _, x: x.isNotNull())


def defaults(districts: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Default settings by column name: every leaf, and a fee map for each region."""
    out = {_alias(p): F.lit(x).cast(k) for p, (k, x) in LEAVES.items()}
    for region in REGIONS:
        names = districts.get(region, ())
        entries = F.create_map(*[F.lit(x) for d in names for x in (d, DEFAULT_FEE)]) if names else F.create_map()
        out[f"fees_{region}"] = entries.cast("map<string,double>")
    return out


def _over(default: Column, stored: Column) -> Column:
    """A map with stored entries over the default ones."""
    return F.map_from_entries(F.concat(F.map_entries(F.map_filter(default, lambda k, _: ~F.map_contains_key(stored, k))), F.map_entries(stored)))


def merged(v2: Column, districts: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Settings of the current version: stored leaves over the defaults; what can't be read is the default as a whole."""
    stored = F.try_parse_json(v2)
    out = {}
    for name, default in defaults(districts).items():
        path = next((p for p in LEAVES if _alias(p) == name), None)
        if path:
            out[name] = F.coalesce(F.when(_object(stored), _leaf(stored, path, LEAVES[path][0])), default)
        else:
            out[name] = F.when(_object(stored), _over(default, _numbers(stored, f"fees.districtFees.{name[5:]}"))).otherwise(default)
    out["route_navApp"] = nav_app(out["route_navApp"])
    return out


def migrated(v1: Column, districts: Mapping[str, Sequence[str]]) -> dict[str, Column]:
    """Settings made of the first version: known districts keep their fee, vehicle and theme are taken over."""
    stored = F.try_parse_json(v1)
    out = defaults(districts)
    for new, old in MOVED.items():
        kind = LEAVES[new][0]
        value = _leaf(stored, old, kind)
        out[_alias(new)] = F.coalesce(F.nullif(value, F.lit("")) if kind == "string" else value, out[_alias(new)])
    fees = _numbers(stored, "districtFees")
    for region in REGIONS[:2]:
        out[f"fees_{region}"] = F.transform_values(out[f"fees_{region}"], lambda k, x: F.coalesce(F.try_element_at(fees, k), x))
    return out


def load(stored: DataFrame, districts: Mapping[str, Sequence[str]]) -> DataFrame:
    """Settings of every user: the current version if there is a text of it, else the first one migrated, else defaults.

    Adds migrated: whether the row came from elsewhere and is to be saved as the current version.
    """
    now, before = merged(F.col("v2"), districts), migrated(F.col("v1"), districts)
    has = F.coalesce(F.col("v2") != "", F.lit(False))
    columns = {name: F.when(has, now[name]).otherwise(before[name]) for name in now}
    return stored.select("user_id", F.lit(VERSION).alias("schemaVersion"), *[c.alias(n) for n, c in columns.items()], (~has).alias("migrated"))


def save(settings: DataFrame) -> DataFrame:
    """(user_id, v2): settings as the JSON text of the current version."""
    parts: dict[str, list[Column]] = {}
    for path in LEAVES:
        head, leaf = path.split(".")
        parts.setdefault(head, []).append(F.col(_alias(path)).alias(leaf))
    parts["fees"].append(F.struct(*[F.col(f"fees_{r}").alias(r) for r in REGIONS]).alias("districtFees"))
    body = F.struct(F.lit(VERSION).alias("schemaVersion"), *[F.struct(*xs).alias(k) for k, xs in parts.items()])
    return settings.select("user_id", F.to_json(body).alias("v2"))


def account(text: Column) -> Column:
    """A stored account as a variant, null unless it has a profile and a list of vehicles."""
    v = F.try_parse_json(text)
    profile = F.schema_of_variant(F.try_variant_get(v, "$.profile", "variant"))
    there = profile.isNotNull() & ~profile.isin("VOID")
    vehicles = F.schema_of_variant(F.try_variant_get(v, "$.vehicles", "variant")).startswith("ARRAY")
    return F.when(F.coalesce(there & vehicles, F.lit(False)), v)
