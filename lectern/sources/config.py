"""Configuration: defaults, then stored settings, then a file, then the environment; values take the type of their default.

The same rules as columns serve settings that stand in tables (`layered`, `coerced`, `snake_column`).
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterable, Mapping
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.errors import InvalidParams
from lectern.operators.filters import first_unknown

#: Dotted keys of known settings with their defaults.
DEFAULTS: dict[str, str | int] = {
    "ui.language": "en-US",
    "ocr.provider": "glm",
    "ocr.apiKey": "",
    "ocr.apiUrl": "",
    "ocr.model": "glm-ocr",
    "embedding.provider": "hashing",
    "embedding.model": "hashing-256",
    "embedding.apiKey": "",
    "embedding.apiUrl": "",
    "rag.chunkSize": 512,
    "rag.chunkOverlap": 64,
    "rag.topK": 5,
}


def snake(name: str) -> str:
    return re.sub(r"(?<!^)(?=[A-Z])", "_", name).lower()


def coerce(value, like):
    """value as the type of like."""
    if isinstance(like, bool):
        return value if isinstance(value, bool) else str(value).strip().lower() in ("1", "true", "yes", "on")
    if isinstance(like, int):
        return int(value)
    if isinstance(like, float):
        return float(value)
    return value


def load(stored: Mapping | None = None, file: str | None = None, env: Mapping[str, str] | None = None, prefix: str = "LECTERN") -> dict:
    """Dotted keys to values. Environment names are PREFIX_SECTION_NAME."""
    out = dict(DEFAULTS)
    layers: list[Mapping] = [stored or {}]
    if file and Path(file).exists():
        nested = json.loads(Path(file).read_text())
        layers.append({f"{s}.{k}": v for s, own in nested.items() for k, v in own.items()})
    env = os.environ if env is None else env
    layers.append({k: env[n] for k in DEFAULTS if (n := f"{prefix}_{k.split('.')[0].upper()}_{snake(k.split('.')[1]).upper()}") in env})
    for layer in layers:
        out |= {k: coerce(v, DEFAULTS[k]) for k, v in layer.items() if k in DEFAULTS and v is not None}
    return out


def set_all(settings: Mapping, updates: Mapping) -> dict:
    """All updates or none: an unknown key is an error."""
    unknown = first_unknown(updates, DEFAULTS)
    if unknown is not None:
        raise InvalidParams(f"unknown setting: {unknown}")
    return dict(settings) | {k: coerce(v, DEFAULTS[k]) for k, v in updates.items()}


def migrate(stored: Mapping, legacy: Mapping, prefixes: Iterable[str] = ("",), defaults: Mapping = DEFAULTS) -> dict:
    """stored with values of older names: the first filled one of prefix + key, where the present value is missing, empty or the default."""
    out = dict(stored)
    for key, default in defaults.items():
        old = next((v for p in prefixes if (v := legacy.get(p + key)) not in (None, "")), None)
        if old is not None and stored.get(key) in (None, "", default):
            out[key] = coerce(old, default)
    return out


def layered(layers: list[DataFrame]) -> DataFrame:
    """key, value: of layers (key, value) the last one's value that isn't null wins."""
    out = layers[0].select("key", "value")
    for k, layer in enumerate(layers[1:]):
        out = out.join(layer.select("key", F.col("value").alias(f"__v{k}")), "key", "full_outer").select("key", F.coalesce(f"__v{k}", "value").alias("value"))
    return out


def migrated(stored: DataFrame, legacy: DataFrame, defaults: DataFrame) -> DataFrame:
    """key, value: `migrate` over tables (key, value); legacy may hold a key more than once with a rank, the least filled one counts."""
    old = legacy.where(F.coalesce("value", F.lit("")) != "").groupBy("key").agg(F.min_by("value", "rank").alias("__old"))
    own = defaults.select("key", F.col("value").alias("__default")).join(stored.select("key", "value"), "key", "left").join(old, "key", "left")
    free = F.coalesce("value", F.lit("")).isin("") | (F.col("value") == F.col("__default"))
    return own.select("key", F.when(F.col("__old").isNotNull() & free, F.col("__old")).otherwise(F.col("value")).alias("value"))


def coerced(value: Column, kind: str) -> Column:
    """A text as a setting of that kind (boolean, int, double or string); what can't be read is null."""
    if kind == "boolean":
        return F.lower(F.trim(value)).isin("1", "true", "yes", "on")
    return value if kind == "string" else F.trim(value).try_cast(kind)


def snake_column(name: Column) -> Column:
    return F.lower(F.regexp_replace(name, r"(?<!^)(?=[A-Z])", "_"))


def unknown_settings(updates: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of updates (pos, key) whose key isn't known, the first one first."""
    return updates.join(known.select("key"), "key", "left_anti").orderBy("pos")


def applied(settings: DataFrame, updates: DataFrame, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(settings, errors) after updates (owner, pos, key, value) to settings (owner, key, value): all of an owner's updates, or none if one has an unknown key.

    errors: owner and key of the first unknown one. Of several updates of a key the last counts.
    """
    unknown = updates.join(known.select("key"), "key", "left_anti")
    errors = unknown.groupBy("owner").agg(F.min_by("key", "pos").alias("key"))
    good = updates.join(errors.select("owner"), "owner", "left_anti").groupBy("owner", "key").agg(F.max_by("value", "pos").alias("value"))
    kept = settings.join(good.select("owner", "key"), ["owner", "key"], "left_anti")
    return kept.select("owner", "key", "value").unionByName(good), errors
