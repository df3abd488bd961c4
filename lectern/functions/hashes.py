"""Content hashes and staleness."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The keys whose change makes derived data stale, in the order in which reasons are given.
TRACKED = (
    "pdf_sha256", "provider_id", "ocr_model", "ocr_config_sha256", "blocks_schema_version", "chunking_config_sha256", "source_chunks_sha256", "source_sha256",
    "embedder_id", "embedder_dim", "provider", "model", "dim", "config_sha256", "schema_version",
)


def text_sha256(x: Column) -> Column:
    return F.sha2(x, 256)


def canonical_json_sha256(value) -> str:
    """Digest of a value as JSON with sorted keys and no spaces."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()


def stale_reasons(current: Column, stored: Column, tracked: tuple[str, ...] = TRACKED) -> Column:
    """Tracked keys that current has with another value than stored."""
    keys = F.array(*[F.lit(k) for k in tracked])
    return F.filter(keys, lambda k: current[k].isNotNull() & ~current[k].eqNullSafe(stored[k]))
