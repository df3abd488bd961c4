"""The registry of reference-side queries: name -> run(spark, sf_dir) and the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from lectern.plans import files, guards, hierarchy, jobs, metadata, mutate, retrieve, scalars, search, streams, texts
from lectern.plans.query import Query

QUERIES: dict[str, Query] = {}
for _module in (retrieve, search, metadata, hierarchy, scalars, texts, mutate, files, jobs, streams, guards):
    QUERIES |= _module.QUERIES
