"""File names and paths, Column to Column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def leaf_of(path: Column) -> Column:
    """What follows the last separator, of either kind."""
    return F.regexp_extract(path, r"[^/\\]*\z", 0)


def extension_of(leaf: Column) -> Column:
    """What follows the last dot, "" without one or where the name begins with its only dot."""
    return F.regexp_extract(leaf, r"\A.+\.([^.]*)\z", 1)


def renamed(leaf: Column, base: Column) -> Column:
    """base with the extension of leaf."""
    ext = extension_of(leaf)
    return F.when(ext == "", base).otherwise(F.concat(base, F.lit("."), ext))


def to_windows(path: Column, distribution: str = "Linux") -> Column:
    """A path as a Windows host names it: mounted drives by their letter, the rest through the share of the distribution."""
    drive = F.regexp_extract(path, r"\A/mnt/([a-z])(?:/|\z)", 1)
    back = lambda x: F.replace(x, F.lit("/"), F.lit("\\"))
    on_drive = F.concat(F.upper(drive), F.lit(":\\"), back(F.substring(path, 8, F.length(path))))
    shared = F.concat(F.lit(f"\\\\wsl.localhost\\{distribution}"), back(path))
    return F.when(drive != "", on_drive).when(F.startswith(path, F.lit("/")), shared).otherwise(path)


def to_posix(path: Column) -> Column:
    """A Windows path below the mount point of its drive; others stay."""
    drive = F.regexp_extract(path, r"\A([A-Za-z]):[\\/]", 1)
    rest = F.replace(F.substring(path, 4, F.length(path)), F.lit("\\"), F.lit("/"))
    return F.when(drive != "", F.concat(F.lit("/mnt/"), F.lower(drive), F.lit("/"), rest)).otherwise(path)
