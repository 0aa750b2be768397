"""Functions of slash-separated relative paths."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_PATH_BYTES = 1 << 20
STAGING_MARK = ".tmp-stage."


def path_validate(path: Column) -> Column:
    """ok, nul, or unsafe (rooted, or with an empty, `.` or `..` component). The empty path is the root and ok."""
    return (
        F.when(path == "", "ok")
        .when(F.instr(path, "\0") > 0, "nul")
        .when(path.rlike(r"(^|/)\.{0,2}(/|$)"), "unsafe")
        .otherwise("ok")
    )


def path_depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/"))).cast("long")


def path_parent(path: Column) -> Column:
    """The directory that holds it; the root's, and that of a top-level entry, is the empty path."""
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def path_basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def path_starts_with(path: Column, prefix: Column) -> Column:
    """By whole components: `ab` isn't under `a`. Everything is under the root."""
    return (prefix == "") | (path == prefix) | F.startswith(path, F.concat(prefix, F.lit("/")))


def strip_prefix(path: Column, prefix: Column) -> Column:
    """The rest below the prefix; empty if equal; null if not under it."""
    return (
        F.when(prefix == "", path)
        .when(path == prefix, "")
        .when(F.startswith(path, F.concat(prefix, F.lit("/"))), F.substr(path, F.length(prefix) + 2))
    )


def with_prefix(path: Column, prefix: Column) -> Column:
    return F.when(prefix == "", path).when(path == "", prefix).otherwise(F.concat_ws("/", prefix, path))


def path_ancestors(path: Column) -> Column:
    """All directories above it, nearest first, without the root."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.when(n < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(n - 1, F.lit(1), F.lit(-1)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))


def path_and_ancestors(path: Column) -> Column:
    return F.concat(F.array(path), path_ancestors(path))


def staging_name(path: Column) -> Column:
    """A sibling name that a write goes to before it is moved into place."""
    name = F.concat(F.lit(STAGING_MARK), F.substring(F.sha2(path, 256), 1, 16))
    parent = path_parent(path)
    return F.when(parent == "", name).otherwise(F.concat_ws("/", parent, name))


def is_staging_artifact(path: Column) -> Column:
    return F.startswith(path_basename(path), F.lit(STAGING_MARK))


@F.pandas_udf(T.StringType())
def nfc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: unicodedata.normalize("NFC", x), na_action="ignore")


def collision_key(path: Column, case_insensitive: bool = True, normalization_insensitive: bool = True) -> Column:
    """What a destination takes two names by: composed form first, then lower case. ASCII paths are in composed form
    already, but the function is applied to all: a branch wouldn't keep it off the Python worker."""
    key = nfc(path) if normalization_insensitive else path
    return F.lower(key) if case_insensitive else key


def hex_components(path: Column) -> Column:
    parts = F.transform(F.split(path, "/"), lambda c: F.lower(F.hex(c.cast("binary"))))
    return F.when(path == "", F.array().cast("array<string>")).otherwise(parts)


def from_hex_components(components: Column) -> Column:
    return F.array_join(F.transform(components, lambda c: F.decode(F.unhex(c), "UTF-8")), "/")


def map_layout(path: Column, kind: str, source_name: str, trailing_slash: bool, destination_name: str | None = None) -> Column:
    """Where a source entry goes: the contents of `src/` as they are, `src` under its own name, and a single file under
    the destination's name if that names one."""
    if kind == "file":
        return F.lit(destination_name or source_name)
    if trailing_slash:
        return path
    return with_prefix(path, F.lit(source_name))


def overlap_check(source: Column, destination: Column, source_is_directory: Column) -> Column:
    """equal, destination_inside, source_inside, or none."""
    return (
        F.when(source == destination, "equal")
        .when(path_starts_with(destination, source), "destination_inside")
        .when(source_is_directory & path_starts_with(source, destination), "source_inside")
        .otherwise("none")
    )


def resolve(directory: Column, target: Column) -> Column:
    """The path that a link's target names from the directory in which the link stands; null for one outside the tree."""
    parts = F.concat(F.when(directory == "", F.array().cast("array<string>")).otherwise(F.split(directory, "/")), F.split(target, "/"))
    out = F.lit("..")

    def step(held: Column, part: Column) -> Column:
        up = F.when(F.size(held) == 0, F.array(out)).when(F.coalesce(F.get(held, F.lit(0)) == out, F.lit(False)), held).otherwise(F.slice(held, 1, F.greatest(F.size(held) - 1, F.lit(0))))
        return F.when((part == "") | (part == "."), held).when(F.coalesce(F.get(held, F.lit(0)) == out, F.lit(False)), held).when(part == out, up).otherwise(F.concat(held, F.array(part)))

    found = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.when(~F.startswith(target, F.lit("/")) & ~F.coalesce(F.get(found, F.lit(0)) == out, F.lit(False)), F.array_join(found, "/"))
