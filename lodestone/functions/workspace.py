"""Tags of a workspace from its remotes, files, dependencies, gems and directories."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from . import values as V


def _any(value: Column, table: dict[str, list[str]], how) -> Column:
    out = F.array().cast("array<string>")
    for pattern, tags in table.items():
        if tags:
            out = F.concat(out, F.when(how(value, pattern), F.array(*map(F.lit, tags))).otherwise(F.array().cast("array<string>")))
    return out


def workspace_tags(facts: DataFrame) -> DataFrame:
    """workspace, tag of facts (workspace, kind: remote, file, dep, gem or dir, value).

    A dependency matches its exact name or as a prefix.
    """
    v = F.col("value")
    by_kind = (
        F.when(F.col("kind") == "remote", F.concat(_any(v, V.HOST_TAGS, lambda x, p: x.rlike(p)), F.when(T.repo_of_remote(v).isNotNull(), F.array(F.concat(F.lit("repo:"), F.lower(T.repo_of_remote(v))))).otherwise(F.array().cast("array<string>"))))
        .when(F.col("kind") == "file", _any(v, V.FILE_TAGS, lambda x, p: x == p))
        .when(F.col("kind") == "dep", _any(v, V.PACKAGE_TAGS, lambda x, p: x.startswith(p)))
        .when(F.col("kind") == "gem", _any(v, V.GEM_TAGS, lambda x, p: x == p))
        .when(F.col("kind") == "dir", _any(F.regexp_replace(v, "/+$", ""), V.DIRECTORY_TAGS, lambda x, p: x == p))
    )
    return facts.select("workspace", F.explode(by_kind).alias("tag")).distinct()
