"""Packages: search, versions, grants, dependencies, content store.

Tables: packages (name, owner, description, public), releases (name, version, digest,
yanked, deps as map of name to constraint), grants (name, holder, permission).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.versions import order_key, satisfies


def visible(packages: DataFrame, grants: DataFrame, who: str) -> DataFrame:
    read = grants.where((F.col("holder") == who) & (F.col("permission") == "read")).select("name", F.lit(True).alias("__granted")).distinct()
    seen = packages.join(read, "name", "left").where(F.col("public") | (F.col("owner") == who) | F.coalesce("__granted", F.lit(False)))
    return seen.drop("__granted")


def search_packages(packages: DataFrame, query: str) -> DataFrame:
    return packages.where(F.contains("name", F.lit(query)) | F.contains("description", F.lit(query)))


def publish(releases: DataFrame, new: DataFrame) -> DataFrame:
    """The rows of ``new`` that may be published: versions that are there already are refused."""
    return new.join(releases.select("name", "version"), ["name", "version"], "left_anti")


def yank(releases: DataFrame, packages: DataFrame, grants: DataFrame, name: str, version: str, who: str) -> DataFrame:
    """The releases, this one withdrawn if ``who`` owns it or may withdraw it."""
    may = packages.where((F.col("name") == name) & (F.col("owner") == who)).select("name").union(grants.where((F.col("name") == name) & (F.col("holder") == who) & (F.col("permission") == "yank")).select("name")).distinct()
    marked = releases.join(F.broadcast(may.limit(1).select("name", F.lit(True).alias("__may"))), "name", "left")
    return marked.withColumn("yanked", F.col("yanked") | (F.coalesce("__may", F.lit(False)) & (F.col("version") == version))).drop("__may")


def newest(releases: DataFrame) -> DataFrame:
    w = Window.partitionBy("name").orderBy(F.desc(order_key(F.col("version"))))
    return releases.where("not yanked").withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def best(releases: DataFrame, name: str, constraint: str) -> DataFrame:
    """The newest release of a package that meets a constraint."""
    return newest(releases.where((F.col("name") == name) & satisfies(F.col("version"), constraint)))


def resolve(releases: DataFrame, wanted: dict[str, str]) -> dict[str, str]:
    """Versions for all packages needed, dependencies too; an error where constraints leave none or never settle.  One job a round, over all packages of the round."""
    demands: dict[str, set[str]] = {n: {c} for n, c in wanted.items()}
    seen: set[str] = set()
    while repr(sorted((n, sorted(c)) for n, c in demands.items())) not in seen:
        seen.add(repr(sorted((n, sorted(c)) for n, c in demands.items())))
        found = [best(releases, n, ",".join(sorted(c))).select("name", "version", "deps") for n, c in sorted(demands.items())]
        rows = {r.name: r for r in reduce(DataFrame.unionByName, found).collect()} if found else {}  # a row for each package
        needs: dict[str, set[str]] = {n: {c} for n, c in wanted.items()}
        for name, constraints in demands.items():
            if name not in rows:
                raise ValueError(f"no release of {name} meets {sorted(constraints)}")
            for dep, c in (rows[name].deps or {}).items():
                needs.setdefault(dep, set()).add(c)
        if needs == demands:
            return {n: rows[n].version for n in sorted(rows)}
        demands = needs
    raise ValueError("the constraints don't settle")


def lockfile(releases: DataFrame, chosen: dict[str, str]) -> DataFrame:
    """(lock): one row of JSON, sorted by name."""
    picked = releases.join(F.broadcast(releases.sparkSession.createDataFrame(sorted(chosen.items()), "name string, version string")), ["name", "version"], "left_semi")
    return picked.agg(F.to_json(F.sort_array(F.collect_list(F.struct("name", "version", "digest")))).alias("lock"))


def store(blobs: DataFrame) -> DataFrame:
    """(digest, data): contents by their SHA-256, each once."""
    return blobs.select(F.sha2("data", 256).alias("digest"), "data").dropDuplicates(["digest"])


def tree_digest(files: DataFrame) -> DataFrame:
    """(tree, digest): a digest over the sorted paths and contents of each tree (tree, path, data)."""
    each = F.concat_ws(":", F.col("path"), F.sha2("data", 256))
    return files.groupBy("tree").agg(F.sha2(F.concat_ws("\n", F.sort_array(F.collect_list(each))), 256).alias("digest"))
