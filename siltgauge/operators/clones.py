"""Duplicated bodies by grouping on a digest of their normalised key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rules import finding


def clone_groups(bodies: DataFrame, key: Column, least_length: int = 40, length: Column | None = None, shown: int = 5) -> DataFrame:
    """(digest, n_paths, n_bodies, path, name, paths) of keys that two or more distinct paths share.

    bodies has path, name and what key reads. Only digests are shuffled, never bodies, and
    distinct paths are counted in two steps, so that a key with very many copies is spread by
    path first. The representative is the smallest path, and its smallest name.
    """
    small = bodies.where(~S.is_test_name(F.col("name")) & ((F.length(key) if length is None else length) >= least_length))
    small = small.select("path", "name", F.sha2(key, 256).alias("digest"))
    per_path = small.groupBy("digest", "path").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("name"))
    groups = per_path.groupBy("digest").agg(F.count(F.lit(1)).alias("n_paths"), F.sum("n").alias("n_bodies"), F.min(F.struct("path", "name")).alias("first")).where("n_paths >= 2")
    # the first few paths by rank inside the groups that stay, not by collecting all of them
    nth = F.row_number().over(Window.partitionBy("digest").orderBy("path"))
    listed = per_path.join(groups.select("digest"), "digest", "left_semi").withColumn("nth", nth).where(F.col("nth") <= shown)
    lists = listed.groupBy("digest").agg(F.array_sort(F.collect_list("path")).alias("paths"))
    return groups.join(lists, "digest").select("digest", "n_paths", "n_bodies", "first.path", "first.name", "paths")


def clone_findings(groups: DataFrame) -> DataFrame:
    n = F.col("n_paths")
    made = finding("code-duplication", F.lit(True), S.ladder(n, (5, "High"), (3, "Medium"), otherwise="Low"), 0.85, {"function_name": F.col("name"), "file_count": n, "files": F.array_join("paths", ", ")})
    return groups.select("path", made.alias("f")).select("path", "f.*")
