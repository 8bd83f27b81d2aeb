"""Unreferenced items by anti-join."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from .rules import finding


def dead_weight(facts: DataFrame, referenced: DataFrame, least_lines: int = 10, ladder: tuple[int, int] = (1000, 500), skip_config: bool = True) -> DataFrame:
    """Findings for rows of facts that nothing refers to.

    facts has path, module_path, line_count, size_bytes, fan_in and the two flags; referenced has
    module_path. Cheap filters run before the anti-join, which is on plain equality.
    """
    rest = facts.where(~F.coalesce("is_entry_point", F.lit(False)) & ~F.coalesce("is_package_init", F.lit(False)) & (F.coalesce("fan_in", F.lit(0)) == 0) & (F.col("line_count") >= least_lines))
    if skip_config:
        rest = rest.where(~S.is_config_path(F.col("path")))
    rest = rest.join(referenced.select("module_path").where("module_path IS NOT NULL").distinct(), "module_path", "left_anti")
    tokens = S.estimated_tokens(F.col("size_bytes"))
    severity = S.ladder(F.col("line_count"), (ladder[0], "Critical"), (ladder[1], "High"), otherwise="Medium")
    stem = F.regexp_replace(F.regexp_extract("path", r"([^/]*)$", 1), r"\.[^.]*$", "")
    made = finding("dead-weight", F.lit(True), severity, 0.6, {"module_path": F.col("module_path"), "line_count": F.col("line_count"), "stem": stem, "estimated_tokens": tokens}, tokens)
    return rest.select("path", made.alias("f")).select("path", "f.*")
