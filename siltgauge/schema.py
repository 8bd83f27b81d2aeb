"""Static schemas and the small dimension tables of kinds and severities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

#: Schemas are DDL, as StructType.fromDDL needs a session and modules are imported before one.
SOURCE_FILES = "path string, rel_path string, size_bytes bigint, line_count bigint, language string, package string, metadata map<string,string>, text string"

FACT_TYPES: dict[str, str] = {
    **dict.fromkeys(("path", "rel_path", "language", "package", "module_path"), "string"),
    **dict.fromkeys(("line_count", "size_bytes"), "bigint"),
    **dict.fromkeys(("is_entry_point", "is_package_init"), "boolean"),
    **dict.fromkeys(("function_count", "class_count", "impl_block_count"), "int"),
    **dict.fromkeys(("imports", "imported_names", "identifiers", "module_declarations", "all_export"), "array<string>"),
    "exports": "array<struct<source:string,item_count:int,is_wildcard:boolean>>",
    "function_bodies": "array<struct<name:string,raw_body:string,normalized_body:string>>",
    **dict.fromkeys(("branch_count", "max_nesting_depth", "max_type_depth", "comment_line_count", "decorator_count", "empty_catch_count", "dangerous_pattern_count", "string_comparison_count"), "int"),
    "error": "string",
}
FILE_FACTS = ", ".join(f"{k} {v}" for k, v in FACT_TYPES.items())

FINDINGS = "path string, kind string, severity string, confidence double, evidence map<string,string>, estimated_tokens bigint"

#: kind: (id prefix, short code, score bucket). Short codes of the five structural kinds are chosen here.
KINDS: dict[str, tuple[str, str, str]] = {
    "context-bomb": ("cb", "OVS", "context_waste"),
    "dead-weight": ("dw", "DEAD", "structural_entropy"),
    "reexport-entropy": ("re", "REXP", "structural_entropy"),
    "coupling-hotspot": ("ch", "COUP", "structural_entropy"),
    "code-duplication": ("dup", "DUPL", "structural_entropy"),
    "unused-import": ("ui", "UNUS", "structural_entropy"),
    "branch-density": ("bd", "BRAN", "reasoning_complexity"),
    "deep-nesting": ("dn", "NEST", "reasoning_complexity"),
    "type-complexity": ("tc", "TYPE", "reasoning_complexity"),
    "comment-ratio": ("cr", "CMNT", "reasoning_complexity"),
    "implicit-control": ("ic", "HIDE", "reasoning_complexity"),
    "error-swallow": ("es", "SWAL", "reasoning_complexity"),
    "dangerous-pattern": ("dp", "DANG", "reasoning_complexity"),
    "naming-entropy": ("ne", "MIXD", "reasoning_complexity"),
    "stringly-typed": ("st", "STRY", "reasoning_complexity"),
    "import-diversity": ("id", "GODF", "reasoning_complexity"),
}

#: Only the order of these weights is known; the values are chosen and can be replaced.
SEVERITY_WEIGHTS: dict[str, float] = {"Critical": 1.0, "High": 0.75, "Medium": 0.5, "Low": 0.25}


def kinds_table(spark: SparkSession) -> DataFrame:
    """Sixteen rows: kind, prefix, code, bucket."""
    return spark.createDataFrame([(k, *v) for k, v in KINDS.items()], "kind string, prefix string, code string, bucket string")


def severities_table(spark: SparkSession, weights: dict[str, float] | None = None) -> DataFrame:
    """Four rows: severity, weight, label."""
    return spark.createDataFrame([(k, float(v), k[0]) for k, v in (weights or SEVERITY_WEIGHTS).items()], "severity string, weight double, label string")
