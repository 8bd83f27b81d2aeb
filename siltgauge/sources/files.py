"""Enumeration of source files as a DataFrame, and the corpus measures of any table of texts."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from .workspace import EXCLUDED, Workspace, excluded


@dataclass(frozen=True)
class Language:
    """What discovery needs to know of a language; analyse() of a plug-in takes and gives DataFrames."""

    name: str
    extensions: tuple[str, ...]
    manifests: tuple[str, ...] = ()


TYPESCRIPT = Language("typescript", (".ts", ".tsx", ".js", ".jsx", ".mts", ".cts", ".mjs", ".cjs"), ("package.json", "tsconfig.json"))
PYTHON = Language("python", (".py",), ("pyproject.toml", "setup.py", "setup.cfg"))
RUST = Language("rust", (".rs",), ("Cargo.toml",))
LANGUAGES = {x.name: x for x in (TYPESCRIPT, PYTHON, RUST)}


def detect_languages(files: DataFrame, manifests: set[str], languages: tuple[Language, ...] = tuple(LANGUAGES.values())) -> list[str]:
    """Languages with a manifest at the root; those without manifests need a file of theirs."""
    found = {r[0] for r in files.select("language").distinct().limit(len(languages) + 1).collect()}
    return [x.name for x in languages if (set(x.manifests) & manifests if x.manifests else x.name in found)]


def _language(path):
    out = None
    for x in LANGUAGES.values():
        has = path.rlike(r"\.(" + "|".join(e[1:] for e in x.extensions) + ")$")
        out = F.when(has, x.name) if out is None else out.when(has, x.name)
    return out


def _underscored(root: str, ends: tuple[str, ...]) -> list[str]:
    """Files of a mounted tree that Spark's listing hides, as their own or a folder's name begins with an underscore."""
    base = root.removeprefix("file://")
    if "://" in base:
        return []
    out = []
    for folder, dirs, names in os.walk(os.path.abspath(base)):
        dirs[:] = [d for d in dirs if not excluded(d) and not d.startswith(".")]
        below = os.path.relpath(folder, os.path.abspath(base)).split(os.sep)
        hidden = any(x.startswith("_") for x in below)
        out += [os.path.join(folder, n) for n in names if n.endswith(ends) and (hidden or n.startswith("_"))]
    return sorted(out)


def _contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        data = [Path(p).read_bytes() for p in pdf["p"]]
        yield pd.DataFrame({"p": pdf["p"], "length": [len(x) for x in data], "content": data})


def read_files(spark: SparkSession, root: str, include_tests: bool = False, languages: tuple[str, ...] = (), ignore: tuple[str, ...] = ()) -> DataFrame:
    """All source files below root: path, rel_path, size_bytes, line_count, language, package, metadata, text.

    The listing filters by name before any content is read. Names that begin with an underscore,
    which Spark's own listing hides, are read beside it in mounted trees, not in object stores.
    Declaration files, tests, excluded
    folders and ignored patterns (regular expressions over the relative path) are left out.
    """
    ends = ",".join(e[1:] for x in LANGUAGES.values() if not languages or x.name in languages for e in x.extensions)
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{{{ends}}}").load(root)
    clean = F.regexp_replace("path", r"^file:/+", "/")
    base = "/" + root.split("://")[-1].strip("/") + "/"
    rel = F.expr(f"substr(p, instr(p, '{base}') + {len(base)})") if "'" not in base else F.regexp_replace("p", F.lit(base), F.lit(""))
    files = raw.select(clean.alias("p"), "length", "content")
    more = _underscored(root, tuple("." + e for e in ends.split(",")))
    if more:
        hidden = spark.createDataFrame([(p,) for p in more], "p string").repartition(min(len(more), 64))
        files = files.union(hidden.mapInPandas(_contents, "p string, length long, content binary"))
    files = files.withColumn("rel_path", rel)
    folders = "|".join(x.replace(".", r"\.") for x in sorted(EXCLUDED))
    files = files.where(~F.col("rel_path").rlike(rf"(^|/)({folders}|[^/]*\.egg-info)/") & ~F.col("rel_path").rlike(r"\.d\.[cm]?ts$"))
    for pattern in ignore:
        files = files.where(~F.col("rel_path").rlike(pattern))
    if not include_tests:
        files = files.where(~S.is_test_path(F.col("rel_path")))
    files = files.withColumn("language", _language(F.col("rel_path")))
    if languages:
        files = files.where(F.col("language").isin(*languages))
    files = files.dropDuplicates(["p"]).withColumn("text", F.col("content").cast("string"))
    return files.select(F.col("p").alias("path"), "rel_path", F.col("length").cast("bigint").alias("size_bytes"), S.line_count(F.col("text")).alias("line_count"), "language", F.lit(None).cast("string").alias("package"), F.create_map().cast("map<string,string>").alias("metadata"), "text")


def tag_packages(files: DataFrame, workspace: Workspace) -> DataFrame:
    """Each file's package by its longest root; roots are exploded from paths, so this is an equi-join."""
    roots = [(r.rstrip("/"), p.name) for p in workspace.packages for r in {p.root, *p.source_roots}]
    if not roots:
        return files
    table = files.sparkSession.createDataFrame(roots, "root string, pkg string").groupBy("root").agg(F.min("pkg").alias("pkg"))
    parts = F.split("path", "/")
    tried = files.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))).alias("root"))
    best = tried.join(table, "root").groupBy("path").agg(F.max_by("pkg", F.length("root")).alias("pkg"))
    return files.join(best, "path", "left").withColumn("package", F.coalesce("pkg", "package")).drop("pkg").select(*files.columns)


def measure(texts: DataFrame, text: str = "text", trailing_counts: bool = False) -> DataFrame:
    """texts with size_bytes, line_count, and tokens floored and rounded; null texts are empty."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    size = F.octet_length(t).cast("bigint")
    return texts.withColumns({"size_bytes": size, "line_count": S.line_count(t, trailing_counts), "tokens_floor": S.estimated_tokens(size), "tokens_round": S.estimated_tokens(size, True)})


def nesting(texts: DataFrame, key: str, text: str, opening: str, closing: str) -> DataFrame:
    """(key, max_depth): deepest nesting of opening and closing tokens, as a running sum in the row.

    An array fold instead of a window: no explosion, no shuffle, and a text's tokens never leave it.
    """
    marks = F.transform(F.regexp_extract_all(F.col(text), F.lit(f"({opening})|({closing})"), F.lit(0)), lambda m: F.when(m.rlike(f"^({closing})$"), -1).otherwise(1))
    start = F.struct(F.lit(0).alias("now"), F.lit(0).alias("best"))
    fold = F.aggregate(marks, start, lambda a, d: F.struct((a["now"] + d).alias("now"), F.greatest(a["best"], a["now"] + d).alias("best")), lambda a: a["best"])
    return texts.select(key, fold.cast("int").alias("max_depth"))


def nesting_by_window(tokens: DataFrame, key: str, at: str | Column, delta: str) -> DataFrame:
    """The same over a table with a row for each token."""
    run = F.sum(delta).over(Window.partitionBy(key).orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return tokens.withColumn("__run", run).groupBy(key).agg(F.greatest(F.max("__run"), F.lit(0)).cast("int").alias("max_depth"))
