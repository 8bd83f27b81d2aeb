"""A scan of a source tree: files, facts, graph, rules, dead weight, clones, score."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import clones, dead, graph, rules, score
from ..operators.facts import LanguagePlugin, file_facts
from ..reports import Report
from ..sources.files import LANGUAGES, detect_languages, read_files, tag_packages
from ..sources.workspace import cargo_workspace, js_workspace, python_workspace
from ..thresholds import Limits, profile

#: Most files whose errors a report lists; it says how many more there are.
MOST_ERRORS = 100_000


@dataclass(frozen=True)
class Options:
    profile: str = "normal"
    include_tests: bool = False
    languages: tuple[str, ...] = ()
    ignore: tuple[str, ...] = ()
    limits: Limits | None = None
    plugins: tuple[LanguagePlugin, ...] = ()


def _workspaces(root: str, languages: list[str]):
    make = {"typescript": js_workspace, "python": python_workspace, "rust": cargo_workspace}
    return [make[x](root) for x in languages if x in make]


def load(spark: SparkSession, root: str, options: Options = Options()) -> DataFrame:
    """Files below root in the languages that are present, tagged with their packages."""
    files = read_files(spark, root, options.include_tests, options.languages, options.ignore)
    present = detect_languages(files, set(os.listdir(root)) if os.path.isdir(root) else set())
    wanted = [x for x in present if not options.languages or x in options.languages]
    found = {r[0] for r in files.select("language").distinct().collect()}  # as many as there are languages
    wanted += [x for x in found if x in LANGUAGES and x not in wanted]  # loose scripts without a manifest
    for w in _workspaces(os.path.abspath(root), wanted):
        files = tag_packages(files, w)
    return files.where(F.col("language").isin(*wanted)) if wanted else files.where("false")


def edges(facts: DataFrame) -> DataFrame:
    """(src, dst) of distinct imports over all languages; re-exports' sources count as imports."""
    base = facts.where("error IS NULL")
    more = F.transform(F.filter("exports", lambda e: ~e["source"].isin("<local>", "*", "")), lambda e: e["source"])
    spec = F.explode(F.array_distinct(F.concat(F.coalesce("imports", F.array().cast("array<string>")), F.when(F.col("language") == "typescript", more).otherwise(F.array().cast("array<string>")))))
    imports = base.select("language", F.col("path").alias("src_path"), "rel_path", "module_path", "package", spec.alias("spec"))
    modules = base.select("language", "module_path", "package", "path", "rel_path")
    py = graph.resolve_prefix(imports.where("language = 'python'"), modules.where("language = 'python' AND module_path <> ''"), ".", skip=graph.STDLIB, strict_chain=True)
    rs_specs = imports.where("language = 'rust'").withColumn("spec", graph.absolute_rust(F.col("spec"), F.col("module_path"))).select("package", "src_path", "spec")
    # files outside any package are one package
    rs = graph.resolve_prefix(rs_specs.na.fill("", ["package"]), modules.where("language = 'rust'").na.fill("", ["package"]), "::", scoped=True)
    ts_files = modules.where("language = 'typescript'").select(F.col("rel_path").alias("path"), F.col("path").alias("full"))
    ts = graph.resolve_relative(imports.where("language = 'typescript'").select(F.col("rel_path").alias("src_path"), "spec"), ts_files)
    named = ts.join(ts_files.select(F.col("path").alias("dst"), F.col("full").alias("to")), "dst").join(ts_files.select(F.col("path").alias("src_path"), F.col("full").alias("from")), "src_path")
    every = py.select("src_path", "dst").union(rs.select("src_path", "dst")).union(named.select("from", "to").toDF("src_path", "dst"))
    return graph.edges_of(every)


def findings(facts: DataFrame, limits: Limits) -> DataFrame:
    """All sixteen rules over facts; one pass for the row rules, one grouping each for the global ones."""
    good = facts.where("error IS NULL")
    degrees = graph.degrees(good, edges(facts)).withColumnRenamed("path", "g_path")
    wide = good.join(degrees, F.col("path") == F.col("g_path")).drop("g_path")
    heavy = S.is_framework_heavy(F.col("imports"), F.col("language"))
    own = {"implicit-control": rules.implicit_control(limits, heavy), "import-diversity": rules.import_diversity(limits, F.col("language") == "python"), "unused-import": rules.unused_import(language=F.col("language"))}
    rows = rules.run_rules(wide, limits, own)
    referenced = good.select(F.explode("module_declarations").alias("module_path"))
    unreferenced = dead.dead_weight(wide, referenced)
    body = good.select("path", F.explode("function_bodies").alias("b")).select("path", "b.name", "b.normalized_body", F.length(S.strip_body(F.col("b.raw_body"))).alias("n"))
    copies = clones.clone_findings(clones.clone_groups(body, F.col("normalized_body"), length=F.col("n")))
    return rows.unionByName(unreferenced).unionByName(copies)


def scan(spark: SparkSession, root: str, options: Options = Options()) -> Report:
    """The report of a source tree; an empty tree has an empty report with zero scores."""
    limits = options.limits or profile(options.profile)
    files = load(spark, root, options)
    facts = file_facts(files, options.plugins).persist()  # three branches read it
    try:
        n, lines, tokens, failed = facts.agg(F.count(F.lit(1)), F.coalesce(F.sum("line_count"), F.lit(0)), F.coalesce(F.sum(S.estimated_tokens(F.col("size_bytes"))), F.lit(0)), F.count("error")).first()
        errors = [f"{r[0]}: {r[1]}" for r in facts.where("error IS NOT NULL").select("rel_path", "error").orderBy("rel_path").limit(MOST_ERRORS).collect()]
        if failed > len(errors):
            errors.append(f"{failed - len(errors)} more files with errors are not listed")
        names = facts.select(F.col("path").alias("__p"), "rel_path")
        found = findings(facts, limits).join(names, F.col("path") == F.col("__p")).withColumn("path", F.col("rel_path")).drop("__p", "rel_path")
        found = found.persist()  # filled by the score below, while the facts are held
        totals = score.global_score(found, n, tokens).first().asDict()
    finally:
        facts.unpersist()
    return Report(found, totals, n - failed, failed, lines, tokens, errors)


def explain(spark: SparkSession, root: str, rel_path: str, options: Options = Options()) -> dict | None:
    """Facts and degrees of one file, or None."""
    facts = file_facts(load(spark, root, options), options.plugins)
    row = facts.where(F.col("rel_path") == rel_path).first()
    if row is None:
        return None
    deg = graph.with_instability(graph.degrees(facts.where("error IS NULL"), edges(facts))).where(F.col("path") == row["path"]).first()
    return row.asDict(recursive=True) | ({k: deg[k] for k in ("fan_in", "fan_out", "instability")} if deg else {})
