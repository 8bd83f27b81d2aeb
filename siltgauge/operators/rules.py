"""The fourteen per-row rules as one projection: each is a column that is a finding or null.

All rules see one row of facts, so a single scan evaluates them; the array of their findings is
filtered and exploded, and no rule costs a further pass or shuffle. Rules are given as columns
over whatever frame holds the facts, so they work on any table whose columns are renamed to the
facts that a rule reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..thresholds import NORMAL, Limits

STRUCT = "struct<kind:string,severity:string,confidence:double,evidence:map<string,string>,estimated_tokens:bigint>"
#: Names that a compiler uses where no identifier shows it; languages not listed have none.
COMPILER_NAMES = {"typescript": ("React", "Fragment", "jsx", "jsxs")}
#: Rules whose evidence shows where to look.
SHOWN = ("error-swallow", "dangerous-pattern", "stringly-typed")


def finding(kind: str, fires: Column, severity: Column | str, confidence: Column | float, evidence: dict[str, Column], tokens: Column | None = None) -> Column:
    """A finding, or null where it does not fire; null evidence values are left out."""
    pairs = F.array(*[F.struct(F.lit(k).alias("key"), v.cast("string").alias("value")) for k, v in evidence.items()])
    made = F.struct(
        F.lit(kind).alias("kind"), S.lit(severity).alias("severity"), S.lit(confidence).cast("double").alias("confidence"),
        F.map_from_entries(F.filter(pairs, lambda p: p["value"].isNotNull())).alias("evidence"), (F.lit(None) if tokens is None else tokens).cast("bigint").alias("estimated_tokens"),
    )
    return F.when(fires, made)


def _over(count: Column, base: Column) -> Column:
    return count / F.greatest(base, F.lit(1))


def context_bomb(L: Limits) -> Column:
    n, tokens = F.col("line_count"), S.estimated_tokens(F.col("size_bytes"))
    extra = {k: F.when(F.col(k) > m, F.col(k)) for k, m in (("function_count", 10), ("class_count", 3), ("impl_block_count", 3))}
    severity = S.severity_scale(n, L.line_count, factors=(4, 2))
    confidence = F.when(severity == "Critical", 0.95).when(severity == "High", 0.85).otherwise(0.75)
    return finding("context-bomb", n >= L.line_count, severity, confidence, {"line_count": n, "estimated_tokens": tokens, "limit": F.lit(L.line_count), **extra}, tokens)


def branch_density(L: Limits) -> Column:
    b, f = F.col("branch_count"), F.col("function_count")
    x = _over(b, f)
    return finding("branch-density", x > L.branch_density, S.severity_scale(x, L.branch_density), 0.85, {"branch_count": b, "function_count": f, "avg_branches_per_fn": F.format_string("%.2f", x), "limit": F.lit(L.branch_density)})


def deep_nesting(L: Limits) -> Column:
    d = F.col("max_nesting_depth")
    return finding("deep-nesting", d > L.nesting_depth, S.severity_offset(d, L.nesting_depth, offsets=(4, 2)), 0.85, {"max_depth": d, "limit": F.lit(L.nesting_depth), "deepest_at": F.lit("unknown")})


def type_complexity(L: Limits) -> Column:
    d = F.col("max_type_depth")
    return finding("type-complexity", d > L.type_depth, S.severity_offset(d, L.type_depth), 0.50, {"max_type_depth": d, "limit": F.lit(L.type_depth), "location": F.lit("unknown")})


def comment_ratio(L: Limits) -> Column:
    c, n = F.col("comment_line_count"), F.col("line_count")
    x = _over(c, n)
    sparse, verbose = x < L.comment_ratio_min, x > L.comment_ratio_max
    side = F.when(sparse, "sparse").otherwise("verbose")
    return finding("comment-ratio", sparse | verbose, F.when(sparse, "Medium").otherwise("Low"), 0.65, {"comment_lines": c, "total_lines": n, "ratio": F.format_string("%.4f", x), "direction": side})


def implicit_control(L: Limits, framework: Column | None = None) -> Column:
    d, f = F.col("decorator_count"), F.col("function_count")
    limit = F.lit(float(L.decorator_density)) * (F.lit(1.0) if framework is None else F.when(framework, 1.5).otherwise(1.0))
    x = _over(d, f)
    severity = F.when(x >= limit * 3, "High").when(x > limit * 2, "Medium").otherwise("Low")
    return finding("implicit-control", x > limit, severity, 0.40, {"decorator_count": d, "function_count": f, "ratio": F.format_string("%.3f", x), "limit": F.format_string("%.3f", limit)})


def error_swallow(L: Limits, preview: Column | None = None) -> Column:
    n = F.col("empty_catch_count")
    return finding("error-swallow", n > L.empty_catch, S.ladder(n, (5, "High"), (3, "Medium"), otherwise="Low"), 0.75, {"empty_catch_count": n, "limit": F.lit(L.empty_catch), "preview": F.lit(None) if preview is None else preview})


def dangerous_pattern(L: Limits, preview: Column | None = None) -> Column:
    n = F.col("dangerous_pattern_count")
    return finding("dangerous-pattern", n > L.dangerous_pattern, S.severity_scale(n, L.dangerous_pattern), 0.70, {"dangerous_pattern_count": n, "limit": F.lit(L.dangerous_pattern), "preview": F.lit(None) if preview is None else preview})


def stringly_typed(L: Limits, preview: Column | None = None) -> Column:
    n = F.col("string_comparison_count")
    return finding("stringly-typed", n > L.string_comparison, S.severity_scale(n, L.string_comparison, ("High", "Medium", "Low")), 0.65, {"string_comparison_count": n, "limit": F.lit(L.string_comparison), "preview": F.lit(None) if preview is None else preview})


def import_diversity(L: Limits, dotted: Column | bool = False) -> Column:
    named = F.filter(F.transform("imports", lambda i: S.import_domain(i, dotted)), lambda d: d.isNotNull() & (d != ""))
    domains = F.array_sort(F.array_distinct(named))
    n = F.coalesce(F.size(domains), F.lit(0))
    return finding("import-diversity", n > L.import_domain, S.severity_scale(n, L.import_domain, ("High", "Medium", "Low")), 0.70, {"domain_count": n, "domains": F.array_join(F.slice(domains, 1, 8), ", "), "limit": F.lit(L.import_domain)})


CONVENTIONS = ("camel", "other", "pascal", "screaming", "snake")


def naming_entropy(least: int = 10, share: float = 0.05, conventions: int = 3) -> Column:
    """Three conventions, "other" included, each above the share; the dominant one ties alphabetically.

    Each identifier is classified once, however many parts of the finding read the counts.
    """
    n = F.coalesce(F.size("identifiers"), F.lit(0))
    of = lambda kinds, c: F.coalesce(F.size(kinds) - F.size(F.array_remove(kinds, c)), F.lit(0)).alias(c)

    def made(count: Column) -> Column:
        mixed = sum(((count[c] > n * share).cast("int") for c in CONVENTIONS), F.lit(0))
        ranked = F.array_sort(F.array(*[F.struct((-count[c]).alias("n"), F.lit(c).alias("name")) for c in CONVENTIONS]))
        text = F.to_json(F.struct(*[F.when(count[c] > 0, count[c]).alias(c) for c in CONVENTIONS]))
        return finding("naming-entropy", (n >= least) & (mixed >= conventions), "Low", 0.50, {"convention_counts": text, "dominant_convention": F.get(ranked, F.lit(0))["name"], "mixed_count": mixed})

    kinds = F.when(n >= least, F.transform("identifiers", S.classify_identifier))
    return S.let(S.let(kinds, lambda k: F.struct(*[of(k, c) for c in CONVENTIONS])), made)


def reexport_entropy(L: Limits, least: int = 3, any_of: bool = False) -> Column:
    """Many re-exports or a wildcard; with any_of each of the three conditions alone fires.

    Unknown item counts (null or negative) add nothing.
    """
    n = F.coalesce(F.size("exports"), F.lit(0))
    items = F.coalesce(F.aggregate("exports", F.lit(0).cast("bigint"), lambda a, e: a + F.greatest(F.coalesce(e["item_count"].cast("bigint"), F.lit(0)), F.lit(0))), F.lit(0))
    wild = F.coalesce(F.exists("exports", lambda e: e["is_wildcard"]), F.lit(False))
    fires = (n >= least) | (items >= L.reexport) | wild if any_of else wild | ((n >= least) & (items >= L.reexport))
    severity = F.when(wild | (items >= 3 * L.reexport), "High").when(items >= L.reexport, "Medium").otherwise("Low")
    return finding("reexport-entropy", fires, severity, 0.80, {"reexport_count": n, "total_items": items, "has_wildcard": wild})


def unused_import(least: int = 2, medium: int = 5, compiler_names: tuple[str, ...] = COMPILER_NAMES["typescript"], language: Column | None = None) -> Column:
    """Imported names that no identifier repeats; duplicates count, so this is no set difference.

    Work grows with names and identifiers, not with their product: hashed sets tell which names are
    used, repeats are counted in one pass over names in order, and the first five unused names hold
    at most the first five different ones.
    """
    none = F.array().cast("array<string>")
    known = F.array(*map(F.lit, compiler_names)).cast("array<string>")
    if language is not None:
        known = F.when(language == "typescript", known).otherwise(none)

    def made(names: Column, used: Column) -> Column:
        marked = F.concat(F.transform(used, lambda x: F.struct(x.alias("name"), F.lit(0).alias("place"))), F.transform(names, lambda x: F.struct(x.alias("name"), F.lit(1).alias("place"))))
        state = lambda last, n: F.struct(last.alias("last"), n.alias("n"))
        step = lambda a, x: F.when(x["place"] == 0, state(x["name"], a["n"])).otherwise(state(a["last"], a["n"] + F.when(x["name"] == a["last"], 0).otherwise(1)))
        unused = F.coalesce(F.aggregate(F.sort_array(marked), state(F.lit(None).cast("string"), F.lit(0)), step, lambda a: a["n"]), F.lit(0))
        first = S.let(F.slice(F.array_except(names, used), 1, 5), lambda few: F.slice(F.filter(names, lambda x: F.array_contains(few, x)), 1, 5))
        return S.let(unused, lambda n: finding("unused-import", n >= least, S.ladder(n, (medium, "Medium"), otherwise="Low"), 0.65, {"unused_count": n, "preview": F.array_join(first, ", ")}))

    return S.let(F.array_compact("imported_names"), lambda names: S.let(F.array_intersect(names, F.concat(F.col("identifiers"), known)), lambda used: made(names, used)))


def coupling_hotspot(L: Limits) -> Column:
    i, o = F.col("fan_in"), F.col("fan_out")
    many_in, many_out = i >= L.fan_in, o >= L.fan_out
    pattern = F.when(many_in & many_out, "god").when(many_in, "api").otherwise("orch")
    high = F.when(pattern == "god", (i >= 3 * L.fan_in) | (o >= 2 * L.fan_out)).when(pattern == "orch", o >= 3 * L.fan_out).otherwise(False)
    confidence = F.when(pattern == "god", 0.85).when(pattern == "api", 0.65).otherwise(0.70)
    return finding("coupling-hotspot", many_in | many_out, F.when(high, "High").otherwise("Medium"), confidence, {"fan_in": i, "fan_out": o, "instability": F.format_string("%.3f", S.instability(i, o)), "pattern": pattern})


#: Rule name: (function of limits, the fact columns that it reads).
RULES: dict[str, tuple[Callable[[Limits], Column], tuple[str, ...]]] = {
    "context-bomb": (context_bomb, ("line_count", "size_bytes", "function_count", "class_count", "impl_block_count")),
    "branch-density": (branch_density, ("branch_count", "function_count")),
    "deep-nesting": (deep_nesting, ("max_nesting_depth",)),
    "type-complexity": (type_complexity, ("max_type_depth",)),
    "comment-ratio": (comment_ratio, ("comment_line_count", "line_count")),
    "implicit-control": (implicit_control, ("decorator_count", "function_count")),
    "error-swallow": (error_swallow, ("empty_catch_count",)),
    "dangerous-pattern": (dangerous_pattern, ("dangerous_pattern_count",)),
    "stringly-typed": (stringly_typed, ("string_comparison_count",)),
    "import-diversity": (import_diversity, ("imports",)),
    "naming-entropy": (lambda L: naming_entropy(), ("identifiers",)),
    "reexport-entropy": (reexport_entropy, ("exports",)),
    "unused-import": (lambda L: unused_import(), ("imported_names", "identifiers")),
    "coupling-hotspot": (coupling_hotspot, ("fan_in", "fan_out")),
}


def run_rules(facts: DataFrame, limits: Limits = NORMAL, columns: dict[str, Column] | None = None, path: str = "path") -> DataFrame:
    """Findings of all rules whose facts the frame has, one row each, from a single projection.

    columns replaces or adds rules by name.
    """
    preview = {"preview": F.col("rel_path" if "rel_path" in facts.columns else path)}
    made = {k: f(limits, **(preview if k in SHOWN else {})) for k, (f, needs) in RULES.items() if set(needs) <= set(facts.columns)}
    made |= columns or {}
    every = F.filter(F.array(*[c.cast(STRUCT) for c in made.values()]), lambda x: x.isNotNull())
    return facts.select(F.col(path).alias("path"), F.explode(every).alias("f")).select("path", "f.*")


def unused_names(names: DataFrame, identifiers: DataFrame, key: str, name: str = "name", least: int = 2, medium: int = 5) -> DataFrame:
    """(key, unused_count, severity) over tables with a row for each name, where arrays would be unbounded.

    Repeated names are summed before the anti-join, so a hot key or word is one row on each side.
    """
    counted = names.where(F.col(name).isNotNull()).groupBy(key, name).agg(F.count(F.lit(1)).alias("n"))
    rest = counted.join(identifiers.select(key, name).distinct(), [key, name], "left_anti")
    sums = rest.groupBy(key).agg(F.sum("n").alias("unused_count")).where(F.col("unused_count") >= least)
    return sums.select(key, "unused_count", S.ladder(F.col("unused_count"), (medium, "Medium"), otherwise="Low").alias("severity"))
