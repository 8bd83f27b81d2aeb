"""Scalar column functions: severity ladders, names, domains, normalisation, evidence, predicates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import KINDS, SEVERITY_WEIGHTS


def lit(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ladder(value: Column, *steps: tuple[object, str], otherwise: str) -> Column:
    """First name whose bound the value reaches."""
    out = None
    for bound, name in steps:
        out = F.when(value >= lit(bound), name) if out is None else out.when(value >= lit(bound), name)
    return out.otherwise(otherwise)


def severity_scale(value: Column, limit, names=("Critical", "High", "Medium"), factors=(3, 2)) -> Column:
    """Multiplicative: reaches factor times the limit."""
    return ladder(value, (lit(limit) * factors[0], names[0]), (lit(limit) * factors[1], names[1]), otherwise=names[2])


def severity_offset(value: Column, limit, names=("Critical", "High", "Medium"), offsets=(3, 2)) -> Column:
    """Additive: exceeds the limit by an offset."""
    return ladder(value, (lit(limit) + offsets[0], names[0]), (lit(limit) + offsets[1], names[1]), otherwise=names[2])


def classify_identifier(name: Column) -> Column:
    """snake, screaming, camel, pascal or other; ASCII rules, as case maps differ between engines.

    First letters are compared by the order of strings, so that most words meet one pattern.
    """
    lower_first, upper_first = (name >= "a") & (name < "{"), (name >= "A") & (name < "[")
    return (
        F.when(F.length(name) < 3, "other")
        .when(name.contains("_") & ~name.rlike("[A-Z]"), "snake")
        .when(name.contains("_") & ~name.rlike("[a-z]"), "screaming")
        .when(lower_first & name.rlike("[A-Z]"), "camel")
        .when(upper_first & name.rlike("[a-z]"), "pascal")
        .otherwise("other")
    )


def import_domain(spec: Column, dotted: Column | bool = False) -> Column:
    """The package or top part that an import names; null for relative ones.

    ``crate::x`` gives x, ``self`` and ``super`` give null, an alias is dropped, a scoped
    package keeps its scope; dotted specs (Python) give their first part.
    """
    bare = F.trim(F.regexp_replace(spec, r"\s+as\s+\w+\s*$", ""))
    colon = F.when(bare.rlike("^(self|super)(::|$)"), F.lit(None)).when(bare.startswith("crate::"), F.get(F.split(bare, "::"), F.lit(1))).otherwise(F.get(F.split(bare, "::"), F.lit(0)))
    path = F.get(F.split(bare, "/"), F.lit(0))
    return (
        F.when(bare.startswith(".") | (bare == ""), F.lit(None).cast("string"))
        .when(lit(dotted), F.get(F.split(bare, r"\."), F.lit(0)))
        .when(bare.contains("::") | bare.rlike("^(self|super|crate)$"), colon)
        .otherwise(path)
    )


def strip_body(body: Column) -> Column:
    return F.regexp_replace(body, r"[\s;]+", "")


KEYWORDS = (
    "if else for while do switch case break continue return try catch finally throw new typeof instanceof in of var let const function class extends super this "
    "import export default async await yield null undefined true false void delete fn match loop impl struct enum trait pub use mod where mut ref move self static type as"
).split()


def blank_identifiers(body: Column, keywords: tuple[str, ...] = tuple(KEYWORDS)) -> Column:
    """Type-2 key: every identifier but keywords becomes ``_``, white space and ``;`` go."""
    words = "|".join(keywords)
    return strip_body(F.regexp_replace(body, rf"\b(?!(?:{words})\b)[A-Za-z_$][A-Za-z0-9_$]*", "_"))


def is_test_name(name: Column, patterns: tuple[str, ...] = ("for_test", "forTest")) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | name.contains(p)
    return out


TEST_PATH = r"(^|/)(tests?|__tests__|testing)/|(^|/)(test_[^/]*|conftest)\.py$|_test\.(py|rs)$|(^|/)tests\.(py|rs)$|\.(test|spec)\.[cm]?[jt]sx?$"
# File names of tools, and imports whose files may have more decorators.
CONFIG_PATH = r"\.config\.(ts|js|mjs|cjs)$|\.eslintrc\.(js|cjs|json)$|\.prettierrc\.(js|cjs|json)$"
FRAMEWORKS = {
    "typescript": ("@nestjs/", "@angular/", "@Component", "@NgModule", "@Entity", "@Injectable", "@Controller", "@Service", "@dataclass", "@pydantic"),
    "python": ("dataclasses", "pydantic", "attr", "attrs", "sqlalchemy", "django", "flask", "fastapi", "typing_extensions"),
}


def is_test_path(path: Column) -> Column:
    return path.rlike(TEST_PATH)


def is_config_path(path: Column) -> Column:
    return path.rlike(CONFIG_PATH)


def is_framework_heavy(imports: Column, language: Column) -> Column:
    """Whether an import holds the name of a framework of its language."""
    out = F.lit(False)
    for name, parts in FRAMEWORKS.items():
        holds = F.exists(imports, lambda i: F.greatest(*[i.contains(p) for p in parts]))  # noqa: B023
        out = F.when(language == name, F.coalesce(holds, F.lit(False))).otherwise(out)
    return out


def evidence_map(lines: Column) -> Column:
    """``"k: v"`` lines to a map; the first ``": "`` splits, lines without one are dropped, last key wins."""
    pairs = F.transform(F.filter(lines, lambda e: F.instr(e, ": ") > 0), lambda e: F.struct(F.substring_index(e, ": ", 1).alias("key"), F.substr(e, F.instr(e, ": ") + 2).alias("value")))
    # of equal keys the last stays: those that no later pair repeats
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.greatest(F.size(pairs), F.lit(1))), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def estimated_tokens(size_bytes: Column, rounded: bool = False) -> Column:
    """A token for four bytes; floored, or rounded half up."""
    return (F.round(size_bytes / 4) if rounded else F.floor(size_bytes / 4)).cast("bigint")


def line_count(text: Column, trailing_counts: bool = False) -> Column:
    """Lines of a text; with trailing_counts a last newline begins one more (empty texts have one)."""
    n = F.length(text) - F.length(F.regexp_replace(text, "\n", "")) + 1
    if trailing_counts:
        return n.cast("bigint")
    return (n - F.when(text.endswith("\n") | (text == ""), 1).otherwise(0)).cast("bigint")


def kebab(name: Column) -> Column:
    return F.lower(F.regexp_replace(F.regexp_replace(name, "([a-z])([A-Z])", "$1-$2"), "_", "-"))


def severity_name(name: Column) -> Column:
    """Any case to Critical, High, Medium or Low."""
    return F.initcap(F.lower(name))


def kind_map(position: int) -> Column:
    """kind to prefix (0), code (1) or bucket (2), as a map literal."""
    return F.create_map(*[F.lit(x) for k, v in KINDS.items() for x in (k, v[position])])


def weight_map(weights: dict[str, float] | None = None) -> Column:
    return F.create_map(*[F.lit(x) for k, v in (weights or SEVERITY_WEIGHTS).items() for x in (k, float(v))])


def score_bar(score: Column, cells: int = 10, rounded: bool = True) -> Column:
    n = (F.round(score * cells / 100) if rounded else F.floor(score * cells / 100)).cast("int")
    n = F.least(F.greatest(n, F.lit(0)), F.lit(cells))
    return F.concat(F.repeat(F.lit("█"), n), F.repeat(F.lit("░"), F.lit(cells) - n))


def score_level(score: Column) -> Column:
    return ladder(score, (70, "high"), (40, "moderate"), (20, "low"), otherwise="minimal")


def instability(fan_in: Column, fan_out: Column) -> Column:
    return F.coalesce(fan_out / F.nullif(fan_in + fan_out, F.lit(0)), F.lit(0.0))


def instability_label(value: Column) -> Column:
    return F.when(value < 0.1, "stable").when(value > 0.9, "volatile").otherwise("mixed")


def module_path(rel_path: Column, separator: str = "::", package: Column | None = None) -> Column:
    """Path segments after the last src/, without extension and a trailing index, mod or __init__."""
    inner = F.regexp_replace(F.regexp_replace(rel_path, r"^(.*/)?src/", ""), r"\.[A-Za-z]+$", "")
    parts = F.filter(F.split(inner, "/"), lambda p: (p != "") & ~p.isin("index", "mod", "__init__", "lib", "main"))
    if package is not None:
        parts = F.concat(F.array(package), parts)
    return F.array_join(parts, separator)
