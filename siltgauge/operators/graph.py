"""Import graphs: longest-prefix and relative-path resolution as equi-joins, degrees, instability.

Resolution never compares every import with every module. Each distinct import explodes into
its few prefixes (or candidate paths), which meet the modules in one equi-join; the longest hit
is taken by a grouped maximum. Distinct imports are resolved once, so a name that a third of all
files import is one row in the join.
"""

from __future__ import annotations

import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import instability

STDLIB = tuple(sorted(sys.stdlib_module_names))


def prefixes(spec: Column, separator: str) -> Column:
    """All prefixes of a separated name, longest first; null for null or empty names."""
    parts = F.filter(F.split(spec, _regex(separator)), lambda p: p != "")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.array_join(F.slice(parts, 1, n), separator)))


def _regex(separator: str) -> str:
    return "".join("\\" + c if c in ".|$^*+?()[]{}\\" else c for c in separator)


def absolute_rust(spec: Column, module: Column) -> Column:
    """crate::, self:: and super:: specs as paths below the crate; bare ones as they are."""
    parts = F.split(spec, "::")
    own = F.filter(F.split(F.regexp_replace(module, "^crate(::)?", ""), "::"), lambda p: p != "")
    ups = F.size(parts) - F.size(F.filter(parts, lambda p: p != "super"))
    rest = F.filter(parts, lambda p: ~p.isin("crate", "self", "super"))
    base = F.when(parts[0] == "crate", F.slice(own, 1, F.lit(0))).when(parts[0] == "super", F.slice(own, F.lit(1), F.greatest(F.size(own) - ups, F.lit(0)))).otherwise(own)
    inside = parts[0].isin("crate", "self", "super")
    return F.when(inside, F.array_join(F.concat(F.array(F.lit("crate")), base, rest), "::")).otherwise(spec)


def absolute_python(spec: Column, module: Column, is_package: Column) -> Column:
    """Leading dots resolved against the importing module."""
    dots = F.length(F.regexp_extract(spec, r"^\.*", 0))
    own = F.filter(F.split(module, r"\."), lambda p: p != "")
    keep = F.greatest(F.size(own) - dots + F.when(is_package, 1).otherwise(0), F.lit(0))
    rest = F.filter(F.split(F.regexp_replace(spec, r"^\.+", ""), r"\."), lambda p: p != "")
    return F.when(dots > 0, F.array_join(F.concat(F.slice(own, F.lit(1), keep), rest), ".")).otherwise(spec)


def resolve_prefix(imports: DataFrame, modules: DataFrame, separator: str = ".", scoped: bool = False, strict_chain: bool = False, skip: tuple[str, ...] = ()) -> DataFrame:
    """(src_path, spec, dst): each import's module by longest prefix.

    imports has src_path, spec and, if scoped, package; modules has module_path, path and, if
    scoped, package, and only modules of the same package match then. strict_chain asks that what
    lies below the matched module is also known as a prefix of a module, else nothing matches.
    skip drops specs by their first part. A module path that two files share goes to the smallest.
    """
    keys = ["package"] if scoped else []
    names = imports.select(*keys, "spec").distinct()
    if skip:
        names = names.where(~F.get(F.split("spec", _regex(separator)), F.lit(0)).isin(*skip))
    tried = names.select(*keys, "spec", F.posexplode(prefixes(F.col("spec"), separator)).alias("cut", "module_path"))
    known = modules.groupBy(*keys, "module_path").agg(F.min("path").alias("dst"))
    if strict_chain:
        tree = modules.select(*keys, F.explode(prefixes(F.col("module_path"), separator)).alias("module_path")).distinct()
        every = tried.join(tree.withColumn("there", F.lit(True)), [*keys, "module_path"], "left").join(known, [*keys, "module_path"], "left")
        # cut counts the parts below a prefix: those not in the tree must lie above the match
        best = every.groupBy(*keys, "spec").agg(F.min(F.when(F.col("dst").isNotNull(), F.struct("cut", "dst"))).alias("hit"), F.max(F.when(F.col("there").isNull(), F.col("cut"))).alias("gap"))
        best = best.where(F.col("hit").isNotNull() & (F.col("gap").isNull() | (F.col("gap") >= F.col("hit.cut"))))
    else:
        best = tried.join(known, [*keys, "module_path"]).groupBy(*keys, "spec").agg(F.min(F.struct("cut", "dst")).alias("hit"))
    return imports.join(best, [*keys, "spec"]).select("src_path", "spec", F.col("hit.dst").alias("dst"))


EXTENSIONS = ("", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")


def normal_path(path: Column) -> Column:
    """A slash path without ``.`` and ``..`` segments."""
    return F.array_join(
        F.aggregate(
            F.filter(F.split(path, "/"), lambda p: ~p.isin("", ".")), F.array().cast("array<string>"),
            lambda a, p: F.when((p == "..") & (F.size(a) > 0), F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(F.concat(a, F.array(p))),
        ),
        "/",
    )


def resolve_relative(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(src_path, spec, dst) of specs that start with a dot; the first candidate that is a file wins.

    A spec of a compiled name (.js for .ts) tries the source's name too. Paths are relative.
    """
    near = imports.where(F.col("spec").startswith("."))
    folder = F.regexp_replace("src_path", "[^/]*$", "")
    base = normal_path(F.concat(folder, F.lit("/"), F.col("spec")))
    bare = F.regexp_replace(base, r"\.(js|jsx|mjs|cjs)$", "")
    tries = F.concat(F.array(*[F.concat(base, F.lit(x)) for x in EXTENSIONS]), F.when(bare != base, F.array(F.concat(bare, F.lit(".ts")), F.concat(bare, F.lit(".tsx")))).otherwise(F.array().cast("array<string>")))
    tried = near.select("src_path", "spec", F.posexplode(tries).alias("nth", "path"))
    hit = tried.join(files.select("path").distinct(), "path").groupBy("src_path", "spec").agg(F.min(F.struct("nth", "path")).alias("hit"))
    return near.join(hit, ["src_path", "spec"]).select("src_path", "spec", F.col("hit.path").alias("dst"))


def edges_of(resolved: DataFrame, distinct: bool = True) -> DataFrame:
    """(src, dst) without self-edges; a row for each pair, or for each import."""
    e = resolved.where(F.col("src_path") != F.col("dst")).select(F.col("src_path").alias("src"), "dst")
    return e.distinct() if distinct else e


def degrees(nodes: DataFrame, edges: DataFrame, node: str = "path") -> DataFrame:
    """(path, fan_in, fan_out) of all nodes, zero for those without edges; one pass over the edges.

    Both directions are counted in one aggregation, which sums before it shuffles.
    """
    ends = edges.select(F.explode(F.array(F.struct(F.col("dst").alias("n"), F.lit(1).alias("i"), F.lit(0).alias("o")), F.struct(F.col("src").alias("n"), F.lit(0).alias("i"), F.lit(1).alias("o")))).alias("e"))
    sums = ends.groupBy(F.col("e.n").alias("__n")).agg(F.sum("e.i").alias("i"), F.sum("e.o").alias("o"))
    return nodes.select(F.col(node).alias("path")).distinct().join(sums, F.col("path") == F.col("__n"), "left").select("path", F.coalesce("i", F.lit(0)).cast("bigint").alias("fan_in"), F.coalesce("o", F.lit(0)).cast("bigint").alias("fan_out"))


def with_instability(deg: DataFrame) -> DataFrame:
    return deg.withColumn("instability", instability(F.col("fan_in"), F.col("fan_out")))


def referenced_closure(names: DataFrame, column: str, separator: str = "::") -> DataFrame:
    """(module_path): every name and every proper prefix of it, once."""
    return names.select(F.explode(prefixes(F.col(column), separator)).alias("module_path")).distinct()
