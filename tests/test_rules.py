"""Boundary values of every rule, scores, ranks and comparisons."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltgauge import thresholds
from siltgauge.functions import scalars as S
from siltgauge.operators import clones, dead, graph, rules, score
from siltgauge.plans import catalogue
from siltgauge.schema import FILE_FACTS
from siltgauge.thresholds import NORMAL, RELAXED, STRICT

BASE = {
    "path": "p", "rel_path": "p", "language": "python", "package": None, "module_path": "m", "line_count": 200, "size_bytes": 4000, "is_entry_point": False, "is_package_init": False, "function_count": 3,
    "class_count": 0, "impl_block_count": 0, "imports": [], "imported_names": [], "identifiers": [], "module_declarations": [], "all_export": None, "exports": [], "function_bodies": [], "branch_count": 0,
    "max_nesting_depth": 0, "max_type_depth": 0, "comment_line_count": 20, "decorator_count": 0, "empty_catch_count": 0, "dangerous_pattern_count": 0, "string_comparison_count": 0, "error": None,
}


def found(spark, limits=NORMAL, fan=None, **facts):
    df = spark.createDataFrame([BASE | facts], FILE_FACTS)
    if fan:
        df = df.withColumns({"fan_in": F.lit(fan[0]), "fan_out": F.lit(fan[1])})
    return {r["kind"]: r for r in rules.run_rules(df, limits).collect()}


def names(n):
    return [f"n{k}" for k in range(n)]


def exports(*items):
    return [("x", n, w) for n, w in items]


MIXED = [f"snake_{k}" for k in range(6)] + [f"camelName{k}" for k in range(6)] + [f"PascalName{k}" for k in range(6)]
CASES = [
    ("context-bomb", NORMAL, {"line_count": 499}, None), ("context-bomb", NORMAL, {"line_count": 500}, "Medium"), ("context-bomb", NORMAL, {"line_count": 1000}, "High"), ("context-bomb", NORMAL, {"line_count": 2000}, "Critical"),
    ("branch-density", NORMAL, {"branch_count": 12, "function_count": 1}, None), ("branch-density", NORMAL, {"branch_count": 13, "function_count": 1}, "Medium"),
    ("branch-density", NORMAL, {"branch_count": 24, "function_count": 1}, "High"), ("branch-density", NORMAL, {"branch_count": 36, "function_count": 1}, "Critical"), ("branch-density", NORMAL, {"branch_count": 25, "function_count": 0}, "High"),
    ("branch-density", STRICT, {"branch_count": 8, "function_count": 1}, None),
    ("deep-nesting", NORMAL, {"max_nesting_depth": 6}, None), ("deep-nesting", NORMAL, {"max_nesting_depth": 7}, "Medium"), ("deep-nesting", NORMAL, {"max_nesting_depth": 8}, "High"), ("deep-nesting", NORMAL, {"max_nesting_depth": 10}, "Critical"), ("deep-nesting", RELAXED, {"max_nesting_depth": 9}, "Medium"),
    ("type-complexity", NORMAL, {"max_type_depth": 4}, None), ("type-complexity", NORMAL, {"max_type_depth": 5}, "Medium"), ("type-complexity", NORMAL, {"max_type_depth": 6}, "High"), ("type-complexity", NORMAL, {"max_type_depth": 7}, "Critical"),
    ("comment-ratio", NORMAL, {"comment_line_count": 50, "line_count": 1000}, None), ("comment-ratio", NORMAL, {"comment_line_count": 1, "line_count": 100}, "Medium"), ("comment-ratio", NORMAL, {"comment_line_count": 400, "line_count": 1000}, "Low"),
    ("comment-ratio", STRICT, {"comment_line_count": 20, "line_count": 100}, None), ("comment-ratio", RELAXED, {"comment_line_count": 1, "line_count": 200}, "Medium"),
    ("implicit-control", NORMAL, {"decorator_count": 1, "function_count": 2}, None), ("implicit-control", NORMAL, {"decorator_count": 2, "function_count": 2}, "Low"), ("implicit-control", STRICT, {"decorator_count": 2, "function_count": 3}, "Medium"), ("implicit-control", STRICT, {"decorator_count": 3, "function_count": 2}, "High"),
    ("error-swallow", NORMAL, {"empty_catch_count": 2}, None), ("error-swallow", STRICT, {"empty_catch_count": 2}, "Low"), ("error-swallow", NORMAL, {"empty_catch_count": 3}, "Medium"), ("error-swallow", NORMAL, {"empty_catch_count": 5}, "High"),
    ("dangerous-pattern", NORMAL, {"dangerous_pattern_count": 5}, None), ("dangerous-pattern", NORMAL, {"dangerous_pattern_count": 6}, "Medium"), ("dangerous-pattern", NORMAL, {"dangerous_pattern_count": 10}, "High"), ("dangerous-pattern", NORMAL, {"dangerous_pattern_count": 15}, "Critical"),
    ("stringly-typed", NORMAL, {"string_comparison_count": 10}, None), ("stringly-typed", NORMAL, {"string_comparison_count": 11}, "Low"), ("stringly-typed", NORMAL, {"string_comparison_count": 20}, "Medium"), ("stringly-typed", NORMAL, {"string_comparison_count": 30}, "High"),
    ("import-diversity", NORMAL, {"imports": names(10) + ["self::a", "super::b", "./c"]}, None), ("import-diversity", NORMAL, {"imports": names(11)}, "Low"), ("import-diversity", NORMAL, {"imports": names(20)}, "Medium"), ("import-diversity", NORMAL, {"imports": names(30)}, "High"),
    ("naming-entropy", NORMAL, {"identifiers": MIXED[:9]}, None), ("naming-entropy", NORMAL, {"identifiers": [f"a_{k}b" for k in range(15)]}, None), ("naming-entropy", NORMAL, {"identifiers": MIXED}, "Low"),
    ("reexport-entropy", NORMAL, {"exports": exports((4, False))}, None), ("reexport-entropy", NORMAL, {"exports": exports((-1, True), (1, False), (1, False))}, "High"), ("reexport-entropy", NORMAL, {"exports": exports((5, False), (5, False), (5, False))}, "Medium"), ("reexport-entropy", NORMAL, {"exports": exports((-1, True))}, "High"),
    ("unused-import", NORMAL, {"imported_names": ["a"]}, None), ("unused-import", NORMAL, {"imported_names": ["a", "b"]}, "Low"), ("unused-import", NORMAL, {"imported_names": list("abcde")}, "Medium"), ("unused-import", NORMAL, {"imported_names": ["React", "a"]}, None), ("unused-import", NORMAL, {"imported_names": ["a", "a"], "identifiers": ["b"]}, "Low"),
]


@pytest.mark.parametrize("kind,limits,facts,severity", CASES)
def test_row_rules(spark, kind, limits, facts, severity):
    got = found(spark, limits, **facts).get(kind)
    assert (got and got["severity"]) == severity


@pytest.mark.parametrize("fan,severity,pattern,confidence", [((2, 3), None, None, None), ((35, 5), "Medium", "api", 0.65), ((500, 0), "Medium", "api", 0.65), ((0, 50), "High", "orch", 0.70), ((35, 35), "High", "god", 0.85)])
def test_coupling(spark, fan, severity, pattern, confidence):
    got = found(spark, fan=fan).get("coupling-hotspot")
    assert (got and (got["severity"], got["evidence"]["pattern"], got["confidence"])) == (severity and (severity, pattern, confidence))


def test_context_bomb_evidence(spark):
    e = found(spark, line_count=500, size_bytes=40000, function_count=15, class_count=5)["context-bomb"]
    assert e["evidence"]["function_count"] == "15" and e["evidence"]["class_count"] == "5" and "impl_block_count" not in e["evidence"] and e["estimated_tokens"] == 10000 and e["confidence"] == 0.75


def test_null_facts_fire_nothing(spark):
    df = spark.createDataFrame([dict.fromkeys(BASE) | {"path": "p"}], FILE_FACTS)
    assert rules.run_rules(df).count() == 0 and rules.run_rules(df.limit(0)).count() == 0


def test_framework_files_get_more_room(spark):
    df = spark.createDataFrame([BASE | {"decorator_count": 2, "function_count": 3}], FILE_FACTS)
    one = df.select(rules.implicit_control(NORMAL).alias("a"), rules.implicit_control(NORMAL, F.lit(True)).alias("b")).first()
    assert one["a"] is not None and one["b"] is None


def test_unused_names_over_rows(spark):
    names_ = spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "x"), (None, "q"), (1, None)], "k int, name string")
    used = spark.createDataFrame([(1, "b"), (2, "y")], "k int, name string")
    assert {(r["k"], r["unused_count"], r["severity"]) for r in rules.unused_names(names_, used, "k").collect()} == {(1, 2, "Low")}


def test_unused_imports_by_brute_force(spark):
    rnd = random.Random(5)
    word = lambda: rnd.choice(["", "a", "b", "B", "React", "jsx", "é", "zz", None])
    rows = [(k, rnd.choice(["typescript", "python", None]), [word() for _ in range(rnd.randrange(14))], [w for w in (word() for _ in range(rnd.randrange(4))) if w]) for k in range(400)]
    rows += [(400, "python", None, ["a"]), (401, "python", ["a", "b"], None)]
    df = spark.createDataFrame(rows, "k int, language string, imported_names array<string>, identifiers array<string>")
    got = {r["k"]: r for r in df.select("k", rules.unused_import().alias("all"), rules.unused_import(language=F.col("language")).alias("own")).collect()}
    for k, language, names_, used in rows:
        for column, skip in (("all", True), ("own", language == "typescript")):
            left = [x for x in names_ or [] if used is not None and x is not None and x not in used and not (skip and x in rules.COMPILER_NAMES["typescript"])]
            f = got[k][column]
            assert (f and (f["severity"], f["evidence"])) == (("Medium" if len(left) >= 5 else "Low", {"unused_count": str(len(left)), "preview": ", ".join(left[:5])}) if len(left) >= 2 else None), (k, column)


def test_names_are_classified_by_ascii_rules(spark):
    rnd = random.Random(6)
    words = ["".join(rnd.choice("abzAZ_09{[@`é\n") for _ in range(rnd.randrange(7))) for _ in range(3000)]

    def kind(x):
        low, up = bool(re.search("[a-z]", x)), bool(re.search("[A-Z]", x))
        if len(x) < 3:
            return "other"
        if "_" in x and not (low and up):
            return "screaming" if up else "snake"
        return "camel" if re.match("[a-z]", x) and up else "pascal" if re.match("[A-Z]", x) and low else "other"

    got = spark.createDataFrame([(w,) for w in words], "w string").select("w", S.classify_identifier(F.col("w")).alias("c")).collect()
    assert [r["c"] for r in got] == [kind(r["w"]) for r in got] and {r["c"] for r in got} == set(rules.CONVENTIONS)


@pytest.mark.parametrize("query,step,most", [("unused_import", "regexp_extract_all(", 2), ("dominant_convention", "regexp_extract_all(", 1), ("dominant_convention", "RLIKE(", 4), ("naming_entropy", "RLIKE(", 4)])
def test_a_rule_computes_each_fact_once(spark, query, step, most):
    """A filter on a finding would copy its facts to every place, and into lambdas, that names them."""
    plan = catalogue.QUERIES[query](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 1 <= plan.count(step) <= most


def test_dead_weight(spark):
    rows = [("orphan", 200, 0, False, False), ("big", 1200, 0, False, False), ("large", 500, 0, False, False), ("small", 9, 0, False, False), ("entry", 200, 0, True, False), ("init", 200, 0, False, True), ("used", 200, 1, False, False), ("named", 200, 0, False, False), ("vite.config.ts", 200, 0, False, False)]
    facts = spark.createDataFrame([(p, p, n, 400, i, e, k) for p, n, i, e, k in rows], "path string, module_path string, line_count long, size_bytes long, fan_in int, is_entry_point boolean, is_package_init boolean")
    got = {r["path"]: r["severity"] for r in dead.dead_weight(facts, spark.createDataFrame([("named",), (None,)], "module_path string")).collect()}
    assert got == {"orphan": "Medium", "big": "Critical", "large": "High"}


def test_clones(spark):
    long = "x" * 40
    rows = [("a", "f", long), ("a", "g", long), ("b", "f", "y" * 50), ("c", "f", "y" * 50), ("d", "f_for_test", "y" * 50), ("e", "f", "z"), ("f", "f", "z")] + [(f"m{k}", "f", "w" * 60) for k in range(7)]
    groups = clones.clone_groups(spark.createDataFrame(rows, "path string, name string, body string"), F.col("body"))
    got = {r["path"]: (r["severity"], r["evidence"]["file_count"]) for r in clones.clone_findings(groups).collect()}
    assert got == {"b": ("Low", "2"), "m0": ("High", "7")}
    assert max(len(r["paths"]) for r in groups.collect()) == 5


# --- graphs


def resolve(spark, specs, modules, **kw):
    imports = spark.createDataFrame(specs, "package string, src_path string, spec string")
    table = spark.createDataFrame(modules, "package string, module_path string, path string")
    return {(r["src_path"], r["dst"]) for r in graph.resolve_prefix(imports, table, **kw).collect()}


def test_longest_prefix(spark):
    mods = [("p", "crate::api", "api"), ("p", "crate::api::files", "files"), ("q", "crate::other", "other")]
    specs = [("p", "main", "crate::api::files::Thing"), ("p", "main2", "crate::api::Handler"), ("p", "main3", "serde::Deserialize"), ("p", "main4", "crate::other::X")]
    assert resolve(spark, specs, mods, separator="::", scoped=True) == {("main", "files"), ("main2", "api")}
    assert ("main4", "other") in resolve(spark, specs, mods, separator="::")
    assert resolve(spark, [("p", "x", "os.path")], [("p", "os", "os.py")], skip=graph.STDLIB) == set()


def test_rust_specs_become_absolute(spark):
    df = spark.createDataFrame([("super::helpers::B", "crate::api::child"), ("self::inner::F", "crate::utils"), ("crate::a::B", "crate"), ("serde::De", "crate"), ("super::super::x", "crate::a::b::c")], "s string, m string")
    assert [r[0] for r in df.select(graph.absolute_rust(F.col("s"), F.col("m"))).collect()] == ["crate::api::helpers::B", "crate::utils::inner::F", "crate::a::B", "serde::De", "crate::a::x"]


def test_relative_paths(spark):
    files = spark.createDataFrame([("src/a.ts",), ("src/lib/index.ts",), ("src/b.tsx",)], "path string")
    imports = spark.createDataFrame([("src/a.ts", "./lib"), ("src/lib/index.ts", "../b"), ("src/lib/index.ts", "../a.js"), ("src/a.ts", "react"), ("src/a.ts", "./none")], "src_path string, spec string")
    assert {(r["src_path"], r["spec"], r["dst"]) for r in graph.resolve_relative(imports, files).collect()} == {("src/a.ts", "./lib", "src/lib/index.ts"), ("src/lib/index.ts", "../b", "src/b.tsx"), ("src/lib/index.ts", "../a.js", "src/a.ts")}


def test_degrees(spark):
    resolved = spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("c", "b")], "src_path string, dst string")
    nodes = spark.createDataFrame([("a",), ("b",), ("z",)], "path string")
    of = lambda distinct: {tuple(r) for r in graph.degrees(nodes, graph.edges_of(resolved, distinct)).collect()}
    assert of(True) == {("a", 0, 1), ("b", 2, 0), ("z", 0, 0)}
    assert of(False) == {("a", 0, 2), ("b", 3, 0), ("z", 0, 0)}


# --- scores


def findings(spark, *rows):
    return spark.createDataFrame([(p, k, s, 1.0, {}, None) for p, k, s in rows], "path string, kind string, severity string, confidence double, evidence map<string,string>, estimated_tokens long")


def test_scores(spark):
    none = score.global_score(findings(spark), 10, 0).first().asDict()
    assert set(none.values()) == {0, 0.0}
    many = score.global_score(findings(spark, *[(str(k), "context-bomb", "Critical") for k in range(50)]), 3, 128000).first()
    assert many["ai_friction_score"] == 100 and many["context_waste_ratio"] == 1.0 and many["estimated_waste_pct"] == 33 and many["structural_entropy_score"] == 0
    one = lambda s: score.global_score(findings(spark, ("a", "deep-nesting", s)), 10, 0).first()["ai_friction_score"]
    assert one("Critical") > one("High") > one("Medium") > one("Low") > 0


def test_scores_of_many_files(spark):
    for files in (16_777, 16_778, 5_000_000_000):
        for n in (files, F.lit(files)):
            assert score.global_score(findings(spark), n, files * 32_000).first()["estimated_waste_pct"] == 25


def test_ranks_and_tops(spark):
    f = findings(spark, *[(f"p{k}", "deep-nesting", "Low") for k in range(7)], ("z", "deep-nesting", "Critical"), ("a", "context-bomb", "High"))
    assert score.ranked(f).where("path = 'z'").first()["id"] == "dn-001"
    top = score.top_per_kind(f).collect()
    assert len(top) == 6 and {r["more"] for r in top if r["kind"] == "deep-nesting"} == {3}
    assert [r["path"] for r in score.priorities(f).collect()] == ["z", "a"]


def test_ranks_of_a_large_kind_run_on_over_ranges(spark):
    rows = [(f"{k * 7919 % 3000:05d}", "deep-nesting", ("Low", "High", "Medium")[k % 3]) for k in range(3000)]
    rows += [("same", "context-bomb", "Low")] * 5 + [("n", None, "Low"), ("m", None, None)]
    got = score.ranked(findings(spark, *rows)).select("kind", "nth", "severity", "path", "id").collect()
    big = sorted((r["nth"], r["severity"], r["path"]) for r in got if r["kind"] == "deep-nesting")
    order = {"High": 0, "Medium": 1, "Low": 2}
    assert [r[0] for r in big] == list(range(1, 3001)) and [r[1:] for r in big] == sorted((r[1:] for r in big), key=lambda x: (order[x[0]], x[1]))
    assert sorted(r["id"] for r in got if r["kind"] == "context-bomb") == [f"cb-00{k}" for k in range(1, 6)]
    assert sorted(r["id"] for r in got if r["kind"] is None) == ["xx-001", "xx-002"] and len(got) == len(rows)
    assert not score.ranked(findings(spark)).collect()


def test_strict_finds_at_least_as_much(spark):
    df = spark.createDataFrame([BASE | {"path": str(k), "line_count": 90 * k, "branch_count": 5 * k, "max_nesting_depth": k, "dangerous_pattern_count": k} for k in range(14)], FILE_FACTS)
    counts = [rules.run_rules(df, limits).count() for limits in (STRICT, NORMAL, RELAXED)]
    assert counts[0] >= counts[1] >= counts[2] > 0
    diff = score.compare(("strict", rules.run_rules(df, STRICT)), ("relaxed", rules.run_rules(df, RELAXED))).collect()
    assert diff and all(r["strict"] != r["relaxed"] for r in diff)


def test_profiles():
    assert thresholds.profile("normal") is NORMAL and NORMAL.but(line_count=1).line_count == 1
    with pytest.raises(ValueError):
        thresholds.profile("none")
