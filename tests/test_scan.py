"""Whole scans of small source trees in three languages, the sinks, the stream, and the driver contract."""

import json

import pytest

import __spark_entry__
from siltgauge import cli, reports
from siltgauge.functions import curly_facts, python_facts
from siltgauge.operators import rules
from siltgauge.plans.scan import Options, explain, scan
from siltgauge.schema import FILE_FACTS
from siltgauge.sources import workspace
from siltgauge.streaming.incremental import stream_rules

BODY = "    total = 0\n    for value in values:\n        if value > 3:\n            total = total + value * 2\n    return total\n"


@pytest.fixture
def tree(tmp_path):
    src = tmp_path / "src"
    (src / "pkg").mkdir(parents=True)
    (tmp_path / "pyproject.toml").write_text('[project]\nname = "demo"\n[tool.setuptools.packages.find]\nwhere = ["src"]\n')
    (src / "pkg" / "__init__.py").write_text("from pkg import used\n")
    (src / "pkg" / "big.py").write_text("x = 1\n" * 600)
    (src / "pkg" / "used.py").write_text("import os\nimport json\n" + f"def one(values):\n{BODY}" + "# end\n" * 6)
    (src / "pkg" / "twin.py").write_text(f"def two(values):\n{BODY}" + "# end\n" * 6)
    (src / "pkg" / "orphan.py").write_text("value = 1\n" * 14)
    (src / "pkg" / "broken.py").write_text("def (:\n")
    (src / "pkg" / "test_used.py").write_text("import pkg\n" * 700)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules" / "x.py").write_text("y = 2\n" * 900)
    return tmp_path


def test_python_tree(spark, tree):
    report = scan(spark, str(tree))
    kinds = {(r["kind"], r["path"]) for r in report.findings.collect()}
    assert ("context-bomb", "src/pkg/big.py") in kinds and ("dead-weight", "src/pkg/orphan.py") in kinds and ("unused-import", "src/pkg/used.py") in kinds
    assert ("code-duplication", "src/pkg/twin.py") in kinds or ("code-duplication", "src/pkg/used.py") in kinds
    assert not any("node_modules" in p or "test_used" in p for _, p in kinds) and ("dead-weight", "src/pkg/used.py") not in kinds
    assert report.files_skipped == 1 and "broken.py" in report.errors[0]
    wide = scan(spark, str(tree), Options(include_tests=True)).findings
    assert ("context-bomb", "src/pkg/test_used.py") in {(r["kind"], r["path"]) for r in wide.collect()}
    strict, relaxed = (scan(spark, str(tree), Options(profile=p)).findings.count() for p in ("strict", "relaxed"))
    assert strict >= relaxed
    one = explain(spark, str(tree), "src/pkg/used.py")
    assert one["fan_in"] == 1 and one["function_count"] == 1
    assert explain(spark, str(tree), "none.py") is None


def test_every_format(spark, tree, capsys):
    report = scan(spark, str(tree))
    data = json.loads(reports.render(report, "json"))
    assert {"findings", "global_score", "files_analyzed", "files_skipped", "total_lines", "total_estimated_tokens", "errors", "version"} <= set(data) and len(data["global_score"]) == 6
    assert {"id", "kind", "severity", "confidence", "path", "summary", "reasons", "evidence", "suggested_next_step", "estimated_tokens"} == set(data["findings"][0])
    for form in reports.FORMATS:
        assert "big.py" in reports.render(report, form)
    assert cli.main(["scan", str(tree), "--format", "tsv"], spark) == 0 and "OVS" in capsys.readouterr().out
    assert cli.main(["explain", str(tree), "src/pkg/big.py"], spark) == 0 and cli.main(["explain", str(tree), "no.py"], spark) == 1
    with pytest.raises(ValueError):
        reports.render(report, "none")


def test_empty_tree(spark, tmp_path):
    report = scan(spark, str(tmp_path))
    assert report.files_analyzed == 0 and report.score["ai_friction_score"] == 0 and json.loads(reports.as_json(report))["findings"] == []


def test_script_and_rust_trees(spark, tmp_path):
    (tmp_path / "package.json").write_text('{"name": "demo", "workspaces": []}')
    (tmp_path / "Cargo.toml").write_text('[package]\nname = "krate"\n')
    src = tmp_path / "src"
    src.mkdir()
    (src / "index.ts").write_text("export * from './a';\nexport { b } from './b';\n")
    (src / "a.ts").write_text("import { b } from './b';\nexport const a = (x: number) => { if (x > 1) { return b(x); } return 0; };\n" + "// line\n" * 12)
    (src / "b.ts").write_text("export function b(x: number) { try { return x; } catch (e) {} }\n")
    (src / "lib.rs").write_text("mod util;\npub use crate::util::*;\nfn main() { let x = util::f(); }\n")
    (src / "util.rs").write_text("use crate::lost::Thing;\npub fn f() -> Vec<Option<u8>> { if true { vec![] } else { vec![None] } }\n" + "// line\n" * 12)
    report = scan(spark, str(tmp_path))
    kinds = {(r["kind"], r["path"]) for r in report.findings.collect()}
    assert ("reexport-entropy", "src/index.ts") in kinds and ("reexport-entropy", "src/lib.rs") in kinds
    assert not {("dead-weight", "src/util.rs"), ("dead-weight", "src/a.ts")} & kinds
    assert explain(spark, str(tmp_path), "src/b.ts")["fan_in"] == 2
    assert scan(spark, str(tmp_path), Options(languages=("rust",))).files_analyzed == 2


def test_python_counters():
    f = python_facts.extract(
        "import a.b as c\nfrom . import d\n__all__ = ['x', 'y']\n@deco\ndef f(x: dict[str, list[int]]):\n    if x == 'a':\n        for y in x:\n            eval(y)\n    try:\n        pass\n    except ValueError:\n        pass\nif __name__ == '__main__':\n    f(1)\n# note\n",
        "src/pkg/mod.py",
    )
    assert (f["function_count"], f["branch_count"], f["max_nesting_depth"], f["max_type_depth"]) == (1, 4, 3, 2)
    assert (f["decorator_count"], f["empty_catch_count"], f["dangerous_pattern_count"], f["string_comparison_count"], f["comment_line_count"]) == (1, 1, 1, 2, 1)
    assert f["module_path"] == "pkg.mod" and f["is_entry_point"] and f["imports"] == ["a.b", "pkg.d"] and f["imported_names"] == ["c", "d"] and f["all_export"] == ["x", "y"]
    assert "error" in python_facts.extract("def", "x.py") and python_facts.extract("\0", "x.py")["error"] == "null byte"


def test_curly_counters():
    t = curly_facts.extract("import X, { y as z } from 'm';\nfunction f(a: any) { if (a === 'q') { eval(a); } else { } }\ntry { f(1); } catch (e) { }\n", "src/a/index.ts")
    assert t["imports"] == ["m"] and t["imported_names"] == ["X", "z"] and t["function_count"] == 1 and t["branch_count"] == 2 and t["empty_catch_count"] == 1 and t["string_comparison_count"] == 1 and t["dangerous_pattern_count"] == 2
    r = curly_facts.extract("use a::{b, c as d, e::*};\npub use f::G;\nimpl T { fn m(&self) { unsafe { x.unwrap(); } } }\nmod inner;\n", "src/x.rs", rust=True)
    assert r["imported_names"] == ["b", "d"] and r["exports"][0]["item_count"] == 1 and r["impl_block_count"] == 1 and r["dangerous_pattern_count"] == 2 and r["module_declarations"] == ["crate::x::inner"]
    assert curly_facts.extract("function f( {", "a.ts")["error"]


def test_workspaces(tmp_path):
    (tmp_path / "package.json").write_text('{"name": "root", "workspaces": ["packages/*"]}')
    for n in ("one", "two"):
        (tmp_path / "packages" / n / "src").mkdir(parents=True)
        (tmp_path / "packages" / n / "package.json").write_text(json.dumps({"name": f"@x/{n}", "main": "./main.js", "bin": {"a": "cli.js"}}))
    w = workspace.js_workspace(str(tmp_path))
    assert w.is_workspace and [p.name for p in w.packages] == ["@x/one", "@x/two"] and w.packages[0].source_roots[0].endswith("one/src") and "cli.js" in w.packages[0].entry_points
    (tmp_path / "Cargo.toml").write_text('[workspace]\nmembers = ["crates/*"]\n')
    (tmp_path / "crates" / "k" / "src").mkdir(parents=True)
    (tmp_path / "crates" / "k" / "Cargo.toml").write_text('[package]\nname = "k"\n')
    assert [p.name for p in workspace.cargo_workspace(str(tmp_path)).packages] == ["k"]


def test_stream_finds_what_batch_finds(spark, tmp_path):
    row = (("a", 700), ("b", 10))
    df = spark.createDataFrame([(p, n, 4 * n, 1, 0, 0) for p, n in row], "path string, line_count long, size_bytes long, function_count int, class_count int, impl_block_count int")
    df.write.parquet(str(tmp_path / "in"))
    facts = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    stream_rules(facts, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == rules.run_rules(df).count() == 1


def test_contract(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert spark.createDataFrame([], FILE_FACTS).count() == 0
