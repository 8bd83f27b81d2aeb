"""Reports of findings: tab-separated lines as a DataFrame, and JSON, Markdown or plain text of a result.

Findings stay typed columns until here. The TSV is a column expression and is written by the
tasks; the other forms render what the ranked top of each kind holds.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .functions import scalars as S
from .operators import score

VERSION = "1"
SCORES = ("ai_friction_score", "context_waste_score", "structural_entropy_score", "reasoning_complexity_score", "context_waste_ratio", "estimated_waste_pct")

#: kind: (summary, reason, next step); {name} is taken from the evidence.
WORDING: dict[str, tuple[str, str, str]] = {
    "context-bomb": ("{line_count} lines, about {estimated_tokens} tokens", "reading it takes a large share of a context", "split it below {limit} lines"),
    "dead-weight": ("nothing refers to it; {line_count} lines", "it is read in vain", "remove it, or refer to it"),
    "reexport-entropy": ("{reexport_count} re-exports of {total_items} items", "names are far from where they are defined", "import from the defining file"),
    "coupling-hotspot": ("{fan_in} in, {fan_out} out ({pattern})", "a change here reaches many files", "cut what it depends on or offers"),
    "code-duplication": ("one body in {file_count} files", "copies drift apart", "keep one and call it"),
    "unused-import": ("{unused_count} imported names are never used", "they suggest links that do not exist", "remove them: {preview}"),
    "branch-density": ("{avg_branches_per_fn} branches a function", "many paths have to be kept in mind", "split the functions or use tables"),
    "deep-nesting": ("nested {max_depth} deep", "conditions pile up", "return early or move inner blocks out"),
    "type-complexity": ("types nested {max_type_depth} deep", "types are hard to follow", "name the inner types"),
    "comment-ratio": ("{direction} comments, a share of {ratio}", "comments are too few or too many to guide", "explain why, not what"),
    "implicit-control": ("{decorator_count} decorators on {function_count} functions", "control flow is out of sight", "call explicitly"),
    "error-swallow": ("{empty_catch_count} errors are dropped", "failures leave no trace", "handle them or let them pass on"),
    "dangerous-pattern": ("{dangerous_pattern_count} risky constructs", "their behaviour can't be read off", "use safe forms"),
    "naming-entropy": ("{mixed_count} naming conventions", "names can't be guessed", "settle on {dominant_convention}"),
    "stringly-typed": ("{string_comparison_count} comparisons with text", "values are unchecked", "use an enumeration"),
    "import-diversity": ("imports from {domain_count} domains", "it does too many things", "divide it by purpose"),
}


def _worded(template: str) -> Column:
    """A template with its {names} taken from the evidence; missing ones show as a dash."""
    parts: list[Column] = []
    for k, piece in enumerate(template.replace("}", "{").split("{")):
        parts.append(F.coalesce(F.try_element_at("evidence", F.lit(piece)), F.lit("-")) if k % 2 else F.lit(piece))
    return F.concat(*parts)


def enrich(findings: DataFrame) -> DataFrame:
    """findings with summary, reasons and next_step in words, chosen by kind."""
    pick = lambda n: F.coalesce(*[F.when(F.col("kind") == k, _worded(w[n])) for k, w in WORDING.items()], F.lit(""))
    return findings.withColumns({"summary": pick(0), "reasons": F.array(pick(1)), "next_step": pick(2)})


def evidence_lines() -> Column:
    """The evidence map as sorted ``"k: v"`` lines."""
    return F.array_sort(F.transform(F.map_entries("evidence"), lambda e: F.concat(e["key"], F.lit(": "), e["value"])))


def tsv_lines(ranked: DataFrame) -> DataFrame:
    """One line for each finding: id, severity's first letter, kind's code, path, confidence in per cent, tokens."""
    code = F.coalesce(F.try_element_at(S.kind_map(1), F.col("kind")), F.lit("OTHR"))
    tokens = F.coalesce(F.col("estimated_tokens").cast("string"), F.lit(""))
    percent = F.round(F.col("confidence") * 100).cast("int").cast("string")
    return ranked.select(F.concat_ws("\t", "id", F.substring("severity", 1, 1), code, "path", percent, tokens).alias("line"))


@dataclass
class Report:
    """Findings as a DataFrame, and the few numbers that sum them up."""

    findings: DataFrame
    score: dict
    files_analyzed: int = 0
    files_skipped: int = 0
    total_lines: int = 0
    total_estimated_tokens: int = 0
    errors: list[str] = field(default_factory=list)

    def head(self) -> dict:
        return {
            "version": VERSION, "files_analyzed": self.files_analyzed, "files_skipped": self.files_skipped, "total_lines": self.total_lines,
            "total_estimated_tokens": self.total_estimated_tokens, "errors": self.errors, "global_score": self.score,
        }


def _shown(report: Report, per_kind: int | None) -> list:
    found = enrich(score.ranked(report.findings)).withColumn("evidence_lines", evidence_lines())
    if per_kind is not None:
        found = found.where(F.col("nth") <= per_kind)
    return found.orderBy(score.weight().desc(), "kind", "path").collect()


def as_json(report: Report, per_kind: int | None = None) -> str:
    """The whole report; per_kind bounds what a kind may list where findings grow with the corpus."""
    rows = [
        {"id": r["id"], "kind": r["kind"], "severity": r["severity"], "confidence": r["confidence"], "path": r["path"], "summary": r["summary"], "reasons": list(r["reasons"]),
         "evidence": list(r["evidence_lines"]), "suggested_next_step": r["next_step"], "estimated_tokens": r["estimated_tokens"]}
        for r in _shown(report, per_kind)
    ]
    return json.dumps(report.head() | {"findings": rows}, indent=2, ensure_ascii=False)


def _bar(value: int) -> str:
    n = max(0, min(10, round(value / 10)))
    return "█" * n + "░" * (10 - n)


def _counts(report: Report) -> dict[str, int]:
    return {r["kind"]: r["count"] for r in report.findings.groupBy("kind").count().collect()}  # sixteen kinds


def as_text(report: Report, per_kind: int = 5) -> str:
    lines = [f"{report.files_analyzed} files, {report.files_skipped} skipped, {report.total_lines} lines, about {report.total_estimated_tokens} tokens"]
    lines += [f"{k:28}{_bar(report.score[k])} {report.score[k]}" for k in SCORES[:4]]
    counts, rows = _counts(report), _shown(report, per_kind)
    for kind in dict.fromkeys(r["kind"] for r in rows):
        mine = [r for r in rows if r["kind"] == kind]
        lines += ["", f"{kind} ({counts[kind]})"] + [f"  [{r['severity']}] {r['path']}: {r['summary']}" for r in mine]
        if counts[kind] > len(mine):
            lines.append(f"  … {counts[kind] - len(mine)} more")
    first = [r for r in rows if r["severity"] in ("Critical", "High")][:5]
    if first:
        lines += ["", "Begin with"] + [f"  {k}. {r['path']}: {r['next_step']}" for k, r in enumerate(first, 1)]
    return "\n".join(lines) + "\n"


def as_markdown(report: Report, per_kind: int | None = None) -> str:
    """All findings by kind, and all errors; with per_kind, that many of a kind and how many more there are."""
    cell = lambda x: str(x).replace("|", "\\|").replace("\n", " ")
    lines = ["# Corpus report", "", "| measure | value |", "|---|---|"]
    lines += [f"| {k} | {v} |" for k, v in ({k: v for k, v in report.head().items() if isinstance(v, int)} | report.score).items()]
    counts, rows = _counts(report), _shown(report, per_kind)
    for kind in dict.fromkeys(r["kind"] for r in rows):
        mine = [r for r in rows if r["kind"] == kind]
        lines += ["", f"## {kind} ({counts[kind]})", "", "| severity | path | finding | next step |", "|---|---|---|---|"]
        lines += [f"| {r['severity']} | {cell(r['path'])} | {cell(r['summary'])} | {cell(r['next_step'])} |" for r in mine]
        if counts[kind] > len(mine):
            lines += ["", f"… {counts[kind] - len(mine)} more"]
    if report.errors:
        lines += ["", f"## Errors ({len(report.errors)})", ""] + [f"- {cell(e)}" for e in report.errors]
    return "\n".join(lines) + "\n"


#: Names of the numbers in the first line of a TSV report.
TSV_HEAD = {"fric": SCORES[0], "waste": SCORES[1], "ent": SCORES[2], "reas": SCORES[3]}


def as_tsv(report: Report) -> str:
    """A line of numbers, a line of errors if there are any, and all findings with summary and next step."""
    stats = {"ver": VERSION} | {k: report.score[v] for k, v in TSV_HEAD.items()}
    stats |= {"ratio": f"{report.score['context_waste_ratio']:.1f}", "pct": report.score["estimated_waste_pct"], "files": report.files_analyzed, "skip": report.files_skipped, "tok": report.total_estimated_tokens}
    flat = lambda x: str(x).replace("\t", " ").replace("\n", " ")
    lines = [" ".join(f"{k}={v}" for k, v in stats.items())]
    lines += [f"err={flat('; '.join(report.errors))}"] if report.errors else []
    codes = {k: v[1] for k, v in S.KINDS.items()}
    rows = _shown(report, None)
    if rows:
        lines.append("\t".join(("id", "sev", "kind", "path", "tok", "summary", "next")))
    for r in rows:
        tokens = f"{r['estimated_tokens']}tk" if r["estimated_tokens"] else "-"
        lines.append("\t".join(map(flat, (r["id"], r["severity"][:1], codes.get(r["kind"], "OTHR"), r["path"], tokens, r["summary"], r["next_step"]))))
    return "\n".join(lines) + "\n"


FORMATS: dict[str, Callable[[Report], str]] = {"json": as_json, "markdown": as_markdown, "text": as_text, "tsv": as_tsv}


def render(report: Report, form: str) -> str:
    if form not in FORMATS:
        raise ValueError(f"no such format: {form}; there are {', '.join(FORMATS)}")
    return FORMATS[form](report)


def write_tsv(findings: DataFrame, path: str) -> None:
    """Lines written by the tasks, for corpora whose findings no driver should hold."""
    tsv_lines(score.ranked(findings)).write.mode("overwrite").text(path)
