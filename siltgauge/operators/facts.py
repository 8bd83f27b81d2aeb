"""Facts of source files as a table function over batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame

from ..functions import curly_facts, python_facts
from ..schema import FACT_TYPES, FILE_FACTS


class LanguagePlugin(Protocol):
    """The extension point: a language names itself and turns one text into facts or an error."""

    name: str

    def extract(self, text: str, rel_path: str) -> dict: ...


EXTRACTORS: dict[str, Callable[[str, str], dict]] = {
    "python": python_facts.extract,
    "typescript": curly_facts.extract,
    "rust": lambda text, path: curly_facts.extract(text, path, rust=True),
}

_LISTS = ("imports", "imported_names", "identifiers", "module_declarations", "exports", "function_bodies")
_COUNTS = [f for f in FACT_TYPES if f.endswith(("_count", "_depth"))]


def file_facts(files: DataFrame, plugins: tuple[LanguagePlugin, ...] = ()) -> DataFrame:
    """One row of facts per file; error says why a file has none, and the other rows go on.

    Texts are parsed in the workers, batch by batch; only facts leave them.
    """
    known = dict(EXTRACTORS) | {p.name: p.extract for p in plugins}
    names = list(FACT_TYPES)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for r in pdf.itertuples(index=False):
                base = {"path": r.path, "rel_path": r.rel_path, "language": r.language, "package": r.package, "line_count": r.line_count, "size_bytes": r.size_bytes}
                try:
                    got = known[r.language](r.text or "", r.rel_path) if r.language in known else {"error": f"no plug-in for {r.language}"}
                except Exception as e:  # noqa: BLE001  one file never ends a run
                    got = {"error": f"{type(e).__name__}: {e}"[:300]}
                row = dict.fromkeys(names) | {k: [] for k in _LISTS} | dict.fromkeys([c for c in _COUNTS if c not in base], 0) | {"is_entry_point": False, "is_package_init": False} | base | got
                out.append(row)
            if out:
                yield pd.DataFrame(out, columns=names)

    cols = ["path", "rel_path", "language", "package", "line_count", "size_bytes", "text"]
    return files.select(*cols).mapInPandas(run, FILE_FACTS)
