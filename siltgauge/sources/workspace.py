"""Discovery of workspaces, packages and source roots: small manifests, read on the driver."""

from __future__ import annotations

import configparser
import json
import os
import re
import tomllib
from dataclasses import dataclass, field
from pathlib import Path

EXCLUDED = frozenset(".git .hg .tox .nox .venv venv env __pycache__ node_modules dist build target .mypy_cache .pytest_cache .eggs coverage .next .turbo vendor site-packages".split())
PY_MANIFESTS = ("pyproject.toml", "setup.py", "setup.cfg")
ENTRY_NAMES = ("index.ts", "index.tsx", "index.js", "main.ts", "main.js", "src/index.ts", "src/main.ts", "src/index.js", "src/main.js")


@dataclass(frozen=True)
class Package:
    name: str
    root: str
    manifest: str | None = None
    source_roots: tuple[str, ...] = ()
    entry_points: tuple[str, ...] = ()


@dataclass(frozen=True)
class Workspace:
    root: str
    packages: tuple[Package, ...] = field(default_factory=tuple)
    is_workspace: bool = False


def _json(path: Path) -> dict:
    try:
        out = json.loads(path.read_text(encoding="utf-8"))
        return out if isinstance(out, dict) else {}
    except (OSError, ValueError):
        return {}


def _toml(path: Path) -> dict:
    try:
        return tomllib.loads(path.read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def excluded(name: str) -> bool:
    return name in EXCLUDED or name.endswith(".egg-info")


def _one_level(root: Path, pattern: str) -> list[Path]:
    pattern = pattern.strip().strip("'\"").removeprefix("./").rstrip("/")
    if pattern.startswith("!"):
        return []
    if pattern.endswith(("/*", "/**")):
        base = root / pattern.rsplit("/", 1)[0]
        return sorted(p for p in base.iterdir() if p.is_dir() and not excluded(p.name)) if base.is_dir() else []
    return [root / pattern] if (root / pattern).is_dir() else []


# --- JavaScript and TypeScript -----------------------------------------------------------


def js_roots(package: Path) -> tuple[str, ...]:
    """src, lib, app or the package itself: src alone if it exists, the package only if none does."""
    if (package / "src").is_dir():
        return (str(package / "src"),)
    found = tuple(str(package / n) for n in ("lib", "app") if (package / n).is_dir())
    return found or (str(package),)


def js_entry_points(package: Path, manifest: dict) -> tuple[str, ...]:
    listed = [manifest.get("main")]
    bins = manifest.get("bin")
    listed += list(bins.values()) if isinstance(bins, dict) else [bins]
    names = [n for n in listed if isinstance(n, str)] + [n for n in ENTRY_NAMES if (package / n).is_file()]
    return tuple(dict.fromkeys(os.path.normpath(n) for n in names))


def js_workspace(path: str) -> Workspace:
    root = Path(path)
    manifest = _json(root / "package.json")
    globs = manifest.get("workspaces")
    globs = list(globs.get("packages", [])) if isinstance(globs, dict) else list(globs or [])
    listing = root / "pnpm-workspace.yaml"
    if listing.is_file():
        globs += re.findall(r"^\s*-\s*(.+?)\s*(?:#.*)?$", listing.read_text(encoding="utf-8"), re.M)
    folders = sorted({p for g in globs for p in _one_level(root, g) if (p / "package.json").is_file()})

    def package(p: Path) -> Package:
        m = _json(p / "package.json")
        return Package(str(m.get("name") or p.name), str(p), "package.json" if m else None, js_roots(p), js_entry_points(p, m))

    return Workspace(str(root), tuple(map(package, folders)) if folders else (package(root),), bool(folders))


# --- Python --------------------------------------------------------------------------------


def find_manifest(path: str) -> Path | None:
    """Nearest folder upwards with a manifest; kinds are tried in turn at each level."""
    at = Path(path).resolve()
    for folder in (at, *at.parents):
        for name in PY_MANIFESTS:
            if (folder / name).is_file():
                return folder / name
    return None


def python_roots(manifest: Path) -> tuple[str, ...]:
    base, wheres = manifest.parent, []
    if manifest.name == "pyproject.toml":
        data = _toml(manifest)
        tool = data.get("tool", {})
        setup = tool.get("setuptools", {})
        found = setup.get("packages", {})
        if isinstance(found, dict):
            wheres += found.get("find", {}).get("where", [])
        wheres += [v for v in setup.get("package-dir", {}).values()]
        for p in tool.get("poetry", {}).get("packages", []):
            wheres.append(p.get("from", "."))
        wheres += [os.path.dirname(p) or "." for p in tool.get("hatch", {}).get("build", {}).get("targets", {}).get("wheel", {}).get("packages", [])]
        for name in ("pdm", "flit", "maturin"):
            t = tool.get(name, {})
            where = t.get("package-dir") or t.get("build", {}).get("package-dir") or t.get("python-source")
            wheres += [where] if where else []
    elif manifest.name == "setup.cfg":
        cfg = configparser.ConfigParser()
        try:
            cfg.read(manifest, encoding="utf-8")
        except configparser.Error:
            cfg = configparser.ConfigParser()
        wheres += [cfg.get("options.packages.find", "where", fallback="").strip()]
        wheres += [x.split("=", 1)[1].strip() for x in cfg.get("options", "package_dir", fallback="").splitlines() if "=" in x]
    else:
        try:
            text = manifest.read_text(encoding="utf-8")  # read, never run
        except OSError:
            text = ""
        wheres += re.findall(r"find_(?:namespace_)?packages\([^)]*where\s*=\s*['\"]([^'\"]+)", text)
        wheres += re.findall(r"package_dir\s*=\s*\{\s*['\"]{2}\s*:\s*['\"]([^'\"]+)", text)
    roots = [str((base / w).resolve()) for w in dict.fromkeys(wheres) if isinstance(w, str) and w and (base / w).is_dir()]
    return tuple(roots) or (str(base.resolve()),)


def python_packages(root: str, namespaces: bool = False) -> tuple[Package, ...]:
    """Folders with an __init__.py, dotted by their place; with namespaces also those that hold .py files."""
    out: dict[str, Package] = {}
    top = Path(root)
    for folder, dirs, files in os.walk(top):
        dirs[:] = sorted(d for d in dirs if not excluded(d))
        here = Path(folder)
        if here == top:
            continue
        if "__init__.py" in files or namespaces and any(f.endswith(".py") for f in files):
            name = ".".join(here.relative_to(top).parts)
            out.setdefault(name, Package(name, str(here), None, (str(here),)))
        elif not namespaces:
            dirs[:] = [d for d in dirs if (here / d / "__init__.py").exists()]
    return tuple(out.values())


def python_workspace(path: str, namespaces: bool = False) -> Workspace:
    root = Path(path).resolve()
    manifest = find_manifest(path)
    if manifest is not None and (manifest.parent == root or root in manifest.parent.parents or manifest.parent in root.parents):
        roots = python_roots(manifest)
        found = [p for r in roots for p in python_packages(r, namespaces)]
        if found:
            return Workspace(str(manifest.parent), tuple({p.name: p for p in reversed(found)}.values())[::-1], len(found) > 1)
        return Workspace(str(manifest.parent), (Package(manifest.parent.name, str(manifest.parent), manifest.name, roots),))
    # no manifest: src/<package>, the folder as a package, or loose scripts
    for base in (root / "src", root):
        found = python_packages(str(base), namespaces) if base.is_dir() else ()
        if found:
            return Workspace(str(root), found, len(found) > 1)
    return Workspace(str(root), (Package(root.name, str(root), None, (str(root),)),))


# --- Rust ------------------------------------------------------------------------------------


def cargo_workspace(path: str) -> Workspace:
    """Members of Cargo.toml, one level of globs; nothing is executed."""
    root = Path(path).resolve()
    data = _toml(root / "Cargo.toml")
    members = [p for g in data.get("workspace", {}).get("members", []) for p in _one_level(root, g)]
    folders = ([root] if "package" in data else []) + [m for m in members if (m / "Cargo.toml").is_file()]

    def package(p: Path) -> Package:
        own = _toml(p / "Cargo.toml")
        targets = [own.get("lib", {}).get("path"), *(b.get("path") for b in own.get("bin", []))]
        roots = {str((p / t).parent) for t in targets if t} or {str(p / "src") if (p / "src").is_dir() else str(p)}
        return Package(str(own.get("package", {}).get("name", "unknown")), str(p), "Cargo.toml", tuple(sorted(roots)))

    if not folders:
        return Workspace(str(root), (Package("unknown", str(root), None, (str(root / "src") if (root / "src").is_dir() else str(root),)),))
    return Workspace(str(root), tuple(map(package, folders)), bool(members))
