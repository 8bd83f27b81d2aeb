"""Structural facts of Python source by the standard parser."""

from __future__ import annotations

import ast
import io
import re
import tokenize

BRANCHES = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.IfExp, ast.ExceptHandler, ast.match_case)
NESTS = (ast.If, ast.For, ast.AsyncFor, ast.While, ast.Try, ast.With, ast.AsyncWith, ast.Match, ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef) + ((ast.TryStar,) if hasattr(ast, "TryStar") else ())
RISKY = {"eval", "exec", "compile", "__import__"}
ENTRY_STEMS = {"__init__", "__main__", "conftest", "manage", "app", "cli", "setup"}
FUNCTIONS = (ast.FunctionDef, ast.AsyncFunctionDef)


def module_of(rel_path: str) -> str:
    parts = re.sub(r"\.pyi?$", "", rel_path).split("/")
    if "src" in parts:
        parts = parts[len(parts) - parts[::-1].index("src") :]
    if parts and parts[-1] == "__init__":
        parts = parts[:-1]
    return ".".join(p for p in parts if p)


def _depth(node: ast.AST) -> int:
    """Deepest chain of nesting statements; an elif is no deeper than its if."""
    best, todo = 0, [(node, 0)]
    while todo:
        at, d = todo.pop()
        best = max(best, d)
        for field, value in ast.iter_fields(at):
            for kid in value if isinstance(value, list) else [value]:
                if isinstance(kid, ast.AST):
                    chained = isinstance(at, ast.If) and field == "orelse" and isinstance(kid, ast.If) and len(at.orelse) == 1
                    todo.append((kid, d + (isinstance(kid, NESTS) and not chained)))
    return best


def _type_depth(node: ast.AST | None) -> int:
    if node is None:
        return 0
    if isinstance(node, ast.Constant) and isinstance(node.value, str):
        try:
            return _type_depth(ast.parse(node.value, mode="eval").body)
        except (SyntaxError, ValueError, RecursionError):
            return 0
    own = isinstance(node, ast.Subscript) or isinstance(node, ast.BinOp) and isinstance(node.op, ast.BitOr)
    return own + max((_type_depth(k) for k in ast.iter_child_nodes(node)), default=0)


def _is_text(node: ast.AST) -> bool:
    return isinstance(node, ast.Constant) and isinstance(node.value, str)


def _is_main_guard(node: ast.AST) -> bool:
    return isinstance(node, ast.If) and isinstance(node.test, ast.Compare) and any(isinstance(x, ast.Name) and x.id == "__name__" for x in [node.test.left, *node.test.comparators]) and any(_is_text(x) and x.value == "__main__" for x in [node.test.left, *node.test.comparators])


class _Blank(ast.NodeTransformer):
    def visit_Name(self, node):  # noqa: N802
        return ast.copy_location(ast.Name("_", node.ctx), node)

    def visit_arg(self, node):
        return ast.copy_location(ast.arg("_", None), node)


def comment_lines(text: str) -> int:
    try:
        return sum(t.type == tokenize.COMMENT for t in tokenize.generate_tokens(io.StringIO(text).readline))
    except (tokenize.TokenError, SyntaxError, ValueError):
        return sum(x.lstrip().startswith("#") for x in text.splitlines())


def extract(text: str, rel_path: str) -> dict:
    """Facts of one file, or {"error": why} if it can't be parsed."""
    if "\x00" in text:
        return {"error": "null byte"}
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        return {"error": f"{type(e).__name__}: {e}"[:300]}
    try:
        return _facts(tree, text, rel_path)
    except RecursionError:
        return {"error": "RecursionError"}


def _facts(tree: ast.Module, text: str, rel_path: str) -> dict:
    stem = rel_path.rsplit("/", 1)[-1].removesuffix(".py")
    module, is_init = module_of(rel_path), stem == "__init__"
    out: dict = {"module_path": module, "is_package_init": is_init, "is_entry_point": stem in ENTRY_STEMS or any(map(_is_main_guard, tree.body)), "error": None}
    imports, names, all_export, bodies, decorators, functions, classes = [], [], None, [], 0, 0, 0
    stars = 0
    for node in tree.body:
        if isinstance(node, ast.Import):
            for a in node.names:
                imports.append(a.name)
                names.append(a.asname or a.name.split(".")[0])
        elif isinstance(node, ast.ImportFrom):
            own = module.split(".") if module else []
            up = own[: max(0, len(own) - node.level + is_init)] if node.level else []
            base = ".".join([*up, *((node.module or "").split(".") if node.module else [])])
            for a in node.names:
                if a.name == "*":
                    stars += 1
                    imports.append(base)
                else:
                    imports.append(f"{base}.{a.name}" if base else a.name)
                    names.append(a.asname or a.name)
        elif isinstance(node, FUNCTIONS):
            functions += 1
            decorators += len(node.decorator_list)
            raw = "\n".join(ast.unparse(s) for s in node.body)
            if sum(isinstance(x, ast.stmt) for s in node.body for x in ast.walk(s)) > 1:
                bodies.append({"name": node.name, "raw_body": raw})
        elif isinstance(node, ast.ClassDef):
            classes += 1
            decorators += len(node.decorator_list) + sum(len(x.decorator_list) for x in node.body if isinstance(x, FUNCTIONS))
        elif isinstance(node, (ast.Assign, ast.AnnAssign)):
            targets = node.targets if isinstance(node, ast.Assign) else [node.target]
            if any(isinstance(t, ast.Name) and t.id == "__all__" for t in targets) and isinstance(node.value, (ast.List, ast.Tuple)):
                all_export = [e.value for e in node.value.elts if _is_text(e)]
    used, branches, empties, risky, texts, types = set(), 0, 0, 0, 0, 0
    for node in ast.walk(tree):
        branches += isinstance(node, BRANCHES)
        if isinstance(node, ast.Name):
            used.add(node.id)
        elif isinstance(node, ast.ExceptHandler):
            if node.name:
                used.add(node.name)
            empties += all(isinstance(s, ast.Pass) or isinstance(s, ast.Expr) and isinstance(s.value, ast.Constant) and s.value.value is Ellipsis for s in node.body)
        elif isinstance(node, ast.Call):
            risky += isinstance(node.func, ast.Name) and node.func.id in RISKY
        elif isinstance(node, ast.Compare):
            sides = [node.left, *node.comparators]
            for k, op in enumerate(node.ops):
                if isinstance(op, (ast.Eq, ast.NotEq)):
                    texts += _is_text(sides[k]) + _is_text(sides[k + 1])
        elif isinstance(node, ast.MatchValue):
            texts += _is_text(node.value)
        elif isinstance(node, (ast.MatchAs, ast.MatchStar)) and node.name:
            used.add(node.name)
        notes = [node.returns, *(a.annotation for a in (*node.args.posonlyargs, *node.args.args, *node.args.kwonlyargs, node.args.vararg, node.args.kwarg) if a)] if isinstance(node, FUNCTIONS) else [node.annotation] if isinstance(node, ast.AnnAssign) else []
        for note in notes:
            types = max(types, _type_depth(note))
            if note is not None and _is_text(note):
                used.update(re.findall(r"[A-Za-z_]\w*", note.value))
    for b in bodies:
        b["normalized_body"] = re.sub(r"[\s;]+", "", ast.unparse(_Blank().visit(ast.parse(b["raw_body"]))) if _parses(b["raw_body"]) else b["raw_body"])
    exports = [{"source": x, "item_count": 1, "is_wildcard": False} for x in all_export or ()] if is_init else []
    exports += [{"source": "*", "item_count": -1, "is_wildcard": True}] * (stars if is_init else 0)
    return out | {
        "function_count": functions, "class_count": classes, "impl_block_count": 0, "imports": imports, "imported_names": names, "identifiers": sorted(used), "module_declarations": [], "all_export": all_export,
        "exports": exports, "function_bodies": bodies, "branch_count": branches, "max_nesting_depth": _depth(tree), "max_type_depth": types, "comment_line_count": comment_lines(text),
        "decorator_count": decorators, "empty_catch_count": empties, "dangerous_pattern_count": risky, "string_comparison_count": texts,
    }


def _parses(body: str) -> bool:
    """A body that returns parses on its own; what needs its function does not."""
    try:
        ast.parse(body)
        return True
    except SyntaxError:
        return False
