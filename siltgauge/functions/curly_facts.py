"""Structural facts of TypeScript, JavaScript and Rust from a token stream.

There is no parser for these languages here. The tokenizer is exact for comments, strings and
braces; the counters follow tokens and so approximate a syntax tree: type depth counts angle
brackets in annotations, and a body belongs to the nearest function-like head before its brace.
"""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""(?P<line>//[^\n]*)|(?P<block>/\*.*?(?:\*/|\Z))|(?P<raw>r(?P<h>\#*)".*?"(?P=h)|b?"(?:\\.|[^"\\])*")|(?P<tick>`(?:\\.|[^`\\])*`)|(?P<char>'(?:\\.[^']*|[^'\\\n])')|(?P<str>'(?:\\.|[^'\\\n])*')"""
    r"""|(?P<life>'[A-Za-z_]\w*)|(?P<num>\d[\w.]*)|(?P<id>[A-Za-z_$][\w$]*)|(?P<op>=>|->|::|===|!==|==|!=|&&|\|\||\?\.|\?\?|\.\.\.|\.\.|\#!?\[|[{}()\[\];,<>=!?:.@&|*+\-/%^~#])|(?P<space>\s+)|(?P<other>.)""",
    re.S,
)
TEXT = ("raw", "tick", "str", "char")
TS_KEYWORDS = frozenset("if else for while do switch case break continue return try catch finally throw new typeof instanceof in of var let const function class extends super this import export default from as async await yield null undefined true false void delete type interface enum implements public private protected static readonly abstract namespace declare get set".split())
RS_KEYWORDS = frozenset("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split())


def tokens(text: str, rust: bool) -> list[tuple[str, str]]:
    out = []
    for m in TOKEN.finditer(text):
        kind = m.lastgroup if m.lastgroup != "h" else "raw"
        if kind == "h" or kind is None:
            kind = "raw"
        if kind == "space":
            continue
        if rust and kind == "str":
            kind = "life"
        out.append((kind, m[0]))
    return out


def comment_lines(text: str) -> int:
    n = 0
    for m in TOKEN.finditer(text):
        if m["line"]:
            n += 1
        elif m["block"]:
            n += m["block"].count("\n") + 1
    return n


def _close(toks: list[tuple[str, str]], at: int) -> int:
    """Index of the bracket that closes the one at ``at``, or the end."""
    pair = {"{": "}", "(": ")", "[": "]"}
    own, depth = toks[at][1], 0
    for k in range(at, len(toks)):
        if toks[k][1] == own:
            depth += 1
        elif toks[k][1] == pair[own]:
            depth -= 1
            if not depth:
                return k
    return len(toks)


def _angles(toks: list[tuple[str, str]]) -> int:
    """Deepest generic nesting after a colon, an arrow or a name that starts with a capital."""
    depth = best = 0
    for k, (kind, t) in enumerate(toks):
        if t == "<" and k and toks[k - 1][0] == "id" and (toks[k - 1][1][0].isupper() or depth):
            depth += 1
        elif t == "[" and k + 1 < len(toks) and toks[k + 1][1] == "]":
            best = max(best, depth + 1)
        elif t == ">" and depth:
            depth -= 1
        elif t in (";", "{", "}"):
            depth = 0
        best = max(best, depth)
    return best


def _body(toks: list[tuple[str, str]], keywords: frozenset) -> tuple[str, str]:
    raw = "".join(t for _, t in toks)
    return raw, "".join("_" if k == "id" and t not in keywords else t for k, t in toks if t != ";")


def extract(text: str, rel_path: str, rust: bool = False) -> dict:
    """Facts of one file; {"error": why} if its brackets don't match."""
    every = tokens(text, rust)
    toks = [x for x in every if x[0] not in ("line", "block")]
    shape: list[str] = []
    for _, t in toks:
        if t in "{([" and len(t) == 1:
            shape.append(t)
        elif t in ("#[", "#!["):
            shape.append("[")
        elif t in "})]" and len(t) == 1:
            if not shape or {"{": "}", "(": ")", "[": "]"}[shape.pop()] != t:
                return {"error": "brackets don't match"}
    if shape:
        return {"error": "brackets don't match"}
    return (_rust if rust else _script)(toks, text, rel_path)


def _common(toks, text, words, nests, keywords, functions, rust) -> dict:
    branches = sum(k == "id" and t in words for k, t in toks)
    depth, best, stack, pending = 0, 0, [], False
    paren = 0
    for k, t in toks:
        if k == "id" and t in nests:
            pending = True
        elif t == "(":
            paren += 1
        elif t == ")":
            paren -= 1
        elif t == "{":
            stack.append(pending)
            depth += pending
            best = max(best, depth)
            pending = False
        elif t == "}":
            depth -= stack.pop() if stack else 0
        elif t == ";" and not paren:
            pending = False
    texts = 0
    for k, (_, t) in enumerate(toks):
        if t in ("==", "===", "!=", "!=="):
            near = toks[max(0, k - 1) : k] + toks[k + 1 : k + 2]
            texts += any(x[0] in TEXT and not (rust and x[0] == "char") for x in near)
    bodies = []
    for name, begin, end in functions:
        raw, key = _body(toks[begin + 1 : end], keywords)
        if len(re.sub(r"[\s;]+", "", raw)) >= 40:
            bodies.append({"name": name, "raw_body": raw, "normalized_body": re.sub(r"\s+", "", key)})
    return {
        "function_count": len(functions), "branch_count": branches, "max_nesting_depth": best, "max_type_depth": _angles(toks), "string_comparison_count": texts,
        "comment_line_count": comment_lines(text), "function_bodies": bodies, "all_export": None, "error": None,
    }


def _script(toks, text, rel_path) -> dict:
    name = rel_path.rsplit("/", 1)[-1]
    imports, names, exports, used, functions = [], [], [], set(), []
    decorators = empties = risky = classes = 0
    k, n = 0, len(toks)
    value = lambda t: t[1][1:-1]
    while k < n:
        kind, t = toks[k]
        nxt = toks[k + 1][1] if k + 1 < n else ""
        if kind == "id" and t == "import" and nxt not in ("(", "."):
            j = k + 1
            while j < n and toks[j][0] not in TEXT and toks[j][1] != ";":
                j += 1
            if j < n and toks[j][0] in TEXT:
                imports.append(value(toks[j]))
                part = [x for x in toks[k + 1 : j] if x[1] not in ("from", "type", "{", "}", ",", "*")]
                for i, x in enumerate(part):
                    if x[0] == "id" and x[1] != "as" and not (i + 1 < len(part) and part[i + 1][1] == "as"):
                        names.append(x[1])
            k = j + 1
            continue
        if kind == "id" and t == "export" and nxt in ("{", "*", "type"):
            j = k + 1 + (nxt == "type" and toks[k + 2][1] == "{" if k + 2 < n else 0)
            if toks[j][1] == "*":
                while j < n and toks[j][0] not in TEXT and toks[j][1] != ";":
                    j += 1
                if j < n and toks[j][0] in TEXT:
                    exports.append({"source": value(toks[j]), "item_count": -1, "is_wildcard": True})
                k = j + 1
                continue
            if toks[j][1] == "{":
                end = _close(toks, j)
                items = sum(x[1] == "," for x in toks[j:end]) + (toks[end - 1][1] not in ("{", ","))
                if end + 2 < n and toks[end + 1][1] == "from" and toks[end + 2][0] in TEXT:
                    exports.append({"source": value(toks[end + 2]), "item_count": items, "is_wildcard": False})
                    end += 2
                else:
                    exports.append({"source": "<local>", "item_count": items, "is_wildcard": False})
                    used.update(x[1] for x in toks[j:end] if x[0] == "id")
                k = end + 1
                continue
        if kind == "id":
            if t == "function":
                j = k + 1
                label = toks[j][1] if j < n and toks[j][0] == "id" else "anonymous"
                while j < n and toks[j][1] != "(":
                    j += 1
                j = _close(toks, j) if j < n else n
                while j < n and toks[j][1] not in ("{", ";"):
                    j += 1
                if j < n and toks[j][1] == "{":
                    functions.append((label, j, _close(toks, j)))
            elif t == "class":
                classes += 1
            elif t == "catch":
                j = k + 1
                if j < n and toks[j][1] == "(":
                    j = _close(toks, j) + 1
                empties += j + 1 < n and toks[j][1] == "{" and toks[j + 1][1] == "}"
            elif t == "eval" and nxt == "(" or t == "any" and k and toks[k - 1][1] in (":", "<", "as", "|", ","):
                risky += 1
            elif t == "Function" and k and toks[k - 1][1] == "new":
                risky += 1
            if t not in TS_KEYWORDS:
                used.add(t)
        elif t == "=>":
            label, back = None, k
            while back > 0 and toks[back][1] not in ("=", ";", "{", "}"):
                back -= 1
            if back > 0 and toks[back][1] == "=" and toks[back - 1][0] == "id":
                label = toks[back - 1][1]
            j = k + 1
            if j < n and toks[j][1] == "{":
                functions.append((label or "anonymous", j, _close(toks, j)))
            else:
                functions.append((label or "anonymous", k, k))
        elif t == "@" and k + 1 < n and toks[k + 1][0] == "id":
            decorators += 1
        k += 1
    # an if with else counts once more, ternaries count, optional members do not
    extra = sum(t == "else" for _, t in toks) + sum(t == "?" and k + 1 < n and toks[k + 1][1] not in (":", ")", ",", "=", ";", "}") for k, (_, t) in enumerate(toks))
    out = _common(toks, text, {"if", "for", "while", "case", "do"}, {"if", "else", "for", "while", "switch", "try", "do"}, TS_KEYWORDS, functions, False)
    path = [p for p in re.sub(r"\.[cm]?[jt]sx?$", "", re.sub(r"^(.*/)?src/", "", rel_path)).split("/") if p]
    return out | {
        "module_path": "::".join(path[:-1] if path and path[-1] == "index" else path), "is_entry_point": bool(re.match(r"index\.|main\.[cm]?[jt]sx?$", name)), "is_package_init": name.startswith("index."),
        "branch_count": out["branch_count"] + extra, "class_count": classes, "impl_block_count": 0, "imports": imports, "imported_names": names, "identifiers": sorted(used), "module_declarations": [],
        "exports": exports, "decorator_count": decorators, "empty_catch_count": empties, "dangerous_pattern_count": risky,
    }


def rust_module(rel_path: str) -> str:
    inner = re.sub(r"\.rs$", "", re.sub(r"^(.*/)?src/", "", rel_path)).split("/")
    if inner and inner[-1] in ("mod", "lib", "main"):
        inner = inner[:-1]
    return "::".join(["crate", *[p for p in inner if p]])


def _use_tree(toks, k, prefix: list[str]) -> tuple[list[tuple[str, str, bool]], int]:
    """(path, leaf, wildcard) of a use tree, and the index after it."""
    out, path = [], list(prefix)
    while k < len(toks):
        kind, t = toks[k]
        if t == "{":
            k += 1
            while k < len(toks) and toks[k][1] != "}":
                more, k = _use_tree(toks, k, path)
                out += more
                if k < len(toks) and toks[k][1] == ",":
                    k += 1
            return out, k + 1
        if t == "*":
            return [("::".join(path), "*", True)], k + 1
        if kind == "id" and t != "as":
            path.append(t)
            if k + 1 < len(toks) and toks[k + 1][1] == "as":
                return [("::".join(path), toks[k + 2][1], False)], k + 3
            if k + 1 >= len(toks) or toks[k + 1][1] != "::":
                leaf = path[-2] if path[-1] == "self" and len(path) > 1 else path[-1]
                return [("::".join(path), leaf, False)], k + 1
        k += 1
    return out, k


def _rust(toks, text, rel_path) -> dict:
    module = rust_module(rel_path)
    stem = rel_path.rsplit("/", 1)[-1].removesuffix(".rs")
    test = bool(re.search(r"(^|/)tests?/|_test\.rs$|(^|/)tests\.rs$", rel_path))
    imports, names, exports, used, functions, mods = [], [], [], set(), [], []
    decorators = empties = risky = classes = impls = 0
    k, n = 0, len(toks)
    while k < n:
        kind, t = toks[k]
        if t == "use" and kind == "id":
            public = k > 0 and (toks[k - 1][1] == "pub" or toks[k - 1][1] == ")")
            found, k = _use_tree(toks, k + 1, [])
            if public:
                count = len([f for f in found if not f[2]])
                wild = any(f[2] for f in found)
                exports.append({"source": found[0][0] if found else "", "item_count": count, "is_wildcard": wild})
            imports += [f[0] for f in found]
            if not public:
                names += [f[1] for f in found if not f[2] and f[1] != "_"]
            continue
        if kind == "id":
            if t == "fn" and k + 1 < n and toks[k + 1][0] == "id":
                j = k + 2
                while j < n and toks[j][1] not in ("{", ";"):
                    j += 1
                if j < n and toks[j][1] == "{":
                    functions.append((toks[k + 1][1], j, _close(toks, j)))
                else:
                    functions.append((toks[k + 1][1], k, k))
            elif t == "impl" and (k == 0 or toks[k - 1][1] in ("}", ";", "]", "{", "unsafe")):
                impls += 1
            elif t in ("struct", "enum", "trait") and k + 1 < n and toks[k + 1][0] == "id":
                classes += 1
            elif t == "mod" and k + 2 < n and toks[k + 2][1] == ";":
                mods.append(f"{module}::{toks[k + 1][1]}")
            elif t == "unsafe" and k + 1 < n and toks[k + 1][1] == "{" or t == "transmute":
                risky += 1
            elif t in ("unwrap", "expect") and k and toks[k - 1][1] == "." and not test:
                risky += 1
            elif t == "Err" and [x[1] for x in toks[k + 1 : k + 4]] == ["(", "_", ")"]:
                j = k + 4
                if j < n and toks[j][1] == "=>":
                    j += 1
                    empties += j + 1 < n and toks[j][1] in "{(" and toks[j + 1][1] in "})"
                elif j < n and toks[j][1] == "=":
                    while j < n and toks[j][1] not in ("{", ";"):
                        j += 1
                    empties += j + 1 < n and toks[j + 1][1] == "}"
            elif t == "ok" and k and toks[k - 1][1] == "." and k + 1 < n and toks[k + 1][1] == "(":
                empties += 1
            if t not in RS_KEYWORDS:
                used.add(t)
        elif t == "#[":
            decorators += 1
        k += 1
    out = _common(toks, text, {"if", "for", "while", "loop"}, {"if", "else", "for", "while", "loop", "match", "fn", "impl", "unsafe"}, RS_KEYWORDS, functions, True)
    if test:
        risky = round(risky * 0.5)
    return out | {
        "module_path": module, "is_entry_point": stem in ("lib", "main", "mod", "build"), "is_package_init": stem == "mod", "branch_count": out["branch_count"] + sum(t == "=>" for _, t in toks), "class_count": classes,
        "impl_block_count": impls, "imports": imports, "imported_names": names, "identifiers": sorted(used), "module_declarations": mods, "exports": exports, "decorator_count": decorators,
        "empty_catch_count": empties, "dangerous_pattern_count": risky,
    }
