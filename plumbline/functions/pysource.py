"""Python source read on its syntax tree: functions, chunks, documentation tree, code graph."""

from __future__ import annotations

import ast
import hashlib
from collections.abc import Iterator

#: Methods that change a list, a dict or a set.
CHANGING = {"sort", "append", "extend", "insert", "remove", "pop", "clear", "reverse", "update", "setdefault", "popitem", "add", "discard"}
_DEF = (ast.FunctionDef, ast.AsyncFunctionDef)


def parsed(source: str) -> ast.Module | None:
    """The tree, or None where the text does not parse."""
    try:
        return ast.parse(source)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def _text(node: ast.AST | None) -> str | None:
    return ast.unparse(node) if node is not None else None


def parameters(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    """(name, annotation, default) in order: defaults belong to the last positional ones; *a and **k keep their stars."""
    a = node.args
    plain = [*a.posonlyargs, *a.args]
    padded = [None] * (len(plain) - len(a.defaults)) + list(a.defaults)
    rows = [("", p, d) for p, d in zip(plain, padded)]
    rows += [("*", a.vararg, None)] * bool(a.vararg) + [("", p, d) for p, d in zip(a.kwonlyargs, a.kw_defaults)] + [("**", a.kwarg, None)] * bool(a.kwarg)
    return [{"name": star + p.arg, "annotation": _text(p.annotation), "default": _text(d)} for star, p, d in rows]


def signature(node: ast.FunctionDef | ast.AsyncFunctionDef, keyword: bool = True) -> str:
    """'def f(a, b=1) -> T'; without the keyword the form of the documentation tree."""
    made = f"{node.name}({ast.unparse(node.args)})" + (f" -> {_text(node.returns)}" if node.returns else "")
    return ("async def " if isinstance(node, ast.AsyncFunctionDef) else "def ") + made if keyword else made


def _walk_guarded(node: ast.AST, guard: ast.expr | None = None) -> Iterator[tuple[ast.AST, ast.expr | None]]:
    """Every node below, with the test of the innermost `if` around it."""
    for child in ast.iter_child_nodes(node):
        yield child, guard
        yield from _walk_guarded(child, child.test if isinstance(child, ast.If) else guard)


def raises(node: ast.AST) -> list[dict]:
    """(exception_class, condition, lineno) of each raise, in order of lines. An error named by an attribute that is not
    called, and a bare raise, are 'Exception'; an else branch carries the test of its if."""
    out = []
    for n, guard in _walk_guarded(node):
        if isinstance(n, ast.Raise):
            e, name = n.exc, "Exception"
            if isinstance(e, ast.Name):
                name = e.id
            elif isinstance(e, ast.Call):
                name = e.func.id if isinstance(e.func, ast.Name) else e.func.attr if isinstance(e.func, ast.Attribute) else name
            out.append({"exception_class": name, "condition": _text(guard), "lineno": n.lineno})
    return sorted(out, key=lambda r: r["lineno"])


def mutations(node: ast.FunctionDef | ast.AsyncFunctionDef) -> list[dict]:
    """(target, method, line) of each change to a parameter, in order of lines; positional-only ones are not looked at."""
    a = node.args
    own = {p.arg for p in [*a.args, *a.kwonlyargs, *filter(None, (a.vararg, a.kwarg))]}
    out = []

    def hit(target: ast.expr, method: str, line: int) -> None:
        if isinstance(target, ast.Name) and target.id in own:
            out.append({"target": target.id, "method": method, "line": line})

    for n in ast.walk(node):
        if isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr in CHANGING:
            hit(n.func.value, n.func.attr, n.lineno)
        elif isinstance(n, ast.Assign):
            for t in n.targets:
                if isinstance(t, ast.Subscript):
                    hit(t.value, "slice_assignment" if isinstance(t.slice, ast.Slice) else "item_assignment", n.lineno)
                elif isinstance(t, ast.Attribute):
                    hit(t.value, "attribute_assignment", n.lineno)
        elif isinstance(n, ast.AugAssign):
            hit(n.target, "augmented_assignment", n.lineno)
    return sorted(out, key=lambda m: m["line"])


def functions(source: str, module: str = "") -> list[dict]:
    """The top-level functions as records of the model (columns of function_records without ids)."""
    tree = parsed(source)
    lines = source.splitlines()
    return [
        {
            "name": n.name, "qualified_name": f"{module}.{n.name}" if module else n.name, "source": "\n".join(lines[n.lineno - 1 : n.end_lineno]), "lineno": n.lineno, "end_line": n.end_lineno, "signature": signature(n), "docstring": ast.get_docstring(n),
            "params": parameters(n), "return_annotation": _text(n.returns), "raise_statements": raises(n), "mutation_patterns": mutations(n),
        }
        for n in (ast.iter_child_nodes(tree) if tree else ())
        if isinstance(n, _DEF)
    ]


def count_functions(source: str) -> int:
    """Functions at any depth; 1 for a text that does not parse."""
    tree = parsed(source)
    return sum(isinstance(n, _DEF) for n in ast.walk(tree)) if tree else 1


def docstring_line(node: ast.AST) -> int:
    """The line on which the documentation's string begins, the node's own if there is none."""
    body = getattr(node, "body", [])
    first = body[0] if body else None
    return first.lineno if isinstance(first, ast.Expr) and isinstance(first.value, ast.Constant) and isinstance(first.value.value, str) else node.lineno


def chunks(source: str, path: str) -> list[dict]:
    """One retrieval chunk per function at any depth; an empty list where there is none (see ingest.line_blocks)."""
    tree, lines = parsed(source), source.splitlines()
    out = []
    for n in ast.walk(tree) if tree else ():
        if isinstance(n, _DEF):
            key = hashlib.md5(f"{path}:{n.lineno}:{n.name}".encode()).hexdigest()[:12]
            out.append({"chunk_id": key, "start_line": n.lineno, "end_line": n.end_lineno, "function_name": n.name, "docstring": ast.get_docstring(n), "content": "\n".join(lines[n.lineno - 1 : n.end_lineno])})
    return out


def documentation_tree(source: str) -> list[dict]:
    """(node, parent, kind, name, signature, docstring, lineno): module functions and classes with their methods. The
    node's id is made of kind, qualified name and line, so it is the same on every run."""
    tree = parsed(source)
    out: list[dict] = []

    def put(n: ast.AST, kind: str, parent: str | None, prefix: str) -> str:
        node = f"{kind}:{prefix}{n.name}:{n.lineno}"
        out.append({"node": node, "parent": parent, "kind": kind, "name": n.name, "signature": signature(n, keyword=False) if isinstance(n, _DEF) else None, "docstring": ast.get_docstring(n), "lineno": n.lineno})
        return node

    for n in ast.iter_child_nodes(tree) if tree else ():
        if isinstance(n, _DEF):
            put(n, "function", None, "")
        elif isinstance(n, ast.ClassDef):
            parent = put(n, "class", None, "")
            for m in n.body:
                if isinstance(m, _DEF):
                    put(m, "method", parent, n.name + ".")
    return out


def graph(source: str, language: str) -> tuple[list[dict], list[dict]]:
    """(nodes, edges). nodes: node, type, name, lineno; edges: source, target, type. A language other than Python has one
    module node; a text that does not parse has none. Calls lead from the first function or method of the caller's name
    to the last one that bears the called name; inheritance only to classes further up."""
    if language != "python":
        return [{"node": "module", "type": "module", "name": "source", "lineno": 1}], []
    tree = parsed(source)
    if tree is None:
        return [], []
    nodes = [{"node": "module", "type": "module", "name": "module", "lineno": 1}]
    edges: dict[tuple[str, str, str], None] = {}
    by_name: dict[str, str] = {}
    first: dict[str, str] = {}

    def add(kind: str, name: str, line: int, prefix: str = "") -> str:
        node = f"{kind}:{prefix}{name}:{line}"
        nodes.append({"node": node, "type": kind, "name": name, "lineno": line})
        if kind in ("function", "method"):
            first.setdefault(name, node)
        return node

    top = list(ast.iter_child_nodes(tree))
    imported = {a.name for n in top if isinstance(n, ast.Import) for a in n.names} | {n.module for n in top if isinstance(n, ast.ImportFrom) and n.module}
    for name in sorted(imported):
        edges["module", add("import", name, 0), "imports"] = None
    for n in top:
        if isinstance(n, ast.ClassDef):
            own = by_name[n.name] = add("class", n.name, n.lineno)
            edges["module", own, "contains"] = None
            for b in n.bases:
                if isinstance(b, ast.Name) and b.id in by_name:
                    edges[own, by_name[b.id], "inherits"] = None
            for m in n.body:
                if isinstance(m, _DEF):
                    by_name[f"{n.name}.{m.name}"] = by_name[m.name] = method = add("method", m.name, m.lineno, n.name + ".")
                    edges[own, method, "has_method"] = None
        elif isinstance(n, _DEF):
            by_name[n.name] = add("function", n.name, n.lineno)
            edges["module", by_name[n.name], "contains"] = None
    for n in ast.walk(tree):
        if isinstance(n, _DEF) and n.name in first:
            for call in ast.walk(n):
                if isinstance(call, ast.Call):
                    called = call.func.id if isinstance(call.func, ast.Name) else call.func.attr if isinstance(call.func, ast.Attribute) else None
                    if called in by_name and by_name[called] != first[n.name]:
                        edges[first[n.name], by_name[called], "calls"] = None
    return nodes, [{"source": s, "target": t, "type": k} for s, t, k in edges]
