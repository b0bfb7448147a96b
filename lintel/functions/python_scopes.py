"""Facts about Python classes that moving a method needs: methods, what they use of their parameters, calls and types, as rows."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame

from lintel.functions.copies import framed, remembered
from lintel.functions.python_code import FUNCTIONS, last_name
from lintel.session import prepare

COLUMNS = "kind string, owner string, method string, name string, type string, uses int, flag boolean, line int, end_line int, argument string, keywords map<string,string>"
NESTED = (*FUNCTIONS, ast.Lambda, ast.ClassDef)


def named_type(annotation: ast.AST | None) -> str | None:
    """The class that an annotation names, quoted or not."""
    if isinstance(annotation, ast.Constant):
        return annotation.value.strip("'\"") if isinstance(annotation.value, str) else None
    return last_name(annotation) if isinstance(annotation, (ast.Name, ast.Attribute)) else None


def value_of(node: ast.AST | None) -> str | None:
    """`new K` for a call of K, `var x` for a name, else `other`."""
    match node:
        case None:
            return None
        case ast.Call(func=ast.Name(id=name)) | ast.Call(func=ast.Attribute(attr=name)):
            return f"new {name}"
        case ast.Name(id=name):
            return f"var {name}"
    return "other"


def movable(m) -> bool:
    a = m.args
    return isinstance(m, ast.FunctionDef) and m.name != "__init__" and not (m.decorator_list or a.posonlyargs or a.vararg) and len(a.args) > 1 and a.args[0].arg == "self"


def method_rows(owner: str, m) -> Iterator[tuple]:
    """The method (uses: of self; type `nested` if it holds a scope of its own) and its parameters (uses: attributes; flag: a value is assigned to it)."""
    params = {a.arg: a.annotation for a in m.args.args[1:]}
    uses, written = dict.fromkeys([*params, "self"], 0), set()
    nested = False
    for n in ast.walk(m):
        nested = nested or n is not m and isinstance(n, NESTED)
        match n:
            case ast.Attribute(value=ast.Name(id=name)) if name in uses:
                uses[name] += 1
            case ast.Name(id=name, ctx=ast.Store() | ast.Del()):
                written.add(name)
    yield "method", owner, m.name, None, "nested" if nested else None, uses["self"], movable(m), m.lineno, m.end_lineno, None, None
    for name, annotation in params.items():
        yield "parameter", owner, m.name, name, named_type(annotation), uses[name], name in written, m.lineno, m.end_lineno, None, None


def rows_of(text: str) -> Iterator[tuple]:
    """Rows of a file: class, function, method, parameter, call, reference (of a method without a call) and variable (with the class of its value)."""
    tree = ast.parse(text)
    none = (None,) * 11
    row = lambda kind, **more: tuple({**dict(zip(NAMES, none, strict=True)), "kind": kind, **more}.values())
    for n in tree.body:
        if isinstance(n, ast.ClassDef):
            yield row("class", name=n.name, line=n.lineno, end_line=n.end_lineno)
            for m in n.body:
                if isinstance(m, FUNCTIONS):
                    yield from method_rows(n.name, m)
        elif isinstance(n, FUNCTIONS):
            yield row("function", name=n.name, line=n.lineno, end_line=n.end_lineno)
    called: set[int] = set()
    stack: list[tuple[ast.AST, str | None, str | None, str | None]] = [(tree, None, None, None)]  # node, class at the top and method in it, innermost class
    while stack:
        node, owner, method, inner = stack.pop()
        if isinstance(node, ast.ClassDef):
            owner, inner = (node.name if owner is None and method is None else owner), node.name
        elif isinstance(node, FUNCTIONS) and owner is not None and method is None:
            method = node.name
        match node:
            case ast.Call(func=ast.Attribute(attr=name, value=receiver) as f):
                called.add(id(f))
                by = f"self {inner}" if isinstance(receiver, ast.Name) and receiver.id == "self" else value_of(receiver)
                by = by if not isinstance(receiver, ast.Call) or isinstance(receiver.func, ast.Name) else "other"
                first = node.args[0] if node.args else None
                given = None if isinstance(first, ast.Starred) else value_of(first)
                words = {} if node.args else {k.arg: value_of(k.value) for k in node.keywords if k.arg}
                yield row("call", owner=owner, method=method, name=name, type=by, flag=bool(node.args), argument=given, keywords=words, line=node.lineno)
            case ast.Attribute(attr=name) if id(node) not in called:
                yield row("reference", owner=owner, method=method, name=name, line=node.lineno)
            case ast.Assign(targets=targets, value=ast.Call() as call):
                for t in targets:
                    if isinstance(t, ast.Name):
                        yield row("variable", name=t.id, type=value_of(call)[4:], line=node.lineno)
            case ast.AnnAssign(target=ast.Name(id=name)):
                for kind in (named_type(node.annotation), value_of(node.value)[4:] if isinstance(node.value, ast.Call) else None):
                    if kind:
                        yield row("variable", name=name, type=kind, line=node.lineno)
            case ast.FunctionDef() | ast.AsyncFunctionDef():
                for a in node.args.args:
                    if kind := named_type(a.annotation):
                        yield row("variable", name=a.arg, type=kind, line=node.lineno)
        stack += [(c, owner, method, inner) for c in ast.iter_child_nodes(node)]


NAMES = [c.split()[0] for c in COLUMNS.replace("map<string,string>", "map").split(", ")]


def scopes(files: DataFrame, repository: str = "repository") -> DataFrame:
    """repository, path and COLUMNS for the Python files (repository, path, text); files that don't parse give no rows."""
    prepare(files.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made = remembered(rows_of)

        def found() -> Iterator[list[tuple]]:
            for pdf in batches:
                for r, p, t in zip(pdf[repository], pdf["path"], pdf["text"], strict=True):
                    try:
                        yield [(r, p, *x) for x in made(t or "")]
                    except (SyntaxError, ValueError, RecursionError):
                        continue

        yield from framed(found(), ["repository", "path", *NAMES], {"uses": "Int32", "line": "Int32", "end_line": "Int32", "flag": "boolean"})

    return files.select(repository, "path", "text").mapInPandas(run, f"repository string, path string, {COLUMNS}")
