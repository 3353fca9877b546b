"""Programs to operation logs by syntax tree. Nothing in a program is ever run.

A program is a module of imports, assignments and call chains on a workplane. Each call of
a chain is one operation with literal arguments. What is not of that form is unsupported.
"""

from __future__ import annotations

import ast


class Unsupported(Exception):
    """The program needs more than call chains over literals."""


def _literal(node: ast.AST, names: dict) -> object:
    if isinstance(node, ast.Name) and node.id in names:
        return names[node.id]
    if isinstance(node, ast.UnaryOp) and isinstance(node.op, (ast.USub, ast.UAdd)):
        value = _literal(node.operand, names)
        if isinstance(value, (int, float)):
            return -value if isinstance(node.op, ast.USub) else value
    if isinstance(node, ast.BinOp) and isinstance(node.op, (ast.Add, ast.Sub, ast.Mult, ast.Div)):
        a, b = _literal(node.left, names), _literal(node.right, names)
        if all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (a, b)):
            if isinstance(node.op, ast.Div) and b == 0:
                raise ZeroDivisionError("division by zero")
            return {ast.Add: a + b, ast.Sub: a - b, ast.Mult: a * b}.get(type(node.op)) if not isinstance(node.op, ast.Div) else a / b
    if isinstance(node, (ast.Tuple, ast.List)):
        return [_literal(x, names) for x in node.elts]
    if isinstance(node, ast.Constant):
        return node.value
    raise Unsupported(f"unsupported expression: {ast.unparse(node)[:80]}")


def _chain(node: ast.AST, names: dict, chains: dict[str, list]) -> list | None:
    """Operations of a call chain; None if the node is none."""
    if isinstance(node, ast.Name) and node.id in chains:
        return list(chains[node.id])
    if not isinstance(node, ast.Call) or not isinstance(node.func, (ast.Attribute, ast.Name)):
        return None
    name = node.func.attr if isinstance(node.func, ast.Attribute) else node.func.id
    before = _chain(node.func.value, names, chains) if isinstance(node.func, ast.Attribute) else None
    if before is None and name != "Workplane":
        return None
    args = [_literal(a, names) for a in node.args]
    kwargs = [(k.arg, _literal(k.value, names)) for k in node.keywords]
    return [*(before or []), (name, args, kwargs)]


def operations(code: str) -> list[tuple[str, list, list]]:
    """(name, args, kwargs) of the result's chain: the value of `result`, else `part`, else of the
    name that was the first to be given a chain, else of the first chain."""
    return parse(code)[0]


def parse(code: str) -> tuple[list[tuple[str, list, list]], list[tuple[str, list, list]]]:
    """The result's chain, and the calls of all chains in the order they are made."""
    names: dict = {}
    chains: dict[str, list] = {}
    first, calls = None, []
    for node in ast.parse(code).body:
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            continue
        value = node.value if isinstance(node, (ast.Assign, ast.Expr, ast.AnnAssign)) else None
        if value is None:
            raise Unsupported(f"unsupported statement: {type(node).__name__}")
        targets = [t.id for t in getattr(node, "targets", [getattr(node, "target", None)]) if isinstance(t, ast.Name)]
        found = _chain(value, names, chains)
        if found is not None:
            first = first or found
            calls += found[_known(value, chains) :]
            chains |= dict.fromkeys(targets, found)
        elif not isinstance(node, ast.Expr):
            names |= dict.fromkeys(targets, _literal(value, names))
    found = chains.get("result") or chains.get("part") or next(iter(chains.values()), first)
    if found is None:
        raise Unsupported("unsupported program: no workplane")
    return found, calls


def _known(node: ast.AST, chains: dict[str, list]) -> int:
    """How many calls of a chain were made before, under the name it starts from."""
    while isinstance(node, ast.Call):
        node = node.func.value if isinstance(node.func, ast.Attribute) else None
    return len(chains[node.id]) if isinstance(node, ast.Name) and node.id in chains else 0
