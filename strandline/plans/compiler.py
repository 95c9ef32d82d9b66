"""Compiles batches of expressions into stages of selects.

Equal subexpressions of a batch, whatever expression they stand in, become one column. A stage holds all columns whose inputs are ready
and which need the same partitioning (by entity, by date, or none), so a batch pays each change of partitioning once a stage and not once
an expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import elementwise
from ..functions.cross_section import Section
from ..functions.time_series import Series
from .expression import RAW, Node, parse


def evaluate(panel: DataFrame, expressions: dict[str, str | Node], keep: tuple[str, ...] = ("t", "stock"), leaves: tuple[str, ...] = RAW) -> DataFrame:
    """panel: a dense grid of t and stock with the leaf columns. keep's columns and one for each named expression."""
    roots = {k: (parse(e, leaves) if isinstance(e, str) else e).canonical() for k, e in expressions.items()}
    names: dict[Node, str] = {}
    todo: list[Node] = []

    def add(node: Node) -> None:
        if node in names:
            return
        for c in node.children:
            add(c)
        names[node] = node.action.name if not node.children else f"_e{len(names)}"
        if node.children:
            todo.append(node)

    for node in roots.values():
        add(node)
    used = sorted({n.action.name for n in names if not n.children})
    df = panel.select(*dict.fromkeys([*keep, "t", "stock", *used]))
    df = df.select(*[elementwise.finite(F.col(c).cast("double")).alias(c) if c in used else c for c in df.columns])
    ready = {n for n in names if not n.children}
    series, section = Series(), Section()
    kind = None
    while todo:
        able = [n for n in todo if all(c in ready for c in n.children)]
        plain = [n for n in able if n.action.kind in ("unary", "binary")]
        if plain:
            now = plain
        else:
            if not any(n.action.kind == kind for n in able):
                kind = able[0].action.kind
            now = [n for n in able if n.action.kind == kind]
        columns, late = {}, {}
        for n in now:
            args, a = [F.col(names[c]) for c in n.children], n.action
            if a.kind in ("unary", "binary"):
                out = (elementwise.UNARY if a.kind == "unary" else elementwise.BINARY)[a.name](*args)
            elif a.kind == "section":
                out = getattr(section, a.name)(*args)
            else:
                out = getattr(series, a.name)(*args, a.window)
            if isinstance(out, tuple):
                columns[f"{names[n]}r"], late[n] = out
            else:
                columns[names[n]] = out
        df = df.withColumns(columns)
        if late:
            df = df.withColumns({names[n]: f(F.col(f"{names[n]}r")) for n, f in late.items()}).drop(*[f"{names[n]}r" for n in late])
        ready.update(now)
        todo = [n for n in todo if n not in ready]
        needed = {names[c] for n in todo for c in n.children} | {names[n] for n in roots.values()} | {*keep, "t", "stock"}
        df = df.select(*[c for c in df.columns if c in needed])
    return df.select(*keep, *[F.col(names[n]).alias(k) for k, n in roots.items()])
