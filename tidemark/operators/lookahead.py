"""What a feature may know: classes of fields as metadata of columns, and the check that a query reads none known too late.

A class rides on a column as metadata. Names change on the way (aliases, joins, unions), so what a query reads is told by following
its analysed plan from the output down: the columns that outputs are made of, and those that choose rows (filters, joins, groups).
Columns that only pass by and are dropped later are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

CLASS = "known"
#: From the earliest: known at the open, after the close, or only as an outcome.
ORDER = ("open", "close", "outcome")
#: Fields of the gap ledger by when they are known.
LEDGER = {
    "open": ("symbol", "date", "previous_date", "open", "previous_close", "gap_pct", "gap_bps", "gap_direction", "prior_atr_pct", "prior_return_5d", "prior_return_20d", "prior_volume", "benchmark_return_20d", "is_benchmark", "row_number", "data_quality_status"),
    "close": ("high", "low", "close", "volume", "tr", "atr"),
    "outcome": ("open_to_close", "close_to_next_open", "next_open_to_close", "gap_filled", "gap_fill_ratio"),
}


class LookaheadError(ValueError):
    """A query reads columns that are not known in time."""


def classify(df: DataFrame, classes: dict[str, tuple[str, ...]]) -> DataFrame:
    """df with each named column's class as metadata; a class not in ORDER is an error, and so is a column without a class."""
    if unknown := set(classes) - set(ORDER):
        raise ValueError(f"unknown classes: {sorted(unknown)}")
    of = {c: k for k, cs in classes.items() for c in cs}
    if missing := [c for c in df.columns if c not in of]:
        raise ValueError(f"columns without a class: {missing}")
    for c in df.columns:
        df = df.withMetadata(c, {CLASS: of[c]})
    return df


def _seq(s) -> list:
    return [s.apply(i) for i in range(s.size())]


def _references(expression) -> dict[int, object]:
    found = {}
    for a in _seq(expression.references().toSeq()):
        found[a.exprId().id()] = a
    return found


def _walk(node, needed: dict[int, object], seen: dict[int, tuple[str, str]]) -> None:
    for i, a in needed.items():
        metadata = a.metadata()
        if metadata.contains(CLASS):
            seen[i] = (a.name(), metadata.getString(CLASS))
    kind, children = node.nodeName(), _seq(node.children())
    if kind == "Union" or kind == "Expand":
        # Outputs stand for columns by position.
        outputs = [a.exprId().id() for a in _seq(node.output())]
        if kind == "Union":
            for child in children:
                _walk(child, {a.exprId().id(): a for i, a in zip(outputs, _seq(child.output()), strict=True) if i in needed}, seen)
            return
    below = dict(needed)
    for e in _seq(node.expressions()):
        made = None
        try:
            made = e.exprId().id() if e.nodeName() == "Alias" else None
        except Exception:  # noqa: BLE001  expressions without an id are conditions, orders or groups
            made = None
        if made is not None:
            below.pop(made, None)
        if e.nodeName() == "AttributeReference" and kind in ("Project", "Aggregate"):
            # A column that passes is read only if it is needed above; a group is told by its own expression below.
            if kind == "Project" or e.exprId().id() not in needed:
                continue
        if made is None or made in needed:
            below.update(_references(e))
    if kind == "Aggregate":
        for e in _seq(node.groupingExpressions()):
            below.update(_references(e))
    if kind == "Window":
        if any(e.exprId().id() in needed for e in _seq(node.windowExpressions())):
            for e in [*_seq(node.partitionSpec()), *_seq(node.orderSpec())]:
                below.update(_references(e))
    for child in children:
        ids = {a.exprId().id(): a for a in _seq(child.output())}
        _walk(child, {i: ids[i] for i in below if i in ids}, seen)


def fields_read(df: DataFrame) -> dict[str, set[str]]:
    """By class the names of classified columns that df reads."""
    plan = df._jdf.queryExecution().analyzed()
    seen: dict[int, tuple[str, str]] = {}
    _walk(plan, {a.exprId().id(): a for a in _seq(plan.output())}, seen)
    out: dict[str, set[str]] = {}
    for name, cls in seen.values():
        out.setdefault(cls, set()).add(name)
    return out


def known_by(df: DataFrame, latest: str = "open") -> DataFrame:
    """df itself; raises LookaheadError if it reads columns known later than `latest`."""
    late = {c: sorted(names) for c, names in fields_read(df).items() if ORDER.index(c) > ORDER.index(latest)}
    if late:
        raise LookaheadError("; ".join(f"{c}: {', '.join(names)}" for c, names in sorted(late.items())))
    return df
