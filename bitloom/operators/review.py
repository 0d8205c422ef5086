"""A user's reviewer run over units, in a channel of its own beside the quality checks."""

from __future__ import annotations

import ast
import importlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ISSUE = "array<struct<type:string,description:string,span_hint:string>>"


def load(spec: str):
    """A reviewer by its name: module:attribute, module.attribute, or module:name(...) with literals or names of
    the module as arguments. A class is called without arguments."""
    head, colon, tail = spec.partition(":")
    if not colon:
        head, _, tail = spec.rpartition(".")
    try:
        node = ast.parse(tail.strip(), mode="eval").body
        names = vars(importlib.import_module(head))
        found = _value(node, names)
    except (ImportError, ValueError, SyntaxError, KeyError, AttributeError, TypeError) as e:
        raise ValueError(f"{tail!r} of the module {head!r} is no reviewer: {e}") from e
    if isinstance(found, type):
        found = found()
    if not callable(getattr(found, "review", found)):
        raise TypeError(f"{spec} has no review method and isn't callable")
    return found


def _value(node: ast.expr, names: dict):
    """What an expression of names, attributes, literals and calls stands for; nothing else is worked out."""
    if isinstance(node, ast.Name):
        return names[node.id]
    if isinstance(node, ast.Attribute):
        return getattr(_value(node.value, names), node.attr)
    if isinstance(node, ast.Call):
        return _value(node.func, names)(*(_value(x, names) for x in node.args), **{k.arg: _value(k.value, names) for k in node.keywords if k.arg})
    return ast.literal_eval(node)


def attach(units: DataFrame, reviewer: Callable) -> DataFrame:
    """units with semantic_issues: what reviewer(unit as dict) gives, a list of dicts; errors propagate.
    Values of a unit are Python's, None where null."""
    call = getattr(reviewer, "review", reviewer)
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in units.schema), f"semantic_issues {ISSUE}"])
    kind = pa.list_(pa.struct([(c, pa.string()) for c in ("type", "description", "span_hint")]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [[{"type": i["type"], "description": i["description"], "span_hint": i.get("span_hint")} for i in call(u)] for u in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, kind)], names=[*b.schema.names, "semantic_issues"])

    return units.mapInArrow(run, schema)


def summary(reviewed: DataFrame) -> DataFrame:
    return reviewed.select(F.explode("semantic_issues").alias("i")).groupBy("i.type").agg(F.count("*").alias("issues"))
