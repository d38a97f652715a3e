"""Results as plain values and as JSON text, for the command line and HTTP."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

from pyspark.sql import DataFrame, Row


def plain(value: object) -> object:
    """Points become {"type": "POINT", "x", "y"}."""
    if isinstance(value, Row):
        return {"type": "POINT", "x": value["x"], "y": value["y"]}
    return value


def rows(result: DataFrame) -> Iterator[dict]:
    """The rows one by one; the driver holds one partition at a time."""
    return ({c: plain(r[k]) for k, c in enumerate(result.columns)} for r in result.toLocalIterator())


def rendered(result: object) -> object:
    return list(rows(result)) if isinstance(result, DataFrame) else asdict(result)


def pieces(result: object) -> Iterator[str]:
    """JSON text of a result in pieces, a row at a time, so that a large result isn't held whole."""
    if not isinstance(result, DataFrame):
        yield json.dumps(asdict(result), ensure_ascii=False, indent=2)
        return
    before = "["
    for row in rows(result):
        yield before + "\n  " + json.dumps(row, ensure_ascii=False)
        before = ","
    yield "[]" if before == "[" else "\n]"
