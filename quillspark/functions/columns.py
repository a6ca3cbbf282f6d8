"""Column helpers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def replace_all(text: Column, find: Column, put: Column) -> Column:
    return F.replace(text, find, put)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value worked out once, however often body uses it."""
    return F.transform(F.array(value), body)[0]
