"""Typed predicates as Columns."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce
from operator import and_

from pyspark.sql import Column, functions as F

# The operators of the predicate grammar.
OPERATORS = ("eq", "neq", "gt", "gte", "lt", "lte", "in", "nin", "contains")


def typed_predicate(field: str, operator: str, value) -> Column:
    """``field operator value``; rows whose field is NULL are not selected."""
    col = F.col(f"`{field}`")
    many = isinstance(value, (list, tuple))
    if (operator in ("in", "nin")) != many:
        raise ValueError(f"{operator} on {field}: a list is expected only by in and nin")
    match operator:
        case "eq":
            return col == value
        case "neq":
            return col != value
        case "gt":
            return col > value
        case "gte":
            return col >= value
        case "lt":
            return col < value
        case "lte":
            return col <= value
        case "in":
            return col.isin(list(value)) if value else F.lit(False)
        case "nin":
            return ~col.isin(list(value)) if value else col.isNotNull()
        case "contains":
            return F.contains(col.cast("string"), F.lit(str(value)))
    raise ValueError(f"unknown operator: {operator}")


def all_of(predicates: Iterable[Column]) -> Column:
    return reduce(and_, predicates, F.lit(True))


def equality_filter(filters: Mapping[str, object]) -> Column:
    """AND of ``column = value``. A NULL value selects nothing; lists and objects are refused."""
    tests = []
    for key, value in filters.items():
        if isinstance(value, (list, tuple, dict, set)):
            raise ValueError(f"scope filter on {key}: only single values can be compared")
        tests.append(F.lit(False) if value is None else F.col(f"`{key}`") == F.lit(value))
    return all_of(tests)
