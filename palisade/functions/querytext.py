"""Table, operation and columns of a logged query text.

For log analytics and batch decisions only. Enforcement never trusts these: it checks the
plan Spark itself parsed (``plans/governed_sql.py``).
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The white space and line ends of the log format.
BLANKS = "\t\n\x0b\f\r \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
LINE_ENDS = "\n\r\u2028\u2029"
_GAP = f"[{BLANKS}]+"

_FROM = rf"(?i)FROM{_GAP}(\w+)"
_FIRST_PIECE = rf"\A([^{BLANKS}]*)"
_SELECT_LIST = rf"(?i)SELECT{_GAP}([^{LINE_ENDS}]+?){_GAP}FROM"
_ALIAS = rf"(?i){_GAP}AS{_GAP}(\w+)\z"
_QUALIFIED = r"\.(\w+)\z"

# The writing operations.
WRITES = ("INSERT", "UPDATE", "DELETE")


def _found(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _trim(text: Column) -> Column:
    return F.trim(text, F.lit(BLANKS))


def query_table(query: Column) -> Column:
    """Word after the first FROM; else the first piece of the text; else ``unknown``."""
    return F.coalesce(_found(query, _FROM), _found(query, _FIRST_PIECE), F.lit("unknown"))


def query_operation(query: Column) -> Column:
    """INSERT, UPDATE or DELETE by prefix; everything else counts as SELECT."""
    head = F.upper(F.substring(F.ltrim(query, F.lit(BLANKS)), 1, len(WRITES[0])))
    return F.when(head.isin(*WRITES), head).otherwise(F.lit("SELECT"))


def query_columns(query: Column) -> Column:
    """Output names of the first SELECT list; ``*`` and texts without a list give none."""
    listed = F.nullif(_trim(F.regexp_extract(query, _SELECT_LIST, 1)), F.lit("*"))

    def name(piece: Column) -> Column:
        item = _trim(piece)
        return F.coalesce(_found(item, _ALIAS), _found(item, _QUALIFIED), item)

    names = F.filter(F.transform(F.split(listed, ","), name), lambda n: n != "")
    return F.coalesce(names, F.array().cast("array<string>"))


def query_length(query: Column) -> Column:
    return F.coalesce(F.length(query), F.lit(0))


def parse_query(query: Column) -> list[Column]:
    return [
        query_table(query).alias("table"),
        query_operation(query).alias("operation"),
        query_columns(query).alias("columns"),
        query_length(query).alias("query_length"),
    ]
