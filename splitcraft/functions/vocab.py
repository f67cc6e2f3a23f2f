"""Program vocabulary: schema properties and language operators.

``extract_properties`` returns the members exactly as the seven pattern
families match them: one optional leading space or ``(`` and a required
trailing space or ``)`` (not for enums).  Members are not trimmed, so
``" tt:x "`` and ``"tt:x "`` are two different members, as in the reference.
"""
from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# The seven property pattern families.
PROPERTY_PATTERNS = [
    r"(?:[\s(]{0,1})tt:[a-z_]+(?:[\s)])",
    r"(?:[\s(]{0,1})org.schema.[a-zA-Z_]+:[a-zA-Z_]+(?:[\s)])",
    r"(?:[\s(]{0,1})@org.schema.[a-zA-Z_]+\.[a-zA-Z_]+(?:[\s)])",
    r"(?:[\s(]{0,1})param:[a-zA-Z._]+[:.][a-zA-Z._]+(?:[\s)])",
    r"(?:[\s(]{0,1})param:[a-zA-Z._]+[:.][a-zA-Z._]+\([()a-zA-Z.:@_,]+\)(?:[\s)])",
    r"enum:[a-zA-Z_:.0-9]+",
    r"(?:[\s(]{0,1})param:[a-zA-Z]+(?:[\s)])",
]

# The 23 language operators checked for coverage.
OPERATORS = ["-", "+", "==", "<=", ">=", "=~", "~=", "contains~", "contains", "in_array~", "in_array",
             "and", "or", "not", "compute", "count", "sort", "distance", "aggregate", "avg", "sum",
             "asc", "desc"]


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


_LEAD = r"(?:[\s(]{0,1})"


def _ahead(pattern: str) -> str:
    """The same pattern, which passes places where no member can begin by their
    first sign."""
    return rf"(?=[\s({pattern[len(_LEAD)]}]){pattern}" if pattern.startswith(_LEAD) else pattern


def _sign(pattern: str) -> str:
    """The letters every member of the family begins with (``tt:``, ``@org``...)."""
    return re.match(r"@?[a-z]+:?", pattern.removeprefix(_LEAD))[0]


def extract_properties(program) -> Column:
    """Distinct property members of one program (array<string>)."""
    p = _col(program)
    none = F.when(p.isNotNull(), F.array().cast("array<string>"))
    return F.array_distinct(F.concat(*[F.when(F.contains(p, F.lit(_sign(pat))), F.regexp_extract_all(p, F.lit(_ahead(pat)), 0)).otherwise(none)
                                       for pat in PROPERTY_PATTERNS]))


def has_operator(program, op: str) -> Column:
    return F.instr(_col(program), f" {op} ") > 0


def operators_present(program) -> Column:
    """Operators occurring as `` op `` in the program (array<string>)."""
    p = _col(program)
    return F.array_compact(F.array(*[F.when(F.contains(p, F.lit(f" {o} ")), F.lit(o)) for o in OPERATORS]))


def program_vocab(program) -> Column:
    """Properties and operators of one program: the coverage vocabulary."""
    return F.array_distinct(F.concat(extract_properties(program), operators_present(program)))


# ---------------------------------------------------------------------------
# DuckDB rendering
# ---------------------------------------------------------------------------
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def extract_properties_sql(expr: str) -> str:
    parts = ", ".join(f"regexp_extract_all({expr}, {_sql_str(p)}, 0)" for p in PROPERTY_PATTERNS)
    return f"list_distinct(list_concat({parts}))"


def operators_present_sql(expr: str) -> str:
    arr = "[" + ", ".join(_sql_str(o) for o in OPERATORS) + "]"
    return f"list_filter({arr}, lambda o: strpos({expr}, ' ' || o || ' ') > 0)"


def program_vocab_sql(expr: str) -> str:
    return f"list_distinct(list_concat({extract_properties_sql(expr)}, {operators_present_sql(expr)}))"
