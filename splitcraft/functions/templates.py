"""Program -> template rewrites at four abstraction levels.

Each level is an ordered list of rewrite steps.  The steps are not
commutative, so the order below is part of the definition.  Every step is a
native Spark expression (``regexp_replace`` / ``replace`` / ``aggregate``),
so one projection holds the whole chain inside whole-stage codegen; no
Python runs per row.

The same step lists are rendered as DuckDB SQL by ``template_sql`` for the
correctness oracle (Java ``$1`` becomes ``\\1``, every replace is global).

Levels (fine to coarse):
  template_typed      values replaced by typed markers (QUOTED_VAL, NUMBER_VAL ...)
  template_schemafree typed template with tables / properties anonymised
  template_untyped    every value -> VALUE, value arithmetic folded, schema removed
  template_noops      operators collapsed into REL_OP / LOG_OP / FUNC_OP / FUNC_MOD
  template_abstract   template_noops(template_untyped(program))
"""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import ascii_fold, ascii_fold_sql

# ---------------------------------------------------------------------------
# The rewrite rules of the four template levels, in order.
# ("re", pattern, replacement)  regular-expression replace of every match
# ("lit", text, replacement)    literal replace of every occurrence
# ("fold",)                     five rounds of value-arithmetic folding
# ---------------------------------------------------------------------------
QUOTED = r'''" [0-9A-Za-z'_\-.:;,?\s\\/&@()+]+ "'''
SQUEEZE = ("re", r"[ ]+", " ")

TYPED_STEPS = [
    ("re", r" true ", " BOOL_VAL "),
    ("re", r" false ", " BOOL_VAL "),
    ("re", QUOTED, "QUOTED_VAL"),
    ("re", r" (NUMBER_[0-9]|[0-9]{1,2}) unit:([a-z]+) ", " NUMBER_VAL "),
    ("re", r" (end_of|start_of) unit:([a-z]+) ", " TIME_VAL "),
    ("re", r"enum:[a-zA-Z_:.0-9]+", "ENUM_VAL"),
    ("re", r"new Date \( [a-zA-Z_0-9\s,]+ \)", "DATE_VAL"),
    ("re", r"time:[0-9]{1,2}:0:0", "TIME_VAL"),
    ("re", r" now ", " TIME_VAL "),
    SQUEEZE,
    ("re", r"(==|,) location:\s{0,1}[a-zA-Z_:.0-9]+ ", "$1 LOCATION_VAL "),
    ("re", r" [0-9]{1,2} ", " NUMBER_VAL "),
    ("re", r"EMAIL_ADDRESS_[0-9]", "QUOTED_VAL"),
    ("re", r"PHONE_NUMBER_[0-9]", "QUOTED_VAL"),
    ("re", r"QUOTED_STRING_[0-9]", "QUOTED_VAL"),
    ("re", r"NUMBER_[0-9]", "NUMBER_VAL"),
    ("re", r"([A-Z]+)_[0-9]", "$1_VAL"),
    ("re", r"location:VAL", "LOCATION_VAL"),
    ("re", r"TIME_VAL", "NUMBER_VAL"),
    ("re", r"DATE_VAL", "NUMBER_VAL"),
    SQUEEZE,
]

SCHEMA_STEPS = [
    ("re", r"org.schema.[a-zA-Z_]+:[a-zA-Z_]+", "schema_property"),
    ("re", r"@org.schema.[a-zA-Z_]+\.[a-zA-Z_]+", "schema_table"),
    ("re", r"tt:[a-z_]+", "tt_property"),
    ("re", r"\^\^tt_property", ""),
    ("re", r"\^\^schema_property", ""),
    ("re", r" param:[a-zA-Z\._]+[:\.]([a-zA-Z\._]+)(\([a-zA-Z\.:@_,]+\))?", " param:property"),
    ("re", r" param:[a-zA-Z\._]+ ", " param:property "),
    ("lit", "param:property(Entity(schema_property))", "param:property"),
    ("lit", "param:property(Entity(tt_property))", "param:property"),
]

LOCATION = r"(==|,) location:\s{0,1}[a-zA-Z_:.0-9]+ "
ALTERNATIVES = (r"(EMAIL_ADDRESS_[0-9]|PHONE_NUMBER_[0-9]|QUOTED_STRING_[0-9]|QUOTED_VAL|UNIT_VAL"
                r"|NUMBER_VAL|location:VAL|ENUM_VAL|NUMBER_0|[A-Z]+_[0-9])")

UNTYPED_VALUE_STEPS = [
    ("re", r" true ", " VALUE "),
    ("re", r" false ", " VALUE "),
    ("re", QUOTED, "VALUE"),
    ("re", r" (NUMBER_[0-9]|start_of|end_of|[0-9]{1,2}) unit:([a-z]+) ", " NUMBER_VAL "),
    ("re", r" [0-9]{1,2} ", " NUMBER_VAL "),
    ("re", r"enum:[a-zA-Z_:.0-9]+", "ENUM_VAL"),
    ("re", r"new Date \( [a-zA-Z_0-9\s,]+ \)", "NUMBER_VAL"),
    ("re", r"time:[0-9]{1,2}:0:0", "NUMBER_VAL"),
    ("re", r" now ", " NUMBER_VAL "),
    SQUEEZE,
    ("re", LOCATION, "$1 VALUE "),
    ("re", ALTERNATIVES, "VALUE"),
    ("re", r"\[\s+VALUE\s+,\s+VALUE\s+\]", "VALUE"),
    ("re", r" \( VALUE \)[\s]+(-|\+)[\s]+VALUE ", " VALUE "),
    ("fold",),
]

# one value-arithmetic term, optionally wrapped in one pair of parentheses
FOLD_PATTERN = r"(\({0,1}[\s]+(?:NUMBER_VAL|VALUE)[\s]+(?:-|\+)[\s]+(?:NUMBER_VAL|VALUE)[\s]+\){0,1})"
FOLD_ROUNDS = 5

REL_OPS = ["==", "<=", ">=", "=~", "~=", "contains~", "contains", "in_array~", "in_array"]
LOG_OPS = ["and", "or", "not"]
FUNC_OPS = ["compute", "count", "sort", "distance", "aggregate", "avg", "sum"]
FUNC_MODS = ["asc", "desc"]

NOOPS_STEPS = (
    [("lit", f" {op} ", " REL_OP ") for op in REL_OPS]
    + [("lit", f" {op} ", " LOG_OP ") for op in LOG_OPS]
    + [("lit", f" {op} ", " FUNC_OP ") for op in FUNC_OPS]
    + [("lit", f" {op} ", " FUNC_MOD ") for op in FUNC_MODS]
    + [("re", "FUNC_OP FUNC_OP", "FUNC_OP"), SQUEEZE]
)

# Templates the compositional split always keeps in train (fixed values).
MUST_TRAIN_TEMPLATES = [
    "now => ( schema_table ) filter param:property REL_OP VALUE LOG_OP param:property REL_OP VALUE => notify",
    "now => ( schema_table ) filter param:property REL_OP VALUE => notify",
    "now => [ param:property ] of ( ( schema_table ) filter param:property REL_OP VALUE ) => notify",
]


# ---------------------------------------------------------------------------
# Spark rendering
# ---------------------------------------------------------------------------
def _count_char(c: Column, ch: str) -> Column:
    return F.length(c) - F.length(F.replace(c, F.lit(ch), F.lit("")))


def fold_value_arithmetic(c: Column) -> Column:
    """Five rounds: every ``[(] VALUE ± VALUE [)]`` found at the start of a
    round is replaced everywhere by `` VALUE `` (outer parentheses dropped
    first when unbalanced), in match order.

    Written as one nested ``aggregate`` so the input expression is
    referenced once (repeating it per round would grow the plan 3^5-fold).
    """
    def step(acc, m):
        balanced = _count_char(m, "(") == _count_char(m, ")")
        target = F.when(balanced, m).otherwise(F.btrim(m, F.lit("()")))
        return F.replace(acc, target, F.lit(" VALUE "))

    def one_round(t, _i):
        return F.aggregate(F.regexp_extract_all(t, F.lit(FOLD_PATTERN), 1), t, step)

    def rounds(t):
        return F.aggregate(F.sequence(F.lit(1), F.lit(FOLD_ROUNDS)), t, one_round)

    # most texts hold nothing to fold; the one-element array names the input once
    return F.element_at(F.transform(F.array(c), lambda t: F.when(t.rlike(FOLD_PATTERN), rounds(t)).otherwise(t)), 1)


_META = set(".^$*+?()[]{}|\\")


def _literal(pattern: str):
    """The plain text a pattern matches when it has no regex operators
    (escaped ``^`` allowed), else None."""
    if pattern.startswith("^"):
        return None
    text = pattern.replace("\\^", "^")
    if any(ch in _META for ch in text.replace("^", "")):
        return None
    return text


#: Patterns as they run on Spark: the same matches, or for runs of blanks the same
#: text, but places where no match can begin are passed by their first sign.
_FAST = {
    r"[ ]+": "  +",  # a single blank would be replaced by itself
    ALTERNATIVES: "(?=[A-Zl])" + ALTERNATIVES,
    LOCATION: "(?=[=,])" + LOCATION,
}


def _replace_each(c: Column, pairs) -> Column:
    """Literal replacements one after the other; texts that don't hold one are
    not written anew."""
    table = F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in pairs])
    return F.aggregate(table, c, lambda t, s: F.when(F.contains(t, s["a"]), F.replace(t, s["a"], s["b"])).otherwise(t))


def apply_steps(c: Column, steps) -> Column:
    literals: list = []

    def settled(c):
        out = _replace_each(c, literals) if literals else c
        literals.clear()
        return out

    for step in steps:
        kind = step[0]
        if kind == "re" and _literal(step[1]) is not None and "$" not in step[2]:
            # same left-to-right, non-overlapping replacement, without a regex engine
            literals.append((_literal(step[1]), step[2]))
        elif kind == "re":
            c = F.regexp_replace(settled(c), _FAST.get(step[1], step[1]), step[2])
        elif kind == "lit":
            literals.append((step[1], step[2]))
        elif kind == "fold":
            c = fold_value_arithmetic(settled(c))
        else:  # pragma: no cover
            raise ValueError(kind)
    return settled(c)


def _program(c, compat: bool) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    # the reference formats a missing program as the text 'nan'
    return F.coalesce(c, F.lit("nan")) if compat else c


def template_typed(program, compat: bool = True) -> Column:
    return apply_steps(ascii_fold(_program(program, compat)), TYPED_STEPS)


def template_schemafree(typed_template) -> Column:
    c = F.col(typed_template) if isinstance(typed_template, str) else typed_template
    return apply_steps(c, SCHEMA_STEPS + [SQUEEZE])


def template_untyped(program, compat: bool = True) -> Column:
    return apply_steps(ascii_fold(_program(program, compat)),
                       UNTYPED_VALUE_STEPS + SCHEMA_STEPS + [SQUEEZE])


def template_noops(untyped_template) -> Column:
    c = F.col(untyped_template) if isinstance(untyped_template, str) else untyped_template
    return apply_steps(c, NOOPS_STEPS)


def template_abstract(program, compat: bool = True) -> Column:
    return template_noops(template_untyped(program, compat))


def with_template_levels(df, program_col: str = "query", compat: bool = True):
    """Add the four template levels and the abstract template.

    Column names follow the hierarchical sampler: ``template_kbfree_untyped_noops``
    (top), ``template_kbfree_untyped``, ``template_kbfree``, ``template`` (typed),
    and ``abstract_template`` (= noops of untyped, the CLI's template).
    The untyped chain is written once and reused for noops.
    """
    typed = template_typed(program_col, compat)
    untyped = template_untyped(program_col, compat)
    return (df.withColumn("template", typed)
              .withColumn("template_kbfree", template_schemafree(F.col("template")))
              .withColumn("template_kbfree_untyped", untyped)
              .withColumn("template_kbfree_untyped_noops", template_noops(F.col("template_kbfree_untyped"))))


# ---------------------------------------------------------------------------
# DuckDB rendering (oracle side)
# ---------------------------------------------------------------------------
def _sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_repl(r: str) -> str:
    return r.replace("$1", "\\1").replace("$2", "\\2")


def _fold_sql(t: str) -> str:
    m_open = "(length(m) - length(replace(m, '(', '')))"
    m_close = "(length(m) - length(replace(m, ')', '')))"
    target = f"CASE WHEN {m_open} = {m_close} THEN m ELSE trim(m, '()') END"
    inner = (f"list_reduce(regexp_extract_all(acc, {_sql_str(FOLD_PATTERN)}, 1), "
             f"lambda a2, m: replace(a2, {target}, ' VALUE '), acc)")
    return f"list_reduce(range({FOLD_ROUNDS}), lambda acc, i: {inner}, {t})"


def steps_sql(expr: str, steps) -> str:
    for step in steps:
        kind = step[0]
        if kind == "re":
            expr = f"regexp_replace({expr}, {_sql_str(step[1])}, {_sql_str(_sql_repl(step[2]))}, 'g')"
        elif kind == "lit":
            expr = f"replace({expr}, {_sql_str(step[1])}, {_sql_str(step[2])})"
        elif kind == "fold":
            expr = _fold_sql(expr)
    return expr


def template_sql(level: str, program_expr: str) -> str:
    """DuckDB SQL text for one template level of ``program_expr``."""
    prog = f"coalesce({program_expr}, 'nan')"
    if level == "template_typed":
        return steps_sql(ascii_fold_sql(prog), TYPED_STEPS)
    if level == "template_schemafree":
        return steps_sql(template_sql("template_typed", program_expr), SCHEMA_STEPS + [SQUEEZE])
    if level == "template_untyped":
        return steps_sql(ascii_fold_sql(prog), UNTYPED_VALUE_STEPS + SCHEMA_STEPS + [SQUEEZE])
    if level in ("template_noops", "template_abstract"):
        return steps_sql(template_sql("template_untyped", program_expr), NOOPS_STEPS)
    raise ValueError(level)
