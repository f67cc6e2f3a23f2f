"""DuckDB oracle SQL fragments shared by the catalog."""
from __future__ import annotations

from ..functions.hashing import uniform_sql
from ..functions.templates import template_sql
from ..functions.vocab import program_vocab_sql
from .fixtures import EVAL_FILTER_SQL, PROGRAMS_SQL


def sql_str(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def with_programs(*ctes: str) -> str:
    return "WITH " + ",\n".join([PROGRAMS_SQL.strip()] + [c.strip() for c in ctes])


TEMPLATED = f"templated AS (SELECT *, {template_sql('template_abstract', 'query')} AS abstract_template FROM programs)"
EVAL_TEMPLATES = f"evalt AS (SELECT DISTINCT abstract_template FROM templated WHERE {EVAL_FILTER_SQL})"
POOL = ("pool AS (SELECT * FROM templated t WHERE NOT EXISTS "
        "(SELECT 1 FROM evalt e WHERE e.abstract_template = t.abstract_template))")


def specs_values(specs: list[dict]) -> str:
    rows = ", ".join(f"({sql_str(s['split_name'])}, {int(s['n'])}, CAST({float(s.get('alpha', 0.0))!r} AS DOUBLE))"
                     for s in specs)
    return f"specs(split_name, n, alpha) AS (VALUES {rows})"


def sample_and_label_sql(source: str, weight_expr: str, dev_share: float, seed: int = 0,
                         id_col: str = "example_id", program_col: str = "query") -> list[str]:
    """CTEs keyed -> sample -> lab -> final (split_name, id, label) from
    ``source`` (rows with ``weight_expr`` evaluated against source s and specs x)."""
    u_draw = uniform_sql(f"s.{id_col}", str(seed), "x.split_name", "'draw'")
    u_dev = uniform_sql(id_col, str(seed), "split_name", "'dev'")
    return [
        f"keyed AS (SELECT x.split_name, x.n, s.{id_col}, s.{program_col}, "
        f"CASE WHEN ({weight_expr}) > 0 THEN -ln({u_draw}) / ({weight_expr}) END AS k "
        f"FROM {source} s, specs x)",
        "sample AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY split_name ORDER BY k, "
        f"{id_col}) AS rn FROM keyed WHERE k IS NOT NULL) WHERE rn <= n)",
        f"lab AS (SELECT split_name, {id_col}, {program_col}, CASE WHEN row_number() OVER "
        f"(PARTITION BY split_name ORDER BY {u_dev}, {id_col}) <= ceil({float(dev_share)!r} * count(*) OVER "
        f"(PARTITION BY split_name)) THEN 2 ELSE 1 END AS label FROM sample)",
        f"voc AS (SELECT split_name, {id_col}, label, unnest({program_vocab_sql(program_col)}) AS tok FROM lab)",
        "missing AS (SELECT DISTINCT split_name, tok FROM voc WHERE label = 2 "
        "EXCEPT SELECT DISTINCT split_name, tok FROM voc WHERE label = 1)",
        f"bad AS (SELECT DISTINCT l.split_name, l.{id_col} FROM lab l JOIN missing m ON l.split_name = m.split_name "
        f"WHERE l.label = 2 AND strpos(l.{program_col}, ' ' || regexp_replace(m.tok, '^\\s+|\\s+$', '', 'g') || ' ') > 0)",
        f"final AS (SELECT l.split_name, l.{id_col}, l.label FROM lab l WHERE NOT EXISTS (SELECT 1 FROM bad b "
        f"WHERE b.split_name = l.split_name AND b.{id_col} = l.{id_col}))",
    ]


LEVELED = ("leveled AS (SELECT *, "
           f"{template_sql('template_typed', 'query')} AS template, "
           f"{template_sql('template_schemafree', 'query')} AS template_kbfree, "
           f"{template_sql('template_untyped', 'query')} AS template_kbfree_untyped, "
           "abstract_template AS template_kbfree_untyped_noops FROM pool)")


def rank_cut_sql(source: str, key: str, id_col: str, k_expr: str, partition: str = "") -> str:
    """Rows of ``source`` whose (key, id) rank is within ``k_expr``."""
    part = f"PARTITION BY {partition} " if partition else ""
    return (f"(SELECT * FROM (SELECT *, row_number() OVER ({part}ORDER BY {key}, {id_col}) AS _rk FROM {source}) "
            f"WHERE _rk <= {k_expr})")
