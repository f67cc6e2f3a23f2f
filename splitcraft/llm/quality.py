"""Quality rules with adaptive thresholds, by DataFrame functions alone.

1. Each document's signals come from array functions on its own row; nothing is
   exploded or shuffled for them.
2. Shares of those signals go into quantile sketches per language and source.  A
   sketch is a histogram over log-linear bins (exact below 256, then 128 bins for
   each power of two, so a quantile is at most 1/128 too low).  Sketches merge by
   adding counts, so each task sums its own rows first and the result does not
   depend on the order.  Documents that fail the base rule are not counted: what is
   rejected anyway sets no cut-off.  A group with fewer than ``MIN_GROUP`` counted
   documents takes the merged sketch of its language.
3. A share fails where it lies beyond ``SPREAD * (q75 - q25)`` above the group's
   q75 (for the word length also that far below its q25).  ``SHARES`` holds the least
   such distance; it decides where a group has next to no spread, as where three
   quarters of the documents hold no symbol.  A group without outliers loses nothing.
4. The cut-offs are joined to the documents by language, source and a salt, so
   that a group with a third of all rows is dealt to many tasks.

Null text: no words, fails.  Null language or source: the group ``''``.  Ties
and repeated rows are judged alike.  An empty table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from splitcraft.llm.common import SPACE_CLASS, row_key, stored, table

SPACES = " \t\n\x0b\x0c\r"
#: Words in the window that is looked for again in the same text.
WINDOW = 8
#: The base rule: fewer words fail, and more repeated words in a hundred.
MIN_WORDS, MAX_REPEATED = 20, 30
#: The fence, in spreads between the quartiles.
SPREAD = 8
#: For each share (in thousandths of words, lines or characters; the word length
#: in hundredths of a character) the least distance of a cut-off from its
#: quartile, and whether low values fail as well.
SHARES = {"symbols": (250, False), "dup_lines": (500, False), "upper": (10, False), "word_len": (10, True)}
#: Bits of a value that its bin keeps.
BIN_BITS = 8
MIN_GROUP = 50
SALTS = 32


def _words(text: Column) -> Column:
    inner = F.btrim(text, F.lit(SPACES))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, SPACE_CLASS + "+"))


def with_signals(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with its signals in the struct ``_signals``: n_words,
    word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_upper (all
    long)."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    step = docs.withColumns({
        "_words": _words(text), "_lines": lines,
        "_symbols": F.regexp_count(text, F.lit("[#*$%&|<>]")), "_upper": F.regexp_count(text, F.lit("[A-Z]")),
    })
    step = step.withColumns({
        "_n": F.size("_words"), "_chars": F.length(F.array_join("_words", "")),
        "_n_lines": F.size("_lines"), "_dup": F.size("_lines") - F.size(F.array_distinct("_lines")),
        "_hash": F.when(F.size("_words") > WINDOW, F.transform(
            F.sequence(F.lit(1), F.size("_words") - (WINDOW - 1)),
            lambda i: F.xxhash64(F.slice("_words", i, F.lit(WINDOW))))),
    }).drop("_words", "_lines")
    # only texts in which some window comes again are looked at closer
    step = step.withColumn("_again", F.when(F.size(F.array_distinct("_hash")) < F.size("_hash"), F.array_sort(
        F.transform("_hash", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))))
    step = step.withColumn("_places", F.array_sort(F.transform(F.filter("_again", lambda x, k: (
        ((k > 0) & (F.get("_again", k - 1)["h"] == x["h"]))
        | F.coalesce(F.get("_again", k + 1)["h"] == x["h"], F.lit(False)))), lambda x: x["i"])))
    # words covered: each window adds those beyond the one before it
    covered = F.aggregate(
        "_places", F.struct(F.lit(-WINDOW).alias("at"), F.lit(0).alias("n")),
        lambda a, x: F.struct(x.alias("at"), (a["n"] + F.least(F.lit(WINDOW), x - a["at"])).alias("n")), lambda a: a["n"])
    signals = {"n_words": F.col("_n"), "word_chars": F.col("_chars"), "n_symbols": F.col("_symbols"), "n_dup_lines": F.col("_dup"),
               "n_repeat_words": F.coalesce(covered, F.lit(0)), "n_lines": F.col("_n_lines"), "n_upper": F.col("_upper")}
    return step.withColumn("_signals", F.struct(*[c.cast("long").alias(k) for k, c in signals.items()])).select(
        *[F.col(f"`{c}`") for c in docs.columns], "_signals")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def shares() -> dict[str, Column]:
    """Whole numbers, so that bins and cut-offs are exact."""
    def part(a, b, times):
        return F.when(F.col(b) > 0, F.expr(f"{times} * {a} div {b}")).otherwise(F.lit(0)).cast("long")
    return {"symbols": part("n_symbols", "n_words", 1000), "dup_lines": part("n_dup_lines", "n_lines", 1000),
            "upper": part("n_upper", "word_chars", 1000), "word_len": part("word_chars", "n_words", 100)}


def bin_floor(v: Column) -> Column:
    """The least value in the bin of ``v`` (non-negative)."""
    drop = F.greatest(F.length(F.bin(v)) - BIN_BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", v, drop), drop)


def sketch(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Sketches of every share by group: ``keys..., share, bin, n``, with n the
    documents that pass the base rule (0 keeps a group that has none)."""
    long = F.explode(F.array(*[F.struct(F.lit(k).alias("share"), bin_floor(c).alias("bin")) for k, c in shares().items()]))
    counted = F.when(base_failed(), 0).otherwise(1).alias("_c")
    return rows.select(*keys, counted, long.alias("_s")).select(*keys, "_c", "_s.share", "_s.bin").groupBy(*keys, "share", "bin").agg(
        F.sum("_c").alias("n"))


def merge(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """The sketches of coarser groups."""
    return sketches.groupBy(*keys, "share", "bin").agg(F.sum("n").alias("n"))


def quartiles(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys..., share, total, q25, q75``: the bin in which the count reaches
    a quarter and three quarters of the rows."""
    by = Window.partitionBy(*keys, "share")
    run = sketches.withColumns({"reached": F.sum("n").over(by.orderBy("bin")), "total": F.sum("n").over(by)})
    return run.groupBy(*keys, "share").agg(
        F.max("total").alias("total"),
        *[F.min(F.when(4 * F.col("reached") >= q * F.col("total"), F.col("bin"))).alias(f"q{25 * q}") for q in (1, 3)])


def cutoffs(rows: DataFrame) -> DataFrame:
    """``lang, source, cut`` with ``cut`` a struct of ``<share>_high`` and, where low values fail, ``<share>_low``."""
    fine = sketch(rows, ["lang", "source"])
    own = quartiles(fine, ["lang", "source"])
    wide = quartiles(merge(fine, ["lang"]), ["lang"]).select("lang", "share", F.col("q25").alias("w25"), F.col("q75").alias("w75"))
    few = F.col("total") < MIN_GROUP
    q = own.join(wide, ["lang", "share"]).select(
        "lang", "source", "share", F.when(few, F.col("w25")).otherwise(F.col("q25")).alias("q25"),
        F.when(few, F.col("w75")).otherwise(F.col("q75")).alias("q75"))
    ends = []
    for share, (slack, low) in SHARES.items():
        far = F.greatest(SPREAD * (F.col("q75") - F.col("q25")), F.lit(slack))
        ends.append(F.max(F.when(F.col("share") == share, F.col("q75") + far)).alias(f"{share}_high"))
        if low:
            ends.append(F.max(F.when(F.col("share") == share, F.col("q25") - far)).alias(f"{share}_low"))
    return q.groupBy("lang", "source").agg(*ends)


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key``, ``doc_id``, the signals, ``base_failed`` and ``kept`` of every
    row; ``key`` is that of the row (``row_key``).  The signals are written once
    to the shared folder; sketches and join read those few columns."""
    rows = with_signals(docs.select(
        row_key(id_col, text_col).alias("key"), F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col("lang"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source"), F.lit("")).alias("source"), F.col(text_col).alias("text")))
    rows = stored(rows.select("key", "doc_id", "lang", "source", "_signals.*"), "quality")
    cuts = cutoffs(rows).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = rows.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int"))
    fails = [base_failed()]
    for share, col in shares().items():
        fails.append(col > F.col(f"{share}_high"))
        if SHARES[share][1]:
            fails.append(col < F.col(f"{share}_low"))
    failed = fails[0]
    for f in fails[1:]:
        failed = failed | f
    return salted.join(cuts, ["lang", "source", "salt"]).select(
        "key", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        base_failed().alias("base_failed"), (~failed).alias("kept"))


def keep(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the rules reject."""
    rejected = judged(docs, id_col, text_col).where("not kept").select(F.col("key").alias("_llm_rejected"))
    return docs.join(rejected, row_key(id_col, text_col) == F.col("_llm_rejected"), "left_anti")


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signals and verdict of every document."""
    return judged(table(spark, sf_dir, "documents")).drop("key")


def _oracle() -> str:
    """The same in SQL: windows as strings, quartiles from sorted lists of bins."""
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    share = {"symbols": "CASE WHEN n_words > 0 THEN 1000 * n_symbols // n_words ELSE 0 END",
             "dup_lines": "CASE WHEN n_lines > 0 THEN 1000 * n_dup_lines // n_lines ELSE 0 END",
             "upper": "CASE WHEN word_chars > 0 THEN 1000 * n_upper // word_chars ELSE 0 END",
             "word_len": "CASE WHEN n_words > 0 THEN 100 * word_chars // n_words ELSE 0 END"}
    low_bits = f"greatest(length(bin({{0}})) - {BIN_BITS}, 0)"
    shares_sql = ", ".join(f"CAST({sql} AS BIGINT) AS {name}" for name, sql in share.items())
    bins = ", ".join(f"({name} >> {low_bits.format(name)}) << {low_bits.format(name)} AS b_{name}" for name in share)
    good = "FILTER (WHERE NOT base_failed)"
    quart = ", ".join(f"list_sort(list(b_{name}) {good})[CAST(ceil({q} * count(*) {good} / 4.0) AS BIGINT)] AS {name}_{q}" for name in share for q in (1, 3))
    pick = ", ".join(f"CASE WHEN f.n < {MIN_GROUP} THEN l.{name}_{q} ELSE f.{name}_{q} END AS {name}_{q}" for name in share for q in (1, 3))
    bad = []
    for name, (slack, low) in SHARES.items():
        far = f"greatest({SPREAD} * ({name}_3 - {name}_1), {slack})"
        bad.append(f"{name} > {name}_3 + {far}")
        if low:
            bad.append(f"{name} < {name}_1 - {far}")
    return f"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '{word}')) AS lines
  FROM documents),
g AS (SELECT r, i, array_to_string(words[i:i + {WINDOW - 1}], ' ') AS win FROM w, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i)),
again AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS c FROM g) WHERE c > 1),
cov AS (SELECT r, sum(least({WINDOW}, i - prev)) AS n FROM
  (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i), i - {WINDOW}) AS prev FROM again) GROUP BY r),
s AS (
  SELECT w.r, doc_id, lang, source, CAST(len(words) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words,
         len(lines) AS n_lines, length(text) - length(regexp_replace(text, '[A-Z]', '', 'g')) AS n_upper
  FROM w LEFT JOIN cov USING (r)),
p AS (SELECT *, {shares_sql}, (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEATED} * n_words) AS base_failed FROM s),
b AS (SELECT *, {bins} FROM p),
fine AS (SELECT lang, source, count(*) {good} AS n, {quart} FROM b GROUP BY lang, source),
wide AS (SELECT lang, {quart} FROM b GROUP BY lang),
cut AS (SELECT f.lang, f.source, {pick} FROM fine f JOIN wide l ON l.lang = f.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       base_failed, NOT (base_failed OR {' OR '.join(bad)}) AS kept
FROM p JOIN cut USING (lang, source)
"""


ORACLE = _oracle()
