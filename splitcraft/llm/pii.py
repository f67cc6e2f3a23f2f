"""Personal data: patterns, and terms that give a protected entity away.

**Base.**  E-mail addresses, IPv4 addresses, card and phone numbers by fixed
patterns, over the whole text, in time linear in its length.

**Disclosing terms.**  Every address or number found is a protected entity.  A
term (a word of a document that holds it, wherever it stands) discloses it as
far as the corpus ties the two together: with document counts N of all,
``d(e)``, ``d(t)`` and ``d(e, t)``

    PMI(e; t) = log2(N * d(e, t) / (d(e) * d(t)))      IC(e) = log2(N / d(e))

and ``PMI / IC`` is the share of the entity's information that the term gives
away, 1 if the term never stands without it.  All counts are over whole
documents, and documents with equal texts count as one in each of them: neither
a repeated row nor a copy is evidence, and a table that holds every row twice
has the marks of the one that holds it once.  A tie seen in fewer than
``SUPPORT`` different texts is no evidence.
In the documents of that entity every occurrence of a term of at least
``GENERALISE`` is replaced by a general sign, of one of at least ``REMOVE``
taken out.  Documents without an entity are left alone, and base spans always
stay.

Null or empty text: no spans; together they are one text of the N.  Rows are
told apart by doc_id and text, so that repeated ids keep their own spans; null
ids are allowed.
"""
from __future__ import annotations

import hashlib
import re
import string
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from splitcraft.llm.common import row_key, ship, stored, table

KINDS = ("email", "ip", "card", "phone", "term")
SUPPORT = 2
GENERALISE, REMOVE = 0.8, 0.95
#: Terms (and signs in them) up to which their set is sent to every worker;
#: more are counted by a shuffle of all terms.
SENT_TERMS, SENT_SIGNS = 400_000, 8_000_000
#: Distinct terms that a worker counts before it passes the counts on, and terms
#: with their places that it holds before it passes rows on.
COUNTED_TERMS, HELD_TERMS = 200_000, 200_000
#: Parts into which the rows of one entity, of one of its terms, or of one text are dealt.
SALTS = 16
#: Bits of the map of texts with copies that is sent to every worker (8 MB).
COPY_BITS = 1 << 26

_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_WORD = re.compile(r"\S+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Each at-sign once, with the local signs right before it."""
    done = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            yield start, m.end()
        done = m.end() if m else at + 1
        at = text.find("@", done)


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) by start, then kind; code points, end exclusive."""
    out = []
    if "@" in text:
        out += [(a, 0, b) for a, b in _emails(text)]
    if _DIGIT.search(text):
        if "." in text:
            out += [(m.start(), 1, m.end()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split("."))]
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and _luhn(digits):
                out.append((m.start(), 2, m.end()))
        if "+" in text:
            out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return sorted(out)


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def entity(kind: int, value: str) -> int:
    """A hash of the value as it is compared: digits alone, or in lower case."""
    import xxhash

    plain = value.lower() if kind < 2 else "".join(_DIGIT.findall(value))
    return xxhash.xxh3_64_intdigest(f"{kind}:{plain}") - (1 << 63)


def term_of(word: str) -> str:
    """A word as it is counted, '' if it holds nothing but punctuation."""
    return word.lower().strip(string.punctuation)


def text_terms(text: str, spans) -> Iterator[tuple[str, int, int]]:
    """Terms of a text with their places, none inside of base spans."""
    at, last = 0, 0  # the first span that may reach the word; what those before it reach
    for m in _WORD.finditer(text):
        word = m[0]
        term = term_of(word)
        if not term:
            continue
        a = m.start() + len(word) - len(word.lstrip(string.punctuation))
        b = m.end() - len(word) + len(word.rstrip(string.punctuation))
        while at < len(spans) and spans[at][0] < b:
            last = max(last, spans[at][2])
            at += 1
        if last <= a:
            yield term, a, b


_SPAN = "start int, kind int, stop int"
_FOUND = (f"key long, doc_id long, text_key long, spans array<struct<{_SPAN}>>, entities array<long>, "
          "words array<struct<term string, start int, stop int>>")


def _found_type() -> pa.Schema:
    span = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("stop", pa.int32())])
    word = pa.struct([("term", pa.string()), ("start", pa.int32()), ("stop", pa.int32())])
    return pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("text_key", pa.int64()), ("spans", pa.list_(span)), ("entities", pa.list_(pa.int64())), ("words", pa.list_(word))])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    doc_id = F.col(id_col).cast("long")
    return docs.select(row_key(id_col, text_col).alias("key"), doc_id.alias("doc_id"), F.xxhash64(text).alias("text_key"), text.alias("text"))


def find_base(texts: DataFrame) -> DataFrame:
    """For each row its base spans, entities, and all terms beside them."""
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = _found_type()
        for batch in batches:
            start, held, spans, entities, words = 0, 0, [], [], []
            for n, text in enumerate(batch.column(3), 1):
                text = text.as_py()
                got = base_spans(text)
                spans.append([{"start": a, "kind": k, "stop": b} for a, k, b in got])
                entities.append(sorted({entity(k, text[a:b]) for a, k, b in got}))
                words.append([{"term": t, "start": a, "stop": b} for t, a, b in text_terms(text, got)] if got else [])
                held += len(words[-1])
                if held > HELD_TERMS or n == batch.num_rows:
                    yield pa.RecordBatch.from_arrays(
                        [*(batch.column(i).slice(start, n - start) for i in range(3)),
                         *(pa.array(x, schema.field(c).type) for x, c in ((spans, "spans"), (entities, "entities"), (words, "words")))],
                        schema=schema)
                    start, held, spans, entities, words = n, 0, [], [], []

    return texts.mapInArrow(found, _FOUND)


def different_texts(texts: DataFrame, found: DataFrame) -> DataFrame:
    """One row of ``texts`` for each text.  Only texts that may have a copy are
    moved: a map of ``COPY_BITS`` bits, one for each key that occurs twice, tells
    them from all others, so what is sent has a fixed size."""
    bit = F.pmod("text_key", F.lit(COPY_BITS)) + 1  # Spark's bitmap buckets count from 1
    copied = found.groupBy("text_key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    maps = stored(copied.groupBy(F.bitmap_bucket_number(bit).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits")), "copies")
    # the bit is read by Spark itself: no second Python worker beside the one that counts
    byte = F.conv(F.hex(F.substring("bits", F.expr("cast(place div 8 as int) + 1"), F.lit(1))), 16, 10).cast("int")
    told = (texts.select("text_key", "text", F.bitmap_bucket_number(bit).alias("bucket"), F.bitmap_bit_position(bit).alias("place"))
            .join(F.broadcast(maps), "bucket", "left")
            .select("text_key", "text", F.coalesce(F.getbit(byte, F.col("place") % 8) == 1, F.lit(False)).alias("several")))
    several = told.where("several").dropDuplicates(["text_key"])
    return told.where("not several").unionByName(several).select("text")


def term_documents(texts: DataFrame, terms: DataFrame) -> DataFrame:
    """``term, n``: in how many of ``texts`` each of ``terms`` stands.  A
    set of terms of checked size is sent to the workers; beyond it the counts
    of all terms are shuffled and joined."""
    size = terms.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.length("term")), F.lit(0))).first()
    few = size[0] <= SENT_TERMS and size[1] <= SENT_SIGNS
    sent = terms.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in terms.collect())) if few else None

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["term", "n"])

        wanted = sent.value if sent is not None else None
        for batch in batches:
            for text in batch.column(0):
                words = {w.strip(string.punctuation) for w in set(text.as_py().lower().split())}
                counts.update(words & wanted if wanted is not None else {w for w in words if term_of(w)})
                if len(counts) > COUNTED_TERMS:
                    yield out()
                    counts.clear()
        yield out()

    n = texts.select("text").mapInArrow(counted, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return n if few else n.join(terms, "term", "left_semi")


def _salted(df: DataFrame) -> DataFrame:
    return df.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))


def tied(once: DataFrame, d_e: DataFrame) -> DataFrame:
    """``text_key, entities, words`` of the texts that hold entities of enough
    texts for a tie; only those entities."""
    salt = F.pmod("text_key", F.lit(SALTS)).cast("int").alias("salt")
    held = (once.select("text_key", salt, F.explode("entities").alias("entity"))
            .join(_salted(d_e.where(F.col("d_e") >= SUPPORT).select("entity")), ["entity", "salt"])
            .groupBy("text_key").agg(F.collect_set("entity").alias("entities")))
    return once.select("text_key", "words").where("size(words) > 0").join(held, "text_key").select("text_key", "entities", "words")


def disclosing(found: DataFrame, ties: DataFrame, d_e: DataFrame, texts: DataFrame) -> DataFrame:
    """``entity, term, share`` of the terms that give an entity away."""
    met = ties.select(F.explode("entities").alias("entity"), F.array_distinct("words.term").alias("terms")).select("entity", F.explode("terms").alias("term"))
    pairs = stored(met.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("d_et")).where(F.col("d_et") >= SUPPORT), "pairs")
    total = found.select("text_key").distinct().count()
    d_t = term_documents(different_texts(texts, found), pairs.select("term").distinct()).withColumnRenamed("n", "d_t")
    ic = F.log2(F.lit(float(total)) / F.col("d_e"))
    pmi = F.log2(F.lit(float(total)) * F.col("d_et") / (F.col("d_e") * F.col("d_t")))
    return (pairs.join(d_e, "entity").join(d_t, "term").where(F.col("d_e") < total)
            .select("entity", "term", (pmi / ic).alias("share")).where(F.col("share") >= GENERALISE))


def find_private(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``key, doc_id, spans, terms`` of every row: base spans, and the spans of
    disclosing terms with ``share``, their share of the entity's information."""
    ship(docs.sparkSession)
    texts = _texts(docs, id_col, text_col)
    found = stored(find_base(texts), "private")
    # what one text holds is the same in each of its copies: counted and marked once
    once = found.where("size(entities) > 0").select("text_key", "entities", "words").dropDuplicates(["text_key"])
    d_e = stored(once.select(F.explode("entities").alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("d_e")), "entities")
    ties = stored(tied(once, d_e), "ties")
    shares = stored(disclosing(found, ties, d_e, texts), "disclosing")
    salt = F.pmod("text_key", F.lit(SALTS)).cast("int").alias("salt")
    marked = (ties.select("text_key", salt, F.explode("entities").alias("entity"), "words").select("text_key", "salt", "entity", F.explode("words").alias("_w"))
              .select("text_key", "salt", "entity", "_w.term", "_w.start", "_w.stop")
              .join(_salted(shares), ["entity", "term", "salt"]).groupBy("text_key", "start", "stop").agg(F.max("share").alias("share"))
              .groupBy("text_key").agg(F.array_sort(F.collect_list(F.struct("start", "stop", "share"))).alias("terms")))
    # rows of one text are dealt by their own key, which tells copies apart
    rows = found.select("doc_id", "key", "text_key", "spans", F.pmod("key", F.lit(SALTS)).cast("int").alias("salt"))
    return rows.join(_salted(marked), ["text_key", "salt"], "left").select("key", "doc_id", "spans", F.coalesce(
        "terms", F.array().cast("array<struct<start:int,stop:int,share:double>>")).alias("terms"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = None) -> DataFrame:
    """``docs`` with base spans and disclosing terms replaced or taken out of
    the text.  Texts without any stay as they are, a null one null.  A column
    ``chars_col`` gets the new text's length where the text has changed."""
    hits = (find_private(docs, id_col, text_col).where("size(spans) > 0 or size(terms) > 0")
            .select(F.col("key").alias("_llm_key"), F.col("spans").alias("_llm_spans"), F.col("terms").alias("_llm_terms")).dropDuplicates(["_llm_key"]))

    @F.pandas_udf(T.StringType())
    def cleaned(text: pd.Series, spans: pd.Series, terms: pd.Series) -> pd.Series:
        return pd.Series([t if s is None else replaced(t, s, m) for t, s, m in zip(text, spans, terms)], dtype=object)

    joined = docs.withColumn("_llm_key", row_key(id_col, text_col)).join(hits, "_llm_key", "left")
    text = F.when(F.col("_llm_spans").isNotNull(), cleaned(F.coalesce(F.col(text_col), F.lit("")), "_llm_spans", "_llm_terms")).otherwise(F.col(text_col))
    joined = joined.withColumn(text_col, text)
    if chars_col in docs.columns:
        joined = joined.withColumn(chars_col, F.when(F.col("_llm_spans").isNotNull(), F.length(text_col)).otherwise(F.col(chars_col)).cast(docs.schema[chars_col].dataType))
    return joined.select(*[F.col(f"`{c}`") for c in docs.columns])


def replaced(text: str, spans, terms) -> str:
    """The text with ``[EMAIL]`` and the like for base spans, ``[TERM]`` for
    terms that are generalised, and nothing for those that are removed."""
    marks = [(s["start"], s["stop"], f"[{KINDS[s['kind']].upper()}]") for s in spans]
    marks += [(t["start"], t["stop"], "" if t["share"] >= REMOVE else "[TERM]") for t in terms]
    out, at = [], 0
    for start, stop, sign in sorted(marks):
        if start < at:  # inside of what is gone already
            at = max(at, stop)
            continue
        out += [text[at:start], sign]
        at = stop
    return "".join(out) + text[at:]


def op2_private_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts, their digest and all spans of every document."""
    found = find_private(table(spark, sf_dir, "documents"))

    @F.pandas_udf("base_sha256 string, spans string")
    def digests(spans: pd.Series, terms: pd.Series) -> pd.DataFrame:
        base = [[(s["start"], s["kind"], s["stop"]) for s in x] for x in spans]
        both = [sorted(b + [(t["start"], KINDS.index("term"), t["stop"]) for t in m]) for b, m in zip(base, terms)]
        return pd.DataFrame({"base_sha256": [hashlib.sha256(written(b).encode()).hexdigest() for b in base],
                             "spans": [written(b) for b in both]})

    def of_kind(k: int):  # a one-argument function: filter() would pass a span's index as the 2nd
        return lambda s: s["kind"] == k

    counts = [F.size(F.filter("spans", of_kind(k))).cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    return found.select("doc_id", *counts, digests("spans", "terms").alias("_d")).select(
        "doc_id", *[f"n_{k}" for k in KINDS[:4]], "_d.base_sha256", "_d.spans")
