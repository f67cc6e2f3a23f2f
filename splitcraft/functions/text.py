"""Per-row string/token functions, all native Spark expressions.

ascii_fold        Latin transliteration to ASCII (before templating)
space_separators  spaces around program separators
snake_lower       camelCase -> snake_case + lower, whitespace normalised
quoted_spans      program -> array<struct<kind,text>> of structural tokens and quoted spans
domain_prefix     prepend the domain marker taken from the example id
truncate_tokens   keep the first ``max`` tokens, then add start/end markers
rename_tokens     replace whole tokens by a per-domain map
occurs_before     both substrings present and the first occurs first
"""
from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


# ---------------------------------------------------------------------------
# ASCII folding
# ---------------------------------------------------------------------------
# Letters whose ASCII form is not their decomposition base.
MULTI_CHAR_FOLDS = [
    ("ß", "ss"), ("Æ", "AE"), ("æ", "ae"), ("Œ", "OE"), ("œ", "oe"),
    ("Ø", "O"), ("ø", "o"), ("Đ", "D"), ("đ", "d"), ("Ł", "L"), ("ł", "l"),
    ("Þ", "Th"), ("þ", "th"), ("Ð", "D"), ("ð", "d"), ("ı", "i"),
]

# General punctuation and Latin signs with their ASCII form.
PUNCTUATION_FOLDS = [
    ("\u00a0", " "), ("\u2002", " "), ("\u2003", " "), ("\u2009", " "),
    ("\u2018", "'"), ("\u2019", "'"), ("\u201b", "'"), ("\u2032", "'"),
    ("\u201c", '"'), ("\u201d", '"'), ("\u2033", '"'),
    ("\u2010", "-"), ("\u2011", "-"), ("\u2012", "-"), ("\u2013", "-"), ("\u2212", "-"),
    ("\u201a", ","), ("\u00d7", "x"), ("\u00a1", "!"), ("\u00bf", "?"),
    ("\u2039", "<"), ("\u203a", ">"),
]
MULTI_CHAR_PUNCTUATION = [
    ("\u2014", "--"), ("\u2026", "..."), ("\u201e", ",,"), ("\u00ab", "<<"), ("\u00bb", ">>"),
]

# Rule-built 1:1 table: every Latin letter in U+00C0-U+024F and
# U+1E00-U+1EFF whose canonical decomposition is one ASCII letter plus
# combining marks maps to that letter.
_LATIN_RANGES = [(0x00C0, 0x0250), (0x1E00, 0x1F00)]


def _one_to_one_table():
    src, dst = [], []
    for lo, hi in _LATIN_RANGES:
        for cp in range(lo, hi):
            ch = chr(cp)
            decomp = unicodedata.normalize("NFD", ch)
            base = decomp[0]
            if (len(decomp) > 1 and base.isascii() and base.isalpha()
                    and all(unicodedata.combining(x) for x in decomp[1:])):
                src.append(ch)
                dst.append(base)
    return "".join(src), "".join(dst)


FOLD_FROM, FOLD_TO = _one_to_one_table()
_PUNCT_FROM, _PUNCT_TO = ("".join(x) for x in zip(*PUNCTUATION_FOLDS))


def named_once(c: Column, fn) -> Column:
    """``fn(c)`` with ``c`` computed once, however often ``fn`` names it."""
    return F.element_at(F.transform(F.array(c), lambda x: fn(x)), 1)


def ascii_fold(c) -> Column:
    """Transliterate Latin letters and general punctuation to ASCII (other
    scripts stay).  Nothing of plain ASCII is folded, so such a text is left as it is."""
    def folded(t):
        out = F.translate(t, FOLD_FROM + _PUNCT_FROM, FOLD_TO + _PUNCT_TO)
        for a, b in MULTI_CHAR_FOLDS + MULTI_CHAR_PUNCTUATION:
            out = F.replace(out, F.lit(a), F.lit(b))
        return out

    return named_once(_col(c), lambda t: F.when(F.octet_length(t) == F.length(t), t).otherwise(folded(t)))


def ascii_fold_sql(expr: str) -> str:
    """DuckDB text of the same folding: each fold as a replacement, then
    strip_accents."""
    for a, b in MULTI_CHAR_FOLDS + MULTI_CHAR_PUNCTUATION + PUNCTUATION_FOLDS:
        quoted = b.replace("'", "''")
        expr = f"replace({expr}, '{a}', '{quoted}')"
    return f"strip_accents({expr})"


# ---------------------------------------------------------------------------
# Program spacing / casing
# ---------------------------------------------------------------------------
# Fixed value: signs that get spaces around them.
SEPARATOR_CLASS = r'([:.@\(\)\[\]",])'


def space_separators(c) -> Column:
    """Spaces around each of ``: . @ ( ) [ ] " ,`` and around ``^^``; runs of
    two or more whitespace characters become one space."""
    x = F.regexp_replace(_col(c), SEPARATOR_CLASS, " $1 ")
    x = F.replace(x, F.lit("^^"), F.lit(" ^^ "))
    return F.regexp_replace(x, r"\s\s+", " ")


def normalise_whitespace(c) -> Column:
    """``' '.join(x.split())``."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^\s+|\s+$", ""), r"\s+", " ")


def snake_lower(c) -> Column:
    """Insert ``_`` at each lower->upper boundary, lower-case, normalise
    whitespace (``ratingValue`` -> ``rating_value``).  One global pass is
    enough: inserted underscores cannot create new boundaries."""
    return F.lower(normalise_whitespace(F.regexp_replace(_col(c), "([a-z])([A-Z])", "$1_$2")))


def whitespace_tokens(c) -> Column:
    """``x.split()`` as an array (empty array for blank text)."""
    return F.array_remove(F.split(_col(c), r"\s+", -1), "")


# Fixed value: a quoted span of a spaced program.
QUOTED_SPAN = r'''" [0-9A-Za-z'_\-.:;,?\s]+ "'''


def quoted_spans(c) -> Column:
    """Split a program into structural tokens and quoted text spans.

    The program is first spaced with ``space_separators``.  Each quoted span
    becomes one element ``{kind:'span', text:<inner text stripped>}``; the
    quote marks themselves stay structural tokens, as in the reference
    tokenizer.  Result: ``array<struct<kind:string,text:string>>`` in text
    order.
    """
    def cut(spaced):
        # segments between spans; quotes belong to the structural side
        return F.struct(F.regexp_extract_all(spaced, F.lit(QUOTED_SPAN), 0).alias("spans"),
                        F.split(spaced, QUOTED_SPAN, -1).alias("segs"))

    def pieces(x):
        spans, segs, n = x["spans"], x["segs"], F.size(x["spans"])

        def body(i):
            seg = F.concat(F.when(i > 0, F.lit('" ')).otherwise(F.lit("")), F.element_at(segs, i + 1),
                           F.when(i < n, F.lit(' "')).otherwise(F.lit("")))
            toks = F.transform(whitespace_tokens(seg),
                               lambda t: F.struct(F.lit("tok").alias("kind"), t.alias("text")))
            span_text = F.element_at(spans, F.least(i + 1, F.greatest(n, F.lit(1))))
            inner = span_text.substr(F.lit(2), F.length(span_text) - 2)
            span = F.array(F.struct(F.lit("span").alias("kind"),
                                    F.regexp_replace(inner, r"^\s+|\s+$", "").alias("text")))
            return F.concat(toks, F.when(i < n, span).otherwise(F.array().cast("array<struct<kind:string,text:string>>")))

        return F.flatten(F.transform(F.sequence(F.lit(0), n), body))

    # both steps are named once: a lambda computes what it holds at each use
    return named_once(named_once(space_separators(c), cut), pieces)


# ---------------------------------------------------------------------------
# Domain markers, truncation
# ---------------------------------------------------------------------------
# Domain -> marker token.
DOMAIN_MARKERS = {
    "restaurants": "<rest>", "books": "<book>", "hotels": "<hotel>",
    "people": "<peopl>", "music": "<music>", "movies": "<movie>",
}


def domain_of(example_id) -> Column:
    return F.split(_col(example_id), "-", 2).getItem(0)


def domain_prefix(example_id, question, markers: dict | None = None, strict: bool = False) -> Column:
    """``marker + ' ' + question``; when the domain has no marker null, or with
    ``strict`` an error as the rows are read."""
    markers = markers or DOMAIN_MARKERS
    m = F.create_map(*[F.lit(x) for kv in markers.items() for x in kv])
    marker = F.element_at(m, domain_of(example_id))
    if strict:
        marker = F.coalesce(marker, F.raise_error(F.concat(F.lit("no marker for the domain of "), _col(example_id))))
    return F.concat(marker, F.lit(" "), _col(question))


def truncate_tokens(tokens, max_tokens: int | None, start: str | None = None,
                    end: str | None = None) -> Column:
    """Keep the first ``max_tokens`` tokens, then add the markers (so the
    result holds at most max_tokens + 2 tokens)."""
    t = _col(tokens)
    if max_tokens:
        t = F.slice(t, 1, max_tokens)
    if start is not None:
        t = F.concat(F.array(F.lit(start)), t)
    if end is not None:
        t = F.concat(t, F.array(F.lit(end)))
    return t


# ---------------------------------------------------------------------------
# Property renaming
# ---------------------------------------------------------------------------
# Token renames of crowd-sourced programs, per domain.
CROWD_RENAMES = {
    "books": {
        "param:aggregateRating.ratingCount": "param:aggregateRating.ratingCount:Number",
        "param:aggregateRating.ratingValue": "param:aggregateRating.ratingValue:Number",
        "param:id:String": "param:id:Entity(org.schema.Book:Book)",
        "param:bookFormat:Enum(EBook,AudiobookFormat,Hardcover,Paperback)":
            "param:bookFormat:Enum(AudiobookFormat,EBook,GraphicNovel,Hardcover,Paperback)",
    },
    "movies": {
        "param:aggregateRating.ratingValue": "param:aggregateRating.ratingValue:Number",
    },
    "restaurants": {
        "param:aggregateRating.reviewCount": "param:aggregateRating.reviewCount:Number",
        "param:aggregateRating.ratingValue": "param:aggregateRating.ratingValue:Number",
        "param:priceRange:String": "param:priceRange:Enum",
    },
}
# Token renames of paraphrased programs, per domain.
PARAPHRASE_RENAMES = {
    "books": {
        "param:bookFormat:Enum(EBook,AudiobookFormat,Hardcover,Paperback)":
            "param:bookFormat:Enum(AudiobookFormat,EBook,GraphicNovel,Hardcover,Paperback)",
    },
    "restaurants": {
        "param:priceRange:String": "param:priceRange:Enum",
    },
}


def _nested_map(renames: dict) -> Column:
    inner = []
    for dom, mapping in renames.items():
        inner.append(F.lit(dom))
        inner.append(F.create_map(*[F.lit(x) for kv in mapping.items() for x in kv]))
    return F.create_map(*inner)


def rename_tokens(text, domain, renames: dict) -> Column:
    """Replace whole whitespace tokens through the domain's map; tokens
    re-joined by one space (unknown domain: only whitespace normalised)."""
    m = F.element_at(_nested_map(renames), _col(domain))
    toks = whitespace_tokens(text)
    return F.array_join(F.transform(toks, lambda t: F.coalesce(F.element_at(m, t), t)), " ")


def rename_properties_crowd(text, domain) -> Column:
    return rename_tokens(text, domain, CROWD_RENAMES)


def rename_properties_para(text, domain) -> Column:
    return rename_tokens(text, domain, PARAPHRASE_RENAMES)


def occurs_before(text, a: str, b: str) -> Column:
    """Both substrings occur and the first occurrence of ``a`` precedes the
    first occurrence of ``b``."""
    x = _col(text)
    ia, ib = F.instr(x, a), F.instr(x, b)
    return (ia > 0) & (ib > 0) & (ia < ib)
