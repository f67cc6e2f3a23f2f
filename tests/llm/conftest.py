import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

LONG = "Lange Wörter ohne Ende und " * 6000
#: (doc_id, text): copies, near copies, repeats, null and empty texts, a repeated row, a long text, a text without blanks
ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf of the north woods"),
    (2, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf of the north woods"),
    (3, "the quick brown fox jumps over the lazy dog and runs away from the big bad wolf of the north wind"),
    (4, None), (5, ""), (6, " \t\n "), (7, "one"), (8, "ONE"), (9, "one two"),
    (10, "write to a.b+c@mail.example.com or 10.1.2.3 or 4111 1111 1111 1111 or +1 (743) 555-3824 now"),
    (11, "write to a.b+c@mail.example.com or 10.1.2.3 or 4111 1111 1111 1111 or +1 (743) 555-3824 soon"),
    (12, LONG), (13, "x" * 5000), (14, "line\nline\nline\n\n### $$$ <|endoftext|> ▁ é 漢字 😀 \x1c\x85 ﬁ"),
    (15, "idiot moron clown"), (16, "a b c d e f g h a b c d e f g h a b c d e f g h"), (16, "a b c d e f g h a b c d e f g h a b c d e f g h"),
    (17, "same id"), (17, "another text with the same id"), (None, "no id at all but a text"), (None, None),
]
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, kept boolean, shard string, score string, key string, "
          "row string, spans string, tokens string, bucket string, component_id string, n_words string, toxic string, label string")


@pytest.fixture(scope="session")
def edge_docs(spark):
    langs = ["en", None, "de"]
    rows = [(i, t, langs[n % 3], [None, "a", "b"][n % 2], None if t is None else len(t), None, "s", "1", "k", "r", "sp", "t", "bu", "c", "w", "1", "l")
            for n, (i, t) in enumerate(ROWS)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small(spark):
    """200 documents of the given tables."""
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
