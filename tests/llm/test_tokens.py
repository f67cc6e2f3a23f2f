"""Token counts and BPE against the libraries themselves."""
import hashlib
import random

import numpy as np
import public_tokenizers as P
import pytest
import sentencepiece
import tokenizers

from splitcraft.llm import bpe, tokencount

SIGNS = " \n\t  abcdeeeetthhÀß漢字😀▁<>/s　ﬁ½\x1c\x85​'aaa0192²Ⅷ_-"


def random_texts(n, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(SIGNS) for _ in range(rng.randint(0, 60))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0x2FF), rng.randint(0x300, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(20))
            for _ in range(n // 2)]
    return out + ["", " ", "  ", "\n", "<s>", "a<|endoftext|>b <|endoftext|> ", "a" * 700, "▁ ▁", "the " * 2000]


def test_counts_equal_the_library():
    with open(P.path("piece_bpe_32k.model"), "rb") as f:
        model = f.read()
    texts = random_texts(3000)
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    assert tokencount.load_model(model)[1]
    assert tokencount.count_batch(texts, model) == [len(x) for x in sp.encode(texts, num_threads=1)]


def test_rounds_balance_bytes():
    sizes = [5, 5, 100, 1, 1, 1, 40, 40]
    parts = list(tokencount.rounds(sizes, 42))
    assert [i for a, b in parts for i in range(a, b)] == list(range(len(sizes)))
    assert all(sum(sizes[a:b]) <= 42 or b - a == 1 for a, b in parts)
    assert list(tokencount.rounds([])) == []


@pytest.fixture(scope="module")
def automaton():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        return bpe.Automaton(f.read())


def test_bpe_equals_the_library(automaton):
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = random_texts(3000, 2)
    wanted = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    coder = bpe.Coder(automaton)
    got = coder.encode(texts)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == wanted
    assert [coder.decode(x) for x in got] == [library.decode(x, skip_special_tokens=False) for x in wanted]


def test_bpe_long_words_equal_short_ones(automaton):
    rng = random.Random(5)
    words = [bytes(rng.randrange(256) for _ in range(rng.randint(1, 48))) for _ in range(300)] + [b"ab" * 20, b"e" * 48]
    assert automaton._short(words) == [automaton._long(w) for w in words]


def test_bpe_small_vocabulary_by_brute_force():
    """Overlapping merges of a small alphabet, merged one rank after the other."""
    import json

    signs = {b: s for s, b in bpe.byte_signs().items()}
    merges = ["a a", "aa a", "a b", "b a", "ab ab", "aa ab", "c c", "cc cc", "ba aa"]
    vocab = {signs[ord(c)]: i for i, c in enumerate("abc")}
    for m in merges:
        vocab.setdefault(m.replace(" ", ""), len(vocab))
    machine = bpe.Automaton(json.dumps({"model": {"vocab": vocab, "merges": [m.split(" ") for m in merges]}}))

    def slow(word):
        parts = list(word)
        for m in merges:
            u, v = m.split(" ")
            i = 0
            while i + 1 < len(parts):
                if parts[i] == u and parts[i + 1] == v:
                    parts[i:i + 2] = [u + v]
                i += 1
        return [vocab[p] for p in parts]

    rng = random.Random(3)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 12))) for _ in range(2000)]
    assert [np.frombuffer(x, "<u4").tolist() for x in machine.encode_words([w.encode() for w in words])] == [slow(w) for w in words]


def test_on_edge_rows(spark, edge_docs, no_docs):
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rows = [(r.doc_id, r.text or "") for r in edge_docs.select("doc_id", "text").collect()]
    got = tokencount.token_counts(edge_docs, P.path("piece_bpe_32k.model")).collect()
    assert sorted(map(repr, got)) == sorted(
        f"Row(doc_id={i}, n_bytes={len(t.encode())}, n_tokens={len(sp.encode(t))})" for i, t in rows)
    digests = bpe.round_trip_digests(edge_docs, P.path("byte_bpe_50k.json")).collect()
    ids = {(i, t): library.encode(t, add_special_tokens=False).ids for i, t in rows}
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in digests) == sorted(
        (str(i), len(x), hashlib.sha256(np.array(x, "<u4").tobytes()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
        for (i, t), x in [((i, t), ids[i, t]) for i, t in rows])
    encoded = bpe.encode(edge_docs, P.path("byte_bpe_50k.json"), check=True)
    assert all(r.intact and r.n_tokens == len(r.ids) for r in encoded.collect())
    back = bpe.decode(encoded, P.path("byte_bpe_50k.json")).collect()
    assert sorted((str(r.doc_id), r.text) for r in back) == sorted((str(i), t) for i, t in rows)
    assert tokencount.token_counts(no_docs, P.path("piece_bpe_32k.model")).count() == 0
    assert bpe.round_trip_digests(no_docs, P.path("byte_bpe_50k.json")).count() == 0
