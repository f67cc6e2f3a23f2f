"""The stages in order, each against a plain version on its own input."""
import public_tokenizers as P
import pytest
import tokenizers

import corpus_pipeline
from test_near_duplicates import brute
from test_rows import plain_spans, verdicts


@pytest.mark.parametrize("table", ["small", "edge_docs", "no_docs"])
def test_stages(request, spark, tmp_path, table):
    docs = request.getfixturevalue(table)
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, "/root/testdata/sf0.001")
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        after = docs.collect()
        kept[name] = (before, after)
        if name != "encode":
            assert docs.columns == out.columns and [f.dataType for f in docs.schema] == [f.dataType for f in request.getfixturevalue(table).schema]

    def plain(rows):
        return sorted((str(r.doc_id), r.text or "", str(r.lang), str(r.source)) for r in rows)

    before, after = kept["quality_rules"]
    good = verdicts([(r.text, r.lang, r.source) for r in before])
    assert plain(after) == plain([r for r, (_, _, k) in zip(before, good) if k])

    before, after = kept["near_dedup"]
    root = brute([(r.doc_id, r.text) for r in before], corpus_pipeline.SHINGLE_WORDS, corpus_pipeline.SIMILARITY)
    assert plain(after) == plain([r for r in before if r.doc_id is None or root[r.doc_id] == r.doc_id])

    before, after = kept["private_data"]
    texts = {(r.doc_id, r.lang, r.source): r.text for r in before}
    for r in after:
        old = texts[r.doc_id, r.lang, r.source] or ""
        assert not [s for s in plain_spans(r.text or "") if s[1] < 3]
        if not plain_spans(old):
            assert (r.text or "") == old
        assert r.text is None or r.n_chars is None or r.n_chars == len(r.text) or not plain_spans(old)
    assert len(after) == len(before)

    before, after = kept["mix_sources"]
    assert set(plain(before)) == set(plain(after))
    tokens = {}
    for r in before:
        tokens[r.source or ""] = tokens.get(r.source or "", 0) + max(1, len((r.text or "").split()))
    mixed = {}
    for r in after:
        mixed[r.source or ""] = mixed.get(r.source or "", 0) + max(1, len((r.text or "").split()))
    longest = max([len((r.text or "").split()) for r in before], default=0) + 1
    assert all(tokens[s] <= mixed[s] < corpus_pipeline.REPEATS * tokens[s] + longest for s in tokens)

    before, after = kept["encode"]
    library = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    assert sorted((str(r.doc_id), list(r.ids)) for r in after) == sorted(
        (str(r.doc_id), library.encode(r.text or "", add_special_tokens=False).ids) for r in before)
    assert all(r.intact and r.n_tokens == len(r.ids) for r in after)


def test_run_equals_the_stages(spark):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.columns == ["doc_id", "ids", "n_tokens", "intact"]
    assert 4 <= len(corpus_pipeline.STAGES) <= 5 and out.count() > 100
