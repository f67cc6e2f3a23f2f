"""Resampling, block anchors and fill-in-middle against plain versions."""
import hashlib
import math
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from splitcraft.llm import anchors, infill, resampling, words

SF = "/root/testdata/sf0.001"
NO_ID = -(1 << 63)


def rows_of(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.select(*cols).collect()]


def same(got, want):
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, want), key=repr)


# --- fill-in-middle -------------------------------------------------------

def plain_infill(docs):
    out = []
    for i, t in docs:
        t = t or ""
        n = len(t)
        hx = hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
        h = [int(hx[8 * k:8 * k + 8], 16) for k in range(4)]
        if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
            out.append((i, n, "plain", None, None, t))
            continue
        a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
        form = "spm" if h[3] % 100 < 20 else "psm"
        text = f"<P>{t[:a]}<S>{t[b:]}<M>{t[a:b]}" if form == "psm" else f"<S>{t[b:]}<P>{t[:a]}<M>{t[a:b]}"
        out.append((i, n, form, a, b - a, text))
    return out


@pytest.mark.parametrize("name", ["small", "edge_docs", "no_docs"])
def test_infill_equals_plain(request, name):
    docs = request.getfixturevalue(name)
    made = infill.fill_in_middle(docs)
    same(rows_of(made, "doc_id", "n", "form", "prefix", "middle", "output"), plain_infill(rows_of(docs, "doc_id", "text")))
    back = made.select("doc_id", infill.restore(made["output"], made["form"]).alias("text"))
    same(rows_of(back, "doc_id", "text"), [(i, t or "") for i, t in rows_of(docs, "doc_id", "text")])


def test_infill_with_separators_in_texts(spark):
    texts = ["a <P> b", "<S", "x<M>", "<P", "<P<S<M", ">M>S>P", "<<P>>", "a<", "<P>", "> <"]
    docs = spark.createDataFrame([(i * 7 + k, t) for k in range(7) for i, t in enumerate(texts)], "doc_id long, text string")
    made = infill.fill_in_middle(docs)
    same(rows_of(made, "doc_id", "n", "form", "prefix", "middle", "output"), plain_infill(rows_of(docs, "doc_id", "text")))
    same(rows_of(made.select("doc_id", infill.restore(made["output"], made["form"]).alias("t")), "doc_id", "t"), rows_of(docs, "doc_id", "text"))


def test_infill_by_words(spark, small):
    made = infill.fill_in_middle(small, unit="word", separators=("[pre]", "[suf]", "[mid]"), plain_percent=0)
    text = dict(rows_of(small, "doc_id", "text"))
    for r in made.collect():
        if r.form == "plain":
            continue
        p, s, m = (re.search(re.escape(x) + r"(.*?)(?=\[pre\]|\[suf\]|\[mid\]|\Z)", r.output, re.S).group(1) for x in ("[pre]", "[suf]", "[mid]"))
        assert p + m + s == text[r.doc_id]
        for left, right in ((p, m + s), (p + m, s)):  # a cut is never inside a word
            assert not (left and right) or left[-1] in " \t\n\v\f\r" or left == ""


@pytest.mark.parametrize("marks", [("<P>", "<P>", "<M>"), ("ab", "bc", "x"), ("aa", "b", "c"), ("", "b", "c"), ("abc", "b", "x")])
def test_separators_that_run_together_are_refused(marks):
    with pytest.raises(ValueError):
        infill.check_separators(marks)


KINDS = {infill.ArrayBox, infill.BitmapBox, infill.RunBox}


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 2 ** 32 - 1), st.sampled_from([0.001, 0.05, 0.3, 0.7, 0.999]), st.integers(1, 200_000))
def test_boundaries_select_like_a_sorted_list(seed, share, size):
    rng = np.random.default_rng(seed)
    flags = rng.random(size) < share
    at = np.flatnonzero(flags)
    cuts = infill.Boundaries(flags)
    assert len(cuts) == len(at)
    if len(at):
        ranks = rng.integers(0, len(at), 20)
        assert cuts.select(ranks).tolist() == at[ranks].tolist()


def test_boundaries_use_all_containers():
    rng = np.random.default_rng(1)
    boxes = {k: infill.Boundaries(f).boxes[0] for k, f in (
        (infill.ArrayBox, np.arange(65536) % 97 == 0), (infill.BitmapBox, rng.random(65536) < 0.5), (infill.RunBox, np.ones(65536, bool)))}
    assert all(type(box) is k for k, box in boxes.items())
    # three bytes a sign: no runs, many of them, then plain letters
    text = ("漢" * 40000 + "x" * 200000).encode()
    cuts = infill.Boundaries(infill.char_flags(np.frombuffer(text, np.uint8)))
    assert {type(b) for b in cuts.boxes} >= {infill.BitmapBox, infill.RunBox}
    assert cuts.select([0, 39999, 40000, 240000]).tolist() == [0, 119997, 120000, 320000]


# --- resampling -----------------------------------------------------------

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_features(text):
    ws = WORD.findall((text or "").encode().translate(LOWER))
    return len(ws), ws + [a + b" " + b for a, b in zip(ws, ws[1:])]


def plain_resampling(docs, target, percent, min_words, seed=7):
    feats = [(i, *plain_features(t)) for i, t in docs]
    counts = []
    for part in ([f for _, _, f in feats], [plain_features(t)[1] for t in target]):
        c = [0] * 10000
        for x in (x for f in part for x in f):
            c[zlib.crc32(x) % 10000] += 1
        counts.append(c)
    s, t = counts
    gain = [math.floor(1000 * math.log((y + 1) * (sum(s) + 10000) / ((x + 1) * (sum(t) + 10000)))) for x, y in zip(s, t)]
    out = []
    for i, n, f in feats:
        weight = sum(gain[zlib.crc32(x) % 10000] for x in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= min_words), key=lambda r: (-r[4], NO_ID if r[0] is None else r[0]))
    for k, r in enumerate(able[:percent * len(able) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize("name,percent,min_words,few", [("small", 25, 20, 0), ("small", 100, 1, 4096), ("small", 0, 1, 4096),
                                                        ("edge_docs", 50, 2, 4096), ("no_docs", 25, 20, 4096)])
def test_resampling_equals_plain(request, spark, monkeypatch, name, percent, min_words, few):
    monkeypatch.setattr(resampling, "FEW_KEYS", few)
    docs = request.getfixturevalue(name)
    target = spark.read.parquet(f"{SF}/benchmark.parquet").unionByName(spark.createDataFrame([(None, None)], "item_id long, text string"))
    made = resampling.resample(docs, target, percent, min_words)
    got = rows_of(made, "doc_id", "n_words", "n_features", "weight", "score", "rank")
    want = plain_resampling(rows_of(docs, "doc_id", "text"), [t for (t,) in rows_of(target, "text")], percent, min_words)
    if name == "edge_docs":  # rows with one id and equal scores: which text comes first follows from a hash
        assert sorted(r[5] for r in got if r[5]) == sorted(r[5] for r in want if r[5])
        same([r[:5] for r in got], [r[:5] for r in want])
    else:
        same(got, want)


def test_resampling_without_target_texts(spark, small):
    none = spark.createDataFrame([], "item_id long, text string")
    got = rows_of(resampling.resample(small, none, 25, 20), "doc_id", "n_words", "n_features", "weight", "score", "rank")
    same(got, plain_resampling(rows_of(small, "doc_id", "text"), [], 25, 20))


@pytest.mark.parametrize("shape", ["spread", "ties", "one", "skewed"])
def test_cutoff_is_the_kth_key(spark, monkeypatch, shape):
    monkeypatch.setattr(resampling, "FEW_KEYS", 3)
    rng = np.random.default_rng(5)
    n = 1500
    neg = {"spread": rng.integers(-10 ** 15, 10 ** 15, n), "ties": rng.integers(0, 3, n), "one": np.zeros(n, np.int64),
           "skewed": np.sort((10 ** rng.uniform(0, 17, n)).astype(np.int64))}[shape]
    keys = [(int(a), int(i) // 3, int(i) % 2) for i, a in enumerate(neg)] * 2
    df = spark.createDataFrame(keys, "neg long, id long, tie long").repartition(7)
    df = df.unionByName(df.limit(0)).persist()
    for k in (17, 2999):
        assert resampling.cutoff(df, k) == sorted(keys)[k - 1]
    assert resampling.cutoff(df, 3000) is None and resampling.cutoff(df, 0) is None


def test_weighted_median_keeps_a_quarter_on_each_side():
    rng = np.random.default_rng(3)
    for _ in range(200):
        parts = [np.sort(rng.integers(0, 1000, rng.integers(1, 60))) for _ in range(rng.integers(1, 12))]
        pivot = resampling.weighted_median([((int(p[(len(p) - 1) // 2]),), len(p)) for p in parts])[0]
        everything = np.concatenate(parts)
        n = len(everything)
        assert (everything <= pivot).sum() >= n / 4 and (everything >= pivot).sum() >= n / 4


@settings(max_examples=80, deadline=None)
@given(st.lists(st.text(alphabet="aZ09é漢 .-\n", max_size=40) | st.just("word " + "x" * 70 + " tail " + "y" * 65 + " " + "z" * 64), max_size=6))
def test_features_equal_plain_checksums(texts):
    of_words, of_pairs, first = resampling.features(pa.array(texts, pa.string()), 10000)
    for i, t in enumerate(texts):
        n, f = plain_features(t)
        a, b = first[i], first[i + 1]
        assert b - a == n
        want = [zlib.crc32(x) % 10000 for x in f]
        assert of_words[a:b].tolist() == want[:n] and of_pairs[a:b].tolist() == want[n:] + [-1] * (n > 0)


# --- block anchors --------------------------------------------------------

def plain_repeats(docs, span):
    split = re.compile(r"[^\x20\x09-\x0D]+")
    rows = [(NO_ID if i is None else i, i, split.findall(t or "")) for i, t in docs]
    least = {}
    for key, _, ws in rows:
        for s in range(len(ws) - span + 1):
            w = tuple(ws[s:s + span])
            least[w] = min(least.get(w, key), key)
    out = []
    for key, i, ws in rows:
        gone, seen = [False] * len(ws), set()
        for s in range(len(ws) - span + 1):
            w = tuple(ws[s:s + span])
            if least[w] < key or w in seen:
                gone[s:s + span] = [True] * span
            seen.add(w)
        out.append((i, len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone) if not g)))
    return out


REPEAT_COLS = ("doc_id", "n_words", "n_removed", "kept")


@pytest.mark.parametrize("name,span", [("small", 20), ("small", 7), ("edge_docs", 4), ("edge_docs", 20), ("no_docs", 20)])
def test_repeats_equal_brute_force(request, name, span):
    docs = request.getfixturevalue(name)
    made = anchors.repeats(docs, span)
    same(rows_of(made, *REPEAT_COLS), plain_repeats(rows_of(docs, "doc_id", "text"), span))
    for r in made.collect():  # spans are maximal, in order and add up
        assert sum(s.stop - s.start for s in r.spans) == r.n_removed
        assert all(a.stop < b.start for a, b in zip(r.spans, r.spans[1:])) and all(s.stop <= r.n_words for s in r.spans)


@pytest.mark.parametrize("span", [1, 2, 5, 6])
def test_repeats_at_any_offset(spark, monkeypatch, span):
    """Few words, so that passages repeat at all offsets of the blocks, in
    the same text and in others, over many chunks."""
    monkeypatch.setattr(anchors, "CHUNK_BYTES", 300)
    rng = np.random.default_rng(span)
    docs = [(int(i) if i % 9 else None, " ".join(rng.choice(list("abc"), rng.integers(0, 60)))) for i in rng.permutation(60)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    same(rows_of(anchors.repeats(df, span), *REPEAT_COLS), plain_repeats(docs, span))


def test_many_copies_of_a_passage(spark, monkeypatch):
    monkeypatch.setattr(anchors, "CHUNK_BYTES", 2000)
    passage = " ".join(f"w{i}" for i in range(70))
    docs = [(i, " ".join(f"d{i}x{j}" for j in range(i % 13)) + " " + passage + f" e{i}") for i in range(400)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(9)
    got = {r.doc_id: r for r in anchors.repeats(df).collect()}
    assert got[0].n_removed == 0 and all(got[i].n_removed == 70 for i in range(1, 400))
    assert all([(s.start, s.stop) for s in got[i].spans] == [(i % 13, i % 13 + 70)] for i in range(1, 400))


def test_texts_do_not_move_for_the_answers(spark, small):
    """The chunks are read by bucket; only answers are exchanged."""
    plan = anchors.repeats(small)._jdf.queryExecution().executedPlan().toString()
    texts = plan[plan.index("data#"):]
    scan = texts.index("FileScan")
    assert "Bucketed: true" in texts[scan:] or "SelectedBucketsCount" in texts[scan:]
    assert "Exchange" not in texts[:scan]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40), st.integers(1, 23))
def test_rolling_hash_is_that_of_the_window(values, k):
    x = np.array(values, np.uint64)
    got = anchors.rolling(x, k, anchors.FACTORS[0]).tolist()
    want = []
    for i in range(len(values) - k + 1):
        h = 0
        for v in values[i:i + k]:
            h = (h * anchors.FACTORS[0] + v) % (1 << 64)
        want.append(h)
    assert got == want


def test_planes_and_gaps_come_back():
    rng = np.random.default_rng(2)
    for kind in ("<u4", "<u8"):
        v = np.sort(rng.integers(0, np.iinfo(kind).max, 1000, dtype=kind))
        assert (anchors.ungaps(anchors.gaps(v), kind) == v).all() and (anchors.unplanes(anchors.planes(v), kind) == v).all()


def test_word_bounds_stop_at_texts():
    data, begins = words.packed(pa.array(["ab", "", "cd e", " f"], pa.string()))
    start, stop, first = words.word_bounds(data != 0x20, begins)
    assert [bytes(data[a:b]) for a, b in zip(start, stop)] == [b"ab", b"cd", b"e", b"f"] and first.tolist() == [0, 1, 1, 3, 4]
