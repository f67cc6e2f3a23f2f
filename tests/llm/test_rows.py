"""Quality rules, private data, mixing and sharding against plain Python."""
import hashlib
import math
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from splitcraft.llm import mixing, pii, quality, sharding

WORD = re.compile("[^\x20\x09-\x0d]+")


def signals(t):
    w = WORD.findall(t or "")
    windows = [tuple(w[i:i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    covered = {j for i, x in enumerate(windows) if n[x] > 1 for j in range(i, i + 8)}
    lines = [x for x in (t or "").split("\n") if WORD.search(x)]
    return (len(w), sum(map(len, w)), len(re.findall("[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered),
            len(lines), len(re.findall("[A-Z]", t or "")))


def floor_bin(v):
    drop = max(v.bit_length() - 8, 0)
    return v >> drop << drop


def verdicts(rows):
    """(signals, base_failed, kept) of (text, lang, source) rows."""
    shares = []
    for t, lang, source in rows:
        n, chars, sym, dup, rep, lines, upper = signals(t)
        shares.append({"symbols": 1000 * sym // n if n else 0, "dup_lines": 1000 * dup // lines if lines else 0,
                       "upper": 1000 * upper // chars if chars else 0, "word_len": 100 * chars // n if n else 0})

    def quartile(group, share, q):
        values = sorted(floor_bin(shares[i][share]) for i in group)
        return values[math.ceil(q * len(values) / 4) - 1]

    fine, wide = {}, {}
    for i, (t, lang, source) in enumerate(rows):
        n, _, _, _, rep, _, _ = signals(t)
        if not (n < 20 or 100 * rep > 30 * n):
            fine.setdefault((lang or "", source or ""), []).append(i)
            wide.setdefault(lang or "", []).append(i)
    out = []
    for i, (t, lang, source) in enumerate(rows):
        n, chars, sym, dup, rep, _, _ = signals(t)
        base = n < 20 or 100 * rep > 30 * n
        bad = base
        group = fine.get((lang or "", source or ""), [])
        group = wide.get(lang or "", []) if len(group) < quality.MIN_GROUP else group
        for share, (slack, low) in quality.SHARES.items() if group else ():
            a, b = quartile(group, share, 1), quartile(group, share, 3)
            far = max(quality.SPREAD * (b - a), slack)
            bad = bad or shares[i][share] > b + far or (low and shares[i][share] < a - far)
        out.append(((n, chars, sym, dup, rep), base, not bad))
    return out


@pytest.mark.parametrize("table", ["small", "edge_docs"])
def test_quality_rules(request, table):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text", "lang", "source").collect()
    wanted = sorted(map(repr, zip([r.doc_id for r in rows], verdicts([(r.text, r.lang, r.source) for r in rows]))))
    got = sorted(repr((r.doc_id, ((r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words), r.base_failed, r.kept)))
                 for r in quality.judged(docs).collect())
    assert got == wanted
    kept = quality.keep(docs)
    assert kept.columns == docs.columns
    assert kept.count() == sum(w.endswith("True))") for w in wanted)


def test_quality_groups_have_their_own_cutoffs(spark):
    """A source that is all symbols keeps its documents; the same text is an
    outlier elsewhere."""
    plain, odd = " ".join(["word"] * 3 + [f"w{i}" for i in range(40)]), " ".join(f"<w{i}>" for i in range(40))
    rows = [(i, plain, "en", "a") for i in range(60)] + [(100 + i, odd, "en", "b") for i in range(60)] + [(200, odd, "en", "a")]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in got.items() if not k] == [200]


def test_quality_cutoffs_follow_the_spread(spark):
    """One word length is far out in a uniform source and usual in a mixed one;
    documents that fail the base rule move no cut-off."""
    def text(i, size):
        return " ".join(f"{k:0{size}d}" for k in range(i * 40, i * 40 + 40))
    rows = [(i, text(i, 5 + i % 2), "en", "even") for i in range(80)] + [(100 + i, text(i, 4 + i % 9), "en", "mixed") for i in range(80)]
    rows += [(300, text(300, 20), "en", "even"), (301, text(301, 20), "en", "mixed")]
    rows += [(400 + i, "x" * 30 + f" {i}", "en", "even") for i in range(200)]
    got = {r.doc_id: r.kept for r in quality.judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert [i for i, k in got.items() if not k and i < 400] == [300] and not any(k for i, k in got.items() if i >= 400)


def test_sketches_merge(spark, small):
    rows = quality.with_signals(small).select("lang", "source", "_signals.*")
    one = quality.sketch(rows, ["lang"])
    both = quality.merge(quality.sketch(rows.where("n_words % 2 = 0"), ["lang", "source"]).unionByName(
        quality.sketch(rows.where("n_words % 2 = 1"), ["lang", "source"])), ["lang"])
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, both.collect()))


BASE = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) < 256 for x in m.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(d := re.sub("[^0-9]", "", m)) <= 19 and luhn(d)),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15)]


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def plain_spans(t):
    return sorted((m.start(), k, m.end()) for k, (_, p, ok) in enumerate(BASE) for m in re.finditer(p, t) if ok(m[0]))


def test_base_spans_equal_the_patterns():
    import random

    rng = random.Random(2)
    for _ in range(30000):
        t = "".join(rng.choice("a1234.@+- ().9b0_é") for _ in range(rng.randint(0, 60)))
        assert pii.base_spans(t) == plain_spans(t), t
    assert pii.base_spans("a" * 300_000 + "@") == [] and pii.base_spans("1" * 100_000) == []


@pytest.mark.parametrize("sent", [0, 10 ** 6])
def test_disclosing_terms(spark, monkeypatch, sent):
    """A term that only stands near one person's address gives it away; common
    words and unrelated documents don't."""
    monkeypatch.setattr(pii, "SENT_TERMS", sent)
    rows = [(i, f"common words here then Zanzibarian person mail jo@x.example.com common words here {i}") for i in range(3)]
    rows += [(10 + i, f"common words here then other person mail someone{i}@x.example.com common") for i in range(20)]
    rows += [(50 + i, "common words here then no data at all zanzibar") for i in range(20)]
    found = {r.doc_id: r for r in pii.find_private(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    texts = dict(rows)
    for i, r in found.items():
        assert [(s.start, s.kind, s.stop) for s in r.spans] == plain_spans(texts[i])
        assert [texts[i][t.start:t.stop] for t in r.terms] == (["Zanzibarian"] if i < 3 else [])
    clean = {r.doc_id: r.text for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert clean[0] == "common words here then  person mail [EMAIL] common words here 0"
    assert clean[50] == texts[50]


@pytest.mark.parametrize("sent, times", [(0, 1), (10 ** 6, 1), (10 ** 6, 3)])
def test_disclosing_terms_anywhere_in_the_document(spark, monkeypatch, sent, times):
    """A name in the heading is tied to an address in the footer, and goes
    wherever it stands again; held against plain counts over whole documents of
    which equal texts count once, however often the table holds its rows."""
    monkeypatch.setattr(pii, "SENT_TERMS", sent)
    monkeypatch.setattr(pii, "HELD_TERMS", 50, raising=False)
    filler = " ".join(["common words here then"] * 40)
    rows = [(i, f"Zanzibarian report\n{filler} zanzibarian, {filler} mail jo@x.example.com or bo@y.example.com {i}") for i in range(3)]
    rows += [(10 + i, f"{filler} other person{'s' * (i % 3)} mail someone{i % 15}@x.example.com {filler} (quux{'abc'[i % 3]}) li jd{i % 15}{' again' * (i > 7)}") for i in range(20)]
    rows += [(50 + i, f"report {filler} no data at all or {i}") for i in range(20)] + [(70, ""), (71, None)]
    rows += [(80 + i, "only copies hold these words, mail copy@z.example.com") for i in range(4)]
    docs = spark.createDataFrame(rows * times, "doc_id long, text string").repartition(3)
    found = {r.doc_id: r for r in pii.find_private(docs).collect()}
    texts = {i: t or "" for i, t in rows}
    own, held = {}, {}
    for i, t in texts.items():
        spans = plain_spans(t)
        held[i] = {(k, t[a:b].lower()) for a, k, b in spans}
        own[i] = [(w, a, b) for m in re.finditer(r"\w+", t) for w, a, b in [(m[0].lower(), *m.span())]
                  if not any(a < e and s < b for s, _, e in spans)]
    first = {t: i for i, t in reversed(texts.items())}.values()
    d_e = Counter(e for i in first for e in held[i])
    d_t = Counter(w for i in first for w in {w for w, _, _ in own[i]})
    d_et = Counter((e, w) for i in first for e in held[i] for w in {w for w, _, _ in own[i]})
    share = {(e, w): math.log2(len(first) * n / (d_e[e] * d_t[w])) / math.log2(len(first) / d_e[e]) for (e, w), n in d_et.items() if n >= pii.SUPPORT}
    for i, r in found.items():
        wanted = [(a, b, max(share.get((e, w), 0) for e in held[i])) for w, a, b in own[i] if held[i]]
        wanted = [(a, b, round(s, 9)) for a, b, s in wanted if s >= pii.GENERALISE]
        assert [(t.start, t.stop, round(t.share, 9)) for t in r.terms] == wanted, i
    assert [texts[0][t.start:t.stop] for t in found[0].terms] == ["Zanzibarian", "zanzibarian"]
    assert any(r.terms for i, r in found.items() if 10 <= i < 30) and not any(found[80 + i].terms for i in range(4))
    clean = {r.doc_id: r.text for r in pii.sanitise(docs).collect()}
    assert "anzibarian" not in "".join(clean[i] for i in range(3)) and clean[50] == texts[50]


def test_private_data_on_edge_rows(edge_docs, no_docs):
    rows = edge_docs.select("doc_id", "text").collect()
    got = pii.find_private(edge_docs).collect()
    assert sorted((str(r.doc_id), [(s.start, s.kind, s.stop) for s in r.spans]) for r in got) == sorted(
        (str(r.doc_id), plain_spans(r.text or "")) for r in rows)
    clean = pii.sanitise(edge_docs, chars_col="n_chars")
    assert clean.schema == edge_docs.schema and clean.count() == len(rows)
    assert not any("@" in (r.text or "") or "4111" in (r.text or "") for r in clean.collect())
    assert all(r.n_chars == len(r.text) for r in clean.collect() if r.text is not None)
    assert pii.find_private(no_docs).count() == 0


def test_private_data_query_counts_each_kind(spark, edge_docs, tmp_dir):
    """Counts and digest of the registered query, whatever stands where in a text."""
    parts = {"email": "a.b@x.example.com", "ip": "10.1.2.3", "card": "4111 1111 1111 1111", "phone": "+1 (743) 555-3824"}
    orders = [("phone", "email"), ("card",), ("email", "email", "ip"), ("ip", "card", "phone", "email", "phone"), ("phone", "phone", "card", "card")]
    rows = [(100 + i, " \u6f22\U0001f600; ".join(parts[k] for k in kinds)) for i, kinds in enumerate(orders)]
    docs = edge_docs.select("doc_id", "text").unionByName(spark.createDataFrame(rows * 2, "doc_id long, text string"))
    docs.write.parquet(f"{tmp_dir}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in pii.op2_private_data(spark, tmp_dir).collect())
    wanted = []
    for r in docs.collect():
        spans = plain_spans(r.text or "")
        digest = hashlib.sha256(",".join(f"{pii.KINDS[k]}:{a}:{b}" for a, k, b in spans).encode()).hexdigest()
        wanted.append((str(r.doc_id), *[sum(k == n for _, k, _ in spans) for n in range(4)], digest))
    assert got == sorted(wanted)


def mixed(docs, **target):
    return mixing.mixture(docs, **target).toPandas()


def test_weights_meet_the_targets(small):
    docs = small
    tokens = Counter()
    for r in docs.select("source", "text").collect():
        tokens[r.source] += max(1, len(WORD.findall(r.text)))
    total = sum(tokens.values())

    def power(a):
        z = sum((n / total) ** a for n in tokens.values())
        return {s: (n / total) ** a / z for s, n in tokens.items()}

    def entropy(w):
        return -sum(x * math.log(x) for x in w.values()) / math.log(len(w))

    for target in (entropy(power(0.3)), entropy(power(0.8))):
        d = mixed(docs, entropy=target)
        w = d.groupby("source").weight.first().to_dict()
        assert abs(entropy(w) - target) < 1e-9
    for repeats in (1.2, 3.0):
        d = mixed(docs, repeats=repeats)
        w = d.groupby("source").weight.first().to_dict()
        passes = [w[s] / n for s, n in tokens.items()]
        assert abs(max(passes) / min(passes) - repeats) < 1e-6 or max(tokens.values()) / min(tokens.values()) < repeats
        assert set(d.doc_id) == {r.doc_id for r in docs.select("doc_id").collect()}


def test_mixture_is_a_budgeted_permutation(small):
    """Each pass takes rows in the order of their hash until the source's
    tokens are reached; blocks follow the place within the source's share."""
    budget = 60000
    d = mixed(small, entropy=0.99, budget=budget, blocks=8)
    own = small.select(*[c for c in small.columns]).toPandas()
    own["tokens"] = [max(1, len(WORD.findall(t))) for t in own.text]
    for source, taken in d.groupby("source"):
        goal = math.floor(taken.weight.iloc[0] * budget + 1e-6)
        all_ = own[own.source == source]
        for n, part in taken.groupby("pass"):
            assert not part.doc_id.duplicated().any()
            if n < taken["pass"].max():
                assert set(part.doc_id) == set(all_.doc_id)
        last = taken.tokens.sum()
        assert last >= goal and last - all_.tokens.max() < goal
        assert taken.block.between(0, 7).all()
        assert (taken.groupby("block").tokens.sum() < goal / 8 + 2 * all_.tokens.max()).all()
    again = mixed(small, entropy=0.99, budget=budget, blocks=8)
    assert sorted(map(tuple, d.itertuples(index=False))) == sorted(map(tuple, again.itertuples(index=False)))


@pytest.mark.parametrize("table, target", [("small", {"entropy": 0.99, "budget": 60000, "blocks": 8}), ("small", {"repeats": 2.0}),
                                           ("small", {"budget": 900, "blocks": 4}), ("edge_docs", {"repeats": 3.0, "blocks": 2})])
def test_mixture_row_by_row(request, spark, monkeypatch, table, target):
    """Every row of the mixture from a plain loop: passes over a source in the
    order of slice and hash, read until the goal, blocks by the place before."""
    monkeypatch.setattr(mixing, "SLICE_ROWS", 10)
    docs, blocks = request.getfixturevalue(table), target.get("blocks", 64)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = [(r.key, r.doc_id, r.source or "", max(1, len(WORD.findall(r.t)))) for r in
            docs.select(mixing.row_key().alias("key"), F.col("doc_id"), F.col("source"), text.alias("t")).collect()]
    weighted, _ = mixing.weights(mixing.sources(spark.createDataFrame(rows, "key long, doc_id long, source string, tokens long")),
                                 target.get("entropy"), target.get("repeats"), target.get("budget"))
    goals = {r.source: (r.goal, r.weight) for r in weighted.collect()}
    assert abs(sum(w for _, w in goals.values()) - 1) < 1e-9
    hashes = {(r.key, r.p): (r.mixed, r.place) for r in spark.createDataFrame(rows, "key long, doc_id long, source string, tokens long")
              .select("key", F.explode(F.sequence(F.lit(0), F.lit(60))).alias("p")).withColumn("mixed", F.xxhash64("key", "p", F.lit(17)))
              .withColumn("place", F.xxhash64("mixed", F.lit("block"))).collect()}
    wanted = []
    for source, (goal, weight) in goals.items():
        own = [r for r in rows if r[2] == source]
        slices, at, n = max(-(-len(own) // 10), mixing.SLICES), 0, 0
        while at < goal:
            for key, doc_id, _, tokens in sorted(own, key=lambda r: (hashes[r[0], n][0] % slices, hashes[r[0], n][0], r[0])):
                if at < goal:
                    wanted.append((str(key), str(doc_id), source, n, tokens, round(weight, 12), at * blocks // goal, hashes[key, n][1]))
                at += tokens
            n += 1
    got = [(str(r.key), str(r.doc_id), r.source, r["pass"], r.tokens, round(r.weight, 12), r.block, r.place) for r in mixing.mixture(docs, **target).collect()]
    assert sorted(got) == sorted(wanted)


def test_mixing_on_edge_rows(edge_docs, no_docs):
    out = mixing.mix(edge_docs, repeats=2.0)
    assert out.columns == edge_docs.columns
    assert {(r.doc_id, r.text) for r in out.select("doc_id", "text").collect()} == {(r.doc_id, r.text) for r in edge_docs.select("doc_id", "text").collect()}
    assert mixing.mixture(no_docs, repeats=2.0).count() == 0 and mixing.mixture(edge_docs, budget=0).count() == 0


def slow_jump(key, n):
    b, j = -1, 0
    while j < n:
        b = j
        key = (key * sharding.STEP + 1) & ((1 << 64) - 1)
        j = int((b + 1) * (float(1 << 31) / ((key >> 33) + 1)))
    return b


@pytest.mark.parametrize("table", ["small", "edge_docs", "no_docs"])
def test_shards(request, table):
    docs = request.getfixturevalue(table)
    rows = docs.select("doc_id", "text").collect()
    got = sharding.shard_layout(docs, 8).collect()

    def key(i):
        return int(hashlib.md5(("" if i is None else str(i)).encode()).hexdigest()[:15], 16)

    assert sorted((str(r.doc_id), r.size, r.text_crc32, r.shard, r.grown_shard) for r in got) == sorted(
        (str(r.doc_id), len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode()), slow_jump(key(r.doc_id), 8), slow_jump(key(r.doc_id), 9)) for r in rows)
    for shard in {r.shard for r in got}:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sum(r.shard == shard for r in got)))
    assert all(r.grown_shard in (r.shard, 8) for r in got)
    assert docs.columns == [c for c in sharding.assign_shards(docs, 8).columns if c in docs.columns]


def test_shards_are_written_whole(small, tmp_path):
    sharding.write_shards(small, str(tmp_path / "shards"), 4)
    back = small.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert back.count() == small.count() and {r.shard for r in back.select("shard").distinct().collect()} == {0, 1, 2, 3}
