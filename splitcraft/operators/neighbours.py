"""Token edit distance between templates and nearest-template search.

Distances are computed only between *distinct* templates, never between
rows.  Each distinct token gets one code point (from U+4E00 to the end of
Unicode without the surrogates: 1.09 million; more raise an error), so
Spark's ``levenshtein`` on the encoded strings is the token-level edit
distance, JVM-side.

Pairs within distance D are found without comparing all template pairs:
templates become sets of numbered token q-grams, and two templates within
D edits share one of their q*D + 1 globally rarest grams (count filter +
prefix filtering), so candidates come from an equi-join on those grams and
are verified with ``levenshtein(a, b, D)``.  Templates too short for the
count bound use an equi-join on token length over [-D, D].  Nearest-k: an
anchor whose k-th nearest template is within D is final; the others widen
D (2, 4, 8, ...) in the next round (the last round, D >= every length,
compares the few remaining anchors with all templates).
"""
from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import whitespace_tokens
from ..session import materialize
from ..sources.shards import row_index

CODE_BASE, SURROGATES, SURROGATES_END, CODE_END = 0x4E00, 0xD800, 0xE000, 0x110000
CODE_SIZE = CODE_END - CODE_BASE - (SURROGATES_END - SURROGATES)
SELF_DISTANCE = 100000


def token_codes(texts: DataFrame, cols: list[str]) -> DataFrame:
    """(tok, code): one code point per distinct whitespace token."""
    toks = None
    for c in cols:
        # each template once, and its tokens by one computation (see vocab_table)
        t = texts.select(c).distinct().select(F.explode_outer(whitespace_tokens(F.col(c))).alias("tok")).where(F.col("tok").isNotNull())
        toks = t if toks is None else toks.unionByName(t)
    idx = row_index(toks.distinct(), ["tok"], "k")
    if (idx.agg(F.max("k")).first()[0] or 0) >= CODE_SIZE:
        raise ValueError("more distinct tokens than code points")
    point = F.lit(CODE_BASE) + F.col("k")
    point = point + F.when(point >= SURROGATES, SURROGATES_END - SURROGATES).otherwise(0)
    return idx.select("tok", F.decode(F.unhex(F.lpad(F.hex(point), 8, "0")), "UTF-32").alias("code"))


def encode(texts: DataFrame, col: str, codes: DataFrame, out_col: str = "enc") -> DataFrame:
    """Distinct ``col`` values with their token count and encoded string."""
    d = texts.select(col).where(F.col(col).isNotNull()).distinct()
    pos = d.select(col, F.posexplode_outer(whitespace_tokens(F.col(col))).alias("pos", "tok")).where(F.col("tok").isNotNull())
    enc = (pos.join(codes, "tok")
              .groupBy(col).agg(F.sort_array(F.collect_list(F.struct("pos", "code"))).alias("_s"))
              .select(col, F.array_join(F.transform("_s", lambda x: x["code"]), "").alias(out_col)))
    out = d.join(enc, col, "left").select(col, F.coalesce(out_col, F.lit("")).alias(out_col))
    return out.withColumn("ntok", F.length(out_col))


def token_edit_distance(a_enc, b_enc, allow_zero: bool = False, threshold: int | None = None):
    """Token-level Levenshtein of two encoded templates; 0 becomes 100000
    unless ``allow_zero``; beyond ``threshold`` gives -1."""
    d = F.levenshtein(a_enc, b_enc, threshold) if threshold is not None else F.levenshtein(a_enc, b_enc)
    return d if allow_zero else F.when(d == 0, F.lit(SELF_DISTANCE)).otherwise(d)


def _band_pairs(anchors: DataFrame, targets: DataFrame, col: str, gap: int, threshold: int | None):
    a = (anchors.select(F.col(col).alias("t1"), F.col("enc").alias("e1"), F.col("ntok").alias("n1"))
                .withColumn("_off", F.explode(F.sequence(F.lit(-gap), F.lit(gap))))
                .withColumn("_n", F.col("n1") + F.col("_off")))
    b = targets.select(F.col(col).alias("t2"), F.col("enc").alias("e2"), F.col("ntok").alias("_n"))
    p = a.join(b, "_n").where(F.col("t1") != F.col("t2"))
    d = F.levenshtein("e1", "e2", threshold) if threshold is not None else F.levenshtein("e1", "e2")
    p = p.withColumn("dist", d)
    if threshold is not None:
        p = p.where(F.col("dist") >= 0)
    p = p.withColumn("dist", F.when(F.col("dist") == 0, F.lit(SELF_DISTANCE)).otherwise(F.col("dist")))
    return p.select("t1", "t2", "dist")


Q_GRAM = 2
PAD_L, PAD_R = "\u3000", "\u3001"   # outside the token code range


def _numbered_grams(e: DataFrame, col: str) -> DataFrame:
    """(template, g): the numbered q-grams of each encoded template."""
    q = Q_GRAM
    padded = F.concat(F.lit(PAD_L * (q - 1)), F.col("enc"), F.lit(PAD_R * (q - 1)))
    ng = F.length(padded) - q + 1
    grams = e.select(col, F.posexplode(F.transform(F.sequence(F.lit(1), ng),
                                                   lambda i: F.substring(padded, i, q))).alias("pos", "gram"))
    # number repeated grams so multiset overlap becomes set overlap
    w = Window.partitionBy(col, "gram").orderBy("pos")
    return grams.select(col, F.concat_ws("#", "gram", F.row_number().over(w).cast("string")).alias("g"))


def _prefix_grams(grams: DataFrame, freq: DataFrame, col: str, d: int) -> DataFrame:
    """(template, g): the q*d + 1 rarest grams of each template by ``freq``
    (whole set when shorter).  Two templates within token edit distance d
    share at least max(|G|) - q*d q-grams (each edit breaks at most q), so,
    when that bound is positive, their prefixes share a gram (prefix
    filtering).  That holds only if both sides are ordered by the same ``freq``."""
    wp = Window.partitionBy(col).orderBy("_df", "g")
    return (grams.join(freq, "g").withColumn("_r", F.row_number().over(wp))
                 .where(F.col("_r") <= Q_GRAM * d + 1).select(col, "g"))


def _threshold_pairs(anchors: DataFrame, targets: DataFrame, col: str, d: int) -> DataFrame:
    """(t1, t2, dist) for anchor t1 and target t2 != t1 with token edit
    distance <= d, exact; every anchor is a target too.  Candidates share a prefix gram (equi-join on the
    gram); anchors too short for the count bound (|G| <= q*d) use the
    length band instead.  Distances verified with ``levenshtein(a, b, d)``."""
    q = Q_GRAM
    long_a = anchors.where(F.col("ntok") + q - 1 > q * d)
    short_a = anchors.where(F.col("ntok") + q - 1 <= q * d)
    grams = _numbered_grams(targets, col)
    freq = grams.groupBy("g").agg(F.count(F.lit(1)).alias("_df"))
    pa = _prefix_grams(_numbered_grams(long_a, col), freq, col, d).select(F.col(col).alias("t1"), "g")
    pb = _prefix_grams(grams, freq, col, d).select(F.col(col).alias("t2"), "g")
    cand = pa.join(pb, "g").where(F.col("t1") != F.col("t2")).select("t1", "t2").distinct()
    ea = long_a.select(F.col(col).alias("t1"), F.col("enc").alias("e1"), F.col("ntok").alias("n1"))
    eb = targets.select(F.col(col).alias("t2"), F.col("enc").alias("e2"), F.col("ntok").alias("n2"))
    p = (cand.join(ea, "t1").join(eb, "t2")
             .where(F.abs(F.col("n1") - F.col("n2")) <= d)
             .withColumn("dist", F.levenshtein("e1", "e2", d)).where(F.col("dist") >= 0)
             .withColumn("dist", F.when(F.col("dist") == 0, F.lit(SELF_DISTANCE)).otherwise(F.col("dist")))
             .select("t1", "t2", "dist"))
    return p.unionByName(_band_pairs(short_a, targets, col, d, d))


def template_pairs(df: DataFrame, col: str, max_dist: int) -> DataFrame:
    """(t1, t2, dist) for distinct templates t1 != t2 within token edit
    distance ``max_dist`` (both orders), without comparing all pairs."""
    codes = token_codes(df, [col])
    e = materialize(encode(df, col, codes))
    return _threshold_pairs(e, e, col, max_dist)


def kept_template_pairs(spark: SparkSession, path: str) -> DataFrame:
    """(t1, t2, dist) of the kept table at ``path``: the pairs of all runs that
    were finished (a run's templates are written last)."""
    done = spark.read.parquet(f"{path}/templates").select("run").distinct()
    return spark.read.parquet(f"{path}/pairs").join(F.broadcast(done), "run", "left_semi").select("t1", "t2", "dist")  # one row a run


def update_template_pairs(df: DataFrame, col: str, max_dist: int, path: str) -> None:
    """Bring the kept table of pairs within ``max_dist`` at ``path`` (a shared
    folder, one for each ``max_dist``) up to the templates of ``df``: only new
    templates meet the others, pairs of kept ones are not computed again.

    A run appends its pairs, then its templates; one that was cut off between
    leaves pairs that no reader sees, and is done again by the next."""
    spark = df.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    kept = fs_path(f"{path}/templates")
    mine = df.select(col).where(F.col(col).isNotNull()).distinct()
    old = None
    if kept.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(kept):
        old = spark.read.parquet(f"{path}/templates").select(col)
    new = materialize(mine if old is None else mine.join(old, col, "left_anti"))
    every = new if old is None else new.unionByName(old)
    e = materialize(encode(every, col, token_codes(every, [col])))
    found = _threshold_pairs(e.join(new, col, "left_semi"), e, col, max_dist)
    if old is not None:  # a kept template meets a new one: the same pair the other way round
        found = materialize(found)
        back = found.join(old.select(F.col(col).alias("t2")), "t2", "left_semi")
        found = found.unionByName(back.select(F.col("t2").alias("t1"), F.col("t1").alias("t2"), "dist"))
    run = F.lit(uuid.uuid4().hex).alias("run")
    found.select("t1", "t2", "dist", run).write.mode("append").parquet(f"{path}/pairs")
    new.select(col, run).write.mode("append").parquet(f"{path}/templates")


def nearest_templates(df: DataFrame, col: str, k: int, anchors: DataFrame | None = None,
                      start_gap: int = 2) -> DataFrame:
    """Exact k nearest other templates of each anchor template (default:
    every distinct template), ties broken by template text:
    (t1, t2, dist, rank)."""
    codes = token_codes(df, [col])
    e = materialize(encode(df, col, codes))
    todo = e if anchors is None else e.join(anchors.select(col).distinct(), col, "left_semi")
    max_n = e.agg(F.max("ntok")).first()[0] or 0
    w = Window.partitionBy("t1").orderBy("dist", "t2")
    done = None
    gap = start_gap
    while True:
        final_round = gap >= max_n
        pairs = _band_pairs(todo, e, col, gap, None) if final_round else _threshold_pairs(todo, e, col, gap)
        # checkpoint each round: the next round's inputs derive from this one,
        # and uncut lineage would double the plan every round
        ranked = materialize(pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k))
        if final_round:
            ok = ranked
        else:
            full = ranked.groupBy("t1").agg(F.count(F.lit(1)).alias("_c")).where(F.col("_c") >= k)
            ok = ranked.join(full.select("t1"), "t1", "left_semi")
        done = ok if done is None else done.unionByName(ok)
        if final_round:
            break
        todo = materialize(todo.join(ok.select(F.col("t1").alias(col)).distinct(), col, "left_anti"))
        if todo.limit(1).count() == 0:
            break
        gap *= 2
    return done


# ---------------------------------------------------------------------------
# neighbourhood sets
# ---------------------------------------------------------------------------
def eligible_templates(nearest: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """A template is eligible for an anchor when it is among the k nearest,
    or the nearer templates hold fewer than k rows (the reference grows its
    neighbourhood until it holds k rows).  ``counts``: (t2, c)."""
    w = Window.partitionBy("t1").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    x = nearest.join(counts, "t2", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    x = x.withColumn("_before", F.coalesce(F.sum("c").over(w), F.lit(0)))
    return x.where((F.col("rank") <= k) | (F.col("_before") < k)).drop("_before")


def expand_neighbourhood(pool: DataFrame, anchors: DataFrame, lev_col: str, k: int, id_col: str) -> DataFrame:
    """(set_id, template, dist, rank, c): the templates each anchor may draw
    from, with their row counts (anchors excluded).  The anchor's own
    template comes last (distance 100000) and is used only when all others
    together hold fewer than k rows."""
    rest = pool.join(anchors.select(id_col), id_col, "left_anti")
    counts = rest.groupBy(F.col(lev_col).alias("t2")).agg(F.count(F.lit(1)).alias("c"))
    n_temps = pool.select(lev_col).distinct().count()
    atemps = anchors.select(F.col(lev_col)).distinct()
    kk = k
    while True:
        near = nearest_templates(pool, lev_col, min(kk, max(n_temps - 1, 1)), anchors=atemps)
        selfrow = atemps.select(F.col(lev_col).alias("t1"), F.col(lev_col).alias("t2"),
                                F.lit(SELF_DISTANCE).alias("dist"), F.lit(10 ** 9).alias("rank"))
        near = near.select("t1", "t2", "dist", F.col("rank").cast("int").alias("rank")).unionByName(
            selfrow.withColumn("rank", F.col("rank").cast("int")))
        elig = eligible_templates(near, counts, k).persist()
        # satisfied: eligible rows >= k, or every template already listed
        # (the own template comes after all others, so it does not count)
        tot = elig.groupBy("t1").agg(F.sum(F.when(F.col("dist") < SELF_DISTANCE, F.col("c")).otherwise(0)).alias("_rows"),
                                     F.count(F.lit(1)).alias("_n"))
        short = tot.where((F.col("_rows") < k) & (F.col("_n") < n_temps)).limit(1).count()
        if short == 0 or kk >= n_temps:
            break
        kk *= 2
    return (anchors.select("set_id", F.col(lev_col).alias("t1"))
                   .join(elig, "t1").select("set_id", F.col("t2").alias("template"), "dist", "rank", "c"))


def _ordered_rows(rest: DataFrame, wanted: DataFrame, lev_col: str, id_col: str, seed: int) -> DataFrame:
    """(template, id, _pos): the rows of the templates ``wanted``, each template's
    in its random order."""
    from ..functions.hashing import uniform as U
    from ..session import materialize
    from .joins import template_join
    rest = template_join(rest.select(lev_col, id_col), wanted.select(F.col("template").alias(lev_col)), lev_col, "left_semi")
    ordered = row_index(rest.withColumn("_g", U(F.col(id_col), seed, "nbr", "order")), [lev_col, "_g", id_col], "_idx")
    first = ordered.groupBy(lev_col).agg(F.min("_idx").alias("_first"))
    return materialize(template_join(ordered, first, lev_col).select(
        F.col(lev_col).alias("template"), id_col, (F.col("_idx") - F.col("_first")).alias("_pos")))


def _arc_candidates(rows: DataFrame, pairs: DataFrame, id_col: str, seed: int) -> DataFrame:
    """Per pair (set, template, c, P): the first P rows of a random arc of the
    template's rows, with exponential-race keys generated in order
    (key_j = sum_{i<=j} E_i / (c - i), the order statistics of c Exp(1)
    draws), so each set reads at most P rows of any template."""
    from ..functions.hashing import uniform as U
    pairs = pairs.where(F.col("c") > 0).select("set_id", "template", "c", "P")
    pairs = pairs.withColumn("_o", F.floor(U(F.col("set_id"), seed, F.col("template"), "offset") * F.col("c")))
    pairs = pairs.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("long"), F.least(F.col("P"), F.col("c")) - 1)))
    gap = -F.log(U(F.col("set_id"), seed, F.col("template"), F.col("_j"))) / (F.col("c") - F.col("_j"))
    wj = Window.partitionBy("set_id", "template").orderBy("_j").rowsBetween(Window.unboundedPreceding, 0)
    pairs = (pairs.withColumn("_gap", gap).withColumn("key", F.sum("_gap").over(wj))
                  .withColumn("_pos", F.pmod(F.col("_o") + F.col("_j"), F.col("c"))))
    return pairs.join(rows, ["template", "_pos"]).select("set_id", "template", id_col, "key", "P", "c")


def _turns(lists: DataFrame, held: DataFrame | None, k: int) -> DataFrame:
    """The templates that each set may draw from at its turn: the fewest nearest
    ones, at least ``k`` of them, that hold ``k`` rows which no earlier set has.

    ``lists`` has (set_id, template, rank, c, complete), ``held`` (template, id,
    holder).  Rows taken before a turn are a running count over the sets in
    order, per template.  Adds ``left``, and ``total``: the rows left in all of the set's list."""
    if held is None:
        x = lists.withColumn("left", F.col("c"))
    else:
        taken = held.groupBy("template", F.col("holder").alias("set_id")).agg(F.count(F.lit(1)).alias("_n"))
        marks = taken.select("template", "set_id", "_n", F.lit(None).cast("int").alias("rank"),
                             F.lit(None).cast("long").alias("c"), F.lit(None).cast("boolean").alias("complete"))
        both = lists.select("template", "set_id", F.lit(0).cast("long").alias("_n"), "rank", "c", "complete").unionByName(marks)
        earlier = Window.partitionBy("template").orderBy("set_id").rangeBetween(Window.unboundedPreceding, -1)
        x = (both.withColumn("left", F.col("c") - F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
                 .where(F.col("rank").isNotNull()).drop("_n"))
    near = Window.partitionBy("set_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    x = x.withColumn("total", F.sum("left").over(Window.partitionBy("set_id")))
    x = x.withColumn("_before", F.coalesce(F.sum("left").over(near), F.lit(0)))
    return x.where((F.col("rank") <= k) | (F.col("_before") < k)).drop("_before")


def _picks(cand: DataFrame, turns: DataFrame, held: DataFrame | None, id_col: str, k: int) -> DataFrame:
    """(set_id, template, id, key): the ``k`` least keys of each set among rows
    of its templates that no earlier set holds."""
    avail = cand.join(turns.select("set_id", "template"), ["set_id", "template"], "left_semi")
    if held is not None:
        avail = (avail.join(held.select(id_col, "holder"), id_col, "left")
                      .where(F.col("holder").isNull() | (F.col("holder") >= F.col("set_id"))))
    w = Window.partitionBy("set_id").orderBy("key", id_col)
    return (avail.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k)
                 .select("set_id", "template", id_col, "key"))


def _holders(picks: DataFrame, id_col: str) -> DataFrame:
    """(id, template, holder): a row picked by several sets is the first one's."""
    return picks.groupBy(id_col, "template").agg(F.min("set_id").alias("holder"))


def serve_sets(lists: DataFrame, read_rows, id_col: str, k: int, seed: int = 0, start_prefix: int | None = None,
               longer=None) -> DataFrame:
    """(set_id, template, id, key): ``k`` rows for every set, as if the sets were
    served one after another in ``set_id`` order.

    At its turn a set may draw from its nearest templates, as many as hold ``k``
    rows that are still there (``_turns``), and takes those with the least keys.
    What a set gets depends on earlier sets only.  So a guess of all sets'
    picks is improved in rounds: from the holders of the guess follow the
    templates at each turn and the rows still there, and from these the picks.
    Only sets whose templates changed, or that meet a row whose holder changed,
    are computed again; set 0 is final after one round, set 1 after two at the
    latest, and sets that want different rows all at once.  Where nothing
    changes, the guess is the serial result.

    A set reads ``start_prefix`` rows of a template's arc at first, and twice as
    many whenever a row it has not read could be among its picks.
    ``read_rows(templates)`` gives (template, id, _pos); ``longer(short)`` gives
    the longer lists of the sets ``short`` (set_id) whose list holds fewer than
    ``k`` rows at their turn and is not ``complete``."""
    from ..session import materialize
    lists = materialize(lists)
    known = lists.select("template").distinct()
    rows = read_rows(known)
    prefix = None                      # (set_id, P) of sets that read more than at first
    start = F.lit(int(start_prefix or max(4 * k, 8))).cast("long")

    def with_prefix(pairs):
        if prefix is None:
            return pairs.withColumn("P", start)
        return pairs.join(prefix, "set_id", "left").withColumn("P", F.coalesce("P", start))

    picks = cand = turns = held = changed = grown = None
    while True:
        now = materialize(_turns(lists, held, k))
        short = now.where((F.col("total") < k) & ~F.col("complete")).select("set_id").distinct()
        if longer is not None and short.limit(1).count():
            short = materialize(short)
            more = materialize(longer(short))
            lists = materialize(lists.join(short, "set_id", "left_anti").unionByName(more.select(*lists.columns)))
            new = materialize(more.select("template").distinct().join(known, "template", "left_anti"))
            if new.limit(1).count():
                rows = materialize(rows.unionByName(read_rows(new)))
            known = lists.select("template").distinct()
            continue
        if picks is None:
            cand = materialize(_arc_candidates(rows, with_prefix(now), id_col, seed))
            picks = materialize(_picks(cand, now, None, id_col, k))
            turns = now
        else:
            def print_of(t):   # one value per set for its templates
                return t.groupBy("set_id").agg(F.bit_xor(F.xxhash64("template")).alias("_h"), F.count(F.lit(1)).alias("_c"))
            other = print_of(now).join(print_of(turns), ["set_id", "_h", "_c"], "left_anti").select("set_id")
            if changed is not None:
                other = other.unionByName(cand.join(changed, id_col).where(F.col("set_id") > F.col("_from")).select("set_id"))
            if grown is not None:
                other = other.unionByName(grown)
            redo = materialize(other.distinct())
            turns = now
            if redo.limit(1).count() == 0:
                # nothing moves any more; does a set have to read further?
                got = picks.groupBy("set_id").agg(F.count(F.lit(1)).alias("_got"), F.max("key").alias("_took"))
                # unread rows of a template have keys above the last one read
                used = cand.join(now.select("set_id", "template"), ["set_id", "template"], "left_semi")
                read = (used.where(F.col("P") < F.col("c")).groupBy("set_id", "template").agg(F.max("key").alias("_read"))
                            .groupBy("set_id").agg(F.min("_read").alias("_read")))
                grow = materialize(read.join(got, "set_id", "left")
                                   .where((F.coalesce("_got", F.lit(0)) < k) | (F.col("_took") > F.col("_read"))).select("set_id"))
                if grow.limit(1).count() == 0:
                    return picks
                again = with_prefix(grow).select("set_id", (F.col("P") * 2).alias("P"))
                prefix = materialize(again if prefix is None else prefix.join(grow, "set_id", "left_anti").unionByName(again))
                cand = materialize(cand.join(grow, "set_id", "left_anti").unionByName(
                    _arc_candidates(rows, with_prefix(now.join(grow, "set_id", "left_semi")), id_col, seed)))
                grown, changed = grow, None
                continue
            fresh = (now.join(redo, "set_id", "left_semi").select("set_id", "template", "c")
                        .join(cand.select("set_id", "template").distinct(), ["set_id", "template"], "left_anti"))
            cand = materialize(cand.unionByName(_arc_candidates(rows, with_prefix(fresh), id_col, seed)))
            part = _picks(cand.join(redo, "set_id", "left_semi"), now, held, id_col, k)
            picks = materialize(picks.join(redo, "set_id", "left_anti").unionByName(part))
        new_held = materialize(_holders(picks, id_col))
        old = (held if held is not None else new_held.limit(0)).select(id_col, F.col("holder").alias("_old"))
        # rows with another holder than before; sets up to the smaller one see no change
        changed = (new_held.select(id_col, F.col("holder").alias("_new")).join(old, id_col, "full_outer")
                   .where(~F.col("_new").eqNullSafe(F.col("_old"))).select(id_col, F.least("_new", "_old").alias("_from")))
        held, grown = new_held, None


def draw_anchors(pool: DataFrame, id_col: str, weights_col: str, m: int, seed: int = 0) -> DataFrame:
    """m anchors drawn without replacement with weight 1 / p(template); set
    ids follow the draw order.  The draw uses the thresholded race (only
    about 1.2 m rows are ranked); the final order is a window over the m
    anchors only."""
    from ..functions.hashing import race_key, uniform as U
    from .joins import template_join
    from .sampling import template_counts, weighted_sample
    counts = template_counts(pool, weights_col)
    pooled = template_join(pool, counts.select(weights_col, (1.0 / F.col("freq")).alias("_w")), weights_col)
    a = weighted_sample(pooled, id_col, "_w", [{"split_name": "anchors", "n": m}], class_col=weights_col, seed=seed)
    a = a.withColumn("_key", race_key(U(F.col(id_col), seed, "anchors", "draw"), F.col("_w")))
    wa = Window.partitionBy("split_name").orderBy("_key", id_col)
    return a.withColumn("set_id", (F.row_number().over(wa) - 1).cast("long")).drop("_key", "_w")


def neighbour_lists(pool: DataFrame, lev_col: str, anchor_templates: DataFrame, counts: DataFrame, k: int, n_temps: int) -> DataFrame:
    """(t1, template, rank, c, complete): the ``k`` nearest templates of each
    anchor template with their row counts.  A complete list has all templates,
    the own one last (distance 100000)."""
    near = nearest_templates(pool, lev_col, min(k, max(n_temps - 1, 1)), anchors=anchor_templates)
    near = near.select("t1", "t2", F.col("rank").cast("int").alias("rank"))
    complete = k >= n_temps - 1
    if complete:
        own = anchor_templates.select(F.col(lev_col).alias("t1"), F.col(lev_col).alias("t2"), F.lit(10 ** 9).alias("rank"))
        near = near.unionByName(own)
    return near.join(counts, "t2", "left").select("t1", F.col("t2").alias("template"), "rank",
                                                  F.coalesce("c", F.lit(0)).alias("c"), F.lit(complete).alias("complete"))


def neighbour_sets(pool: DataFrame, id_col: str, weights_col: str, lev_col: str, training_size: int,
                   set_size: int, seed: int = 0, start_prefix: int | None = None) -> DataFrame:
    """floor(floor(0.95 * size) / (k + 1)) sets: an anchor drawn with weight
    1 / p(template), plus k rows of its nearest templates; rows used by a
    set leave the pool.  Then floor(0.05 * size) uniform rows of the
    remainder form dev (set_id -1), validated on ``weights_col`` against
    the sets.  Output: (split_name, set_id, id, label).

    Sets are served in order, each from the rows left at its turn: where
    earlier sets have emptied its k nearest templates, its neighbourhood widens
    until it holds k rows (``serve_sets``), so a set is short only when the
    whole pool is used up.  Rows without a template are never drawn.
    Divergence from the sequential reference (stated): anchors are reserved first.
    """
    from ..session import materialize
    from .coverage import validate_and_fix
    from .sampling import uniform_sample

    k = set_size
    m = int(training_size * 0.95 // 1 // (k + 1))
    n_dev = int(training_size * 0.05 // 1)
    split = f"{k}_{training_size}_0_false"
    anchors = materialize(draw_anchors(pool, id_col, weights_col, m, seed).select("set_id", id_col, lev_col, weights_col))
    rest = materialize(pool.join(anchors.select(id_col), id_col, "left_anti"))
    counts = materialize(rest.groupBy(F.col(lev_col).alias("t2")).agg(F.count(F.lit(1)).alias("c")))
    n_temps = pool.where(F.col(lev_col).isNotNull()).select(lev_col).distinct().count()
    sets = anchors.select("set_id", F.col(lev_col).alias("t1"))
    size = {"k": 2 * k}

    def lists_of(wanted):
        near = neighbour_lists(pool, lev_col, wanted.select(F.col("t1").alias(lev_col)).distinct(), counts, size["k"], n_temps)
        return wanted.join(near, "t1").select("set_id", "template", "rank", "c", "complete")

    def longer(short):
        size["k"] *= 2
        return lists_of(sets.join(short, "set_id", "left_semi"))

    picks = serve_sets(lists_of(sets), lambda wanted: _ordered_rows(rest, wanted, lev_col, id_col, seed),
                       id_col, k, seed, start_prefix, longer)
    members = picks.select("set_id", id_col)
    train = anchors.select("set_id", id_col).unionByName(members).withColumn("label", F.lit(1))
    remainder = rest.join(members.select(id_col), id_col, "left_anti")
    dev = uniform_sample(remainder.select(id_col, weights_col), id_col,
                         [{"split_name": "dev", "n": n_dev}], seed=seed).select(id_col)
    dev = dev.withColumn("set_id", F.lit(-1).cast("long")).withColumn("label", F.lit(2))
    both = (train.unionByName(dev).join(pool.select(id_col, weights_col), id_col)
                 .withColumn("_g", F.lit(split)))
    kept = validate_and_fix(both, ["_g"], id_col, weights_col)
    return kept.select(F.col("_g").alias("split_name"), "set_id", id_col, "label")


def set_quality(sets: DataFrame, id_col: str, set_size: int) -> DataFrame:
    """Per set: rows, distinct ids, and ok = (rows <= k + 1 and ids unique)."""
    q = sets.where(F.col("set_id") >= 0).groupBy("set_id").agg(
        F.count(F.lit(1)).alias("rows"), F.count_distinct(id_col).alias("distinct_ids"))
    return q.withColumn("ok", (F.col("rows") <= set_size + 1) & (F.col("rows") == F.col("distinct_ids")))
