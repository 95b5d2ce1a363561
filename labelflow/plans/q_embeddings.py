"""Queries on the embeddings and events tables: D8, D9, D17, D18, C10, F10, F11, F12."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.constants import ALPHABET, Q
from labelflow.functions.residues import encode_residues
from labelflow.operators import embeddings as EM
from labelflow.operators.common import out
from labelflow.operators.sampling import hash_key
from labelflow.operators.windows import consecutive_ids, running_agg
from labelflow.plans.fixtures import seq_table
from labelflow.plans.registry import register
from labelflow.plans.sql_base import with_
from labelflow.sources.tables import table

SEED = 7
PAIRS_PER_BATCH = 8
SAVE_STEPS = 100   # fixed value: log window (steps per saved loss average)
PATIENCE = 5       # fixed value: early-stopping patience
TEMPERATURE = 0.05  # fixed value: contrastive temperature


def _emb(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", "embedding")


def _weights(spark):
    d = spark.range(0, 64).select(F.col("id").cast("int").alias("dim"))
    h = spark.range(0, 16).select(F.col("id").cast("int").alias("h"))
    o = spark.range(0, 8).select(F.col("id").cast("int").alias("o"))
    # fixed rule for the supplied head weights (shape-bounded tables)
    w1 = d.join(h, how="cross").select("dim", "h", (((F.col("dim") * 31 + F.col("h") * 17) % 101 - 50) / 250.0).alias("w"))
    w2 = h.join(o, how="cross").select("h", "o", (((F.col("h") * 13 + F.col("o") * 7) % 53 - 26) / 100.0).alias("w"))
    return EM.matrix(w1, "dim", "h", "w"), EM.matrix(w2, "h", "o", "w")


@register("feature_moments", with_("emb") + """select dim, round(avg(x), 6) as mean, round(stddev_pop(x), 6) as std,
    round(case when stddev_pop(x) = 0 then 1.0 else stddev_pop(x) end, 6) as scale from emb group by dim""")
def q_feature_moments(spark, sf_dir):
    m = EM.feature_moments(_emb(spark, sf_dir), "embedding")
    return m.select("dim", out("mean", "mean"), out("std", "std"), out("scale", "scale"))


@register("standardize", with_("emb") + """select e.vec_id, e.dim, round((e.x - m.mean) / m.scale, 6) as z from emb e join (
    select dim, avg(x) as mean, case when stddev_pop(x) = 0 then 1.0 else stddev_pop(x) end as scale from emb group by dim) m
    on e.dim = m.dim""")
def q_standardize(spark, sf_dir):
    e = _emb(spark, sf_dir)
    z = EM.standardize(e, "embedding", EM.feature_moments(e, "embedding"))
    return EM.long_vectors(z, "z", ("vec_id",)).select("vec_id", "dim", out("x", "z"))


@register("l2_normalize", with_("embn") + "select vec_id, dim, round(x, 6) as x from embn")
def q_l2_normalize(spark, sf_dir):
    n = _emb(spark, sf_dir).select("vec_id", EM.l2_normalize("embedding").alias("v"))
    return EM.long_vectors(n, "v", ("vec_id",)).select("vec_id", "dim", out("x", "x"))


@register("projection_head", with_("emb", "w1", "w2") + """, hid as (
    select e.vec_id, w1.h, greatest(sum(e.x * w1.w), 0.0) as x from emb e join w1 on e.dim = w1.dim group by e.vec_id, w1.h),
    o as (select hid.vec_id, w2.o, sum(hid.x * w2.w) as x from hid join w2 on hid.h = w2.h group by hid.vec_id, w2.o)
    select o.vec_id, o.o, round(o.x / n.norm, 6) as x from o
    join (select vec_id, sqrt(sum(x * x)) as norm from o group by vec_id) n on o.vec_id = n.vec_id""")
def q_projection_head(spark, sf_dir):
    w1, w2 = _weights(spark)
    p = EM.projection_head(_emb(spark, sf_dir), "embedding", w1, w2, ("vec_id",), out="v")
    return EM.long_vectors(p, "v", ("vec_id",), dim="o").select("vec_id", "o", out("x", "x"))


POOL_SQL = with_("seqs", "emb") + f""", tv as (select cast(vec_id % {Q} as integer) as token, dim, avg(x) as v from emb group by 1, 2),
    tok as (select header, cast(instr('-ACDEFGHIKLMNPQRSTVWY', substr(sequence_align, cast(r.i as bigint), 1)) - 1 as integer) as token
            from seqs, range(1, 65) r(i) where substr(sequence_align, cast(r.i as bigint), 1) <> '-'),
    c as (select header, token, count(*) as c from tok group by 1, 2),
    n as (select header, sum(c) as n from c group by 1)
    select c.header, tv.dim, round(sum(c.c * tv.v) / max(n.n), 6) as pooled from c join tv on c.token = tv.token
    join n on c.header = n.header group by c.header, tv.dim"""


@register("masked_mean_pool", POOL_SQL)
def q_masked_mean_pool(spark, sf_dir):
    """C10 + D8: residue tokens of every window -> token vectors (mean embedding of the rows whose
    vec_id falls on that token, vec_id mod q) -> mean over unmasked (non-gap) positions."""
    e = _emb(spark, sf_dir).withColumn("token", F.pmod(F.col("vec_id"), F.lit(Q)).cast("int"))
    vectors = EM.matrix(EM.token_vectors(e, "embedding"), "token", "dim", "v")
    s = seq_table(spark, sf_dir, with_split=False).select("header", encode_residues("sequence_align").alias("codes"))
    s = s.withColumn("mask", F.transform("codes", lambda c: (c != 0).cast("int")))
    pooled = EM.masked_mean_pool(s, "codes", "mask", vectors, ("header",))
    return EM.long_vectors(pooled, "pooled", ("header",)).select("header", "dim", out("x", "pooled"))


KMER_SQL = with_("seqs") + """, k as (select header, substr(sequence, cast(r.i as bigint), 2) as kmer from seqs, range(1, 64) r(i) where r.i < length(sequence))
    select header, kmer, count(*) as n from k group by header, kmer"""


@register("kmer_counts", KMER_SQL)
def q_kmer_counts(spark, sf_dir):
    """2-mer composition of every ungapped window (the encoder's vector, its nonzero entries)."""
    letters = ALPHABET[1:]
    names = F.array(*[F.lit(a + b) for a in letters for b in letters])
    v = EM.embed_sequences(seq_table(spark, sf_dir, with_split=False), "sequence", EM.kmer_encoder(2), ("header",), out="v")
    x = v.select("header", F.posexplode("v").alias("dim", "n")).where("n > 0")
    return x.select("header", F.element_at(names, F.col("dim") + 1).alias("kmer"), F.col("n").cast("bigint").alias("n"))


LOSS_SQL = with_("embn") + f""", r as (select vec_id, label, row_number() over (partition by label order by md5('{SEED}:' || vec_id), vec_id) - 1 as rn
        from embeddings),
    p as (select vec_id, label || ':' || cast(rn // 2 as varchar) as pair_key, cast(rn % 2 as integer) as side from r),
    full_pairs as (select pair_key from p group by pair_key having count(*) = 2),
    b as (select pair_key, (row_number() over (order by md5('{SEED}:' || pair_key), pair_key) - 1) // {PAIRS_PER_BATCH} as batch_id
          from full_pairs),
    f as (select b.batch_id, p.pair_key as pair_id, p.side, e.dim, e.x from p join b on p.pair_key = b.pair_key
          join embn e on e.vec_id = p.vec_id),
    sim as (select a.batch_id, a.pair_id as pa, a.side as sa, c.pair_id as pb, c.side as sb, exp(sum(a.x * c.x) / {TEMPERATURE}) as e
            from f a join f c on a.batch_id = c.batch_id and a.dim = c.dim group by 1, 2, 3, 4, 5),
    pos as (select batch_id, pa, sa, e as pos from sim where pa = pb and sa <> sb),
    neg as (select batch_id, pa, sa, sum(e * e) as s2, avg(e) as mean_neg from sim where pa <> pb group by 1, 2, 3)
    select pos.batch_id, round(sum(-ln(pos.pos / (neg.s2 / neg.mean_neg + pos.pos))) / count(*), 6) as loss, count(*) as n_features
    from pos join neg on pos.batch_id = neg.batch_id and pos.pa = neg.pa and pos.sa = neg.sa group by pos.batch_id"""


@register("contrastive_batch_loss", LOSS_SQL)
def q_contrastive_batch_loss(spark, sf_dir):
    """D17 (+C6 re-aimed, E10): same-label rows paired consecutively in a seeded hash order (every
    row in at most one pair), pairs batched by a seeded hash, in-batch contrastive loss."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", "label")
    r = consecutive_ids(e.withColumn("_h", hash_key(SEED, "vec_id")), ["_h", "vec_id"], "rn", keys=["label"])
    p = r.select("vec_id", F.concat_ws(":", F.col("label").cast("string"), (F.col("rn") / 2).cast("long").cast("string"))
                 .alias("pair_id"), (F.col("rn") % 2).cast("int").alias("side"))
    full = p.groupBy("pair_id").agg(F.count(F.lit(1)).alias("c")).where("c = 2").select("pair_id")
    b = consecutive_ids(full.withColumn("_h", hash_key(SEED, "pair_id")), ["_h", "pair_id"], "pair_no") \
        .select("pair_id", (F.col("pair_no") / PAIRS_PER_BATCH).cast("long").alias("batch_id"))
    v = _emb(spark, sf_dir).select("vec_id", EM.l2_normalize("embedding").alias("x"))
    feat = p.join(b, "pair_id").join(v, "vec_id").select("batch_id", "pair_id", "side", "x")
    return EM.contrastive_batch_loss(feat, TEMPERATURE).select("batch_id", out("loss", "loss"), "n_features")


LOG_SQL = f"""with s as (select value, row_number() over (order by event_id) as step from events),
    w as (select cast((step - 1) // {SAVE_STEPS} as bigint) as window_id, count(*) as n, avg(value) as loss_avg from s group by 1),
    b as (select *, min(loss_avg) over (order by window_id rows between unbounded preceding and 1 preceding) as best_before,
                 min(loss_avg) over (order by window_id rows between unbounded preceding and current row) as best from w),
    i as (select *, coalesce(loss_avg < best_before, true) as improved from b),
    l as (select *, max(case when improved then window_id end) over (order by window_id rows between unbounded preceding and current row)
          as last_improved from i)
    select window_id, n, round(loss_avg, 6) as loss_avg, round(best, 6) as best_so_far, improved,
           window_id - last_improved as since_best, (window_id - last_improved) >= {PATIENCE} as stop from l"""


@register("loss_by_window", LOG_SQL)
def q_loss_by_window(spark, sf_dir):
    """The events value column read as a training-loss log in event_id order: mean per save
    window, best so far, strict improvement and the early-stopping counter (patience)."""
    ev = table(spark, sf_dir, "events").select("event_id", "value")
    st = consecutive_ids(ev, ["event_id"], "step", start=1)
    w = st.groupBy((F.floor((F.col("step") - 1) / SAVE_STEPS)).cast("long").alias("window_id")) \
        .agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("loss_avg"))
    w = running_agg(w, [], ["window_id"], ["loss_avg"], "min", exclusive=True, suffix="_before")
    w = running_agg(w, [], ["window_id"], ["loss_avg"], "min", suffix="_best")
    w = w.withColumn("improved", F.coalesce(F.col("loss_avg") < F.col("loss_avg_before"), F.lit(True)))
    w = w.withColumn("_imp_w", F.when(F.col("improved"), F.col("window_id")))
    w = running_agg(w, [], ["window_id"], ["_imp_w"], "max", suffix="_last")
    since = F.col("window_id") - F.col("_imp_w_last")
    return w.select("window_id", "n", out("loss_avg", "loss_avg"), out("loss_avg_best", "best_so_far"), "improved",
                    since.alias("since_best"), (since >= PATIENCE).alias("stop"))
