"""Queries: site and pair statistics (D4, D5, D6), site-profile generation."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.constants import TARGETS_PER_LABEL
from labelflow.functions.residues import strip_gaps
from labelflow.operators import sampling as S
from labelflow.operators import pairstats as P
from labelflow.operators import sitestats as T
from labelflow.operators.common import out
from labelflow.plans.fixtures import seq_table
from labelflow.plans.registry import register
from labelflow.plans.sql_base import pearson_sql, with_

GEN_SEED = 11


def generate_from_profile(train, labels_df, k: int = TARGETS_PER_LABEL, seed: int = GEN_SEED):
    """K sequences per label from the labelled site profile; header gen_<i> in (label, idx) order."""
    targets = S.replicate_targets(labels_df, k).withColumn(
        "target_id", F.concat_ws(":", F.col("label"), F.col("target_idx").cast("string")))
    g = T.draw_sequences(T.fit_site_models(train), targets, seed, keep=("target_idx",))
    g = S.sequence_ids(g, ["label", "target_idx"], name="header")
    return g.select("header", strip_gaps("sequence_align").alias("sequence"), "sequence_align", "label")


@register("site_frequencies", with_("fi") + "select grp, pos, aa, n, round(f, 6) as f from fi")
def q_site_frequencies(spark, sf_dir):
    f = T.site_frequencies(seq_table(spark, sf_dir, with_split=False))
    return f.select("grp", "pos", "aa", "n", out("f", "f"))


@register("pair_frequencies", with_("fij") + "select grp, i, a, j, b, n from fij")
def q_pair_frequencies(spark, sf_dir):
    return P.pair_counts(seq_table(spark, sf_dir, with_split=False))


@register("profile_generate", with_("gen") + "select header, sequence, sequence_align, label from gen")
def q_profile_generate(spark, sf_dir):
    s = seq_table(spark, sf_dir)
    tr = s.where("is_train")
    return generate_from_profile(tr, tr.select("label"))


PAIR_CORR_SQL = with_("gen", extra=(
    ("ds", "select header, label, pos, aa from sites"),
    ("ms", "select g.header, g.label, cast(r.i as integer) as pos, substr(g.sequence_align, cast(r.i as bigint), 1) as aa "
           "from gen g, range(1, 65) r(i)"),
)) + "," + pearson_sql("ds", "ms")


@register("pair_correlation", PAIR_CORR_SQL)
def q_pair_correlation(spark, sf_dir):
    """Cij Pearson, data (all windows) vs site-profile generated sequences, per label + global."""
    s = seq_table(spark, sf_dir)
    tr = s.where("is_train")
    gen = generate_from_profile(tr, tr.select("label"))
    r = P.pair_correlation(s.select("label", "sequence_align"), gen.select("label", "sequence_align"))
    return r.select("label", out("pearson", "pearson"))
