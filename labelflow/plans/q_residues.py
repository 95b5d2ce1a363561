"""Queries: residue functions (F1-F5, F13, F15, F16), label dimension
and deterministic sampling/ids/batching (E4, E8, E9, E10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from labelflow.constants import ALPHABET, Q, TARGETS_PER_LABEL
from labelflow.functions import residues as R
from labelflow.operators import labels as LB
from labelflow.operators import sampling as S
from labelflow.operators.common import out
from labelflow.plans.fixtures import seq_table
from labelflow.plans.registry import register
from labelflow.plans.sql_base import with_

ENC = f"list_transform(string_split(sequence_align, ''), lambda x: instr('{ALPHABET}', x) - 1)"
SEED = 7
SAMPLE_CAP = 20000  # fixed value: row cap of the projection sample
BATCH = 16          # fixed value: default embedding batch size


def _split_col():
    return F.when(F.col("is_train"), F.lit("train")).otherwise(F.lit("query")).alias("split")


@register("space_residues", with_("seqs") + "select header, array_to_string(string_split(sequence, ''), ' ') as spaced from seqs")
def q_space_residues(spark, sf_dir):
    return seq_table(spark, sf_dir, with_split=False).select("header", R.space_residues("sequence").alias("spaced"))


@register("encode_residues", with_("seqs") + f"select header, array_to_string({ENC}, ',') as codes from seqs")
def q_encode_residues(spark, sf_dir):
    return seq_table(spark, sf_dir, with_split=False).select("header", F.array_join(R.encode_residues("sequence_align"), ",").alias("codes"))


@register("one_hot", with_("seqs") + f"""select header, cast((r.i - 1) * {Q} + instr('{ALPHABET}', substr(sequence_align, cast(r.i as bigint), 1)) - 1 as integer)
    as idx from seqs, range(1, 65) r(i)""")
def q_one_hot(spark, sf_dir):
    """F5 long form: one row per nonzero of the flattened one-hot (idx = pos * q + code, pos 0-based)."""
    s = seq_table(spark, sf_dir, with_split=False).select("header", R.encode_residues("sequence_align").alias("codes"))
    return s.select("header", F.posexplode("codes").alias("p", "c")).select(
        "header", (F.col("p") * Q + F.col("c")).cast("int").alias("idx"))


@register("decode_residues", with_("seqs") + f"""select header,
    array_to_string(list_transform({ENC}, lambda i: substr('{ALPHABET}', i + 1, 1)), '') as decoded,
    replace(array_to_string(list_transform({ENC}, lambda i: substr('{ALPHABET}', i + 1, 1)), ''), '-', '') as ungapped
    from seqs""")
def q_decode_residues(spark, sf_dir):
    s = seq_table(spark, sf_dir, with_split=False).select("header", R.encode_residues("sequence_align").alias("codes"))
    d = s.select("header", R.decode_residues("codes").alias("decoded"))
    return d.select("header", "decoded", R.strip_gaps("decoded").alias("ungapped"))


@register("sequence_identity", with_("seqs") + """select a.header, b.header as next_header,
    round((length(a.sequence_align) - hamming(a.sequence_align, b.sequence_align)) / length(a.sequence_align), 6) as identity
    from seqs a join seqs b on a.doc_id = b.doc_id and b.k = a.k + 1""")
def q_sequence_identity(spark, sf_dir):
    """F13 between consecutive windows of a document (an equi-join on (doc_id, k+1))."""
    s = seq_table(spark, sf_dir, with_split=False).select("doc_id", "k", "header", "sequence_align")
    nxt = s.select("doc_id", (F.col("k") - 1).alias("k"), F.col("header").alias("next_header"),
                   F.col("sequence_align").alias("next_align"))
    j = s.join(nxt, ["doc_id", "k"])
    return j.select("header", "next_header", out(R.sequence_identity("sequence_align", "next_align"), "identity"))


@register("fasta_header_id", with_("seqs") + """select split_part('>' || header || ' ' || label || ' window', ' ', 1)
    as raw, substr(split_part('>' || header || ' ' || label || ' window', ' ', 1), 2) as id, sequence from seqs""")
def q_fasta_header_id(spark, sf_dir):
    """F15 on FASTA description lines rendered from the sequence table."""
    s = seq_table(spark, sf_dir, with_split=False).select(F.concat(F.lit(">"), "header", F.lit(" "), "label", F.lit(" window")).alias("d"),
                                        "sequence")
    return s.select(F.split("d", " ")[0].alias("raw"), R.fasta_header_id("d").alias("id"), "sequence")


LABEL_DIM = "(select label, cast(dense_rank() over (order by label) - 1 as integer) as label_idx from (select distinct label from seqs where label is not null) z)"


@register("label_index", with_("seqs") + f"""select s.header, s.label, d.label_idx, d.label as label_back,
    array_to_string(list_transform(range(0, (select count(*) from {LABEL_DIM} q)), lambda i: cast(i = d.label_idx as integer)), ',')
      as label_one_hot
    from seqs s left join {LABEL_DIM} d on s.label = d.label""")
def q_label_index(spark, sf_dir):
    """C9 + F16: label -> index -> label, and the one-hot of the index."""
    s = seq_table(spark, sf_dir, with_split=False).select("header", "label")
    dim = LB.label_index(s)
    n = dim.count()  # number of classes (tiny, needed as the one-hot width)
    j = LB.one_hot_labels(s, dim, n)
    j = LB.to_label(j, dim, "label_idx", "label_back")
    return j.select("header", "label", "label_idx", "label_back", F.array_join("label_one_hot", ",").alias("label_one_hot"))


@register("distinct_labels", with_("seqs") + """select label, cast(dense_rank() over (order by label) - 1 as integer) as sorted_idx,
    cast(row_number() over (order by first_doc_id, first_k) - 1 as integer) as appearance_idx, first_doc_id, first_k
    from (select label, arg_min(doc_id, (doc_id, k)) as first_doc_id, arg_min(k, (doc_id, k)) as first_k
          from seqs where is_train group by label) z""")
def q_distinct_labels(spark, sf_dir):
    s = seq_table(spark, sf_dir).where("is_train")
    return LB.distinct_labels(s, ["doc_id", "k"])


@register("class_abundance", with_("seqs") + """select case when is_train then 'train' else 'query' end as split, label,
    count(*) as n from seqs group by 1, 2""")
def q_class_abundance(spark, sf_dir):
    return LB.class_abundance(seq_table(spark, sf_dir).select(_split_col(), "label"))


@register("dataset_sizes", with_("seqs") + """select split, cast(sum(n) as bigint) as n_rows, count(label) as n_labels,
    cast(sum(n * (n - 1) / 2) as bigint) as n_pairs from (
      select case when is_train then 'train' else 'query' end as split, label, count(*) as n from seqs group by 1, 2) z
    group by split""")
def q_dataset_sizes(spark, sf_dir):
    return LB.dataset_sizes(seq_table(spark, sf_dir).select(_split_col(), "label"))


@register("sequence_column", with_("seqs") + """select coalesce(nullif(sequence_align, ''), sequence) as seq_used, header,
    p.predictor, case when p.predictor in ('train', 'msa') then sequence_align else sequence end as train_seq
    from seqs, (values ('true'), ('train'), ('msa'), ('foundation')) p(predictor) where is_train""")
def q_sequence_column(spark, sf_dir):
    """B10 (aligned column if present, else raw) and B12 (training source column by predictor)."""
    s = seq_table(spark, sf_dir).where("is_train")
    preds = F.explode(F.array(*[F.lit(x) for x in ("true", "train", "msa", "foundation")])).alias("predictor")
    x = s.select("header", "sequence", "sequence_align", preds)
    return x.select(F.coalesce(F.nullif(F.col("sequence_align"), F.lit("")), F.col("sequence")).alias("seq_used"), "header",
                    "predictor", F.when(F.col("predictor").isin("train", "msa"), F.col("sequence_align"))
                    .otherwise(F.col("sequence")).alias("train_seq"))


@register("relabel_values", with_("seqs") + """select coalesce(m.display, x.predictor) as predictor, count(*) as n from (
    select case when is_train then 'Train' else 'True' end as predictor from seqs) x
    left join (values ('Train', 'Only Train Labels'), ('True', 'True Labels'), ('MSA', 'MSA Labels')) m(k, display)
    on x.predictor = m.k group by 1""")
def q_relabel_values(spark, sf_dir):
    s = seq_table(spark, sf_dir).select(F.when(F.col("is_train"), F.lit("Train")).otherwise(F.lit("True")).alias("predictor"))
    # fixed display names of predictors
    r = LB.relabel(s, "predictor", {"Train": "Only Train Labels", "True": "True Labels", "MSA": "MSA Labels"})
    return r.groupBy("predictor").agg(F.count(F.lit(1)).alias("n"))


@register("sample_cap", with_("seqs") + f"""select header, label from seqs
    order by md5('{SEED}:' || header), header limit {SAMPLE_CAP}""")
def q_sample_cap(spark, sf_dir):
    return S.sample_cap(seq_table(spark, sf_dir, with_split=False).select("header", "label"), SAMPLE_CAP, SEED)


@register("sequence_ids", with_("seqs") + """select header, 'gen_' || cast(row_number() over (order by doc_id, k) - 1 as varchar)
    as gen_id from seqs where not is_train""")
def q_sequence_ids(spark, sf_dir):
    s = seq_table(spark, sf_dir).where(~F.col("is_train")).select("header", "doc_id", "k")
    return S.sequence_ids(s, ["doc_id", "k"]).select("header", "gen_id")


@register("replicate_targets", with_("seqs") + f"""select label, cast(t.i as integer) as target_idx
    from (select distinct label from seqs where is_train) l, range(0, {TARGETS_PER_LABEL}) t(i)""")
def q_replicate_targets(spark, sf_dir):
    s = seq_table(spark, sf_dir).where("is_train").select("label")
    return S.replicate_targets(s, TARGETS_PER_LABEL).select("label", F.col("target_idx").cast("int").alias("target_idx"))


@register("make_batches", with_("seqs") + f"""select header, cast(rn as bigint) as batch_pos, cast(floor(rn / {BATCH}) as bigint) as batch_id
    from (select header, row_number() over (order by md5('{SEED}:' || header), header) - 1 as rn from seqs where is_train) z""")
def q_make_batches(spark, sf_dir):
    s = seq_table(spark, sf_dir).where("is_train").select("header")
    return S.make_batches(s, BATCH, SEED).select("header", "batch_pos", "batch_id")
