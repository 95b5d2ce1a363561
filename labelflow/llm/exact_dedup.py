"""Exact deduplication with keyed streaming state (DataFrame and SQL functions only).

A narrow fingerprint log (digest, identifier, length, content locator) is read as a stream and folded
into RocksDB-backed state keyed by the digest, without watermark, so no key ever expires. The state
holds, per digest, the row that stays with its locator, and the number of rows. Where the state
reports a hit (more than one row), the full normalised bytes are compared with those of the row that
stays; rows that differ (a digest collision) are regrouped by their bytes.

Defined cases: a null text is the empty text, and all white-space texts equal it; a null identifier
sorts after every other one and may stay; repeated rows are members of their group like any others, and of
wholly equal rows the one with the largest locator stays (all of them, where the table has no locators); an empty
table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from labelflow.llm.common import scratch, stored, stripped, text_or_empty, unused

STATE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FINGERPRINT = "digest string, id bigint, n_cp int, locator string"


def sha256_hex(norm: Column) -> Column:
    return F.sha2(norm, 256)


def _norm_rows(docs: DataFrame, digest: Callable[[Column], Column], locator: Column | None) -> DataFrame:
    text = text_or_empty()
    norm = stripped(text)
    return docs.select(F.col("doc_id").cast("bigint").alias("id"), F.length(text).alias("n_cp"),
                       (locator if locator is not None else F.lit(None).cast("string")).alias("locator"),
                       norm.alias("norm"), digest(norm).alias("digest"))


#: orders candidates: most code points first, then the smallest identifier (null last)
def _rank(id_: str = "id", n: str = "n_cp") -> Column:
    return F.struct(F.col(n).alias("n_cp"), F.coalesce(-F.col(id_), F.lit(-(2 ** 63) + 1)).alias("neg"),
                    F.col("locator").alias("locator"))


def fold_into_state(fingerprints: DataFrame, log_dir: str, state_dir: str) -> DataFrame:
    """Append the fingerprints to the log, fold the log's new files into the state, and return the state:
    one row per digest with best (n_cp, neg, locator) and group_size. Calling it again with the same
    folders goes on from the committed state."""
    spark = fingerprints.sparkSession
    fingerprints.write.mode("append").parquet(log_dir)
    session = spark.newSession()
    for key in ("spark.sql.shuffle.partitions", "spark.sql.session.timeZone"):
        session.conf.set(key, spark.conf.get(key))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", STATE)
    # a store is closed when its task has committed: local disk holds the running tasks' stores only
    session.conf.set("spark.sql.streaming.stateStore.unloadOnCommit", "true")
    stream = session.readStream.schema(FINGERPRINT).parquet(log_dir)
    query = (stream.groupBy("digest").agg(F.max(_rank()).alias("best"), F.count(F.lit(1)).alias("group_size"))
             .writeStream.format("noop").outputMode("update").option("checkpointLocation", state_dir)
             .trigger(availableNow=True).start())
    query.awaitTermination()
    state = spark.read.format("statestore").load(state_dir)
    value = state.schema["value"].dataType.names
    return state.select(F.col("key")["digest"].alias("digest"),
                        F.col("value")[value[0]].alias("best"), F.col("value")[value[1]].alias("group_size"))


def exact_groups(docs: DataFrame, digest: Callable[[Column], Column] = sha256_hex, locator: Column | None = None) -> DataFrame:
    """One row per row of docs: id, digest, n_cp, keep_id, group_size, locator of the row that stays, kept."""
    spark = docs.sparkSession
    rows = _norm_rows(docs, digest, locator)
    work = scratch(spark, "exact-dedup")
    state = fold_into_state(rows.select("digest", "id", "n_cp", "locator"), f"{work}/log", f"{work}/state")
    state = stored(state, "exact-dedup-state")
    # hits: the bytes of the staying row, fetched once per digest; single rows need no comparison
    hits = state.where("group_size > 1").select("digest", F.col("best.n_cp").alias("h_n"), F.col("best.neg").alias("h_neg"))
    full = rows.select("digest", "id", "n_cp", "locator", "norm")
    kept_bytes = (full.join(hits, "digest")
                  .where((F.col("n_cp") == F.col("h_n")) & (F.coalesce(-F.col("id"), F.lit(-(2 ** 63) + 1)) == F.col("h_neg")))
                  .groupBy("digest").agg(F.first("norm").alias("kept_norm")))
    checked = (full.join(state, "digest").join(kept_bytes.hint("shuffle_hash"), "digest", "left")
               .select("id", "digest", "n_cp", "locator", "best", "group_size",
                       F.when((F.col("group_size") > 1) & (F.col("norm") != F.col("kept_norm")), F.col("norm")).alias("other")))
    checked = stored(checked, "exact-dedup-checked")
    # digests under which different bytes met: group their rows by the bytes themselves
    mixed = checked.where("other is not null").select("digest").distinct()
    clean = checked.join(mixed, "digest", "left_anti")
    split = checked.join(mixed, "digest")
    part = split.groupBy("digest", "other").agg(F.max(_rank()).alias("p_best"), F.count(F.lit(1)).alias("p_size"))
    split = (split.alias("a").join(part.alias("b"), (F.col("a.digest") == F.col("b.digest")) & F.col("a.other").eqNullSafe(F.col("b.other")))
             .select("a.id", "a.digest", "a.n_cp", "a.locator", F.col("b.p_best").alias("best"), F.col("b.p_size").alias("group_size")))
    out = clean.select("id", "digest", "n_cp", "locator", "best", "group_size").unionByName(split)
    keep = F.when(F.col("best.neg") != -(2 ** 63) + 1, -F.col("best.neg"))
    same = keep.eqNullSafe(F.col("id")) & (F.col("n_cp") == F.col("best.n_cp")) & F.col("locator").eqNullSafe(F.col("best.locator"))
    return out.select("id", "digest", "n_cp", "locator", keep.alias("keep_id"), "group_size", F.col("best.locator").alias("keep_locator"), same.alias("kept"))


def drop_exact_copies(docs: DataFrame) -> DataFrame:
    """The documents that stay, all columns. Wholly equal rows (same identifier and text) leave one."""
    locator = locator_of(docs)
    mine, theirs = (lambda x: unused(docs, f"own {x}")), (lambda x: unused(docs, f"kept {x}"))
    if locator is not None:
        gone = exact_groups(docs, locator=locator).where("not kept").select(F.col("locator").alias(theirs("locator")))
        return docs.withColumn(mine("locator"), locator).join(gone, F.col(mine("locator")) == F.col(theirs("locator")), "left_anti").drop(mine("locator"))
    stay = exact_groups(docs).where("kept").select(*(F.col(c).alias(theirs(c)) for c in ("id", "digest", "n_cp"))).distinct()
    keyed = docs.withColumns({mine("digest"): sha256_hex(stripped(text_or_empty())), mine("n_cp"): F.length(text_or_empty())})
    joined = keyed.join(stay, F.col("doc_id").cast("bigint").eqNullSafe(F.col(theirs("id"))) & (F.col(mine("digest")) == F.col(theirs("digest"))) & (F.col(mine("n_cp")) == F.col(theirs("n_cp"))), "left_semi")
    return joined.dropDuplicates(["doc_id", mine("digest"), mine("n_cp")]).drop(mine("digest"), mine("n_cp"))


def locator_of(docs: DataFrame) -> Column | None:
    """File and row of each document, where the table comes from files."""
    try:
        docs.select("_metadata.file_path", "_metadata.row_index")
    except Exception as e:  # only an unresolved column means "not from files"
        if "UNRESOLVED_COLUMN" in str(e) or "cannot be resolved" in str(e):
            return None
        raise
    return F.concat_ws("#", F.col("_metadata.file_path"), F.col("_metadata.row_index"))
