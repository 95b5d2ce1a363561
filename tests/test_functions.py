"""Column functions: residues, tokenisation, identity, FASTA header ids."""

from pyspark.sql import functions as F

from labelflow.functions import residues as R
from labelflow.functions import tokens as TK


def test_residue_round_trip(spark):
    df = spark.createDataFrame([("AC-DY",), ("",)], "s string")
    r = df.select(R.space_residues("s").alias("sp"), R.encode_residues("s").alias("c")).collect()
    assert r[0].sp == "A C - D Y" and r[0].c == [1, 2, 0, 3, 20]
    d = df.select(R.encode_residues("s").alias("c")).select(R.decode_residues("c").alias("d")).collect()
    assert d[0].d == "AC-DY"


def test_tokenize_truncates_and_pads(spark):
    df = spark.createDataFrame([("ACDEFG",), ("",)], "sequence string")
    ids, mask = TK.tokenize_fixed("sequence", 5)
    r = df.select(ids.alias("i"), mask.alias("m")).collect()
    assert r[0].i == [1, 6, 7, 8, 2] and r[0].m == [1, 1, 1, 1, 1]
    assert r[1].i == [1, 2, 0, 0, 0] and r[1].m == [1, 1, 0, 0, 0]


def test_identity_and_fasta_id(spark):
    df = spark.createDataFrame([("AC-D", "AC-E", ">sp|P1 some protein")], "a string, b string, d string")
    r = df.select(R.sequence_identity("a", "b").alias("i"), R.fasta_header_id("d").alias("h")).collect()[0]
    assert r.i == 0.75 and r.h == "sp|P1"


def test_md5_uniform_deterministic(spark):
    df = spark.range(5).withColumn("u", R.md5_uniform(3, "id"))
    a = [r.u for r in df.orderBy("id").collect()]
    b = [r.u for r in df.repartition(3).orderBy("id").collect()]
    assert a == b and all(0 <= x < 1 for x in a)


def test_token_mask_does_not_tokenise_again(spark):
    df = spark.createDataFrame([("ACDEFG",), (None,)], "sequence string")
    _, mask = TK.tokenize_fixed("sequence", 256)
    assert "split(" not in df.select(mask.alias("m"))._jdf.queryExecution().analyzed().toString()
    assert [r.n for r in df.select(F.aggregate(mask, F.lit(0), lambda a, m: a + m).alias("n")).collect()] == [8, None]
