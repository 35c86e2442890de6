import pytest
from pyspark.sql import functions as F

from lodestar.llm import byte_conv


@pytest.mark.parametrize("at", [0, 7, 19])
@pytest.mark.parametrize("length", [901, 1500])
def test_a_long_text_is_left_out_alone(spark, at, length):
    """Whichever place in hash order the long text has, whether or not it fits in the size by itself, the others stay."""
    ids = spark.range(60).withColumnRenamed("id", "doc_id")
    docs = ids.withColumn("text", F.concat(F.lit("text "), F.col("doc_id").cast("string")))
    labels = ids.withColumn("quality", (F.col("doc_id") % 2).cast("int"))
    whole = byte_conv.sample(docs, labels, size=1000)
    assert len(whole[0]) > 20 and sum(map(len, whole[0])) < 1000
    long = int(whole[0][at].split()[1])
    mixed = docs.withColumn("text", F.when(F.col("doc_id") == long, F.lit("x" * length)).otherwise(F.col("text")))
    got, held = byte_conv.sample(mixed, labels, size=1000)
    kept = [(t, y) for t, y in zip(*whole, strict=True) if t != whole[0][at]]
    if length > 1000:
        assert list(zip(got, held, strict=True)) == kept
    else:
        used, want = 0, []
        for t, y in zip(*whole, strict=True):
            t = b"x" * length if t == whole[0][at] else t
            if used + len(t) <= 1000:
                used += len(t)
                want.append((t, y))
        assert list(zip(got, held, strict=True)) == want and got[0] == (b"x" * length if at == 0 else whole[0][0])
        assert len(got) > at + 1 or at == 19


def test_a_longer_text_at_the_head_leaves_a_model(spark):
    docs = spark.createDataFrame([(k, "good words " * 5 if k % 2 else "## $$ %% " * 5) for k in range(60)], "doc_id long, text string")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    first = int(docs.join(labels, "doc_id").filter(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(byte_conv.MODULUS)) != byte_conv.HELD_OUT).orderBy(F.xxhash64("doc_id")).first().doc_id)
    docs = docs.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("x"), 5000)).otherwise(F.col("text")))
    assert len(byte_conv.sample(docs, labels, size=4000)[0]) > 40
