import corpus_pipeline
from lodestar.llm import bpe, byte_conv, decontaminate, line_dedup, queries
from tests.llm import brute

SF = "/root/testdata/sf0.001"


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    net = byte_conv.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = sorted(i for i, t in rows.items() if net.scores([t.encode()])[0] >= byte_conv.THRESHOLD)
    first: dict[bytes, int] = {}
    after = {}
    for i in kept:
        lines = rows[i].encode().split(b"\n")
        keys = line_dedup.line_keys(rows[i].encode())
        long = [line_dedup.long_enough(k, 10) for k in keys]
        for k, ok in zip(keys, long, strict=True):
            if ok:
                first.setdefault(k, i)
        after[i] = b"\n".join(x for x, k, ok in zip(lines, keys, long, strict=True) if not ok or first[k] == i).decode()
    near = brute.near_components(list(after.items()))
    after = {i: t for i, t in after.items() if near[i][1] == i}
    items = [set(map(tuple, brute.shingles(r.text))) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = {i: t for i, t in after.items() if not any(s and 100 * len(s & brute.shingles(t)) >= 75 * len(s) for s in items)}
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) == set(clean) and all(r.round_trip for r in got.values())
    with open(queries.bpe_path(), "rb") as f:
        own = bpe.Vocabulary(f.read())
    assert all(bytes(got[i].ids) == own.encode_batch([t])[0] for i, t in clean.items())


def test_stages_keep_the_columns_of_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
    assert decontaminate.PERCENT == 75
