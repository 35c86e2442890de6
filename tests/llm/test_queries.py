import pytest

from lodestar.llm import queries
from tests.llm import brute
from tests.oracle import same

SF = "/root/testdata/sf0.001"


def rows(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_its_sql(spark, name):
    same(queries.queries()[name](spark, SF), queries.oracle_sql()[name], SF)


def test_bwt_dedup_equals_brute_force(spark):
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in queries.op2_bwt_dedup(spark, SF).collect()}
    assert got == brute.byte_dedup(rows(spark))


def test_ngram_join_equals_brute_force(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in queries.op7_ngram_join(spark, SF).collect()}
    assert got == brute.near_components(rows(spark))


def test_katz_equals_brute_force(spark):
    want = brute.katz(rows(spark))
    for r in queries.op8_katz_scoring(spark, SF).collect():
        n, known, train, base, score = want[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (n, known, train)
        assert abs(r.base_score - base) <= 1e-6 * abs(base) + 1e-9 and abs(r.score - score) <= 1e-6 * abs(score) + 1e-9


def test_bpe_equals_the_library(spark):
    import hashlib

    import numpy as np
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(queries.bpe_path())
    want = {}
    for i, t in rows(spark):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want[i] = (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids, skip_special_tokens=False).encode()).hexdigest())
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op6_bpe(spark, SF).collect()} == want


def test_classifier_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    from lodestar.llm import byte_conv

    got = byte_conv.score(docs, byte_conv.train(docs, labels)).filter("held_out").join(labels, "doc_id").collect()
    assert len(got) > 50 and all(0 <= r.score <= 1 for r in got)
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.9
    assert sum(r.predicted == 0 for r in got if r.quality == 1) <= 1
