"""Nulls, empty and very long texts, ties, repeated rows, empty tables, clashing names."""

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from lodestar.llm import bpe, bwt_dedup, byte_conv, chat, decontaminate, katz, line_dedup, ngram_join, quality_rules, queries, warc
from tests.llm import brute

LONG = "one two three four five six seven " * 20_000
SAME = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho"
TEXTS = [(1, SAME), (2, None), (3, ""), (4, SAME), (5, LONG), (6, "x\n" + SAME + "\nlast line here"), (6, "x\n" + SAME + "\nlast line here"), (7, "éÉ 한글 \U0001f600\x1c\x85"), (None, SAME), (8, "a b"), (9, "A\tB"), (10, " \n\n ")]


def odd(spark, rows=TEXTS):
    """Documents with columns named as those that operators make."""
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return df.select("*", F.lit("s").alias("source"), F.lit(1).alias("row_fp"), F.lit(2).alias("keep"), F.lit(3).alias("class"), F.lit(4).alias("node"), F.lit(5).alias("score"), F.lit(6).alias("_row"), F.lit(7).alias("hash"), F.lit(None).cast("string").alias("lang"))


def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (4, 0, 0), (5, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


RUNS = {
    "quality": lambda s, d: byte_conv.score(d, byte_conv.train(d, labels(s))),
    "bytes": lambda s, d: bwt_dedup.dedup_digests(d),
    "rules": lambda s, d: quality_rules.apply_rules(d),
    "bpe": lambda s, d: bpe.bpe_digests(d, queries.bpe_path()),
    "near": lambda s, d: ngram_join.near_duplicates(d),
    "katz": lambda s, d: katz.score_documents(d),
    "lines": lambda s, d: line_dedup.line_digests(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_a_row_for_each_row(spark, name):
    got = RUNS[name](spark, odd(spark)).collect()
    assert sorted(map(repr, (r.doc_id for r in got))) == sorted(repr(i) for i, _ in TEXTS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(spark, name):
    assert RUNS[name](spark, odd(spark, [])).count() == 0


def test_other_operators_on_empty_tables(spark):
    b = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contaminated_pairs(odd(spark), b).count() == 0
    assert decontaminate.contaminated_pairs(odd(spark, []), b).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.format_chats(chat.text_parts(none)).count() == 0


def test_filters_keep_columns(spark):
    d = odd(spark)
    for out in (line_dedup.dedup_lines(d), ngram_join.keep_one(d), decontaminate.decontaminate(d, spark.createDataFrame([(1, LONG[:300])], "item_id long, text string")), byte_conv.keep_good(d, labels(spark))):
        assert out.columns == d.columns
        out.collect()


def test_near_duplicate_cases(spark):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(odd(spark)).collect()}
    assert got[4] == (13, 1) and got[2] == got[3][:0] + (0, 2) and got[3] == (0, 3)
    assert got[9] == (1, 8) and got[None][1] is None and got[5][1] == 5


def copies(n=40, families=3):
    """Near copies that are linked in chains, and others that share a passage only."""
    rng = np.random.default_rng(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, passage = [], " ".join(rng.choice(vocabulary, 60))
    for f in range(families):
        words = list(rng.choice(vocabulary, 200))
        for _ in range(n):
            words = list(words)
            words[int(rng.integers(200))] = str(rng.choice(vocabulary))
            rows.append(" ".join(words))
    rows += [" ".join(rng.choice(vocabulary, 60)) + " " + passage for _ in range(30)]
    return [(i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("page", [512, 8])
def test_chains_of_copies(spark, monkeypatch, page):
    monkeypatch.setattr(ngram_join, "PAGE", page)
    rows = copies()
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.near_components(rows)


def test_rtree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(1)
    points = rng.poisson(4, (400, ngram_join.GROUPS))
    points[200:] = np.maximum(points[:200] + rng.integers(-1, 2, (200, ngram_join.GROUPS)), 0)
    sizes = points.sum(1)
    tree = ngram_join.CountRTree(points, sizes)
    for q in range(0, 400, 7):
        want = np.flatnonzero(ngram_join.OF * np.minimum(points, points[q]).sum(1) >= ngram_join.NEED * (sizes + sizes[q]))
        assert sorted(tree.search(points[q], int(sizes[q])).tolist()) == want.tolist()


def test_repeats_of_bytes(spark):
    base = "abcdefghij" * 12
    rows = [(1, base), (2, "zz" + base[3:80] + "yy" + base), (3, "q" * 400), (4, "q" * 49), (5, "p" + "q" * 60), (6, None), (7, "é" * 40), (8, "xé" + "é" * 39)]
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.byte_dedup(rows)


def test_repeats_of_bytes_in_many_copies(spark):
    """Copies, parts of copies and repeated doc_ids, many to a chunk, whose first documents differ along a run."""
    rng = np.random.default_rng(5)
    passages = ["".join(rng.choice(list("abcd"), int(n))) for n in rng.integers(40, 400, 12)]
    rows = []
    for _ in range(150):
        cut = [passages[k][int(rng.integers(0, 60)) :][: int(rng.integers(30, 400))] for k in rng.integers(0, 12, int(rng.integers(1, 5)))]
        rows.append((int(rng.integers(-20, 400)), "".join(cut)))
    rows += [(None, passages[0]), (500, passages[1] * 3), (501, passages[1] * 2)]
    rows = list(dict(rows).items())
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in bwt_dedup.dedup_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    null = -(1 << 62)  # a null doc_id is smaller than all others
    assert {null if d is None else d: v for d, v in got.items()} == brute.byte_dedup([(null if d is None else d, t) for d, t in rows])


def test_repeats_of_bytes_over_parts_and_slices(spark, monkeypatch):
    """Many slices to a chunk, chunks to a task and parts to a bucket give what brute force gives; local mode's workers see other sizes by closures only, so the steps run here."""
    monkeypatch.setattr(bwt_dedup, "SLICE_BYTES", 300)
    rng = np.random.default_rng(8)
    passages = ["".join(rng.choice(list("abcdefgh "), 200)) for _ in range(8)]
    rows = [(k, "".join(passages[j][int(rng.integers(0, 90)) :] for j in rng.integers(0, 8, int(rng.integers(0, 4)))) + f"own {k}") for k in range(120)]
    dealt = [pa.table({"chunk": pa.array([c] * 40, pa.int64()), "doc_id": [d for d, _ in rows[c::3]], "row_fp": pa.array([0] * 40, pa.int64()), "text": [t for _, t in rows[c::3]]}) for c in range(3)]
    keys = pa.Table.from_batches(bwt_dedup.shared_keys(sorted_rows(bwt_dedup.anchor_keys(2)(b for t in dealt for b in t.to_batches()), "bucket", "chunk")))
    sent = pa.concat_tables(bwt_dedup.spread(2)(t, keys.filter(pa.compute.equal(keys["chunk"], c))) for c, t in enumerate(dealt))
    assert sent.num_rows == 3 + 3 * 2  # a chunk's places, and a row to each bucket
    back = pa.Table.from_batches(bwt_dedup.searched(sorted_rows(sent.to_batches(), "bucket", "chunk")))
    want = brute.byte_dedup(rows)
    for c, t in enumerate(dealt):
        for r in bwt_dedup.with_spans(t, back.filter(pa.compute.equal(back["chunk"], c))).to_pylist():
            kept, n = bwt_dedup.without(r["text"].encode(), r["spans"])
            assert (n, hashlib.sha256(kept).hexdigest()) == want[r["doc_id"]][2:]


def sorted_rows(batches, *by):
    return pa.Table.from_batches(list(batches)).sort_by([(c, "ascending") for c in by]).to_batches()


def test_rows_between_chunks_and_buckets_of_6_gb():
    """10 GB of text in 600 tasks: a task's rows are one or two for each other task, not the square of smaller pieces."""
    chunks, buckets = bwt_dedup.dealt_in(10_000_000_000, 600)
    assert chunks * buckets <= 2 * 600 * 600


def test_merge_of_transforms_orders_strings():
    rng = np.random.default_rng(2)
    runs = [rng.integers(97, 99, int(n)).astype(np.uint8) for n in rng.integers(50, 90, 30)]
    runs += [runs[k].copy() for k in range(10)]
    data = np.concatenate([np.r_[r, np.uint8(bwt_dedup.END)] for r in runs])
    sizes = np.array([len(r) + 1 for r in runs])
    begins = np.cumsum(sizes) - sizes
    doc = np.arange(len(runs))
    got = bwt_dedup.first_documents(data, begins, sizes, doc)
    first = {}
    for d, r in enumerate(runs):
        for p in range(len(r) - 49):
            first.setdefault(r[p : p + 50].tobytes(), d)
    for d, r in enumerate(runs):
        assert [first[r[p : p + 50].tobytes()] for p in range(len(r) - 49)] == got[begins[d] : begins[d] + len(r) - 49].tolist()


@pytest.mark.parametrize("hot", [1000, 10])
def test_katz_with_split_histories(spark, monkeypatch, hot):
    monkeypatch.setattr(katz, "HOT", hot)
    rows = [(i, "the cat sat on the mat the cat ran " * (i % 7) + f"word{i} the end") for i in range(60)] + [(90, None), (91, "the")]
    want = brute.katz(rows)
    for r in katz.score_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert abs(r.score - want[r.doc_id][4]) < 1e-6 and abs(r.base_score - want[r.doc_id][3]) < 1e-6


def test_lines_over_partitions(spark):
    line = "A Frequent Line, of a third of all documents"
    rows = [(i, f"own line number {i}\n{line if i % 3 else line.upper()}\nshort\nshort") for i in range(300)]
    got = {r.doc_id: r for r in line_dedup.line_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0].n_dropped == 0 and all(got[i].n_dropped == 1 for i in range(1, 300))
    assert got[7].kept_sha256 == hashlib.sha256(b"own line number 7\nshort\nshort").hexdigest()


def test_bitmaps_drop_the_right_lines():
    keep = line_dedup.zlib.compress(np.packbits(line_dedup._kept([1, 9]), bitorder="little").tobytes())
    n, dropped, text = line_dedup.kept_lines(b"\n".join(b"%d" % k for k in range(20)), keep)
    assert (n, dropped) == (20, 2) and text.split(b"\n") == [b"%d" % k for k in range(20) if k not in (1, 9)]


def test_chat_parts(spark):
    part = "struct<type:string,text:string,ref:string,tokens:bigint>"
    rows = [(1, 0, "user", [("text", "see [IMG] \\e", None, None), ("image", None, "a.png", None), ("audio", None, "b.wav", 7)]), (1, 1, "assistant", [("text", "ok</s>", None, None)]), (1, 2, None, None)]
    r = chat.format_chats(spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{part}>"))
    got = r.first()
    assert got.n_turns == 3 and [(a.turn_index, a.type, a.ref, a.tokens) for a in got.attachments] == [(0, "image", "a.png", 576), (0, "audio", "b.wav", 7)] and got.attachment_tokens == 583
    assert got.formatted.count("[IMG]") == 1 and got.formatted.count("[AUDIO]") == 1
    turns = r.select(chat.parsed(F.col("formatted")).alias("t"), chat.under_mask(F.col("formatted"), F.col("loss_spans")).alias("m")).first()
    assert [(t.role, t.text) for t in turns.t] == [("user", "see [IMG] \\e[IMG][AUDIO]"), ("assistant", "ok</s>"), ("", "")] and turns.m == "ok</s>"


def test_short_item_in_long_document(spark):
    item = "some rare test item about copper kettles and green doors that nobody else wrote"
    docs = spark.createDataFrame([(1, LONG + item + " " + LONG), (2, LONG), (3, item.upper()), (4, None), (5, "some rare")], "doc_id long, text string")
    items = spark.createDataFrame([(7, item), (8, None), (9, "some rare"), (7, item)], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contaminated_pairs(docs, items).collect()}
    assert got == {(1, 7): 1.0, (3, 7): 1.0, (5, 9): 1.0}


def test_sketches_by_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 0)
    test_short_item_in_long_document(spark)


def test_warc_records(spark):
    pages = spark.createDataFrame([(1, "http://a/é", "x"), (2, None, "x"), (3, "u", None), (4, "u", ""), (None, "u", "y"), (5, "u\r\nEvil: 1", "z" * 100_000), (2, None, "x")], "page_id long, url string, html string")
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes) for r in warc.round_trip(pages).collect()), key=repr)
    assert got == sorted([(1, "revisit", 2, 1), (2, "response", None, 1), (2, "response", None, 1), (3, "revisit", 4, 0), (4, "response", None, 0), (None, "response", None, 1), (5, "response", None, 100_000)], key=repr)


def test_damaged_archives_are_refused():
    good = warc.archive([warc.record(1, "u", b"payload", "response", None), warc.record(2, "u", b"payload", "revisit", 1)])
    assert [r["page_id"] for r in warc.records(good)] == [1, 2]
    for bad in (good[:-1], good[4:], good[:-20] + b"\0" * 20, b"", good + b"\0"):
        with pytest.raises(ValueError):
            list(warc.records(bad))
    head = warc.record(1, "u", b"payload", "response", None)
    for bad in (head.replace(b"payload", b"paXload"), head.replace(b"WARC/1.1", b"HTTP/1.1", 1), head[:-1], head.replace(b"WARC-Type: response\r\n", b"")):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_encoder_meets_the_library():
    import random

    from tokenizers import Tokenizer

    with open(queries.bpe_path(), "rb") as f:
        own = bpe.Vocabulary(f.read())
    lib = Tokenizer.from_file(queries.bpe_path())
    rnd = random.Random(3)
    texts = ["", "<|endoftext|>", "a<|endoftext|>b", "x" * 5000, "don't WE'LL  \n\n 12 ½\x1c\x85", LONG[:5000]]
    texts += ["".join(rnd.choice("abcdetinosr éß'#$1 \n日\U0001f389") for _ in range(rnd.randint(1, 60))) for _ in range(400)]
    got = own.encode_batch(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [lib.encode(t, add_special_tokens=False).ids for t in texts]
    assert [own.decode(g) for g in got] == texts


def test_gradients():
    net = byte_conv.ByteConv()
    net.w = {k: v.astype(np.float64) for k, v in net.w.items()}
    rng = np.random.default_rng(4)  # texts without a period, whose chunks don't tie for the largest value
    batch, y = [bytes(rng.integers(a, b, n).astype(np.uint8)) for a, b, n in ((97, 123, 700), (33, 48, 900), (97, 110, 40))], np.array([1, 0, 1], np.float32)
    g = net.gradients(batch, y)

    def loss():
        net._pairs = None
        p = net.scores(batch)
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    for name, w in net.w.items():
        flat, k = w.reshape(-1), int(np.argmax(np.abs(g[name]).reshape(-1)))
        keep = flat[k]
        flat[k] = keep + 1e-5
        up = loss()
        flat[k] = keep - 1e-5
        down = loss()
        flat[k] = keep
        assert abs((up - down) / 2e-5 - g[name].reshape(-1)[k]) < 1e-3


def test_score_without_both_labels():
    net = byte_conv.ByteConv().fit([b"a", b"b"], np.array([1.0, 1.0], np.float32))
    assert net.scores([b"", b"zzz"]).min() > 0.99
    assert abs(byte_conv.ByteConv().fit([], np.zeros(0, np.float32)).scores([b"x"])[0] - 0.5) < 1e-9


def test_unsupported_tokenizer_settings_are_refused():
    import json

    with open(queries.bpe_path(), "rb") as f:
        made = json.load(f)
    for change in ({"normalizer": {"type": "NFC"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"model": made["model"] | {"ignore_merges": True}}, {"added_tokens": [made["added_tokens"][0] | {"lstrip": True}]}):
        with pytest.raises(ValueError, match="supported"):
            bpe.check_settings(made | change)
    bpe.check_settings(made)


def test_scores_equal_a_plain_forward_pass(monkeypatch):
    """Also where a text is scored in slices."""
    from tests.llm import brute

    net = byte_conv.ByteConv(3)
    texts = [b"", b"a", b"xyz" * 41, bytes(range(1, 250)) * 9, b"hello world " * 300]
    want = [brute.byte_conv_score(net.w, t) for t in texts]
    for size in (512 << 10, 512, 128):
        monkeypatch.setattr(byte_conv, "SCORED_BYTES", size)
        assert np.allclose(net.scores(texts), want, atol=1e-5)


def test_markers_of_many_partitions():
    from types import SimpleNamespace

    markers = [SimpleNamespace(pid=k, first1=1, first2=1, last1=1, last2=1, last_doc=k, one_run=True) for k in range(3000)]
    assert line_dedup.continued(markers) == dict.fromkeys(range(1, 3000), 0)


def test_archives_of_other_writers(spark, tmp_path):
    """Files with a warcinfo record and frames without a content size, through the binaryFile source."""
    import struct

    import zstandard as zstd

    block = b"software: other\r\n"
    info = b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:0>\r\nWARC-Date: 2020-01-01T00:00:00Z\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(block), block)
    words = (info * 4)[:200]
    packer = zstd.ZstdCompressor(dict_data=zstd.ZstdCompressionDict(words), write_content_size=False)
    made = struct.pack("<II", warc.SKIPPABLE_MAGIC, len(words)) + words
    for r in (info, warc.record(7, "u", b"payload", "response", None), warc.record(8, "u", b"", "revisit", 7)):
        one = packer.compressobj()
        made += one.compress(r) + one.flush()
    (tmp_path / "a.warc.zst").write_bytes(made)
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.warc.zst")).select("content")
    got = {r.page_id: r for r in warc.read_archives(files).collect()}
    assert set(got) == {7, 8} and got[7].record_type == "response" and got[8].refers_to == 7
    with pytest.raises(ValueError):
        list(warc.records(made[:-3]))
