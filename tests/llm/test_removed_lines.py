from pyspark.sql import functions as F

from lodestar.llm import quality_rules
from lodestar.llm.common import SPACE

BAR, LONG = " Menü | Home ", "word " * 60


def docs(spark):
    """The bar is in 12 documents of host a and in 5 of host b; a doc_id repeats, once with the same text."""
    rows = [(k, f"{BAR}\nown é{k} text\r\n{BAR.upper().replace('Ü', 'ü')}\n\nend{k}\n{BAR}", "a", f"x{k}") for k in range(12)]
    rows += [(100 + k, f"{BAR}\nother {k}", "b", None) for k in range(5)]
    rows += [(200, f"{LONG}\n{BAR}", "a", "kept"), (200, f"{LONG}\n{BAR}", "a", "again"), (200, f"{LONG}\n{BAR}", "b", "host b"), (None, BAR, "a", "no id"), (300, None, "a", "no text"), (301, "", None, "")]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, note string").withColumn("n_chars", F.length("text"))


def without(text):
    return "".join(x for x in text.splitlines(keepends=True) if x.strip().lower() != BAR.strip().lower())


def test_texts_lose_the_lines_above_the_limit(spark):
    d = docs(spark)
    out = quality_rules.remove_lines(d)
    assert out.columns == d.columns
    want = [(r.doc_id, without(r.text) if r.text and r.source == "a" else r.text, r.source, r.note) for r in d.collect()]
    want = [(*w, None if w[1] is None else len(w[1])) for w in want]
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)
    assert BAR not in next(t for i, t, *_ in want if i == 3)


def test_spans_hold_the_removed_words(spark):
    d = docs(spark)
    text = {(r.doc_id, r.source): (r.text or "").encode() for r in d.collect()}
    got = quality_rules.removed_lines(d).collect()
    assert {r.host for r in got} == {"a"} and len(got) == 14
    for r in got:
        cut = [text[r.doc_id, r.host][s.begin : s.end] for s in r.spans]
        assert all(c.lower().strip(SPACE) == BAR.lower().strip().encode() for c in cut) and sum(len(c.split()) for c in cut) == r.removed_words
    assert sorted((r.removed_words for r in quality_rules.apply_rules(d).filter("doc_id = 200").collect())) == [0, 3, 3]


def test_verdicts_follow_from_the_texts(spark):
    d = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    left = {r.doc_id: len((r.text or "").encode().split()) for r in quality_rules.remove_lines(d, 0, 2).collect()}
    rules = quality_rules.apply_rules(d, 0, 2).collect()
    assert all(r.n_words - r.removed_words == left[r.doc_id] and r.kept == (not r.base_failed and 2 * left[r.doc_id] >= r.n_words) for r in rules)
    assert any(r.removed_words for r in rules)
