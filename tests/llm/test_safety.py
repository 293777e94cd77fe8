"""Repeated and missing ids, and column names that clash: every text is judged for itself, and the texts left are compared."""

from collections import Counter

import corpus_pipeline
from flowguard.llm import toxicity
from flowguard.llm.chunk_dedup import repeated_passages, without_repeats
from flowguard.llm.mixing import mix, mixed_documents
from flowguard.llm.near_dedup import near_groups
from tests.llm.helpers import SENTENCE

HELPERS = ["text_key", "rows", "_rows", "copies", "_copies", "key", "_gone", "mix_key", "mix_key_n", "mix_key_at", "_id", "label", "gone", "_stays", "component_id", "predicted"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} string" for c in HELPERS)


def table(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), *["x"] * len(HELPERS)) for i, t, s in rows], DOCS)


def left(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def prose(seed, n=60):
    return " ".join(f"word{(seed * 7919 + k * k * 31 + k) % 9973}" for k in range(n))


def test_a_passage_is_cut_from_the_text_that_holds_it(spark):
    passage = prose(1, 80)
    rows = [(1, passage), (2, f"{passage} {prose(2)}"), (2, f"{prose(3, 90)} end"), (2, f"{prose(4)} {passage}"), (2, f"{prose(3, 90)} end"), (3, prose(5))]
    docs = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
    cut = without_repeats(docs, repeated_passages(docs)).collect()
    texts = sorted((r.doc_id, r.text) for r in cut)
    untouched = [(1, passage), (2, f"{prose(3, 90)} end"), (2, f"{prose(3, 90)} end"), (3, prose(5))]
    assert not Counter(untouched) - Counter(texts)
    changed = sorted((Counter(texts) - Counter(untouched)).elements())
    assert len(changed) == 2 and all(i == 2 and len(t) < len(passage) for i, t in changed)
    assert prose(2)[30:] in changed[0][1] + changed[1][1] and prose(4)[:-30] in changed[0][1] + changed[1][1]


def test_toxic_rows_without_or_with_repeated_id_go_alone(spark, tmp_path, monkeypatch):
    docs = table(spark, [(None, "bad words", "a"), (None, "fine words", "a"), (7, "bad words", "a"), (7, "other words", "a"), (8, None, "a"), (9, "", "a")])
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))

    def judged(docs, labels):
        from pyspark.sql import functions as F

        own = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.coalesce((F.col("text") == "bad words").cast("int"), F.lit(0)).alias("predicted"))
        return own

    monkeypatch.setattr(corpus_pipeline, "score_toxicity", judged)
    out = corpus_pipeline.drop_toxic(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert left(out) == sorted([(None, "fine words"), (7, "other words"), (8, None), (9, "")], key=str)


def test_scores_carry_the_key_of_their_text(spark):
    docs = spark.createDataFrame([(1, "aa bb"), (1, "cc dd"), (None, "aa bb")], "doc_id long, text string")
    rows = toxicity.score_toxicity(docs, spark.createDataFrame([], "doc_id long, toxic int")).collect()
    assert len(rows) == 3 and len({r.text_key for r in rows}) == 2


def test_near_copies_under_one_id(spark, tmp_path):
    near = SENTENCE + " tonight"
    docs = table(spark, [(5, SENTENCE, "a"), (13, near, "a"), (13, prose(9), "a"), (13, prose(9), "a"), (None, prose(8), "a"), (None, SENTENCE, "a")])
    out = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert left(out) == sorted([(5, SENTENCE), (13, prose(9)), (None, prose(8))], key=str)
    assert sorted(near_groups(docs).columns) == sorted(["doc_id", "n_shingles", "component_id", "kept", "text_key"])


def test_contaminated_text_goes_alone(spark, tmp_path):
    item = prose(6, 30)
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = table(spark, [(None, f"see {item} there", "a"), (None, prose(7), "a"), (4, f"{item}", "a"), (4, prose(8), "a"), (5, None, "a")])
    out = corpus_pipeline.drop_contaminated(spark, docs, str(tmp_path))
    assert out.columns == docs.columns
    assert left(out) == sorted([(None, prose(7)), (4, prose(8)), (5, None)], key=str)


def test_mix_of_repeated_ids_meets_its_budget(spark):
    rows = [(k % 5, prose(k, 1 + k % 9), "big") for k in range(60)] + [(3, prose(100, 6), "b")] * 7 + [(None, prose(k, 4), None) for k in range(200, 212)]
    docs = table(spark, rows)
    words = lambda pairs: Counter({s: sum(len((t or "").split()) for _, t, x in pairs if x == s) for s in ("big", "b", None)})
    out = mixed_documents(docs)
    assert out.columns == docs.columns
    got = words([(r.doc_id, r.text, r.source) for r in out.collect()])
    targets = {r.source_size: r.target for r in mix(docs).collect()}
    for source, size in words(rows).items():
        assert abs(got[source] - targets[size]) <= 9, source


def test_word_digests_do_not_pile_up():
    from flowguard.llm import decontaminate as dc

    kept = dc.WordHashes()
    first = kept["word0"]
    for k in range(250_000):
        kept[f"word{k}"]
    assert len(kept) <= 100_001 and kept["word0"] == first
