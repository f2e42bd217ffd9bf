"""The pipeline's stages, each judged on its own input by brute force."""

from collections import Counter

import corpus_pipeline
import numpy as np
from pyspark.sql import functions as F

from sundew.plans.tables import materialize
from tests.llm.test_operators import DOCS, brute_lines, brute_similar, docs, words


def corpus(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet").withColumn("extra", F.lit(1))


def test_stages(spark):
    given = corpus(spark)
    columns = given.drop("extra").columns
    seen = []
    for name, stage in corpus_pipeline.STAGES:
        after = materialize(stage(spark, given, "/root/testdata/sf0.001"), "test-stage")
        seen.append((name, given.collect(), after.collect(), after.columns))
        given = after
    for _, _, _, names in seen[:-1]:
        assert names == columns
    (_, raw, good, _), (_, _, lined, _), (_, before, apart, _), (_, pool, mixed, _), (_, _, encoded, _) = seen
    assert {r.doc_id for r in good} < {r.doc_id for r in raw} and all(len(words(r.text)) >= 50 for r in good)
    want = {d: t for d, (t, gone) in brute_lines([(r.doc_id, r.text) for r in good]).items() if not gone or words(t)}
    assert {r.doc_id: r.text for r in lined} == want and all(r.n_chars == len(r.text) for r in lined)
    classes = brute_similar([(r.doc_id, r.text) for r in before])
    assert {r.doc_id for r in apart} == {c for c, _ in classes.values()}
    size = {r.doc_id: len(words(r.text)) for r in pool}
    copies = Counter(r.doc_id for r in mixed)
    assert max(copies.values()) <= 3 and abs(sum(size[d] * n for d, n in copies.items()) - sum(size.values())) <= 0.02 * sum(size.values())
    assert len(encoded) == len(mixed) and all(r.exact and r.n_tokens == len(np.frombuffer(r.ids, "<u4")) for r in encoded)


def test_edge_rows_and_empty_tables(spark):
    odd = docs(spark).unionByName(spark.createDataFrame([(None, None, None, None, None), (3, "x " * 60, "en", "s0", 5), (3, "x " * 60, "en", "s0", 5)], DOCS)).withColumn("copies", F.lit("mine"))
    given = odd.collect()
    got = {}
    for name, stage in corpus_pipeline.STAGES:
        none = stage(spark, odd.where("false"), "")
        assert none.collect() == [] and (name == corpus_pipeline.STAGES[-1][0] or none.columns == corpus_pipeline.COLUMNS)
        got[name] = stage(spark, odd, "").collect()
    good, lined, apart, mixed, encoded = got.values()
    nulls = sum(r.text is None for r in given)
    texts = [Counter(r.text for r in found) for found in (good, lined, apart)]
    # too few words, or one word again and again, goes; rows of one id are one document to the lines, so none is the earlier; of near copies one stays; nulls have no copies
    assert all(r.text and len(words(r.text)) >= 50 for r in good) and texts[0]["x " * 60] == 0
    assert [t["x " * 60] for t in texts[1:]] == [2, 1] and [t[None] for t in texts[1:]] == [nulls, nulls]
    size = Counter(r.source for r in given for _ in words(r.text or ""))
    taken = Counter(r.source for r in mixed for _ in words(r.text or ""))
    assert all(taken[s] <= 3 * size[s] + max(len(words(r.text or "")) for r in given) for s in taken)
    assert Counter(r.doc_id for r in encoded) == Counter(r.doc_id for r in given) and all(r.exact for r in encoded)


def test_rows_are_told_apart_whatever_their_ids(spark):
    texts = [" ".join(f"{g}{i}" for i in range(60)) for g in "abcd"]
    rows = [(3, texts[1]), (7, texts[0]), (7, texts[1]), (None, texts[2]), (None, texts[2]), (9, texts[3]), (9, texts[3]), (None, texts[3]), (1, None), (1, None)]
    given = spark.createDataFrame([(d, t, "en", "s", len(t or "")) for d, t in rows], DOCS)
    left = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, given, "").collect())
    assert left == Counter([(3, texts[1]), (7, texts[0]), (None, texts[2]), (9, texts[3]), (1, None), (1, None)])
    # a null id and a repeated one hold most of a source: it still comes within one document of its target
    many = [(None if i % 3 else 7, f"n{i} " * 10, "en", "a", 0) for i in range(300)] + [(1000 + i, f"m{i} " * 10, "en", "b", 0) for i in range(300)]
    taken = Counter(r.source for r in corpus_pipeline.mixing(spark, spark.createDataFrame(many, DOCS), "").collect())
    assert abs(taken["a"] - 200) <= 1 and abs(taken["b"] - 400) <= 1


def test_run_over_the_whole_table(spark):
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").where("exact").count() > 100
