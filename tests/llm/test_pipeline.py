"""The pipeline against brute force, stage by stage, and its columns."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from millrace.llm import classifier, mixing, queries, rules
from tests.llm.samples import DOCS, documents
from tests.llm.test_ops import brute_fingerprint, brute_verdict, clashing, closed, contaminated, same


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    rows = [(k, " ".join(word() for _ in range(rng.choice([5, 25, 60, 90]))), "en", rng.choice("abc"), 0) for k in range(50)]
    rows += [(100, rows[7][1], "en", "a", 0), (101, rows[7][1].upper(), "en", "b", 0), (102, "same " * 40, "en", "a", 0), (103, None, "en", None, 0)]
    # what the labels teach: texts full of symbols are bad
    rows += [(200 + k, " ".join(word() + ("#&" if k % 2 else "") for _ in range(40)), "en", "d", 0) for k in range(120)]
    labels = [(200 + k, 1 - k % 2, 0) for k in range(100)]
    items = [(1, " ".join(rows[9][1].split()[2:14])), (2, rows[12][1].split()[0] + " zzz qqq")]
    folder = f"file://{tmp_path}"
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")

    known = spark.read.parquet(f"{folder}/labels.parquet")
    stats, column = rules.text_stats(spark.createDataFrame(rows, DOCS))
    found = rules.learn_from(stats, column, "doc_id", known)
    good = kept = [r for r in rows if brute_verdict(found, r[1])]
    assert found.rules and {r[0] for r in rows if r[0] >= 300 and r[0] % 2} and not any("#" in r[1] for r in kept) and sum(r[0] >= 200 for r in kept) == 60
    label, alone = closed([brute_fingerprint(r[1]) for r in kept]), {}
    for r, c in zip(kept, label):
        alone[c] = min(alone.get(c, r), r)
    kept = list(alone.values())
    dirty = {x[0] for x in contaminated(kept, items) if x[-1]}
    clean = [r for r in kept if r[0] not in dirty]
    assert dirty and {100, 101, 102, 103} & {r[0] for r in clean} == set()

    docs, wanted = spark.read.parquet(f"{folder}/documents.parquet"), [good, kept, clean]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:4]):
        docs = stage(spark, docs, folder)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(f"{folder}/stage{k}")
        docs = spark.read.parquet(f"{folder}/stage{k}")
        if k < 3:
            same(docs.collect(), wanted[k])
    left = spark.createDataFrame(clean, DOCS)
    scored, score = classifier.fit(left, known).with_scores(left)
    copies = {r["doc_id"]: r["copies"] for r in mixing.mix(scored, quality=F.col(score)).collect()}
    assert Counter(r["doc_id"] for r in docs.collect()) == +Counter(copies)

    vocabulary, start, want = Tokenizer.from_file(queries.vocabulary()), 0, []
    for r in sorted(clean):
        for _ in range(copies[r[0]]):
            ids = [*vocabulary.encode(r[1], add_special_tokens=False).ids, 2]
            want.append((r[0], start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    same(corpus_pipeline.run(spark, folder).collect(), want)


@pytest.mark.parametrize("k", range(4))
def test_stages_with_clashing_columns(spark, tmp_path, k):
    """Extra columns pass through; nulls, empty texts, repeated rows and an empty table don't hurt."""
    rows = documents()
    folder = f"file://{tmp_path}"
    spark.createDataFrame([(1, rows[20][1] or "x y")], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame([(r[0], k % 2) for k, r in enumerate(rows) if r[0] is not None], "doc_id long, quality int").write.parquet(f"{folder}/labels.parquet")
    docs = clashing(spark.createDataFrame(rows, DOCS))
    out = corpus_pipeline.STAGES[k][1](spark, docs, folder)
    assert out.columns == docs.columns and {str(r) for r in out.collect()} <= {str(r) for r in docs.collect()}
    assert corpus_pipeline.STAGES[k][1](spark, docs.limit(0), folder).collect() == []
