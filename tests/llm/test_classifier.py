"""What the classifier's dictionaries see of long texts."""

from pyspark.sql import functions as F

from millrace.llm import classifier


def test_spread_reaches_all_of_a_text(spark):
    text = "".join(f"{k:04d}" * (classifier.CHUNK // 4) for k in range(40)) + "end"
    rows = spark.range(60).select("id", F.lit(text).alias("text")).select("id", classifier.spread(F.col("text"), F.col("id")).alias("t")).collect()
    pieces = {text[k : k + classifier.CHUNK] for k in range(0, len(text), classifier.CHUNK)}
    seen = set()
    for r in rows:
        assert classifier.SAMPLE_CHARS - classifier.CHUNK <= len(r["t"]) <= classifier.SAMPLE_CHARS
        seen |= {r["t"][k : k + classifier.CHUNK] for k in range(0, len(r["t"]), classifier.CHUNK)}
    assert seen == pieces
    short = spark.createDataFrame([(1, "short"), (2, "")], "id long, text string")
    assert [r["t"] for r in short.select(classifier.spread(F.col("text"), F.col("id")).alias("t")).collect()] == ["short", ""]


def test_fit_sees_tails(spark):
    """Words that only come after the first characters reach the dictionaries."""
    filler = "the same plain filler words in every text " * 200
    tail = {1: "marvellously", 0: "dreadfully"}
    rows = [(k, filler + "".join(f" {tail[k % 2]} {k * j}" for j in range(1500)), k % 2) for k in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = classifier.fit(df, df)
    assert b"marvellously" in model.good and b"dreadfully" in model.bad
