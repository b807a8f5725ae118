"""Letters counted in one pass over the bytes are those that the column expressions count."""

from pyspark.sql import functions as F

from threadwatch.operators import lexicon


def test_letters_of_odd_texts(spark, monkeypatch):
    texts = [None, "", "a", "ÀÉ ß ﬁ İ ete", "🙂ppp🙂", "x" * 10, "The Quick brown\x00fox " * 900, "eé" * 5000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string").coalesce(1) \
        .select("id", F.lower("text").alias("low"))
    names = [f"l{i}" for i in range(len(lexicon.TOPIC_LETTERS))]
    want = df.select("id", *[w.cast("long").alias(n) for w, n in zip(lexicon.letter_weights(F.col("low")), names)])
    got = lexicon.with_letter_weights(df, "low", names)
    assert got.schema.names == want.schema.names
    assert sorted(got.collect()) == sorted(want.collect())
    import pyarrow as pa
    low = pa.array([t and t.lower() for t in texts])
    whole = lexicon.letter_counts(low)
    monkeypatch.setattr(lexicon, "_COUNTED_BYTES", 7)
    assert (lexicon.letter_counts(low.slice(2, 5)) == whole[2:7]).all()
    assert lexicon.letter_counts(low.slice(0, 0)).shape == (0, len(names))
