"""A table with the cases every operator must take: nulls in any column, empty, blank and very long texts, repeats, ties, and columns named like the operators' own."""

from pyspark.sql import functions as F

LONG = " ".join(f"Word{i % 977} of the long text is here." for i in range(30_000))


def awkward(spark, key="seq", text="text"):
    rows = [(1, "A plain sentence of more than ten words stands here, and it ends."), (1, "A plain sentence of more than ten words stands here, and it ends."), (2, None), (None, "key is null but there are words in this text to read"), (3, ""), (4, " \n\t"), (5, LONG), (6, "​‍"), (7, "🙂 \x00 \r\n x"), (8, "A plain sentence of more than ten words stands here, and it ends."), (None, None)]
    df = spark.createDataFrame(rows, f"{key} long, {text} string")
    own = ["k", "t", "s", "n", "cls", "set", "form", "raw", "words", "kind", "ids", "WORD_COUNT", "canonical_form", "line_no", "template", "documents", "defect", "spam_share", "gram"]
    for c in own:
        if c.lower() not in (key.lower(), text.lower()):
            df = df.withColumn(c, F.lit(None).cast("string"))
    return df
