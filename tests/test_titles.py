from pyspark.sql import functions as F

from quaero.functions.text import title_of


def test_titles_behind_a_long_beginning(spark):
    rows = [("<" * 3000 + "\nNa een lange regel", "Na een lange regel"), ("x" * 5000, "x" * 120), ("\n" * 2047 + "\r\nLaat\r\nrest", "Laat"), ("{\n" * 1023 + "een titel op de rand\nnog een", "een titel op de rand"), (None, "anders"), ("ab\n\n", "anders"), ("## Koptekst\nrest", "Koptekst")]
    table = spark.createDataFrame(rows, "text string, title string")
    assert [r.found for r in table.select(title_of(F.col("text"), F.lit("anders")).alias("found")).collect()] == [t for _, t in rows]
