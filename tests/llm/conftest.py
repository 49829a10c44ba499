import pytest
from pyspark.sql import functions as F


@pytest.fixture
def docs(spark):
    """Make a documents-like table; extra columns have names that operators use themselves."""

    def make(rows):
        frame = spark.createDataFrame([(i, t) for i, t in rows], "doc_id long, text string")
        extras = ["score", "id", "component", "bucket", "band", "n", "key", "registers", "pieces", "n_shingles", "secret_spans", "media", "words", "y"]
        for name in extras:
            frame = frame.withColumn(name, F.lit("clash"))
        return frame.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.coalesce(F.length("text"), F.lit(0)).cast("long")})

    return make
