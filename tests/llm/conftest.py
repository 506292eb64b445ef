import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Builds a documents table from texts, or from (doc_id, text[, source]) rows."""

    def build(rows, parts=3):
        full = []
        for i, r in enumerate(rows):
            doc_id, text, *source = r if isinstance(r, tuple) else (i, r)
            full.append((doc_id, text, None, source[0] if source else f"s{i % 3}", None if text is None else len(text)))
        return spark.createDataFrame(full, SCHEMA).repartition(parts)

    return build


@pytest.fixture
def clashing():
    """Adds columns whose names operators use themselves."""

    def add(df, *names):
        from pyspark.sql import functions as F

        for n in ("__id", "__text", "__row", "__digest", "id", "h", "hub", "fp", "key", "label", "size", "kept", "score", "text_sha256", *names):
            df = df.withColumn(n, F.lit("x"))
        return df

    return add
