import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lamda mu nu xi omicron pi rho sigma tau".split()
PASSAGE = " ".join(WORDS * 3)
SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    # Names that the operators use for their own columns.
    T.StructField("key", T.StringType()), T.StructField("n", T.StringType()), T.StructField("rank", T.StringType()),
    T.StructField("score", T.StringType()), T.StructField("spans", T.StringType()), T.StructField("n_deleted", T.StringType()),
])
TEXTS = [(1, PASSAGE), (2, PASSAGE), (2, PASSAGE), (3, None), (4, ""), (5, " \n\t "), (None, PASSAGE), (6, "one two"), (7, None), (8, "x" * 50_000),
         (9, "a b " * 9_000), (10, PASSAGE.replace("mu", "mU") + " tail"), (11, "mail a.b@c.de now"), (12, "1234 5678"), (13, "ONE two"), (14, "日本語 текст 🙂\u2028x")]


@pytest.fixture(scope="session")
def odd_docs(spark):
    return spark.createDataFrame([(d, t, "en" if d and d % 2 else None, None, None, "k", "n", "r", "s", "sp", "nd") for d, t in TEXTS], SCHEMA)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")
