import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])


@pytest.fixture(scope="session")
def words():
    rng = random.Random(7)
    return ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(2, 7))) for _ in range(400)]


@pytest.fixture(scope="session")
def texts(words):
    """Whole texts with copies, near copies, shared passages, nulls, empty and long ones."""
    rng = random.Random(11)
    passage = " ".join(rng.choices(words, k=70))
    base = [" ".join(rng.choices(words, k=rng.randint(1, 160))) for _ in range(14)]
    long = " ".join(rng.choices(words, k=9000))
    near = base[3].split() + [rng.choice(words)] + base[3].split()[:1]
    out = [None, "", " \n\t ", *base, base[2], base[2], " ".join(near), base[5] + "\n" + passage, passage + " " + base[6], "xx " + passage, long]
    out += [long[: len(long) // 2] + " change " + long[len(long) // 2 :], "a" * 300, "b" + "a" * 200, "One  Two\r\nthree.\n"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


@pytest.fixture(scope="session")
def awkward(spark, texts):
    """Null and repeated ids, repeated rows, columns that could clash."""
    rows = [(None, texts[5]), (5, texts[5]), (5, texts[5]), (9, texts[5]), (9, "short"), (None, None), (3, texts[-1])]
    schema = T.StructType([*DOCS, T.StructField("kept", T.StringType()), T.StructField("hits", T.LongType()), T.StructField("pii", T.LongType()), T.StructField("_fp", T.LongType())])
    return spark.createDataFrame([(*r, "x", 1, 2, 3) for r in rows], schema)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def tokenizers_dir():
    return pytest.importorskip("public_tokenizers")
