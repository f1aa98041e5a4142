"""Small fixtures shared by the training-data tests."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                       T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                       T.StructField("n_chars", T.LongType())])


def corpus(n=60, seed=1):
    """Documents with copies, near copies, shared lines, odd white space, NULLs, empty and long texts."""
    r = random.Random(seed)
    words = ["".join(r.choice("abcdefghij") for _ in range(r.randint(1, 7))) for _ in range(300)]
    line = lambda k: " ".join(r.choice(words) for _ in range(k))
    rows = []
    for i in range(n):
        text = "\n".join(line(r.randint(3, 14)) for _ in range(r.randint(1, 8)))
        if i % 4 == 0:
            text = "Common line on every site.\n" + text
        rows.append([i, text, "en", f"site{i % 7}", len(text)])
    for i in range(8):
        rows.append([n + i, rows[i][1], "en", f"site{i % 3}", 0])
        rows.append([n + 8 + i, rows[i][1] + " tail", "en", f"site{i % 5}", 0])
    loop = line(9)
    odd = [None, "", " \t\n\x0b ", "x", "a b\x1cc d", (loop + " ") * 6, loop + "\n" + loop + "\n" + line(30),
           "é" * 50 + " ß\r\n" + "😀 " * 10, " ".join(words * 20), "idiot 1d10t i d i o t", "\x00 nul", "<|endoftext|> it's  two"]
    for j, t in enumerate(odd):
        rows.append([n + 16 + j, t, None, None if j % 2 else "site0", None])
    rows.append([None, "row without id " + line(8), "en", "site1", 1])
    rows.append(list(rows[3]))  # repeated row
    return [tuple(x) for x in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clash(docs):
    """The same rows with extra columns whose names the operators also use or return."""
    from pyspark.sql import functions as F
    extra = ["t", "w", "line", "h", "class", "shard", "n", "kept", "words", "size", "id", "key", "score", "a.b", "site"]
    return docs.select("*", *[F.lit("x").alias(c) for c in extra])
