"""Documents with every awkward case: nulls, empty and long texts, repeated rows, clashing columns."""

import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("kept", T.StringType()), T.StructField("__mix_row", T.LongType()), T.StructField("rank", T.LongType())])


def awkward() -> list[tuple]:
    r = random.Random(5)
    vocabulary = ["the", "of", "and", *("".join(r.choice("abcdeé日ñ") for _ in range(r.randint(2, 8))) for _ in range(150))]
    prose = lambda n: " ".join(r.choice(vocabulary) + (".\n" if i % 11 == 10 else "") for i in range(n)) + "."
    passage, long = prose(60), prose(4000)
    texts = [None, "", "   \n\t", "one", "two words", prose(19), prose(20), passage, prose(30) + " " + passage + " " + prose(25), passage + " " + prose(9), long, long, long[:9000] + " changed " + long[9000:]]
    base = prose(120)
    for i in range(25):  # near copies
        words = base.split(" ")
        for _ in range(i % 6):
            words[r.randrange(len(words))] = r.choice(vocabulary)
        texts.append(" ".join(words))
    texts += ["tick tock " * 60, "=" * 2000, "*** $$$ %%% " * 20, "THIS!! IS!! LOUD!! " * 10, "a  b\tc\nd e f g h i", "A B C D E F G H I"]
    texts += [prose(r.randint(1, 90)) for _ in range(40)]
    rows = [(i * 3 - 5, t, "en", [None, "a", "b", "é"][i % 4], None if t is None else len(t), "x", i, -i) for i, t in enumerate(texts)]
    rows.append(rows[8])  # a repeated row
    rows.append((None, passage + " tail", None, None, 3, None, None, None))
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="session")
def rows():
    return awkward()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)
