import random

import pytest

#: Columns that operators must ignore, named like those they work with.
EXTRA = {"key": "k", "fp": 1, "row": 2, "doc": "d", "score": 0.5, "label": 1, "spans": "s", "part": 3, "place": 4, "__text": "t", "piece": 5, "length": 6}


@pytest.fixture
def texts():
    """Texts with nulls, blanks, repeats, and a very long one."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7)))
    say = lambda n: " ".join(word() for _ in range(n))
    out = [None, "", "   \n\t ", "one", say(40), say(7), say(300), say(20_000)]
    return out + [out[4], out[4], out[6] + " tail", "É" + say(30), "x" * 3000]


def table(spark, rows, kinds="doc_id long, text string"):
    """Rows with the extra columns."""
    extra = ", ".join(f"`{c}` {'string' if isinstance(v, str) else 'double' if isinstance(v, float) else 'long'}" for c, v in EXTRA.items())
    return spark.createDataFrame([(*r, *EXTRA.values()) for r in rows], f"{kinds}, {extra}")


@pytest.fixture
def docs(spark, texts):
    return table(spark, [(i if i != 5 else None, t) for i, t in enumerate(texts)] + [(4, texts[4])])


@pytest.fixture
def none(docs):
    return docs.where("false")


@pytest.fixture
def make(spark):
    return lambda rows, kinds="doc_id long, text string": table(spark, rows, kinds)
