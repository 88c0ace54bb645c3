import random

import pytest

CLASH = ["key", "found", "hash", "signature", "times", "component", "spans", "ws", "id_key", "text_key", "cell", "blocks"]


@pytest.fixture(scope="session")
def texts():
    """Random texts, copies whole and in part, nulls, empty and very long ones."""
    draw = random.Random(5)
    word = lambda: draw.choice(["alpha", "Beta", "gamma", "ünï", "x1", "δέλτα", "o", "omega"])
    some = [" ".join(word() for _ in range(n)) for n in (3, 4, 5, 30, 40, 60, 80, 120, 200, 9)]
    shared = " ".join(f"s{i}" for i in range(60))
    long = " ".join(f"w{draw.randrange(3000)}" for _ in range(30_000))
    near = shared.split()
    near[30] = "other"
    return some + [some[7], some[7].upper(), f"a b {shared}", f"{shared}\tc", f"d {shared[:150]} e", shared, " ".join(near), "", None, " \n\t ", long, f"{long} tail", "a " * 90, "a " * 90, "z" * 50_000]


@pytest.fixture(scope="session")
def docs(spark, texts):
    """``doc_id, text`` with columns that operators use inside; the ids are not in order."""
    rows = [(7 * i % 101, t, *(f"{c}{i}" for c in CLASH)) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"{c} string" for c in CLASH)).repartition(3)


@pytest.fixture(scope="session")
def odd(docs):
    """The same with a null id and with repeated rows."""
    return docs.union(docs.filter("doc_id in (0, 21, 84)")).union(docs.filter("doc_id = 35").selectExpr("cast(null AS long)", *docs.columns[1:]))


@pytest.fixture(scope="session")
def none(docs):
    return docs.limit(0)
