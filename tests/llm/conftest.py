"""Small document tables for the operators of the subpackage."""

import random

import pytest

from texts import prose

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, words string, x int, label string, ids string, rank int, sig string"


@pytest.fixture(scope="session")
def rows():
    """Documents with nulls, empty, blank, very long, equal and nearly equal texts, repeated rows and columns whose names
    the operators use themselves."""
    rng = random.Random(11)
    base = [prose(rng, rng.randint(20, 160)) for _ in range(30)]
    texts = dict(enumerate(base))
    texts[40] = base[3]                                            # exact copy
    texts[41] = base[4].replace(base[4].split()[10], "changed", 1)  # one word off
    texts[42] = " ".join(base[5].split()[:15] + ["new"] + base[5].split()[15:])
    texts[43] = prose(rng, 30) + " " + base[6] + " " + prose(rng, 25)  # holds a passage
    texts |= {50: None, 51: "", 52: " \n\t ", 53: "one two", 54: "one two", 55: "word " * 400, 56: prose(rng, 9000), 57: "Été 中文 \U0001F600 café",
              58: "Write to a.b@c-d.org or +1 (555) 010-4477, card 4111 1111 1111 1111, host 10.0.0.255.",
              59: prose(rng, 20) + " Licensed under the Apache License, Version 2.0. " + prose(rng, 20)}
    out = [(i, t, "en", None if i % 9 == 8 else f"s{0 if i % 3 == 0 else i % 4}", len(t) if t else None, 1.5, "w", 3, None, "y", 2, None) for i, t in texts.items()]
    return out + [out[0], out[0], out[7]]


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def copies(spark):
    """A third of all rows in one group of near copies, and a passage that half of the others share."""
    rng = random.Random(5)
    base, passage = prose(rng, 120).split(), prose(rng, 60)
    out = []
    for i in range(60):
        w = list(base)
        w[rng.randrange(len(w))] = f"edit{i}"
        out.append((i, " ".join(w)))
    out += [(100 + i, prose(rng, 40) + (" " + passage + " " if i % 2 else " ") + prose(rng, 60)) for i in range(120)]
    return spark.createDataFrame(out, "doc_id long, text string").repartition(4).cache()
