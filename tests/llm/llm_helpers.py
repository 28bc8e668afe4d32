"""Tables and comparisons for the tests of the corpus operators."""

import random

import pytest


DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def docs_frame(spark):
    """Builds a ``documents`` table from (doc_id, text) or (doc_id, text, lang, source) rows."""

    def make(rows):
        full = [(r[0], r[1], *(r[2:] or ("en", "s")), len(r[1] or "")) for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture()
def odd_rows():
    """Null ids and texts, empty, short, repeated and long texts, other alphabets, ties."""
    rng = random.Random(5)
    vocabulary = ["ab", "cd", "Ef", "gh", "éÀ", "ij", "KL", "m-n", "o2", "日本"]
    base = [" ".join(rng.choice(vocabulary) + str(rng.randrange(30)) for _ in range(60)) for _ in range(12)]
    rows = [(i, t) for i, t in enumerate(base)]
    rows += [(20, base[0]), (21, base[0].swapcase()), (22, base[1] + " tail"), (23, "head " + base[1]), (24, base[2][:200])]
    rows += [(30, None), (31, ""), (32, " \t\n"), (33, "one"), (34, "one two three"), (35, "ONE two three"), (36, "...")]
    rows += [(None, base[0]), (None, base[0]), (None, None), (40, base[3]), (40, base[3]), (41, base[4]), (41, base[5] + " x y z")]
    rows += [(50, " ".join(base * 40)), (51, "a " * 4000), (52, "a " * 3000), (53, "x" * 50_000), (54, base[6] + "\x00" + base[7])]
    near = base[8].split()
    for k in range(25):
        w = list(near)
        w[k] = f"changed{k}"
        rows.append((100 + k, " ".join(w)))
    return rows


def key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def same(left, right):
    assert sorted(map(tuple, left), key=key) == sorted(map(tuple, right), key=key)
