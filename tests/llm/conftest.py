import random

import pytest

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint, key string, copy int, slice string, row int, fp string"


def frame(spark, rows):
    """Documents with columns whose names clash with those used inside the operators."""
    full = [(i, t, None, s, None if t is None else len(t), "k", 7, "s", 1, None) for i, t, s in rows]
    return spark.createDataFrame(full, COLUMNS)


def sentences(seed, count, words=30):
    r = random.Random(seed)
    lexicon = ["".join(r.choice("abcdeéfgh") for _ in range(r.randint(2, 8))) for _ in range(400)]
    return [" ".join(r.choice(lexicon) for _ in range(words)) for _ in range(count)]


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and blank texts, copies, near copies, a long text, repeated rows, a null id and a null source."""
    base = sentences(5, 30)
    rows = [(k, text, f"src{k % 3}") for k, text in enumerate(base)]
    rows += [(100, None, "src0"), (101, "", "src1"), (102, " \t\n ", None), (103, base[3], "src1"), (104, base[3].replace(" ", "\n", 2), "src1")]
    rows += [(105, base[4] + " tail", "src2"), (106, "x" * 70_000 + " end", "src0"), (None, base[5], "src0"), (7, base[7], "src1"), (-4, base[9], "src2")]
    rows += [(200 + k, "common line here\n" + text, "src1") for k, text in enumerate(base[:5])]
    return rows


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return frame(spark, odd_rows)


@pytest.fixture(scope="session")
def none(spark):
    return frame(spark, [])
