import random
import string

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use inside; they must not get in the way.
CLASHING = "block int, part int, payload string, id int, n int, keys string, host string, kept string, component_id string, v int, e int, band int, spans string, __row string"
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def prose(rng, n, vocabulary=400):
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(2 + rng.randrange(vocabulary) % 6)) for _ in range(n))


def make(spark, texts, ids=None):
    """Documents of texts, with extra columns of clashing names."""
    ids = list(range(len(texts))) if ids is None else ids
    extra = CLASHING.split(", ")
    rows = [(i, t, None if k % 5 == 0 else "en", f"s{k % 3}", None if t is None else len(t), *([None] * len(extra))) for k, (i, t) in enumerate(zip(ids, texts, strict=True))]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def texts():
    """Null, empty, blank and very long texts, copies and near copies, shared passages, other scripts, repeated lines."""
    rng = random.Random(7)
    base = [prose(rng, rng.randint(1, 200)) for _ in range(40)]
    passage = prose(rng, 60)
    words = base[3].split()
    near = [" ".join(w if k != (i * 7) % len(words) else "changed" for k, w in enumerate(words)) for i in range(4)]
    out = [None, "", " \n\t ", "one", "one two three", *base, base[5], base[5], *near, f"{base[6]} {passage}", f"{passage}\n{base[7]}", f"{base[8]}\n{passage}", "é ü ß 漢字 🎉 \u00a0 x" * 20, "same line here\n" * 40, prose(rng, 9000), "a" * 300, "ab" * 200, "tail of it", "<|endoftext|> in a text <|endoftext|>"]
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    return make(spark, texts).cache()


@pytest.fixture(scope="session")
def none(spark):
    """No documents at all."""
    return make(spark, [])
