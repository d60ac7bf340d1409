import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def prose(rng, words, vocabulary=400):
    return " ".join("w%d" % rng.randrange(vocabulary) for _ in range(words))


@pytest.fixture(scope="session")
def texts():
    """Texts with copies, near copies, shared passages, junk and edge cases, by doc_id."""
    rng = random.Random(7)
    base = [prose(rng, rng.randrange(60, 200), 4000) for _ in range(30)]
    passage = prose(rng, 60, 4000)
    found = list(base)
    found += [base[0], base[0], base[1] + " tail", base[2] + "\n" + passage, passage + " " + base[3], " ".join(base[4].split()[:-2])]
    for k in range(12):  # a group of near copies
        words = base[5].split()
        words[rng.randrange(len(words))] = f"edit{k}"
        found.append(" ".join(words))
    found += ["", "   \n\t ", "one", "two words", "a b c", "same same same same " * 30, "x y  z \U0001f600 é", "Line\nLine\n\nLine\nother", "UPPER lower Upper LOWER " * 10]
    found.append(prose(rng, 30_000, 5000))
    found.append("w" * 20_000)
    return {i + 1: t for i, t in enumerate(found)}


@pytest.fixture(scope="session")
def documents(spark, texts):
    """The texts, with a repeated row, null columns and columns whose names operators use inside."""
    rows = [(i, t, "en", f"s{i % 3}", len(t)) for i, t in texts.items()]
    rows.append(rows[6])
    rows.append((1000, None, None, None, None))
    df = spark.createDataFrame(rows, SCHEMA)
    from pyspark.sql import functions as F

    return df.withColumns({name: F.lit("x") for name in ("id", "k", "n", "label", "bucket", "piece", "score", "host", "spans", "words", "_row", "_text", "c0")})


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
