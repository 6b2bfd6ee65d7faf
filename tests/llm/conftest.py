"""Fixtures of the training-data operator tests (the session fixture is the parent folder's)."""

import random

import pytest

WORDS = ("the of and to in is was for on that with as by this be are from or an at la de le les un une der die das "
         "und ein el los las del que es en por alpha beta gamma delta epsilon zeta eta theta iota kappa lambda").split()


def prose(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "s", "ing", "er"]) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text, lang, source): prose, copies, near copies, shared passages, nulls, empty and odd texts."""
    rng = random.Random(7)
    rows = [(i, prose(rng, rng.choice([3, 20, 80, 200])), rng.choice(["en", "de", None]), rng.choice(["a", "b", None]))
            for i in range(40)]
    base = prose(rng, 300)
    passage = prose(rng, 70)
    words = base.split()
    rows += [(100 + i, base, "en", "a") for i in range(6)]
    rows += [(120 + i, base.upper(), "en", "b") for i in range(3)]
    for i in range(8):  # near copies: one word changed
        w = list(words)
        w[37 * (i + 1) % 300] = f"changed{i}"
        rows.append((200 + i, " ".join(w), "en", "a"))
    rows += [(300 + i, prose(rng, 30) + "\n" + passage + "\t " + prose(rng, 30), "de", "c") for i in range(6)]
    rows += [(400, None, "en", "a"), (401, "", "en", "a"), (402, "  \n\t ", None, None), (403, "One", "en", "a"),
             (404, "one two", "en", "a"), (405, "ONE two", "en", "a"), (406, "12 34 !!", "en", "a"),
             (407, "ÉTÉ été Straße", "fr", "a"), (408, "x " * 3000, "en", "a"), (409, "x " * 2999 + "y", "en", "a"),
             (None, "a row without an id " * 30, "en", "a"), (None, base, "en", "a"),
             (500, prose(rng, 12000), "en", "long"), (501, "a b \x0b c\x0cd", "en", "a")]
    rows += [rows[3], rows[3]]  # repeated rows
    rows.append((rows[5][0], "another text under a used id " * 12, "en", "a"))
    rng.shuffle(rows)
    return rows


SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    """The corpus with extra columns whose names the operators use inside."""
    from pyspark.sql import functions as F
    out = docs
    for c in ("id", "len", "prefix", "sha", "keep", "kept", "row", "open", "n", "fp", "component", "key", "seg", "a", "b",
              "rate", "n_copies", "copy_no", "__x", "__xid", "__lost", "chars", "w", "host", "path", "bucket", "check",
              "ranges", "own", "doc", "train", "body", "chunk", "edits", "score"):
        out = out.withColumn(c, F.lit(f"extra {c}"))
    return out


@pytest.fixture(scope="session")
def unsortable(docs):
    """The corpus with a map and an array of maps, which Spark cannot order."""
    from pyspark.sql import functions as F
    return docs.withColumn("tags", F.create_map(F.lit("k"), "lang")).withColumn("more", F.array(F.create_map(F.lit("s"), "source")))
