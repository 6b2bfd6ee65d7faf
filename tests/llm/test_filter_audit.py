import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from trackside.llm import filter_audit as fa
from trackside.llm.queries import AUDIT_RULES

SCHEMA = "doc_id long, text string, source string"
LABELS = "doc_id long, quality int, toxic int"


def masks(rows):
    first = {}
    for i, t, *_ in rows:
        if i is not None:
            first[t or ""] = min(first.get(t or "", i), i)
    out = []
    for i, t, *_ in rows:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
                 "D": bool(re.search(r"[#$%&*|]", t)), "E": i is not None and i > first[t]}
        out.append({k for k, v in fails.items() if v})
    return out


def brute(rows, labels, names="ABCDE"):
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, x in labels if x == 1 and i is not None}
    found = list(zip(rows, masks(rows)))
    out = {}
    for part in {r[2] or "" for r in rows}:
        mine = [(r[0], m & set(names)) for r, m in found if (r[2] or "") == part]
        shap = Counter()
        for order in itertools.permutations(names):
            left = mine
            for k, f in enumerate(order):
                gone = [x for x in left if f in x[1]]
                left = [x for x in left if f not in x[1]]
                shap[f] += len(gone)
                out[part, "".join(order), k + 1] = [
                    len(left), len(gone), sum(f in m for _, m in mine) - len(gone), sum(m == {f} for _, m in mine),
                    sum(i in good for i, _ in gone), sum(i in toxic for i, _ in gone)]
        for order in itertools.permutations(names):
            for k, f in enumerate(order):
                out[part, "".join(order), k + 1].append(shap[f])
    return {k: tuple(v) for k, v in out.items()}


def run(spark, docs, labels, rules=AUDIT_RULES):
    got = fa.audit(docs, spark.createDataFrame(labels, LABELS), rules, part=F.col("source")).collect()
    out = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley)
           for r in got}
    assert len(out) == len(got)
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    vocab = [f"w{i}" for i in range(400)] + ["Cap", "UP", "é中", "C" * 9, " "]

    def text():
        kind = rng.randrange(5)
        w = [rng.choice(vocab[:20] if kind == 1 else vocab) for _ in range(rng.choice([0, 5, 199, 200, 240]))]
        return rng.choice([" ", "\n", "\t \x0b"]).join(w) + rng.choice(["", "", " #", "  ", " UPPER CASE TEXT IS HERE NOW"])

    out = [(i, rng.choice([text(), text(), None, ""]), rng.choice(["a", "b", None, ""])) for i in range(250)]
    copy = " ".join(vocab[:250])
    out += [(1000 + i, copy, "hot") for i in range(150)]
    out += [(None, copy, "a"), (None, "only here " * 120, "b"), (1000, copy, "hot"), (1001, copy, "c"), (5, "another text", "a")]
    out += [(3000, "Long word " * 1_000_000, "long"), (3001, "x", "clean " + "z")]
    out += [(4000, " ".join(f"u{i}" for i in range(210)), "nothing fails")]
    rng.shuffle(out)
    return out


@pytest.fixture(scope="module")
def labels(rows):
    rng = random.Random(12)
    ids = [r[0] for r in rows if rng.random() < 0.6] + [99999, None]
    return [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in ids + ids[:30]]


def test_matches_brute_force(spark, rows, labels):
    assert run(spark, spark.createDataFrame(rows, SCHEMA).repartition(6), labels) == brute(rows, labels)


def test_clashing_columns_and_fewer_filters(spark, rows, labels):
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("row", "id", "part", "digest", "failed", "filter", "alive", "words", "n", "d", "set", "first_id"):
        df = df.withColumn(c, F.lit(c))
    want = brute(rows, labels, "DEA")
    assert run(spark, df, labels, {k: AUDIT_RULES[k] for k in "DEA"}) == want


def test_empty_tables(spark, rows):
    assert run(spark, spark.createDataFrame([], SCHEMA), []) == {}
    few = rows[:40]
    assert run(spark, spark.createDataFrame(few, SCHEMA), []) == brute(few, [])


def test_nothing_fails_gives_zero_rows(spark):
    rows = [(i, " ".join(f"u{i}x{k}" for k in range(200)), None) for i in range(3)]
    got = run(spark, spark.createDataFrame(rows, SCHEMA), [])
    assert len(got) == 600 and set(got.values()) == {(3, 0, 0, 0, 0, 0, 0)}


def test_names_and_number_of_filters(spark, rows):
    df = spark.createDataFrame(rows[:3], SCHEMA)
    for rules in ({}, {"AB": AUDIT_RULES["A"]}, {c: AUDIT_RULES["A"] for c in "ABCDEFG"}):
        with pytest.raises(ValueError):
            fa.audit(df, spark.createDataFrame([], LABELS), rules, part=F.col("source"))
