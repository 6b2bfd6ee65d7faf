import hashlib
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from trackside.llm import chat_format as cf

SCHEMA = "conv_id long, turn long, role string, text string"
NEXT = {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user",
        ("user", "assistant"): "assistant", ("assistant", "user"): "user"}
HEAD = {"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}


def esc(s):
    return s.replace("\\", "\\s").replace("### ", "\\h").replace("</turn>", "\\e")


def brute(rows):
    """Counter of the digest columns, by plain Python over each conversation."""
    convs = defaultdict(list)
    for c, t, r, x, *_ in rows:
        convs[c].append((t is not None, t or 0, r or "", x or ""))
    out = Counter()
    for c, ts in convs.items():
        ts.sort()
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for *_, r, x in ts if r == "assistant")
        state, n = "start", 0
        for *_, r, _x in ts:
            state = NEXT.get((state, r), "bad")
            n += state != "bad"
        text = "".join(HEAD.get(r, "### [" + esc(r).replace("]: ", "\\r") + "]: ") + esc(x) + "</turn>\n" for *_, r, x in ts)
        out[(c, len(ts), sha("".join(f"{r}\n{x}\n" for *_, r, x in ts)), len(loss), sha(loss), len(text),
             state == "assistant", n)] += 1
    return out


def digests(df, **kw):
    got = cf.conversation_digests(cf.read_parts(cf.format_parts(df, **kw)))
    return Counter((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars, r.valid, r.n_ordered)
                   for r in got.collect())


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    bits = ["### ", "</turn>", "\\", "\\s", "\\e", "\\h", "\n", "</turn", "#", "### Assistant: ", "<", "a b", "é中😀", "]: ", "\\r", "</turn>\n", ""]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(12)))])
    roles = ["user", "assistant"] * 5 + ["system", None, "tool", "", "a]", "x]: y", "User", "### [", "\\", "</turn>"]
    out = [(c, t, rng.choice(roles), text()) for c in range(60) for t in range(rng.randrange(1, 9))]
    out += [(100 + c, t, ("user", "assistant")[t % 2], text()) for c in range(10) for t in range(2 * c + 1)]
    out += [(200, t, ("user", "assistant")[t % 2], f"t{t}") for t in range(3000)]                 # a hot one
    out += [(201, rng.choice([None, -5, 3, 10**12, 3]), rng.choice(roles), text()) for _ in range(50)]  # ties, nulls, wide
    out += [(None, t, "user", "no id") for t in range(4)]
    out += [(202, 0, "user", "x" * 3_000_000 + "</turn>"), (202, 1, "assistant", "é" * 1_000_000)]
    out += out[:7]
    return out


@pytest.mark.parametrize("slice_turns", [1, 7, 4096])
def test_matches_plain_python(spark, rows, slice_turns):
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert digests(df, slice_turns=slice_turns) == brute(rows)


def test_clashing_columns_and_empty_table(spark, rows):
    few = rows[:200]
    df = spark.createDataFrame(few, SCHEMA)
    for c in ("part", "t", "ts", "whole", "segments", "machine", "long_id", "formatted", "lines", "loss", "end", "tables"):
        df = df.withColumn(c, F.lit(c))
    assert digests(df) == brute(few)
    assert digests(spark.createDataFrame([], SCHEMA)) == Counter()


def test_segments_carry_the_loss_flags(spark):
    df = spark.createDataFrame([(1, 0, "user", "q ### "), (1, 1, "assistant", "a\\")], SCHEMA)
    row = cf.format_parts(df).collect()[0]
    assert [(s.text, s.loss) for s in row.segments] == [
        ("### User: ", False), ("q \\h", False), ("</turn>\n", False),
        ("### Assistant: ", False), ("a\\s", True), ("</turn>\n", False)]


def test_machine_parts_compose(spark):
    """A break in a later part, and a part that is only valid behind the one before."""
    good = [(1, t, ("user", "assistant")[t % 2], "x") for t in range(10)]
    broken = [(2, t, "user" if t == 7 else ("user", "assistant")[t % 2], "x") for t in range(10)]
    got = cf.conversation_digests(cf.read_parts(cf.format_parts(spark.createDataFrame(good + broken, SCHEMA), slice_turns=3)))
    assert {(r.conv_id, r.valid, r.n_ordered) for r in got.collect()} == {(1, True, 10), (2, False, 7)}


def test_another_template(spark):
    t = cf.Template(headers={"human": "<|human|>", "bot": "<|bot|>"}, other_header=("<|?", "|>:"), turn_end="<|end|>", escape="~",
                    controls={"<|": "o", "<|end|>": "x"}, loss_roles=("bot", "tool"),
                    transitions={("start", "human"): "h", ("h", "bot"): "b", ("h", "tool"): "h", ("b", "human"): "h"}, accept=("b",))
    rows = [(1, 0, "human", "a <|end|> ~b"), (1, 1, "tool", "<|"), (1, 2, "bot", "~o~x")]
    parts = cf.format_parts(spark.createDataFrame(rows, SCHEMA), t)
    r = cf.read_parts(parts, t).collect()[0]
    assert r.turns == "".join(f"{role}\n{text}\n" for _, _, role, text in rows) and r.loss == "<|~o~x"
    assert cf.conversation_digests(cf.read_parts(parts, t), t).collect()[0].valid


@pytest.mark.parametrize("bad", [{"escape": "\\\\"}, {"escape": "#"}, {"turn_end": "\n"}, {"controls": {"### ": "h", "</turn>": "h"}},
                                 {"controls": {"aba": "h", "</turn>": "e"}}, {"headers": {"a": "### ", "b": "### b"}}])
def test_ambiguous_templates_are_refused(bad):
    with pytest.raises(ValueError):
        cf.Template(**bad)


def test_plan_has_no_python(spark):
    df = entry.queries()["op13_chat_format"](spark, "/root/testdata/sf0.001")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert "ExistingRDD" not in plan
