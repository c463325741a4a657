"""Rules, gates and aggregates against brute force over small tables."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.operators.rules import first_broken, missing_key_violations


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    # One key holds a third of the rows.
    keys = ["hot"] * 100 + [f"k{rng.randrange(40)}" for _ in range(200)]
    return [
        (key, i, rng.choice([1, 2, 3, None]), rng.choice(["a", "b", None]))
        for i, key in enumerate(keys)
    ]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "k string, i int, n int, s string")


def rules():
    return [
        sy.Rule("late", 9, F.col("n") != 3, "n is 3 or missing", phase=2),
        sy.Rule("small", 2, F.col("n") < 3, F.concat(F.lit("n="), F.col("n")), item_pos=F.col("i")),
        sy.Rule("it's a \\ b", 1, F.col("s") == "a", "quote ' and \\", item_pos=F.col("i")),
    ]


def broken(row):
    _, i, n, s = row
    found = []
    if n is None or n == 3:
        found.append((2, 0, 9, 0, "late", "n is 3 or missing"))
        found.append((1, i, 2, 0, "small", f"n={n}" if n else None))
    if s != "a":
        found.append((1, i, 1, 0, "it's a \\ b", "quote ' and \\"))
    return found


def test_violations_of_all_rules(df, rows):
    got = sorted(map(tuple, sy.violations(df, ["k", "i"], rules()).collect()), key=repr)
    want = sorted(((r[0], r[1], *v) for r in rows for v in broken(r)), key=repr)
    assert got == want


def test_gate_first_violation_and_verdicts(df, rows):
    found = sy.violations(df, ["k"], rules())
    by_key = defaultdict(list)
    for row in rows:
        by_key[row[0]] += broken(row)
    subjects = df.select("k").distinct()
    gated = {r.k: (r.n_violations, r.passed) for r in sy.gate(subjects, found, ["k"]).collect()}
    assert gated == {k: (len(v), not v) for k, v in by_key.items()}
    first = {r.k: (r.rule, r.message) for r in sy.first_violation(found, ["k"]).collect()}
    assert first == {k: min(v, key=lambda x: x[:4])[4:] for k, v in by_key.items() if v}
    for r in sy.verdicts(subjects, found, ["k"]).collect():
        assert (r.n_violations, r.passed) == gated[r.k]
        assert (r.rule, r.message) == first.get(r.k, (None, None))


def test_gate_rows_agrees_with_gate(df, rows):
    count = defaultdict(int)
    for row in rows:
        count[row[0]] += len(broken(row))
    got = {r.k: (r.n_rows, r.n_violations, r.passed) for r in sy.gate_rows(df, ["k"], rules()).collect()}
    assert got == {
        k: (sum(r[0] == k for r in rows), n, n == 0) for k, n in count.items()
    }


def test_first_broken_follows_phase_and_order(df, rows):
    fixed = [r for r in rules() if isinstance(r.item_pos, int)]
    got = {r.i: r.r for r in df.select("i", first_broken(fixed).alias("r")).collect()}
    names = {r.name for r in fixed}
    for row in rows:
        order = sorted((v for v in broken(row) if v[4] in names), key=lambda v: v[:4])
        assert got[row[1]] == (order[0][4] if order else None)


def test_first_broken_counts_all_of_the_order(spark):
    one = spark.range(1)
    never = F.lit(False)
    by_sub = [sy.Rule("late", 1, never, sub_pos=1), sy.Rule("early", 1, never, sub_pos=0)]
    by_item = [sy.Rule("late", 1, never, item_pos=1), sy.Rule("early", 2, never, item_pos=0)]
    for made in (by_sub, by_item):
        assert one.select(first_broken(made)).first()[0] == "early"
        assert sy.first_violation(sy.violations(one, ["id"], made), ["id"]).first().rule == "early"
    with pytest.raises(ValueError, match="positions"):
        first_broken([sy.Rule("r", 1, never, item_pos=F.col("id"))])


def test_a_null_key_fails_with_its_violations(spark):
    df = spark.createDataFrame([(None, 1), ("a", 1), ("b", 0)], "k string, n int")
    made = [sy.Rule("r", 1, F.col("n") == 0, "no")]
    found = sy.violations(df, ["k"], made)
    want = {None: (1, False), "a": (1, False), "b": (0, True)}
    for judged in (sy.gate(df, found, ["k"]), sy.verdicts(df, found, ["k"]), sy.gate_rows(df, ["k"], made)):
        assert {r.k: (r.n_violations, r.passed) for r in judged.collect()} == want


def test_a_subject_without_rows_passes_and_a_null_does_not(spark):
    subjects = spark.createDataFrame([("a",), ("b",)], "k string")
    one = spark.createDataFrame([("a", None)], "k string, n int")
    found = sy.violations(one, ["k"], [sy.Rule("r", 1, F.col("n") == 1)])
    got = {r.k: r.passed for r in sy.gate(subjects, found, ["k"]).collect()}
    assert got == {"a": False, "b": True}


def test_required_keys_order(spark):
    raw = spark.createDataFrame([(1, '{"b":null}'), (2, "[]"), (3, '{"a":1,"b":2,"c":3}')], "k int, raw string")
    from sealyard.operators.rules import required_keys_of_text

    missing = required_keys_of_text(raw, ["k"], F.col("raw"), ["a", "b", "c"])
    assert sorted((r.k, r.missing) for r in missing.collect()) == [
        (1, "a"), (1, "c"), (2, "a"), (2, "b"), (2, "c"),
    ]
    found = missing_key_violations(missing, ["k"], "keys", 1, 2, ["a", "b", "c"], F.col("missing"))
    assert {r.k: r.message for r in sy.first_violation(found, ["k"]).collect()} == {1: "a", 2: "a"}
    assert {(r.message, r.sub_pos) for r in found.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_last_wins_by_all_order_columns(df, rows):
    got = {r.k: (r.i, r.n, r.s) for r in sy.last_wins(df, ["k"], ["s", "i"]).collect()}
    want = {}
    for k, i, n, s in rows:
        mark = ((s is not None, s or ""), i)
        if k not in want or mark > want[k][0]:
            want[k] = (mark, (i, n, s))
    assert got == {k: v for k, (_, v) in want.items()}


def test_any_and_all_treat_null_as_false(df, rows):
    some = {r.k: r.ok for r in sy.any_row(df, ["k"], F.col("n") == 1).collect()}
    every = {r.k: r.ok for r in sy.all_rows(df, ["k"], F.col("n") < 4).collect()}
    keys = {r[0] for r in rows}
    assert some == {k: any(r[2] == 1 for r in rows if r[0] == k) for k in keys}
    assert every == {k: all(r[2] is not None for r in rows if r[0] == k) for k in keys}


def test_reconcile_counts_the_last_observation(spark):
    expected = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("d", None)], "name string, size int")
    observed = spark.createDataFrame(
        [("a", 0, 9), ("a", 1, 1), ("b", 0, 2), ("b", 1, 8), ("x", 0, 1), ("d", 0, None)],
        "name string, pos int, size int",
    )
    got = sy.reconcile_inventory(expected, observed, ["name"], "size", ["pos"])
    assert {r.name: r.status for r in got.collect()} == {
        "a": "ok", "b": "mismatch", "c": "missing", "d": "mismatch",
    }
    more = sy.reconcile_inventory(expected, observed, ["name"], "size", ["pos"], report_extra=True)
    assert {r.name: r.status for r in more.collect()}["x"] == "extra"


def test_require_members(spark, df, rows):
    subjects = spark.createDataFrame([(k,) for k in {r[0] for r in rows} | {"none"}], "k string")
    got = sy.require_members(df, subjects, ["k"], F.col("s"), ["a", "z"])
    have = {(r[0], r[3]) for r in rows}
    want = {(k, v) for k in {r[0] for r in rows} | {"none"} for v in "az" if (k, v) not in have}
    assert {tuple(r) for r in got.collect()} == want


def test_write_violations_keeps_rows_and_refuses_to_replace(spark, df, tmp_path):
    found = sy.violations(df, ["k"], rules())
    path = str(tmp_path / "found")
    stored = sy.write_violations(found, path)
    assert stored.schema == found.schema and stored.count() == found.count()
    with pytest.raises(Exception, match="ALREADY_EXISTS"):
        sy.write_violations(found, path)
