"""Column functions against the behaviour they stand for, spelled in plain Python."""

import json
import random
import re
from pathlib import PurePosixPath

import pytest
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.functions.documents import json_document, whole_number
from sealyard.fixed import COMMIT_PATTERN, VERSION_PATTERN


def evaluate(spark, values, expression):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    rows = df.select("i", expression(F.col("v")).alias("r")).collect()
    return [row.r for row in sorted(rows)]


def sample(alphabet, count, longest, seed=7):
    rng = random.Random(seed)
    return ["".join(rng.choices(alphabet, k=rng.randint(0, longest))) for _ in range(count)]


VERSIONS = [
    "0.4.0", "01.2.3", "1.2.3-rc.1", "1.2.3--", "١.٢.٣", "1.2", "1.2.3-", "1.2.3+b1",
    "v1.2.3", "0.4.0\n", "", "1.2.3-é", "1.2.3 ", "𝟏.2.3", "1.2.3-a\n",
]


def test_full_match_version(spark):
    got = evaluate(spark, VERSIONS, lambda v: sy.full_match(v, VERSION_PATTERN))
    assert got == [re.fullmatch(VERSION_PATTERN, v) is not None for v in VERSIONS]
    assert got[:5] == [True] * 5


def test_full_match_commit(spark):
    commits = ["a" * 40, "a" * 39, "a" * 41, "A" * 40, "a" * 40 + "\n", "g" * 40, "0f" * 20]
    got = evaluate(spark, commits, lambda v: sy.full_match(v, COMMIT_PATTERN))
    assert got == [True, False, False, False, False, False, True]


BLANK = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0       　"


def test_split_fields_is_unicode_split(spark):
    texts = sample(BLANK + "ab*​﻿\x1b", 400, 9) + ["", " ", "a  b\n", "a\xa0b"]
    assert evaluate(spark, texts, sy.split_fields) == [text.split() for text in texts]


PATHS = sample("/.ab", 500, 7) + ["", ".", "..", "/", "//b", "b/..", "b/../c", "..b", "./b/x", "b//x"]


def test_path_functions(spark):
    def absolute(path):
        return PurePosixPath(path).is_absolute()

    parts = [list(PurePosixPath(p).parts[1 if absolute(p) else 0:]) for p in PATHS]
    assert evaluate(spark, PATHS, sy.path_parts) == parts
    assert evaluate(spark, PATHS, sy.safe_path) == [
        not absolute(p) and ".." not in PurePosixPath(p).parts for p in PATHS
    ]
    rooted = evaluate(spark, PATHS, lambda v: sy.path_root(v, F.lit("b")))
    assert rooted == [bool(q) and q[0] == "b" for q in parts]
    assert evaluate(spark, PATHS, sy.strip_slashes) == [p.rstrip("/") for p in PATHS]


def test_classify_channel(spark):
    got = evaluate(spark, ["v1.0.0", "v1.0.0-rc", "-", ""], sy.classify_channel)
    assert got == ["stable", "prerelease", "prerelease", "stable"]


DOCUMENTS = [
    '{"a":-INF}', '{"a":+Infinity}', '{"a":"+Infinity \\" INF","b":-Infinity}', '{"INF":"\\\\"}',
    '{"a":"x","b":INF}',
    '{"a":1}', ' {"a":1}\n', '{"a":1} x', '{"a":1}}', '{"a":1}]', '{"a":1},{"b":2}', "", " ",
    '{"a":1},"b":2', '{"a":1}] [', '{"a":1}} {', "[1]", "[1],[2]", '"x"', "1", "1,2", "1]", "1}",
    "null", "true", "NaN", '{"a":NaN}', '{"a":-Infinity}', "{'a':1}", '{"a":01}', '{"a":1,}',
    '{"a":1}/*c*/', "{a:1}", '{"a":"x\ny"}', '{"a":1,"a":2}', '﻿{"a":1}', '{"a":"\\u00e9"}',
    '{"a":"\\x"}', "{", "}", '{"a"}', '{"a":1} {"b":2}', '1,"k":2', '"a"],"b":["c"', "\xa01",
]


def parses(text):
    try:
        json.loads(text)
        return True
    except ValueError:
        return False


def test_manifest_readable(spark):
    noise = sample('{}[]",:1a ', 1500, 6)
    texts = DOCUMENTS + noise
    assert evaluate(spark, texts, sy.manifest_readable) == [parses(t) for t in texts]


def test_manifest_readable_needs_utf8(spark):
    df = spark.createDataFrame([(b'{"a":"\xff"}',), (b'{"a":1}',)], "b binary")
    got = df.select(sy.manifest_readable(F.expr("cast(b as string)")).alias("r")).collect()
    assert [row.r for row in got] == [False, True]


VALUES = ["true", "false", "1", '"true"', "null", "{}", "[]", '{"a":null}', "[0]", '"x"', "0", "1.0"]


@pytest.mark.parametrize(
    "function, holds",
    [
        (sy.strict_true, lambda v: v is True),
        (sy.nonempty_object, lambda v: isinstance(v, dict) and bool(v)),
        (sy.nonempty_array, lambda v: isinstance(v, list) and bool(v)),
    ],
)
def test_json_types(spark, function, holds):
    got = evaluate(spark, [*VALUES, "nonsense"], lambda v: function(json_document(v)))
    assert got == [holds(json.loads(v)) for v in VALUES] + [False]


def test_whole_number_takes_no_text(spark):
    values = ["5", "5.0", "5.5", '"5"', "true", "null", "9007199254740993", "-1"]
    got = evaluate(spark, values, lambda v: whole_number(json_document(v)))
    assert got[:2] == [5, 5] and got[2:6] == [None] * 4 and got[7] == -1


def test_missing_values_fail(spark):
    df = spark.sql("select cast(null as string) as a, cast(null as string) as b")
    row = df.select(
        sy.columns_equal(F.col("a"), F.col("b")).alias("x"),
        sy.equals_constant(F.col("a"), "k").alias("y"),
        sy.path_root(F.col("a"), F.col("b")).alias("z"),
    ).first()
    assert tuple(row) == (False, False, False)
