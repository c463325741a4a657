"""Kept results: what a second run judges, and that its result is that of a full run."""

from dataclasses import replace

import pytest
from builder import CONTRACT, write_release

import sealyard as sy
from sealyard.plans import rejudge
from sealyard.sources import commits


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def ids(df):
    return sorted(r.release_id for r in df.collect())


@pytest.fixture
def folders(spark, tmp_path):
    root = tmp_path / "dist"
    write_release(root / "a")
    write_release(root / "b", manifest=lambda d: d.update(architecture="other"))
    write_release(root / "c", without=["release.json"])
    write_release(root / "d", without=[".dmg"])
    candidates = spark.createDataFrame([(i, "v0.4.0") for i in "abcd"], "release_id string, tag string")
    log = f"file://{tmp_path}/results"
    sy.create_results(candidates, log)
    return root, candidates, log


def test_only_changed_folders_are_judged(spark, folders, monkeypatch):
    root, candidates, log = folders
    asked = []
    whole = rejudge.validate_folder
    monkeypatch.setattr(rejudge, "validate_folder", lambda s, c, some, p: asked.append(ids(some)) or whole(s, c, some, p))

    def run(seq, contract=CONTRACT, of=candidates):
        passed, found, verdicts, judged = sy.validate_changed_folders(spark, contract, of, str(root), log, seq)
        if seq in (3, 6):  # some judged now, and none
            want = sy.validate_folder(spark, contract, of, str(root))
            assert [rows(passed), rows(found), rows(verdicts)] == [rows(df) for df in want]
        assert ids(judged) == asked[-1]
        return asked[-1]

    assert run(1) == list("abcd")
    assert run(2) == []
    base = "acme-tool-0.4.0-os-cpu"
    (root / "d" / f"{base}.dmg").write_bytes(b"image")  # a file that was missing
    (root / "a" / f"{base}.tar.gz").write_bytes(b"other")  # a file that is another now
    assert run(3) == ["a", "d"]
    write_release(root / "e")
    more = candidates.unionByName(spark.createDataFrame([("e", "v0.4.0")], candidates.schema))
    assert run(4, of=more) == ["e"]
    assert run(5, of=spark.createDataFrame([("b", "v0.4.1")], candidates.schema)) == ["b"]
    assert run(6) == []  # the results of the tag before are still there
    other = replace(CONTRACT, architecture="other")
    assert run(7, contract=other) == list("abcd")
    sy.compact_results(candidates, log)
    assert run(8) == [] and run(9, contract=other) == []


def test_a_failed_run_has_judged_nothing(spark, folders, monkeypatch):
    root, candidates, log = folders

    def fail(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(rejudge, "validate_folder", fail)
        with pytest.raises(RuntimeError):
            sy.validate_changed_folders(spark, CONTRACT, candidates, str(root), log, 1)
    assert ids(sy.validate_changed_folders(spark, CONTRACT, candidates, str(root), log, 1)[3]) == list("abcd")
    # A number is one run's; nothing of the other is seen.
    write_release(root / "e")
    more = candidates.unionByName(spark.createDataFrame([("e", "v0.4.0")], candidates.schema))
    with pytest.raises(sy.AlreadyCommitted):
        sy.validate_changed_folders(spark, CONTRACT, more, str(root), log, 1)
    assert ids(sy.validate_changed_folders(spark, CONTRACT, more, str(root), log, 2)[3]) == ["e"]


def test_two_runs_at_once_do_not_double_findings(spark, folders):
    root, candidates, log = folders
    empty = commits.read_log(spark, log, rejudge._schema(candidates)).count()
    assert empty == 0
    first = sy.validate_changed_folders(spark, CONTRACT, candidates, str(root), log, 1)
    kept = commits.read_log(spark, log, rejudge._schema(candidates)).collect()
    again = spark.createDataFrame([(*r[:-1], 2) for r in kept], rejudge._schema(candidates))
    commits.commit(again, log, 2, "judged")
    third = sy.validate_changed_folders(spark, CONTRACT, candidates, str(root), log, 3)
    assert ids(third[3]) == [] and rows(third[1]) == rows(first[1])


def test_fingerprints_see_every_value_and_no_order(spark):
    def prints(members, tag="v1", contract=CONTRACT):
        candidates = spark.createDataFrame([(1, tag), (2, "v2")], "release_id bigint, tag string")
        table = spark.createDataFrame(members, "release_id bigint, name string, mode bigint")
        return dict(map(tuple, rejudge.release_fingerprints(contract, candidates, [table]).collect()))

    some = [(1, "a", 1), (1, "b", None), (1, None, 2), (3, "x", 1)]
    one = prints(some)
    assert set(one) == {1, 2} and one == prints(some[::-1])
    changed = [[(1, "a", 2), *some[1:]], [*some, some[0]], some[1:], [(1, "a", 1), (1, "b", 0), *some[2:]], [(1, "b", 1), (1, "a", None), *some[2:]]]
    for members in changed:
        found = prints(members)
        assert found[1] != one[1] and found[2] == one[2]
    assert prints(some, tag="v2")[1] != one[1]
    assert prints(some, contract=replace(CONTRACT, alias="other"))[2] != one[2]
    assert len({prints([(1, "a", i)])[1] for i in range(5)}) == 5


def test_texts_are_hashed_once_for_all_branches(spark, sf_dir):
    from sealyard.bindings.releases import document_releases

    for df in document_releases(spark, sf_dir):
        assert not any("documents.parquet" in name for name in df.inputFiles())


def test_fingerprints_convert_no_digits(spark):
    candidates = spark.createDataFrame([(1, "v1")], "release_id bigint, tag string")
    prints = rejudge.release_fingerprints(CONTRACT, candidates, [candidates])
    assert "conv(" not in prints._jdf.queryExecution().toString()
    assert [len(r.fingerprint) for r in prints.collect()] == [64]
