"""Batches that many tasks write and one marker commits; withdrawn drafts; snapshots and compaction."""

from concurrent.futures import ThreadPoolExecutor

import pytest
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.plans.publish import draft_release, index_rows, publish_release, releases_path
from sealyard.sources import commits

SCHEMA = "release_id string, tag string, arrival bigint"
NO_FAULTS = "release_id string"


def rows_of(spark, tags):
    rows = spark.createDataFrame([(t, t, i) for i, t in enumerate(tags)], SCHEMA)
    return index_rows(rows, F.lit("p"), F.col("arrival"))


def index(spark, registry, as_of=None):
    rows = sy.scan_releases(spark, releases_path(registry), as_of)
    return sorted((r.tag, r.state, r.seq) for r in rows.collect())


def published(spark, registry, seq, tags, failed=()):
    """Draft the tags and publish all but the failed."""
    rows = rows_of(spark, tags)
    draft_release(rows, registry, seq)
    publish_release(rows, spark.createDataFrame([(t,) for t in failed], NO_FAULTS), registry, seq)


@pytest.fixture
def registry(spark, tmp_path):
    sy.create_registry(spark, f"file://{tmp_path}/registry")
    return f"file://{tmp_path}/registry"


# ---- the commit


@pytest.mark.parametrize("put", [commits.put_if_absent, lambda s, p, t: commits._rename_if_absent(s, f"{p}.own{t}", p, t)])
def test_one_of_many_writers_creates_a_file(spark, tmp_path, put):
    (tmp_path / "c").mkdir()
    path = f"file://{tmp_path}/c/name.json"
    if put is commits.put_if_absent:
        with ThreadPoolExecutor(16) as pool:
            won = list(pool.map(lambda i: put(spark, path, str(i)), range(64)))
    else:
        won = [put(spark, path, str(i)) for i in range(4)]
    assert sum(won) == 1
    assert (tmp_path / "c/name.json").read_text() == str(won.index(True))
    assert [p.name for p in (tmp_path / "c").iterdir() if not p.name.endswith(".crc")] == ["name.json"]


def test_of_two_publishers_with_one_number_one_wins(spark, registry):
    one, two = rows_of(spark, ["a"]), rows_of(spark, ["b"])
    draft_release(one, registry, 1)
    with pytest.raises(sy.AlreadyCommitted):
        draft_release(two, registry, 1)
    publish_release(one, spark.createDataFrame([], NO_FAULTS), registry, 1)
    with pytest.raises(sy.AlreadyCommitted):
        publish_release(two, spark.createDataFrame([], NO_FAULTS), registry, 1)
    assert index(spark, registry) == [("a", "draft", 1), ("a", "published", 1)]


def test_a_race_for_one_number_has_one_winner(spark, registry):
    def attempt(i):
        try:
            draft_release(rows_of(spark, [f"t{i}-{k}" for k in range(5)]), registry, 1)
            return i
        except sy.AlreadyCommitted:
            return None

    with ThreadPoolExecutor(6) as pool:
        won = [i for i in pool.map(attempt, range(6)) if i is not None]
    assert len(won) == 1
    assert index(spark, registry) == [(f"t{won[0]}-{k}", "draft", 1) for k in range(5)]


def test_a_batch_without_its_marker_is_invisible(spark, registry, monkeypatch):
    published(spark, registry, 1, ["a"])
    before = index(spark, registry)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(commits, "put_if_absent", killed)
    with pytest.raises(KeyboardInterrupt):
        draft_release(rows_of(spark, ["b"]), registry, 2)
    monkeypatch.undo()
    assert index(spark, registry) == before
    # The number is free, and the attempt's folder goes when nobody can be writing to it any more.
    published(spark, registry, 2, ["c"])
    assert commits.remove_unread(spark, releases_path(registry), older_than=3600) == 0
    assert commits.remove_unread(spark, releases_path(registry), older_than=-60) == 1
    assert index(spark, registry) == sorted([*before, ("c", "draft", 2), ("c", "published", 2)])


def test_a_batch_is_written_by_many_tasks(spark, registry, tmp_path):
    rows = rows_of(spark, [f"t{i}" for i in range(64)]).repartition(8)
    draft_release(rows, registry, 1)
    (folder,) = (tmp_path / "registry/releases/batches").glob("*1.draft-*")
    assert len(list(folder.glob("part-*"))) == 8
    assert len(index(spark, registry)) == 64


def test_an_index_without_batches_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sy.scan_releases(spark, f"{tmp_path}/none")
    (tmp_path / "empty/commits").mkdir(parents=True)
    with pytest.raises(ValueError, match="no batch"):
        sy.scan_releases(spark, f"{tmp_path}/empty")


def test_a_registry_is_created_once(spark, registry):
    with pytest.raises(sy.AlreadyCommitted):
        sy.create_registry(spark, registry)
    assert index(spark, registry) == []


# ---- withdrawing


def withdrawn(spark, registry, tags, seq, **how):
    ended, refused = sy.withdraw_draft(spark.createDataFrame([(t,) for t in tags], "tag string"), registry, seq, **how)
    return sorted(r.tag for r in ended.collect()), {r.tag: r.reason for r in refused.collect()}


def test_a_withdrawn_draft_frees_its_tag_and_a_published_one_never(spark, registry):
    published(spark, registry, 1, ["a", "b", "c"], failed=["b"])
    assert withdrawn(spark, registry, ["a", "b", "b", "x", None], 2) == (["b"], {"a": "published", "x": "no draft"})
    assert ("b", "draft", 1) not in index(spark, registry) and ("b", "draft", 1) in index(spark, registry, as_of=1)
    again = spark.createDataFrame([("b", "b", 1), ("a", "a", 1)], SCHEMA)
    admitted, rejected = sy.reject_existing(again, sy.scan_releases(spark, releases_path(registry)), ["tag"], ["arrival"])
    assert [r.tag for r in admitted.collect()] == ["b"] and [r.tag for r in rejected.collect()] == ["a"]
    published(spark, registry, 3, ["b"])
    assert index(spark, registry) == sorted(
        [(t, s, n) for t, n in (("a", 1), ("b", 3), ("c", 1)) for s in ("draft", "published")]
    )
    assert withdrawn(spark, registry, ["b"], 4) == ([], {"b": "published"})


def test_a_draft_withdrawn_twice_is_refused(spark, registry):
    published(spark, registry, 1, ["a"], failed=["a"])
    assert withdrawn(spark, registry, ["a"], 2) == (["a"], {})
    assert withdrawn(spark, registry, ["a"], 3) == ([], {"a": "no draft"})
    published(spark, registry, 5, ["a"], failed=["a"])
    assert withdrawn(spark, registry, ["a"], 4) == ([], {"a": "later"})
    assert index(spark, registry) == [("a", "draft", 5)]


def test_drafts_of_a_publisher_at_work_stay_unless_it_is_shut_out(spark, registry):
    rows = rows_of(spark, ["a", "b"])
    draft_release(rows, registry, 1)
    assert withdrawn(spark, registry, ["a"], 2) == ([], {"a": "open"})
    assert withdrawn(spark, registry, ["a"], 3, abandon=True) == (["a"], {})
    with pytest.raises(sy.AlreadyCommitted):
        publish_release(rows, spark.createDataFrame([], NO_FAULTS), registry, 1)
    assert index(spark, registry) == [("b", "draft", 1)]
    # Who has published before that is left alone.
    published(spark, registry, 4, ["c"])
    assert withdrawn(spark, registry, ["c"], 5, abandon=True) == ([], {"c": "published"})


def test_files_of_a_withdrawn_draft_do_not_hinder_a_retry(spark, registry, tmp_path):
    kind = "release_id string, tag string, ord int, name string, content binary"

    def staged(seq, text):
        files = spark.createDataFrame([("r", t, 0, "x", bytearray(text)) for t in ("v1", "v2")], kind)
        uploads = sy.stage_release(files, rows_of(spark, ["v1", "v2"]), registry, seq, content="content")
        return {r.tag: r.size for r in uploads.collect()}

    assert staged(1, b"first") == {"v1": 5, "v2": 5}
    publish_release(rows_of(spark, ["v2"]), spark.createDataFrame([], NO_FAULTS), registry, 1)
    (tmp_path / "outside").write_text("stays")
    assert withdrawn(spark, registry, ["v1", "v2", "../.."], 2)[0] == ["v1"]
    assert not list((tmp_path / "registry/files/v1").iterdir())
    assert staged(3, b"second") == {"v1": 6, "v2": None}
    assert (tmp_path / "registry/files/v2/x").read_bytes() == b"first" and (tmp_path / "outside").exists()


# ---- snapshots and compaction


def test_snapshots_survive_compaction(spark, registry, tmp_path):
    log = releases_path(registry)
    for seq in range(1, 6):
        published(spark, registry, seq, [f"t{seq}-{i}" for i in range(20)], failed=[f"t{seq}-0"])
    withdrawn(spark, registry, ["t2-0", "t4-0"], 6)
    want = [index(spark, registry, n) for n in range(8)]
    assert len({len(w) for w in want}) > 5 and want[7] == want[6] == index(spark, registry)
    assert sy.compact_releases(spark, log)
    assert [index(spark, registry, n) for n in range(8)] == want
    published(spark, registry, 7, ["late"])
    now = index(spark, registry)
    assert now == sorted([*want[6], ("late", "draft", 7), ("late", "published", 7)])
    # Once more, over the first compaction; then with what it replaced removed.
    assert sy.compact_releases(spark, log, file_bytes=2000) and not sy.compact_releases(spark, log)
    assert commits.remove_unread(spark, log, older_than=-60) > 10
    assert [index(spark, registry, n) for n in range(7)] == want[:7] and index(spark, registry) == now
    folder = max((tmp_path / "registry/releases/batches").iterdir(), key=lambda p: p.stat().st_mtime)
    files = list(folder.glob("part-*"))
    assert 1 < len(files) < 20


def test_compaction_makes_few_large_files(spark, registry, tmp_path):
    for seq in range(1, 5):
        draft_release(rows_of(spark, [f"t{seq}-{i}" for i in range(16)]).repartition(8), registry, seq)
    assert sy.compact_releases(spark, releases_path(registry))
    (folder,) = (tmp_path / "registry/releases/batches").glob("*compaction*")
    assert len(list(folder.glob("part-*"))) == 1
    files = sy.scan_releases(spark, releases_path(registry)).inputFiles()
    assert len(files) == 1 and len(index(spark, registry)) == 64


def test_a_batch_committed_during_a_compaction_is_kept(spark, registry, monkeypatch):
    published(spark, registry, 1, ["a"])
    published(spark, registry, 3, ["c"])
    put = commits.put_if_absent

    def between(session, path, text):
        # A slow publisher with a smaller number commits when the compaction has read everything.
        monkeypatch.setattr(commits, "put_if_absent", put)
        published(spark, registry, 2, ["b"])
        return put(session, path, text)

    monkeypatch.setattr(commits, "put_if_absent", between)
    assert sy.compact_releases(spark, releases_path(registry))
    assert [tag for tag, state, _ in index(spark, registry) if state == "published"] == ["a", "b", "c"]
    assert [tag for tag, state, _ in index(spark, registry, 2) if state == "published"] == ["a", "b"]


def test_two_compactions_at_once_lose_nothing(spark, registry):
    for seq in (1, 2):
        published(spark, registry, seq, [f"t{seq}"])
    want = index(spark, registry)

    def compaction(_):
        try:
            return sy.compact_releases(spark, releases_path(registry))
        except sy.AlreadyCommitted:
            return False

    with ThreadPoolExecutor(2) as pool:
        assert any(pool.map(compaction, range(2)))
    assert index(spark, registry) == want


# ---- interrupted staging


def test_an_interrupted_batch_is_resumed_and_leaves_no_stray_file(spark, registry, tmp_path):
    source, place = tmp_path / "source", tmp_path / "registry/files"
    source.mkdir()
    for name in ("a", "b"):
        (source / name).write_bytes(name.encode() * 100)
    files = spark.createDataFrame(
        [(t, t, 0, n, f"file:{source}/{n}", 100) for t, n in (("v1", "a"), ("v2", "b"), ("v2", "c"))],
        "release_id string, tag string, ord int, name string, path string, length bigint",
    )
    rows = rows_of(spark, ["v1", "v2"])
    # The copy of a file that is not there yet fails, and with it the batch.
    with pytest.raises(Exception, match="c"):
        sy.stage_release(files, rows, registry, 1)
    assert list(place.rglob("*.1-*.part")) and index(spark, registry) == [("v1", "draft", 1), ("v2", "draft", 1)]
    (place / "v1").mkdir(exist_ok=True)
    (place / "v1" / "x.2-other.part").write_text("of another publisher")
    (source / "c").write_bytes(b"c" * 100)
    with pytest.raises(sy.AlreadyCommitted):
        sy.stage_release(files, rows, registry, 1)
    with pytest.raises(ValueError, match="not the releases"):
        sy.stage_release(files, rows_of(spark, ["v1"]), registry, 1, resume=True)
    uploads = sy.stage_release(files, rows, registry, 1, resume=True)
    assert {(r.tag, r.name, r.size) for r in uploads.collect()} == {("v1", "a", 100), ("v2", "b", 100), ("v2", "c", 100)}
    assert [p.name for p in place.rglob("*.part")] == ["x.2-other.part"]
    # Once more after the listing was written: it is taken as it is.
    assert sy.stage_release(files, rows, registry, 1, resume=True).count() == 3
    publish_release(rows, spark.createDataFrame([], NO_FAULTS), registry, 1)
    with pytest.raises(sy.AlreadyCommitted):
        sy.stage_release(files, rows, registry, 1, resume=True)
    assert [(t, s) for t, s, _ in index(spark, registry)] == [(t, s) for t in ("v1", "v2") for s in ("draft", "published")]


def test_parts_of_closed_numbers_are_swept(spark, registry, tmp_path):
    published(spark, registry, 1, ["a", "b"], failed=["b"])
    draft_release(rows_of(spark, ["c"]), registry, 2)
    for tag, name in (("a", "x.1-dead.part"), ("b", "x.1-dead.part"), ("a", "x"), ("c", "y.2-live.part"), ("a", "z.part")):
        (tmp_path / "registry/files" / tag).mkdir(parents=True, exist_ok=True)
        (tmp_path / "registry/files" / tag / name).write_text("x")
    assert sy.sweep_parts(spark, registry) == 2
    left = sorted(p.name for p in (tmp_path / "registry/files").rglob("*") if p.is_file())
    assert left == ["x", "y.2-live.part", "z.part"]


def test_a_folder_is_published_after_an_interruption(spark, registry, tmp_path, monkeypatch):
    from builder import CONTRACT, write_release

    from sealyard.plans import publish

    write_release(tmp_path / "dist/a", "0.4.0")
    candidates = spark.createDataFrame([("a", "v0.4.0", 1)], SCHEMA)

    def killed(*_):
        raise KeyboardInterrupt

    monkeypatch.setattr(publish, "write_upload_listing", killed)
    with pytest.raises(KeyboardInterrupt):
        sy.publish_folder(spark, CONTRACT, candidates, str(tmp_path / "dist"), registry, 1)
    monkeypatch.undo()
    assert index(spark, registry) == [("v0.4.0", "draft", 1)]
    released, found = sy.publish_folder(spark, CONTRACT, candidates, str(tmp_path / "dist"), registry, 1, resume=True)
    assert found.count() == 0 and index(spark, registry) == [("v0.4.0", "draft", 1), ("v0.4.0", "published", 1)]
    assert len(list((tmp_path / "registry/files/v0.4.0").iterdir())) == 5
