"""Admission, staging, publishing and the latest pointer."""

import pytest
from builder import CONTRACT, write_release

import sealyard as sy
from sealyard.plans.publish import (
    index_rows,
    publish_release,
    releases_path,
    tag_violations,
    upload_violations,
)


def index(spark, registry):
    rows = sy.scan_releases(spark, releases_path(registry)).collect()
    return {(r.tag, r.state) for r in rows}


def test_reject_existing_admits_first_arrival_once(spark):
    # One tag holds half of the candidates, and one is taken in another state.
    rows = [("t-hot", i) for i in range(100)] + [(f"t{i}", i) for i in range(100)]
    candidates = spark.createDataFrame(rows, "tag string, arrival int")
    releases = spark.createDataFrame([("t1", "published"), ("t2", "draft"), ("t2", "draft")], "tag string, state string")
    admitted, rejected = sy.reject_existing(candidates, releases, ["tag"], ["arrival"])
    got = {tuple(r) for r in admitted.collect()}
    assert got == {("t-hot", 0)} | {(f"t{i}", i) for i in range(100) if i not in (1, 2)}
    assert {tuple(r) for r in rejected.collect()} == set(rows) - got
    assert got | {tuple(r) for r in rejected.collect()} == set(rows)


def test_admitted_and_rejected_are_the_candidates(spark):
    rows = [(None, 1), (None, 1), ("u", None), ("u", 3), ("v", 1), ("v", 1), ("taken", None), ("w", None)]
    candidates = spark.createDataFrame(rows, "tag string, arrival int")
    releases = spark.createDataFrame([("taken",), (None,)], "tag string")
    admitted, rejected = sy.reject_existing(candidates, releases, ["tag"], ["arrival"])
    one, two = ([tuple(r) for r in df.collect()] for df in (admitted, rejected))
    assert sorted(one, key=repr) == sorted([("u", None), ("v", 1), ("w", None)], key=repr)
    assert sorted(one + two, key=repr) == sorted(rows, key=repr)


def test_staging_neither_overwrites_nor_leaves_its_folder(spark, tmp_path):
    registry = f"file://{tmp_path}/registry"
    sy.create_registry(spark, registry)
    kind = "release_id string, tag string, ord int, name string, content binary"

    def staged(rows, seq):
        files = spark.createDataFrame([(t, t, 0, n, bytearray(c)) for t, n, c in rows], kind)
        releases = spark.createDataFrame([(t, t, "p", t, "stable", 1) for t, _, _ in rows], "release_id string, tag string, product string, title string, channel string, arrival bigint")
        return {(r.tag, r.name): r.size for r in sy.stage_release(files, releases, registry, seq, content="content").collect()}

    assert staged([("v1", "x", b"old"), ("v1", "empty", b"")], 1) == {("v1", "x"): 3, ("v1", "empty"): 0}
    again = staged([("v1", "x", b"newer"), ("v1", "empty", b""), ("../../esc", "x", b"1"), ("v2", "../x", b"1"), ("v2", "/x", b"1"), ("v2", "", b"1")], 2)
    assert again == {("v1", "x"): None, ("v1", "empty"): 0, ("../../esc", "x"): None, ("v2", "../x"): None, ("v2", "/x"): None, ("v2", ""): None}
    assert (tmp_path / "registry/files/v1/x").read_bytes() == b"old"
    assert sorted(p.name for p in tmp_path.iterdir()) == ["registry"]
    assert sorted(p.name for p in (tmp_path / "registry/files").iterdir()) == ["v1"]
    assert sorted(p.name for p in (tmp_path / "registry/files/v1").iterdir()) == ["empty", "x"]


def test_staged_files_are_written_by_many_tasks(spark, tmp_path):
    registry = f"file://{tmp_path}/registry"
    sy.create_registry(spark, registry)
    kind = "release_id string, tag string, ord int, name string, content binary"
    files = spark.createDataFrame([(f"v{i}", f"v{i}", 0, "x", bytearray(b"1" * 50)) for i in range(64)], kind).coalesce(1)
    releases = files.selectExpr("release_id", "tag", "'p' as product", "tag as title", "'stable' as channel", "1L as arrival")
    sy.stage_release(files, releases, registry, 1, content="content")
    assert len(list((tmp_path / "registry/uploads/batches").glob("*/part-*"))) > 1


def test_latest_is_publish_order_not_version_order(spark):
    releases = spark.createDataFrame(
        [
            ("r1", "v0.4.0", "p", "stable", "published", 1),
            ("r2", "v0.3.9", "p", "stable", "published", 2),
            ("r3", "v0.5.0-rc", "p", "prerelease", "published", 3),
            ("r4", "v0.6.0", "p", "stable", "draft", 4),
        ],
        "release_id string, tag string, product string, channel string, state string, seq int",
    )
    files = spark.createDataFrame(
        [(r, n) for r in ("r1", "r2", "r3", "r4") for n in ("release.json", "x.tar.gz")],
        "release_id string, name string",
    )
    got = sy.resolve_latest(releases, files, ["release_id"], ["product"], ["seq"])
    assert sorted((r.tag, r.name) for r in got.collect()) == [
        ("v0.3.9", "release.json"), ("v0.3.9", "x.tar.gz"),
    ]
    any_channel = sy.latest_per_channel(releases, ["product", "channel"], ["seq"], None)
    assert {r.channel: r.tag for r in any_channel.collect()} == {
        "stable": "v0.6.0", "prerelease": "v0.5.0-rc",
    }


@pytest.fixture(scope="module")
def published(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("publish")
    registry = f"file://{root}/registry"
    sy.create_registry(spark, registry)
    dist = root / "dist"
    write_release(dist / "a", "0.4.0")
    write_release(dist / "b", "0.4.0", image=b"another image")
    write_release(dist / "c", "0.5.0-rc.1", image=b"")
    write_release(dist / "d", "0.6.0", manifest=lambda m: m.update(notarized=1))
    candidates = spark.createDataFrame(
        [("a", "v0.4.0", 1), ("b", "v0.4.0", 2), ("c", "v0.5.0-rc.1", 3), ("d", "v0.6.0", 4)],
        "release_id string, tag string, arrival bigint",
    )
    first = sy.publish_folder(spark, CONTRACT, candidates, str(dist), registry, 1)
    after_first = index(spark, registry)
    again = sy.publish_folder(spark, CONTRACT, candidates, str(dist), registry, 2)
    write_release(root / "late" / "e", "0.3.9")
    late = spark.createDataFrame([("e", "v0.3.9", 1)], candidates.schema)
    third = sy.publish_folder(spark, CONTRACT, late, str(root / "late"), registry, 3)
    return root, registry, first, after_first, again, third


def test_publish_folder_publishes_sound_releases(published):
    _, _, (_, found), after_first, _, _ = published
    want = {(t, s) for t in ("v0.4.0", "v0.5.0-rc.1") for s in ("draft", "published")}
    assert after_first == want
    rules = {(r.release_id, r.rule) for r in found.collect()}
    assert rules == {("b", "tag_not_published"), ("d", "strict_true(notarized)")}


def test_publishing_again_admits_nothing(spark, published):
    _, registry, _, after_first, (_, found), _ = published
    now = index(spark, registry)
    assert now - after_first == {("v0.3.9", "draft"), ("v0.3.9", "published")}
    taken = {r.release_id for r in found.collect() if r.rule == "tag_not_published"}
    assert taken == {"a", "b", "c"}


def test_all_files_arrive_whole(spark, published):
    root, registry, *_ = published
    for release, tag in (("a", "v0.4.0"), ("c", "v0.5.0-rc.1")):
        source = {p.name: p.read_bytes() for p in (root / "dist" / release).iterdir()}
        target = {p.name: p.read_bytes() for p in (root / "registry/files" / tag).iterdir()}
        assert source == target and len(target) == 5
    listed = sy.read_upload_listings(spark, registry).where("tag = 'v0.4.0'").collect()
    assert {r.upload_pos for r in listed} == set(range(5)) and all(r.seq == 1 for r in listed)


def test_resolve_reads_the_release_published_last(spark, published):
    _, registry, *_ = published
    releases = sy.scan_releases(spark, releases_path(registry))
    uploads = sy.read_upload_listings(spark, registry).select("release_id", "name", "size")
    latest = sy.resolve_latest(
        releases, uploads, ["release_id"], ["product"], ["seq", "arrival", "tag"]
    ).collect()
    assert {r.tag for r in latest} == {"v0.3.9"} and len(latest) == 5


def test_published_releases_are_validated_where_they_lie(spark, published):
    root, registry, *_ = published
    damaged = root / "registry/files/v0.5.0-rc.1/acme-tool-0.5.0-rc.1-os-cpu.dmg"
    damaged.write_bytes(b"something else")
    _, _, judged = sy.validate_published(spark, CONTRACT, registry)
    got = {r.release_id: r.rule for r in judged.collect()}
    assert got == {"v0.4.0": None, "v0.3.9": None, "v0.5.0-rc.1": "sidecar_matches"}


def test_index_has_title_and_channel(spark, published):
    _, registry, *_ = published
    rows = sy.scan_releases(spark, releases_path(registry)).where("state = 'published'").collect()
    assert {(r.tag, r.title, r.channel) for r in rows} == {
        ("v0.4.0", "acme-tool v0.4.0", "stable"),
        ("v0.3.9", "acme-tool v0.3.9", "stable"),
        ("v0.5.0-rc.1", "acme-tool v0.5.0-rc.1", "prerelease"),
    }


def test_incomplete_upload_stays_a_draft_and_blocks_its_tag(spark, tmp_path):
    registry = f"file://{tmp_path}/registry"
    sy.create_registry(spark, registry)
    rows = spark.createDataFrame([("r1", "v1", 1), ("r2", "v2", 2)], "release_id string, tag string, arrival bigint")
    from pyspark.sql import functions as F

    releases = index_rows(rows, F.lit("p"), F.col("arrival"))
    files = spark.createDataFrame(
        [("r1", "v1", 0, "x", bytearray(b"123")), ("r2", "v2", 0, "x", bytearray(b"123"))],
        "release_id string, tag string, ord int, name string, content binary",
    )
    uploads = sy.stage_release(files, releases, registry, 1, content="content")
    expected = files.withColumn("size", F.when(F.col("tag") == "v1", 3).otherwise(4).cast("bigint"))
    faults = upload_violations(expected, uploads)
    assert [(r.release_id, r.rule, r.message) for r in faults.collect()] == [
        ("r2", "upload_size_matches", "Missing or incomplete upload: x")
    ]
    publish_release(releases, faults, registry, 1)
    assert index(spark, registry) == {("v1", "draft"), ("v2", "draft"), ("v1", "published")}
    taken = sy.scan_releases(spark, releases_path(registry))
    admitted, rejected = sy.reject_existing(rows, taken, ["tag"], ["arrival"])
    assert admitted.count() == 0 and tag_violations(rejected).count() == 2


def test_upload_without_name_is_a_fault_and_extras_are_not(spark):
    expected = spark.createDataFrame([("r1", "a", 1), ("r2", "a", 1)], "release_id string, name string, size bigint")
    uploads = spark.createDataFrame(
        [("r1", "a", 0, 1), ("r1", "x", 1, 9), ("r2", "a", 0, 1), ("r2", None, 1, None)],
        "release_id string, name string, upload_pos int, size bigint",
    )
    found = upload_violations(expected, uploads).collect()
    assert [(r.release_id, r.rule) for r in found] == [("r2", "upload_listing_readable")]


def test_seq_is_never_reused(spark, tmp_path):
    registry = f"file://{tmp_path}/registry"
    sy.create_registry(spark, registry)
    from pyspark.sql import functions as F

    rows = spark.createDataFrame([("r1", "v1", 1)], "release_id string, tag string, arrival bigint")
    releases = index_rows(rows, F.lit("p"), F.col("arrival"))
    none = upload_violations(
        spark.createDataFrame([], "release_id string, name string, size bigint"),
        spark.createDataFrame([], "release_id string, name string, upload_pos int, size bigint"),
    )
    publish_release(releases, none, registry, 1)
    with pytest.raises(sy.AlreadyCommitted, match="ALREADY_EXISTS"):
        publish_release(releases, none, registry, 1)
