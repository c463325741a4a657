"""File sources, digests and archive listings against plain Python on small folders."""

import hashlib
import io
import json
import tarfile

import pytest
from builder import archive_bytes, member, members_of
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.operators.digests import digest_files
from sealyard.sources.archives import digests_of, members_of as listed_members, read_bytes_once
from sealyard.sources.named import balance_by_bytes, file_lengths, read_texts
from sealyard.sources.streams import HashingReader, copy_file, locate


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("files")
    for release in ("r1", "r+2 %20"):
        place = root / release
        place.mkdir()
        (place / "a.bin").write_bytes(release.encode() * 1000)
        (place / "b.bin").write_bytes(bytes(range(256)) * 9000)
        (place / "a.bin.sha256").write_text("abc \t a.bin\n")
        listing = {"assets": [
            {"name": "a.bin", "size": 5}, {"name": "a.bin", "size": 7}, {"name": "b.bin", "size": "9"},
            {"name": "c.bin"},
        ]}
        (place / "uploaded-assets.json").write_text(json.dumps(listing))
        (place / "release.json").write_text(json.dumps({"models": [{"id": 1, "x": None}, 5]}))
    (root / "r3").mkdir()
    (root / "r3" / "release.json").write_text('{"models": {"a": 1}}')
    (root / "r3" / "empty.bin").write_bytes(b"")
    (root / "r3" / "empty.sha256").write_bytes(b"")
    (root / "r4").mkdir()
    (root / "r4" / "release.json").write_bytes(b"")
    return root


@pytest.fixture(scope="module")
def releases(spark):
    names = ["r1", "r+2 %20", "r3", "r4", "no such release", None]
    return spark.createDataFrame([(n,) for n in names], "release_id string")


def test_scan_assets_lists_files_of_all_lengths(releases, folder):
    rows = {(r.release_id, r.name): r.length for r in sy.scan_assets(releases, str(folder), "*.bin").collect()}
    assert rows == {
        ("r1", "a.bin"): 2000, ("r1", "b.bin"): 256 * 9000, ("r+2 %20", "a.bin"): 7000,
        ("r+2 %20", "b.bin"): 256 * 9000, ("r3", "empty.bin"): 0,
    }


def test_digest_files_of_all_lengths(releases, folder):
    rows = digest_files(releases, str(folder), "*.bin").collect()
    assert len(rows) == 5
    for row in rows:
        data = (folder / row.release_id / row.name).read_bytes()
        assert (row.length, row.sha256) == (len(data), hashlib.sha256(data).hexdigest())
        assert row.error is None


def test_scan_sidecars(releases, folder):
    rows = {r.release_id: (r.name, r.fields) for r in sy.scan_sidecars(releases, str(folder)).collect()}
    assert rows == {k: ("a.bin", ["abc", "a.bin"]) for k in ("r1", "r+2 %20")} | {"r3": ("empty", [])}


def test_scan_manifests_sees_empty_files(releases, folder):
    rows = {r.release_id: r.raw for r in sy.scan_manifests(releases, str(folder)).collect()}
    assert rows.keys() == {"r1", "r+2 %20", "r3", "r4"} and rows["r4"] == ""


def test_scan_uploads_keeps_positions_and_number_types(releases, folder):
    rows = sy.scan_uploads(releases, str(folder)).where("release_id = 'r1'").orderBy("upload_pos")
    assert [(r.name, r.size) for r in rows.collect()] == [("a.bin", 5), ("a.bin", 7), ("b.bin", None), (None, None)]


def test_scan_models(releases, folder):
    manifests = sy.scan_manifests(releases, str(folder))
    rows = sy.scan_models(manifests).where("release_id <> 'r3'").orderBy("release_id", "model_pos")
    assert [(r.model_pos, r["keys"]) for r in rows.collect()] == [(0, ["id", "x"]), (1, None)] * 2
    assert sy.scan_models(manifests).where("release_id = 'r3'").count() == 0


def test_absent_registry_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        sy.scan_releases(spark, str(tmp_path / "none")).count()


def test_balance_by_bytes_parts_the_work(spark):
    files = spark.range(400).selectExpr("concat('f', id) as path", "if(id % 50 = 0, 1000L, 10L) as length")
    spread = balance_by_bytes(files, bytes_per_task=500)
    sizes = [sum(r.length for r in part) for part in spread.rdd.glom().collect()]
    assert sum(sizes) == 8 * 1000 + 392 * 10 and len(sizes) > 8
    assert max(sizes) <= 2 * 1000


def test_texts_are_handed_on_by_bytes(spark, tmp_path, monkeypatch):
    import sealyard.sources.named as named

    monkeypatch.setattr(named, "_BATCH_BYTES", 100)
    for i in range(40):
        (tmp_path / f"t{i}").write_text("x" * (i * 7))
    files = spark.createDataFrame([(i, f"{tmp_path}/t{i}") for i in range(40)], "k int, path string")
    assert {r.k: len(r.raw) for r in read_texts(files, ["k"]).collect()} == {i: i * 7 for i in range(40)}


def test_named_files(spark, folder, tmp_path):
    (tmp_path / "bad").write_bytes(b"\xff")
    (tmp_path / "empty").write_bytes(b"")
    names = [str(folder / "r+2 %20" / "a.bin.sha256"), f"file://{tmp_path}/bad",
             f"file:{tmp_path}/empty", f"{tmp_path}/none", str(tmp_path)]
    files = spark.createDataFrame(list(enumerate(names)), "k int, path string")
    texts = {r.k: r.raw for r in read_texts(files.limit(4), ["k"]).collect()}
    assert texts == {0: "abc \t a.bin\n", 1: None, 2: "", 3: None}
    lengths = {r.k: r.length for r in file_lengths(files, ["k"], files_per_task=1).collect()}
    assert lengths == {0: 12, 1: 1, 2: 0, 3: None, 4: None}


def wide_archive(count):
    return archive_bytes([member("b", tarfile.DIRTYPE)] + [
        member(f"b/{'x' * (i % 120)}{i}", data=b"d" * (i % 700)) for i in range(count)
    ])


def test_listing_equals_tarfile_and_digest_covers_all_bytes(spark):
    archives = {
        1: archive_bytes(members_of("b")),
        2: wide_archive(9000),
        3: archive_bytes(members_of("b")) + b"after the end",
        4: b"no archive",
        5: wide_archive(50)[:-200],
        6: b"",
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in archives.items()], "k int, c binary")
    listing = read_bytes_once(df, ["k"], True, "c").cache()
    digests = {r.k: r for r in digests_of(listing, ["k"]).collect()}
    for k, data in archives.items():
        assert digests[k].sha256 == hashlib.sha256(data).hexdigest()
        assert digests[k].length == len(data)
    assert [k for k in archives if digests[k].error is None] == [1, 2, 3]
    for k in (1, 2):
        with tarfile.open(fileobj=io.BytesIO(archives[k])) as archive:
            want = [(i, m.name, m.mode, m.linkname) for i, m in enumerate(archive.getmembers())]
        rows = listed_members(listing, ["k"]).where(F.col("k") == k).orderBy("member_pos").collect()
        assert [(r.member_pos, r.name, r.mode, r.linkname) for r in rows] == want
    listing.unpersist()


def test_missing_file_is_a_row_not_a_failure(spark, tmp_path):
    df = spark.createDataFrame([("a", f"file:{tmp_path}/none")], "k string, path string")
    row = read_bytes_once(df, ["k"], False).collect()[0]
    assert row.sha256 is None and row.error


def test_hashing_reader_counts_each_byte_once():
    data = bytes(range(256)) * 50
    reader = HashingReader(io.BytesIO(data))
    reader.read(100)
    reader.seek(50)
    reader.read(200)
    reader.seek(5000)
    reader.read(10)
    assert reader.finish() == hashlib.sha256(data).hexdigest() and reader.digested == len(data)


def test_read_failure_is_raised_not_reported():
    class Failing(io.BytesIO):
        def read(self, size=-1):
            raise OSError("disk")

    from sealyard.sources.archives import listing_rows

    with pytest.raises(OSError, match="disk"):
        list(listing_rows(Failing(b"x"), True))


def test_list_archives_tells_of_damage(spark):
    whole = wide_archive(300)
    df = spark.createDataFrame([(1, bytearray(whole)), (2, bytearray(whole[: len(whole) // 2])), (3, bytearray(b"no"))], "k int, c binary")
    rows = sy.list_archives(df, ["k"], content="c").collect()
    errors = {r.k: r.error for r in rows if r.error is not None}
    assert errors.keys() == {2, 3} and errors[3] == "not a gzip file"
    members = {k: sum(r.k == k and r.member_pos is not None for r in rows) for k in (1, 2, 3)}
    assert members[1] == 301 and 0 < members[2] < 301 and members[3] == 0


def test_batches_with_contents_are_bounded_by_bytes(spark):

    rows = spark.range(0, 40, 1, 1).select(F.col("id").alias("k"), F.repeat(F.lit("x"), 300_000).cast("binary").alias("c"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    digests = digests_of(read_bytes_once(rows, ["k"], False, "c"), ["k"]).collect()
    assert {(d.sha256, d.length) for d in digests} == {(hashlib.sha256(b"x" * 300_000).hexdigest(), 300_000)} and len(digests) == 40
    found = rows.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    assert sum(r.rows for r in found) == 40 and max(r.bytes for r in found) < (1 << 20) + 400_000


def test_archives_of_releases_are_built_from_bounded_batches(spark):
    from sealyard.bindings.releases import packed_documents

    own = spark.newSession()  # whose limits no other query has set
    documents = own.range(0, 40, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 300_000).alias("text"))

    def sizes(batches):
        import pyarrow as pa

        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows]), pa.array([batch.nbytes])], ["rows", "bytes"])

    assert packed_documents(documents, F.lit("b"), F.lit(None).cast("string")).count() == 40
    found = documents.mapInArrow(sizes, "rows bigint, bytes bigint").collect()
    assert sum(r.rows for r in found) == 40 and max(r.bytes for r in found) < (1 << 20) + 400_000


def test_copy_file_never_replaces(tmp_path):
    target = f"file://{tmp_path}/t"
    assert copy_file(b"one", target) == 3 and copy_file(b"one", target) == 3
    assert copy_file(b"two!", target) is None and (tmp_path / "t").read_bytes() == b"one"
    assert [p.name for p in tmp_path.iterdir()] == ["t"]


def test_copy_file_is_repeatable(tmp_path):
    source = tmp_path / "s#1 ?.bin"
    source.write_bytes(b"x" * 3_000_000)
    # The name must not make any layer compress or decompress.
    target = f"file://{tmp_path}/deep/er/t.bin.gz"
    assert copy_file(f"file:{source}", target) == copy_file(str(source), target) == 3_000_000
    assert (tmp_path / "deep/er/t.bin.gz").read_bytes() == source.read_bytes()
    assert [p.name for p in (tmp_path / "deep/er").iterdir()] == ["t.bin.gz"]


def test_locate_local_forms():
    assert locate("file:/a/b")[1] == locate("file:///a/b")[1] == locate("/a/b")[1] == "/a/b"
