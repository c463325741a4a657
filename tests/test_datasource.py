"""Release folders as a data source: filters reach the listing, and nothing runs before the action."""

import hashlib
import io
import tarfile

import pytest
from pyspark.sql import functions as F

import sealyard as sy
from sealyard.sources import datasource
from sealyard.sources.archives import digests_of, members_of, read_bytes_once
from sealyard.sources.datasource import ARCHIVES, FileRow, in_shares


def packed(names):
    target = io.BytesIO()
    with tarfile.open(fileobj=target, mode="w:gz") as archive:
        for name in names:
            info = tarfile.TarInfo(name)
            info.size = 1
            archive.addfile(info, io.BytesIO(b"x"))
    return target.getvalue()


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("source")
    for i in range(20):
        place = root / f"r{i:02d}"
        place.mkdir()
        (place / "a.tar.gz").write_bytes(packed([f"m{k}" for k in range(i)]))
        (place / "b.tar.gz").write_bytes(b"no archive" if i % 2 else packed(["x"] * 50)[:40])
        (place / "empty").write_bytes(b"")
        (place / "long").write_bytes(b"z" * 1000 * i)
        (place / "below").mkdir()
    (root / "not a release").write_text("x")
    return root


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def releases(spark):
    return spark.createDataFrame([(f"r{i:02d}",) for i in range(20)], "release_id string")


def test_files_are_those_that_tasks_list(spark, folder):
    found = sy.read_release_files(spark, str(folder))
    assert rows(found) == rows(sy.scan_assets(releases(spark), str(folder)))
    assert found.columns == ["release_id", "name", "path", "length"]


def test_archives_are_listed_as_from_a_table_of_paths(spark, folder):
    found = sy.read_release_files(spark, str(folder), ARCHIVES, ["*.tar.gz"])
    files = sy.scan_assets(releases(spark), str(folder), "*.tar.gz")
    want = read_bytes_once(files, ["release_id", "name"], True)
    assert rows(found) == rows(want)
    key = ["release_id", "name"]
    members = members_of(found.where("name = 'a.tar.gz'").withColumnRenamed("name", "archive"), ["release_id", "archive"])
    assert members.count() == sum(range(20))
    told = {(r.release_id, r.name): (r.sha256, r.error is None) for r in digests_of(found, key).collect()}
    for i in range(20):
        data = (folder / f"r{i:02d}/a.tar.gz").read_bytes()
        assert told[f"r{i:02d}", "a.tar.gz"] == (hashlib.sha256(data).hexdigest(), True)
        assert told[f"r{i:02d}", "b.tar.gz"][1] is False


@pytest.mark.parametrize("names, n", [
    (["empty"], 20), (["empty", "long", "x"], 40), (["a*"], 20), (["*.gz"], 40), (["*on*"], 20), (["EMPTY"], 0),
])
def test_names_are_left_out_where_files_are_listed(spark, folder, names, n):
    found = sy.read_release_files(spark, str(folder), names=names)
    assert found.count() == n
    listed = datasource._FileReader({"path": f"file:{folder}", "names": "\n".join(names)}, 8).listing()
    assert len(listed) == n


def test_queries_on_one_table_do_not_touch_each_other(spark, folder):
    found = sy.read_release_files(spark, str(folder))
    assert found.where("length > 5000 AND name = 'long'").count() == 14
    assert found.where("name = 'long' OR length = 0").count() == 40
    assert found.where("upper(name) = 'LONG'").count() == 20 and found.where("release_id = 'r03'").count() == 4
    assert found.where("name IS NULL").count() == 0 and found.where("name <> 'long'").count() == 60
    one, two = found.where("name = 'long'"), found.where("name = 'empty'")
    assert one.join(two, "release_id").count() == 20 and found.count() == 80


def test_only_the_archives_asked_for_are_opened(spark, folder, tmp_path):
    place = tmp_path / "r1"
    place.mkdir()
    (place / "a.tar.gz").write_bytes(packed(["m"]))
    (place / "b.tar.gz").write_bytes(packed(["m"]))
    (place / "b.tar.gz").chmod(0)
    found = sy.read_release_files(spark, str(tmp_path), ARCHIVES, ["a.tar.gz"])
    assert found.where("error IS NOT NULL").count() == 0 and found.count() == 2


def test_no_job_runs_before_the_action(spark, folder):
    spark.sparkContext.setJobGroup("before the action", "")
    try:
        found = sy.read_release_files(spark, str(folder), ARCHIVES, ["a.tar.gz"]).groupBy("error").count()
        jobs = spark.sparkContext.statusTracker().getJobIdsForGroup("before the action")
        assert list(jobs) == []
        assert found.collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_shares_have_like_bytes_and_a_long_file_has_its_own():
    files = [FileRow("r", str(i), "p", n) for i, n in enumerate([10, 10, 10, 500, 10, 0, 0, 90, 5])]
    shares = [[f.length for f in share] for share in in_shares(files, 100, 4)]
    assert shares == [[10, 10, 10], [500], [10, 0, 0, 90], [5]]
    assert in_shares([], 100, 4) == []


def test_work_is_spread_by_bytes(spark, folder):
    found = sy.read_release_files(spark, str(folder), names=["long"], bytesPerTask=20_000)
    sizes = found.groupBy(F.spark_partition_id().alias("task")).agg(F.sum("length").alias("n"), F.count("*").alias("files"))
    got = [(r.n, r.files) for r in sizes.collect()]
    assert sum(n for n, _ in got) == 190_000 and all(n <= 20_000 or files == 1 for n, files in got) and len(got) >= 10


def test_some_releases_and_an_absent_folder(spark, folder, tmp_path):
    some = sy.read_release_files(spark, str(folder), releases="r01\nr02\nnone")
    assert some.select("release_id").distinct().count() == 2
    assert sy.read_release_files(spark, str(folder), releases="").count() == 0
    (tmp_path / "void").mkdir()
    assert sy.read_release_files(spark, str(tmp_path / "void")).count() == 0
    with pytest.raises(Exception, match="none such"):
        sy.read_release_files(spark, str(tmp_path / "none such")).count()
    with pytest.raises(ValueError, match="path"):
        datasource._FileReader({}, 1)
