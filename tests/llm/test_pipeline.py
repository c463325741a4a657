"""The pipeline's stages, each against brute force over its own input, and the registration."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from sealyard.llm import registered
from tests.llm import cases
from tests.llm.test_sets import removed, similar
from tests.llm.test_texts import base_counts, check_pieces


@pytest.fixture(scope="module")
def folder(tmp_path_factory, spark):
    path = str(tmp_path_factory.mktemp("tables"))
    rows = cases.documents() + [(100 + i, cases.words(200 + i, 80), "en", "a", 1) for i in range(20)]
    cases.frame(spark, rows).coalesce(2).write.parquet(f"{path}/documents.parquet")
    labels = spark.createDataFrame([(100 + i, 1, 0) for i in range(20)], "doc_id bigint, quality int, toxic int")
    labels.write.parquet(f"{path}/labels.parquet")
    return path


@pytest.fixture(scope="module")
def written(folder, spark, tmp_path_factory):
    """What goes into and comes out of each stage."""
    docs, out = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stages") / name)
        stage(spark, docs, folder).write.parquet(path)
        out[name] = (docs, spark.read.parquet(path))
        docs = out[name][1]
    return out


def test_columns_stay_until_the_last_stage(written):
    for name, (given, made) in list(written.items())[:-1]:
        assert made.columns == given.columns, name
        assert made.where("kept = 'given' and score = 'given' and _doc = 'given'").count() == made.count(), name


def test_language_stage_rejects_texts_without_letters(written):
    given, made = written["language_id"]
    lettered = [r.doc_id for r in given.collect() if any(c.isalpha() for c in r.text or "")]
    assert set(lettered) >= {r.doc_id for r in made.collect()}
    assert {100 + i for i in range(20)} <= {r.doc_id for r in made.collect()}


def test_quality_stage_applies_the_base_rules(written):
    given, made = written["quality_rules"]
    passed = {r.doc_id for r in given.collect() if not base_counts(r.text)[-1]}
    kept = {r.doc_id for r in made.collect()}
    assert kept <= passed and {100 + i for i in range(20)} <= kept


def test_jaccard_stage_keeps_one_of_each_group(written):
    given, made = written["jaccard_join"]
    expected = [e[0] for e in similar([(r.doc_id, r.text) for r in given.collect()]) if e[3]]
    assert sorted(map(str, (r.doc_id for r in made.collect()))) == sorted(map(str, expected))


def test_suffix_stage_removes_copied_bytes(written):
    given, made = written["suffix_dedup"]
    expected = removed([(r.doc_id, r.text) for r in given.collect()])
    sizes = {e[0]: e[1] - e[2] for e in expected}
    for r in made.collect():
        assert len(r.text.encode()) == sizes[r.doc_id] and r.n_chars == len(r.text)
    assert made.count() == given.count()


def test_packing_stage_holds_every_id(written):
    import public_tokenizers
    from tokenizers import Tokenizer

    given, made = written["packing"]
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    check_pieces(made.collect(), [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 1]) for r in given.collect()])


def test_empty_tables_pass_through(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet").where(F.lit(False))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder).count() == 0, name


def test_run_is_the_stages_in_order(spark, sf_dir):
    rows = corpus_pipeline.run(spark, sf_dir).select("doc_id", "length").collect()
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert 0 < len({r.doc_id for r in rows}) < given.count() and min(r.length for r in rows) > 0


def test_eleven_queries_are_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)) and "pipeline" in names
    queries, sql = registered()
    assert sql.keys() <= queries.keys()
