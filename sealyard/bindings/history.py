"""The registry over time: left-over drafts, snapshots and compaction, over the given tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import functions as F

from sealyard import (
    compact_releases,
    create_registry,
    materialise,
    publish_release as publish,
    reject_existing,
    scan_releases as scan_index,
    withdraw_draft as withdraw,
)
from sealyard.bindings import query, table
from sealyard.bindings.releases import _PUBLISHED, _tagged_documents
from sealyard.plans.publish import draft_release, index_rows, releases_path
from sealyard.session import fresh_folder


def _admit_and_publish(candidates, registry, seq):
    """Draft those candidates whose tags are free, and publish the complete ones."""
    index = scan_index(candidates.sparkSession, releases_path(registry))
    admitted, _ = reject_existing(candidates, index, ["tag"], ["doc_id"])
    admitted = materialise(admitted)
    rows = index_rows(admitted, F.col("source"), F.col("doc_id"))
    draft_release(rows, registry, seq)
    faults = admitted.where(~F.coalesce(F.col("complete"), F.lit(False))).select("release_id")
    return publish(rows, faults, registry, seq)


# Texts with characters of several bytes count as incompletely uploaded, and stay drafts at first.
@query(f"""
    SELECT doc_id::VARCHAR AS release_id, tag, s.state, CASE WHEN whole THEN 1 ELSE 3 END::BIGINT AS seq
    FROM (SELECT *, strlen(text) = n_chars AS whole FROM ({_PUBLISHED})), (VALUES ('draft'), ('published')) AS s(state)
    UNION ALL
    SELECT NULL, tag, 'refused: published', 2 FROM ({_PUBLISHED}) WHERE strlen(text) = n_chars
    UNION ALL
    SELECT NULL, tag || '?', 'refused: no draft', 2 FROM ({_PUBLISHED})
""")
def withdraw_draft(spark, sf_dir):
    """The index after withdrawing all drafts and trying their releases again, and what could not be withdrawn."""
    registry = fresh_folder(spark, "registry")
    create_registry(spark, registry)
    candidates = materialise(_tagged_documents(spark, sf_dir))
    _admit_and_publish(candidates, registry, 1)
    unknown = F.concat("tag", F.lit("?")).alias("tag")
    _, refused = withdraw(candidates.select("tag").unionByName(candidates.select(unknown)), registry, 2)
    index = _admit_and_publish(candidates.withColumn("complete", F.lit(True)), registry, 3)
    told = refused.select(
        F.lit(None).cast("string").alias("release_id"), "tag",
        F.concat(F.lit("refused: "), "reason").alias("state"), F.lit(2).cast("bigint").alias("seq"),
    )
    return index.select("release_id", "tag", "state", "seq").unionByName(told)


_BATCHES = ("en", "fr", "de", "es")
_LAST = len(_BATCHES) + 2


@query(f"""
    WITH batch AS (
      SELECT doc_id, source, strlen(text) = n_chars AS whole,
        CASE lang WHEN 'en' THEN 1 WHEN 'fr' THEN 2 WHEN 'de' THEN 3 WHEN 'es' THEN 4 END AS seq
      FROM documents WHERE lang IN ('en', 'fr', 'de', 'es')
    ), entries AS (
      SELECT source, doc_id, 'draft' AS state, seq, CASE WHEN NOT whole AND seq <= 3 THEN 5 ELSE 99 END AS until FROM batch
      UNION ALL SELECT source, doc_id, 'published', seq, 99 FROM batch WHERE whole
      UNION ALL SELECT source, doc_id, s.state, 6, 99 FROM batch, (VALUES ('draft'), ('published')) AS s(state)
        WHERE NOT whole AND seq <= 3
    )
    SELECT a.as_of, c.compacted, source AS product, state, count(*) AS releases, sum(doc_id)::BIGINT AS arrivals
    FROM entries, (SELECT unnest(range({_LAST + 1})) AS as_of) a, (VALUES (false), (true)) AS c(compacted)
    WHERE seq <= a.as_of AND a.as_of < until AND (compacted OR a.as_of < {_LAST})
    GROUP BY a.as_of, c.compacted, source, state
""")
def snapshots(spark, sf_dir):
    """The index as of each batch, before and after a compaction that is followed by one batch more.

    A batch per language; then the drafts of the first three are withdrawn, and tried again last.
    """
    registry = fresh_folder(spark, "registry")
    log = releases_path(registry)
    create_registry(spark, registry)
    documents = table(spark, sf_dir, "documents").where(F.col("lang").isin(*_BATCHES))
    candidates = materialise(
        documents.select(
            F.col("doc_id").cast("string").alias("release_id"), F.concat(F.lit("v"), "doc_id").alias("tag"),
            "doc_id", "source", "lang", (F.octet_length("text") == F.col("n_chars")).alias("complete"),
        )
    )
    for seq, lang in enumerate(_BATCHES, 1):
        _admit_and_publish(candidates.where(F.col("lang") == lang), registry, seq)

    def seen(as_of, compacted):
        rows = scan_index(spark, log, as_of).groupBy("product", "state")
        counted = rows.agg(F.count("*").alias("releases"), F.sum("arrival").alias("arrivals"))
        return counted.withColumns({"as_of": F.lit(as_of).cast("bigint"), "compacted": F.lit(compacted)})

    def all_seen(compacted, upto):
        return reduce(lambda a, b: a.unionByName(b), [seen(n, compacted) for n in range(upto + 1)])

    early = materialise(all_seen(False, 2))
    leftovers = candidates.where(~F.col("complete") & F.col("lang").isin(*_BATCHES[:3]))
    withdraw(leftovers.select("tag"), registry, 5)
    late = materialise(all_seen(False, 5).where("as_of > 2"))
    compact_releases(spark, log)
    _admit_and_publish(leftovers.withColumn("complete", F.lit(True)), registry, 6)
    return early.unionByName(late).unionByName(all_seen(True, 6))
