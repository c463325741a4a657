"""Validation that remembers: what is as it was when it was judged is not judged again.

Results are kept in a log of batches, under a fingerprint of all that a verdict depends on: the release's tag, manifest
and files, and the rules with their parameters. A later run judges releases whose fingerprint has no result yet and
takes the others' findings from the log. Findings and the marks that say "judged" are one batch, so a run that fails
half-way has judged nothing; its releases are judged by the next. The result is that of a full run.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard import fixed
from sealyard.fixed import MANIFEST_NAME
from sealyard.operators.rules import verdicts
from sealyard.plans.contract import ReleaseContract
from sealyard.plans.validate import KEY, manifest_facts, release_inventory, validate_folder, validate_releases
from sealyard.session import materialise
from sealyard.sources.commits import commit, compact, read_log
from sealyard.sources.named import file_states, qualified, read_texts

#: To be raised whenever a rule itself changes, so that nothing judged by the rules before counts.
RULES_VERSION = 1
_FINDING = "phase int, item_pos bigint, rule_ord int, sub_pos int, rule string, message string"


def _schema(candidates: DataFrame) -> str:
    kind = candidates.schema["release_id"].dataType.simpleString()
    return f"release_id {kind}, fingerprint string, {_FINDING}, seq bigint"


def create_results(candidates: DataFrame, log: str) -> None:
    """A new, empty log of results for releases with ids like those of ``candidates``; needs to be done once."""
    spark = candidates.sparkSession
    commit(spark.createDataFrame([], _schema(candidates)), log, 0, "created")


def compact_results(candidates: DataFrame, log: str) -> None:
    """Fold the batches of a log of results into large files, ordered by release."""
    compact(candidates.sparkSession, log, _schema(candidates), "release_id")


def rules_fingerprint(contract: ReleaseContract) -> str:
    """SHA-256 of the parameters of all rules, their texts and their version."""
    values = {name: getattr(fixed, name) for name in dir(fixed) if name.isupper()}
    text = json.dumps([RULES_VERSION, asdict(contract), values], sort_keys=True)
    return hashlib.sha256(text.encode()).hexdigest()


def release_fingerprints(contract: ReleaseContract, candidates: DataFrame, tables: Sequence[DataFrame]) -> DataFrame:
    """``release_id, fingerprint`` of each candidate, from its rows in all tables, in any order.

    Each row has a SHA-256, spread over four numbers by hashes with different seeds; a release has the sums of its rows'
    numbers, by 32 bits, which combine before the shuffle, so a release with millions of members is one row a task.
    NULL is a value like others.
    """
    rows = None
    for i, df in enumerate([candidates.select("release_id", "tag"), *tables]):
        told = F.to_json(F.struct(F.lit(i).alias("_table"), *sorted(df.columns)), {"ignoreNullFields": "false"})
        part = df.select("release_id", F.sha2(told, 256).alias("digest"))
        rows = part if rows is None else rows.unionByName(part)
    numbers = [F.xxhash64(F.lit(i), "digest") for i in range(4)]
    halves = [half for n in numbers for half in (n.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(n, 32))]
    sums = [F.sum(half) for half in halves]
    total = rows.groupBy("release_id").agg(F.count("*").alias("n"), *[s.alias(f"s{i}") for i, s in enumerate(sums)])
    whole = F.concat_ws(":", F.lit(rules_fingerprint(contract)), "n", *[f"s{i}" for i in range(8)])
    found = total.select("release_id", F.sha2(whole, 256).alias("fingerprint"))
    return found.join(candidates.select("release_id"), KEY, "left_semi")


def judge_changed(
    fingerprints: DataFrame, judge: Callable[[DataFrame], DataFrame], log: str, seq: int
) -> tuple[DataFrame, DataFrame]:
    """``(violations, judged)`` of all releases: ``judge`` sees the ids of those without a result, and ``judged`` has them.

    The batch is committed under ``seq``; raises ``AlreadyCommitted`` if another run has that number.
    """
    spark = fingerprints.sparkSession
    schema = _schema(fingerprints)
    both = ["release_id", "fingerprint"]
    kept = read_log(spark, log, schema)
    # A row without a rule says that a release was judged; several runs may have judged it at the same time.
    marks = kept.where("rule IS NULL").groupBy(*both).agg(F.max("seq").alias("seq"))
    current = materialise(fingerprints.join(marks, both, "left"))
    changed = current.where("seq IS NULL").select(*both)
    found = materialise(judge(changed.select(*KEY)))
    finding = ["phase", "item_pos", "rule_ord", "sub_pos", "rule", "message"]
    nothing = [F.lit(None).cast(field.split()[1]).alias(field.split()[0]) for field in _FINDING.split(", ")]
    rows = found.join(changed, KEY).select(*both, *finding).unionByName(changed.select(*both, *nothing))
    commit(rows.withColumn("seq", F.lit(seq).cast("bigint")), log, seq, "judged")
    known = current.where("seq IS NOT NULL")
    earlier = kept.where("rule IS NOT NULL").join(known, [*both, "seq"], "left_semi")
    return found.unionByName(earlier.select(*found.columns)), changed.select(*KEY)


def validate_changed_releases(
    contract: ReleaseContract,
    candidates: DataFrame,
    manifests: DataFrame,
    assets: DataFrame,
    sidecars: DataFrame,
    members: DataFrame,
    log: str,
    seq: int,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(violations, verdicts, judged)``: as ``validate_releases``, judging those that have changed only."""
    tables = [manifests, assets, sidecars, members]
    fingerprints = materialise(release_fingerprints(contract, candidates, tables))

    def judge(changed: DataFrame) -> DataFrame:
        some = [df.join(changed, KEY, "left_semi") for df in (candidates, *tables)]
        return validate_releases(contract, *some)[0]

    found, judged = judge_changed(fingerprints, judge, log, seq)
    return found, verdicts(candidates, found, KEY), judged


def validate_changed_folders(
    spark: SparkSession, contract: ReleaseContract, candidates: DataFrame, path: str, log: str, seq: int
) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """``(inventory, violations, verdicts, judged)``: as ``validate_folder``, reading changed releases' files only.

    Manifests are read always; of the other files length and time of the last change are asked for, and a file for
    which both are as before is taken to be as before. They are asked for before any byte is read, so a file that
    changes meanwhile has another fingerprint in the next run.
    """
    root = F.lit(qualified(spark, path))
    named = candidates.select("release_id", F.concat_ws("/", root, "release_id", F.lit(MANIFEST_NAME)).alias("path"))
    texts = materialise(read_texts(named, KEY))
    facts = manifest_facts(contract, candidates, texts)
    inventory = release_inventory(contract, facts).withColumn("path", F.concat_ws("/", root, "release_id", "name"))
    inventory = materialise(inventory)
    states = file_states(inventory, ["release_id", "name"])
    fingerprints = materialise(release_fingerprints(contract, candidates, [texts, states]))

    def judge(changed: DataFrame) -> DataFrame:
        return validate_folder(spark, contract, candidates.join(changed, KEY, "left_semi"), path)[1]

    found, judged = judge_changed(fingerprints, judge, log, seq)
    verdict = materialise(verdicts(candidates, found, KEY))
    passed = inventory.join(verdict.where("passed").select(*KEY), KEY, "left_semi")
    return passed, found, verdict, judged
