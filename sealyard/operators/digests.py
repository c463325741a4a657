"""Content digests, and their check against checksum files and manifest claims."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sealyard.fixed import MESSAGES
from sealyard.operators.rules import Rule, violations
from sealyard.sources.archives import digests_of, read_bytes_once
from sealyard.sources.files import scan_assets
from sealyard.sources.named import balance_by_bytes

def content_digest(content: Column) -> Column:
    """Lower-case hexadecimal SHA-256 of a text or binary column."""
    return F.sha2(content, 256)


def digest_files(releases: DataFrame, path: str, pattern: str = "*") -> DataFrame:
    """``release_id, name, path, length, sha256, error`` of every file in the releases' folders.

    Files of all lengths are read in chunks, each byte once. One that cannot be opened has
    no digest, and the reason as ``error``.
    """
    files = balance_by_bytes(scan_assets(releases, path, pattern))
    found = read_bytes_once(files, ["release_id", "name", "path"], archives=False)
    return digests_of(found, ["release_id", "name", "path"]).select(
        "release_id", "name", "path", "length", "sha256", "error"
    )


def verify_digests(
    expected: DataFrame,
    assets: DataFrame,
    sidecars: DataFrame,
    key: Sequence[str],
    phase: int = 3,
) -> DataFrame:
    """Violations of the asset rules 13 to 15.

    ``expected`` has ``key, item_pos, kind, name, claimed_sha256``, assets ``key, name,
    sha256`` and sidecars ``key, name, fields`` with the name of the asset, not of the
    checksum file. Only the kind ``archive`` has a claim in the manifest.
    """
    return violations(asset_facts(expected, assets, sidecars, key), key, asset_rules(phase))


def asset_facts(
    expected: DataFrame, assets: DataFrame, sidecars: DataFrame, key: Sequence[str]
) -> DataFrame:
    """Each expected asset beside what was found; both joins share one partitioning."""
    by = [*key, "name"]
    found = assets.select(*by, "sha256", F.lit(True).alias("_present"))
    claims = sidecars.select(*by, "fields")
    return expected.join(found, by, "left").join(claims, by, "left")


def asset_rules(phase: int = 3) -> list[Rule]:
    present = F.col("_present").isNotNull()
    at = {"phase": phase, "item_pos": F.col("item_pos")}
    return [
        Rule("asset_present", 13, present, F.concat(F.lit(MESSAGES["asset_present"]), "name"), **at),
        Rule(
            "sidecar_matches",
            14,
            ~present | sidecar_matches(F.col("fields"), F.col("sha256"), F.col("name")),
            F.concat(F.lit(MESSAGES["sidecar_matches"]), "name"),
            **at,
        ),
        Rule(
            "digest_matches_manifest",
            15,
            ~present
            | (F.col("kind") != "archive")
            | (F.col("sha256") == F.col("claimed_sha256")),
            MESSAGES["digest_matches_manifest"],
            sub_pos=1,
            **at,
        ),
    ]


def sidecar_matches(fields: Column, sha256: Column, name: Column) -> Column:
    """The checksum file says exactly: this digest, this name."""
    return F.coalesce(fields == F.array(sha256, name), F.lit(False))
