"""Validation of many releases at once: from tables to violations and verdicts.

Phases, in the order a sequential check goes through them: 1 manifest, 2 model
catalog, 3 assets, 4 archive readable, 5 archive members, 6 required members,
7 tag not taken, 8 uploads complete.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sealyard.fixed import (
    ARCHIVE_SUFFIX,
    COMMIT_PATTERN,
    EXECUTE_BITS,
    IMAGE_SUFFIX,
    MANIFEST_NAME,
    MESSAGES,
    MODEL_KEYS,
    SIDECAR_SUFFIX,
    TAG_PREFIX,
    VERSION_PATTERN,
)
from sealyard.functions.documents import (
    json_document,
    key_list,
    object_fields,
    string_value,
)
from sealyard.functions.predicates import (
    FILE,
    SYMLINK,
    allowed_kind,
    columns_equal,
    equals_constant,
    full_match,
    link_allowlist,
    member_property,
    nonempty_array,
    nonempty_object,
    path_root,
    safe_path,
    strict_true,
)
from sealyard.functions.text import path_parts, quoted, split_fields, strip_slashes
from sealyard.operators.digests import asset_facts, asset_rules
from sealyard.operators.inventory import expected_inventory
from sealyard.operators.rules import (
    Rule,
    missing_key_violations,
    required_keys,
    verdicts,
    violations,
)
from sealyard.plans.contract import ReleaseContract
from sealyard.session import configure, materialise
from sealyard.sources.archives import digests_of, members_of, read_bytes_once
from sealyard.sources.files import explode_models
from sealyard.sources.named import balance_by_bytes, file_lengths, qualified, read_texts

KEY = ["release_id"]


def manifest_facts(
    contract: ReleaseContract, candidates: DataFrame, manifests: DataFrame
) -> DataFrame:
    """One row per candidate with what the rules ask of its manifest.

    ``candidates`` has ``release_id, tag``, manifests ``release_id, raw``. The text is
    parsed once; ``document`` is kept for the catalog and pruned where unused.
    """
    configure(candidates.sparkSession)
    parsed = (
        candidates.select("release_id", "tag")
        .join(manifests.select("release_id", "raw"), KEY, "left")
        .select("release_id", "tag", json_document(F.col("raw")).alias("document"))
    )
    fields = parsed.select("*", object_fields(F.col("document")).alias("fields"))

    def value(key: str) -> Column:
        return F.expr(f"try_element_at(fields, {quoted(key)})")

    typed = fields.select(
        "release_id",
        "tag",
        "document",
        F.col("document").isNotNull().alias("readable"),
        key_list(F.col("fields")).alias("keys"),
        *[
            string_value(value(key)).alias(key)
            for key in (
                "version",
                "architecture",
                "team_identifier",
                "source_commit",
                "archive",
                "disk_image",
                "archive_sha256",
            )
        ],
        strict_true(value("notarized")).alias("notarized"),
        nonempty_object(value("server")).alias("has_server"),
        nonempty_array(value("models")).alias("has_models"),
    )
    return typed.withColumn("base", contract.base(F.col("version")))


def _keyed(
    contract: ReleaseContract, name: str, ord: int, key: str, holds: Column, **at
) -> list[Rule]:
    """A rule on the value of a manifest key, led by the rule that the key is there."""
    moot = F.expr(f"NOT readable OR NOT array_contains(keys, {quoted(key)})")
    return [
        _key_present(ord, key, **at),
        Rule(name, ord, moot | holds, contract.message(name), sub_pos=1, **at),
    ]


def _key_present(ord: int, key: str, **at) -> Rule:
    present = F.expr(f"NOT readable OR array_contains(keys, {quoted(key)})")
    return Rule("required_key", ord, present, repr(key), **at)


def manifest_rules(contract: ReleaseContract) -> list[Rule]:
    version, tag = F.col("version"), F.col("tag")
    same_tag = version.isNull() | columns_equal(tag, F.concat(F.lit(TAG_PREFIX), version))
    architecture = equals_constant(F.col("architecture"), contract.architecture)
    team = equals_constant(F.col("team_identifier"), contract.team_identifier)
    commit = full_match(F.col("source_commit"), COMMIT_PATTERN)

    def keyed(name, ord, key, holds):
        return _keyed(contract, name, ord, key, holds)

    return [
        Rule("manifest_readable", 1, F.col("readable"), contract.message("manifest_readable")),
        *keyed("full_match(version)", 3, "version", full_match(version, VERSION_PATTERN)),
        Rule("columns_equal(tag)", 4, same_tag, contract.message("columns_equal(tag)")),
        *keyed("equals_constant(architecture)", 5, "architecture", architecture),
        *keyed("equals_constant(team_identifier)", 6, "team_identifier", team),
        *keyed("strict_true(notarized)", 7, "notarized", F.col("notarized")),
        *keyed("full_match(source_commit)", 8, "source_commit", commit),
        *keyed("nonempty_object(server)", 9, "server", F.col("has_server")),
        *keyed("nonempty_array(models)", 10, "models", F.col("has_models")),
    ]


def manifest_violations(contract: ReleaseContract, facts: DataFrame) -> DataFrame:
    """Phases 1 and 2. Reads no asset and shuffles nothing."""
    entries = explode_models(facts, KEY, F.col("document"))
    missing = required_keys(entries, KEY, F.col("model"), MODEL_KEYS, F.col("model_pos"))
    rule = "required_keys(models[])"
    message = F.concat(F.lit(contract.message(rule)), F.col("missing"))
    catalog = missing_key_violations(missing, KEY, rule, 11, 2, MODEL_KEYS, message)
    return violations(facts, KEY, manifest_rules(contract)).unionByName(catalog)


def release_inventory(contract: ReleaseContract, facts: DataFrame) -> DataFrame:
    """``release_id, ord, kind, name``: the five files of each named release."""
    named = facts.where(F.col("base").isNotNull())
    return expected_inventory(named, KEY, F.col("base"), contract.files())


def asset_violations(
    contract: ReleaseContract, facts: DataFrame, assets: DataFrame, sidecars: DataFrame
) -> DataFrame:
    """Phase 3: names, presence, checksum files and the digest the manifest claims."""
    binaries = [("archive", ARCHIVE_SUFFIX), ("image", IMAGE_SUFFIX)]
    carried = ["readable", "keys", "archive", "disk_image", "archive_sha256"]
    expected = expected_inventory(
        facts.where(F.col("base").isNotNull()), KEY, F.col("base"), binaries, carried
    ).withColumnsRenamed({"ord": "item_pos", "archive_sha256": "claimed_sha256"})
    at = {"phase": 3, "item_pos": F.col("item_pos")}
    rules = []
    for kind, key in (("archive", "archive"), ("image", "disk_image")):
        named = columns_equal(F.col(key), F.col("name"))
        for rule in _keyed(contract, f"columns_equal({key})", 12, key, named, **at):
            rules.append(_only(F.col("kind") == kind, rule))
    rules.append(_only(F.col("kind") == "archive", _key_present(15, "archive_sha256", **at)))
    compared = asset_facts(expected, assets, sidecars, KEY)
    return violations(compared, KEY, [*rules, *asset_rules()])


def _only(scope: Column, rule: Rule) -> Rule:
    """The rule, limited to the rows in scope."""
    return replace(rule, holds=~scope | F.coalesce(rule.holds, F.lit(False)))


def archive_violations(
    contract: ReleaseContract, archives: DataFrame, members: DataFrame, only_expected: bool = False
) -> DataFrame:
    """Phases 4 to 6. ``archives`` has ``release_id, archive, error`` of the expected
    archives that were read, members ``release_id, archive, member_pos, name, type,
    mode, linkname``. Members of other archives have no influence; with ``only_expected``
    there are none, and findings need not be compared with the archives.

    The base name comes with each member as its archive's name without suffix, so the
    rules on members are row-wise and only their findings are joined; what concerns the
    archive as a whole is folded into one small row per archive before the shuffle.
    """
    key = [*KEY, "archive"]
    unreadable = violations(
        archives, KEY,
        [Rule("archive_readable", 16, F.col("error").isNull(), F.col("error"), phase=4)],
    )
    based = members.withColumn("base", _without_suffix(F.col("archive")))
    split = based.withColumn("parts", path_parts(F.col("name")))
    rows = violations(split, key, member_rules(contract))
    if not only_expected:
        rows = rows.join(archives.select(*key), key, "left_semi")
    rows = rows.drop("archive")
    listed = archives.where(F.col("error").isNull()).select(*key)
    return unreadable.unionByName(rows).unionByName(
        required_member_violations(contract, listed, based)
    )


def expected_archives(facts: DataFrame, assets: DataFrame) -> DataFrame:
    """``release_id, archive, error`` of those assets that are a release's archive."""
    named = facts.select("release_id", F.concat("base", F.lit(ARCHIVE_SUFFIX)).alias("archive"))
    found = assets.select("release_id", F.col("name").alias("archive"), "error")
    return found.join(named, [*KEY, "archive"], "left_semi")


def _without_suffix(archive: Column) -> Column:
    return F.left(archive, F.char_length(archive) - len(ARCHIVE_SUFFIX))


def member_rules(contract: ReleaseContract) -> list[Rule]:
    name, kind, base, parts = (F.col(c) for c in ("name", "type", "base", "parts"))
    permitted = [(F.concat(base, F.lit("/" + contract.alias)), F.lit(contract.entrypoint))]
    holds = {
        "safe_path": safe_path(name, parts),
        "path_root": path_root(name, base, parts),
        "allowed_kind": allowed_kind(kind),
        "link_allowlist": link_allowlist(kind, name, F.col("linkname"), permitted),
    }
    return [
        Rule(rule, ord, condition, MESSAGES[rule], phase=5, item_pos=F.col("member_pos"))
        for ord, (rule, condition) in enumerate(holds.items(), 17)
    ]


def required_member_violations(
    contract: ReleaseContract, listed: DataFrame, members: DataFrame
) -> DataFrame:
    """Phase 6. Of members with the same name the last one counts."""
    name = strip_slashes(F.col("name"))
    within = F.when(
        name.startswith(F.concat("base", F.lit("/"))),
        F.substr(name, F.char_length("base") + 2),
    )
    full = F.concat("base", F.lit("/"))
    entry_ok = (F.col("type") == FILE) & member_property(F.col("mode"), EXECUTE_BITS)
    alias_ok = (F.col("type") == SYMLINK) & (F.col("linkname") == contract.entrypoint)
    at_entry = F.when(F.col("within") == contract.entrypoint, F.col("member_pos"))
    at_alias = F.when(F.col("within") == contract.alias, F.col("member_pos"))
    below = F.col("within").startswith(contract.resources + "/")
    # Flags and positions only, so the partial aggregation needs no sort.
    key = [*KEY, "archive"]
    summary = (
        members.withColumn("within", within)
        .where(F.col("within").isin(contract.entrypoint, contract.alias) | below)
        .groupBy(*key)
        .agg(
            F.max_by(F.coalesce(entry_ok, F.lit(False)), at_entry).alias("entry_ok"),
            F.max_by(F.coalesce(alias_ok, F.lit(False)), at_alias).alias("alias_ok"),
            F.bool_or(below).alias("resources_ok"),
        )
    )
    # A name that is looked up in vain is reported itself, quoted.
    def absent(member: str) -> Column:
        return F.concat(F.lit("'"), full, F.lit(f"{member}'"))

    entry, alias = F.col("entry_ok"), F.col("alias_ok")
    required, linked = "require_member(entrypoint)", "require_member(alias)"
    proper, resources = "member_property(entrypoint)", "require_any_prefix(resources)"
    rules = [
        Rule(required, 21, entry.isNotNull(), absent(contract.entrypoint), phase=6),
        Rule(proper, 22, F.coalesce(entry, F.lit(True)), contract.message(proper), phase=6),
        Rule(linked, 23, alias.isNotNull(), absent(contract.alias), phase=6),
        Rule("member_property(alias)", 23, F.coalesce(alias, F.lit(True)), contract.message(linked), phase=6, sub_pos=1),
        Rule(resources, 24, F.col("resources_ok"), contract.message(resources), phase=6),
    ]
    compared = listed.join(summary, key, "left").withColumn("base", _without_suffix(F.col("archive")))
    return violations(compared, KEY, rules)


def validate_releases(
    contract: ReleaseContract,
    candidates: DataFrame,
    manifests: DataFrame,
    assets: DataFrame,
    sidecars: DataFrame,
    members: DataFrame,
) -> tuple[DataFrame, DataFrame]:
    """``(violations, verdicts)`` of the candidates, phases 1 to 6.

    ``assets`` has ``release_id, name, sha256, error``; the other tables are as the
    sources give them, members with their ``archive``. Parsed manifests and violations
    go to the shared folder once, as several branches and the caller read them.
    """
    facts = materialise(manifest_facts(contract, candidates, manifests))
    archives = materialise(expected_archives(facts, assets))
    found = materialise(
        manifest_violations(contract, facts)
        .unionByName(asset_violations(contract, facts, assets, sidecars))
        .unionByName(archive_violations(contract, archives, members))
    )
    return found, verdicts(candidates, found, KEY)


def validate_folder(
    spark: SparkSession, contract: ReleaseContract, candidates: DataFrame, path: str
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(inventory, violations, verdicts)`` of the release folders below ``path``.

    The inventory is that of the releases that pass.
    ``candidates`` has ``release_id, tag`` with each id once. Files are opened by the
    name the contract gives them, so no folder is listed, and an unexpected file has no
    influence. Manifests are judged first, and bytes are read only for releases without
    a finding there. Each such file is read once; digests and member lists are written
    to the shared folder, so neither a later branch nor a lost executor reads it again.
    """
    root = F.lit(qualified(spark, path))
    texts = read_texts(
        candidates.select(
            "release_id", F.concat_ws("/", root, "release_id", F.lit(MANIFEST_NAME)).alias("path")
        ),
        KEY,
    )
    facts = materialise(manifest_facts(contract, candidates, texts))
    early = materialise(manifest_violations(contract, facts))
    sound = facts.drop("document").join(early.select(*KEY).distinct(), KEY, "left_anti")
    inventory = materialise(
        release_inventory(contract, sound).withColumn(
            "path", F.concat_ws("/", root, "release_id", "name")
        )
    )
    key = ["release_id", "name"]
    binaries = inventory.where(F.col("kind").isin("archive", "image"))
    wanted = materialise(binaries.join(file_lengths(binaries, key), key))
    listing = materialise(
        read_bytes_once(balance_by_bytes(wanted), key, F.col("kind") == "archive")
    )
    assets = digests_of(listing, key).where(F.col("sha256").isNotNull())
    claims = read_texts(inventory.where(F.col("kind").endswith("_sidecar")), key)
    sidecars = claims.select(
        "release_id",
        F.left("name", F.char_length("name") - len(SIDECAR_SUFFIX)).alias("name"),
        split_fields(F.col("raw")).alias("fields"),
    )
    archives = materialise(expected_archives(sound, assets))
    members = members_of(listing.withColumnRenamed("name", "archive"), ["release_id", "archive"])
    found = materialise(
        early.unionByName(asset_violations(contract, sound, assets, sidecars))
        .unionByName(archive_violations(contract, archives, members, only_expected=True))
    )
    judged = materialise(verdicts(candidates, found, KEY))
    passed = inventory.join(judged.where("passed").select(*KEY), KEY, "left_semi")
    return passed, found, judged
