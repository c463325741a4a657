"""Checking, gating and publishing large registries of released artifacts with Spark.

Operators take and return DataFrames (or Columns); rules are data, so the same
gate runs over release manifests or over any other table.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

from sealyard.functions.predicates import (
    allowed_kind,
    columns_equal,
    equals_constant,
    full_match,
    link_allowlist,
    manifest_readable,
    member_property,
    nonempty_array,
    nonempty_object,
    path_root,
    safe_path,
    strict_true,
)
from sealyard.functions.text import (
    base_name,
    classify_channel,
    path_parts,
    split_fields,
    strip_slashes,
)
from sealyard.operators.aggregates import all_rows, any_row, last_wins, require_any_prefix
from sealyard.operators.digests import content_digest, digest_files, verify_digests
from sealyard.operators.inventory import (
    expected_inventory,
    inventory_order,
    reconcile_by_fingerprint,
    reconcile_inventory,
)
from sealyard.operators.lookup import open_key_index, reject_indexed, taken_keys, write_key_index
from sealyard.operators.members import require_members
from sealyard.operators.registry import (
    latest_per_channel,
    manifest_and_archive,
    reject_existing,
    resolve_latest,
)
from sealyard.operators.rules import (
    Rule,
    first_violation,
    gate,
    gate_rows,
    required_keys,
    verdicts,
    violations,
    write_violations,
)
from sealyard.plans.contract import ReleaseContract
from sealyard.plans.publish import (
    create_registry,
    index_tags,
    publish_folder,
    publish_release,
    read_upload_listings,
    stage_release,
    sweep_parts,
    validate_published,
    withdraw_draft,
)
from sealyard.plans.rejudge import (
    compact_results,
    create_results,
    judge_changed,
    validate_changed_folders,
    validate_changed_releases,
)
from sealyard.plans.validate import validate_folder, validate_releases
from sealyard.session import clean_up, configure, materialise, shared_folder
from sealyard.sources.archives import list_archives
from sealyard.sources.bucketed import read_bucketed, write_bucketed
from sealyard.sources.commits import AlreadyCommitted
from sealyard.sources.datasource import read_release_files, register_sources
from sealyard.sources.files import (
    compact_releases,
    scan_assets,
    scan_manifests,
    scan_models,
    scan_releases,
    scan_sidecars,
    scan_uploads,
)

# Functions that run in tasks travel with the job: executors need no installation.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__all__ = [name for name in dir() if not name.startswith("_")]
