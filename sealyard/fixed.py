"""Fixed values of the release contract: texts that results must equal."""

# Patterns a text must match as a whole.
VERSION_PATTERN = r"\d+\.\d+\.\d+(?:-[0-9A-Za-z.-]+)?"
COMMIT_PATTERN = r"[a-f0-9]{40}"

# Keys each catalog entry must have.
MODEL_KEYS = (
    "id",
    "label",
    "repository",
    "revision",
    "size_bytes",
    "dimensions",
    "default_dimensions",
)

# File names, tags and mode bits.
MANIFEST_NAME = "release.json"
LISTING_NAME = "uploaded-assets.json"
ARCHIVE_SUFFIX = ".tar.gz"
IMAGE_SUFFIX = ".dmg"
SIDECAR_SUFFIX = ".sha256"
TAG_PREFIX = "v"
EXECUTE_BITS = 0o111

# What a rule says when it is broken. Braces stand for names of the contract; where a
# message ends in a colon or blank, the name of the key or file follows.
MESSAGES = {
    "manifest_readable": "Manifest missing or not one JSON value",
    "full_match(version)": "Invalid version",
    "columns_equal(tag)": "Tag and manifest version differ",
    "equals_constant(architecture)": "Expected {architecture}",
    "equals_constant(team_identifier)": "Expected {team_name} signing team",
    "strict_true(notarized)": "Only notarized builds may be published",
    "full_match(source_commit)": "Missing source commit",
    "nonempty_object(server)": "Missing server description",
    "nonempty_array(models)": "Missing model catalog",
    "required_keys(models[])": "Model missing ",
    "columns_equal(archive)": "Unexpected archive",
    "columns_equal(disk_image)": "Unexpected disk_image",
    "asset_present": "No such file: ",
    "sidecar_matches": "Invalid checksum for ",
    "digest_matches_manifest": "Archive checksum differs from manifest",
    "safe_path": "Unsafe archive path",
    "path_root": "Unexpected archive root",
    "allowed_kind": "Unsupported archive member",
    "link_allowlist": "Unexpected symlink",
    "member_property(entrypoint)": "{entrypoint_role} is not executable",
    "require_member(alias)": "Missing {client_name} compatibility entry",
    "require_any_prefix(resources)": "Missing resources",
    "upload_size_matches": "Missing or incomplete upload: ",
}
