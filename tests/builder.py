"""Writes small release folders, sound or with chosen faults, for the tests."""

import gzip
import hashlib
import io
import json
import tarfile
from pathlib import Path

from sealyard import ReleaseContract

CONTRACT = ReleaseContract(
    base_prefix="acme-tool-",
    base_suffix="-os-cpu",
    architecture="cpu",
    team_identifier="TEAM123",
    entrypoint="toold",
    alias="tool",
    resources="Res.bundle",
    team_name="acme",
    entrypoint_role="Daemon",
    client_name="Shell",
)

MODEL = {
    "id": "m", "label": None, "repository": "r", "revision": "1",
    "size_bytes": 1, "dimensions": 2, "default_dimensions": 2, "more": [],
}


def member(name, kind=tarfile.REGTYPE, data=b"", mode=0o644, link=""):
    info = tarfile.TarInfo(name)
    info.type, info.mode, info.linkname, info.size = kind, mode, link, len(data)
    return info, data


def members_of(base):
    return [
        member(base, tarfile.DIRTYPE, mode=0o755),
        member(f"{base}/toold", data=b"#!", mode=0o755),
        member(f"{base}/tool", tarfile.SYMTYPE, mode=0o777, link="toold"),
        member(f"{base}/Res.bundle", tarfile.DIRTYPE, mode=0o755),
        member(f"{base}/Res.bundle/a.txt", data=b"resource"),
    ]


def archive_bytes(entries):
    target = io.BytesIO()
    with tarfile.open(fileobj=target, mode="w:gz") as archive:
        for info, data in entries:
            archive.addfile(info, io.BytesIO(data))
    return target.getvalue()


def write_release(
    folder, version="0.4.0", manifest=None, raw=None, entries=None, archive=None, image=b"image",
    sidecars=None, without=(),
):
    """Write a release folder. ``manifest`` edits the manifest, ``entries`` the members."""
    folder = Path(folder)
    folder.mkdir(parents=True)
    base = f"acme-tool-{version}-os-cpu"
    if archive is None:
        listed = members_of(base)
        archive = archive_bytes(entries(listed, base) if entries else listed)
    files = {f"{base}.tar.gz": archive, f"{base}.dmg": image}
    digests = {name: hashlib.sha256(data).hexdigest() for name, data in files.items()}
    document = {
        "version": version, "architecture": "cpu", "team_identifier": "TEAM123",
        "notarized": True, "source_commit": "0123456789abcdef" * 2 + "01234567",
        "server": {"a": 1}, "models": [dict(MODEL)],
        "archive": f"{base}.tar.gz", "disk_image": f"{base}.dmg",
        "archive_sha256": digests[f"{base}.tar.gz"],
    }
    if manifest:
        document = manifest(document) or document
    files["release.json"] = (json.dumps(document) if raw is None else raw(document)).encode(
        "utf-8", "surrogateescape"
    )
    for name, digest in digests.items():
        text = f"{digest}  {name}\n"
        if sidecars:
            text = sidecars(digest, name)
        files[f"{name}.sha256"] = text.encode()
    for name, data in files.items():
        if not any(name.endswith(part) for part in without):
            (folder / name).write_bytes(data)
    return base


def gz(data):
    return gzip.compress(data)
