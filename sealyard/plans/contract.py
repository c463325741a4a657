"""What a release must look like: the parameters of the rule set."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from sealyard.fixed import (
    ARCHIVE_SUFFIX,
    IMAGE_SUFFIX,
    MANIFEST_NAME,
    MESSAGES,
    SIDECAR_SUFFIX,
)

@dataclass(frozen=True)
class ReleaseContract:
    """The names one product puts into its releases.

    A release of version V consists of the manifest and, for the base name
    ``base_prefix + V + base_suffix``, an archive and a disk image with their
    checksum files. The archive has one root folder named like the base. In it lie
    an executable ``entrypoint``, a symlink ``alias`` to it, and ``resources``.
    """

    base_prefix: str
    base_suffix: str
    architecture: str
    team_identifier: str
    entrypoint: str
    alias: str
    resources: str
    # How messages speak of the signing team, the executable and the client.
    team_name: str = "the"
    entrypoint_role: str = "Entry point"
    client_name: str = "client"

    @property
    def product(self) -> str:
        return self.base_prefix.rstrip("-")

    def message(self, rule: str) -> str:
        return MESSAGES[rule].format(**asdict(self))

    def base(self, version: Column) -> Column:
        return F.concat(F.lit(self.base_prefix), version, F.lit(self.base_suffix))

    def files(self) -> list[tuple[str, Column | str]]:
        """(kind, suffix) of the five files in inventory order."""
        return [
            ("manifest", F.lit(MANIFEST_NAME)),
            ("archive", ARCHIVE_SUFFIX),
            ("archive_sidecar", ARCHIVE_SUFFIX + SIDECAR_SUFFIX),
            ("image", IMAGE_SUFFIX),
            ("image_sidecar", IMAGE_SUFFIX + SIDECAR_SUFFIX),
        ]
