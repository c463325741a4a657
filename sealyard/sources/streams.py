"""Opening, reading and copying single files inside a task, on any file system."""

from __future__ import annotations

import hashlib
import uuid
from urllib.parse import urlsplit

CHUNK = 1024 * 1024
# File systems this process has connected to.
_SERVERS: dict = {}


def locate(path: str):
    """The pyarrow file system of a Spark path, and the path within it."""
    from pyarrow import fs

    parts = urlsplit(path)
    if parts.scheme in ("", "file"):
        # Local names may hold characters that mean something in a URI.
        return fs.LocalFileSystem(), path.removeprefix("file:").replace("///", "/", 1)
    scheme = "s3" if parts.scheme in ("s3a", "s3n") else parts.scheme
    server = f"{scheme}://{parts.netloc}/"
    if server not in _SERVERS:
        _SERVERS[server] = fs.FileSystem.from_uri(server)
    system, root = _SERVERS[server]
    inner = path.split(parts.netloc, 1)[1] if parts.netloc else path.split(":", 1)[1]
    return system, root.rstrip("/") + "/" + inner.lstrip("/")


class HashingReader:
    """A readable file that digests every byte once, in order, as it passes.

    A failing read of the file itself is kept in ``failure``, to tell it from
    damage inside the file: the former is worth another attempt of the task.
    """

    def __init__(self, raw):
        self.raw = raw
        self.sha = hashlib.sha256()
        self.digested = 0
        self.failure = None

    def read(self, size: int = -1) -> bytes:
        try:
            at = self.raw.tell()
            data = self.raw.read(size if size is not None and size >= 0 else None)
        except OSError as error:
            self.failure = error
            raise
        fresh = at + len(data) - self.digested
        if fresh > 0 and at <= self.digested:
            self.sha.update(memoryview(data)[len(data) - fresh:])
            self.digested += fresh
        return data

    def seek(self, offset: int, whence: int = 0) -> int:
        return self.raw.seek(offset, whence)

    def tell(self) -> int:
        return self.raw.tell()

    def finish(self) -> str:
        """Digest the rest of the file and return the hexadecimal digest."""
        self.raw.seek(self.digested)
        while self.read(CHUNK):
            pass
        return self.sha.hexdigest()


def _same_bytes(system, one: str, other: str) -> bool:
    with (
        system.open_input_stream(one, compression=None) as a,
        system.open_input_stream(other, compression=None) as b,
    ):
        while True:
            left, right = a.read(CHUNK), b.read(CHUNK)
            if left != right:
                return False
            if not left:
                return True


def copy_file(source, target: str, owner: str = "any") -> int | None:
    """Copy a file (its path, or its bytes) to ``target`` and return the size found there.

    The bytes go to a name of this attempt's own, with its ``owner``, and are moved into place when
    complete, so a repeated or concurrent attempt never shows a partial file. A target
    that is there already stays as it is: with the same bytes it is an earlier attempt's
    and counts as copied, with others nothing is copied and there is no size.
    """
    system, place = locate(target)
    system.create_dir(place.rsplit("/", 1)[0], recursive=True)
    draft = f"{place}.{owner}-{uuid.uuid4().hex}.part"
    with system.open_output_stream(draft, compression=None) as sink:
        if isinstance(source, str):
            from_system, from_place = locate(source)
            with from_system.open_input_stream(from_place, compression=None) as stream:
                while chunk := stream.read(CHUNK):
                    sink.write(chunk)
        else:
            sink.write(source)
    if not system.get_file_info(place).is_file:
        try:
            system.move(draft, place)
            return system.get_file_info(place).size
        except OSError:
            # Another attempt may have been first where files are not moved onto others.
            if not system.get_file_info(place).is_file:
                raise
    same = _same_bytes(system, draft, place)
    system.delete_file(draft)
    return system.get_file_info(place).size if same else None
