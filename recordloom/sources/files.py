"""Files as byte streams inside tasks, by any scheme that ``pyarrow.fs`` opens."""

from __future__ import annotations

import hashlib
import re

from pyarrow import fs

#: Bytes read at once.
CHUNK = 4 << 20


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    if re.match(r"file:/|/", path):
        return fs.LocalFileSystem(), "/" + re.sub(r"^(file:)?/+", "", path)
    return fs.FileSystem.from_uri(path)


def sha256_of(path: str) -> str:
    """Digest of a file's content, in constant memory."""
    system, place = open_path(path)
    digest = hashlib.sha256()
    with system.open_input_stream(place) as stream:
        while block := stream.read(CHUNK):
            digest.update(block)
    return digest.hexdigest()
