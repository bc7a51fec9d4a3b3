"""File systems of tasks that read and write single files."""

from __future__ import annotations

import re


def file_store(uri: str):
    """The file system and path of a folder or file, by the names that Spark uses for stores."""
    from pyarrow import fs

    plain = re.sub(r"^file:/(?!/)", "file:///", re.sub(r"^s3[an]:", "s3:", uri))
    return fs.FileSystem.from_uri(plain) if ":" in plain else (fs.LocalFileSystem(), plain)
