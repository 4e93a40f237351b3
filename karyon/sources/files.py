"""Files by URI, with the names that Hadoop has for object stores."""

from __future__ import annotations

import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a local path."""
    scheme, there, rest = uri.partition("://")
    if not there:
        return pafs.FileSystem.from_uri("file://" + uri)
    return pafs.FileSystem.from_uri(f"s3://{rest}" if scheme in ("s3a", "s3n") else uri)
