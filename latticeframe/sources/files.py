"""Plain files at paths that all executors reach, through pyarrow's file systems."""

from __future__ import annotations

import os


def file_store(folder: str):
    """(file system, path) of a folder given as a path or a uri."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder else "file://" + os.path.abspath(folder.removeprefix("file:")))
