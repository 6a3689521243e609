"""Files by path or address, for code that reads byte ranges inside tasks."""

from __future__ import annotations

import fnmatch
import posixpath

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path in it: local paths, or addresses such as file:, hdfs: and s3:."""
    if ":/" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, ending: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file, of the files of a folder that end so, or of a pattern in one folder."""
    where, inner = located(path)
    start = path[:len(path) - len(inner)] if path.endswith(inner) else ""
    info = where.get_file_info(inner)
    if info.type == fs.FileType.File:
        return [(path, info.size)]
    folder, pattern = (inner, "*" + ending) if info.type == fs.FileType.Directory else \
        posixpath.split(inner)
    found = where.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    got = sorted((start + f.path, f.size) for f in found
                 if f.type == fs.FileType.File and fnmatch.fnmatch(posixpath.basename(f.path), pattern))
    if not got:
        raise FileNotFoundError(path)
    return got


def opened(path: str):
    """Random access: ``read_at(bytes, offset)`` and ``size()``."""
    where, inner = located(path)
    return where.open_input_file(inner)


def exists(path: str) -> bool:
    where, inner = located(path)
    return where.get_file_info(inner).type == fs.FileType.File
