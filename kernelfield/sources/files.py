"""Files by URI: local paths, and stores that pyarrow reads."""

from __future__ import annotations

import fnmatch
import re


def located(uri: str):
    """pyarrow's file system and path of a URI."""
    from pyarrow import fs

    local = re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(local) if "://" in local else (fs.LocalFileSystem(), local)


def content(uri: str, most: int | None = None) -> bytes:
    system, path = located(uri)
    with system.open_input_stream(path, compression=None) as f:
        return f.read(most) if most else f.read()


def exists(uri: str) -> bool:
    from pyarrow.fs import FileType

    system, path = located(uri)
    return system.get_file_info(path).type == FileType.File


def write(uri: str, data: bytes) -> None:
    system, path = located(uri)
    if "/" in path:
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as f:
        f.write(data)


def matching(pattern: str) -> list[str]:
    """The files that a pattern names, in order; wildcards stand in the last part of the path."""
    folder, _, last = pattern.rpartition("/")
    if not re.search(r"[*?\[]", pattern):
        return [pattern] if exists(pattern) else []
    from pyarrow.fs import FileSelector, FileType

    system, path = located(folder or ".")
    return sorted(f"{folder}/{x.base_name}" if folder else x.base_name for x in system.get_file_info(FileSelector(path)) if x.type == FileType.File and fnmatch.fnmatchcase(x.base_name, last))
