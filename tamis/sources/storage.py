"""Files of any storage that has a file system, reached from driver and tasks."""

from __future__ import annotations

import os


def file_system(path: str):
    """(file system, path in it) of a plain path or a URI."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:/"):
        return fs.FileSystem.from_uri(path.replace("file:/", "file:///", 1) if "://" not in path else path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def read_bytes(path: str) -> bytes | None:
    """The content, or None where it cannot be read."""
    try:
        system, inner = file_system(path)
        with system.open_input_stream(inner, compression=None) as f:
            return f.read()
    except OSError:
        return None


def list_folder(path: str) -> list[tuple[str, bool]]:
    """(path, is a folder) of what lies directly in a folder, named the way the
    folder is. Links to folders are left out; a folder that cannot be read is
    empty."""
    from pyarrow import fs

    system, inner = file_system(path)
    try:
        if isinstance(system, fs.LocalFileSystem):
            with os.scandir(inner) as entries:
                found = [
                    (e.name, e.is_dir(follow_symlinks=False))
                    for e in entries
                    if e.is_dir(follow_symlinks=False) or e.is_file()
                ]
        else:
            listed = system.get_file_info(fs.FileSelector(inner))
            found = [(i.base_name, i.type == fs.FileType.Directory) for i in listed]
    except OSError:
        return []
    base = path.rstrip("/")
    return [(f"{base}/{name}", folder) for name, folder in found]
