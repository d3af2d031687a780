"""Paths, formats and decompression that all file formats share."""

from __future__ import annotations

import bz2
import glob
import gzip
import io
import lzma
import os

COMPRESSED = ("gz", "bz", "bz2", "xz")


class PathError(ValueError):
    pass


def refuse_directory(path: str, what: str) -> None:
    if os.path.isdir(path):
        raise PathError(f"{what} is a directory: {path}")


def uncompressed_type(path: str) -> str:
    """The extension that tells the format, one compression extension aside; case matters."""
    if os.path.isdir(path):
        raise PathError(f"a directory has no format: {path}")
    parts = os.path.basename(path).split(".")
    if len(parts) > 2 and parts[-1] in COMPRESSED:
        parts.pop()
    if len(parts) < 2 or not parts[-1]:
        raise PathError(f"no extension tells the format of {path}")
    return parts[-1]


def add_suffix(path: str, suffix: str) -> str:
    """The path with a suffix before the first dot of its file name."""
    folder, name = os.path.split(path)
    stem, dot, rest = name.partition(".")
    return os.path.join(folder, f"{stem}{suffix}{dot}{rest}")


def with_extension(path: str, extension: str) -> str:
    return f"{os.path.splitext(path)[0]}.{extension}"


def store_of(path: str):
    """The file system and path of a URI such as hdfs://… or s3://…, by pyarrow; a plain path or a file: URI has none."""
    if "://" not in path or path.startswith("file://"):
        return None, path.removeprefix("file://")
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def raw_file(path: str):
    """A file's bytes as they are, to be read and sought in."""
    store, at = store_of(path)
    return open(at, "rb") if store is None else store.open_input_file(at)


def size_of(path: str) -> int:
    store, at = store_of(path)
    return os.path.getsize(at) if store is None else store.get_file_info(at).size


def _kind(head: bytes) -> str | None:
    return "gzip" if head[:2] == b"\x1f\x8b" else "bzip2" if head[:3] == b"BZh" else "xz" if head == b"\xfd7zXZ\x00" else None


def opened(path: str):
    """A file's bytes, decompressed as its first bytes tell (gzip, bzip2 or xz)."""
    raw = raw_file(path)
    kind = _kind(raw.read(6))
    raw.seek(0)
    if kind == "gzip":
        return io.BufferedReader(gzip.GzipFile(fileobj=raw))
    if kind == "bzip2":
        return io.BufferedReader(bz2.BZ2File(raw))
    if kind == "xz":
        return io.BufferedReader(lzma.LZMAFile(raw))
    return raw if isinstance(raw, io.BufferedReader) else io.BufferedReader(raw)


def is_compressed(path: str) -> bool:
    with raw_file(path) as f:
        return _kind(f.read(6)) is not None


def _hidden(path: str) -> bool:
    return os.path.basename(path).startswith((".", "_"))


def listed(path: str) -> list[str]:
    """The files of a path: itself, those of a folder, or (on a mounted file system) those that a pattern matches; in order."""
    store, at = store_of(path)
    if store is not None:
        return listed_in(store, at, path.split("://")[0] + "://")
    if os.path.isdir(at):
        found = sorted(p for p in (os.path.join(at, n) for n in os.listdir(at)) if os.path.isfile(p) and not _hidden(p))
    else:
        found = sorted(glob.glob(at)) or [at]
    for p in found:
        if not os.path.exists(p):
            raise FileNotFoundError(p)
    return found


def listed_in(store, path: str, scheme: str) -> list[str]:
    """The files of a path in a store, as URIs."""
    from pyarrow import fs

    one = store.get_file_info(path)
    if one.type == fs.FileType.NotFound:
        raise FileNotFoundError(scheme + path)
    if one.type == fs.FileType.File:
        return [scheme + path]
    inside = store.get_file_info(fs.FileSelector(path))
    return sorted(scheme + x.path for x in inside if x.type == fs.FileType.File and not _hidden(x.path))
