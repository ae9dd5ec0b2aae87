"""Members of archives as files of their own, to a fixed depth."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from treesift.functions.paths import inner_path

MAX_ENTRIES, MAX_BYTES, MAX_MEMBER, MAX_DEPTH = 10_000, 1 << 30, 50 << 20, 3
#: Bytes of members that are given on at once, but for a larger single one.
BATCH_BYTES = 32 << 20


def _unsafe(name: str) -> bool:
    name = name.replace("\\", "/")
    return name.startswith("/") or re.match(r"[A-Za-z]:", name) is not None or posixpath.normpath(name).split("/")[0] == ".."


def members(path: str, data: bytes, max_bytes: int = MAX_BYTES) -> Iterator[tuple[str, bytes | None, str]]:
    """(name, content, problem) of each member; content is null where there is a problem.
    Declared sizes are not trusted: no more is read than the limits allow."""
    left, entries = max_bytes, 0

    def take(stream, name: str) -> tuple[str, bytes | None, str]:
        nonlocal left
        body = stream.read(min(left, MAX_MEMBER) + 1)
        if len(body) > MAX_MEMBER:
            return name, None, "member size limit"
        if len(body) > left:
            left = 0
            return name, None, "expansion limit"
        left -= len(body)
        return name, body, ""

    try:
        if data[:4] == b"PK\x03\x04":
            with zipfile.ZipFile(io.BytesIO(data)) as z:
                for info in z.infolist():
                    if (entries := entries + 1) > MAX_ENTRIES or left <= 0:
                        yield info.filename, None, "entry limit" if left > 0 else "expansion limit"
                        return
                    if _unsafe(info.filename):
                        yield info.filename, None, "traversal"
                    elif not info.is_dir():
                        with z.open(info) as f:
                            yield take(f, info.filename)
        elif path.lower().endswith((".tar", ".tar.gz", ".tgz")):
            with tarfile.open(fileobj=io.BytesIO(data), mode="r:*") as t:
                for member in t:
                    if (entries := entries + 1) > MAX_ENTRIES or left <= 0:
                        yield member.name, None, "entry limit" if left > 0 else "expansion limit"
                        return
                    link = posixpath.join(posixpath.dirname(member.name), member.linkname) if member.issym() else member.linkname
                    if _unsafe(member.name) or (member.issym() or member.islnk()) and _unsafe(link):
                        yield member.name, None, "traversal"
                    elif member.isfile() and (f := t.extractfile(member)):
                        yield take(f, member.name)
    except (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, RuntimeError, NotImplementedError) as e:
        yield "", None, f"unreadable: {type(e).__name__}"


def _is_archive(path: str, data: bytes) -> bool:
    return len(data) >= 4 and (data[:4] == b"PK\x03\x04" or path.lower().endswith((".tar", ".tar.gz", ".tgz")))


def is_archive(path: Column, content: Column) -> Column:
    name = F.lower(inner_path(path))
    return (F.length(content) >= 4) & ((F.hex(F.substring(content, 1, 4)) == "504B0304") | name.endswith(".tar") | name.endswith(".tar.gz") | name.endswith(".tgz"))


def expand(files: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(repo_id, path, depth, content, problem) of ``files`` (repo_id, path, content)
    and of all members of archives among them; paths of members are ``outer!inner``."""
    base = files.select("repo_id", "path", F.lit(0).alias("depth"), "content", F.lit("").alias("problem"))
    return base.unionByName(inside(files.where(is_archive(F.col("path"), F.col("content"))), depth))


def inside(files: DataFrame, depth: int = MAX_DEPTH) -> DataFrame:
    """(repo_id, path, depth, content, problem) of all members of the archives ``files``.
    An archive deeper than ``depth`` has a row of its own with this problem.

    Archives are opened once, level below level, inside the task that holds them."""

    def nested(path: str, data: bytes, level: int) -> Iterator[tuple[str, int, bytes | None, str]]:
        if level > depth:
            yield path, level - 1, None, "archive-depth limit"
            return
        for name, body, problem in members(path, data):
            inner = f"{path}!{name}"
            yield inner, level, body, problem
            if body is not None and _is_archive(name, body):
                yield from nested(inner, body, level + 1)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for repo, path, content in batch.itertuples(index=False):
                rows, held = [], 0
                for row in nested(path, bytes(content), 1):
                    rows.append((repo, *row))
                    held += len(row[2] or b"")
                    if len(rows) == 64 or held > BATCH_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=columns)

    columns = ["repo_id", "path", "depth", "content", "problem"]
    schema = "repo_id string, path string, depth int, content binary, problem string"
    return files.select("repo_id", "path", "content").mapInPandas(run, schema)
