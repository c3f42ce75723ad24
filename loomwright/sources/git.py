"""Git repositories as a source: files of a commit, and the changes between two commits.

Executors read the repository themselves, so on a cluster it must lie on a shared path.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from loomwright.functions.text import is_indexed_path
from loomwright.session import ship_package

CHANGE_SCHEMA = "status string, old_path string, new_path string"


def _output(repo: str, command: str, *arguments: str) -> str:
    done = subprocess.run(["git", f"--git-dir={_folder(repo)}", command, *arguments], capture_output=True)
    if done.returncode:
        raise ValueError(f"git {command} failed in {repo}: {done.stderr.decode('utf-8', 'replace').strip()}")
    return done.stdout.decode("utf-8", "surrogateescape")


def _folder(repo: str) -> str:
    """The folder of the object store: of a working copy, or a bare repository itself."""
    from pathlib import Path

    inner = Path(repo) / ".git"
    if inner.is_file():  # a linked working copy names its folder
        return str((Path(repo) / inner.read_text().partition(":")[2].strip()).resolve())
    return str(inner if inner.exists() else repo)


def resolve(repo: str, name: str) -> str:
    """The full id of the commit that a branch, tag or abbreviation names."""
    return _output(repo, "rev-parse", "--verify", name + "^{commit}").strip()


def lineage(repo: str, head: str = "HEAD", last: int | None = None) -> list[tuple[str, str | None]]:
    """(commit, first parent or None) along the first parents of head, oldest first; the last so many of them."""
    limit = [] if last is None else [f"--max-count={last}"]
    lines = _output(repo, "log", "--first-parent", "--format=%H %P", *limit, head).splitlines()
    split = [line.split() for line in lines if line.strip()]
    return [(ids[0], ids[1] if len(ids) > 1 else None) for ids in reversed(split)]


def _paths(listing: str) -> list[str]:
    """NUL-separated names; bytes that aren't UTF-8 can't be indexed by name and are replaced."""
    return [name.encode("utf-8", "surrogateescape").decode("utf-8", "replace") for name in listing.split("\0") if name]


def files_at(spark: SparkSession, repo: str, commit: str, include: tuple[str, ...] = ()) -> DataFrame:
    """(path) of the indexed files at a commit. Names are read NUL-separated, so none arrives quoted."""
    ship_package(spark)
    listed = spark.createDataFrame([(p,) for p in _paths(_output(repo, "ls-tree", "-r", "-z", "--name-only", commit))], "path string")
    return listed.filter(is_indexed_path(listed["path"], include))


def changed_files(spark: SparkSession, repo: str, parent: str, commit: str) -> DataFrame:
    """(status, old_path, new_path) between two commits, renames detected."""
    ship_package(spark)
    names = _paths(_output(repo, "diff-tree", "-r", "-z", "--find-renames", "--name-status", parent, commit))
    rows, at = [], 0
    while at < len(names):
        moved = names[at][:1] in ("R", "C")  # the only ones that name two files
        rows.append((names[at], names[at + 1], names[at + 1 + moved]))
        at += 2 + moved
    return spark.createDataFrame(rows, CHANGE_SCHEMA)


class _Reader:
    """One process that hands out blobs by name, for as long as a task runs."""

    def __init__(self, repo: str) -> None:
        self.process = subprocess.Popen(["git", f"--git-dir={_folder(repo)}", "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)

    def read(self, name: str) -> bytes | None:
        """A blob's bytes; None if there is none of this name (a submodule, say)."""
        self.process.stdin.write(name.encode("utf-8") + b"\n")
        self.process.stdin.flush()
        header = self.process.stdout.readline().split()
        if len(header) < 3 or not header[-1].isdigit():
            return None
        body = self.process.stdout.read(int(header[-1]) + 1)[:-1]
        return body if header[-2] == b"blob" else None

    def close(self) -> None:
        self.process.stdin.close()
        self.process.wait()


def with_sources(paths: DataFrame, repo: str, commit: str) -> DataFrame:
    """(path, source) at a commit, one reading process a task; bytes that aren't UTF-8 are replaced, line ends made one.

    Paths without a file at the commit, and those with a line break in their name, are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = _Reader(repo)
        try:
            for batch in batches:
                names = [p for p in batch.column("path").to_pylist() if p and "\n" not in p]
                bodies = [(p, reader.read(f"{commit}:{p}")) for p in names]
                found = [(p, b.decode("utf-8", "replace").replace("\r\n", "\n")) for p, b in bodies if b is not None]
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([b for _, b in found], pa.string())], names=["path", "source"])
        finally:
            reader.close()

    return paths.select("path").mapInArrow(run, "path string, source string")
