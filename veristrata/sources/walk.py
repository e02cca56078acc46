"""Trees of files as a Spark data source: folders that are skipped or ignored are never opened, hidden names are files like others."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions.text import glob_regex

FORMAT = "file_tree"
SCHEMA = "path string, length bigint, modified bigint, content binary"
#: Folders that planning opens before tasks take over, files in a task at most, and bytes of them.
PLANNED, FILES, BYTES = 64, 1000, 32 << 20


def ignore_rules(patterns: list[str]) -> list[tuple[str, bool]]:
    """(expression, whether it takes paths back in) of an ignore file's lines, in order; the last that matches decides."""
    out = []
    for p in patterns:
        p = p.strip()
        if not p or p.startswith("#"):
            continue
        back, p = p.startswith("!"), p.lstrip("!")
        folder, p = p.endswith("/"), p.rstrip("/")
        anchored, p = "/" in p, p.lstrip("/")
        out.append((("^" if anchored else "(^|/)") + glob_regex(p, crosses=False)[5:-1] + ("/" if folder else "(/|$)"), back))
    return out


class Walker:
    """Lists a tree folder by folder; `opened` counts the folders that it has read.

    skip: names of folders that are not opened; hidden: whether folders that begin with a dot are; ignore: patterns, of
    files and of folders (what lies in an ignored folder cannot be taken back in). only: an expression that a file's
    relative path must match. Symbolic links are left out, files and folders, as they may lead out of the tree.
    """

    def __init__(self, root: str, skip: tuple[str, ...] = (), ignore: tuple[str, ...] = (), hidden: bool = True, only: str = ""):
        self.root, self.skip, self.hidden = root, frozenset(skip), hidden
        self.rules = [(re.compile(rule), back) for rule, back in ignore_rules(list(ignore))]
        self.only = re.compile(only) if only else None
        self.opened = 0
        self.local = not re.match(r"[A-Za-z][A-Za-z0-9+.-]*://", root)

    def store(self):
        """(file system, path) of a root that is a URI of a store that pyarrow's file systems reach."""
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def ignored(self, path: str) -> bool:
        out = False
        for rule, back in self.rules:
            if rule.search(path):
                out = not back
        return out

    def entries(self, folder: str) -> Iterator[tuple[str, bool, int, int]]:
        """(name, whether a folder, size, seconds of change) of what lies in a folder; what vanishes meanwhile is left out."""
        self.opened += 1
        if self.local:
            try:
                with os.scandir(os.path.join(self.root, folder)) as found:
                    for e in found:
                        try:
                            if e.is_dir(follow_symlinks=False):
                                yield e.name, True, 0, 0
                            elif e.is_file(follow_symlinks=False):
                                s = e.stat(follow_symlinks=False)
                                yield e.name, False, s.st_size, int(s.st_mtime)
                        except FileNotFoundError:
                            continue
            except FileNotFoundError:
                return
            return
        from pyarrow import fs

        system, base = self.store()
        for e in system.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/"), recursive=False, allow_not_found=True)):
            yield e.base_name, e.type == fs.FileType.Directory, e.size or 0, int((e.mtime_ns or 0) // 10**9)

    def folder(self, folder: str) -> tuple[list[str], list[tuple[str, int, int]]]:
        """The folders to open and the files to read in a folder, by name; paths are relative to root."""
        below, files = [], []
        for name, is_folder, size, modified in sorted(self.entries(folder)):
            path = f"{folder}/{name}" if folder else name
            if is_folder:
                if name not in self.skip and (self.hidden or not name.startswith(".")) and not self.ignored(path + "/"):
                    below.append(path)
            elif not self.ignored(path) and (self.only is None or self.only.search(path)):
                files.append((path, size, modified))
        return below, files

    def files(self, folder: str) -> Iterator[tuple[str, int, int]]:
        """All files under a folder, depth first; memory is one path's folders."""
        todo = [folder]
        while todo:
            below, files = self.folder(todo.pop())
            yield from files
            todo += reversed(below)

    def stat(self, path: str) -> tuple[str, int, int] | None:
        """One file as folder() gives it; None if there is none, or if it is a folder or a link."""
        if self.local:
            whole = os.path.join(self.root, path)
            if os.path.islink(whole) or not os.path.isfile(whole):
                return None
            s = os.stat(whole)
            return path, s.st_size, int(s.st_mtime)
        from pyarrow import fs

        system, base = self.store()
        e = system.get_file_info(f"{base}/{path}")
        return (path, e.size or 0, int((e.mtime_ns or 0) // 10**9)) if e.type == fs.FileType.File else None

    def read(self, path: str) -> bytes | None:
        """A file's bytes; None if it has vanished."""
        try:
            if self.local:
                with open(os.path.join(self.root, path), "rb") as f:
                    return f.read()
            system, base = self.store()
            with system.open_input_stream(f"{base}/{path}") as f:
                return f.read()
        except FileNotFoundError:
            return None


@dataclass
class Part(InputPartition):
    """Files that planning has found, and folders whose trees the task walks itself."""

    found: list[tuple[str, int, int]] = field(default_factory=list)
    folders: list[str] = field(default_factory=list)


def plan(walker: Walker, planned: int = PLANNED) -> list[Part]:
    """Breadth first until `planned` folders are open or none is left; each folder that is then unread is a task's own tree."""
    todo, files = [""], []
    while todo and walker.opened < planned:
        below, found = walker.folder(todo.pop(0))
        todo += below
        files += found
    parts, size = [], BYTES
    for f in files:
        if size + f[1] > BYTES or len(parts[-1].found) >= FILES:
            parts.append(Part())
            size = 0
        parts[-1].found.append(f)
        size += f[1]
    return parts + [Part(folders=[f]) for f in todo]


class FileTree(DataSource):
    """spark.read.format("file_tree").option("root", ...): (path, length, modified, content) of a tree's files.

    Options: root, a folder that driver and executors mount, or a URI of a store that pyarrow's file systems reach; skip, ignore, lists
    with line ends between; hidden, only as Walker has them; files, relative paths that are read without a walk; most, bytes of a file beyond which its content is null and
    not read. A missing root has no rows.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FileTreeReader(dict(self.options))


class FileTreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        lines = lambda k: tuple(x for x in options.get(k, "").split("\n") if x)
        self.walker = Walker(re.sub(r"^file:/+", "/", options["root"]).rstrip("/") or "/", lines("skip"), lines("ignore"), options.get("hidden", "true") == "true", options.get("only", ""))
        self.most = int(options["most"]) if options.get("most") else None
        self.named = lines("files")

    def partitions(self) -> list[Part]:
        if self.named:
            return [Part([f for f in map(self.walker.stat, self.named) if f])]
        return plan(self.walker) or [Part()]

    def read(self, partition: Part):
        for found in (partition.found, *(self.walker.files(f) for f in partition.folders)):
            for path, length, modified in found:
                content = None if self.most is not None and length > self.most else self.walker.read(path)
                if content is not None or self.most is not None and length > self.most:
                    yield path, length, modified, content


def read_tree(spark: SparkSession, root: str, skip: tuple[str, ...] = (), ignore: list[str] | tuple[str, ...] = (), hidden: bool = True, only: str = "", most: int | None = None, files: list[str] | tuple[str, ...] = ()) -> DataFrame:
    """The files of a tree, by the data source above, which is registered with the session. files: only these, without a walk."""
    spark.dataSource.register(FileTree)
    reader = spark.read.format(FORMAT).option("root", root).option("skip", "\n".join(skip)).option("ignore", "\n".join(ignore)).option("hidden", str(hidden).lower()).option("only", only).option("files", "\n".join(files))
    return (reader if most is None else reader.option("most", str(most))).load()
