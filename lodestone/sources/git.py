"""Repositories with their history: references, commits, trees and blobs as tables, files by depth as joins.

``git_objects`` reads loose objects and packs (offset and reference deltas resolved against their bases); a
partition is some loose folders or a range of a pack's objects, so one large repository is read by many tasks. ``git_refs``
reads references. The rest is Spark: commits meet their first parents by pointer doubling (as many joins as
the depth has binary digits), trees are unfolded level by level, once for each root tree, and blobs are joined.

The folder must be visible to all executors. Repositories are the folders below it that hold ``.git``, a ``.git`` file that
names another folder, or are bare; objects of alternates count. An object that cannot be read is a row with its
error and no content. A reference without a commit gives no files; submodules are no files.
"""

from __future__ import annotations

import mmap
import os
import re
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import dropped, ship, stored

#: The kinds of objects in a pack by number.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
BY_OFFSET, BY_NAME = 6, 7
OBJECTS_A_TASK = 20_000
#: Steps behind a head that are walked one by one.
WALKED = 12
#: Bytes of bases that a task keeps for the deltas to come.
KEPT = 64 << 20
ENTRY = T.StructType().add("mode", "string").add("name", "string").add("object_id", "string")
OBJECTS = T.StructType().add("repository_id", "string").add("object_id", "string").add("kind", "string").add("size", "long").add("text", "string").add("is_binary", "boolean").add("entries", T.ArrayType(ENTRY)).add("error", "string")
REFS = T.StructType().add("repository_id", "string").add("name", "string").add("object_id", "string")
REPOSITORIES = T.StructType().add("id", "string").add("urls", T.ArrayType(T.StringType())).add("is_fork", "boolean").add("repository_path", "string")


def git_folder(path: Path) -> Path | None:
    """Where a repository's objects and references are, None if ``path`` is none."""
    own = path / ".git"
    if own.is_file():
        named = own.read_text().partition("gitdir:")[2].strip()
        own = (path / named).resolve()
        common = own / "commondir"
        return (own / common.read_text().strip()).resolve() if common.exists() else own
    for top in (own, path):
        if (top / "objects").is_dir() and (top / "HEAD").is_file():
            return top
    return None


def repositories_below(root: str) -> list[tuple[str, Path]]:
    return [(p.name, top) for p in sorted(Path(root).iterdir()) if p.is_dir() and (top := git_folder(p))]


def object_folders(top: Path) -> list[Path]:
    """The folder of objects, and those of its alternates."""
    out, left = [], [top / "objects"]
    while left:
        folder = left.pop()
        if folder in out or not folder.is_dir():
            continue
        out.append(folder)
        listed = folder / "info" / "alternates"
        if listed.exists():
            left += [(folder / line).resolve() for line in listed.read_text().splitlines() if line and line[0] != "#"]
    return out


class PackIndex:
    """The names and offsets of a pack's objects, from an index of version 1 or 2."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.new = self.data[:4] == b"\xfftOc"
        if self.new and (version := struct.unpack(">I", self.data[4:8])[0]) != 2:
            raise ValueError(f"index version {version}")
        self.fan = 8 if self.new else 0
        self.n = self._fan(255)

    def _fan(self, byte: int) -> int:
        return struct.unpack_from(">I", self.data, self.fan + 4 * byte)[0]

    def name(self, i: int) -> bytes:
        at = self.fan + 1024 + (20 * i if self.new else 24 * i + 4)
        return self.data[at : at + 20]

    def offset(self, i: int) -> int:
        if not self.new:
            return struct.unpack_from(">I", self.data, 1024 + 24 * i)[0]
        names_end = self.fan + 1024 + 24 * self.n
        at = struct.unpack_from(">I", self.data, names_end + 4 * i)[0]
        return at if at < 1 << 31 else struct.unpack_from(">Q", self.data, names_end + 4 * self.n + 8 * (at - (1 << 31)))[0]

    def find(self, name: bytes) -> int | None:
        """The offset of an object."""
        lo, hi = self._fan(name[0] - 1) if name[0] else 0, self._fan(name[0])
        while lo < hi:
            middle = (lo + hi) // 2
            if self.name(middle) < name:
                lo = middle + 1
            else:
                hi = middle
        return self.offset(lo) if lo < self.n and self.name(lo) == name else None


class Pack:
    def __init__(self, path: str, index: PackIndex):
        with open(path, "rb") as f:
            self.data = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        self.index, self.kept, self.size = index, OrderedDict(), 0

    def _header(self, at: int) -> tuple[int, int, int]:
        """(kind, size, where the content begins)"""
        byte = self.data[at]
        kind, size, shift, at = byte >> 4 & 7, byte & 15, 4, at + 1
        while byte & 128:
            byte, at = self.data[at], at + 1
            size |= (byte & 127) << shift
            shift += 7
        return kind, size, at

    def _base(self, kind: int, start: int, at: int) -> tuple[int, int]:
        """(offset of a delta's base, where its content begins)"""
        if kind == BY_NAME:
            if (base := self.index.find(self.data[at : at + 20])) is None:
                raise ValueError("a delta's base is not in its pack")
            return base, at + 20
        byte, at = self.data[at], at + 1
        back = byte & 127
        while byte & 128:
            byte, at = self.data[at], at + 1
            back = (back + 1) << 7 | byte & 127
        return start - back, at

    def _inflated(self, at: int, size: int) -> bytes:
        stream, out, got = zlib.decompressobj(), [], 0
        while not stream.eof:
            if at >= len(self.data):
                raise ValueError("the pack ends within an object")
            piece = stream.decompress(self.data[at : at + 65536])
            out.append(piece)
            got, at = got + len(piece), at + 65536
        if got != size:
            raise ValueError(f"{got} bytes instead of {size}")
        return b"".join(out)

    def kind(self, at: int) -> str:
        while True:
            kind, _, content = self._header(at)
            if kind in KINDS:
                return KINDS[kind]
            at, _ = self._base(kind, at, content)

    def read(self, at: int) -> bytes:
        """An object's content: its base's, changed by each delta on the way back."""
        chain = []
        while at not in self.kept:
            kind, size, content = self._header(at)
            if kind in KINDS:
                self._keep(at, self._inflated(content, size))
                break
            base, content = self._base(kind, at, content)
            chain.append((at, content, size))
            at = base
        self.kept.move_to_end(at)
        out = self.kept[at]
        for at, content, size in reversed(chain):
            out = patched(out, self._inflated(content, size))
            self._keep(at, out)
        return out

    def _keep(self, at: int, content: bytes) -> None:
        self.kept[at] = content
        self.size += len(content)
        while self.size > KEPT and len(self.kept) > 1:
            self.size -= len(self.kept.popitem(last=False)[1])


def patched(base: bytes, delta: bytes) -> bytes:
    """``base`` changed by a delta: its two sizes, then copies of ranges of the base and literal bytes."""

    def number(at: int) -> tuple[int, int]:
        value = shift = 0
        while True:
            byte, at = delta[at], at + 1
            value |= (byte & 127) << shift
            shift += 7
            if not byte & 128:
                return value, at

    source, at = number(0)
    target, at = number(at)
    if source != len(base):
        raise ValueError("a delta of another base")
    out = bytearray()
    while at < len(delta):
        code, at = delta[at], at + 1
        if code & 128:
            fields = []
            for bit in range(7):
                fields.append(delta[at] if code >> bit & 1 else 0)
                at += code >> bit & 1
            begin, length = int.from_bytes(bytes(fields[:4]), "little"), int.from_bytes(bytes(fields[4:]), "little") or 0x10000
            out += base[begin : begin + length]
        elif code:
            out += delta[at : at + code]
            at += code
        else:
            raise ValueError("a delta with an unknown step")
    if len(out) != target:
        raise ValueError("a delta that makes another size")
    return bytes(out)


def tree_entries(content: bytes) -> list[tuple[str, str, str]]:
    out, at = [], 0
    while at < len(content):
        blank = content.index(b" ", at)
        end = content.index(b"\0", blank)
        out.append((content[at:blank].decode(), content[blank + 1 : end].decode(errors="replace"), content[end + 1 : end + 21].hex()))
        at = end + 21
    return out


def object_row(repository: str, name: str, kind: str, content: bytes) -> tuple:
    if kind == "tree":
        return repository, name, kind, len(content), None, None, tree_entries(content), None
    binary = kind == "blob" and b"\0" in content[:8000]
    return repository, name, kind, len(content), None if binary else content.decode(errors="replace"), binary, None, None


def failed_row(repository: str, name: str, kind: str | None, e: Exception) -> tuple:
    return repository, name, kind, None, None, None, None, f"{type(e).__name__}: {e}"


class _Part(InputPartition):
    def __init__(self, repository: str, path: str, lo: int = 0, hi: int = 0):
        self.repository, self.path, self.lo, self.hi = repository, path, lo, hi


class _Reader(DataSourceReader):
    def __init__(self, root: str, kinds: str):
        self.root, self.kinds = root, set(kinds.split(",")) if kinds else set(KINDS.values())


class _Objects(_Reader):
    def partitions(self) -> list[InputPartition]:
        out = []
        for repository, top in repositories_below(self.root):
            for folder in object_folders(top):
                out += [_Part(repository, str(folder), int(digit, 16)) for digit in sorted({p.name[0] for p in folder.iterdir() if re.fullmatch("[0-9a-f]{2}", p.name)})]
                for pack in sorted((folder / "pack").glob("*.pack")):
                    n = PackIndex(str(pack.with_suffix(".idx"))).n
                    out += [_Part(repository, str(pack), lo, min(lo + OBJECTS_A_TASK, n)) for lo in range(0, n, OBJECTS_A_TASK)]
        return out

    def read(self, partition: _Part) -> Iterator[tuple]:
        return self._packed(partition) if partition.path.endswith(".pack") else self._loose(partition)

    def _loose(self, part: _Part) -> Iterator[tuple]:
        for path in sorted(Path(part.path).glob(f"{part.lo:x}[0-9a-f]/*")):
            name, kind = path.parent.name + path.name, None
            if not re.fullmatch("[0-9a-f]{40}", name):
                continue
            try:
                head, _, content = zlib.decompress(path.read_bytes()).partition(b"\0")
                kind = head.partition(b" ")[0].decode()
                if kind in self.kinds:
                    yield object_row(part.repository, name, kind, content)
            except (zlib.error, ValueError, OSError) as e:
                yield failed_row(part.repository, name, kind, e)

    def _packed(self, part: _Part) -> Iterator[tuple]:
        index = PackIndex(f"{part.path.removesuffix('.pack')}.idx")
        pack = Pack(part.path, index)
        # by place in the pack: bases lie near their deltas
        for at, i in sorted((index.offset(i), i) for i in range(part.lo, part.hi)):
            name, kind = index.name(i).hex(), None
            try:
                kind = pack.kind(at)
                if kind in self.kinds:
                    yield object_row(part.repository, name, kind, pack.read(at))
            except (zlib.error, ValueError, IndexError) as e:
                yield failed_row(part.repository, name, kind, e)


class GitObjects(DataSource):
    """``spark.read.format("git_objects").option("kinds", "commit,tree").load(root)``"""

    @classmethod
    def name(cls) -> str:
        return "git_objects"

    def schema(self):
        return OBJECTS

    def reader(self, schema) -> DataSourceReader:
        return _Objects(self.options["path"], self.options.get("kinds", ""))


class _Refs(_Reader):
    def partitions(self) -> list[InputPartition]:
        return [_Part(repository, str(top)) for repository, top in repositories_below(self.root)]

    def read(self, partition: _Part) -> Iterator[tuple]:
        top, found = Path(partition.path), {}
        packed = top / "packed-refs"
        if packed.exists():
            for line in packed.read_text().splitlines():
                if m := re.fullmatch("([0-9a-f]{40}) (.+)", line):
                    found[m[2]] = m[1]
        for path in sorted((top / "refs").rglob("*")):  # a loose reference hides a packed one
            if path.is_file() and re.fullmatch("[0-9a-f]{40}", text := path.read_text().strip()):
                found[str(path.relative_to(top))] = text
        head = (top / "HEAD").read_text().strip()
        found["HEAD"] = found.get(head.removeprefix("ref: ")) if head.startswith("ref: ") else head
        for name, object_id in found.items():
            if object_id:
                yield partition.repository, name, object_id


class GitRefs(DataSource):
    @classmethod
    def name(cls) -> str:
        return "git_refs"

    def schema(self):
        return REFS

    def reader(self, schema) -> DataSourceReader:
        return _Refs(self.options["path"], "")


class _Repositories(_Refs):
    def read(self, partition: _Part) -> Iterator[tuple]:
        config = Path(partition.path, "config")
        urls = re.findall(r"(?m)^\s*url\s*=\s*(\S+)", config.read_text()) if config.exists() else []
        yield partition.repository, urls, None, os.path.abspath(partition.path)


class GitRepositories(DataSource):
    """(id, urls, is_fork, repository_path): whether it is a fork is not known from a folder."""

    @classmethod
    def name(cls) -> str:
        return "git_repositories"

    def schema(self):
        return REPOSITORIES

    def reader(self, schema) -> DataSourceReader:
        return _Repositories(self.options["path"], "")


def _load(spark: SparkSession, source: type[DataSource], root: str, **options: str) -> DataFrame:
    ship(spark)
    spark.dataSource.register(source)
    return spark.read.format(source.name()).options(**options).load(root)


def objects(spark: SparkSession, root: str, *kinds: str) -> DataFrame:
    return _load(spark, GitObjects, root, kinds=",".join(kinds))


def references(spark: SparkSession, root: str) -> DataFrame:
    return _load(spark, GitRefs, root)


def repositories(spark: SparkSession, root: str) -> DataFrame:
    return _load(spark, GitRepositories, root)


def commits_of(found: DataFrame) -> DataFrame:
    """(repository_id, commit, tree, parents, commit_time, message) of commit objects."""
    head, message = F.substring_index("text", "\n\n", 1), F.expr("substring(text, instr(text, '\n\n') + 2)")
    at = F.regexp_extract(head, r"(?m)^committer .* (\d+) [+-]\d{4}$", 1)
    return found.where("kind = 'commit' and error is null").select(
        "repository_id",
        F.col("object_id").alias("commit"),
        F.regexp_extract(head, "(?m)^tree ([0-9a-f]{40})$", 1).alias("tree"),
        F.regexp_extract_all(head, F.lit("(?m)^parent ([0-9a-f]{40})$"), F.lit(1)).alias("parents"),
        F.timestamp_seconds(F.when(at != "", at).cast("long")).alias("commit_time"),
        message.alias("message"),
    )


def first_parents(commits: DataFrame, heads: DataFrame, depth: int = -1) -> DataFrame:
    """(repository_id, commit, index): the commits on the line of first parents from ``heads`` (repository_id, commit), from 0.

    ``commits`` has (repository_id, commit, parent); a head without a commit is left out, a missing parent ends the line. With a ``depth``
    below 0 all of them, else those up to that index. Up to a depth of ``WALKED`` each step is one join with the commits; beyond, the commits found and the way that one jump goes
    double in each round, which deals the commits four times.
    """
    jumps = stored(commits.select("repository_id", "commit", "parent"), "jumps")
    if 0 <= depth <= WALKED:
        at, found = heads.select("repository_id", "commit").distinct(), None
        for index in range(depth + 1):
            # a head or a parent whose commit is not here (a shallow copy) ends the line
            here = stored(at.join(jumps, ["repository_id", "commit"]).dropDuplicates(["repository_id", "commit"]), "found")
            own = here.select("repository_id", "commit", F.lit(index).cast("long").alias("index"))
            found = own if found is None else found.unionByName(own)
            at = here.where("parent is not null").select("repository_id", F.col("parent").alias("commit"))
        dropped(jumps)
        return found
    found = stored(heads.select("repository_id", "commit").join(jumps.select("repository_id", "commit"), ["repository_id", "commit"], "left_semi").distinct().withColumn("index", F.lit(0).cast("long")), "found")
    way = 1
    while depth < 0 or way <= depth:
        next_ = found.join(jumps.where("parent is not null"), ["repository_id", "commit"]).select("repository_id", F.col("parent").alias("commit"), (F.col("index") + way).alias("index"))
        if depth >= 0:
            next_ = next_.where(F.col("index") <= depth)
        # a parent whose commit is not here (a shallow copy) ends the line
        next_ = stored(next_.join(jumps.select("repository_id", "commit"), ["repository_id", "commit"], "left_semi"), "found")
        if next_.isEmpty():
            dropped(next_)
            break
        on = jumps.select("repository_id", F.col("commit").alias("parent"), F.col("parent").alias("__far"))
        further = stored(jumps.join(on, ["repository_id", "parent"], "left").select("repository_id", "commit", F.col("__far").alias("parent")), "jumps")
        both = stored(found.unionByName(next_), "found")
        for old in (found, next_, jumps):
            dropped(old)
        found, jumps, way = both, further, 2 * way
    dropped(jumps)
    return found


def tree_files(entries: DataFrame, roots: DataFrame) -> DataFrame:
    """(repository_id, tree, path, mode, blob_id) of all files below the trees ``roots`` (repository_id, tree).

    ``entries`` has (repository_id, tree, mode, name, object_id). Each level is one join, with as many rows as it has folders.
    """
    at = roots.select("repository_id", "tree", F.col("tree").alias("at"), F.lit("").alias("above")).distinct()
    inner = entries.select("repository_id", F.col("tree").alias("at"), "mode", "name", "object_id")
    files, folders = None, F.col("mode").isin("40000", "040000")
    while True:
        level = stored(at.join(inner, ["repository_id", "at"]).select("repository_id", "tree", F.concat("above", "name").alias("path"), "mode", "object_id"), "tree-level")
        own = level.where(~folders & (F.col("mode") != "160000")).withColumnRenamed("object_id", "blob_id")
        files = own if files is None else files.unionByName(own)
        at = level.where(folders).select("repository_id", "tree", F.col("object_id").alias("at"), F.concat("path", F.lit("/")).alias("above"))
        if at.isEmpty():
            return files


def history_files(commits: DataFrame, entries: DataFrame, heads: DataFrame, depth: int = 0) -> DataFrame:
    """(repository_id, commit_hash, index, path, mode, blob_id) of the commits up to ``depth`` behind the heads."""
    line = first_parents(commits.withColumn("parent", F.get("parents", F.lit(0))), heads, depth)
    at = stored(line.join(commits.select("repository_id", "commit", "tree"), ["repository_id", "commit"]), "line")
    files = tree_files(entries, at.select("repository_id", "tree"))
    return at.join(files, ["repository_id", "tree"]).select("repository_id", F.col("commit").alias("commit_hash"), "index", "path", "mode", "blob_id")


def read_history(spark: SparkSession, root: str, depth: int = 0) -> DataFrame:
    """Files as in ``columns.FILES``, with ``index``: those of HEAD (0), of ``depth`` commits before it as well, or of all (below 0).

    A blob that cannot be read has neither content nor ``is_binary``.
    """
    found = stored(objects(spark, root, "commit", "tree"), "git-objects")
    commits = stored(commits_of(found), "git-commits")
    entries = found.where("kind = 'tree'").select("repository_id", F.col("object_id").alias("tree"), F.explode("entries").alias("e")).select("repository_id", "tree", "e.*")
    heads = references(spark, root).where("name = 'HEAD'").select("repository_id", F.col("object_id").alias("commit"))
    files = stored(history_files(commits, entries.distinct(), heads, depth), "git-files")
    wanted = files.select("repository_id", F.col("blob_id").alias("object_id")).distinct()
    # an object can be loose and packed, or in two packs
    blobs = objects(spark, root, "blob").join(wanted, ["repository_id", "object_id"], "left_semi").dropDuplicates(["repository_id", "object_id"])
    blobs = blobs.select("repository_id", F.col("object_id").alias("blob_id"), F.col("text").alias("content"), "is_binary")
    return files.join(blobs, ["repository_id", "blob_id"], "left").select("repository_id", "path", "blob_id", "commit_hash", F.lit(None).cast("string").alias("lang"), "content", "is_binary", "index")
