"""Repositories built with git, read from their objects and held against what git itself lists."""

import os
import subprocess
import zlib

import pytest
from pyspark.sql import functions as F

from lodestone.sources import git as source


class Repository:
    def __init__(self, path, *args):
        self.path, self.n = path, 0
        self("init", "-q", "-b", "main", *args, str(path), at="/")

    def __call__(self, *args, at=None):
        stamp = f"{1_500_000_000 + self.n} +0200"
        env = os.environ | {"GIT_AUTHOR_DATE": stamp, "GIT_COMMITTER_DATE": stamp, "GIT_CONFIG_GLOBAL": "/dev/null", "GIT_CONFIG_SYSTEM": "/dev/null"}
        who = ["-c", "user.name=n", "-c", "user.email=n@example.org", "-c", "core.quotePath=false", "-c", "protocol.file.allow=always"]
        return subprocess.run(["git", *who, *args], cwd=at or self.path, env=env, check=True, capture_output=True, text=True).stdout

    def commit(self, files, message="m"):
        self.n += 1
        for name, content in files.items():
            path = self.path / name
            if content is None:
                path.unlink()
                continue
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_bytes(content if isinstance(content, bytes) else content.encode())
        self("add", "-A")
        self("commit", "-q", "--allow-empty", "-m", message)

    def files(self, depth):
        """(index, commit, path, blob) of the first-parent line."""
        line = self("rev-list", "--first-parent", "HEAD").split()
        for i, commit in enumerate(line if depth < 0 else line[: depth + 1]):
            for row in self("ls-tree", "-r", "-z", commit).split("\0")[:-1]:
                about, path = row.split("\t")
                if about.split()[1] == "blob":
                    yield i, commit, path, about.split()[2]


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    root = tmp_path_factory.mktemp("repos")
    one = Repository(root / "one")
    body = [f"line {i} of a file that grows\n" for i in range(400)]
    one.commit({"a.py": "".join(body), "deep/er/still/b.txt": "b", "bin": b"\0\1\2", "empty": "", "näme 城.txt": "é\nü"})
    for i in range(30):
        body[i * 7] = f"changed {i}\n"
        one.commit({"a.py": "".join(body + [f"tail {i}\n"]), f"d{i % 3}/f{i}.c": f"int x{i};\n"}, f"tree 0000\n\nparent of nothing {i}")
    one("checkout", "-q", "-b", "side")
    one.commit({"side.txt": "s"})
    one("checkout", "-q", "main")
    one.commit({"d0/f0.c": None})
    one("merge", "-q", "--no-ff", "-m", "merged", "side")
    one("gc", "-q", "--aggressive")  # packed, with deltas
    one.commit({"loose.txt": "after the pack", "run.sh": "#!/bin/sh\n"})
    two = Repository(root / "two")
    for i in range(3):
        two.commit({"same.txt": "x" * 10, "n.txt": str(i)})
    two("remote", "add", "origin", "https://example.org/two.git")
    two("checkout", "-q", "--detach", "HEAD~1")
    Repository(root / "unborn")
    two("clone", "-q", "--bare", "--shared", str(root / "one"), str(root / "bare"), at=root)
    (root / "plain").mkdir()
    return root, {"one": one, "two": two, "bare": one}


@pytest.mark.parametrize("depth", [0, 1, 5, 12, -1])
def test_files_by_depth_are_those_that_git_lists(spark, root, depth):
    path, made = root
    got = source.read_history(spark, str(path), depth)
    assert set(source_columns()) < set(got.columns)
    found = sorted((r.repository_id, r["index"], r.commit_hash, r.path, r.blob_id) for r in got.collect())
    assert found == sorted((name, *row) for name, repository in made.items() for row in repository.files(depth))


def source_columns():
    from lodestone.columns import FILES

    return FILES.names


def test_contents_of_all_commits(spark, root):
    path, made = root
    one = made["one"]
    blobs = {r.blob_id: (r.content, r.is_binary) for r in source.read_history(spark, str(path), -1).where("repository_id = 'one'").collect()}
    assert len(blobs) > 60
    for blob, (content, binary) in blobs.items():
        raw = subprocess.run(["git", "cat-file", "blob", blob], cwd=one.path, capture_output=True, check=True).stdout
        assert (content, binary) == ((None, True) if b"\0" in raw else (raw.decode(), False))


def test_commits_and_references(spark, root):
    path, made = root
    one = made["one"]
    commits = {r.commit: r for r in source.commits_of(source.objects(spark, str(path), "commit")).where("repository_id = 'one'").collect()}
    want = one("log", "--all", "--format=%H %T %ct %P").splitlines()
    assert len(commits) == len(want)
    for line in want:
        name, tree, at, *parents = line.split()
        row = commits[name]
        assert (row.tree, row.parents, int(row.commit_time.timestamp())) == (tree, parents, int(at))
    refs = {r.name: r.object_id for r in source.references(spark, str(path)).where("repository_id = 'one'").collect()}
    listed = dict(reversed(x.split()) for x in one("show-ref", "--head").splitlines())
    assert refs == listed and {"HEAD", "refs/heads/main", "refs/heads/side"} <= set(refs)
    about = {r.id: r for r in source.repositories(spark, str(path)).collect()}
    assert set(about) == {"one", "two", "unborn", "bare"} and about["two"].urls == ["https://example.org/two.git"]


def test_packs_have_deltas_and_many_parts(root, monkeypatch):
    path, _ = root
    monkeypatch.setattr(source, "OBJECTS_A_TASK", 10)
    monkeypatch.setattr(source, "KEPT", 5000)  # bases are read again once they have gone
    reader = source._Objects(str(path), "")
    parts = [p for p in reader.partitions() if p.repository == "one"]
    assert sum(p.path.endswith(".pack") for p in parts) > 10
    rows = [r for p in parts for r in reader.read(p)]
    assert not any(r[-1] for r in rows)
    for _, name, kind, size, text, *_ in rows:
        if kind == "blob" and text is not None:
            assert source_hash(b"blob", text.encode()) == name and size == len(text.encode())
    (pack,) = {p.path for p in parts if p.path.endswith(".pack")}
    index = source.PackIndex(pack.replace(".pack", ".idx"))
    opened = source.Pack(pack, index)
    kinds = [opened._header(index.offset(i))[0] for i in range(index.n)]
    assert source.BY_OFFSET in kinds and index.find(b"\0" * 20) is None


def source_hash(kind, content):
    import hashlib

    return hashlib.sha1(kind + b" %d\0" % len(content) + content).hexdigest()


def test_old_indexes_and_deltas_by_name(tmp_path, root):
    path, _ = root
    (pack,) = (path / "one" / ".git" / "objects" / "pack").glob("*.pack")
    subprocess.run(["git", "index-pack", "--index-version=1", "-o", str(tmp_path / "old.idx"), str(pack)], check=True, capture_output=True)
    new, old = source.PackIndex(str(pack.with_suffix(".idx"))), source.PackIndex(str(tmp_path / "old.idx"))
    assert [(new.name(i), new.offset(i)) for i in range(new.n)] == [(old.name(i), old.offset(i)) for i in range(old.n)]
    names = "".join(new.name(i).hex() + "\n" for i in range(new.n))
    made = subprocess.run(["git", "pack-objects", "-q", "--delta-base-offset", "--no-reuse-delta", str(tmp_path / "x")], input=names, text=True, cwd=path / "one", check=True, capture_output=True)
    assert made.stdout
    by_name = subprocess.run(["git", "-c", "repack.useDeltaBaseOffset=false", "pack-objects", "-q", "--no-reuse-delta", str(tmp_path / "y")], input=names, text=True, cwd=path / "one", check=True, capture_output=True).stdout.strip()
    index = source.PackIndex(str(tmp_path / f"y-{by_name}.idx"))
    opened = source.Pack(str(tmp_path / f"y-{by_name}.pack"), index)
    assert source.BY_NAME in {opened._header(index.offset(i))[0] for i in range(index.n)}
    for i in range(index.n):
        at = index.offset(i)
        assert source_hash(opened.kind(at).encode(), opened.read(at)) == index.name(i).hex()


def test_what_cannot_be_read_is_a_row(spark, tmp_path):
    broken = Repository(tmp_path / "broken")
    broken.commit({"a.txt": "a", "b.txt": "b"})
    blob = broken("rev-parse", "HEAD:b.txt").strip()
    loose = tmp_path / "broken" / ".git" / "objects" / blob[:2] / blob[2:]
    loose.chmod(0o644)
    loose.write_bytes(zlib.compress(b"blob 1\0b")[:-6])
    (row,) = source.objects(spark, str(tmp_path)).where("error is not null").collect()
    assert row.object_id == blob and row.text is None
    got = {r.path: (r.content, r.is_binary) for r in source.read_history(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == ("a", False) and got["b.txt"][0] is None


def test_lines_of_first_parents(spark):
    commits = [("r", i, i + 1 if i < 70 else None) for i in range(71)] + [("s", 0, 5), ("s", 9, None), ("t", 1, None)]
    table = spark.createDataFrame(commits, "repository_id string, commit int, parent int")
    heads = spark.createDataFrame([("r", 0), ("s", 0), ("t", 7), ("r", 0)], "repository_id string, commit int")
    for depth in (0, 1, 2, 3, 16, 33, 70, 500, -1):
        got = sorted((r.repository_id, r.commit, r["index"]) for r in source.first_parents(table, heads, depth).collect())
        last = 70 if depth < 0 else min(depth, 70)
        assert got == [("r", i, i) for i in range(last + 1)] + [("s", 0, 0)]


def test_a_pack_that_is_cut_off_fails_by_object(tmp_path):
    one = Repository(tmp_path / "r")
    one.commit({f"{i}.txt": f"{i}" * 2000 for i in range(20)})
    one("gc", "-q")
    (pack,) = (tmp_path / "r" / ".git" / "objects" / "pack").glob("*.pack")
    pack.chmod(0o644)
    pack.write_bytes(pack.read_bytes()[: pack.stat().st_size // 2])
    reader = source._Objects(str(tmp_path), "")
    rows = [r for p in reader.partitions() for r in reader.read(p)]
    assert any(r[-1] for r in rows) and any(r[-1] is None for r in rows)


def test_index_is_a_long(spark, root):
    assert dict(source.read_history(spark, str(root[0])).dtypes)["index"] == "bigint"
    assert source.read_history(spark, str(root[0])).where(F.col("lang").isNotNull()).count() == 0
