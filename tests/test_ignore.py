import subprocess

import pytest

from tamis.sources import files as sources
from tamis.sources.files import from_path
from tamis.sources.storage import list_folder, read_bytes


@pytest.fixture
def put(tmp_path, monkeypatch):
    monkeypatch.setenv("HOME", str(tmp_path / "home"))
    monkeypatch.setenv("XDG_CONFIG_HOME", str(tmp_path / "config"))
    monkeypatch.setenv("GIT_CONFIG_GLOBAL", "/dev/null")

    def put(name, content="x"):
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text(content)

    return put


def listed(spark, root, prefix=None):
    prefix = prefix or root
    return sorted(r.path.removeprefix(f"{prefix}/") for r in from_path(spark, root).select("path").collect())


@pytest.fixture
def tree(put, tmp_path):
    subprocess.run(["git", "init", "-q", str(tmp_path / "repo")], check=True)
    put("config/git/ignore", "*.swp\n*.bak\n")
    put("repo/.git/info/exclude", "/pkg/private\n*.bak\n*.tmp\n")
    put("repo/.gitignore", "*.log\n/pkg/out/\n!keep.bak\n")
    put("repo/pkg/.gitignore", "!special.log\n*.o\n")
    put("repo/pkg/deep/.gitignore", "special.log\n!a.o\n")
    for name in (
        "a.txt", "a.swp", "a.bak", "keep.bak", "a.tmp", "a.log", "special.log", "a.o", "private/x", "out/x",
        "deep/special.log", "deep/a.o", "deep/out/x", "deep/.hidden/_y", "deep/_SUCCESS", "deep/k=v/_a=b",
    ):
        put(f"repo/pkg/{name}")
    return str(tmp_path / "repo/pkg")


KEPT = [
    ".gitignore", "a.txt", "deep/.gitignore", "deep/.hidden/_y", "deep/_SUCCESS", "deep/a.o", "deep/k=v/_a=b",
    "deep/out/x", "keep.bak", "special.log",
]


@pytest.mark.parametrize("limit", [sources.LISTED_AT_ONCE, 1])
def test_ignore_files_of_all_kinds(spark, tree, monkeypatch, limit):
    """Of the tree, above it, of the repository and global; also where a task
    lists one entry only before it hands back the rest."""
    monkeypatch.setattr(sources, "LISTED_AT_ONCE", limit)
    assert listed(spark, tree) == KEPT


def test_uri_gives_the_same_rows(spark, tree):
    for uri in (f"file://{tree}", f"file:{tree}"):
        assert listed(spark, uri, tree) == KEPT
        assert sorted(p.removeprefix(uri) for p, _ in list_folder(uri)) == sorted(
            p.removeprefix(tree) for p, _ in list_folder(tree)
        )
        assert read_bytes(f"{uri}/a.txt") == b"x" and read_bytes(f"{uri}/none") is None


def test_many_ignored_names(spark, tree, monkeypatch):
    """Beyond the size of a broadcast, tasks read the names that are left."""
    monkeypatch.setattr(sources, "BROADCAST_BYTES", 0)
    assert listed(spark, tree) == KEPT
    assert {r.text for r in from_path(spark, tree).filter("path like '%.txt'").collect()} == {"x"}


def test_many_patterns(spark, put, tmp_path):
    put("many/.gitignore", "".join(f"no{i}.txt\n" for i in range(120_000)) + "a.txt\n")
    put("many/a.txt"), put("many/b.txt"), put("many/no119999.txt")
    assert listed(spark, str(tmp_path / "many")) == [".gitignore", "b.txt"]


def test_folder_without_repository(spark, put, tmp_path):
    put("config/git/ignore", "*.swp\n")
    put(".gitignore", "*.txt\n")
    put("plain/a.swp"), put("plain/a.txt")
    (tmp_path / "plain/loop").symlink_to(tmp_path / "plain")
    put("empty/.gitignore", "# nothing\n\n")
    assert listed(spark, str(tmp_path / "empty")) == [".gitignore"]
    assert {"a.swp", "a.txt"} <= set(listed(spark, str(tmp_path / "plain")))
