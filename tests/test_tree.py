"""The tree source: rules, underscores, and files that must stay closed."""

import os

import pytest

from quarrylight.sources import files as X
from quarrylight.sources import tree


@pytest.fixture()
def root(tmp_path):
    def put(path, text="text"):
        at = tmp_path / path
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_bytes(text.encode("utf-8") if isinstance(text, str) else text)
        return at

    for path in ("a.md", "__init__.py", "pkg/_y.py", "_notes/z.md", "deep/er/and/deeper/x.ts", "src/main.go", "space in name/ü.md", "empty.md"):
        put(path, "" if path == "empty.md" else f"of {path}")
    put("broken.md", b"a\xff\xfeb")
    for path in ("node_modules/m/a.js", ".hidden/a.md", "src/.cache/a.md", "pic.png", "x.lock", "dist/a.js", "README"):
        put(path)
    for path in ("node_modules/huge.js", "pic2.png", "big.md"):  # reading one of these would end the worker
        with open(put(path), "wb") as f:
            f.truncate(1 << 42)
    os.symlink("nowhere", tmp_path / "lost.md")
    return tmp_path


WANTED = {"a.md", "__init__.py", "pkg/_y.py", "_notes/z.md", "deep/er/and/deeper/x.ts", "src/main.go", "space in name/ü.md", "empty.md", "broken.md", "big.md"}


@pytest.mark.parametrize("folders", [1, 3, 64])
def test_scan_takes_underscores_and_leaves_the_rest_closed(spark, root, monkeypatch, folders):
    monkeypatch.setattr(tree, "FOLDERS", folders)
    got = {r.path: r for r in X.scan(spark, f"file://{root}", max_bytes=1000).collect()}
    assert set(got) == WANTED
    assert all(r.content == f"of {p}" for p, r in got.items() if p not in ("big.md", "broken.md", "empty.md"))
    assert got["big.md"].content is None and got["big.md"].size_bytes == 1 << 42 and got["empty.md"].content == ""
    assert got["broken.md"].content == "a��b" and got["a.md"].mtime_ms == os.stat(root / "a.md").st_mtime_ns // 1_000_000


def test_pruned_folders_are_not_listed(root, monkeypatch):
    listed = []
    own = tree.TreeReader._list
    monkeypatch.setattr(tree.TreeReader, "_list", lambda self, files, base, folder: listed.append(folder) or own(self, files, base, folder))
    import json

    reader = tree.TreeReader({"path": str(root), "include": json.dumps(X.INCLUDE), "exclude": json.dumps(X.EXCLUDE), "max_bytes": "1000"})
    paths = [x for p in reader.partitions() for b in reader.read(p) for x in b.column("path").to_pylist()]
    assert sorted(paths) == sorted(WANTED)
    assert not [f for f in listed if f.startswith(("node_modules", "dist", ".hidden", "src/.cache"))]


def test_markdown_skips_underscored_folders_only(spark, root):
    (root / "big.md").unlink()
    (root / "_x.md").write_text("taken")
    got = {r.path for r in X.markdown(spark, str(root)).collect()}
    assert got == {"a.md", "space in name/ü.md", "empty.md", "broken.md", "_x.md"}


def test_missing_root_and_empty_tree(spark, tmp_path):
    assert X.scan(spark, str(tmp_path)).count() == 0
    with pytest.raises(Exception, match="(?i)not found|no such|does not exist|non-existent"):
        X.scan(spark, str(tmp_path / "nowhere")).count()


def test_a_large_folder_is_read_entry_by_entry(tmp_path, monkeypatch):
    for i in range(50):
        (tmp_path / f"{i}.md").write_bytes(b"text")
    listed, scandir = [], os.scandir

    class Counted:
        def __init__(self, at):
            self.entries = scandir(at)

        def __enter__(self):
            return self

        def __exit__(self, *_):
            self.entries.close()

        def __iter__(self):
            for entry in self.entries:
                listed.append(entry.name)
                yield entry

    monkeypatch.setattr(os, "scandir", Counted)
    monkeypatch.setattr(tree, "BATCH_BYTES", 1)
    batches = tree.TreeReader({"path": str(tmp_path)}).read(tree.Folder("", True))
    assert next(batches).num_rows == 1 and len(listed) == 1
    assert 1 + sum(b.num_rows for b in batches) == 50
