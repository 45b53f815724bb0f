"""Folder trees: what is listed, what is opened."""

from codeweave.sources.files import MAX_BYTES, indexable
from codeweave.sources.tree import list_tree, scan_tree


def test_tree_is_pruned_while_listed(spark, tmp_path):
    texts = {"a.cs": "class A {}", "x/b.sql": "SELECT 1", "x/y/z/deep.ts": "let a", "x/empty.md": "", "x/Node_Modules/m/i.js": "no", "bin/k.cs": "no", "x/p.min.js": "long", "x/ö ü.html": "ä"}
    for path, text in texts.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text, encoding="utf-8")
    (tmp_path / "big.cs").write_bytes(b"x" * (MAX_BYTES + 1))
    (tmp_path / "bom.cs").write_bytes(b"\xef\xbb\xbfclass B {}")
    (tmp_path / "latin.cs").write_bytes(b"caf\xe9")
    (tmp_path / "none").mkdir()
    (tmp_path / "lost.cs").symlink_to(tmp_path / "nowhere")
    opened = spark.sparkContext.accumulator(0)
    rows = {r.relative_path: r for r in scan_tree(spark, str(tmp_path), "w", opened).collect()}
    kept = {p for p in texts if "odules" not in p and "bin/" not in p}
    assert set(rows) == kept | {"big.cs", "bom.cs", "latin.cs"}
    assert opened.value == len(rows) - 2  # not the oversized and the generated one
    assert {p for p, r in rows.items() if r.skipped} == {"big.cs", "x/p.min.js"} == {p for p, r in rows.items() if r.content is None}
    assert all(rows[p].content == texts[p] for p in kept - {"x/p.min.js"})
    assert rows["bom.cs"].content == "class B {}" and rows["latin.cs"].content == "caf�"
    assert rows["x/b.sql"].size_bytes == 8 and rows["x/b.sql"].last_write is not None
    names = {r.relative_path for r in indexable(scan_tree(spark, tmp_path.as_uri(), "w").drop("skipped")).collect()}
    assert names == set(rows) - {"big.cs", "x/p.min.js"}


def test_trees_without_files(spark, tmp_path):
    assert list_tree(spark, str(tmp_path)).count() == 0
    assert scan_tree(spark, str(tmp_path / "missing"), "w").count() == 0
