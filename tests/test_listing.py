"""Trees listed in tasks."""

import os

import pytest

from codeweft.sources.files import file_names, listed_files, read_files


def tree(root, depth, width):
    """Folders of ``width`` children to ``depth``; what is wanted of them."""
    wanted = set()

    def grow(folder, inside, left):
        folder.mkdir()
        for name in ("__init__.py", "a b#1%.ts", "skip.bin", ".hidden.py"):
            (folder / name).write_text(name)
            if name != "skip.bin":
                wanted.add(inside + name)
        for k in range(width if left else 0):
            grow(folder / f"d{k}", f"{inside}d{k}/", left - 1)

    grow(root, "", depth)
    return wanted


@pytest.mark.parametrize("folders", [1, 4, 500])
def test_every_round_size_lists_the_whole_tree(spark, tmp_path, folders):
    wanted = tree(tmp_path / "t", 3, 3)
    for skipped in (".git", "node_modules", "d0/venv"):
        (tmp_path / "t" / skipped).mkdir()
        (tmp_path / "t" / skipped / "x.py").write_text("no")
    rows = file_names(spark, str(tmp_path / "t"), folders).collect()
    assert len(rows) == len(wanted) and {r.file for r in rows} == wanted
    assert all(os.path.samefile(r.uri, tmp_path / "t" / r.file) for r in rows)


def test_links_gone_and_empty_folders(spark, tmp_path):
    (tmp_path / "t/in").mkdir(parents=True)
    (tmp_path / "t/in/a.py").write_text("x = 1\n")
    (tmp_path / "t/in/again").symlink_to(tmp_path / "t")
    (tmp_path / "t/b.py").symlink_to(tmp_path / "t/in/a.py")
    (tmp_path / "t/c.py").symlink_to(tmp_path / "nowhere")
    (tmp_path / "t/d.py").mkdir()
    assert [f for f, _ in listed_files(spark, str(tmp_path / "t"))] == ["b.py", "in/a.py"]
    assert read_files(spark, str(tmp_path / "t"), "r").select("file", "content").count() == 2
    assert read_files(spark, f"file://{tmp_path}/t", "r").where("content = cast('x = 1\\n' as binary)").count() == 2
    (tmp_path / "e").mkdir()
    assert listed_files(spark, str(tmp_path / "e")) == listed_files(spark, str(tmp_path / "gone")) == []
    assert read_files(spark, str(tmp_path / "e"), "r").count() == 0


def test_names_stay_in_tables(spark, tmp_path, monkeypatch):
    tree(tmp_path / "t", 2, 2)
    from pyspark.sql import DataFrame

    def refused(*args, **kwargs):
        raise AssertionError("names came to the driver")

    for name in ("collect", "toPandas", "toLocalIterator", "take", "first"):
        monkeypatch.setattr(type(spark.range(1)), name, refused)
    assert isinstance(file_names(spark, str(tmp_path / "t"), 2), DataFrame)
