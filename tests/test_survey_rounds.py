"""Surveys in rounds against the walk of one process, on real folders; and what reading archives must bear."""

import os
import zipfile

from leafsieve.sources import archives


def make(path, text="x"):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)


def rows(spark, paths, **options):
    return [tuple(r) for r in archives.survey(spark, paths, **options).collect()]


def by_walk(paths, **options):
    return sorted({r[0]: r for r in archives.walk(paths, **options)}.values())


def test_equals_the_walk(spark, tmp_path, monkeypatch):
    for k in range(60):
        make(tmp_path / "lib" / f"s{k % 7}" / f"t{k % 3}" / f"book{k}.{('cbz', 'cbr', 'zip', 'pdf', 'txt')[k % 5]}")
    deep = tmp_path / "lib" / "/".join(["d"] * 25) / "end.cbz"
    make(deep)
    make(tmp_path / "lib" / "skip" / "no.cbz")
    (tmp_path / "lib" / "empty").mkdir()
    os.symlink(tmp_path / "lib" / "s0", tmp_path / "lib" / "linked")
    os.symlink(deep, tmp_path / "lib" / "link.cbz")
    os.symlink(tmp_path / "nowhere", tmp_path / "lib" / "dangling.cbz")
    top = str(tmp_path / "lib")
    for options in ({}, {"exclude": ["skip/*", "*book1*"]}, {"recursive": False}):
        assert rows(spark, [top], **options) == by_walk([top], **options)
    assert rows(spark, [top, str(deep), top, str(tmp_path / "gone")]) == by_walk([top, str(deep)])
    assert rows(spark, []) == []
    monkeypatch.setattr(archives, "ENOUGH", 0)
    monkeypatch.setattr(archives, "BELOW", 3)
    assert rows(spark, [top]) == by_walk([top])


def test_one_large_tree_uses_all_tasks(spark, tmp_path):
    for k in range(10_000):
        (tmp_path / f"f{k:05d}").mkdir()
        if k % 50 == 0:
            make(tmp_path / f"f{k:05d}" / "b.cbz")
    first, last = archives.survey_rounds(spark, [str(tmp_path)])
    assert first.count() == 10_000 and last.count() == 200
    tasks = spark.sparkContext.defaultParallelism
    assert last.select("task").distinct().count() == tasks
    assert rows(spark, [str(tmp_path)]) == by_walk([str(tmp_path)])


def test_entries_of_any_declared_size(tmp_path, monkeypatch):
    """An entry that is larger than what is read is an error of its own; the others are read."""
    monkeypatch.setattr(archives, "MOST_BYTES", 1000)
    path = tmp_path / "bomb.cbz"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a.png", b"a" * 1000)
        z.writestr("b.png", b"b" * 1001)
    (a, b) = archives.zip_entries(str(path))
    assert a[2] == b"a" * 1000 and a[3] is None and b[2] is None and "1001" in b[3]

