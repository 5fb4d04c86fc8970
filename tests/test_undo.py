"""Past runs: what their files are like, restoring at once from two places, deleting and sweeping backups."""

import io
import json
import os
import threading

import pytest
from tests.test_books_on_disk import book, picture

from leafsieve.__main__ import TABLES, main
from leafsieve.plans import undo


def items(spark, folder, n=5):
    rows = []
    for k in range(n):
        archive, backup = os.path.join(folder, f"b{k}.cbz"), os.path.join(folder, f"b{k}.cbz.bak")
        for path, text in ((archive, "clean"), (backup, f"whole {k}")):
            with open(path, "w", encoding="utf-8") as file:
                file.write(text)
        size = os.stat(archive)
        rows.append((k, 1 + k % 2, archive, archive, backup, 1, ["p"], 3, False, size.st_size, size.st_mtime_ns, None))
    return spark.createDataFrame(rows, TABLES["items"])


def test_two_restores_at_once(spark, tmp_path):
    found = items(spark, str(tmp_path))
    os.unlink(tmp_path / "b3.cbz.bak")
    (tmp_path / "b4.cbz").write_text("edited since")
    seen = undo.with_status(found)
    assert [r.status for r in seen.orderBy("id").collect()] == ["can be restored"] * 3 + ["the backup has since been deleted", "changed since the run"]
    journal, results = str(tmp_path / "journal"), []
    threads = [threading.Thread(target=lambda: results.append({r.id: r.why for r in undo.restore_items(seen, journal).collect()})) for _ in range(2)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert results[0] == results[1] == {0: None, 1: None, 2: None, 3: "the backup has since been deleted", 4: "changed since the run"}
    assert [(tmp_path / f"b{k}.cbz").read_text() for k in range(5)] == ["whole 0", "whole 1", "whole 2", "clean", "edited since"]
    marked = undo.mark_all_restored(found, undo.restore_items(seen, journal))
    assert marked.columns == found.columns and [r.restored_at is not None for r in marked.orderBy("id").collect()] == [True] * 3 + [False] * 2


def test_a_restore_that_died(spark, tmp_path):
    """The file was moved and nothing noted: the book counts as restored."""
    found = undo.with_status(items(spark, str(tmp_path), 1))
    found.collect()
    os.replace(tmp_path / "b0.cbz.bak", tmp_path / "b0.cbz")
    assert [r.why for r in undo.restore_items(found, str(tmp_path / "j")).collect()] == [None]


def test_sweep_spares_pinned_runs(spark, tmp_path):
    found = items(spark, str(tmp_path))
    for name in ("loose.cbz.bak", "loose.cbr.bak.2", "notes.bak", "b9.cbz"):
        (tmp_path / name).write_text("xy")
    (tmp_path / "dir.cbz.bak").mkdir()
    folders = undo.backup_folders(found)
    assert [r.folder for r in folders.collect()] == [str(tmp_path)]
    backups = undo.find_backups(spark, folders)
    assert {os.path.basename(r.path) for r in backups.collect()} == {*(f"b{k}.cbz.bak" for k in range(5)), "loose.cbz.bak", "loose.cbr.bak.2"}
    from leafsieve.operators.history import backups_to_clean

    runs = spark.createDataFrame([(1, 0.0, "cli", True), (2, 0.0, "cli", False)], TABLES["runs"])
    assert undo.delete_files(backups_to_clean(backups.select("path"), found, runs)) == (4, 4 + 2 * 7)
    assert sorted(p.name for p in tmp_path.glob("*.bak*")) == ["b0.cbz.bak", "b2.cbz.bak", "b4.cbz.bak", "dir.cbz.bak", "notes.bak"]
    assert undo.delete_files(backups.select("path").limit(0)) == (0, 0)


def test_commands(spark, tmp_path):
    shelf = tmp_path / "shelf"
    shelf.mkdir()
    advert = picture(99)
    for k in range(3):
        book(shelf / f"b{k}.cbz", [advert if i == 1 else picture(10 * k + i) for i in range(5)])

    def run(*args):
        out = io.StringIO()
        return main(["--store", str(tmp_path / "store"), *map(str, args)], spark, out), out.getvalue()

    assert run("clean", shelf, "--all", "--yes", "--min-pages", 3)[0] == 0
    assert run("pack", "export", tmp_path / "pack.json")[0] == 0
    with open(tmp_path / "pack.json", encoding="utf-8") as file:
        pack = json.load(file)
    assert pack["settings"]["min_pages"] == 3
    pack["settings"] |= {"min_pages": 4, "threshold": 2}
    pack["ignored"] = [{"id": "0000000000000007", "note": "left", "hashes": ["0000000000000007"]}]
    (tmp_path / "pack.json").write_text(json.dumps(pack))
    code, text = run("pack", "import", tmp_path / "pack.json")
    assert code == 0 and sorted(json.loads(text)) == [["min_pages", 3, 4], ["threshold", 0, 2]]
    assert run("ignored", "list")[1] == "0000000000000007\t1\tleft\n"
    assert run("ignored", "forget", "12")[0] == 2 and run("ignored", "forget", "0000000000000007")[0] == 0 and run("ignored", "list") == (0, "")
    assert run("known", "list")[1] and run("known", "clear")[0] == 0 and run("known", "list") == (0, "") and run("ignored", "clear")[0] == 0
    code, text = run("history", "restore", 1)
    assert code == 0 and text.count("restored") == 3
    assert run("history", "list")[1].strip().split("\t")[3] == "0"
    (shelf / "old.cbz.bak").write_text("x")
    assert run("history", "sweep", shelf)[1].split() == ["1", "1"] and sorted(os.listdir(shelf)) == ["b0.cbz", "b1.cbz", "b2.cbz"]


def test_store_of_a_cluster(spark):
    from types import SimpleNamespace

    from leafsieve.__main__ import Store

    cluster = SimpleNamespace(sparkContext=SimpleNamespace(master="spark://host:7077"))
    with pytest.raises(ValueError, match="shared"):
        Store(cluster, "/home/me/.leafsieve")
    assert Store(cluster, "hdfs://there/store/").folder == "hdfs://there/store"
    with pytest.raises(ValueError, match="mounted"):
        Store(cluster, "hdfs://there/store").journal("run")
