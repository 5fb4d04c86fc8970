import io
import json
import os

from tests.test_books_on_disk import book, picture

from leafsieve.__main__ import main


def test_scan_clean_known_history_pack(spark, tmp_path):
    shelf, store = tmp_path / "shelf", str(tmp_path / "store")
    shelf.mkdir()
    advert = picture(99)
    for k in range(3):
        pages = [picture(10 * k + i) for i in range(5)]
        pages[1] = advert
        book(shelf / f"b{k}.cbz", pages)

    def run(*args):
        out = io.StringIO()
        code = main(["--store", store, *map(str, args)], spark, out)
        return code, out.getvalue()

    code, text = run("scan", shelf)
    (group,) = json.loads(text)["groups"]
    assert code == 0 and group["copies"] == 3 and group["kind"] == "identical"
    assert run("scan", tmp_path / "nowhere")[0] == 2 and run("clean", shelf)[0] == 2 and run("clean", shelf, "--all")[0] == 2
    assert run("clean", shelf, "--group", "zz", "--dry-run")[0] == 2 and run("scan", shelf, "--threshold", 99)[0] == 2
    code, text = run("clean", shelf, "--group", group["id"][:6], "--dry-run", "--max-fraction", 0.1)
    assert code == 0 and json.loads(text)["removed"] == 0 and sum(json.loads(text)["skipped"].values()) == 3
    code, text = run("clean", shelf, "--all", "--yes", "--protect", shelf / "b2.cbz")
    report = json.loads(text)
    assert code == 0 and report["removed"] == 2 and report["remembered"] == 1 and len(report["results"]) == 2 and report["library"]["archives"] == 3
    assert sorted(os.listdir(shelf)) == ["b0.cbz", "b0.cbz.bak", "b1.cbz", "b1.cbz.bak", "b2.cbz"]
    # One copy is left: it is known now.
    code, text = run("scan", shelf)
    (left,) = json.loads(text)["groups"]
    assert left["known"] and left["copies"] == 1
    assert run("known", "list")[1].count("\n") == 1
    assert run("known", "export", tmp_path / "list.json")[0] == 0 and run("pack", "export", tmp_path / "pack.json")[0] == 0
    assert run("known", "forget", group["id"])[0] == 0 and run("known", "list")[1] == ""
    assert run("known", "import", tmp_path / "list.json")[0] == 0 and "imported" in run("known", "list")[1]
    assert run("pack", "import", tmp_path / "pack.json")[0] == 0
    code, text = run("history", "list")
    assert text.split("\t")[:2] == ["1", "2"] and text.strip().split("\t")[3] == "2"
    assert run("history", "pin", 1)[0] == 0 and run("history", "clean", 1)[1].split() == ["0", "0"] and run("history", "unpin", 1)[0] == 0
    code, text = run("history", "restore", 1)
    assert code == 0 and text.count("restored") == 2 and sorted(os.listdir(shelf)) == ["b0.cbz", "b1.cbz", "b2.cbz"]
