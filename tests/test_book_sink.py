"""Plans that are claimed: killed tasks, attempts that meet, runs that go on."""

import hashlib
import json
import multiprocessing
import os
import threading
import time
import zipfile

import pytest
from tests.test_books_on_disk import book, picture

from leafsieve.plans import apply
from leafsieve.sources import book_sink


def plan(path, name="p1.png"):
    with zipfile.ZipFile(path) as z:
        return [{"name": n, "content_sha": hashlib.sha256(z.read(n)).hexdigest()} for n in z.namelist() if n.endswith(name)]


@pytest.fixture
def one(tmp_path):
    path = tmp_path / "b.cbz"
    book(path, [picture(k) for k in range(4)])
    with zipfile.ZipFile(path) as z:
        name = sorted(z.namelist())[1]
    os.makedirs(tmp_path / "journal")
    return str(path), plan(path, name), str(tmp_path / "journal")


def pages(path):
    with zipfile.ZipFile(path) as z:
        return sum(n.endswith(".png") for n in z.namelist())


def die_at(step, archive, removed, journal):
    """Runs a plan and ends the process at a step, as a lost executor does."""
    if step == "aside":  # the book is moved aside, and not replaced
        apply.os.replace = lambda a, b, real=os.replace: os._exit(9) if b.endswith(".cbz") else real(a, b)
    elif step == "replaced":  # the book is replaced, and nothing is noted
        real_write = book_sink._write
        book_sink._write = lambda path, what: os._exit(9) if path.endswith(".json") else real_write(path, what)
    elif step == "before":
        apply._rebuild = lambda *a: os._exit(9)
    book_sink.carry_out_once(archive, removed, apply.Policy(), journal)


@pytest.mark.parametrize("step", ["before", "aside", "replaced"])
def test_a_task_that_dies(one, step):
    archive, removed, journal = one
    child = multiprocessing.get_context("fork").Process(target=die_at, args=(step, archive, removed, journal))
    child.start()
    child.join()
    assert child.exitcode == 9 and [n for n in os.listdir(journal) if n.endswith(".claim")]
    assert os.path.exists(archive) == (step != "aside")
    done = book_sink.carry_out_once(archive, removed, apply.Policy(), journal)
    assert done["error"] is None and done["removed"] == 1 and pages(archive) == 3 and pages(done["backup"]) == 4
    folder = os.path.dirname(archive)
    assert sorted(os.listdir(folder)) == ["b.cbz", "b.cbz.bak", "journal"]  # one backup, no remains
    assert [n.rpartition(".")[2] for n in os.listdir(journal)] == ["json"]


def test_attempts_that_meet(one, monkeypatch):
    """Of two attempts at once one works and the other waits for its result."""
    archive, removed, journal = one
    worked, real = [], apply.carry_out

    def slow(*args):
        worked.append(args[0])
        time.sleep(1)
        return real(*args)

    monkeypatch.setattr(apply, "carry_out", slow)
    results = []
    threads = [threading.Thread(target=lambda: results.append(book_sink.carry_out_once(archive, removed, apply.Policy(), journal))) for _ in range(4)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert worked == [archive] and len(results) == 4 and all(r == results[0] for r in results) and results[0]["removed"] == 1


def test_claims_of_other_machines(one, monkeypatch):
    """A claim that is kept fresh is waited for, one that is not is taken over."""
    archive, removed, journal = one
    claim = os.path.join(journal, f"{apply.plan_key(archive, removed)}.claim")
    with open(claim, "w", encoding="utf-8") as file:
        json.dump({"host": "elsewhere", "pid": 1, "started": "1", "token": "t"}, file)
    monkeypatch.setattr(book_sink, "LEASE", 1.5)
    began = time.time()
    beats = threading.Thread(target=lambda: [(time.sleep(0.4), os.path.exists(claim) and os.utime(claim)) for _ in range(5)])
    beats.start()
    done = book_sink.carry_out_once(archive, removed, apply.Policy(), journal)
    beats.join()
    assert done["removed"] == 1 and time.time() - began > 2.5


def test_sink(spark, one, tmp_path):
    """Results come from the commit; a run that is called again carries nothing out; a plan that fails leaves its book."""
    archive, removed, journal = one
    rows = [(archive, removed), (str(tmp_path / "missing.cbz"), removed), (archive.replace("b.cbz", "none.cbz"), [])]
    plans = spark.createDataFrame(rows, "archive string, removed array<struct<name: string, content_sha: string>>")
    first = {r.archive: r for r in apply.apply_removals(plans, apply.Policy(), journal).collect()}
    assert first[archive].removed == 1 and first[rows[1][0]].error and first[rows[2][0]].skipped and pages(archive) == 3
    with open(os.path.join(journal, book_sink.COMMITTED), encoding="utf-8") as file:
        committed = json.load(file)
    assert committed["books"] == 3 and set(committed["files"]) <= set(os.listdir(os.path.join(journal, book_sink.FILES)))
    assert {r.archive: r for r in apply.apply_removals(plans, apply.Policy(), journal).collect()} == first
    assert sorted(n for n in os.listdir(tmp_path) if n.startswith("b.")) == ["b.cbz", "b.cbz.bak"]
    assert apply.apply_removals(plans.limit(0), apply.Policy(), str(tmp_path / "empty")).count() == 0
    writer = book_sink._Writer({"journal": journal, "policy": json.dumps(apply.asdict(apply.Policy()))})
    message = writer.write(iter([]))
    writer.abort([message, None])
    assert message.file not in os.listdir(os.path.join(journal, book_sink.FILES)) and pages(archive) == 3
