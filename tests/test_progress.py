"""Progress while books are read, stopping from another thread, and reports in rows."""

import json
import threading
import time

import pytest
from pyspark.sql import functions as F
from tests.test_books_on_disk import book, picture

from leafsieve.operators import groups
from leafsieve.plans import reports, scan
from leafsieve.plans.progress import Cancelled, Watch, ticking


@pytest.fixture
def shelf(tmp_path):
    for k in range(12):
        book(tmp_path / f"b{k:02d}.cbz", [picture(99) if i == 1 else picture(10 * k + i) for i in range(4)])
    return tmp_path


def test_lines_while_scanning(spark, shelf, monkeypatch):
    monkeypatch.setattr(scan, "TASK_BYTES", 1 << 11)
    seen = []
    archives, _ = scan.scan(spark, [str(shelf)], watch=Watch(spark, seen.append, 0.05))
    assert archives.count() == 12 and len(seen) > 1
    last, size = seen[-1], sum(p.stat().st_size for p in shelf.iterdir())
    assert (last["books"], last["of"], last["bytes"], last["of_bytes"], last["eta"]) == (12, 12, size, size, 0.0)
    assert [s["books"] for s in seen] == sorted(s["books"] for s in seen) and max(s["of_tasks"] for s in seen) > 1


def test_stopped_from_another_thread(spark, shelf):
    """The scan ends soon, its jobs alone are cancelled, and another scan goes on."""

    def slow(count):
        def run(batches):
            import pandas as pd

            for batch in batches:
                for path in batch["archive"]:
                    time.sleep(1)
                    count(1)
                    yield pd.DataFrame([], columns=[c.split()[0] for c in scan._READ.split(", ")])

        return run

    watch, ended = Watch(spark), []
    before, scan._digest_books = scan._digest_books, slow

    def work():
        try:
            scan.scan(spark, [str(shelf)], watch=watch)
        except Cancelled as stopped:
            ended.append(stopped)

    try:
        thread = threading.Thread(target=work)
        thread.start()
        while not watch.total:
            time.sleep(0.05)
        time.sleep(1)
        began = time.time()
        watch.cancel()
        thread.join(30)
    finally:
        scan._digest_books = before
    assert ended and time.time() - began < 8
    with pytest.raises(Cancelled):
        scan.scan(spark, [str(shelf)], watch=watch)
    assert scan.scan(spark, [str(shelf)])[0].count() == 12


def test_ticking_tells_changes_and_the_end():
    values, told = iter([1, 1, 2, 2, 2]), []
    with ticking(lambda: {"n": next(values, 9)}, told.append, 0.02):
        time.sleep(0.09)
    assert [t["n"] for t in told] == sorted({t["n"] for t in told}) and told[-1]["n"] in (2, 9)


def test_reports_in_rows(spark, tmp_path):
    """The rows of all copies, put together, are the documents of the groups; files written by ranges say the same."""
    pages = spark.range(3000).select(
        F.concat(F.lit("B" + "o" * 3), F.col("id") % 37, F.lit('"\\.cbz')).alias("archive"), F.concat(F.lit("p"), "id").alias("name"), (F.col("id") % 11 + 1).cast("int").alias("index"),
        (F.col("id") % 90).alias("size"), F.lit(9).alias("width"), F.lit(9).alias("height"), F.sha2(F.col("id").cast("string").cast("binary"), 256).alias("content_sha"),
        F.when(F.col("id") < 2500, -5).otherwise(F.col("id") % 60).cast("long").alias("dhash"), F.lit(False).alias("flat"), F.lit(None).cast("string").alias("error"), F.lit(None).cast("string").alias("codecs"),
    )
    archives = pages.groupBy("archive").agg(F.lit(99).alias("page_count")).withColumn("error", F.lit(None).cast("string"))
    made = groups.build_groups(pages, archives)
    want = {r.gid: json.loads(r.document) for r in reports.group_documents(made.groups, made.members).collect()}
    text = "".join(r.text for r in reports.group_rows(made.groups, made.members).orderBy("position", "rank").collect())
    reports.write_group_report(made.groups, made.members, f"file://{tmp_path}/report")
    written = "".join(p.read_text() for p in sorted((tmp_path / "report").glob("part-*")))
    order = [r.gid for r in groups.sort_groups(made.groups).collect()]
    key = lambda p: (p["archive"].lower(), p["page"], p["name"])
    for given in (text, written):
        found, at, decoder = [], 0, json.JSONDecoder()
        while at < len(given):
            document, at = decoder.raw_decode(given, at)
            found.append(document)
            while at < len(given) and given[at] in "\n ":
                at += 1
        assert [d["id"] for d in found] == order and max(d["copies"] for d in found) == 2500
        for d in found:
            assert [key(p)[:2] for p in d["pages"]] == [key(p)[:2] for p in want[d["id"]]["pages"]]
            assert sorted(map(str, d["pages"])) == sorted(map(str, want[d["id"]]["pages"])) and {**d, "pages": 0} == {**want[d["id"]], "pages": 0}
