import io
import json
import os
import random
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from leafsieve.functions import comicinfo, imaging
from leafsieve.operators import incremental
from leafsieve.operators.groups import build_groups
from leafsieve.operators.removal import build_plans, pages_to_remove
from leafsieve.options import GroupingOptions, check_run, matching_preset
from leafsieve.plans import apply
from leafsieve.plans.reports import group_documents
from leafsieve.plans.scan import scan
from leafsieve.sources import archives, known_list


def picture(seed, scale=1, noise=0):
    rng = random.Random(seed)
    out = np.full((90 * scale, 60 * scale, 3), 250, dtype=np.uint8)
    for _ in range(18):
        x, y, w, h = rng.randrange(50), rng.randrange(80), rng.randint(5, 30), rng.randint(5, 30)
        out[y * scale : (y + h) * scale, x * scale : (x + w) * scale] = [rng.randrange(256) for _ in range(3)]
    if noise:
        out = np.clip(out.astype(int) + np.random.default_rng(seed).integers(-noise, noise + 1, out.shape), 0, 255).astype(np.uint8)
    return imaging.encode_png(out)


INFO = (
    '<?xml version="1.0"?><ComicInfo><Series> Saga </Series><Number>12</Number><PageCount>5</PageCount><Pages><Page Image="0"/><Page Image="1"/>'
    '<Page Image="4"/><Page Type="x"/></Pages></ComicInfo>'
)


def book(path, pages, info=None):
    with zipfile.ZipFile(path, "w") as out:
        for i, data in enumerate(pages):
            out.writestr(f"page{i + 1}.png", data)
        if info:
            out.writestr("ComicInfo.xml", info)
    return str(path)


@pytest.fixture
def library(tmp_path):
    """Three books of five pages; page 2 is the same in all, in the third with noise."""
    advert, noisy = picture(99), picture(99, noise=24)  # 3 bits apart
    for k, ad in enumerate((advert, advert, noisy)):
        pages = [picture(10 * k + i) for i in range(5)]
        pages[1] = ad
        book(tmp_path / f"book{k}.cbz", pages, INFO if k == 0 else None)
    (tmp_path / "broken.cbz").write_bytes(b"PK not a zip")
    (tmp_path / "notes.pdf").write_bytes(b"")
    (tmp_path / "plain.rar").write_bytes(b"")
    return tmp_path


def test_survey(spark, library):
    got = {os.path.basename(r.archive): r.disposition for r in archives.survey(spark, [str(library)], exclude=["*book2*"]).collect()}
    assert got == {"book0.cbz": "found", "book1.cbz": "found", "book2.cbz": "excluded", "broken.cbz": "found", "notes.pdf": "pdf", "plain.rar": "not_walked"}
    named = archives.survey(spark, [str(library / "plain.rar"), str(library)])
    assert {r.disposition for r in named.where("archive like '%plain.rar'").collect()} == {"found"}
    assert archives.survey_counts(named).count() == 2


def test_fingerprints_stand_small_changes():
    one, _ = imaging.fingerprint(imaging.decode(picture(5)))
    noisy, flat = imaging.fingerprint(imaging.decode(picture(5, noise=3)))
    large, _ = imaging.fingerprint(imaging.decode(picture(5, scale=3)))
    other, _ = imaging.fingerprint(imaging.decode(picture(6)))
    assert (one ^ noisy).bit_count() <= 4 and (one ^ large).bit_count() <= 6 and (one ^ other).bit_count() > 10 and not flat
    assert imaging.fingerprint(np.full((50, 40, 3), 128, dtype=np.uint8))[1]
    assert imaging.difference(picture(5), picture(5)) == 0 and imaging.difference(picture(5), picture(6, scale=2)) > 0.1
    assert max(imaging.decode(imaging.thumbnail(picture(5, scale=5), 100)).shape[:2]) == 100
    assert imaging.decode(b"P5 2 1 255\n\x01\x02").tolist() == [[[1], [2]]]
    with pytest.raises(imaging.DecodeError):
        imaging.decode(b"RIFF....WEBP")


def test_png_filters():
    import struct
    import zlib

    rng = np.random.default_rng(1)
    pixels = rng.integers(0, 256, (6, 5, 3), dtype=np.uint8)
    raw, before = b"", np.zeros(15, dtype=int)
    for y, row in enumerate(pixels.reshape(6, 15).astype(int)):
        left = np.concatenate((np.zeros(3, dtype=int), row[:-3]))
        corner = np.concatenate((np.zeros(3, dtype=int), before[:-3]))
        p = left + before - corner
        paeth = [min((abs(q - a), k, a) for k, a in enumerate((x, b, c)))[2] for q, x, b, c in zip(p, left, before, corner)]
        guess = [0 * row, left, before, (left + before) // 2, np.array(paeth)][y % 5]
        raw += bytes([y % 5]) + ((row - guess) % 256).astype(np.uint8).tobytes()
        before = row
    whole = imaging.encode_png(pixels)
    at = whole.index(b"IDAT") - 4
    body = zlib.compress(raw)
    data = whole[:at] + struct.pack(">I", len(body)) + b"IDAT" + body + b"\0\0\0\0" + whole[-12:]
    assert (imaging.decode(data) == pixels).all()


def test_scan_group_plan_apply_restore(spark, library, tmp_path):
    books, pages = scan(spark, [str(library)])
    rows = {os.path.basename(r.archive): r for r in books.collect()}
    assert rows["book0.cbz"].series == "Saga" and rows["book0.cbz"].number == "12" and rows["book0.cbz"].page_count == 5
    assert rows["broken.cbz"].error and rows["broken.cbz"].page_count == 0
    exact = build_groups(pages, books).groups.collect()
    assert [(g.kind, g.archive_count, g.page_count) for g in exact] == [("exact", 2, 2)]
    made = build_groups(pages, books, GroupingOptions(threshold=8))
    (group,) = made.groups.collect()
    assert (group.kind, group.archive_count) == ("similar", 3)
    document = json.loads(group_documents(made.groups, made.members).first().document)
    assert document["copies"] == 3 and [p["page"] for p in document["pages"]] == [2, 2, 2]
    plans = build_plans(pages_to_remove(made.members, made.groups.selectExpr("gid", "'delete' as decision")), books)
    dry = apply.apply_removals(plans, apply.Policy(dry_run=True), str(tmp_path / "journal"))
    assert {(r.removed, r.error) for r in dry.collect()} == {(1, None)}
    before = {p: (library / p).read_bytes() for p in ("book0.cbz", "book1.cbz")}
    policy = apply.Policy(quarantine=str(tmp_path / "q"))
    done = apply.apply_removals(plans, policy, str(tmp_path / "journal"))
    assert {(r.removed, r.error, len(r.quarantined)) for r in done.collect()} == {(1, None, 1)}
    with zipfile.ZipFile(library / "book0.cbz") as cleaned:
        assert cleaned.namelist() == ["page1.png", "page3.png", "page4.png", "page5.png", "ComicInfo.xml"]
        info = cleaned.read("ComicInfo.xml").decode()
    assert "<PageCount>4</PageCount>" in info and 'Image="3"' in info and 'Image="1"' not in info
    # Once more: the journal gives the same results, and nothing is done twice.
    again = apply.apply_removals(plans, policy, str(tmp_path / "journal"))
    assert sorted(r.backup for r in again.collect()) == sorted(r.backup for r in done.collect())
    # Without the journal the books are no longer as they were scanned.
    late = apply.apply_removals(plans, policy, str(tmp_path / "other"))
    assert all("changed since" in r.error for r in late.collect())
    # A second scan reads the changed books only.
    again_books, again_pages = scan(spark, [str(library)], cached=(books, pages))
    assert again_pages.where("archive like '%book%'").count() == 12
    # A book that has moved is not read again, and one with pages of other decoders is.
    (library / "sub").mkdir()
    os.rename(library / "book2.cbz", library / "sub" / "book2.cbz")
    marked = again_pages.withColumn("dhash", F.lit(7).cast("long"))
    bad = F.col("archive").endswith("book1.cbz") & (F.col("index") == 0)
    marked = marked.withColumns({"error": F.when(bad, "old decoder").otherwise(F.col("error")), "codecs": F.when(bad, "other").otherwise(F.col("codecs"))})
    third_books, third_pages = scan(spark, [str(library)], cached=(again_books, marked))
    got = {r.archive.removeprefix(f"{library}/"): r.n for r in third_pages.groupBy("archive").agg(F.count_if(F.col("dhash") == 7).alias("n")).collect()}
    assert got == {"book0.cbz": 4, "book1.cbz": 0, "sub/book2.cbz": 4} and third_books.count() == 4
    put = incremental.put(third_pages, third_pages.where("archive like '%book0.cbz'").withColumn("size", F.lit(1).cast("long")))
    assert put.count() == 12 and put.where("size = 1").count() == 4
    item = next(r.asDict() for r in done.collect() if r.archive.endswith("book1.cbz"))
    assert apply.restore(item, "can be restored") is None and (library / "book1.cbz").read_bytes() == before["book1.cbz"]


def test_failures_leave_the_book(tmp_path):
    path = book(tmp_path / "a.cbz", [picture(1), picture(2)])
    with zipfile.ZipFile(path) as z:
        sha = {n: __import__("hashlib").sha256(z.read(n)).hexdigest() for n in z.namelist()}
    before = open(path, "rb").read()
    all_pages = [{"name": n, "content_sha": s, "index": 0} for n, s in sha.items()]
    for removed, text in (
        (all_pages, "no page"), ([{"name": "gone.png", "content_sha": "x"}], "not there"), ([{"name": "page1.png", "content_sha": ""}], "no digest"),
        ([{"name": "page1.png", "content_sha": "0" * 64}], "another page"),
    ):
        assert text in apply.carry_out(path, removed, apply.Policy(), "k").error
    assert apply.carry_out(path, [], apply.Policy(), "k").skipped
    out = tmp_path / "out"
    out.mkdir()
    (out / "a.cbz").write_bytes(b"x")
    assert "there already" in apply.carry_out(path, all_pages[:1], apply.Policy(output_dir=str(out)), "k").error
    assert open(path, "rb").read() == before and sorted(os.listdir(tmp_path)) == ["a.cbz", "out"]


def test_recovery(tmp_path):
    original, backup = tmp_path / "a.cbz", tmp_path / "a.cbz.bak"
    backup.write_bytes(b"book")
    marker = tmp_path / f"{apply.TEMP_PREFIX}k{apply.PENDING}"
    marker.write_text(json.dumps({"original": str(original), "output": str(original), "backup": str(backup), "temp": str(tmp_path / f"{apply.TEMP_PREFIX}k.cbz"), "pid": 2**22 + 5}))
    assert apply.recover([str(tmp_path)], dry_run=True) == [(str(original), str(backup), True)] and not original.exists()
    assert apply.recover([str(tmp_path)]) == [(str(original), str(backup), True)]
    assert original.read_bytes() == b"book" and not marker.exists() and apply.recover([str(tmp_path)]) == []


def test_comicinfo_update():
    rows = "".join(f'<Page Image="{i}"/>' for i in (0, 3, 7)) + "<Page/>"
    out = comicinfo.update(f'<c:ComicInfo xmlns:c="urn:x"><c:Pages>{rows}</c:Pages></c:ComicInfo>'.encode(), {3, 4}, 8).decode()
    assert 'Image="0"' in out and 'Image="5"' in out and 'Image="3"' not in out and "<c:PageCount>8</c:PageCount>" in out and 'xmlns:c="urn:x"' in out
    assert comicinfo.update(b"<broken", {1}, 2) == b"<broken"


def test_comicinfo_odd_documents():
    """Numbers that are none stay as they are; what is not touched stays byte for byte."""
    out = comicinfo.update(
        b"""<?xml version='1.0' encoding='utf-16'?><ComicInfo><!-- <Page Image="9"/> --><Pages><Page Image="--5"/><Page Image='+-1'/><Page Image=" 6 " Type='a>b'>x<!--c--></Page>"""
        b"""<Page	Image = '2' Key="k"/><Bookmark Image="1"/></Pages><PageCount/><Pages><Page Image="2"/></Pages></ComicInfo>""", {2}, 5,
    )
    assert out == (
        b"""<?xml version="1.0" encoding="utf-8"?>\n<ComicInfo><!-- <Page Image="9"/> --><Pages><Page Image="--5"/><Page Image='+-1'/><Page Image="5" Type='a>b'>x<!--c--></Page>"""
        b"""<Bookmark Image="1"/></Pages><PageCount>5</PageCount><Pages><Page Image="2"/></Pages></ComicInfo>"""
    )
    assert comicinfo.update(b"<a><Pages/></a>", set(), 3).endswith(b"<a><Pages/><PageCount>3</PageCount></a>")
    assert comicinfo.update("\ufeff<a><PageCount>é<b/></PageCount></a>".encode(), {1}, 3).endswith(b"<a><PageCount>3</PageCount></a>")
    assert comicinfo.update(b"<a/>", {1}, 3).endswith(b"<a/>")


def test_filters():
    """Weights sum to one, a plane of one value stays, and sides of other filters are as computed by hand."""
    for size, cells in ((60, 9), (9, 9), (5, 9), (400, 32)):
        for kind in (imaging.BILINEAR, imaging.LANCZOS):
            assert np.abs(imaging._weights(size, cells, kind).sum(axis=1) - (1 << 22)).max() <= size
            assert (imaging.shrink(np.full((size, size), 77), cells, cells, kind) == 77).all()
    # Half the size, triangle of reach two: weights 1/8 3/8 3/8 1/8, cut at the ends to 3/7 3/7 1/7.
    assert imaging.shrink(np.array([[0, 70, 140, 210]]), 2, 1, imaging.BILINEAR).tolist() == [[50, 160]]
    ramp = np.arange(0, 256, 4)[None, :].repeat(8, axis=0)
    assert (np.diff(imaging.shrink(ramp, 9, 8)[0]) > 0).all()
    assert imaging.grey(np.array([[[255, 0, 0], [0, 255, 0], [0, 0, 255]]], dtype=np.uint8)).tolist() == [[76, 150, 29]]


def test_names_agree(spark):
    from leafsieve.functions.text import natural_key
    from leafsieve.operators.pages import is_page_name

    names = ["a10.jpg", "a9.jpg", "A09.jpg", "10.jpg", "9.jpg", "b", "a", ".x.jpg", "d/.jpg", "d\\p.PNG", "x/", "__MACOSX/a.jpg", "Thumbs.db", "p1²3.webp", "007.jpg", "7.jpg", "1" * 60 + ".gif"]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    assert {r.name for r in frame.where(is_page_name(F.col("name"))).collect()} == {n for n in names if apply.is_page(n)}
    got = [r.name for r in frame.orderBy(natural_key(F.col("name")), "name").collect()]
    assert got == sorted(names, key=lambda n: (apply.natural(n), n))
    assert apply.safe_name("a/b<c>.png ") == "b_c_.png" and apply.safe_name("..") == "page"


def test_known_lists(spark, tmp_path):
    entry = {"id": "forged", "note": "n", "tags": None, "hashes": ["f" * 16, "0" * 15 + "1"], "thumbnail": "???"}
    good = {"format": known_list.LIST_FORMAT, "version": 1, "entries": [entry]}

    def file(payload):
        path = tmp_path / "list.json"
        path.write_text(payload if isinstance(payload, str) else json.dumps(payload))
        return str(path)

    (row,) = known_list.read_known(spark, file(good)).collect()
    assert row.sid == "0" * 15 + "1" and row.hashes == [1, -1] and row.thumbnail is None and row.source == "imported"
    for bad in ("no json", "[]", good | {"format": "x"}, good | {"version": 2}, good | {"entries": None}, good | {"entries": [entry, {}]},
                good | {"entries": [entry | {"hashes": ["0x" + "1" * 13 + "g"]}]}, good | {"version": True}, good | {"entries": [entry | {"hashes": [5]}]}, good | {"entries": [entry | {"hashes": []}]}):
        with pytest.raises(known_list.ListError):
            known_list.read_known(spark, file(bad))
    known = spark.createDataFrame([("0" * 15 + "1", "n", "", None)], "sid string, note string, tags string, thumbnail binary")
    hashes = spark.createDataFrame([("0" * 15 + "1", 1), ("0" * 15 + "1", -1)], "sid string, dhash long")
    ignored = spark.createDataFrame([("0" * 15 + "2", "i", ["0" * 15 + "2"])], "gid string, note string, hashes array<string>")
    known_list.write_known(known, hashes, str(tmp_path / "out.json"))
    assert known_list.read_known(spark, str(tmp_path / "out.json")).first().hashes == [1, -1]
    known_list.write_pack(known, hashes, ignored, {"threshold": 4, "other": 1}, str(tmp_path / "pack.json"))
    settings, entries, left = known_list.read_pack(spark, str(tmp_path / "pack.json"))
    assert settings == {"threshold": 4} and entries.count() == 1 and left.first().hashes == [2]
    assert known_list.setting_changes({"threshold": 0}, settings) == [("threshold", 0, 4)]


def test_options():
    assert matching_preset(GroupingOptions(threshold=6, edge_pages=5)) == "ads" and matching_preset(GroupingOptions(threshold=5)) is None
    for bad in ({"threshold": 17}, {"min_pages": 1}, {"edge_pages": 0}, {"min_archives": 0}):
        with pytest.raises(ValueError):
            GroupingOptions(**bad).check()
    check_run(1.0, known_only=True)
    for args in ((0, {"choose_all": True}), (0.5, {}), (0.5, {"choose_all": True, "known_only": True})):
        with pytest.raises(ValueError):
            check_run(args[0], **args[1])


def test_watch(spark, tmp_path):
    from leafsieve.streaming.watch import watch

    spark.createDataFrame([("a", 5), ("b", 99999), ("c", 7)], "name string, dhash long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("name string, dhash long").parquet(str(tmp_path / "in"))
    got = []
    query = watch(stream, spark.createDataFrame([(5,)], "dhash long"), 1, lambda df, n: got.extend(r.name for r in df.collect()), f"t{os.getpid()}")
    query.awaitTermination(60)
    assert sorted(got) == ["a", "c"]


def test_other_archives_by_a_tool(spark, tmp_path, monkeypatch):
    """A stand-in for an unpacking tool: what it unpacks is read, and what it ends badly on is an error."""
    tool = tmp_path / "7zz"
    tool.write_text("""#!/bin/sh
if [ "$1" = i ]; then echo "Codecs:"; echo "  LZMA"; exit 0; fi
for last; do :; done
python3 -c "import sys, zipfile; f = open(sys.argv[1], 'rb'); f.seek(8); zipfile.ZipFile(__import__('io').BytesIO(f.read())).extractall('.')" "$last" || exit 2
case "$last" in *half*) exit 1;; esac
""")
    tool.chmod(0o755)
    book(tmp_path / "inner.zip", [picture(1), picture(2)], INFO)
    inner = (tmp_path / "inner.zip").read_bytes()
    shelf = tmp_path / "shelf"
    shelf.mkdir()
    for name in ("a.cbr", "half.cbr"):
        (shelf / name).write_bytes(b"Rar!\x1a\x07\x01\x00" + inner)
    monkeypatch.setenv("LEAFSIEVE_EXTRACTOR", str(tool))
    rows = [archives.book_entries(str(shelf / "a.cbr")), archives.book_entries(str(shelf / "half.cbr"))]
    assert sorted(e[0] for e in rows[0]) == ["ComicInfo.xml", "page1.png", "page2.png"]
    with pytest.raises(RuntimeError, match="ended with 1"):
        list(rows[1])
    monkeypatch.delenv("LEAFSIEVE_EXTRACTOR")
    monkeypatch.setenv("PATH", str(tmp_path), prepend=os.pathsep)
    archives._reads_rar.cache_clear()
    assert archives.extractor("7z")[0] == str(tool) and (archives.extractor("rar") or [""])[0] != str(tool)


def test_space_and_cancel(spark, tmp_path):
    path = book(tmp_path / "a.cbz", [picture(1), picture(2)])
    plans = spark.createDataFrame([(path, [])], "archive string, removed array<struct<name: string, content_sha: string, index: int>>")
    looked = apply.look_at(plans)
    (row,) = looked.collect()
    assert row.size == os.path.getsize(path) and row.kind == "zip" and os.path.ismount(row.volume)
    assert apply.shortfall(plans, looked, apply.Policy()).count() == 0
    (short,) = apply.shortfall(plans, looked.withColumn("free", F.lit(3).cast("long")), apply.Policy()).collect()
    assert (short.needed, short.free) == (row.size, 3)
    journal = str(tmp_path / "journal")
    os.makedirs(journal)
    apply.cancel(journal)
    (done,) = apply.apply_removals(plans, apply.Policy(), journal).collect()
    assert done.skipped and "cancelled" in done.error and apply.progress(journal) == 0


def test_recovery_of_another_host(tmp_path):
    original, backup = tmp_path / "a.cbz", tmp_path / "a.cbz.bak"
    backup.write_bytes(b"book")
    marker = tmp_path / f"{apply.TEMP_PREFIX}k{apply.PENDING}"
    marker.write_text(json.dumps({"original": str(original), "output": str(original), "backup": str(backup), "temp": str(tmp_path / f"{apply.TEMP_PREFIX}k.cbz"), "pid": 2**22 + 5, "host": "elsewhere"}))
    assert apply.recover([str(tmp_path)]) == []
    os.utime(marker, (0, 0))
    assert apply.recover([str(tmp_path)]) == [(str(original), str(backup), True)] and original.read_bytes() == b"book"


def test_entries_of_a_store(spark, library):
    files = spark.read.format("binaryFile").load(f"{library}/book*.cbz")
    entries = archives.zip_entries_of(files)
    assert archives.page_entries(entries).count() == 15 and io.BytesIO(entries.first().content).read(4) == b"\x89PNG"
