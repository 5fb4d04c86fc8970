import hashlib
import random

import numpy as np
import pyarrow as pa
from tests.llm.fixtures import small, table

from leafsieve.llm import suffix_dedup
from leafsieve.llm.queries import op2_suffix_dedup
from leafsieve.llm.suffix_dedup import refine, remove_repeats


def brute(texts, length=100):
    """{id: (bytes, removed, spans, kept)} of {id: text}, by a table of all windows."""
    seen, out = set(), {}
    for i in sorted(texts):
        data = (texts[i] or "").encode()
        gone = np.zeros(len(data), dtype=bool)
        for at in range(len(data) - length + 1):
            window = data[at : at + length]
            if window in seen:
                gone[at : at + length] = True
            seen.add(window)
        kept = np.frombuffer(data, dtype=np.uint8)[~gone].tobytes()
        spans = int(np.count_nonzero(np.diff(np.concatenate(([0], gone.astype(int)))) == 1))
        out[i] = len(data), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()
    return out


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def texts(seed=3):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    line, passage = prose(30), prose(80)
    out = [None, "", "short", "x" * 99, "x" * 100, "x" * 101, "y" * 5000, "ab" * 400, "abc" * 300 + "d" + "abc" * 300, prose(4000)]
    out += [prose(rng.randint(0, 60)) + line + prose(rng.randint(0, 60)) for _ in range(60)]
    out += [prose(5) + passage[rng.randint(0, 40) :] + prose(5) for _ in range(20)]
    base = prose(200)
    for _ in range(20):
        k = rng.randrange(len(base))
        out.append(base[:k] + rng.choice("xyz") + base[k + rng.randint(0, 2) :])
    out += [prose(50) + p for p in (out[-1], out[12])] * 2
    rng.shuffle(out)
    return out


def test_refine_tells_suffixes_apart():
    rng = random.Random(1)
    for length in (8, 9, 16, 31, 100):
        parts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 300))) for _ in range(12)] + [b"a" * 250, b"a" * 130]
        parts += [parts[0], parts[3][1:]]
        data = np.frombuffer(b"".join(parts), dtype=np.uint8)
        room = np.concatenate([np.arange(len(p), 0, -1) for p in parts])
        pointer, seen = refine(data, room, length), {}
        for at in range(len(data)):
            if room[at] < length:
                assert pointer[at] == -1
            else:
                assert seen.setdefault(pointer[at], data[at : at + length].tobytes()) == data[at : at + length].tobytes()
        assert len(seen) == len(set(seen.values()))


def test_equals_brute_force(spark, monkeypatch):
    for seed in (3, 4):
        case = texts(seed)
        assert rows(remove_repeats(table(spark, case).repartition(3))) == brute(dict(enumerate(case)))


def test_frequent_anchors_and_small_batches(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST", 2)  # anchors with two rows count as frequent
    case = texts(5)
    assert rows(remove_repeats(table(spark, case).repartition(5))) == brute(dict(enumerate(case)))


def in_one_process(case, size, sliced=False, split=False):
    """Removed bytes of each text by the steps without Spark; ``sliced``: all anchors count as large, ``split``: all slices go a round further."""
    ids = np.arange(len(case))
    anchors = pa.concat_tables([pa.Table.from_batches([suffix_dedup._scan(ids[k : k + 9], case[k : k + 9])]) for k in range(0, len(case), 9)])
    marks = anchors.filter(anchors["h"].is_null()).to_pylist()
    rest = anchors.filter(anchors["h"].is_valid()).sort_by("h").combine_chunks()
    dealt = [r for b in suffix_dedup._deal(iter(rest.to_batches(max_chunksize=size))) for r in b.to_pylist()]
    runs = {}
    for r in rest.to_pylist() if sliced else dealt:
        runs.setdefault(r["doc"], []).append({**r, "fate": suffix_dedup.SLICED} if sliced else r)
    kind = pa.struct([("at", pa.int64()), ("n", pa.int64()), ("lead", pa.int64()), ("h", pa.int64()), ("fate", pa.int64())])
    cut_in = pa.RecordBatch.from_pylist(
        [{"doc": d, "text": case[d].decode(), "runs": held} for d, held in runs.items()], schema=pa.schema([("doc", pa.int64()), ("text", pa.string()), ("runs", pa.list_(kind))])
    )
    pieces = pa.Table.from_batches(suffix_dedup._cut(iter([cut_in])), schema=suffix_dedup._PIECES)
    if split:
        open_ = pieces.filter(pieces["payload"].is_valid())
        pieces = pa.concat_tables([pieces.filter(pieces["payload"].is_null()), pa.Table.from_batches(suffix_dedup._windows(iter(open_.combine_chunks().to_batches(max_chunksize=size))), schema=suffix_dedup._PIECES)])
    marks += pieces.filter(pieces["payload"].is_null()).to_pylist()
    pieces = pieces.filter(pieces["payload"].is_valid()).sort_by("key").combine_chunks()
    marks += [r for b in suffix_dedup._grouped(iter(pieces.to_batches(max_chunksize=size * 3))) for r in b.to_pylist()]
    gone = [np.zeros(len(t), dtype=bool) for t in case]
    for r in marks:
        gone[r["doc"]][r["at"] : r["at"] + r["n"] + 99] = True
    return [int(g.sum()) for g in gone], dealt


def test_stretches_and_batches_in_one_process(monkeypatch):
    """The steps without Spark, with stretches, batches and slices so small that every border is met."""
    case = [(t or "").encode() for t in texts(6)]
    want = brute({i: t.decode() for i, t in enumerate(case)})
    monkeypatch.setattr(suffix_dedup, "SCAN", 700)
    monkeypatch.setattr(suffix_dedup, "BATCH", 4000)
    for size in (1, 7, 100_000):
        for group in (4096, 3):
            monkeypatch.setattr(suffix_dedup, "GROUP", group)
            for sliced, split in ((False, False), (True, False), (True, True)):
                got, dealt = in_one_process(case, size, sliced, split)
                assert got == [want[i][1] for i in range(len(case))]
                assert any(r["fate"] == suffix_dedup.SLICED for r in dealt) == (group == 3)


def test_same_strings():
    rng = random.Random(8)
    parts = [bytes(rng.choice(b"ab\0") for _ in range(rng.choice([0, 1, 7, 8, 9, 100, 101, 300]))) for _ in range(300)] + [b"a" * 100, b"a" * 101, b"a" * 100, b"a" * 100 + b"\0"]
    data, begins, sizes = suffix_dedup._strings(parts)
    pointer = suffix_dedup.same_strings(data, begins, sizes).tolist()
    assert len(set(zip(pointer, parts, strict=True))) == len(set(pointer)) == len(set(parts))


def test_all_removal_comes_through_refinement(spark, monkeypatch):
    """Without what refinement finds nothing is settled: no digest decides."""
    none = np.zeros(0, dtype=np.int64)
    monkeypatch.setattr(suffix_dedup, "repeats", lambda *a: (none, none, none))
    case = [(t or "").encode() for t in texts(6)]
    assert sum(in_one_process(case, 1000)[0]) == sum(in_one_process(case, 1000, sliced=True, split=True)[0]) == 0


def test_equal_digests_settle_nothing(monkeypatch):
    """Whatever the digests are, only equal bytes go."""
    case = [(t or "").encode() for t in texts(7)]
    want = brute({i: t.decode() for i, t in enumerate(case)})
    monkeypatch.setattr(suffix_dedup.xxhash, "xxh3_64_intdigest", lambda *a: 5)
    monkeypatch.setattr(suffix_dedup, "GROUP", 2)
    assert in_one_process(case, 1000)[0] == in_one_process(case, 1000, sliced=True, split=True)[0] == [want[i][1] for i in range(len(case))]


def test_a_hot_key_is_held_as_its_first_windows(monkeypatch):
    """One passage in 100,000 texts: under a key only what is first stays between batches."""
    most = 0
    plain = suffix_dedup._equal_windows

    def watched(table):
        nonlocal most
        most = max(most, table.column("payload").nbytes)
        return plain(table)

    monkeypatch.setattr(suffix_dedup, "_equal_windows", watched)
    monkeypatch.setattr(suffix_dedup, "BATCH", 1 << 18)
    rng = random.Random(4)
    passage = bytes(rng.randrange(256) for _ in range(100))
    rows = pa.table({"key": pa.array(np.full(100_000, 7)), "payload": pa.array([passage] * 100_000, pa.binary()), "doc": pa.array(np.arange(100_000)[::-1]), "at": pa.array(np.full(100_000, 3)), "n": pa.array(np.full(100_000, 1)), "sliced": pa.array([True] * 100_000)}).cast(suffix_dedup._PIECES)
    marks = pa.Table.from_batches(suffix_dedup._grouped(iter(rows.to_batches(max_chunksize=1000))), schema=suffix_dedup._MARKS)
    assert set(marks["doc"].to_pylist()) == set(range(1, 100_000)) and most < 1 << 20
    anchors = pa.table({"h": pa.array(np.full(100_000, 7)), "doc": pa.array(np.arange(100_000)), "at": pa.array(np.zeros(100_000)), "n": pa.array(np.ones(100_000)), "lead": pa.array(np.zeros(100_000))}).cast(suffix_dedup._ANCHORS)
    fates = [b for b in suffix_dedup._deal(iter(anchors.to_batches(max_chunksize=1000)))]
    assert sum(b.num_rows for b in fates) == 100_000 and max(b.num_rows for b in fates) <= 5096


def test_frequent_slices_go_a_round_further(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "LEAST", 2)
    rng = random.Random(9)
    passage = " ".join(str(rng.random()) for _ in range(20))
    case = [f"{rng.random()} {passage} {rng.random()}" for _ in range(40)]
    assert rows(remove_repeats(table(spark, case).repartition(8))) == brute(dict(enumerate(case)))


def test_edges(spark):
    assert remove_repeats(table(spark, ["x"]).limit(0)).count() == 0
    twice = table(spark, ["a b " * 100, "a b " * 100])
    twice = twice.unionByName(twice)
    got = sorted((r.doc_id, r.n_removed, r.n_bytes) for r in remove_repeats(twice).collect())
    want = brute({0: "a b " * 100, 1: "a b " * 100})
    assert got == sorted((i, want[i][1], 400) for i in (0, 0, 1, 1))
    nulls = twice.limit(1).selectExpr("cast(null as long) doc_id", "text").unionByName(table(spark, ["q" * 50 + "a b " * 100]).select("doc_id", "text"))
    assert {r.doc_id: bytes(r.kept) for r in remove_repeats(nulls).collect()}[None] == b""


def test_query_equals_brute_force(spark):
    case = {r.doc_id: r.text for r in small(spark).collect()}
    assert rows(op2_suffix_dedup(spark, "/root/testdata/sf0.001")) == brute(case)
