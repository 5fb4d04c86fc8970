import random
import re

import numpy as np
import xxhash
from tests.llm.fixtures import small, table

from leafsieve.llm import simhash
from leafsieve.llm.queries import op7_simhash
from leafsieve.llm.simhash import deal, fingerprint, keep_first, simhash_dedup, tree_links


def brute_print(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum((2 * sum(x >> b & 1 for x in h) > len(h)) << b for b in range(64))


def brute_components(ids, prints):
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, p in zip(ids, prints, strict=True):
        for y, q in zip(ids, prints, strict=True):
            if x < y and (p ^ q).bit_count() <= 4:
                a, b = find(x), find(y)
                root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint():
    cases = [None, "", " ", "One", "ÀB c", "a b c d", "a b c d e", "A b\x1cc d e f g " * 9, "x y " * 40_000, "tie one two three four five"]
    for c in cases:
        assert fingerprint((c or "").encode()) == brute_print(c)


def points(seed, n, near):
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(n)]
    for k in near:
        base = rng.getrandbits(64)
        for _ in range(k):
            p = base
            for b in rng.sample(range(64), rng.randint(0, 5)):
                p ^= 1 << b
            out.append(p)
    return sorted(set(out))


def test_trees_lose_no_component():
    for seed, n, near in ((1, 3000, [5] * 60), (2, 200, [1500]), (3, 0, [3, 2]), (4, 1, []), (5, 900, [600, 40])):
        prints = points(seed, n, near)
        fps = np.array(prints, dtype=np.uint64)
        links = np.concatenate([tree_links(fps, t) for t in range(3)])
        for x, y in links.tolist():
            assert (prints[x] ^ prints[y]).bit_count() <= 4
        want = brute_components(range(len(prints)), prints) if len(prints) < 2500 else None
        root = list(range(len(prints)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for x, y in links.tolist():
            a, b = find(x), find(y)
            root[max(a, b)] = min(a, b)
        if want:
            assert {i: find(i) for i in range(len(prints))} == want
        else:
            far = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
            assert all(find(x) == find(y) for x, y in zip(*np.nonzero(far), strict=True))


def test_shards_keep_every_close_pair_together(spark):
    prints = points(7, 150, [30, 10])
    signed = [int(np.uint64(p).view(np.int64)) for p in prints]
    rows = deal(spark.createDataFrame([(p, i) for i, p in enumerate(signed)], "fp long, rep long"), 5).collect()
    shards = {}
    for r in rows:
        shards.setdefault(r.rep, set()).add(r.shard)
    for x, p in enumerate(prints):
        for y, q in enumerate(prints):
            if (p ^ q).bit_count() <= 4:
                thirds = [t for t, (o, w) in enumerate(simhash.THIRDS) if (((p ^ q) >> o) & ((1 << w) - 1)).bit_count() <= 1]
                assert all(any(s % 3 == t for s in shards[x] & shards[y]) for t in thirds)
    assert len({s for v in shards.values() for s in v}) > 60


def test_documents(spark, monkeypatch):
    monkeypatch.setattr(simhash, "SHARD", 20)
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    base = [rng.choice(words) for _ in range(300)]
    texts = [None, "", " ", "short", "SHORT", "x " * 30_000]
    for _ in range(25):
        changed = list(base)
        for _ in range(rng.randint(0, 3)):
            changed[rng.randrange(300)] = rng.choice(words)
        texts.append(" ".join(changed))
    texts += [" ".join(rng.choice(words) for _ in range(30)) for _ in range(40)]
    got = {r.doc_id: (r.fp % (1 << 64), r.component_id) for r in simhash_dedup(table(spark, texts)).collect()}
    prints = [brute_print(t) for t in texts]
    want = brute_components(range(len(texts)), prints)
    assert got == {i: (prints[i], want[i]) for i in range(len(texts))}
    assert {r.doc_id for r in keep_first(table(spark, texts)).collect()} == {i for i, c in want.items() if c == i}
    assert simhash_dedup(table(spark, texts).limit(0)).count() == 0


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    want = brute_components(sorted(texts), [brute_print(texts[i]) for i in sorted(texts)])
    rows = op7_simhash(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in rows} == {i: (f"{brute_print(t):016x}", want[i]) for i, t in texts.items()}


def test_rows_are_kept_by_row(spark):
    long = "one two three four five six seven eight nine ten eleven twelve " * 40
    rows = [(1, long), (2, "quite another text than that"), (2, long + "."), (None, long + "!"), (None, "a text alone without an id"), (None, "a text alone without an id"), (3, "twice the same"), (3, "twice the same")]
    prints = {t: brute_print(t) for _, t in rows}
    assert max((prints[long] ^ prints[long + e]).bit_count() for e in ".!") <= 4
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, row string")
    got = sorted(((r.doc_id, r.text) for r in keep_first(docs).collect()), key=str)
    assert got == sorted([(1, long), (2, "quite another text than that"), (None, "a text alone without an id"), (3, "twice the same")], key=str)
    found = {(r.doc_id, r.fp): r.component_id for r in simhash_dedup(docs).collect()}
    assert found[None, int(np.uint64(prints[long + "!"]).view(np.int64))] == 1
    assert found[None, int(np.uint64(prints["a text alone without an id"]).view(np.int64))] is None


def test_large_leaves_go_on_with_the_other_thirds(monkeypatch):
    """Points that agree in a third, so that its trees can't divide them."""
    rng = random.Random(9)
    prints = sorted({rng.getrandbits(42) << 22 for _ in range(1500)} | {p ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(22, 64) for p in points(2, 100, [8] * 20)})
    monkeypatch.setattr(simhash, "LEAF", 16)
    fps = np.array(prints, dtype=np.uint64)
    near = np.argwhere(np.triu(np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4, 1))
    pairs = {tuple(sorted(x)) for t in range(3) for x in tree_links(fps, t).tolist()}
    assert len(near) and all(tuple(x) in pairs for x in near.tolist())
