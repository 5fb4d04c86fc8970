import random
import zlib

import numpy as np
import public_tokenizers
from tests.llm.fixtures import small, table
from tokenizers import Tokenizer

from leafsieve.llm.packing import Packer, lay_out, pack
from leafsieve.llm.word_ids import Encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
CASES = [None, "", " ", "Hello  World's\tend", "a\x1cb\x85c d é x ́y", "<|endoftext|>a <|startoftext|>", "ΣΑΣ ΟΔΟΣ İI", "日本語 123 !!??", "w" * 5000, "several words here " * 3000]


def check(texts, rows, window=2048):
    tok = Tokenizer.from_file(PATH)
    docs, seqs = {}, {}
    for r in rows:
        docs.setdefault(r.doc_id, []).append(r)
        seqs.setdefault(r.sequence_id, []).append(r)
    assert set(docs) == set(texts)
    for i, pieces in docs.items():
        want = np.array(tok.encode(texts[i] or "", add_special_tokens=False).ids + [1], dtype="<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(want) and p.length > 0
            part = want[at : at + p.length].tobytes()
            assert p.ids_crc32 == zlib.crc32(part) and bytes(p.ids) == part
            at += p.length
        assert at == len(want)
    pad = total = 0
    for pieces in seqs.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= window
        total += at
        pad += 0 if at & (at - 1) == 0 else window - at
    return pad / max(total, 1)


def test_pieces_make_up_every_document(spark):
    texts = dict(enumerate(CASES + ["mid words of some length " * k for k in range(60)]))
    assert check(texts, pack(table(spark, list(texts.values())), PATH).collect()) < 0.01


def test_whole_table(spark):
    docs = small(spark)
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert check(texts, pack(docs.repartition(5), PATH).collect()) < 0.01
    assert pack(docs.limit(0), PATH).count() == 0


def test_encoder_equals_library():
    tok, enc = Tokenizer.from_file(PATH), Encoder(PATH)
    texts = [c for c in CASES if c is not None]
    for text, got in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids


def test_other_tokenizers_encode_whole_texts(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok, enc = Tokenizer.from_file(path), Encoder(path)
    texts = ["Hello big World, a.b.", "  two  blanks\n\n", *(c for c in CASES if c is not None)]
    assert not enc.by_words and Encoder(PATH).by_words
    for text, got in zip(texts, enc.encode([t.encode() for t in texts]), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == tok.encode(text, add_special_tokens=False).ids
    ids = {}
    for r in sorted(pack(table(spark, texts), path).collect(), key=lambda r: r.start):
        ids[r.doc_id] = ids.get(r.doc_id, b"") + bytes(r.ids)
    assert {i: np.frombuffer(x, "<u4").tolist() for i, x in ids.items()} == {i: [*tok.encode(t, add_special_tokens=False).ids, 1] for i, t in enumerate(texts)}


def test_words_equal_library():
    """Words of the table and made-up ones of all code points that are merged in step, one by one."""
    import pyarrow.parquet as pq

    rng = random.Random(3)
    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["text"])["text"].to_pylist()
    words = sorted({w for t in texts for w in (t or "").encode().split()})[::2]
    letters = [chr(c) for c in range(0x21, 0x300) if c != 0x7F and not 0x80 <= c <= 0xA0]
    words += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 130))).encode() for _ in range(2000)] + [c.encode() for c in letters]
    words += ["".join(rng.choice("etaoinshrdluXQ's.,9-") for _ in range(rng.randint(1, 70))).encode() for _ in range(4000)]
    words += [w.encode() for w in ("don't", "we'll've", "''" + "'s", "x²y3½", "İx", "ßẞ", "e\u0301a", "a\x1cb", "\x85q", "ŉǅ", "日本語x", "it's.")]
    tok, enc = Tokenizer.from_file(PATH), Encoder(PATH)
    for word, got, batch in zip(words, enc.encode(words), tok.encode_batch([w.decode() for w in words], add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == batch.ids, word


def test_open_windows_are_bounded_and_padding_small():
    rng, packer, emitted, total = random.Random(1), Packer(window=256, slots=8, sliver=4), [], 0
    for i in range(3000):
        n = rng.choice([1, 5, 40, 100, 255, 256, 700])
        total += n
        emitted += packer.add(i, bytes(4 * n))
        assert len(packer.rest()) <= 8
    rest = packer.rest()
    assert sum(len(p[2]) // 4 for w in emitted + rest for p in w) == total
    assert all(256 - 4 < sum(len(p[2]) // 4 for p in w) <= 256 for w in emitted)
    tail = list(lay_out([p for w in rest for p in w], 256))
    sizes = [sum(len(p[2]) // 4 for p in w) for w in tail]
    assert all(n == 256 or n & (n - 1) == 0 for n in sizes) and sum(sizes) == sum(len(p[2]) // 4 for w in rest for p in w)


def test_long_texts_and_full_tables():
    """Texts of many stretches, more new tokens than the table holds, and apostrophes, signs and marks at every place."""
    from leafsieve.llm import word_ids

    rng, tok, enc = random.Random(5), Tokenizer.from_file(PATH), Encoder(PATH)
    parts = ["'s", "''s", "'", "re", "'re", "ll'll", "É", "×", "÷a", "ÿ", "1", "\u0301", "ab", "Ж", " ", "\n", "\x00", "'D", "x" * 30, "\u00a0", "\ud55c"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 40))).encode() for _ in range(3000)]
    for text, got, want in zip(texts, enc.encode(texts), tok.encode_batch([t.decode() for t in texts], add_special_tokens=False), strict=True):
        assert np.frombuffer(got, "<u4").tolist() == want.ids, text
    whole, before = b" ".join(texts), word_ids.STRETCH
    try:
        word_ids.STRETCH = 50
        enc.table = word_ids.TokenTable(6)
        assert np.frombuffer(enc.encode([whole])[0], "<u4").tolist() == tok.encode(whole.decode(), add_special_tokens=False).ids
        assert enc.table.bits > 6
    finally:
        word_ids.STRETCH = before
    assert enc.encode([]) == [] and enc.encode([b"", b" \n"]) == [b"", b""]
