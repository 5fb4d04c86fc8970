import hashlib
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import small, table

from leafsieve.llm.merge_dropout import DropoutEncoder, decode_pieces, encode_pieces
from leafsieve.llm.queries import op3_merge_dropout
from leafsieve.llm.vocabulary import load_vocabulary, units

PATH = public_tokenizers.path("piece_bpe_32k.model")
TEXT = st.text(alphabet=st.sampled_from("ab the ing\nÉéß日𝄞.,  0"), max_size=80)


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def plain(vocabulary):
    return DropoutEncoder(vocabulary, 0.0, 0, 1)


@pytest.fixture(scope="module")
def dropping(vocabulary):
    return DropoutEncoder(vocabulary, 0.3, 7, 2)


CASES = ["", " ", "  a", "Hello  world\n\nnew\tline ", "é𝄞 日本語", "abc" * 200, "x" * 3000, "\n", "\x00 \x01\x7f", "naïve word. Word, word", "<s></s><0x0A>", " " * 90]


def numbers(ids):
    return np.frombuffer(ids, "<u4").tolist()


def test_without_dropout_equals_library(plain, library):
    for text in CASES:
        assert numbers(plain.encode([text], [0])[0]) == library.encode(text), repr(text)


@settings(max_examples=200, deadline=None)
@given(TEXT)
def test_random_without_dropout_equals_library(plain, library, text):
    assert numbers(plain.encode([text], [0])[0]) == library.encode(text)


@settings(max_examples=200, deadline=None)
@given(TEXT | st.text(max_size=40), st.integers(0, 9))
def test_round_trip(dropping, text, doc_id):
    (ids,) = dropping.encode([text], [doc_id])
    text.encode("utf-8", "surrogatepass")
    assert dropping.decode(ids) == text.encode("utf-8", "surrogatepass")


def test_agendas_in_step_equal_single_ones(dropping):
    words = list({u for t in CASES + ["the singing thing tests nothing interesting " * 3] for u in units(t, True) if len(u) <= 64})
    for variant in (0, 1):
        keys = dropping.keys(words, variant)
        for word, key, ids in zip(words, keys, dropping.encode_units(words, variant), strict=True):
            assert ids == dropping.merges.ids(dropping.agenda(word, key)), word


def test_seeds_and_ids_vary_but_repeat(vocabulary, dropping, plain):
    text = "international understanding of tokenization differences " * 20
    got = dropping.encode([text] * 20, list(range(20)))
    assert 1 < len(set(got)) <= 2 and got == DropoutEncoder(vocabulary, 0.3, 7, 2).encode([text] * 20, list(range(20)))
    assert got[0] != DropoutEncoder(vocabulary, 0.3, 8, 2).encode([text], [0])[0]
    assert len(got[0]) > len(plain.encode([text], [0])[0])
    letters = DropoutEncoder(vocabulary, 1.0, 0, 1).encode(["abc de"], [0])[0]
    assert len(letters) == 4 * 7


def brute(proc, text, doc_id, dropout, seed=0):
    """Ids by a plain loop: of the neighbours that make a piece and are not skipped, those with the best score merge, the leftmost of equals."""
    mask = (1 << 64) - 1
    pieces = {proc.id_to_piece(i): i for i in range(proc.vocab_size()) if not (proc.is_byte(i) or proc.is_control(i) or proc.is_unknown(i))}

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ x >> 27) * 0x94D049BB133111EB & mask
        return x ^ x >> 31

    def skipped(key, start, piece):
        h = key ^ start * 0xC2B2AE3D27D4EB4F & mask ^ piece * 0x165667B19E3779F9 & mask
        h = (h ^ h >> 33) * 0x9E3779B97F4A7C15 & mask
        h = (h ^ h >> 29) * 0xC2B2AE3D27D4EB4F & mask
        return h ^ h >> 32 < int(dropout * 2**64)

    out = []
    for number, unit in enumerate(re.findall(r" +[^ \n]*|[^ \n]+|\n", f" {text}" if text else "")):
        key = mixed(xxhash.xxh3_64_intdigest(f"{seed}:{doc_id}") + (number + 1) * 0x9E3779B97F4A7C15 & mask)
        parts, starts = [c.replace(" ", "▁") if c != "▁" else None for c in unit], list(range(len(unit)))
        while True:
            best = None
            for k in range(len(parts) - 1):
                piece = pieces.get(parts[k] + parts[k + 1]) if parts[k] and parts[k + 1] else None
                if piece is not None and (best is None or proc.get_score(piece) > best[0]) and not skipped(key, starts[k], piece):
                    best = proc.get_score(piece), k
            if best is None:
                break
            k = best[1]
            parts[k : k + 2], starts[k : k + 2] = [parts[k] + parts[k + 1]], [starts[k]]
        for part in parts:
            known = pieces.get(part) if part else None
            out += [known] if known is not None else [proc.piece_to_id(f"<0x{b:02X}>") for b in (part or "▁").encode()]
    return out


def test_query_equals_brute_force(spark, library):
    """Whole texts, each occurrence of a word drawn by itself; nothing is shared with the operator."""
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    rows = {r.doc_id: r for r in op3_merge_dropout(spark, "/root/testdata/sf0.001").collect()}
    assert set(rows) == set(texts)
    for i, text in texts.items():
        ids = bytes(rows[i].ids)
        assert rows[i].n_ids == len(ids) // 4 and rows[i].ids_crc32 == zlib.crc32(ids)
        if len(text) < 3000:
            assert numbers(ids) == brute(library, text, i, 0.1), i


def test_cases_equal_brute_force(vocabulary, library):
    code = DropoutEncoder(vocabulary, 0.3, 7)
    for k, text in enumerate([*CASES, "▁ literal a▁b", "the singing thing tests nothing interesting " * 9]):
        assert numbers(code.encode([text], [k])[0]) == brute(library, text, k, 0.3, 7), repr(text)


def test_frames(spark):
    texts = [None, "", "▁ literal", "one two", *CASES]
    docs = table(spark, texts)
    coded = encode_pieces(docs, PATH, dropout=0.5, seed=3)
    back = {r.doc_id: r.text2 for r in decode_pieces(coded, PATH, out_col="text2").collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    assert encode_pieces(docs.limit(0), PATH).count() == 0


def test_query_decodes_to_every_text(spark):
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    rows = op3_merge_dropout(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.decoded_sha256 for r in rows} == {i: hashlib.sha256(t.encode()).hexdigest() for i, t in texts.items()}
    assert all(r.lossless for r in rows)
