import numpy as np
import public_tokenizers
import pytest

from leafsieve.llm import merge_dropout
from leafsieve.llm.merge_dropout import DropoutEncoder
from leafsieve.llm.vocabulary import load_vocabulary, units

TEXTS = ["the singing thing tests nothing interesting " * 3, "", None, "é𝄞 日本語 naïve\nab  cd", "abc" * 50 + " word", " " * 90 + "x"]


@pytest.fixture(scope="module")
def vocabulary():
    return load_vocabulary(public_tokenizers.path("piece_bpe_32k.model"))


def test_a_word_varies_over_documents_and_places(vocabulary):
    code = DropoutEncoder(vocabulary, seed=5)
    assert len(set(code.encode(["understanding tokenization"] * 400, list(range(400))))) > 8
    # Every occurrence in one text is drawn by itself: lines are units of their own, so the ids between line ends can be compared.
    (line,) = np.frombuffer(code.encode(["\n"], [0])[0][-4:], "<u4").tolist()
    ids = np.frombuffer(code.encode(["\nunderstanding" * 400], [0])[0], "<u4")
    parts = {tuple(p.tolist()) for p in np.split(ids, np.flatnonzero(ids == line))}
    assert len(parts) > 5


def test_skipped_share_is_the_dropout(vocabulary):
    code, plain = DropoutEncoder(vocabulary, 0.1, 3), DropoutEncoder(vocabulary, 0.0)
    (alone,) = plain.encode(["a"], [0])  # " a" is one merge
    got = code.encode(["a"] * 20_000, list(range(20_000)))
    assert abs(sum(g != alone for g in got) / 20_000 - 0.1) < 0.01


def test_remembered_units_equal_agendas(vocabulary, monkeypatch):
    monkeypatch.setattr(merge_dropout, "KNOWN_UNITS", 12)
    monkeypatch.setattr(merge_dropout, "KNOWN_OUTCOMES", 10)
    code, other = DropoutEncoder(vocabulary, 0.3, 7), DropoutEncoder(vocabulary, 0.3, 7)
    monkeypatch.setattr(merge_dropout, "DRAWN", 100)
    texts, ids = TEXTS * 20, list(range(20 * len(TEXTS)))
    got = code.encode(texts, ids)
    assert got == [other.encode([t], [i])[0] for t, i in list(zip(texts, ids, strict=True))[::-1]][::-1]
    for text, i, g in zip(texts, ids, got, strict=True):
        words = units(text, True) if text else []
        assert g == b"".join(code.merges.ids(code.agenda(w, k)) for w, k in zip(words, code.unit_keys(i, len(words)), strict=True))
        assert code.decode(g).decode() == (text or "")
