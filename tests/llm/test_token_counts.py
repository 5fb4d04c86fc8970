import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import small, table

from leafsieve.llm.queries import op4_token_counts
from leafsieve.llm.token_counts import Counter, count_tokens
from leafsieve.llm.vocabulary import load_vocabulary, read_model, unigram_scores, units

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    """The same pieces and scores as a unigram model of the library."""
    proto = read_model(PATH)
    proto.trainer_spec.model_type = 1
    for piece, score in zip(proto.pieces, unigram_scores([p.score for p in proto.pieces]), strict=True):
        if piece.type == 1:
            piece.score = score / 64
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


@pytest.fixture(scope="module")
def own():
    v = load_vocabulary(PATH)
    return Counter(v.pieces, unigram_scores(v.scores), v.prefix)


CASES = ["", " ", "  ", "a", "Hello  world\n\nnew\tline ", "é𝄞 日本語 ▁x", "   lead", "trail   ", "x\r\ny", "\n", "aaaaaaa" * 30, "<s> </s> <0x0A>", "\x00 \x01", "word " * 3000]


def test_cases_equal_library(library, own):
    for text in CASES:
        assert own.count([text])[0][0] == len(library.encode(text)), repr(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab the ing\nÉéß▁日𝄞.,  0"), max_size=60))
def test_random_equal_library(library, own, text):
    assert own.count([text])[0][0] == len(library.encode(text))


def test_ties_keep_the_longest_last_piece():
    pieces = {"a": 0, "b": 1, "ab": 2, "c": 3, "bc": 4}
    # a + bc and ab + c have equal scores: the one whose last piece is longer stays; a|b|c scores the same with three.
    counter = Counter(pieces, [-2, -2, -4, -2, -4], False)
    assert counter.count(["abc"])[0][0] == 2 and counter.count(["ab"])[0][0] == 1


def test_units_make_up_the_text():
    for text in CASES:
        assert "".join(units(text, False)) == text


def test_whole_table(spark, library):
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    rows = op4_token_counts(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_tokens for r in rows} == {i: len(library.encode(t)) for i, t in texts.items()}


def test_edges(spark):
    docs = table(spark, [None, "", "one", "one"])
    assert [tuple(r.tokens)[0] for r in count_tokens(docs, PATH).orderBy("doc_id").collect()] == [0, 0, 1, 1]
    assert count_tokens(docs.limit(0), PATH).count() == 0
