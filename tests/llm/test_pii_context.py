import re

from tests.llm.fixtures import table

from leafsieve.llm.pii import CONTEXT, KINDS, find_pii, redact

TEXTS = [
    "SSN: 123-45-6789, 223-45-6789, 323-45-6789",
    "card 1234567890123, 4222222222222",  # the first one fails validation
    "mail a@b.cc, b@b.cc " + "é𝄞 " * 14 + "c@b.cc " + "x" * 50 + " d@b.cc",
    "ssn 123-45-6789" + " " * 40 + "223-45-6789 323-45-6789",
    "123-45-6789 ssn 223-45-6789",
    "ssn 123-45-6789 and his 223-45-6789, code 323-45-6789",
]


def test_every_entry_of_a_list_has_its_context(spark):
    got = {r.doc_id: r.pii for r in find_pii(table(spark, TEXTS)).collect()}
    assert [(s.start, s.kind) for s in got[0]] == [(5, "ssn"), (18, "ssn"), (31, "ssn")]
    assert [(s.start, s.kind) for s in got[1]] == [(20, "card13")]
    assert [s.start for s in got[3]] == [4]
    assert [s.start for s in got[4]] == [16]
    assert [s.start for s in got[5]] == [4, 24]


def test_scores_come_from_the_text_before(spark):
    kinds = {k.name: k for k in KINDS}
    for r in find_pii(table(spark, TEXTS)).collect():
        for s in r.pii:
            kind = kinds[s.kind]
            near = re.search(kind.words, TEXTS[r.doc_id][max(0, s.start - CONTEXT) : s.start])
            assert s.score == round(kind.prior + (kind.bonus if near else 0), 2), (r.doc_id, s)


def test_redaction_reaches_every_entry(spark):
    got = {r.doc_id: r.text for r in redact(table(spark, TEXTS)).collect()}
    assert got[0] == "SSN: <SSN>, <SSN>, <SSN>"
