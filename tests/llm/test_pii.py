import hashlib
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from tests.llm.fixtures import small, table

from leafsieve.llm.pii import find_pii, redact
from leafsieve.llm.queries import op6_pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def brute(text):
    out = []
    for rank, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": all(int(p) <= 255 for p in m[0].split(".")) if kind == "ip" else 0,
                  "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]
            if ok:
                out.append((m.start(), rank, m.end(), kind))
    return sorted(out)


CASES = [
    None, "", "a@b.c_d@e.f and x@y.zz.", "ip 1.2.3.4.5.6.7.8 300.1.1.1 001.2.3.255 1.1.1.1", "4111 1111 1111 1111, 4111-1111-1111-1112",
    "é𝄞 +1 (743) 555-3824 and +44 20 7946 0958 +1(((((", "@@@ a@b a@b. .@x.y-z", "5" * 40, "1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 8 9",
    "+12345678901 +1.2.3.4", "0.0.0.0 10.0.0.1 00.000.0.256 000.00.0255.1 1.2.3.0", "a..b@c.d- x%+-@y.z é@é.fr 1@2.3,4@5.6", "IBAN GB82 WEST 1234 5698 7654 32 and GB83 WEST 1234 5698 7654 32", "my ssn 123-45-6789, code 123-45-6789",
]


def test_base_spans_equal_brute_force(spark):
    texts = CASES + [c + "\n" + d for c in CASES[2:] for d in CASES[2:]]
    got = {r.doc_id: [(s.start, s["rank"], s.stop, s.kind) for s in r.pii] for r in find_pii(table(spark, texts)).collect()}
    for i, t in enumerate(texts):
        assert [s for s in got[i] if s[1] < 4] == brute(t), t


@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet=st.sampled_from("0123459. -()+@a.b_%é\n"), max_size=120), min_size=40, max_size=40))
def test_random_base_spans(spark, texts):
    got = {r.doc_id: [(s.start, s["rank"], s.stop, s.kind) for s in r.pii if s["rank"] < 4] for r in find_pii(table(spark, texts)).collect()}
    assert got == {i: brute(t) for i, t in enumerate(texts)}


def test_query_equals_brute_force(spark):
    texts = {r.doc_id: r.text for r in small(spark).collect()}
    rows = op6_pii(spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = brute(texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{s}:{e}" for s, _, e, k in base).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(b[3] == k for b in base) for k in PATTERNS]


def test_method_adds_validated_spans(spark):
    rows = {r.doc_id: r.pii for r in find_pii(table(spark, CASES)).collect()}
    assert [(s.kind, s.start) for s in rows[12] if s["rank"] >= 4] == [("iban", 5)]
    assert [(s.kind, s.start) for s in rows[13] if s["rank"] >= 4] == [("ssn", 7)]


def test_long_runs_are_linear(spark):
    texts = ["a" * 300_000 + "@", "1" * 300_000 + ".1", "1 " * 200_000, "+" + "1(" * 100_000, "a@" * 100_000, "a@b" + ".c" * 100_000]
    rows = {r.doc_id: r.pii for r in find_pii(table(spark, texts)).collect()}
    assert [len(rows[i]) for i in range(6)] == [0, 0, 0, 0, 0, 1]


def test_redact_and_empty(spark):
    got = {r.doc_id: r.text for r in redact(table(spark, CASES)).collect()}
    assert got[0] is None and got[2] == "<EMAIL>_d@e.f and <EMAIL>." .replace("_d@e.f", "<EMAIL>")
    assert got[4] == "<CARD>, 4111-1111-1111-1112"
    assert redact(table(spark, ["x"]).limit(0)).count() == 0
    assert redact(table(spark, ["x"])).columns == table(spark, ["x"]).columns
