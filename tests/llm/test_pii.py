"""Spans by anchors and local parsers against plain regular expressions."""
import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

import __spark_entry__ as E
from regiopanel.llm import pii

SF = "/root/testdata/sf0.01"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, match):
    digits = re.sub(r"[^0-9]", "", match)
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "phone":
        return 10 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(digits[::-1]))
        return 14 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    return sorted((m.start(), list(PATTERNS).index(k), m.end(), k)
                  for k, p in PATTERNS.items() for m in re.finditer(p, text) if valid(k, m.group(0)))


def base_spans(text):
    return [(s, e, k) for s, e, k in pii.find_spans(text, AUTOMATON) if k in pii.BASE]


AUTOMATON = pii.build_automaton()


@settings(max_examples=1500, deadline=None)
@given(st.text(alphabet="0123456789.@+- ()a-Zé%_", max_size=60))
def test_base_spans_match_patterns(text):
    assert base_spans(text) == [(s, e, k) for s, _, e, k in brute(text)]


def test_dense_digits_match_patterns():
    rng = random.Random(3)
    for _ in range(3000):
        text = "".join(rng.choices("0123456789 -.+()@ab", weights=[6] * 10 + [5, 3, 5, 2, 1, 1, 1, 1, 1], k=rng.randrange(80)))
        assert base_spans(text) == [(s, e, k) for s, _, e, k in brute(text)]


def test_added_kinds():
    text = "See https://a.example.com/x?y=1 and account: DE4450010517, 12 Long Hill Street."
    assert [(k, text[s:e]) for s, e, k in pii.find_spans(text, AUTOMATON)] == [
        ("url", "https://a.example.com/x?y=1"), ("account", "DE4450010517"), ("address", "12 Long Hill Street")]


def test_query_over_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    rows = E.queries()["op9_pii"](spark, SF).collect()
    assert len(rows) == len(texts)
    seen = 0
    for r in rows:
        spans = brute(texts[r.doc_id])
        base = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        counts = [sum(k == x for *_, k in spans) for x in pii.BASE]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts
        assert set(base.split(",")) <= set(r.spans.split(",")) | {""}
        seen += len(spans)
    assert seen > 30


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 5), (None, "x" * 200_000 + " a@b.co", 6), (1, "", 7), (1, "", 7)],
                               "doc_id long, text string, spans int")
    rows = pii.find_personal_data(df).collect()
    assert sorted(r.n_email for r in rows) == [0, 0, 0, 1]
    assert next(r for r in rows if r.n_email).spans == "email:200001:200007"
    assert pii.find_personal_data(df.where("false")).count() == 0


def found(text, kind):
    return [text[s:e] for s, e, k in pii.find_spans(text, AUTOMATON) if k == kind]


def test_accounts_and_their_check_digits():
    assert found("IBAN DE89 3704 0044 0532 0130 00, danke", "account") == ["DE89 3704 0044 0532 0130 00"]
    assert found("pay to GB82WEST12345698765432 now", "account") == ["GB82WEST12345698765432"]
    assert found("pay to FR14 2004 1010 0505 0001 3M02 606.", "account") == ["FR14 2004 1010 0505 0001 3M02 606"]
    assert found("IBAN DE88 3704 0044 0532 0130 00", "account") == []  # wrong check digits
    assert found("code DE89370400440532013000X", "account") == []
    assert found("ACCOUNT no. 12345678 and Kontonummer: 532 013 000; cuenta nº 0012-3456-78", "account") == \
        ["12345678", "532 013 000", "0012-3456-78"]
    assert found("my account was closed in 2019", "account") == []
    rng = random.Random(9)
    for _ in range(200):  # right check digits by their definition, then one digit changed
        bban = "".join(rng.choices("0123456789", k=18))
        check = 98 - int(bban + "131400") % 97
        value = f"DE{check:02d}{bban}"
        assert pii.iban_ok(value)
        at = rng.randrange(4, 22)
        assert not pii.iban_ok(value[:at] + str((int(value[at]) + rng.randrange(1, 10)) % 10) + value[at + 1:])


def test_addresses_in_four_languages():
    for text in ("12 Long Hill Street", "12 Long Hill St.", "7b Baker St", "12 rue de la Paix", "3 bis, avenue Victor Hugo", "5 place de l'Opéra",
                 "Hauptstraße 12", "Lange Straße 5 a", "Goethestr. 7", "Am Markt-Platz 3", "Calle de Alcalá, 42", "Avenida del Sol 5",
                 "Plaza Mayor nº 1"):
        assert found(f"sie wohnt: {text}, ja", "address") == [text], text
    for text in ("the street was long", "in 1999 the road ended", "une rue de la ville", "er ging seinen Weg", "la calle mayor", "Weg 12x3",
                 "on St. Mary's day"):
        assert found(text, "address") == [], text
