import re

import pytest

from pairset.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(c) * (2 if k % 2 else 1) for k, c in enumerate(reversed(digits))]
    return sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0


def passes(kind, match):
    d = re.sub("[^0-9]", "", match)
    return {
        "email": lambda: True, "ip": lambda: all(int(p) <= 255 for p in match.split(".")),
        "card": lambda: 16 <= len(d) <= 19 and luhn(d), "phone": lambda: 8 <= len(d) <= 15,
    }[kind]()


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if passes(k, m.group())]


TEXTS = [
    "mail a.b+c@mail.example.com, or a@b@c.de_x@y.z.w and é ü 😀 q@r.st. end", "@ a@ a@b a@b. a@b.c", "1.2.3.4 1.2.3.4.5.6.7.8 256.1.1.1 0000255.01.1.1 1.2.3",
    "4111 1111 1111 1111, 4111-1111-1111-1112 4601917210984092 411111111111111 4111111111111111 2 3", "+1 (582) 555-6684 +49 30 1234567 + 1 +12 +123456789012345678 +1(2)",
    None, "", "x" * 50_000 + "@", "9" * 30_000, "1 " * 20_000, "a@" + "b." * 15_000 + "c", "+1" + " " * 20_000 + "2 +1 582 555 6684",
    "call (582) 555-6684 or 582-555-6684; ssn 123-45-6789, version 123-45-6780", "pay to account DE89 3704 0044 0532 0130 00", "write jane.doe [at] example [dot] com now",
]


def test_base_equals_plain_matching(docs):
    got = {r.doc_id: [(s.kind, s.start, s.end) for s in r.base] for r in pii.detect(docs(*enumerate(TEXTS))).collect()}
    for i, text in enumerate(TEXTS):
        assert got[i] == brute(text), i


def test_the_method_adds_spans(docs):
    rows = [(k, t) for k in range(30) for t in TEXTS[-3:]] + [(99, "build 582-555-6684x and version 123-45-6789")]
    found = pii.detect(docs(*rows)).collect()
    kinds = {s.kind for r in found if r.doc_id < 99 for s in r.spans}
    assert {"phone_local", "ssn", "iban", "email_spelled"} <= kinds
    assert all({(s.kind, s.start) for s in r.base} <= {(s.kind, s.start) for s in r.spans} for r in found)


def test_repeated_rows_keep_a_row_each(docs):
    got = pii.detect(docs((1, "a@b.cd"), (1, "a@b.cd"), (1, "x"))).select("doc_id", pii.joined("spans").alias("s")).collect()
    assert sorted(r.s for r in got) == ["", "email:0:6", "email:0:6"]


def test_estimates_find_the_bad_labeler():
    counts = [((1, 1, 0, 0, 1), 800), ((-1, -1, 0, -1, 1), 300), ((1, 1, 1, 0, -1), 100), ((-1, -1, 0, 0, -1), 100)]
    prior, says = pii.reliabilities(counts)
    assert 0.5 < prior < 0.9 and says[0][1][0] > 0.9 and says[0][-1][1] > 0.9


@pytest.mark.parametrize("rows", [[], [(1, "nothing here")], [(1, None)]])
def test_without_spans(docs, rows):
    assert [list(r.spans) for r in pii.detect(docs(*rows) if rows else docs().limit(0)).collect()] == [[]] * len(rows)


@pytest.mark.parametrize("iban", ["DE89370400440532013000", "DE89 3704 0044 0532 0130 00", "AT61 1904 3002 3457 3201", "GB29 NWBK 6016 1331 9268 19", "NO93 8601 1117 947"])
@pytest.mark.parametrize("after", ["Please pay", "Call us", "PLEASE PAY NOW", "CALL", "I pay", "and pay", "2024 too", ""])
def test_an_iban_ends_before_the_next_word(docs, iban, after):
    text = f"IBAN {iban} {after}".strip()
    spans = [s for r in pii.candidates(docs((1, text))).collect() for s in r.spans if s.kind == "iban"]
    assert [(text[s.start: s.end], s.format) for s in spans] == [(iban, 1)]
