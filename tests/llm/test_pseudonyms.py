import re

import pytest

from huetide.llm import pseudonyms as p
from tests.llm.cases import documents, empty

VALUES = {
    "email": ["ann.42@mail8.example.com", "A_b+c@x-y.org"],
    "iban": ["GB82WEST12345698765432", "DE89 3704 0044 0532 0130 00"],
    "ssn": ["123-45-6789"],
    "date": ["2024-02-29", "31/12/1999", "3/4/2020", "12.11.2001", "2001/1/9"],
    "ip": ["54.158.173.199", "8.8.8.8"],
    "card": ["4111111111111111", "4111 1111 1111 1111", "5500-0000-0000-0004"],
    "phone": ["+1 (375) 555-4393", "(415) 555-0100", "+49 30 1234567", "415-555-0100"],
}
WRONG = ["4111111111111112", "2023-02-29", "300.1.1.1", "000-12-3456", "GB82WEST12345698765433", "1.2.3.4.5", "12345", "3.14", "a@b"]


@pytest.mark.parametrize(("kind", "value"), [(k, v) for k, vs in VALUES.items() for v in vs])
def test_round_trip_in_format(kind, value):
    f = p.Feistel(b"k")
    new = p.pseudonym(f, kind, value)
    assert new != value and p.PATTERNS[kind].fullmatch(new)
    assert p.pseudonym(f, kind, new, back=True) == value
    assert kind == "ip" or kind == "date" or re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", new))) == re.sub("[0-9]", "9", re.sub("[a-z]", "a", re.sub("[A-Z]", "A", value)))
    assert p.replace(f"x {value}, y", lambda k, v: p.pseudonym(f, k, v))[1][0][0] == kind


def test_permutes(spark):
    f = p.Feistel(b"k")
    assert sorted(f.permute("t", x, 1000) for x in range(1000)) == list(range(1000))


def test_what_fails_validation_stays():
    f = p.Feistel(b"k")
    for v in WRONG:
        assert p.replace(f"x {v} y", lambda k, s: p.pseudonym(f, k, s)) == (f"x {v} y", [])


def brute(text, kind, right, inside, low, high):
    """Values from left to right, longest first, over all substrings that begin and end between groups."""
    edge = "[0-9]" if kind == "card" else "[A-Za-z0-9]"
    at, out = 0, []
    while at < len(text):
        for end in range(len(text), at, -1):
            plain = re.sub("[ -]", "", text[at:end])
            cut = (at and re.match(edge, text[at - 1])) or (end < len(text) and re.match(edge, text[end]))
            if low <= len(plain) <= high and not cut and re.fullmatch(inside, text[at:end]) and right(plain):
                out.append((at, end))
                at = end - 1
                break
        at += 1
    return out


BESIDE = [
    "4111 1111 1111 1111 123",
    "ref 17 4111111111111111",
    "7536784127813050 4845168114407329",
    "4111-1111-1111-1111 5500-0000-0000-0004 12",
    "1 2 3 4111111111111111 9 8 7-6 5500 0000 0000 0004",
    "41111111111111111111 4111111111111112",
    "BE68 5390 0754 7034 PAID",
    "XX12 BE68 5390 0754 7034 A1B2 C3",
    "AB12 CD34 GB82WEST12345698765432 DE89 3704 0044 0532 0130 00",
]


def test_values_beside_other_groups_are_found():
    f = p.Feistel(b"k")
    card = lambda d: p.luhn_digit(d[:-1]) == d[-1] and len(set(d)) > 1
    iban = lambda d: p.iban_digits(d[:2] + d[4:]) == d[2:4]
    for text in BESIDE:
        spans = p.replace(text, lambda k, s: p.pseudonym(f, k, s))[1]
        ibans = brute(text, "iban", iban, "[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4})*(?: ?[A-Z0-9]{1,3})?", 15, 34)
        cards = [(a, b) for a, b in brute(text, "card", card, "[0-9](?:[ -]?[0-9])*", 13, 19) if all(b <= c or a >= d for c, d in ibans)]
        assert [(a, b) for k, a, b, _ in spans if k == "iban"] == ibans, text
        assert [(a, b) for k, a, b, _ in spans if k == "card"] == cards, text
        assert ibans or cards or text.startswith("4111111111111111111"), text


def test_equal_values_stay_linked_across_documents(spark):
    card = "4111111111111111"
    texts = [None, "", f"é {card}", f"{card} and 4111 1111 1111 1111", "nothing", "z" * 100_000 + card, f"é {card}"]
    got = [r for r in sorted(p.pseudonymise(documents(spark, texts)).collect(), key=lambda r: r.doc_id)]
    assert got[0].text is None and got[1].text == "" and got[4].text == "nothing"
    new = got[2].replaced[0].pseudonym
    assert got[2].text == f"é {new}" and got[2].replaced[0].start == 2
    assert got[3].text == f"{new} and {' '.join(new[k:k + 4] for k in range(0, 16, 4))}"
    assert got[5].text == "z" * 100_000 + new and got[6].text == got[2].text
    assert p.luhn_digit(new[:-1]) == new[-1]
    assert p.pseudonymise(empty(spark)).count() == 0
