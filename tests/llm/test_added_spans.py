"""Added kinds of personal data: beside base spans, cues in any case, labels behind cues."""

import random
import time

import pytest

from pkgaudit.llm import pii as P


def added(text):
    return [(k, text[s:e]) for k, s, e in P.find_spans(text) if k not in P.BASE]


def test_url_login_is_demanded():
    text = "see https://bob:pw123@host.example/x IBAN DE89 3704 0044 0532 0130 00 and SSN 078-05-1120."
    assert added(text) == [("url_login", "bob:pw123"), ("iban", "DE89 3704 0044 0532 0130 00"), ("ssn", "078-05-1120")]
    text = "postgres://bob:pw123@db.example.com"
    assert [(k, text[s:e]) for k, s, e in P.find_spans(text)] == [
        ("email", "pw123@db.example.com"), ("url_login", "bob:pw123")]
    assert added("HTTPS://bob:pw123@host.example") == [("url_login", "bob:pw123")]


def iban(country, body):
    moved = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{country}{98 - moved % 97:02d}{body}"


def test_account_that_is_a_card_too():
    rng = random.Random(3)
    while True:
        number = iban("BE", "".join(rng.choice("0123456789") for _ in range(12)))
        if P.luhn(number[2:]):
            break
    kinds = {k for k, _, _ in P.find_spans(f"IBAN: {number}")}
    assert kinds == {"card", "iban"}


@pytest.mark.parametrize("cue", ["IBAN", "iBan", "Iban (International Bank Account Number): ", "iban of the account to be paid to, as agreed:\n\t"])
def test_labels_behind_an_account_cue(cue):
    assert added(f"{cue} DE89370400440532013000, or GB82 WEST 1234 5698 7654 32.") == [
        ("iban", "DE89370400440532013000"), ("iban", "GB82 WEST 1234 5698 7654 32")]


@pytest.mark.parametrize("cue", [
    "Social Security", "Social security number", "SOCIAL SECURITY NO.", "social-security", "Ssn", "ssn (the one on your old card): ",
    "Social Security Number (SSN) of the employee - "])
def test_labels_behind_a_number_cue(cue):
    assert added(f"{cue} 078-05-1120 and 219-09-9998; part 123-45-67890") == [("ssn", "078-05-1120"), ("ssn", "219-09-9998")]


def test_no_cue_or_no_number():
    for text in ("078-05-1120", "DE89370400440532013000", "SSN 000-12-3456", "SSN 5 078-05-1120", "IBAN DE88370400440532013000", "social 078-05-1120"):
        assert added(text) == []


def test_many_cues_take_linear_time():
    began = time.process_time()
    assert added("iban ssn social security " * 40_000 + "219-09-9998") == [("ssn", "219-09-9998")]
    assert time.process_time() - began < 20
