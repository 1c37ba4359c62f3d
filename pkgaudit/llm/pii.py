"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, schemes, digits and plus signs, and cue
words of identifiers. Around each anchor a small deterministic parser walks to the boundaries of an
address or number and validates it. Text without anchors is never looked at again.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import product

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pkgaudit.llm.common import need, ship, table

KINDS = ("email", "ip", "card", "phone", "url_login", "iban", "ssn")
BASE = KINDS[:4]

DIGITS = frozenset("0123456789")
LETTERS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz")
LOCAL = LETTERS | DIGITS | frozenset("._%+-")
LABEL = LETTERS | DIGITS | frozenset("-")
PHONE = DIGITS | frozenset(" ().-")
USER = LETTERS | DIGITS | frozenset("._~%!$&'()*+,;=-:")
SCHEMES = ("http://", "https://", "ftp://", "ssh://", "postgres://", "mysql://", "redis://", "amqp://", "mongodb://")
IBAN_CUES = ("iban",)
SSN_CUES = ("ssn", "social")
SECURITY = re.compile(r"[\s_-]*security", re.IGNORECASE | re.ASCII)
NEXT_IBAN_CUE = re.compile("iban", re.IGNORECASE | re.ASCII)
IBAN_START = re.compile(r"(?<![A-Za-z0-9-])[A-Z]{2}(?=[ 0-9])", re.ASCII)
NEXT_DIGIT = re.compile(r"[0-9]|ssn|social[\s_-]*security", re.IGNORECASE | re.ASCII)
SSN = re.compile(r"([0-9]{3})-[0-9]{2}-[0-9]{4}(?![0-9])", re.ASCII)
# Length of the account part by country, as the register of the format gives it.
IBAN_LENGTHS = {
    "AT": 20, "BE": 16, "CH": 21, "CZ": 24, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27,
    "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24,
}


def _automaton() -> ahocorasick.Automaton:
    automaton = ahocorasick.Automaton()
    automaton.add_word("@", (1, "@"))
    automaton.add_word("+", (1, "+"))
    for digit in DIGITS:
        automaton.add_word(digit, (1, "0"))
    for words, what in ((SCHEMES, "url"), (IBAN_CUES, "iban"), (SSN_CUES, "ssn")):
        for word in words:
            for cased in product(*({c.lower(), c.upper()} for c in word)):
                automaton.add_word("".join(cased), (len(word), what))
    automaton.make_automaton()
    return automaton


def _run(text: str, at: int, allowed: frozenset) -> int:
    """The end of the run of allowed characters that begins at `at`."""
    end = len(text)
    while at < end and text[at] in allowed:
        at += 1
    return at


def email_at(text: str, sign: int, free: int) -> tuple[int, int] | None:
    """The address around an at-sign; what precedes `free` is taken."""
    start = sign
    while start > free and text[start - 1] in LOCAL:
        start -= 1
    if start == sign:
        return None
    end = _run(text, sign + 1, LABEL)
    if end == sign + 1:
        return None
    labels = 1
    while end + 1 < len(text) and text[end] == "." and text[end + 1] in LABEL:
        end = _run(text, end + 1, LABEL)
        labels += 1
    return (start, end) if labels > 1 else None


def digits_run(text: str, at: int) -> int:
    return _run(text, at, DIGITS)


def ip_at(text: str, at: int) -> tuple[int, int] | None:
    """Four runs of digits with dots between them that begin with the run at `at`; their values are not looked at."""
    start = at
    for part in range(4):
        end = digits_run(text, at)
        if end == at:
            return None
        if part < 3:
            if end >= len(text) or text[end] != ".":
                return None
            at = end + 1
    return start, end


def card_at(text: str, at: int) -> tuple[int, int]:
    """Digits with at most one blank or hyphen between two, as far as they go."""
    end = at + 1
    while end < len(text):
        if text[end] in DIGITS:
            end += 1
        elif text[end] in " -" and end + 1 < len(text) and text[end + 1] in DIGITS:
            end += 2
        else:
            break
    return at, end


def phone_at(text: str, plus: int) -> tuple[int, int] | None:
    """A plus sign and a digit, then digits and punctuation, back to the last digit; at least one character between."""
    if plus + 1 >= len(text) or text[plus + 1] not in DIGITS:
        return None
    end = _run(text, plus + 2, PHONE)
    while end > plus + 2 and text[end - 1] not in DIGITS:
        end -= 1
    return (plus, end) if end >= plus + 4 else None


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        value = int(c) * (1 + i % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def _digits_of(text: str) -> str:
    return "".join(c for c in text if c in DIGITS)


def login_at(text: str, end_of_scheme: int) -> tuple[int, int] | None:
    """user:password in front of the host of an address with a scheme."""
    end = _run(text, end_of_scheme, USER)
    if end < len(text) and text[end] == "@" and ":" in text[end_of_scheme:end].strip(":"):
        return end_of_scheme, end
    return None


def iban_at(text: str, start: int) -> tuple[int, int] | None:
    """The account number that begins with a country's letters at `start`, checked by its remainder."""
    length = IBAN_LENGTHS.get(text[start:start + 2])
    if length is None:
        return None
    got, end = [], start
    while end < len(text) and len(got) < length:
        if text[end] in LETTERS or text[end] in DIGITS:
            got.append(text[end])
        elif text[end] != " ":
            break
        end += 1
    number = "".join(got)
    if len(number) == length and number.isupper() and (end == len(text) or text[end] not in LABEL):
        moved = number[4:] + number[:4]
        if int("".join(str(int(c, 36)) for c in moved)) % 97 == 1:
            return start, end
    return None


def ibans_after(text: str, cue_end: int) -> Iterator[tuple[int, int]]:
    """The account numbers behind a cue, whatever lies between, up to the next cue (which finds those behind it)."""
    following = NEXT_IBAN_CUE.search(text, cue_end)
    at, end = cue_end, following.start() if following else len(text)
    while found := IBAN_START.search(text, at, end):
        span = iban_at(text, found.start())
        if span:
            yield span
        at = span[1] if span else found.start() + 1


def ssns_after(text: str, cue_end: int) -> Iterator[tuple[int, int]]:
    """Numbers of three, two and four digits with hyphens behind a cue and labels, up to other digits or the next cue."""
    at = cue_end
    while (found := NEXT_DIGIT.search(text, at)) and found[0] in DIGITS:
        number = SSN.match(text, found.start())
        if not number or number[1] in ("000", "666") or number[1] >= "900":
            return
        yield number.span()
        at = number.end()


class _Scanner:
    """The automaton of a worker."""

    made: ahocorasick.Automaton | None = None

    @classmethod
    def anchors(cls, text: str) -> Iterator:
        if cls.made is None:
            cls.made = _automaton()
        return cls.made.iter(text)


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """All spans (kind, start, end) of a text, by kind as listed, then start.

    Of each base kind: leftmost matches that do not overlap, those failing validation dropped without
    a second try. The further kinds stand beside base spans that they overlap.
    """
    base: dict[str, list[tuple[int, int]]] = {k: [] for k in BASE}
    more: list[tuple[str, int, int]] = []
    free = dict.fromkeys(BASE, 0)
    digits_end = 0
    for last, (length, what) in _Scanner.anchors(text):
        at = last - length + 1
        if what == "@":
            if at >= free["email"]:
                span = email_at(text, at, free["email"])
                if span:
                    base["email"].append(span)
                    free["email"] = span[1]
        elif what == "0":
            # An address of numbers may begin at the start of a run of digits, or where the last one ended.
            if at >= free["ip"] and (at >= digits_end or at == free["ip"]):
                span = ip_at(text, at)
                if span:
                    free["ip"] = span[1]
                    if all(len(p.lstrip("0")) <= 3 and int(p[-4:] or 0) <= 255 for p in text[slice(*span)].split(".")):
                        base["ip"].append(span)
            digits_end = max(digits_end, digits_run(text, at)) if at >= digits_end else digits_end
            if at >= free["card"]:
                start, end = card_at(text, at)
                free["card"] = end
                digits = _digits_of(text[start:end]) if 13 <= end - start <= 37 else ""
                if 13 <= len(digits) <= 19 and luhn(digits):
                    base["card"].append((start, end))
        elif what == "+":
            if at >= free["phone"]:
                span = phone_at(text, at)
                if span:
                    free["phone"] = span[1]
                    if 9 <= len(_digits_of(text[slice(*span)])) <= 15:
                        base["phone"].append(span)
        elif what == "url":
            span = login_at(text, last + 1)
            if span:
                more.append(("url_login", *span))
        elif what == "iban":
            more += [("iban", *span) for span in ibans_after(text, last + 1)]
        else:
            rest = SECURITY.match(text, last + 1) if length == len("social") else None
            if rest or length == len("ssn"):
                more += [("ssn", *span) for span in ssns_after(text, rest.end() if rest else last + 1)]
    out = [(k, s, e) for k in BASE for s, e in base[k]]
    return out + sorted(set(more), key=lambda m: (KINDS.index(m[0]), m[1]))


def scan_pii(docs: DataFrame) -> DataFrame:
    """doc_id and spans (kind, start, end; code points, end exclusive) of every row; nothing is shuffled.

    A null text has no spans; repeated rows each have theirs; an empty table gives an empty result;
    columns beyond doc_id and text are not read.
    """
    need(docs, "doc_id", "text")
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans = [
                [{"kind": k, "start": s, "end": e} for k, s, e in find_spans(t.as_py() or "")]
                for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(spans, kind)], ["doc_id", "spans"])

    return docs.select("doc_id", "text").mapInArrow(
        run, docs.select("doc_id").schema.simpleString()[7:-1].replace(":", " ")
        + ", spans array<struct<kind: string, start: bigint, end: bigint>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with their spans of personal data."""
    from pyspark.sql import functions as F

    found = scan_pii(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def of_kind(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def text_of(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    return found.select(
        "doc_id",
        *[of_kind(kind) for kind in BASE],
        F.sha2(text_of(base), 256).alias("base_sha256"), text_of(F.col("spans")).alias("spans"))


QUERIES = {"op10_pii": op10_pii}
ORACLES: dict[str, str] = {}
