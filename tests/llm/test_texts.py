"""Operators on single texts: encoding, chat, personal data, secrets, rules, quality."""

import hashlib
import random
import re

import pytest
import tiktoken

from pkgaudit.llm import byte_bpe as B
from pkgaudit.llm import chat as C
from pkgaudit.llm import crf
from pkgaudit.llm import pii as P
from pkgaudit.llm import quality_classifier as Q
from pkgaudit.llm import quality_rules as R
from pkgaudit.llm import secrets as S
from tests.llm.conftest import odd_rows


@pytest.fixture(scope="module")
def coder():
    return B.Codec(B.vocabulary_path(), B.split_pattern())


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding(
        "known", pat_str=B.split_pattern(), mergeable_ranks=B.read_ranks(B.vocabulary_path()), special_tokens={})


def fuzz(alphabet, n, length, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(length))) for _ in range(n)]


def test_ids_are_those_of_the_known_library(coder, known):
    texts = fuzz(["a", "b", "e", "t", "h", " ", "\n", "é", "日", "1", "=", "-", "́", "😀", "A", "\xa0", "==", "...", "tion", "ing"], 3000, 60, 1)
    texts += ["a" * 5000, " " * 3000, "=" * 4000, "1" * 3000, "日" * 2000, "---===***" * 300, "", "\x00"]
    for text in texts:
        ids = coder.encode(text).tolist()
        assert ids == known.encode_ordinary(text)
        assert "".join(coder.decode_stream(ids, at_a_time=3)) == text


def test_forgetting_states_changes_nothing(known, monkeypatch):
    coder = B.Codec(B.vocabulary_path(), B.split_pattern())
    coder.transducer.kept_states = 50
    monkeypatch.setattr(B, "KEPT_PIECES", 20)
    for text in fuzz(["un", "believ", "able", "tion", " ", "x", "é"], 500, 40, 2):
        assert coder.encode(text).tolist() == known.encode_ordinary(text)


def test_encoding_tables(odd, nothing, known):
    plain = {(i, known_digest(known, t)) for i, t, _ in odd_rows()}
    rows = B.round_trip(odd).collect()
    assert {(r.doc_id, r.ids_sha256) for r in rows} == plain and len(rows) == len(odd_rows())
    back = B.decode_documents(B.encode_documents(odd)).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    assert B.round_trip(nothing).count() == 0 and B.encode_documents(nothing).count() == 0


def known_digest(known, text):
    return hashlib.sha256(" ".join(map(str, known.encode_ordinary(text or ""))).encode()).hexdigest()


def test_escapes_are_undone():
    used = C.Template(B.vocabulary_path(), B.split_pattern())
    for text in fuzz(["<", "[", "\\", "/s>", "s>", "INST]", "/INST]", "|turn|>", "a", *C.CONTROLS], 5000, 10, 3):
        escaped = used.escape(text)
        assert used.unescape(escaped) == text
        assert not any(c in escaped for c in C.CONTROLS)


def test_conversations(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "</s> [INST] \\"), (1, 1, "assistant", None), (1, None, None, "first"),
        (None, 3, "assistant", "lone"), (2, 0, "assistant", "x" * 50_000), (2, 1, "assistant", "x" * 50_000), (2, 1, "assistant", "x" * 50_000),
    ]
    df = spark.createDataFrame([(*t, "clash") for t in turns], "conv_id long, turn long, role string, text string, position string")
    formatted = C.format_turns(df).persist()
    got = {r.conv_id: r for r in C.digest_conversations(formatted).collect()}
    for conv in (1, 2, None):
        own = sorted((t for t in turns if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] is not None))
        loss = "".join(t[3] or "" for t in own if t[2] == "assistant")
        said = "".join(f"{t[2] or ''}\n{t[3] or ''}\n" for t in own)
        assert got[conv].n_turns == len(own) and got[conv].loss_chars == len(loss)
        assert got[conv].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert got[conv].turns_sha256 == hashlib.sha256(said.encode()).hexdigest()
    starts = sorted((r.position, r.token_start, len(r.input_ids)) for r in formatted.collect() if r.conv_id == 1)
    assert all(b[1] == a[1] + a[2] for a, b in zip(starts, starts[1:], strict=False))
    assert C.digest_conversations(C.format_turns(df.limit(0))).count() == 0


EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def brute_pii(text):
    def digits(m):
        return re.sub("[^0-9]", "", m[0])

    out = [("email", *m.span()) for m in EMAIL.finditer(text)]
    out += [("ip", *m.span()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m[0].split("."))]
    out += [("card", *m.span()) for m in CARD.finditer(text) if 13 <= len(digits(m)) <= 19 and P.luhn(digits(m))]
    return out + [("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(digits(m)) <= 15]


def test_personal_data():
    alphabet = [*"0123456789", *"0123456789", ".", ".", "@", "+", " ", "-", "(", ")", "a", "Z", "_", "4111 1111 1111 1111",
                "192.168.1.1", "a@b.c", "+49 30 123456", "٣", "1.2.3.4.5", "@x.y", "é", "256"]
    for text in fuzz(alphabet, 20_000, 40, 4):
        assert [s for s in P.find_spans(text) if s[0] in P.BASE] == brute_pii(text)



ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)


def brute_secrets(text):
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(out, key=lambda s: (s[1], S.BASE.index(s[0])))


def test_secret_patterns():
    alphabet = ["token", "Secret", "API_KEY", "password", "=", ":", " ", "\"", "'", "abcdef01", "AKIA", "ABCDEFGH1234", "f" * 16, "K", "ſ", "x", "\n"]
    for text in fuzz(alphabet, 20_000, 14, 5):
        assert S.base_spans(text) == brute_secrets(text)


def test_secrets_table(spark, odd, nothing):
    rows = [(i, f'prose of some words token = "{hashlib.sha1(str(i).encode()).hexdigest()}" and id 26691094489{i:05d} x@y.org') for i in range(60)]
    model = S.train(spark.createDataFrame(rows, "doc_id long, text string"))
    found = {r.doc_id: r.spans for r in S.scan_secrets(spark.createDataFrame(
        [*rows, (99, 'the secret is "Ab3dE9fGh1Jk2LmN4b5c6d7e" ok'), (100, None)], "doc_id long, text string"), *model).collect()}
    assert all([s.kind for s in found[i]] == ["assign", "hex"] for i in range(60))
    assert [(s.kind, s.start, s.end) for s in found[99]] == [("field", 15, 39)] and found[100] == []
    assert S.scan_secrets(odd, *S.train(odd)).count() == len(odd_rows())
    assert S.scan_secrets(nothing, *S.train(nothing)).count() == 0


def test_field_against_brute_force():
    import itertools

    import numpy as np

    rng = np.random.default_rng(1)
    scores, ties, lengths = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), np.array([4, 1, 4])
    marginals, _ = crf.forward_backward(scores, lengths, ties)
    labels, at = crf.viterbi(scores, lengths, ties), 0
    for n in lengths:
        ways = list(itertools.product(range(3), repeat=int(n)))
        total = np.array([sum(scores[at + k, w[k]] for k in range(n)) + sum(ties[a, b] for a, b in zip(w, w[1:], strict=False)) for w in ways])
        assert tuple(labels[at:at + n]) == ways[int(total.argmax())]
        p = np.exp(total) / np.exp(total).sum()
        for k in range(n):
            for y in range(3):
                assert abs(marginals[at + k, y] - sum(q for q, w in zip(p, ways, strict=True) if w[k] == y)) < 1e-9
        at += n


def test_rules(odd, nothing, spark):
    rows = R.judge(odd).collect()
    assert len(rows) == len(odd_rows())
    by_id = {}
    for i, t, _ in odd_rows():
        by_id.setdefault(i, []).append(brute_rules(t or ""))
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) in by_id[r.doc_id]
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
    assert R.judge(nothing).count() == 0
    line = "this line of twelve words stands in many documents of the host"
    many = spark.createDataFrame(
        [(i, f"{line} \nown words number {i}", "h") for i in range(30)]
        + [(50, line + "\n" + " ".join(f"u{k}" for k in range(200)), "h"), (51, f"{line}\nown words number 1", "other")]
        + [(60 + i, f"copied words of ten or more in this row here {0}", "h") for i in range(30)],
        "doc_id long, text string, source string")
    verdict = {r.doc_id: r.kept for r in R.judge(many, limit=20).collect()}
    assert not any(verdict[i] for i in range(30)) and verdict[50] and verdict[51]
    assert all(verdict[60 + i] for i in range(30))  # copies of one text are one text
    left = {r.doc_id: r.text for r in R.remove_lines(many, limit=20).collect()}
    assert left[3] == "own words number 3" and left[51].startswith(line)


def brute_rules(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    times = {}
    for g in grams:
        times[g] = times.get(g, 0) + 1
    inside = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside))


def test_rules_stay_in_sql(odd):
    plan = R.judge(odd)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_classifier_on_held_out_labels(spark, sf_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    rows = [r for r in Q.op6_quality_classifier(spark, sf_dir).collect() if r.held_out and r.doc_id in labels]
    assert sum(r.predicted == labels[r.doc_id] for r in rows) >= 0.9 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_classifier_edges(spark, odd, nothing):
    model = Q.train(odd, spark.createDataFrame([(100, 1), (101, 1), (9, 0), (400, 0)], "doc_id long, quality int"))
    rows = Q.score_documents(odd, *model).collect()
    assert len(rows) == len(odd_rows()) and all(0 <= r.score <= 1 for r in rows)
    blank = {r.score for r in rows if not r.text}
    assert len(blank) == 1
    assert Q.score_documents(nothing, *model).count() == 0
    none = Q.train(nothing, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r.score for r in Q.score_documents(odd, *none).collect()} == {0.5}
