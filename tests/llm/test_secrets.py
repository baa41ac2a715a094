"""The automaton and the secret scan, against Python's regular expressions."""

import hashlib
import random
import re

import numpy as np
import pytest

from readqc.llm import secret_scan
from readqc.llm.automaton import Nfa, automaton, run
from readqc.llm.secret_scan import BASE, RULES, Rule, Scanner

DATA = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def scanner():
    return Scanner()


def plain(text, rules=RULES):
    """Spans of a text (bytes) in code points by regular expressions, rule by rule."""
    found = []
    for i, r in enumerate(rules):
        flags = re.I if r.any_case else 0
        for m in re.finditer(r.pattern.encode(), text, flags):
            if r.kept is None or re.fullmatch(r.kept.encode(), m[0], flags):
                found.append((m.start(), i, m.end()))
    return [(rules[i].kind, len(text[:a].decode()), len(text[:b].decode())) for a, i, b in sorted(found)]


def plain_row(doc_id, text):
    """The query's row as its contract words it, with the base rules written out."""
    text = text or ""
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    base = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 8]
    base += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    base += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    said = ",".join(f"{BASE[k].kind}:{a}:{b}" for a, k, b in sorted(base))
    return (doc_id, *(sum(k == i for _, k, _ in base) for i in range(3)), hashlib.sha256(said.encode()).hexdigest())


WORDS = (
    ["password", "PassWd", "secret", "token", "api_key", "ApiKey", " ", "  ", ":", "=", '"', "'", "AKIA", "AKIAIOSFODNN7", "ASIA", "0123456789abcdef", "deadbeef", "x", "Zz9_", ".", "é", "\U0001f600", "\n", "\x00"]
    + ["eyJhbGciOi", "eyJ", "ghp_", "xoxb-", "AIza", "sk_live_", "Bearer ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "https://", "user:pw@host", "@", "/", "npm_", "github_pat_", "abcdefghijklmnop", "ABCDEFGHIJKLMNOP1234"]
)


def test_scanner_on_random_texts(scanner):
    rng = random.Random(1)
    for _ in range(30):
        texts = ["".join(rng.choice(WORDS) for _ in range(rng.choice([0, 3, 30, 300]))).encode() for _ in range(40)]
        assert scanner.spans(texts) == [plain(t) for t in texts]


def test_failing_matches_hide_what_they_cover(scanner):
    """A match that is too short is dropped, but the search goes on after it, not within it."""
    assert scanner.spans([b"token=token: abcdefghij"]) == [[]]
    assert scanner.spans([b"token=abc token: abcdefghij"]) == [[("assign", 10, 27)]]
    assert scanner.spans([b"AKIA0 AKIAAKIAAKIAAKIA"]) == [[("access", 6, 22)]]
    assert scanner.spans(["é token='ſecret-ſecret' toKen=abcdefgh".encode()]) == [[("assign", 24, 38)]]  # no case beyond ASCII


@pytest.mark.parametrize("kind, text", [
    ("github", "ghp_" + "z1" * 18), ("github_pat", "github_pat_" + "A_b" * 8), ("slack", "xoxb-1234-abcdefgh"), ("google", "AIza" + "b-_Y1" * 7), ("stripe", "sk_live_" + "q7" * 8),
    ("npm", "npm_" + "Ab3" * 12), ("bearer", "BEARER abcdefghij.klmnopqrst"), ("jwt", "eyJhbGciOiJI.eyJzdWIiOiIx.c2lnbmF0dXJl"), ("private_key", "-----BEGIN RSA PRIVATE KEY-----"), ("url", "postgres://admin:hunter2@db1"), ("session", "ASIA" + "B2" * 8),
])
def test_further_kinds(scanner, kind, text):
    found = scanner.spans([f"a {text}\nb {text[:-9]}".encode()])[0]
    assert found[0] == (kind, 2, 2 + len(text)) and len(found) == 1


def test_automaton_equals_regular_expressions():
    """Minimal automata of small patterns accept what Python's patterns match in full, forwards and backwards."""
    rng = random.Random(2)
    for pattern in ["a|bc*", "(ab|a)(b?c){2,3}", "[^ab]{2}a*", "(a|b)*abb", "a{0,2}b{2}", r"\x61\.[c-]+|(b|)c", "(a*b*)+c", "(a?b)?c"]:
        ahead, back = automaton([(Nfa(pattern), 1)]), automaton([(Nfa(pattern), 1)], backwards=True)
        for _ in range(400):
            text = "".join(rng.choice("abc.-") for _ in range(rng.randrange(1, 8))).encode()
            want = re.fullmatch(pattern.encode(), text) is not None
            for dfa, data in ((ahead, text), (back, text[::-1])):
                assert (dfa.tags[run(dfa, np.frombuffer(data, np.uint8))[1]] == 1) == want, (pattern, text)
    assert len(automaton([(Nfa("(a|b)*abb"), 1)]).tags) == 5  # four states, and the dead one for other bytes
    for wrong in ("(ab", "a)", "[é]"):
        with pytest.raises((ValueError, IndexError)):
            Nfa(wrong)
    with pytest.raises(ValueError):
        Scanner((Rule("x", "a*"),))


def test_lanes_and_blocks(scanner, monkeypatch):
    """Pieces that step together give the states of one long run, also where a state lasts over many pieces and blocks."""
    dfa, rng = scanner.back, np.random.default_rng(0)
    for data in (rng.integers(0, 255, 70_000), np.frombuffer(b"." + b"eyJab" * 9000 + b".x." + b"0" * 9000, np.uint8), rng.choice(np.frombuffer(b'token= "AKIA09af.', np.uint8), 50_000)):
        data, state, want = np.asarray(data, np.uint8), 0, []
        for b in data.tolist():
            state = int(dfa.step[state, dfa.kind[b]])
            want.append(state)
        got, last = run(dfa, data)
        assert got.tolist() == want and last == state
    text = ("é token = " + "ab" * 5000 + " ").encode() * 3
    monkeypatch.setattr(secret_scan, "BLOCK", 1000)
    assert scanner.spans([text, None, b"", text]) == [plain(text), [], [], plain(text)]


def test_query_rows(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = docs.collect()
    out = secret_scan.summary(docs).collect()
    assert sorted(tuple(r)[:5] for r in out) == sorted(plain_row(r.doc_id, r.text) for r in rows)
    texts = {r.doc_id: r.text for r in rows}
    assert all(r.spans == ",".join(f"{k}:{a}:{b}" for k, a, b in plain((texts[r.doc_id] or "").encode())) for r in out)
    assert sum(r.n_assign + r.n_hex for r in out) > 0


def test_odd_rows(spark):
    """Null and empty texts, shared and null ids, repeated rows, a long text, clashing names, an empty table."""
    long = "word " * 60_000 + "secret: " + "A" * 70_000
    rows = [(1, None), (2, ""), (None, "token=abcdefgh"), (3, "token=abcdefgh"), (3, "token=abcdefgh"), (3, "AKIA" + "B" * 12), (4, long)]
    docs = spark.createDataFrame([(i, t, "x", "y", "z") for i, t in rows], "doc_id long, text string, b string, spans string, kind string")
    out = secret_scan.summary(docs).collect()
    assert sorted((tuple(r)[:5] for r in out), key=str) == sorted((plain_row(i, t) for i, t in rows), key=str)
    assert [r.spans for r in out if r.doc_id == 4] == [f"assign:300000:{300_008 + 70_000}"]
    assert secret_scan.summary(docs.limit(0)).count() == 0
