"""Secrets in texts by one automaton for all rules.

The rules' patterns are compiled together, read backwards and begun anywhere: one pass over the bytes of a text, from its
end, tells for each byte which rules have a match that starts there. From the first start of a rule its own automaton
runs forward to the longest end, and so on from there: leftmost matches that don't overlap, of each rule. A match is kept
if all of it also fits the rule's second pattern, which holds the lengths asked for; so the common automaton needs no counters
and stays small. Automata are compiled once, by the driver, and go out with the tasks; rows are read where they lie.
"""

from __future__ import annotations

from bisect import bisect_left
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .automaton import Nfa, automaton, run
from .common import pieces

BLOCK = 1 << 22
SPANS = "array<struct<kind: string, start: long, stop: long>>"


class Rule(NamedTuple):
    """Matches of ``pattern`` are of this kind if they also fit ``kept`` (None: all are). any_case: ASCII letters stand for both cases."""

    kind: str
    pattern: str
    kept: str | None = None
    any_case: bool = False


def grown(kind: str, pattern: str, tail: str, least: str, any_case: bool = False) -> Rule:
    """The pattern followed by characters of tail, as many as there are; kept if their number fits ``least``."""
    return Rule(kind, pattern + tail + "+", pattern + tail + least, any_case)


_B64 = "[A-Za-z0-9_-]"
#: The three kinds that callers count, and formats that services document for their keys.
BASE = (
    grown("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?""", "[A-Za-z0-9+/_.=-]", "{8,}", any_case=True),
    grown("access", "AKIA", "[A-Z0-9]", "{12,}"),
    Rule("hex", "[0-9a-f]{32,}"),
)
MORE = (
    grown("session", "ASIA", "[A-Z0-9]", "{16}"),
    grown("github", "gh[oprsu]_", "[A-Za-z0-9]", "{36,}"),
    grown("github_pat", "github_pat_", "[A-Za-z0-9_]", "{22,}"),
    grown("slack", "xox[abeoprs]-", "[A-Za-z0-9-]", "{10,}"),
    grown("google", "AIza", _B64, "{35}"),
    grown("stripe", "[rs]k_(live|test)_", "[0-9A-Za-z]", "{16,}"),
    grown("npm", "npm_", "[A-Za-z0-9]", "{36}"),
    grown("bearer", r"bearer\x20+", "[A-Za-z0-9._~+/-]", "{20,}", any_case=True),
    Rule("jwt", rf"eyJ{_B64}+\.{_B64}+\.{_B64}+", rf"eyJ{_B64}{{8,}}\.{_B64}{{8,}}\.{_B64}{{8,}}"),
    Rule("private_key", "-----BEGIN ([A-Z0-9]+ )*PRIVATE KEY-----"),
    Rule("url", r"[a-z][a-z0-9+.-]*://[^/@:\x00-\x20]+:[^/@:\x00-\x20]+@[A-Za-z0-9]+"),
)
RULES = BASE + MORE


class Scanner:
    """Rules compiled to automata."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.kinds = [r.kind for r in rules]
        if len(rules) > 60 or len(set(self.kinds)) < len(rules):
            raise ValueError("kinds must differ, and be 60 at most")
        self.back = automaton([(Nfa(r.pattern, r.any_case), 1 << i) for i, r in enumerate(rules)], backwards=True, anywhere=True)
        self.ahead = []
        for r in rules:
            dfa = automaton([(Nfa(r.pattern, r.any_case), 1), (Nfa(r.kept or r.pattern, r.any_case), 2)])
            if dfa.tags[0]:
                raise ValueError(f"rule {r.kind} matches an empty text")
            dead = next((s for s in range(len(dfa.tags)) if not dfa.tags[s] and (dfa.step[s] == s).all()), -1)
            self.ahead.append((dfa.kind.tolist(), dfa.step.tolist(), dfa.tags.tolist(), dead))

    def _starts(self, data: np.ndarray) -> dict[int, list[int]]:
        """Rule: sorted starts of its matches. Blocks are read from the last to the first; the state goes on."""
        found, state = [], 0
        for stop in range(len(data), 0, -BLOCK):
            first = max(0, stop - BLOCK)
            states, state = run(self.back, data[first:stop][::-1], state)
            tags = self.back.tags[states]
            hits = np.flatnonzero(tags)[::-1]
            found.append((stop - 1 - hits, tags[hits]))
        if not found:
            return {}
        at, tags = (np.concatenate(x[::-1]) for x in zip(*found))
        return {i: at[tags >> i & 1 == 1].tolist() for i in range(len(self.kinds)) if (tags >> i & 1).any()}

    def _longest(self, rule: int, data: bytes, at: int) -> tuple[int, bool]:
        """(end, kept) of the longest match of a rule that starts at a byte."""
        kind, step, tags, dead = self.ahead[rule]
        state, end, kept = 0, at + 1, False
        for i in range(at, len(data)):
            state = step[state][kind[data[i]]]
            if state == dead:
                break
            if tags[state] & 1:
                end, kept = i + 1, tags[state] & 2 > 0
        return end, kept

    def spans(self, texts: list[bytes | None]) -> list[list[tuple[str, int, int]]]:
        """(kind, start, end) of each text in code points, by start and then kind as the rules come."""
        data = b"\xff".join(t or b"" for t in texts) + b"\xff"  # no rule goes over this byte
        firsts = np.cumsum([0, *(len(t or b"") + 1 for t in texts)])
        out: list[list] = [[] for _ in texts]
        for rule, starts in self._starts(np.frombuffer(data, np.uint8)).items():
            i = 0
            while i < len(starts):
                end, kept = self._longest(rule, data, starts[i])
                if kept:
                    row = int(np.searchsorted(firsts, starts[i], "right")) - 1
                    out[row].append((starts[i] - int(firsts[row]), rule, end - int(firsts[row])))
                i = bisect_left(starts, end, i + 1)
        return [self._in_characters(t or b"", sorted(found)) if found else [] for t, found in zip(texts, out)]

    def _in_characters(self, text: bytes, found: list[tuple[int, int, int]]) -> list[tuple[str, int, int]]:
        places = sorted({x for start, _, end in found for x in (start, end)})
        begins = np.frombuffer(text, np.uint8) & 0xC0 != 0x80  # bytes that begin a character
        chars = np.cumsum([np.count_nonzero(begins[a:b]) for a, b in zip([0, *places], places)]).tolist()
        at = dict(zip(places, chars))
        return [(self.kinds[rule], at[start], at[end]) for start, rule, end in found]


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans) of every row: spans by start, then kind as the rules are listed, in code points, end exclusive.

    Per kind, matches are leftmost, longest and don't overlap; kinds may overlap each other. A match that fails its rule's
    length is dropped, with what it covers. A null or empty text has no spans. Rows that share an id or have none, and
    repeated rows, are scanned one by one; other columns are ignored; an empty table gives an empty table. Texts of any
    length are scanned whole, in blocks of 4 MB.
    """
    scanner = Scanner(rules)
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("stop", pa.int64())]))

    def work(batches):
        for batch in pieces(batches):
            found = scanner.spans(batch.column("b").to_pylist())
            rows = [[{"kind": k, "start": a, "stop": b} for k, a, b in x] for x in found]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, kind)], names=["doc_id", "spans"])

    texts = docs.select("doc_id", F.col("text").cast("binary").alias("b"))
    return texts.mapInArrow(work, f"doc_id {dict(docs.dtypes)['doc_id']}, spans {SPANS}")


def summary(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """find_secrets as one row of counts of the BASE kinds, the hash of their spans, and all spans as text."""
    found = find_secrets(docs, rules)
    names = [r.kind for r in BASE]
    of = lambda *kinds: F.filter("spans", lambda s: s["kind"].isin(*kinds))
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")
    counts = [F.size(of(k)).cast("long").alias(f"n_{k}") for k in names]
    return found.select("doc_id", *counts, F.sha2(text(of(*names)), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"))
