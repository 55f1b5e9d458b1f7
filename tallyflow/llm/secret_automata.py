"""Secrets by grammar inference: probabilistic automata of credential formats.

Credentials with a known shape (``BASE``) are found by their patterns.  A bounded sample of them is the labelled set:
their characters become classes, the class strings become a prefix tree with counts, and states whose futures are
statistically compatible (Hoeffding bound, red-blue order) are merged until none is left to merge.  A second automaton is
learned from long ordinary tokens in the same way.  Every candidate token is scored by the log-likelihood ratio of both
automata per character.  One in ``HELD_OUT`` of either sample does not teach but sets the threshold: credentials there
stand without the keyword that betrayed them, and the threshold is where they and ordinary tokens are told apart best.
Candidates from there on are reported besides the base spans.

The texts are read once: base spans and candidates leave it as small rows, which learning and scoring work on.

Defined cases: a null text is an empty one and has no spans; null ids, repeated rows and ties come out row by row; if
nothing or too little is labelled (fewer than ``ENOUGH`` distinct credentials or ordinary tokens) nothing is added to
the base spans; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyflow.llm.common import checkpointed, received, ship, small_batches

#: Base kinds in the order in which equal starts are listed: pattern, the group that is the credential, least length.
BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    "access": (r"AKIA[A-Z0-9]+", 0, 18),
    "hex": (r"[0-9a-f]+", 0, 16),
}
#: The kind of what the automata add.
ADDED = "format"
#: Distinct credentials, and distinct ordinary tokens, that are learned from at most and at least.
SAMPLE, ENOUGH = 800, 20
#: Bound on chance agreement when two states are compared.
ALPHA = 0.05
#: One in so many labelled words sets the threshold and does not teach.
HELD_OUT = 4
#: As long as the shortest credential that a keyword gives away.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=.-]{12,}")
KEYWORDS = ("password", "passwd", "secret", "token", "api_key", "apikey")


def base_spans(text: str) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, credential) of every base match, leftmost first within a kind; failing matches are dropped."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= BASE["assign"][2]:
                out.append(("assign", m.start(), m.end(), m[2]))
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if len(m[0]) >= BASE["access"][2]:
                out.append(("access", m.start(), m.end(), m[0]))
    for m in HEX.finditer(text):
        out.append(("hex", m.start(), m.end(), m[0]))
    return out


ASSIGN = re.compile(BASE["assign"][0], re.ASCII | re.IGNORECASE)
ACCESS = re.compile(BASE["access"][0])
HEX = re.compile(rf"(?<![0-9a-f])[0-9a-f]{{{BASE['hex'][2]},}}")  # greedy from a run's start: the runs that are long enough


def candidates(text: str, taken: list[tuple[str, int, int, str]]) -> Iterator[tuple[int, int, str]]:
    """Long unbroken tokens that no base span touches."""
    for m in CANDIDATE.finditer(text):
        start, end = m.span()
        word = m[0].rstrip(".-=_/+") or m[0]
        if all(end <= s or start >= e for _, s, e, _ in taken):
            yield start, start + len(word), word


def classes(word: str) -> str:
    return "".join(
        "0" if c.isdigit() else ("h" if c <= "f" else "l") if c.islower() else ("H" if c <= "F" else "U") if c.isupper() else c
        for c in word
    )


class Automaton:
    """A probabilistic automaton over class characters, inferred from strings.  The end of a string is the symbol ""."""

    def __init__(self, words: list[str]) -> None:
        self.next: list[dict[str, int]] = [{}]
        self.count: list[dict[str, int]] = [{}]
        for word in words:
            state = 0
            for symbol in word:
                self.count[state][symbol] = self.count[state].get(symbol, 0) + 1
                if symbol not in self.next[state]:
                    self.next[state][symbol] = len(self.next)
                    self.next.append({})
                    self.count.append({})
                state = self.next[state][symbol]
            self.count[state][""] = self.count[state].get("", 0) + 1
        self.alphabet = len({s for c in self.count for s in c} | {""}) + 1
        self.infer()

    def infer(self) -> None:
        """Red states are final; a blue state (child of a red one) is merged into the first compatible red one or becomes
        red itself."""
        red, blue = [0], sorted(self.next[0].values())
        while blue:
            state = blue.pop(0)
            parent, symbol = next((r, s) for r in red for s, t in sorted(self.next[r].items()) if t == state)
            for other in red:
                if self.compatible(other, state):
                    self.next[parent][symbol] = other
                    self.fold(other, state)
                    break
            else:
                red.append(state)
            known = set(red)
            blue = sorted({t for r in red for t in self.next[r].values()} - known)

    def compatible(self, a: int, b: int) -> bool:
        todo = [(a, b)]
        while todo:
            a, b = todo.pop()
            n, m = sum(self.count[a].values()), sum(self.count[b].values())
            if not n or not m:
                continue
            bound = math.sqrt(0.5 * math.log(2 / ALPHA)) * (1 / math.sqrt(n) + 1 / math.sqrt(m))
            for symbol in self.count[a].keys() | self.count[b].keys():
                if abs(self.count[a].get(symbol, 0) / n - self.count[b].get(symbol, 0) / m) > bound:
                    return False
            # Below a state of few strings the bound lets everything pass, so the comparison ends there.
            if min(n, m) > 2:
                todo.extend((self.next[a][s], t) for s, t in self.next[b].items() if s in self.next[a])
        return True

    def fold(self, into: int, tree: int) -> None:
        todo = [(into, tree)]
        while todo:
            into, tree = todo.pop()
            for symbol, n in self.count[tree].items():
                self.count[into][symbol] = self.count[into].get(symbol, 0) + n
            for symbol, target in self.next[tree].items():
                if symbol in self.next[into]:
                    todo.append((self.next[into][symbol], target))
                else:
                    self.next[into][symbol] = target

    def log_likelihood(self, word: str) -> float:
        """Natural logarithm, smoothed so that unseen symbols are unlikely but possible; a string that leaves the
        automaton goes on from its start."""
        state, total = 0, 0.0
        for symbol in [*word, ""]:
            counts = self.count[state]
            total += math.log((counts.get(symbol, 0) + 0.1) / (sum(counts.values()) + 0.1 * self.alphabet))
            state = self.next[state].get(symbol, 0)
        return total


def best_threshold(credentials: list[float], ordinary: list[float]) -> tuple[float, float, float]:
    """(threshold, recall, precision) of the best F1 over held-out scores; of equal ones the middle of the range."""
    scores = sorted({*credentials, *ordinary})
    cuts = [scores[0] - 1, *((a + b) / 2 for a, b in zip(scores, scores[1:])), scores[-1] + 1]

    def rated(cut: float) -> tuple[float, float]:
        hits, wrong = sum(x >= cut for x in credentials), sum(x >= cut for x in ordinary)
        return hits / len(credentials), hits / max(1, hits + wrong)

    f1 = lambda x: 2 * x[0] * x[1] / (x[0] + x[1] or 1)
    best = max(f1(rated(c)) for c in cuts)
    tied = [c for c in cuts if f1(rated(c)) == best]
    return tied[len(tied) // 2], *rated(tied[len(tied) // 2])


class Formats:
    """Scores candidates: credential automaton against ordinary one, with a threshold from held-out words."""

    def __init__(self, credentials: list[str], ordinary: list[str]) -> None:
        held = lambda w: zlib.crc32(w.encode()) % HELD_OUT == 0
        teach = [[w for w in words if not held(w)] for words in (credentials, ordinary)]
        apart = [[w for w in words if held(w)] for words in (credentials, ordinary)]
        self.ready = min(map(len, teach)) >= ENOUGH and min(map(len, apart)) > 0
        if self.ready:
            self.credential, self.ordinary = (Automaton([classes(w) for w in words]) for words in teach)
            self.threshold, self.recall, self.precision = best_threshold(*([self.score(w) for w in words] for words in apart))

    def score(self, word: str) -> float:
        form = classes(word)
        return (self.credential.log_likelihood(form) - self.ordinary.log_likelihood(form)) / (len(form) + 1)

    def reports(self, word: str) -> bool:
        return self.ready and self.score(word) >= self.threshold


SPAN = "array<struct<kind: string, start: bigint, end: bigint, word: string>>"


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("word", pa.string())])
    for batch in batches:
        base, more = [], []
        for text in batch.column(1).to_pylist():
            found = base_spans(text or "")
            base.append([dict(zip(("kind", "start", "end", "word"), x)) for x in found])
            more.append([{"kind": ADDED, "start": s, "end": e, "word": w} for s, e, w in candidates(text or "", found)])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(base, pa.list_(span)), pa.array(more, pa.list_(span))], ["id", "base", "more"]
        )


def _sample(words: DataFrame) -> list[str]:
    """At most SAMPLE distinct words, those of least hash."""
    return [r["word"] for r in words.select("word").distinct().orderBy(F.xxhash64("word"), "word").limit(SAMPLE).collect()]


def fit(found: DataFrame) -> Formats:
    """Learn from (base, more) rows: base credentials against candidates that are letters only or hold no digit."""
    credentials = found.select(F.explode("base.word").alias("word"))
    words = found.select(F.explode("more.word").alias("word"))
    return Formats(_sample(credentials), _sample(words.where(~F.col("word").rlike("[0-9]"))))


def spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, base, added, spans = both): arrays of (kind, start, end, word), by start and then kind as listed.

    Places count code points, the end is exclusive.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    found = checkpointed(
        docs.select(F.col(id_col).alias("id"), text).mapInArrow(_found, f"id {kind}, base {SPAN}, more {SPAN}")
    )
    shared = ship(docs.sparkSession, fit(found))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        formats = received(shared)
        for batch in batches:
            more = [
                [x for x in row if formats.reports(x["word"])] if row else [] for row in batch.column(2).to_pylist()
            ]
            column = pa.array(more, batch.schema.field(2).type)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), column], ["id", "base", "added"])

    rank = {kind: k for k, kind in enumerate([*BASE, ADDED])}
    scored = found.mapInArrow(run, f"id {kind}, base {SPAN}, added {SPAN}")
    order = F.create_map(*[F.lit(x) for pair in rank.items() for x in pair])

    def listed(a, b):
        key = lambda x: F.struct(x["start"], order[x["kind"]])
        return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

    return scored.select(
        "id",
        F.array_sort("base", listed).alias("base"),
        "added",
        F.array_sort(F.concat("base", "added"), listed).alias("spans"),
    )
