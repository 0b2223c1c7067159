"""Secret scans: fixed patterns, and character Markov models for secrets that follow none.

Two first-order models over characters, one of random strings and one of ordinary identifiers, are trained from labelled
samples: values that the patterns find and strings drawn from a seed on one side, words of the corpus and identifiers built
from them on the other. A run of key characters, or a stretch of one, is a secret when the log-likelihood ratio of the models
is high enough.
Scanning is by documents; nothing is shuffled.
"""

from __future__ import annotations

import itertools
import random
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import arrow_function, sampled_texts, whole_text

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{12,}"), re.compile(r"[0-9a-f]{32,}")
#: Every text that ASSIGN matches holds one of these in lower case.
_HINTS = ("passw", "secret", "token", "api")
KINDS = ("assign", "access", "hex", "markov")
#: Shortest run that the models judge; each ACCESS and HEX match lies in one run.
SHORTEST = 16
RUN = re.compile(rf"[A-Za-z0-9+/_=-]{{{SHORTEST},}}")
SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SEPARATORS = frozenset("+/_=-")
#: Documents that the training sample is bounded by, strings drawn for each alphabet, and the log-likelihood ratio, whole and
#: for each character, from which a run or a stretch of it is a secret.
SAMPLE_DOCS, DRAWN, LEAST, LEAST_EACH = 500, 1_500, 14.0, 0.55


class Markov:
    """Log probability of each character after the one before; row 0 stands for the start."""

    def __init__(self, samples):
        self.place = {c: i + 1 for i, c in enumerate(SYMBOLS)}
        counts = np.full((len(SYMBOLS) + 1, len(SYMBOLS) + 1), 0.2)
        for text in samples:
            row = 0
            for c in text:
                to = self.place.get(c)
                if to is None:
                    row = 0
                    continue
                counts[row, to] += 1
                row = to
        self.log = np.log(counts / counts.sum(axis=1, keepdims=True))


class Judge:
    def __init__(self, random_model: Markov, plain_model: Markov):
        self.place = random_model.place
        self.ratio = (random_model.log - plain_model.log).tolist()

    def ratio_of(self, run: str) -> float:
        place, ratio, row, total = self.place, self.ratio, 0, 0.0
        for c in run:
            to = place[c]
            total += ratio[row][to]
            row = to
        return total

    def secret(self, run: str) -> bool:
        return (total := self.ratio_of(run)) >= LEAST and total >= LEAST_EACH * len(run)

    def secrets(self, run: str) -> list[tuple[int, int]]:
        """Places of the secrets in a run: all of it, or else its stretches that reach LEAST and LEAST_EACH.

        Stretches are the run's maximal sums of the ratio less LEAST_EACH (Ruzzo and Tompa, in linear time), so neither a key
        or path before a secret nor one behind it counts against it. They are widened to the nearest separators.
        """
        if run.isdigit():
            return []
        if self.secret(run):
            return [(0, len(run))]
        place, ratio, row, total, open_, done = self.place, self.ratio, 0, 0.0, [], []
        for i, c in enumerate(run):
            to = place[c]
            step = ratio[row][to] - LEAST_EACH
            row, total, low = to, total + step, total
            if step <= 0:
                continue
            start = i
            while True:
                while open_ and open_[-1][2] >= low:
                    done.append(open_.pop())  # no later stretch joins one that begins higher
                if not open_ or open_[-1][3] >= total:
                    break
                start, _, low, _ = open_.pop()
                while done and done[-1][0] >= start:
                    done.pop()
            open_.append((start, i + 1, low, total))
        found = []
        for start, end, low, high in sorted(done + open_):
            if high - low + LEAST_EACH * (end - start) < LEAST or (found and end <= found[-1][1]):
                continue
            while start and run[start - 1] not in SEPARATORS and (not found or start > found[-1][1]):
                start -= 1
            while end < len(run) and run[end] not in SEPARATORS:
                end += 1
            if found and start <= found[-1][1]:
                found[-1] = (found[-1][0], max(end, found[-1][1]))
            else:
                found.append((start, end))
        return [(a, b) for a, b in found if b - a >= SHORTEST and not run[a:b].isdigit()]


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of what the fixed patterns find."""
    found = []
    low = text.lower()
    if any(h in low for h in _HINTS) or not low.isascii():
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    for run in RUN.finditer(text):
        a, b = run.span()
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text, a, b)]
        found += [(m.start(), 2, m.end()) for m in HEX.finditer(text, a, b)]
    return sorted(found)


def all_spans(text: str, judge: Judge, base) -> list[tuple[int, int, int]]:
    """The fixed patterns' spans and what the models add: secrets in what those spans leave of each run."""
    ends, found = [], []
    for x, _, y in base:  # sorted by start
        if ends and x <= ends[-1][1]:
            ends[-1] = (ends[-1][0], max(y, ends[-1][1]))
        else:
            ends.append((x, y))
    at = 0
    for run in RUN.finditer(text):
        a, b = run.span()
        while at < len(ends) and ends[at][1] <= a:
            at += 1
        while at < len(ends) and ends[at][0] < b:
            x, y = ends[at]
            if x - a >= SHORTEST:
                found += [(a + i, 3, a + j) for i, j in judge.secrets(text[a:x])]
            a = y
            if y > b:
                break
            at += 1
        if b - a >= SHORTEST:
            found += [(a + i, 3, a + j) for i, j in judge.secrets(text[a:b])]
    return sorted([*base, *found])


def _read(text: str) -> tuple[set[str], set[str]]:
    """Values that the fixed patterns find in a text, and its words outside of their spans."""
    spans, words, at = base_spans(text), set(), 0
    values = {m[2] for m in ASSIGN.finditer(text) if len(m[2]) >= 8} | {text[a:b] for a, kind, b in spans if kind}
    for a, _, b in [*spans, (len(text), 0, len(text))]:
        words.update(w for w in re.findall(r"[A-Za-z][A-Za-z_-]+", text[at:max(a, at)]) if len(w) > 2)
        at = max(at, b)
    return values, words


def _samples(values: set[str], words: set[str]) -> tuple[list[str], list[str]]:
    """Random strings and ordinary identifiers from what the sampled texts give and a seed."""
    draw = random.Random(17)
    alphabets = (SYMBOLS[:64], SYMBOLS[:62], SYMBOLS[26:36] + SYMBOLS[52:62], SYMBOLS[26:32] + SYMBOLS[52:62], SYMBOLS[:26] + SYMBOLS[52:62])
    drawn = ["".join(draw.choices(a, k=draw.randrange(16, 65))) for a in alphabets for _ in range(DRAWN)]
    plain = sorted(words) or ["name", "value", "index", "number"]
    built = []
    for sep, make in itertools.product(("_", "-", "", "/", "+"), (str.lower, str.upper, str.capitalize)):
        built += [sep.join(make(w) for w in draw.choices(plain, k=draw.randrange(2, 5))) + draw.choice(("", "1", "2024", "_id", "=")) for _ in range(DRAWN)]
    built += [str(draw.randrange(10 ** 6, 10 ** 19)) for _ in range(DRAWN // 10)] + ["=" * 40, "-" * 40, "_" * 40, "+" * 40, "/" * 40]
    return sorted(values) + drawn, plain + [w.upper() for w in plain] + built


def _labelled(texts: list[str]) -> tuple[list[str], list[str]]:
    found = [_read(text) for text in texts]
    return _samples(set().union(*(v for v, _ in found)), set().union(*(w for _, w in found)))


def _reader():
    def step(batch):
        values, words = set(), set()
        for text in batch.column(0):
            v, w = _read(text.as_py())
            values |= v
            words |= w
        yield pa.RecordBatch.from_pydict(
            {"value": [True] * len(values) + [False] * len(words), "found": [*values, *words]},
            schema=pa.schema([("value", pa.bool_()), ("found", pa.string())]))

    return step


def sampled(docs: DataFrame) -> tuple[set[str], set[str]]:
    """Values and words of the whole texts of about SAMPLE_DOCS documents, chosen by a hash of doc_id and text."""
    chosen = sampled_texts(whole_text(docs), SAMPLE_DOCS).select("text")
    found = chosen.mapInArrow(arrow_function(_reader), "value boolean, found string").distinct().collect()
    return {r["found"] for r in found if r["value"]}, {r["found"] for r in found if not r["value"]}


def train(docs: DataFrame) -> Judge:
    """Models from the values and words of about SAMPLE_DOCS documents and what is drawn and built beside them."""
    drawn, plain = _samples(*sampled(docs))
    return Judge(Markov(drawn), Markov(plain))


def _scanner(judge: Judge):
    def step(batch):
        docs, texts, rows = batch.column(0), batch.column(1), []
        for value in texts:
            text = value.as_py() or ""
            base = base_spans(text)
            name = lambda s: [f"{KINDS[k]}:{a}:{b}" for a, k, b in s]
            kinds = [k for _, k, _ in base]
            rows.append((*(kinds.count(k) for k in range(3)), ",".join(name(base)), ",".join(name(all_spans(text, judge, base)))))
        columns = list(zip(*rows, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays(
            [docs, *[pa.array(c, pa.int64()) for c in columns[:3]], *[pa.array(c, pa.string()) for c in columns[3:]]],
            names=["doc_id", "n_assign", "n_access", "n_hex", "base", "spans"])

    return step


def scan_secrets(docs: DataFrame, judge: Judge | None = None) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base and spans (kind:start:end by start and kind), one row per row of ``docs``.

    Places are code points, the end is exclusive. Null counts as empty and has no span. Other columns play no part;
    repeated rows are scanned alike. Without a judge, one is trained from ``docs``.
    """
    judge = judge or train(docs)
    return whole_text(docs).mapInArrow(
        arrow_function(_scanner, judge), "doc_id long, n_assign long, n_access long, n_hex long, base string, spans string")


def secret_report(docs: DataFrame) -> DataFrame:
    return scan_secrets(docs).select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base", 256).alias("base_sha256"), "spans")
