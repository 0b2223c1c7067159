"""Quality classifier from weak labels.

Heuristic labellers vote on every document: good, junk or no vote. Expectation-maximisation over the counts of vote
patterns, of which there are at most 3 to the number of labellers however large the corpus, estimates how often each
labeller is right. The posteriors of a bounded sample then train a linear scorer over hashed word shapes and repetition,
which scores every document. Documents are read three times and never shuffled.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweave.llm.common import arrow_function, sampled_texts, whole_text

#: Documents that train the scorer, its width, words and characters of words that a task remembers between texts, and the
#: score below which a document goes.
TRAIN_DOCS, WIDTH, KEPT_WORDS, KEPT_CHARS, LEAST = 4_000, 1 << 10, 200_000, 8_000_000, 0.5
#: A longer word is judged by how dense its marks are: one for every so many characters counts as one in a short word.
LONG = 40
LABELLERS = ("symbols", "bare marks", "capitals", "repeats", "stutter", "sentences")
_MARKS = frozenset("#$%&*|@^~<>{}[]\\=_+!")
_SYMBOL, _BARE, _CAPITAL, _STOP = 1, 2, 4, 8


class _Kinds(dict):
    """Code point to the kind of its character; marks and other characters are their own kind."""

    def __missing__(self, point: int) -> str:
        c = chr(point)
        kind = self[point] = "a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else "x" if c.isalpha() else c
        return kind


_KINDS, _RUNS = _Kinds(), re.compile(r"(.)\1+", re.S)


def _shape(word: str) -> str:
    """Runs of one kind of character as one, over the whole word: Aa for Word, a# for word###."""
    stem, end = (word[:-1], word[-1]) if word[-1] in ".,;:?!" else (word, "")
    if stem.isalpha():
        if stem.islower():
            return "a" + end
        if stem[1:].islower():
            return "Aa" + end
    return _RUNS.sub(r"\1", word.translate(_KINDS))


def _shape_hash(shape: str) -> int:
    return (zlib.crc32(shape.encode()) % (WIDTH - 32)) << 4


def _long_code(word: str) -> int:
    """A long word's code, from all its characters. Its shape may be as long as itself and isn't remembered."""
    shape, kinds = _shape(word), word.translate(_KINDS)
    marks, plain = sum(map(kinds.count, _MARKS)), sum(map(kinds.count, "aAx0"))
    return (_SYMBOL * (marks * LONG >= len(word)) | _BARE * (plain * LONG < len(word)) | _STOP * (shape[-1] in ".,;:?")
            | _shape_hash(shape))


class Reader:
    """Counts that labellers and scorer go by, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[str, int] = {}
        self.held = 0  # characters in known
        self.shapes: dict[str, int] = {}

    def _shape_code(self, shape: str) -> int:
        if len(self.shapes) > KEPT_WORDS:
            self.shapes.clear()
        kinds = set(shape)
        marks, letters = not kinds.isdisjoint(_MARKS), not kinds.isdisjoint("aAx")
        code = _SYMBOL * marks | _BARE * (not letters and "0" not in kinds) | _STOP * (shape[-1] in ".,;:?")
        code = self.shapes[shape] = code | _shape_hash(shape)
        return code

    def _learn(self, word: str) -> int:
        self.held += len(word)
        if len(word) > LONG:
            code = _long_code(word)
        else:
            shape = _shape(word)
            code = self.shapes.get(shape)
            if code is None:
                code = self._shape_code(shape)
        if word[0].isupper() and len(word) > 1 and word.isupper():
            code |= _CAPITAL
        return code | len(self.known) << 16  # a number of its own until the memory is cleared, which is between texts

    def read(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Shares (one for each labeller, and the number of words), and the number of words of each hashed shape."""
        words = text.split()
        if len(self.known) > KEPT_WORDS or self.held > KEPT_CHARS:
            self.known.clear()
            self.held = 0
        known, learn = self.known, self._learn
        for w in set(words).difference(known):
            known[w] = learn(w)
        code = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        n = len(code)
        shapes = np.bincount((code >> 4) & 0xFFF, minlength=WIDTH)[:WIDTH]
        if not n:
            return np.zeros(len(LABELLERS) + 1), shapes
        name = code >> 16
        three = (name[2:] * 0x9E3779B1 + name[1:-1]) * 0x9E3779B1 + name[:-2]  # wraps round
        three.sort()
        repeats = float((three[1:] == three[:-1]).sum() / len(three)) if len(three) else 0.0
        stutter = float((name[1:] == name[:-1]).mean()) if n > 1 else 0.0
        share = lambda bit: float(((code & bit) > 0).mean())
        return np.array([share(_SYMBOL), share(_BARE), share(_CAPITAL), repeats, stutter, share(_STOP), float(n)]), shapes


#: Share above which a labeller says junk, and below which it says good; ``sentences`` goes the other way round.
RULES = {"symbols": (0.15, 0.05), "bare marks": (0.1, 0.03), "capitals": (0.15, 0.05), "repeats": (0.35, 0.15),
         "stutter": (0.10, 0.03), "sentences": (0.01, 0.04)}


def votes(shares: np.ndarray) -> tuple[int, ...]:
    """1 good, 0 junk, 2 no vote, one for each labeller. Texts under 12 words get votes on marks and capitals only."""
    out, n = [], shares[-1]
    for i, name in enumerate(LABELLERS):
        junk, good = RULES[name]
        if n == 0 or (i > 2 and n < 12):
            out.append(2)
        elif name == "sentences":
            out.append(0 if shares[i] < junk and n >= 30 else 1 if shares[i] > good else 2)
        else:
            out.append(0 if shares[i] > junk else 1 if shares[i] < good else 2)
    return tuple(out)


class LabelModel:
    """How often each labeller says what of good and of junk documents, and how many are good."""

    def __init__(self, patterns: dict[tuple[int, ...], int], rounds: int = 100):
        keys = sorted(patterns)
        p = np.array(keys or [(2,) * len(LABELLERS)])
        n = np.array([patterns[k] for k in keys] or [1], float)
        good, junk = (p == 1).sum(axis=1), (p == 0).sum(axis=1)
        post = np.clip((good + 1) / (good + 2 * junk + 2), 0.02, 0.98)  # a junk vote weighs two at the start
        for _ in range(rounds):
            self.prior = float(np.clip((n * post).sum() / n.sum(), 0.05, 0.99))
            weight = np.stack([n * (1 - post), n * post])  # class by pattern
            self.says = np.empty((2, len(LABELLERS), 3))
            for v in range(3):
                self.says[:, :, v] = weight @ (p == v) + 0.5
            self.says /= self.says[:, :, :2].sum(axis=2, keepdims=True)
            self.says[:, :, 2] = 1  # no vote says nothing
            post, before = self.posterior(p), post
            if np.abs(post - before).max() < 1e-9:
                break

    def posterior(self, p: np.ndarray) -> np.ndarray:
        """Probability of good for rows of votes."""
        log = np.log(self.says[:, np.arange(len(LABELLERS)), p]).sum(axis=2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(log[0] - log[1], -500, 500)))


def features(shares: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Shares of the hashed shapes on a root scale, and of what no single word shows in the last places."""
    out = np.sqrt(shapes / max(1.0, shares[-1]))
    out[-7:] = [1.0, *np.sqrt(shares[:-1])]
    return out


def train_scorer(x: np.ndarray, y: np.ndarray, rounds: int = 250) -> np.ndarray:
    """Logistic regression on probabilities ``y``."""
    x, y = x.astype(np.float32), y.astype(np.float32)
    w, first, second = (np.zeros(x.shape[1], np.float32) for _ in range(3))
    for step in range(1, rounds + 1):
        g = (1 / (1 + np.exp(-(x @ w))) - y) @ x / max(1, len(x)) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * g, 0.999 * second + 0.001 * g * g
        w = (w - 0.1 * (first / (1 - 0.9 ** step)) / (np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)).astype(np.float32)
    return w.astype(np.float64)


def _pattern_counter():
    reader = Reader()

    def step(batch):
        found: dict[tuple[int, ...], int] = {}
        for text in batch.column(0):
            v = votes(reader.read(text.as_py() or "")[0])
            found[v] = found.get(v, 0) + 1
        yield pa.RecordBatch.from_pydict(
            {"votes": list(map(list, found)), "n": list(found.values())},
            schema=pa.schema([("votes", pa.list_(pa.int32())), ("n", pa.int64())]))

    return step


def _featurer():
    reader = Reader()

    def step(batch):
        both = [reader.read(text.as_py() or "") for text in batch.column(0)]
        yield pa.RecordBatch.from_pydict(
            {"votes": [list(votes(s)) for s, _ in both], "x": [features(*b).astype(np.float32).tobytes() for b in both],
             "copies": batch.column(1)},
            schema=pa.schema([("votes", pa.list_(pa.int32())), ("x", pa.binary()), ("copies", pa.int32())]))

    return step


class Classifier:
    def __init__(self, labels: LabelModel, weights: np.ndarray):
        self.labels, self.weights = labels, weights


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Classifier:
    """Label model from the votes on all documents; scorer from about ``train_docs``, chosen by a hash of doc_id and text."""
    texts = whole_text(docs)
    counted = texts.select("text").mapInArrow(arrow_function(_pattern_counter), "votes array<int>, n long")
    patterns = {tuple(r["votes"]): r["n"] for r in counted.groupBy("votes").agg(F.sum("n").alias("n")).collect()}  # 3 ** 6 at most
    labels = LabelModel(patterns)
    chosen = sampled_texts(texts, train_docs)
    rows = sorted(chosen.mapInArrow(arrow_function(_featurer), "votes array<int>, x binary, copies int").collect())
    if not rows:
        return Classifier(labels, np.zeros(WIDTH))
    x, v = np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.array([r["votes"] for r in rows])
    x, v = (np.repeat(a, [r["copies"] for r in rows], axis=0) for a in (x, v))
    return Classifier(labels, train_scorer(x, labels.posterior(v)))


def _scorer(model: Classifier, at: int):
    reader = Reader()

    def step(batch):
        found = []
        for text in batch.column(at):
            shares, shapes = reader.read(text.as_py() or "")
            v = votes(shares)
            score = 1 / (1 + np.exp(-float(features(shares, shapes) @ model.weights)))
            found.append((list(v), float(model.labels.posterior(np.array([v]))[0]), score))
        columns = list(zip(*found, strict=True)) or [[]] * 3
        added = [pa.array(columns[0], pa.list_(pa.int32())), pa.array(columns[1], pa.float64()), pa.array(columns[2], pa.float64())]
        yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, "votes__", "posterior__", "score__"])

    return step


def score(docs: DataFrame, model: Classifier) -> DataFrame:
    """Adds votes__, posterior__ (label model) and score__ (scorer; 1 is good) to every row; null text counts as empty."""
    docs = docs.drop("votes__", "posterior__", "score__")
    schema = T.StructType([*docs.schema.fields, T.StructField("votes__", T.ArrayType(T.IntegerType())),
                           T.StructField("posterior__", T.DoubleType()), T.StructField("score__", T.DoubleType())])
    return docs.mapInArrow(arrow_function(_scorer, model, docs.columns.index("text")), schema)


def classify(docs: DataFrame) -> DataFrame:
    """doc_id, votes, posterior, score and kept, one row per row of ``docs``.

    A document goes if its score is below LEAST. Texts without words get no votes and stay, as nothing speaks against them.
    Repeated rows are scored alike; other columns play no part; an empty table gives an empty one.
    """
    texts = whole_text(docs)
    scored = score(texts, train(texts))
    return scored.select(
        "doc_id", F.array_join(F.col("votes__").cast("array<string>"), ",").alias("votes"), F.col("posterior__").alias("posterior"),
        F.col("score__").alias("score"), _kept().alias("kept"))


def _kept():
    return (F.col("score__") >= LEAST) | F.forall("votes__", lambda v: v == 2)


def keep_good(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that ``classify`` keeps, with all their columns."""
    return score(docs, train(docs)).filter(_kept()).select(docs.columns)
