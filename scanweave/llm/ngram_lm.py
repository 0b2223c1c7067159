"""Language-model scoring with an Elias-Fano n-gram trie of two levels.

Level one holds the words: their sorted hashes, whose places are the words' numbers, and running sums of their counts, both
as monotone sequences. Level two holds, for every context, its successors: pointers to each context's range, the successors
made monotone by their context's place, and quantised logarithms of smoothed probabilities and of back-off weights. Levels
are cut into files of bounded size in the folder that driver and executors share; tasks map the files that their questions
touch and look up successors within the context's range.

Counting combines within tasks; counts travel as Elias-Fano sequences to the file they belong to, and a hot context is cut
over several files. Smoothing is interpolated absolute discounting: ``p(w|u) = max(c(u,w) - D, 0) / c(u) + D n(u) / c(u)
p(w)`` with the add-half unigram p(w), n(u) the successors of u, and D from the number of pairs seen once and twice.
A word's hash is 63 bits; two words with one hash would count as one.
"""

from __future__ import annotations

import bisect

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import arrow_function, stored, whole_text
from scanweave.llm.elias_fano import EliasFano, Folder, from_bytes, to_bytes
from scanweave.sources.tables import work_folder

#: Words and pairs in a file, words and pairs that a task remembers, tokens that it handles at a time, steps of a factor of ten.
FILE_WORDS, FILE_PAIRS, KEPT_WORDS, KEPT_PAIRS, TOKENS_AT_ONCE, STEPS = 1 << 20, 1 << 21, 300_000, 2_000_000, 1_000_000, 4096
#: The end of a text, which is also the context of its first word.
END = 0


def held_out() -> Column:
    """Whether a row's doc_id keeps it from training; null ids train."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 1, F.lit(False))


class Tokens:
    """Texts as arrays of numbers that stand for words in this task, each text with its end; ``hashes`` has each number's hash.

    Memory is bounded: a caller asks ``full`` before it reads, and calls ``forget`` when it has used what it kept by number.
    """

    def __init__(self):
        self.forget()

    def forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.hashes = np.array([END], np.int64)  # number 0

    def full(self) -> bool:
        return len(self.known) > KEPT_WORDS

    def read(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of all tokens, and how many tokens each text has."""
        parts, sizes, known, new = [], [], self.known, []
        for text in texts:
            words = text.lower().split()  # bytes: A-Z only, and blank and tab to carriage return only
            for w in set(words).difference(known):
                known[w] = len(self.hashes) + len(new)
                new.append((xxhash.xxh3_64_intdigest(w) >> 1) or 1)
            parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            parts.append(np.array([0]))
            sizes.append(len(words) + 1)
        self.hashes = np.concatenate([self.hashes, np.array(new, np.int64)])
        return np.concatenate(parts) if parts else np.empty(0, np.int64), np.array(sizes, np.int64)


def _groups(batch, at: int):
    """Texts of a batch as bytes, in runs of bounded size, with their places."""
    texts, start, size = batch.column(at).cast(pa.binary()), 0, 0
    run = []
    for i in range(len(texts)):
        text = texts[i].as_py() or b""
        run.append(text)
        size += len(text)
        if size > 5 * TOKENS_AT_ONCE:
            yield start, run
            start, run, size = i + 1, [], 0
    if run:
        yield start, run


def _count_words(batches):
    tokens, count = Tokens(), np.zeros(1, np.int64)

    def flush():
        for a in range(0, len(count), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(tokens.hashes[a:a + 50_000]), pa.array(count[a:a + 50_000])], names=["word", "n"])

    for batch in batches:
        for _, run in _groups(batch, 0):
            if tokens.full():
                yield from flush()
                tokens.forget()
                count = np.zeros(1, np.int64)
            numbers, _ = tokens.read(run)
            found = np.bincount(numbers, minlength=len(tokens.hashes))
            found[:len(count)] += count
            count = found
    if count[0]:
        yield from flush()


def _runs(batches, keys: int, columns):
    """Groups of neighbouring rows alike in the first ``keys`` columns, as lists of rows, over batch borders."""
    last, rows = None, []
    for batch in batches:
        for row in zip(*[batch.column(i).to_pylist() for i in range(columns)], strict=True):
            if row[:keys] != last:
                if rows:
                    yield last, rows
                last, rows = row[:keys], []
            rows.append(row[keys:])
    if rows:
        yield last, rows


def _word_file(uri: str, bits: int):
    def run(batches):
        folder, seg, words, counts = Folder(uri), None, [], []

        def close():
            word, count = np.concatenate(words), np.concatenate(counts)
            arrays = EliasFano.of(word - (seg << (63 - bits))).arrays("word")
            arrays |= EliasFano.of(np.concatenate([[0], np.cumsum(count)])).arrays("sum")
            folder.write(f"words-{seg}", arrays)
            return pa.RecordBatch.from_pydict({"file": [seg], "words": [len(word)], "n": [int(count.sum())]})

        for batch in batches:
            file, word, count = (batch.column(i).to_numpy() for i in range(3))
            cuts = np.flatnonzero(np.diff(file)) + 1
            for a, b in zip([0, *cuts], [*cuts, len(file)], strict=True):
                if a == b:
                    continue
                if seg is not None and file[a] != seg:
                    yield close()
                    words, counts = [], []
                seg = int(file[a])
                words.append(word[a:b])
                counts.append(count[a:b])
        if seg is not None:
            yield close()

    return run


class Words:
    """Level one: numbers and counts of words."""

    def __init__(self, uri: str, bits: int, files: list[tuple[int, int, int]]):
        self.uri, self.bits = uri, bits
        self.files = files  # number, words, tokens; by number
        self.first = np.concatenate([[0], np.cumsum([f[1] for f in files])]).astype(np.int64)
        self.before = np.concatenate([[0], np.cumsum([f[2] for f in files])]).astype(np.int64)
        self.size, self.total = int(self.first[-1]), int(self.before[-1])
        self.open: dict[int, tuple[EliasFano, EliasFano]] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def _file(self, k: int) -> tuple[EliasFano, EliasFano]:
        if k not in self.open:
            arrays = Folder(self.uri).read(f"words-{self.files[k][0]}")
            self.open[k] = EliasFano.within(arrays, "word"), EliasFano.within(arrays, "sum")
        return self.open[k]

    def numbers(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash (sorted), -1 where the word is unknown."""
        out, names = np.full(len(hashes), -1, np.int64), np.array([f[0] for f in self.files], np.int64)
        seg = hashes >> (63 - self.bits)
        for k, name in enumerate(names):
            a, b = np.searchsorted(seg, [name, name + 1])
            if a == b:
                continue
            words, want = self._file(k)[0], (hashes[a:b] - (int(name) << (63 - self.bits))).astype(np.uint64)
            place = words.successor(want)
            there = np.flatnonzero(place < words.n)
            there = there[words.get(place[there]) == want[there]]
            out[a + there] = place[there] + self.first[k]
        return out

    def counts(self, numbers: np.ndarray) -> np.ndarray:
        """The count of each number, in any order; 0 for -1."""
        out, file = np.zeros(len(numbers), np.int64), np.searchsorted(self.first, numbers, "right") - 1
        order = np.argsort(file, kind="stable")
        edges = np.searchsorted(file[order], np.arange(len(self.files) + 1))
        for k in range(len(self.files)):
            some = order[edges[k]:edges[k + 1]]
            if len(some):
                sums, place = self._file(k)[1], numbers[some] - self.first[k]
                out[some] = (sums.get(place + 1) - sums.get(place)).astype(np.int64)
        return out

    def at(self, token: int) -> tuple[int, float]:
        """The word that the token-th of all sorted tokens belongs to, and the share of the word's tokens before it."""
        k = min(bisect.bisect_right(self.before.tolist(), token) - 1, len(self.files) - 1)
        sums, rest = self._file(k)[1], np.array([token - self.before[k] + 1])
        place = int(sums.successor(rest)[0]) - 1
        low, high = sums.get(np.array([place, place + 1])).astype(np.int64)
        return int(self.first[k]) + place, float((rest[0] - 1 - low) / max(1, high - low))


class WordMemory:
    """What the words of a task's texts are to the model, by their number in the task: their number in the model (-1: unknown), and
    with ``unigram`` how often they came and their own probability."""

    def __init__(self, words: Words, unigram=None):
        self.tokens, self.words, self.unigram = Tokens(), words, unigram
        self._forget()

    def _forget(self) -> None:
        self.tokens.forget()
        self.numbers, self.counts, self.base = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)

    def read(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """As ``Tokens.read``; the arrays then cover all numbers that it returns."""
        if self.tokens.full():
            self._forget()
        read = self.tokens.read(texts)
        new = self.tokens.hashes[len(self.numbers):]
        if len(new):
            order, numbers = np.argsort(new, kind="stable"), np.full(len(new), -1, np.int64)
            if self.words.size:
                numbers[order] = self.words.numbers(new[order])
            self.numbers = np.concatenate([self.numbers, numbers])
            if self.unigram:
                counts = self.words.counts(numbers) if self.words.size else np.zeros(len(new), np.int64)
                self.counts, self.base = np.concatenate([self.counts, counts]), np.concatenate([self.base, self.unigram(counts)])
        return read


def _contexts(numbers: np.ndarray, sizes: np.ndarray, end: int) -> np.ndarray:
    """The word before each token: the end for a text's first."""
    out = np.empty_like(numbers)
    out[1:] = numbers[:-1]
    out[np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)] = end
    return out


def _count_pairs(words: Words, edges: np.ndarray):
    """Counts of pairs, sorted and cut by file: rows (file, payload)."""
    def run(batches):
        memory, end = WordMemory(words), int(words.numbers(np.array([END]))[0])
        kept, n = [], 0

        def flush():
            pair, back = np.unique(np.concatenate([k for k, _ in kept]), return_inverse=True)
            count = np.bincount(back, np.concatenate([c for _, c in kept]), len(pair)).astype(np.int64)
            cuts = np.searchsorted(pair, edges)
            for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(pair)], strict=True)):
                if b > a:
                    yield pa.RecordBatch.from_pydict({"file": [k], "payload": [_packed(pair[a:b], count[a:b])]})

        for batch in batches:
            for _, run_ in _groups(batch, 0):
                tokens, sizes = memory.read(run_)
                numbers = memory.numbers[tokens]
                pairs = _contexts(numbers, sizes, end).astype(np.uint64) * np.uint64(words.size) + numbers.astype(np.uint64)
                kept.append(np.unique(pairs, return_counts=True))
                n += len(kept[-1][0])
                if n > 2 * TOKENS_AT_ONCE:
                    yield from flush()
                    kept, n = [], 0
        if kept:
            yield from flush()

    return run


def _packed(pair: np.ndarray, count: np.ndarray) -> bytes:
    """Sorted pairs with counts; counts above 255 stand apart."""
    large = np.flatnonzero(count > 255)
    arrays = EliasFano.of(pair - pair[0]).arrays("pair") | {
        "base": pair[:1], "count": np.minimum(count, 255).astype(np.uint8), "large": large, "counts": count[large]}
    return to_bytes(arrays)


def _unpacked(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    arrays = from_bytes(payload)
    count = arrays["count"].astype(np.int64)
    count[arrays["large"]] = arrays["counts"]
    return EliasFano.within(arrays, "pair").all() + arrays["base"][0], count


def _merge_pairs(size: int):
    """All payloads of a file as one, with what smoothing needs to know of it."""
    def run(batches):
        for (file,), rows in _runs(batches, 1, 2):
            pairs, counts = zip(*[_unpacked(r[0]) for r in rows], strict=True)
            pair, back = np.unique(np.concatenate(pairs), return_inverse=True)
            count = np.bincount(back, np.concatenate(counts), len(pair)).astype(np.int64)
            context = pair // np.uint64(size)
            first, last = int(context[0]), int(context[-1])
            yield pa.RecordBatch.from_pydict({
                "file": [file], "payload": [_packed(pair, count)], "once": [int((count == 1).sum())], "twice": [int((count == 2).sum())],
                "first": [first], "n_first": [int((context == first).sum())], "last": [last], "n_last": [int((context == last).sum())]})

    return run


def _quantised(log: np.ndarray) -> np.ndarray:
    """Logarithms from -16 to 0 in steps."""
    return np.clip(np.rint(-log * STEPS), 0, 65_535).astype(np.uint16)


def _pair_file(model):
    """Level two: writes a file of contexts, pointers, successors, probabilities and back-off weights."""
    def run(batches):
        folder, words = Folder(model.words.uri), model.words
        for (file,), rows in _runs(batches, 1, 2):
            pair, count = _unpacked(rows[0][0])
            size = np.uint64(words.size)
            context, word = (pair // size).astype(np.int64), (pair % size).astype(np.int64)
            distinct, start = np.unique(context, return_index=True)
            pointers = np.concatenate([start, [len(pair)]])
            followers = np.diff(pointers)
            for u, n in model.spread.items():  # contexts that go over several files
                followers[distinct == u] = n
            total = words.counts(distinct)
            weight = model.discount * followers / total
            here = np.repeat(np.arange(len(distinct)), np.diff(pointers))
            p = np.maximum(count - model.discount, 0) / total[here] + weight[here] * 10 ** model.unigram(words.counts(word))
            arrays = EliasFano.of(distinct - distinct[0]).arrays("context") | EliasFano.of(pointers).arrays("pointer")
            arrays |= EliasFano.of(here.astype(np.uint64) * size + word.astype(np.uint64)).arrays("word")
            arrays |= {"base": distinct[:1], "p": _quantised(np.log10(p)), "back": _quantised(np.log10(np.maximum(weight, 1e-16)))}
            folder.write(f"pairs-{file}", arrays)
            yield pa.RecordBatch.from_pydict({"file": [file]})

    return run


class Model:
    """The written trie and the numbers that its smoothing needs."""

    def __init__(self, words: Words, edges: np.ndarray, discount: float, spread: dict[int, int], files: set[int]):
        self.words, self.edges, self.discount, self.spread, self.files = words, edges, discount, spread, files
        self.open: dict[int, dict] = {}

    def __getstate__(self):
        return self.__dict__ | {"open": {}}

    def unigram(self, counts: np.ndarray) -> np.ndarray:
        """log10 of the add-half probability of words with these counts."""
        return np.log10((counts + 0.5) / (self.words.total + 0.5 * (self.words.size + 1)))

    def _file(self, k: int) -> dict:
        if k not in self.open:
            arrays = Folder(self.words.uri).read(f"pairs-{k}")
            self.open[k] = arrays | {n: EliasFano.within(arrays, n) for n in ("context", "pointer", "word")}
        return self.open[k]

    def pairs(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For sorted pairs: log10 of the smoothed probability, or nan where the pair wasn't seen, and then the logarithm of
        the context's back-off weight."""
        p, back = np.full(len(pair), np.nan), np.zeros(len(pair))
        cuts = np.searchsorted(pair, self.edges)
        for k, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(pair)], strict=True)):
            if a == b:
                continue
            context, word = np.divmod(pair[a:b], np.uint64(self.words.size))
            rest = np.arange(b - a)
            if k in self.files:
                f = self._file(k)
                there, at = self._contexts(f, context, rest)
                back[a + there] = f["back"][at] / -STEPS
                first, last = f["pointer"].get(at).astype(np.int64), f["pointer"].get(at + 1).astype(np.int64)
                want = at.astype(np.uint64) * np.uint64(self.words.size) + word[there]
                found = f["word"].successor(want, first, last)
                seen = np.flatnonzero(found < last)
                seen = seen[f["word"].get(found[seen]) == want[seen]]
                p[a + there[seen]] = f["p"][found[seen]] / -STEPS
                rest = np.setdiff1d(rest, there, assume_unique=True)
            for beside in self._beside(k) if len(rest) else ():  # a context on the border may have all its rows there
                f = self._file(beside)
                there, at = self._contexts(f, context, rest)
                back[a + there] = f["back"][at] / -STEPS
        return p, back

    @staticmethod
    def _contexts(f: dict, context: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of ``rows`` whose context is in the file, and its place there."""
        base = int(f["base"][0])
        rows = rows[context[rows] >= base]
        want = context[rows] - np.uint64(base)
        place = f["context"].successor(want)
        there = np.flatnonzero(place < f["context"].n)
        there = there[f["context"].get(place[there]) == want[there]]
        return rows[there], place[there]

    def _beside(self, k: int) -> list[int]:
        """Files that share the border contexts of file k: the next ones before and after that exist."""
        names = sorted(self.files)
        at = bisect.bisect_left(names, k)
        return [*names[max(0, at - 1):at], *[n for n in names[at:at + 2] if n != k][:1]]


def train(docs: DataFrame) -> Model:
    """The model of all texts of ``docs``. Only sums, file sizes and borders reach the driver."""
    spark, texts = docs.sparkSession, whole_text(docs).select("text")
    uri = work_folder(spark, "ngrams")
    counted = texts.mapInArrow(_count_words, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counted = stored(counted, "words")
    size = counted.count()
    bits = max(0, (size // FILE_WORDS).bit_length())
    dealt = counted.select(F.shiftright("word", 63 - bits).alias("file") if bits else F.lit(0).cast("long").alias("file"), "word", "n")
    dealt = dealt.repartition(1 << bits, "file").sortWithinPartitions("file", "word")
    files = dealt.mapInArrow(_word_file(uri, bits), "file long, words long, n long").collect()
    words = Words(uri, bits, sorted(map(tuple, files)))
    if not size:
        return Model(words, np.empty(0, np.uint64), 0.5, {}, set())
    edges = []
    for k in range(1, -(-words.total // FILE_PAIRS)):
        u, share = words.at(k * FILE_PAIRS)
        v, _ = words.at(min(words.total - 1, int(share * words.total)))
        edges.append(u * words.size + v)
    edges = np.array(edges, np.uint64)
    parts = texts.mapInArrow(_count_pairs(words, edges), "file long, payload binary")
    merged = parts.repartition(len(edges) + 1, "file").sortWithinPartitions("file").mapInArrow(
        _merge_pairs(words.size), "file long, payload binary, once long, twice long, first long, n_first long, last long, n_last long")
    merged = stored(merged, "pairs")
    stats = merged.drop("payload").collect()
    once, twice = sum(s["once"] for s in stats), sum(s["twice"] for s in stats)
    discount = min(0.95, max(0.1, once / max(1, once + 2 * twice)))
    spread: dict[int, int] = {}
    for s in stats:
        for u, n in {(s["first"], s["n_first"]), (s["last"], s["n_last"])}:
            spread[u] = spread.get(u, 0) + n
    model = Model(words, edges, discount, spread, {s["file"] for s in stats})
    merged.select("file", "payload").mapInArrow(_pair_file(model), "file long").agg(F.count("*")).collect()
    return model


class PairMemory:
    """What the model says of pairs, remembered from batch to batch."""

    def __init__(self, model: Model):
        self.model = model
        self.pair, self.p, self.back = np.empty(0, np.uint64), np.empty(0), np.empty(0)

    def look(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``Model.pairs`` of sorted distinct pairs."""
        p, back, known = np.empty(len(pair)), np.empty(len(pair)), np.zeros(len(pair), bool)
        if len(self.pair):
            place = np.minimum(np.searchsorted(self.pair, pair), len(self.pair) - 1)
            known = self.pair[place] == pair
            p[known], back[known] = self.p[place[known]], self.back[place[known]]
        new = pair[~known]
        p[~known], back[~known] = found = self.model.pairs(new)
        if len(self.pair) + len(new) > KEPT_PAIRS:
            self.pair, self.p, self.back = pair, p, back
        else:
            both = np.concatenate([self.pair, new])
            order = np.argsort(both, kind="stable")
            self.pair = both[order]
            self.p, self.back = (np.concatenate([a, b])[order] for a, b in zip((self.p, self.back), found, strict=True))
        return p, back


def _score(model: Model):
    memory, pairs, words = WordMemory(model.words, model.unigram), PairMemory(model), model.words
    end = int(words.numbers(np.array([END]))[0]) if words.size else -1

    def step(batch):
        for start, run in _groups(batch, 2):
            tokens, sizes = memory.read(run)
            numbers, counts, base = memory.numbers[tokens], memory.counts[tokens], memory.base[tokens]
            context = _contexts(numbers, sizes, end)
            score = base.copy()
            both = np.flatnonzero((context >= 0) & (numbers >= 0))
            if len(both):
                pair, where = np.unique(context[both].astype(np.uint64) * np.uint64(words.size) + numbers[both].astype(np.uint64), return_inverse=True)
                p, weight = pairs.look(pair)
                score[both] = np.where(np.isnan(p[where]), weight[where] + base[both], p[where])
            odd = np.flatnonzero((context >= 0) & (numbers < 0))
            if len(odd):  # an unknown word after a known one costs the context's back-off weight too
                known, where = np.unique(context[odd], return_inverse=True)
                score[odd] += model.pairs(known.astype(np.uint64) * np.uint64(words.size))[1][where]
            heads = np.concatenate([[0], np.cumsum(sizes)[:-1]]).astype(np.int64)
            n = len(run)
            yield pa.RecordBatch.from_arrays([
                batch.column(0).slice(start, n), batch.column(1).slice(start, n), pa.array(sizes),
                pa.array(np.add.reduceat((counts > 0).astype(np.int64), heads)), pa.array(np.full(n, words.total)),
                pa.array(np.add.reduceat(base, heads)), pa.array(np.add.reduceat(score, heads))],
                names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return step


def score(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score, one row per row of ``docs``.

    Without a model, one is learnt from the rows that aren't held out. Null counts as empty, which is one end. Words are
    what blank and tab to carriage return leave, A-Z in lower case. Rows that repeat count, and are scored, each time.
    An empty table gives an empty one; where no row trains, every token has the one probability that is left.
    """
    model = model or train(docs.filter(~held_out()))
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(
        arrow_function(_score, model),
        "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
