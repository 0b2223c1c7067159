"""Substring dedup: removes every passage of 35 words or more that occurs more than once, by suffix automata.

1. *Seeds.* In every window of 35 words the 8-word sequence of smallest hash is a seed; windows that are alike have the same
   one, so only windows whose seed occurs twice can repeat. They are cut into pieces of bounded length, and within a piece the
   neighbouring windows of one seed are a group.
2. *Reference.* Groups that occur twice repeat as a whole. Where a seed has several different groups, windows are told apart: of each
   that occurs twice the first occurrence is kept. Runs of such windows are the reference passages: each repeated passage about once,
   however many copies there are. They are dealt to shards of bounded size.
3. *Automata.* Each shard's passages become a suffix automaton over whole words, written once as a row.
4. *Statistics.* Each piece is streamed through the automata of the shards that hold its windows. The length of the longest match
   that ends at a word is its matching statistic; where it reaches the threshold, the whole match is covered. A shard with many pieces
   sends its automaton to many tasks.
5. Covered spans are merged for each text and removed.

Equal texts are handled as one that counts as often as it occurs.
"""

from __future__ import annotations

import pickle
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scanweave.llm.common import Scratch, arrow_function, ordered, running, stored

#: Words in a window and in a seed; windows in a piece, words in a shard and in the pieces that one task streams through it,
#: words that a task remembers and that it hashes at a time (or those of one text).
WINDOW, SEED, PIECE_WINDOWS, SHARD_WORDS, STREAM_WORDS, KEPT_WORDS, WORDS_AT_ONCE = 35, 8, 2048, 32_768, 1_000_000, 300_000, 200_000
#: Odd multipliers of the rolling hashes of seeds and of the two of windows.
_SEED_BY, _FIRST_BY, _SECOND_BY = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93
#: Bits of a place, more than a window has words.
_PLACE = np.uint64(1023)


class _Powers:
    """Powers of an odd number and of its inverse modulo 2^64, as many as the longest text so far needs."""

    def __init__(self, base: int):
        self.base, self.inverse, self.up, self.down = base, pow(base, -1, 1 << 64), np.ones(1, np.uint64), np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        while len(self.up) < n:
            size = len(self.up)
            self.up = np.concatenate([self.up, self.up * np.uint64(pow(self.base, size, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * np.uint64(pow(self.inverse, size, 1 << 64))])

    def rolling(self, words: np.ndarray, width: int) -> np.ndarray:
        """A hash of each ``width`` consecutive words."""
        n = len(words)
        self.reach(n)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * self.up[:n], dtype=np.uint64)])
        x = (sums[width:] - sums[:-width]) * self.down[:n - width + 1]
        x ^= x >> np.uint64(33)
        x *= np.uint64(0xFF51AFD7ED558CCD)
        return x ^ (x >> np.uint64(29))


class Hashes:
    """Hashes of words, of seeds and of windows, with a bounded memory of words."""

    def __init__(self):
        self.known: dict[bytes, int] = {}
        self.seed, self.first, self.second = _Powers(_SEED_BY), _Powers(_FIRST_BY), _Powers(_SECOND_BY)

    def words(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT_WORDS:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def seeds(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The hash of every sequence of ``SEED`` words, and for each window the place of its smallest. Of equal sequences in a window
        any may be chosen: they are one seed."""
        grams = self.seed.rolling(words, SEED)
        # The low bits of a hash give way to its place: minima of pairs, then of pairs of those, keep both.
        place = np.arange(len(grams), dtype=np.uint64) & _PLACE
        least, width, inside = (grams & ~_PLACE) | place, 1, WINDOW - SEED + 1
        while width < inside:
            step = min(width, inside - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        first = np.arange(len(least), dtype=np.uint64)
        return grams, (first + (((least & _PLACE) - first) & _PLACE)).astype(np.int64)


def _split(text) -> list[bytes]:
    """Words between blanks, tabs, line feeds, vertical tabs, form feeds and carriage returns."""
    return (text.as_py() or b"").split()


_SEEDS = pa.schema([("digest", pa.binary()), ("seeds", pa.list_(pa.int64()))])


def _rows(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _runs(texts):
    """Texts in runs of bounded size: the first one's place, the words of all, and where each text begins in them."""
    first, words, begins = 0, [], [0]
    for i, text in enumerate(texts):
        words += _split(text)
        begins.append(len(words))
        if len(words) > WORDS_AT_ONCE:
            yield first, words, np.array(begins)
            first, words, begins = i + 1, [], [0]
    if len(begins) > 1:
        yield first, words, np.array(begins)


def _inside(begins: np.ndarray, windows: int) -> np.ndarray:
    """Which of the windows over the words of several texts lie in one text."""
    inside = np.ones(windows, bool)
    for b in begins[1:-1].tolist():
        inside[max(0, b - WINDOW + 1):b] = False
    return inside


def _find_seeds():
    hashes = Hashes()

    def step(batch):
        seeds, sizes = [], []
        for _, words, begins in _runs(batch.column(1).cast(pa.binary())):
            n = np.zeros(len(begins) - 1, np.int64)
            if len(words) >= WINDOW:
                grams, at = hashes.seeds(hashes.words(words))
                windows = np.flatnonzero(_inside(begins, len(at)))
                text = np.searchsorted(begins, windows, "right") - 1
                chosen = _starts(at[windows]) if len(windows) else windows
                # A text's first window begins a run of its own, for its place is beyond those of the text before.
                seeds.append(grams[at[windows[chosen]]].view(np.int64))
                n = np.bincount(text[chosen], minlength=len(n))
            sizes.append(n)
        ends = np.concatenate([[0], np.cumsum(np.concatenate(sizes))]) if sizes else np.zeros(1, np.int64)
        values = np.concatenate(seeds) if seeds else np.empty(0, np.int64)
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.binary()), lists], schema=_SEEDS)

    return step


def _starts(values: np.ndarray) -> np.ndarray:
    """Where runs of equal neighbours begin."""
    return np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))


_GROUP = "seed: long, head: long, tail: long, at: int, size: int"
_GROUPS = pa.list_(pa.struct([("seed", pa.int64()), ("head", pa.int64()), ("tail", pa.int64()), ("at", pa.int32()), ("size", pa.int32())]))
_PIECES = pa.schema([("digest", pa.binary()), ("copies", pa.int64()), ("start", pa.int64()), ("words", pa.string()), ("groups", _GROUPS)])


def _cut_pieces():
    """Pieces of the texts: neighbouring windows whose seeds are among the rows' repeated ones, in whole groups. A group is known
    by its seed, the hashes of its first and last window, which overlap, and the number of its windows."""
    hashes = Hashes()

    def cut(groups_from, groups_to):
        """Places where pieces begin in a sequence of groups: after a break or where a piece is full."""
        begins, start, end = [], 0, -1
        for k, (a, b) in enumerate(zip(groups_from, groups_to, strict=True)):
            if a != end or b - start > PIECE_WINDOWS:
                begins.append(k)
                start = a
            end = b
        return begins

    def step(batch):
        digests, copies = batch.column(0), batch.column(1)
        hits = batch.column(3)
        for first, words, begins in _runs(batch.column(2).cast(pa.binary())):
            if len(words) < WINDOW:
                continue
            hashed = hashes.words(words)
            grams, at = hashes.seeds(hashed)
            inside = _inside(begins, len(at))
            # Groups: runs of windows of one text with one seed. Whether a seed repeats doesn't hang on the text.
            text = np.searchsorted(begins, np.arange(len(at)), "right") - 1
            starts = _starts(np.where(inside, at, -1 - text))
            ends = np.append(starts[1:], len(at))
            seeds = grams[at[starts]].view(np.int64)
            repeated = hits.slice(first, len(begins) - 1).flatten().to_numpy()
            kept = np.flatnonzero(inside[starts] & np.isin(seeds, repeated))
            if not len(kept):
                continue
            starts, ends, seeds = starts[kept], ends[kept], seeds[kept]
            windows = hashes.first.rolling(hashed, WINDOW).view(np.int64)
            opens = np.array(cut(starts.tolist(), ends.tolist()))
            closes = np.append(opens[1:], len(starts))
            of, a, b = text[starts[opens]], starts[opens], ends[closes - 1]
            groups = pa.StructArray.from_arrays([
                pa.array(seeds), pa.array(windows[starts]), pa.array(windows[ends - 1]),
                pa.array((starts - np.repeat(a, closes - opens)).astype(np.int32)), pa.array((ends - starts).astype(np.int32))],
                ["seed", "head", "tail", "at", "size"])
            texts = [b" ".join(words[i:j + WINDOW - 1]).decode() for i, j in zip(a.tolist(), b.tolist(), strict=True)]
            rows = pa.array(of + first)
            yield pa.RecordBatch.from_arrays([
                digests.take(rows).cast(pa.binary()), copies.take(rows), pa.array(a - begins[of]), pa.array(texts, pa.string()),
                pa.ListArray.from_arrays(pa.array(np.append(opens, len(starts)), pa.int32()), groups).cast(_GROUPS)], schema=_PIECES)

    return step


_WINDOWS = "first long, second long, piece long, pos int, at int, weight int"


def _window_rows():
    """The windows of some groups of a piece: rows (piece, words, groups as at, size, weight)."""
    hashes = Hashes()

    def step(batch):
        piece, lists = batch.column(0).to_numpy(), batch.column(2)
        for first, words, begins in _runs(batch.column(1).cast(pa.binary())):
            hashed = hashes.words(words)
            some = lists.slice(first, len(begins) - 1)
            at, n, weight = (some.flatten().field(k).to_numpy() for k in range(3))
            owner = np.repeat(np.arange(len(begins) - 1), some.value_lengths().to_numpy())
            before = np.cumsum(n) - n
            pos = np.arange(int(n.sum())) + np.repeat(at - before, n)
            row = np.repeat(owner, n)
            window = begins[row] + pos
            yield pa.RecordBatch.from_arrays([
                pa.array(hashes.first.rolling(hashed, WINDOW)[window].view(np.int64)),
                pa.array(hashes.second.rolling(hashed, WINDOW)[window].view(np.int64)), pa.array(piece[first + row]),
                pa.array(pos.astype(np.int32)), pa.array(np.repeat(at, n)), pa.array(np.repeat(weight, n))],
                names=["first", "second", "piece", "pos", "at", "weight"])

    return step


class SuffixAutomaton:
    """All substrings of some passages of words, in states and transitions linear in their length.

    ``go`` maps state * (number of words + 1) + word to a state. A break between passages is a word that no text has.
    """

    def __init__(self, words: dict[bytes, int], link: list[int], length: list[int], go: dict[int, int]):
        self.words, self.link, self.length, self.go, self.base = words, link, length, go, len(words) + 1

    @classmethod
    def of(cls, passages: list[list[bytes]]) -> SuffixAutomaton:
        words: dict[bytes, int] = {}
        for p in passages:
            for w in p:
                words.setdefault(w, len(words))
        end = len(words)
        nxt: list[dict[int, int]] = [{}]
        link, length = [-1], [0]
        for p in passages:
            last = 0  # all passages start in the root, so none goes over into another
            for c in map(words.__getitem__, p):
                row = nxt[last]
                if c not in row:
                    # A new state; its suffixes get it as their next until one has a next already.
                    new = len(nxt)
                    nxt.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    at = last
                    while at != -1 and c not in nxt[at]:
                        nxt[at][c] = new
                        at = link[at]
                    if at != -1:
                        link[new] = cls._next(nxt, link, length, at, c)
                    last = new
                else:
                    last = cls._next(nxt, link, length, last, c)  # of an earlier passage
        base = end + 1
        go = {s * base + w: t for s, row in enumerate(nxt) for w, t in row.items()}
        return cls(words, link, length, go)

    @staticmethod
    def _next(nxt, link, length, at, c):
        """The state after ``at`` and the word ``c`` whose longest substring is that of ``at`` and the word: split off where the
        present one stands for longer ones too."""
        q = nxt[at][c]
        if length[q] == length[at] + 1:
            return q
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[at] + 1)
        while at != -1 and nxt[at].get(c) == q:
            nxt[at][c] = clone
            at = link[at]
        link[q] = clone
        return clone

    def to_bytes(self) -> bytes:
        n = len(self.go)
        arrays = (np.array(self.link, np.int32), np.array(self.length, np.int32), np.fromiter(self.go.keys(), np.int64, n),
                  np.fromiter(self.go.values(), np.int32, n))
        return zlib.compress(pickle.dumps((b" ".join(self.words), *arrays)), 1)

    @classmethod
    def from_bytes(cls, data: bytes) -> SuffixAutomaton:
        words, link, length, keys, to = pickle.loads(zlib.decompress(data))
        return cls({w: i for i, w in enumerate(words.split(b" "))}, link.tolist(), length.tolist(), dict(zip(keys.tolist(), to.tolist(), strict=True)))

    def spans(self, words: list[bytes], least: int) -> list[tuple[int, int]]:
        """What matches of ``least`` words or more cover: disjoint (start, end), end exclusive, that don't touch or overlap."""
        go, link, length, base, number = self.go, self.link, self.length, self.base, self.words.get
        state = n = 0
        out: list[tuple[int, int]] = []
        a, b = -1, -1
        for at, w in enumerate(words, 1):
            c = number(w)
            if c is None:
                state = n = 0
                continue
            to = go.get(state * base + c)
            while to is None and state:
                state = link[state]
                n = length[state]
                to = go.get(state * base + c)
            if to is None:
                n = 0
                continue
            state, n = to, n + 1
            if n >= least:
                if at - n > b:
                    if b > 0:
                        out.append((a, b))
                    a = at - n
                a, b = min(a, at - n), at
        if b > 0:
            out.append((a, b))
        return out


def _build(batches):
    """One automaton for each run of neighbouring rows of a shard: rows (shard, words, places of reference windows as pos, size)."""
    shard, passages = None, []

    def close():
        data = SuffixAutomaton.of(passages).to_bytes()
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int64()), pa.array([data], pa.binary())], names=["shard", "automaton"])

    for batch in batches:
        for no, text, places in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2), strict=True):
            if no != shard and shard is not None:
                yield close()
                passages = []
            shard, words = no, _split(text)
            end = start = 0
            for place in places.as_py():  # sorted
                if place["pos"] > end and end:
                    passages.append(words[start:end + WINDOW - 1])
                start = place["pos"] if place["pos"] > end or not end else start
                end = max(end, place["pos"] + place["size"])
            passages.append(words[start:end + WINDOW - 1])
    if shard is not None:
        yield close()


_COVERED = pa.schema([("digest", pa.binary()), ("a", pa.int64()), ("b", pa.int64())])


def _stream(batches):
    """Spans of the pieces that matches cover: rows (automaton, digest, start, words), each automaton before its pieces."""
    automaton = None
    for batch in batches:
        rows = []
        data, digests, starts, texts = (batch.column(i) for i in range(4))
        for i in range(len(batch)):
            if data[i].is_valid:
                automaton = SuffixAutomaton.from_bytes(data[i].as_py())
                continue
            start = starts[i].as_py()
            digest = digests[i].as_py()
            rows += [(digest, start + a, start + b) for a, b in automaton.spans(texts[i].as_py().encode().split(b" "), WINDOW)]
        if rows:
            yield _rows(rows, _COVERED)


def _remove(batch):
    rows = []
    columns = batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist()
    for doc, text, spans in zip(*columns, strict=True):
        words, kept, at = _split(text), [], 0
        for s in spans or ():
            kept += words[at:s["a"]]
            at = max(at, s["b"])
        kept += words[at:]
        rows.append((doc, len(words), len(words) - len(kept), b" ".join(kept).decode()))
    yield _rows(rows, _LEFT)


_LEFT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("text", pa.string())])


def _texts(docs: DataFrame) -> DataFrame:
    """Every row's digest and whole text."""
    whole = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return whole.select("doc_id", F.unhex(F.md5("text")).alias("digest"), "text")


def _pieces(rows: DataFrame, kept: Scratch) -> DataFrame:
    """digest, copies, start, words and groups of all windows whose seed occurs twice, as a written table with a number a row."""
    scratch = Scratch(rows.sparkSession)
    seeds = rows.select("digest", "text").mapInArrow(arrow_function(_find_seeds), "digest binary, seeds array<long>")
    seeds = seeds.groupBy("digest").agg(F.count("*").alias("copies"), F.first("seeds").alias("seeds"))
    seeds = scratch.stored(seeds.filter(F.size("seeds") > 0).withColumn("text_no", F.monotonically_increasing_id()), "seeds")
    each = seeds.select("text_no", "copies", F.explode("seeds").alias("seed"))
    repeated = scratch.stored(each.groupBy("seed").agg(F.sum("copies").alias("n")).filter("n > 1").select("seed"), "repeated-seeds")
    hits = each.select("text_no", "seed").join(repeated, "seed").groupBy("text_no").agg(F.collect_set("seed").alias("hits"))
    hits = seeds.select("text_no", "digest", "copies").join(hits, "text_no").select("digest", "copies", "hits")
    texts = rows.groupBy("digest").agg(F.first("text").alias("text"))
    cut = texts.join(hits, "digest").select("digest", "copies", "text", "hits").mapInArrow(
        arrow_function(_cut_pieces), f"digest binary, copies long, start long, words string, groups array<struct<{_GROUP}>>")
    pieces = kept.stored(cut.withColumn("piece", F.monotonically_increasing_id()), "pieces")
    scratch.drop()
    return pieces


def _routes(pieces: DataFrame, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Reference passages (shard, words, places) and which pieces have windows in which shards (shard, piece)."""
    key = ["seed", "head", "tail", "size"]
    groups = pieces.select("piece", "copies", F.explode("groups").alias("g")).select("piece", "copies", "g.*")
    place = F.min(F.struct("piece", "at")).alias("place")
    different = groups.groupBy(*key).agg(F.sum("copies").alias("n"), place)
    different = scratch.stored(different.select(*key, F.least("n", F.lit(2)).cast("int").alias("weight"), "place.*"), "groups")
    several = scratch.stored(different.groupBy("seed").agg(F.count("*").alias("d")).filter("d > 1").select("seed", F.lit(True).alias("several")),
                     "several-groups")
    marked = scratch.stored(different.join(several, "seed", "left"), "marked-groups")
    apart = marked.filter("several").groupBy("piece").agg(F.collect_list(F.struct("at", "size", "weight")).alias("some"))
    windows = scratch.stored(pieces.select("piece", "words").join(apart, "piece").select("piece", "words", "some").mapInArrow(
        arrow_function(_window_rows), _WINDOWS), "windows")
    seen = windows.groupBy("first", "second").agg(F.min(F.struct("piece", "pos")).alias("place"), F.sum("weight").alias("n"))
    seen = scratch.stored(seen.filter("n > 1").select("first", "second", "place.*"), "repeated-windows")
    alike = marked.filter("several IS NULL AND weight = 2").select("piece", "at", F.col("at").alias("pos"), "size")
    ranges = alike.select("piece", "pos", "size").unionByName(seen.select("piece", "pos", F.lit(1).alias("size")))
    # No more words than the ranges have one by one, nor than lie between the first and the last.
    words = F.least(F.sum(F.col("size") + (WINDOW - 1)), F.max(F.col("pos") + F.col("size")) - F.min("pos") + (WINDOW - 1))
    held = ranges.groupBy("piece").agg(
        F.sort_array(F.collect_list(F.struct("pos", "size"))).alias("places"), words.cast("long").alias("n"), F.lit(0).alias("all"))
    placed = running(ordered(held, ["all"], ["piece"], "reference"), ["all"], ["piece"], F.col("n"), "before")
    shards = scratch.stored(placed.select("piece", "places", F.floor(F.col("before") / SHARD_WORDS).cast("long").alias("shard")), "shards")
    passages = shards.join(pieces.select("piece", "words"), "piece").select("shard", "words", "places")
    home = shards.select("piece", "shard")
    where = seen.join(home, "piece").select("first", "second", "shard")
    found = windows.select("first", "second", "piece", "at").join(where, ["first", "second"]).select("piece", "at", "shard").distinct()
    found = found.unionByName(alike.join(home, "piece").select("piece", "at", "shard"))
    # Every occurrence of a group goes where its first one does.
    targets = marked.select(*key, "piece", "at").join(found, ["piece", "at"]).select(*key, "shard")
    return passages, groups.select(*key, "piece").join(targets, key).select("shard", "piece").distinct()


def covered_spans(rows: DataFrame) -> DataFrame:
    """digest and covered spans (a, b) in words, sorted, of the texts among rows (digest, text) that have any, as a written table."""
    kept, scratch = Scratch(rows.sparkSession), Scratch(rows.sparkSession)
    pieces = _pieces(rows, kept)
    passages, routes = _routes(pieces, scratch)
    dealt = passages.repartition("shard").sortWithinPartitions("shard")
    automata = kept.stored(dealt.mapInArrow(_build, "shard long, automaton binary"), "automata")
    routes = kept.stored(routes, "routes")
    scratch.drop()
    size = F.aggregate("groups", F.lit(0), lambda n, g: n + g["size"]).alias("size")
    load = routes.join(pieces.select("piece", size), "piece").groupBy("shard").agg(
        F.greatest(F.ceil(F.sum("size") / STREAM_WORDS), F.lit(1)).cast("long").alias("tasks"))
    load = kept.stored(load, "load")
    automata = automata.join(load, "shard").select(
        "shard", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), "automaton",
        F.lit(None).cast("binary").alias("digest"), F.lit(None).cast("long").alias("start"), F.lit(None).cast("string").alias("words"))
    dealt = routes.join(load, "shard").select("shard", "piece", F.pmod(F.xxhash64("piece"), F.col("tasks")).alias("task"))
    pieced = dealt.join(pieces.select("piece", "digest", "start", "words"), "piece").select(
        "shard", "task", F.lit(None).cast("binary").alias("automaton"), "digest", "start", "words")
    both = automata.unionByName(pieced).repartition("shard", "task").sortWithinPartitions("shard", "task", F.col("automaton").isNull())
    found = both.select("automaton", "digest", "start", "words").mapInArrow(_stream, "digest binary, a long, b long")
    spans = stored(found.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("spans")), "spans")
    kept.drop()
    return spans


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_removed and the words that are left, joined by one blank; one row per row of ``docs``.

    Words end at a blank, tab, line feed, vertical tab, form feed or carriage return and are compared as they are. A word goes if
    a window of 35 words covers it whose words also start anywhere else; windows are judged on the texts as given, and the first
    occurrence goes too. Null counts as empty; texts under 35 words lose nothing. Repeated rows are copies of each other, whatever
    their doc_id. Other columns play no part. An empty table gives an empty one.
    """
    rows = _texts(docs)
    spans = covered_spans(rows)
    left = rows.withColumn("doc_id", F.col("doc_id").cast("long")).join(spans, "digest", "left").select("doc_id", "text", "spans")
    return left.mapInArrow(lambda batches: (out for b in batches for out in _remove(b)), "doc_id long, n_words long, n_removed long, text string")


def substring_report(docs: DataFrame) -> DataFrame:
    """The result with the remaining text as its digest."""
    return dedup_substrings(docs).select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS row_no, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
w AS (
  SELECT row_no, unnest(range(len(hs))) AS start, unnest(hs) AS h
  FROM (SELECT row_no, list_transform(range(1, greatest(len(ws) - 33, 1)), lambda i: md5(array_to_string(ws[i:i + 34], ' '))) AS hs FROM d)),
twice AS (SELECT h FROM w GROUP BY h HAVING count(*) > 1),
gone AS (
  SELECT DISTINCT row_no, start + k AS pos FROM w SEMI JOIN twice USING (h), range(35) AS t(k)),
words AS (SELECT row_no, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM d),
kept AS (
  SELECT w.row_no, count(g.pos) AS n_removed, coalesce(string_agg(w.word, ' ' ORDER BY w.pos) FILTER (WHERE g.pos IS NULL), '') AS kept
  FROM words w LEFT JOIN gone g ON w.row_no = g.row_no AND w.pos = g.pos GROUP BY w.row_no)
SELECT d.doc_id, len(d.ws)::BIGINT AS n_words, coalesce(k.n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k USING (row_no)
"""
