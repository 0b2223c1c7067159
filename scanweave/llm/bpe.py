"""Byte-level BPE: whole texts to token numbers and back.

The vocabulary is a file of a public tokenizer; its path is a parameter. Work is split by documents and nothing is
shuffled. A task keeps the encodings of words that it has met, up to a bound, and encodes only new words: sorted, they are
the depth-first order of a trie, and the last token of every prefix on the current path is kept, so what words share at
their front is computed once. A prefix ends in the one token whose pair with the last token before it stays apart under
the merge rules.
"""

from __future__ import annotations

import array
import functools
import hashlib
import itertools
import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scanweave.llm.common import arrow_function, whole_text

#: How byte-level vocabularies cut a text into words. White space is listed, as engines differ there.
_SPACE = r"\t-\r \x85\xa0  -     　"
_WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_SPACE}\p{{L}}\p{{N}}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
#: The same over Latin text and general punctuation, whose letters and numbers can be listed, for the faster engine.
_LETTER, _NUMBER = r"A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼½¾"
_LATIN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^{_SPACE}{_LETTER}{_NUMBER}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
_NOT_LATIN = r"[^\x00-ɏ -⁯]"
#: Characters that every Unicode version puts into the same class; a text with others is cut by the tokenizer's own rule.
_STEADY = r"[^\x00-ӿ -⁯]"
#: Words and pairs of tokens that a task remembers, words handled at a time, and characters of text that go into one output batch.
KEPT_WORDS, KEPT_PAIRS, WORDS_AT_ONCE, CHARS_AT_ONCE = 400_000, 500_000, 100_000, 2_000_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte: itself where it prints, else the next free one from U+0100."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(0x100 + i): b for i, b in enumerate(rest)}


def _given(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def token_texts(given: dict) -> dict[int, bytes]:
    """Every token's bytes, which is all that decoding needs."""
    letters = byte_letters()
    texts = {i: bytes(letters[c] for c in t) for t, i in given["model"]["vocab"].items()}
    return texts | {t["id"]: t["content"].encode() for t in given.get("added_tokens", [])}


class Vocabulary:
    """Tokens as bytes, how each was merged, and the token that each pair makes."""

    def __init__(self, path: str):
        given = _given(path)
        model = given["model"]
        self.added = {t["content"]: t["id"] for t in given.get("added_tokens", [])}
        self.text = token_texts(given)
        self.number = {self.text[i]: i for i in model["vocab"].values()}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.made: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        vocab = model["vocab"]
        self.rank: dict[int, int] = {}
        for rank, (a, b) in enumerate(pairs):
            whole = vocab[a + b]
            self.made[vocab[a], vocab[b]] = whole
            if whole not in self.parts:
                self.parts[whole], self.rank[whole] = (vocab[a], vocab[b]), rank


class Endings:
    """The tokens that end at a place of a word, longest first, by walking a trie of all tokens byte by byte."""

    def __init__(self, vocabulary: Vocabulary):
        self.child: dict[int, int] = {}
        token = [-1]
        for text, number in vocabulary.number.items():
            node = 0
            for byte in text:
                found = self.child.get(node << 8 | byte)
                if found is None:
                    found = self.child[node << 8 | byte] = len(token)
                    token.append(-1)
                node = found
            token[node] = number
        shorter, below = [0] * len(token), [[] for _ in token]  # shorter: the node of the longest proper suffix
        for key, node in self.child.items():
            below[key >> 8].append((key & 255, node))
        self.shorter, self.tokens = shorter, [()] * len(token)
        level = [0]
        while level:
            rest = []
            for node in level:
                for byte, to in below[node]:
                    shorter[to] = self._step(shorter[node], byte) if node else 0
                    own = ((token[to], len(vocabulary.text[token[to]])),) if token[to] >= 0 else ()
                    self.tokens[to] = own + self.tokens[shorter[to]]
                    rest.append(to)
            level = rest
        self.next = dict(self.child)  # grows by the steps taken, nodes times bytes at most

    def _step(self, node: int, byte: int) -> int:
        while node and node << 8 | byte not in self.child:
            node = self.shorter[node]
        return self.child.get(node << 8 | byte, 0)

    def step(self, node: int, byte: int) -> int:
        found = self.next[node << 8 | byte] = self._step(node, byte)
        return found


class TrieEncoder:
    """Encodes sets of words, shared prefixes once."""

    def __init__(self, vocabulary: Vocabulary):
        self.v, self.endings = vocabulary, Endings(vocabulary)
        self.pairs: dict[int, bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens stay two: no merge over their border comes before the merges that made them.

        Goes back through time: undo the latest merge that made a token at the border, until no merge is left.
        """
        made, parts, rank = self.v.made, self.v.parts, self.v.rank
        limit = len(rank)  # a border merge counts if its rank is below this
        while True:
            whole = made.get((left, right))
            if whole is not None and rank[whole] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:  # of merges with one rank the left one runs first: one at the border comes after this merge
                limit, left = a, parts[left][1]
            else:  # and here before it
                limit, right = b + 1, parts[right][0]

    def encode(self, words: list[bytes]) -> list[bytes]:
        """The token numbers of each word as 32-bit integers, in the order given."""
        tokens, follow, step, pairs = self.endings.tokens, self.endings.next, self.endings.step, self.pairs
        if len(pairs) > KEPT_PAIRS:
            pairs.clear()
        out: list[bytes] = [b""] * len(words)
        last, nodes, path = [(0, 0)], [0], b""  # last[d]: the last token, and its length, of the path's first d bytes
        for at in sorted(range(len(words)), key=words.__getitem__):
            word = words[at]
            shared, most = 0, min(len(path), len(word))
            if word[:most] == path[:most]:
                shared = most
            else:
                while word[shared] == path[shared]:
                    shared += 1
            del last[shared + 1:], nodes[shared + 1:]
            node, d = nodes[shared], shared
            for byte in word[shared:]:
                d += 1
                key = node << 8 | byte
                node = follow[key] if key in follow else step(node, byte)
                nodes.append(node)
                for pair in tokens[node]:
                    token, n = pair
                    if n == d:
                        break
                    left = last[d - n][0]
                    key = left << 20 | token
                    if key in pairs:
                        if pairs[key]:
                            break
                    else:
                        pairs[key] = stays = self.apart(left, token)
                        if stays:
                            break
                last.append(pair)
            path = word
            ids = []
            while d:
                token, n = last[d]
                ids.append(token)
                d -= n
            ids.reverse()
            out[at] = array.array("i", ids).tobytes()
        return out


class Codec:
    """Texts to token numbers and back, with a bounded memory of words."""

    def __init__(self, path: str):
        self.v = Vocabulary(path)
        self.trie, self.path = TrieEncoder(self.v), path
        self.known: dict[str, bytes] = {}
        self.words, self.odd = regex.compile(_WORDS), regex.compile(_STEADY)
        self.latin, self.not_latin = re.compile(_LATIN), re.compile(_NOT_LATIN)
        added = sorted(self.v.added, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, added)) + ")") if added else None

    @functools.cached_property
    def own_rule(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path).pre_tokenizer

    def _pieces(self, text: str):
        """Lists of words; an added token stands alone as its number."""
        for k, part in enumerate(self.cut.split(text)) if self.cut else [(0, text)]:
            if k % 2:
                yield self.v.added[part]
            elif not part:
                continue
            elif (foreign := self.not_latin.search(part)) and self.odd.search(part):
                yield [part[a:b] for _, (a, b) in self.own_rule.pre_tokenize_str(part)]
            elif len(part) <= CHARS_AT_ONCE:
                yield (self.words if foreign else self.latin).findall(part)
            else:
                found = (m.group() for m in (self.words if foreign else self.latin).finditer(part))
                while some := list(itertools.islice(found, WORDS_AT_ONCE)):
                    yield some

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The token numbers of each text. New words of all texts go into one trie: the more words, the more is shared."""
        if sum(map(len, texts)) > CHARS_AT_ONCE:
            return [self._encode(self._pieces(t)) for t in texts]
        cut = [list(self._pieces(t)) for t in texts]
        self._learn(itertools.chain.from_iterable(w for pieces in cut for w in pieces if not isinstance(w, int)))
        return [self._encode(pieces, learnt=True) for pieces in cut]

    def _encode(self, pieces, learnt: bool = False) -> np.ndarray:
        out = []
        for words in pieces:
            if isinstance(words, int):
                out.append(np.array([words], np.int32))
                continue
            if not learnt:
                self._learn(words)
            out.append(np.frombuffer(b"".join(map(self.known.__getitem__, words)), np.int32))
        return np.concatenate(out) if out else np.empty(0, np.int32)

    def _learn(self, words) -> None:
        distinct = set(words)
        new = list(distinct.difference(self.known))
        if new and len(self.known) + len(new) > KEPT_WORDS:
            self.known, new = {}, list(distinct)
        self.known.update(zip(new, self.trie.encode([w.encode() for w in new]), strict=True))

    def decode(self, ids) -> str:
        return decoded(self.v.text, ids)


def decoded(texts: dict[int, bytes], ids) -> str:
    return b"".join(map(texts.__getitem__, ids)).decode("utf-8", errors="replace")


def _blocks(sizes, most: int):
    """Neighbouring rows up to ``most`` in all, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)


def _encoder(path: str, at: int, back: bool):
    codec = Codec(path)

    def step(batch):
        texts = batch.column(at).to_pylist()
        for a, b in _blocks([len(t or "") for t in texts], CHARS_AT_ONCE):
            ids = codec.encode_all([t or "" for t in texts[a:b]])
            ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
            column = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids), pa.int32()))
            kept = [i for i in range(batch.num_columns) if i != at]
            columns, fields = [batch.column(i).slice(a, b - a) for i in kept], [batch.schema.field(i) for i in kept]
            columns, fields = [*columns, column], [*fields, pa.field("ids", pa.list_(pa.int32()))]
            if back:
                columns.append(pa.array([decoded(codec.v.text, x.tolist()) for x in ids], pa.string()))
                fields.append(pa.field("decoded", pa.string()))
            yield pa.RecordBatch.from_arrays(columns, schema=pa.schema(fields))

    return step


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Replaces the column ``text`` by ``ids``, the token numbers of the whole text; null counts as empty.

    Equal to the tokenizers library with add_special_tokens=False: an added token's string in a text is that token. Rows
    stay as they are, repeated or not; an empty table stays empty. A column ``ids`` that was there is replaced.
    """
    df = df.drop("ids") if text != "ids" else df
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return df.mapInArrow(arrow_function(_encoder, path, df.columns.index(text), False), schema)


def round_trip(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a task needs one Python worker: the column ``text`` gives way to
    ``ids`` and ``decoded``. Columns of these names that were there are replaced."""
    df = df.drop(*{"ids", "decoded"} - {text})
    rest = [f for f in df.schema.fields if f.name != text]
    schema = T.StructType([*rest, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())])
    return df.mapInArrow(arrow_function(_encoder, path, df.columns.index(text), True), schema)


def _decoder(path: str, at: int):
    known = token_texts(_given(path))

    def step(batch):
        column = batch.column(at)
        for a, b in _blocks(np.diff(column.offsets.to_numpy()).tolist(), CHARS_AT_ONCE // 4):
            texts = [None if x is None else decoded(known, x) for x in column.slice(a, b - a).to_pylist()]
            columns = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(texts, pa.string())], schema=batch.schema.append(
                pa.field("decoded", pa.string())))

    return step


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``, the text of the token numbers in ``ids``, special tokens included; null ids give null. Bytes that
    are no UTF-8 become U+FFFD. A column ``decoded`` that was there is replaced."""
    df = df.drop("decoded")
    schema = T.StructType([*df.schema.fields, T.StructField("decoded", T.StringType())])
    return df.mapInArrow(arrow_function(_decoder, path, df.columns.index(ids)), schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, ids_sha256 and decoded_sha256 of the round trip."""
    coded = round_trip(whole_text(docs), path)
    numbers = F.array_join(F.col("ids").cast("array<string>"), ",")
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(numbers, 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"))


def brute_digest(ids: list[int], text: str) -> tuple[int, str, str]:
    """What ``digests`` gives, from another tokenizer's answer; for tests."""
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(text)
