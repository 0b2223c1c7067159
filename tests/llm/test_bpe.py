import hashlib
import random

import pytest
from corpus_rows import prose

from scanweave.llm import bpe
from scanweave.llm.queries import tokenizer_path

tokenizers = pytest.importorskip("tokenizers")


def texts():
    draw = random.Random(3)
    letters = "abcdefghij ABC012 \n\t'\"-_=+éßñ中ऀ😀\x1c\x85\xa0՘<|endoftext|>"
    out = ["".join(draw.choice(letters) for _ in range(draw.randrange(0, 120))) for _ in range(400)]
    out += ["".join(draw.choice("aeo") for _ in range(40)) for _ in range(200)]
    out += [prose(s, 200) for s in range(20)]
    return [*out, "", " ", " \n\n  x", "a" * 47, "=" * 5000, " " * 1000, "ab" * 3000, "a<|endoftext|>b  c", "हिन्दी x   y", "it's WE'LL"]


def test_same_as_the_tokenizers_library():
    lib, own = tokenizers.Tokenizer.from_file(tokenizer_path()), bpe.Codec(tokenizer_path())
    given = texts()
    want = [e.ids for e in lib.encode_batch(given, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode_all(given)] == want
    assert [own.decode(x) for x in want] == [lib.decode(x, skip_special_tokens=False) for x in want]


def test_long_texts_and_small_memory(monkeypatch):
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    for name, n in (("CHARS_AT_ONCE", 500), ("WORDS_AT_ONCE", 50), ("KEPT_WORDS", 60), ("KEPT_PAIRS", 100)):
        monkeypatch.setattr(bpe, name, n)
    own, given = bpe.Codec(tokenizer_path()), [prose(s, 600) for s in range(5)]
    assert [x.tolist() for x in own.encode_all(given)] == [e.ids for e in lib.encode_batch(given, add_special_tokens=False)]


def test_round_trip_and_digests(odd_docs):
    lib = tokenizers.Tokenizer.from_file(tokenizer_path())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_docs.select("doc_id", "text").collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        want.append((str(r["doc_id"]), len(ids), sha(",".join(map(str, ids))), sha(r["text"] or "")))
    got = [(str(r[0]), *r[1:]) for r in bpe.digests(odd_docs, tokenizer_path()).collect()]
    assert sorted(got) == sorted(want)
    assert bpe.digests(odd_docs.limit(0), tokenizer_path()).count() == 0
    coded = bpe.encode(odd_docs, tokenizer_path())
    assert set(coded.columns) == set(odd_docs.columns) - {"text"}
