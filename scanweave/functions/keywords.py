"""All keywords of all rules in one pass over a text, by an Aho-Corasick automaton."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import functions as F

_LINES = pa.list_(pa.int32())


def _automaton(words: dict[int, list[str]]):
    """Words to the bits of the keys that ask for them; a key's bit is its place in ``words``."""
    bits: dict[str, int] = {}
    for place, some in enumerate(words.values()):
        for w in some:
            bits[w] = bits.get(w, 0) | 1 << place
    automaton = ahocorasick.Automaton()
    for w, asking in bits.items():
        automaton.add_word(w, asking)
    automaton.make_automaton()
    return automaton


def _keys_of(words: dict[int, list[str]], needs: dict[int, list[list[int]]]):
    """A function from the bits of a line to the keys that the line has."""
    bit = {key: 1 << place for place, key in enumerate(words)}
    inner = {k for alternatives in needs.values() for together in alternatives for k in together}
    asked = [(key, [bit[key]]) for key in words if key not in inner]
    asked += [(key, [sum(bit[k] for k in set(together)) for together in alternatives]) for key, alternatives in needs.items()]

    @lru_cache(maxsize=1 << 16)
    def keys(bits: int) -> tuple[int, ...]:
        return tuple(key for key, wanted in asked if any(bits & w == w for w in wanted))

    return keys


def _lines_of(automaton, keys, text: str) -> dict[int, list[int]]:
    low, found, line, at, bits = text.lower(), {}, 0, 0, 0
    for end, some in automaton.iter(low):
        down = low.count("\n", at, end)
        at = end
        if down:
            for key in keys(bits):
                found.setdefault(key, []).append(line)
            line, bits = line + down, some
        else:
            bits |= some
    for key in keys(bits):
        found.setdefault(key, []).append(line)
    return found


def lines_with(words: dict[int, list[str]], needs: dict[int, list[list[int]]] | None = None):
    """A column function: text to a map from each key to the 0-based lines that hold one of its lower-case ASCII words, whatever
    their case; keys without a line are absent. Null gives an empty map. One automaton serves all keys.

    ``needs`` names further keys whose lines hold words of several: each has alternatives, lists of keys of ``words`` of which a line
    must have all. Keys of ``words`` that serve these only aren't in the map.
    """
    @F.arrow_udf("map<int,array<int>>")
    def find(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        automaton, key_of_line = _automaton(words), _keys_of(words, needs or {})
        for texts in batches:
            ends, keys, lines, line_ends = [0], [], [], [0]
            for text in texts:
                for key, some in _lines_of(automaton, key_of_line, text.as_py() or "").items():
                    keys.append(key)
                    lines += some
                    line_ends.append(len(lines))
                ends.append(len(keys))
            values = pa.ListArray.from_arrays(pa.array(line_ends, pa.int32()), pa.array(lines, pa.int32()), type=_LINES)
            yield pa.MapArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys, pa.int32()), values)

    return find
