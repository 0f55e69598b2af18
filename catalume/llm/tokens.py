"""Token counts by a linear longest-match automaton over a given vocabulary.

Greedy longest match takes, at each position of a word, the longest vocabulary piece that starts
there. The trie of the pieces gets failure links (Song et al., EMNLP 2021): where no edge goes
on, the link leads to the state of what is left after the pieces that are then certain, and the
count of those pieces was computed beforehand. Each byte moves the automaton on once; pieces are
counted and never built.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Largest vocabulary that is broadcast (pieces), and words whose counts a task remembers.
MOST_PIECES, REMEMBERED = 2_000_000, 200_000


class LongestMatch:
    """Automaton over bytes; every single byte counts as a piece, so that each word has pieces."""

    def __init__(self, pieces: list[bytes]):
        self.go: dict[int, int] = {}  # state * 256 + byte -> state
        ends = bytearray(1)
        for p in (*[bytes([b]) for b in range(256)], *pieces):
            v = 0
            for c in p:
                u = self.go.setdefault(v << 8 | c, len(ends))
                if u == len(ends):
                    ends.append(0)
                v = u
            ends[v] = bool(v)
        self.fail, self.pops = [0] * len(ends), [0] * len(ends)
        # breadth first, since states were numbered as pieces came
        level = [0]
        below: dict[int, list[tuple[int, int]]] = {}
        for key, v in self.go.items():
            below.setdefault(key >> 8, []).append((key & 255, v))
        while level:
            nxt = []
            for u in level:
                for c, v in below.get(u, ()):
                    nxt.append(v)
                    if ends[v]:  # the piece itself, then nothing is left
                        self.fail[v], self.pops[v] = 0, 1
                        continue
                    z, n = self.fail[u], self.pops[u]
                    while (z << 8 | c) not in self.go:  # ends at the root, which has all bytes
                        n += self.pops[z]
                        z = self.fail[z]
                    self.fail[v], self.pops[v] = self.go[z << 8 | c], n
            level = nxt

    def count(self, word: bytes) -> int:
        v = n = 0
        go, fail, pops = self.go, self.fail, self.pops
        for c in word:
            key = v << 8 | c
            while key not in go:
                n += pops[v]
                v = fail[v]
                key = v << 8 | c
            v = go[key]
        while v:
            n += pops[v]
            v = fail[v]
        return n


def byte_symbols() -> dict[str, int]:
    """The characters by which byte-level vocabularies in JSON write bytes: printable ones as they are, the rest from U+0100."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    return out | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> list[bytes]:
    """The pieces of a byte-level tokenizer file (JSON with model.vocab), special tokens left out."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    special = {t["content"] for t in data.get("added_tokens", []) if t.get("special")}
    table = byte_symbols()
    return sorted(bytes(table[c] for c in p) for p in data["model"]["vocab"] if p not in special)


_BUILT: dict[int, LongestMatch] = {}


def token_counts(docs: DataFrame, pieces: list[bytes], doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, n_tokens, most_in_word: one row per row of ``docs``.

    Words are the runs of non-space bytes (space, U+0009 to U+000D), each matched with one
    space before it, as byte-level vocabularies write word starts. Null and empty texts have no
    words and no tokens. Nothing is shuffled; texts are read whole. The vocabulary is checked to
    be of at most MOST_PIECES pieces before it is broadcast.
    """
    if len(pieces) > MOST_PIECES:
        raise ValueError(f"a vocabulary of {len(pieces)} pieces is not broadcast; the bound is {MOST_PIECES}")
    shared = docs.sparkSession.sparkContext.broadcast(pieces)
    mark = hash(tuple(pieces))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mark not in _BUILT:
            _BUILT.clear()
            _BUILT[mark] = LongestMatch(shared.value)
        count = _BUILT[mark].count
        known: dict[bytes, int] = {}
        for b in batches:
            words, total, most = [], [], []
            for x in b.column(1):
                t = x.as_py()
                n = []
                for w in t.encode("utf-8", "surrogatepass").split() if t else ():
                    k = known.get(w)
                    if k is None:
                        if len(known) >= REMEMBERED:
                            known.clear()
                        k = known[w] = count(b" " + w)
                    n.append(k)
                words.append(len(n))
                total.append(sum(n))
                most.append(max(n, default=0))
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.int64()) for c in (words, total, most)]], names=["doc_id", "n_words", "n_tokens", "most_in_word"])

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text")).mapInArrow(scan, "doc_id long, n_words long, n_tokens long, most_in_word long")
