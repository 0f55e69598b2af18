"""Best-fit packing of tokenised documents into sequences of a fixed number of tokens.

Lengths are whole numbers up to the capacity, so how many pieces there are of each length tells
all that packing needs: a plan is made from these counts, which are as many as the capacity,
however large the corpus. Large pieces (more than a third of the capacity) come first: no sequence
holds three, and the largest is matched with the largest other that fits, which pairs as many as
can be. Smaller ones, in falling length, go where they leave the smallest gap. The plan deals
ranks: the pieces of a length, numbered in the order of the table, are cut into stretches, each of
which fills a row of equal sequences. Pieces find their stretch by a join with the plan.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator, Mapping
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from catalume.llm.common import fresh
from catalume.llm.tokens import byte_symbols
from catalume.sources.scratch import stage_table

#: Tokens of a sequence, and the id that ends a document.
CAPACITY, END = 1024, 2
#: Words of a block of texts, words that are encoded at once, and words that a worker remembers.
BLOCK, AT_ONCE, REMEMBERED = 200_000, 2_000, 1_000_000

_LOOSE = re.compile(r"\s\s")
_CUT = re.compile(r"(?<!\s)(?= )")
_STOPS = ".,;:!?"
#: Letters by any version of Unicode; the characters by which byte-level vocabularies write bytes, and a blank.
_LETTERS = re.compile("[A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u024F]+")
_SYMBOLS = {b: c for c, b in byte_symbols().items()}
BLANK = _SYMBOLS[32]


class WordIds:
    """Token ids of texts by a tokenizer file, word by word.

    Byte-level pre-tokenizers always cut before white space that follows something else, after a single line break,
    and between a letter and a full stop, comma or the like. So a text is a row of words, each
    with the blank before it (strings here), and of starts of lines and stops, without one (bytes). Words are encoded
    many at once when they are first met; the lengths of tokens tell them apart. A tokenizer
    of another kind encodes whole texts.
    """

    def __init__(self, file: str, end: int):
        self.tokenizer, self.end = Tokenizer.from_str(file), end
        told = json.loads(file)
        pre, added = told.get("pre_tokenizer") or {}, told.get("added_tokens") or []
        self.by_word = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space") and not told.get("normalizer") and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.bytes_of = np.zeros(max(vocab.values()) + 1, np.int64)
        for piece, i in vocab.items():
            self.bytes_of[i] = len(piece)  # a character for each byte
        for t in added:
            self.bytes_of[t["id"]] = len(t["content"].encode())
        self._forget()

    def _forget(self) -> None:
        self.number: defaultdict[str | bytes | None, int] = defaultdict()
        self.number.default_factory = self.number.__len__  # a new word gets the next number
        self.number[None]  # the end
        self.first, self.many, self.flat = np.zeros(1, np.int64), np.ones(1, np.int64), np.array([self.end], np.uint32)

    def _ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of numbered words, one after the other, and how many there are up to each."""
        n = self.many[at]
        upto = np.cumsum(n)
        return self.flat[np.repeat(self.first[at] - (upto - n), n) + np.arange(upto[-1] if len(upto) else 0)], upto

    def _know(self, at: list[int], ids: np.ndarray, many: np.ndarray) -> None:
        self.first[at] = len(self.flat) + np.cumsum(many) - many
        self.many[at] = many
        self.flat = np.concatenate((self.flat, ids.astype(np.uint32)))

    def _encode(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _alone(self, at: list[int], texts: list[str]) -> None:
        ids = self._encode(texts)
        self._know(at, np.array([i for x in ids for i in x], np.uint32), np.array([len(x) for x in ids], np.int64))

    def _together(self, at: list[int], words: list[str], before: str) -> None:
        """Encode words as one text, each after a blank that is its own, or a line break that is not."""
        ids = np.array(self._encode([before + before.join(words)])[0], np.int64)
        ends = np.cumsum(np.array([len(w.encode()) + 1 for w in words]))
        read = np.cumsum(self.bytes_of[ids])
        stop = np.searchsorted(read, ends)
        fits = stop[-1] == len(ids) - 1 and np.array_equal(read[stop], ends)
        many = np.diff(stop, prepend=-1)
        if before == "\n" and fits:
            breaks = stop + 1 - many
            fits = bool((self.bytes_of[ids[breaks]] == 1).all())
            ids, many = np.delete(ids, breaks), many - 1
        if fits:
            self._know(at, ids, many)
        else:  # tokens that aren't as long as they say
            self._alone(at, [f"{before if before == ' ' else ''}{w}" for w in words])

    def _letters(self, at: list[int], words: list[str]) -> None:
        """Words of letters only, in the characters that stand for bytes, go to the merges as they are."""
        tokenize = self.tokenizer.model.tokenize
        ids = [[t.id for t in tokenize(w)] for w in words]
        self._know(at, np.fromiter(chain.from_iterable(ids), np.uint32), np.fromiter(map(len, ids), np.int64, len(ids)))

    def _learn(self) -> None:
        """Encode the words that are new."""
        number, known = self.number, len(self.first)
        new = list(islice(number, known, None))
        letters, spaced, starts, alone = ([], []), ([], []), ([], []), ([], [])
        stopped: list[tuple[int, int, int]] = []
        letter, k = _LETTERS.fullmatch, known - 1
        for w in new:  # grows while stems and stops are new
            k += 1
            blank = w.__class__ is str
            text = w if blank else w.decode()
            if not self.by_word or not text or text[-1].isspace() or (not blank and text[0].isspace()):
                kind, text = alone, f" {text}" if blank else text
            elif letter(text):
                kind, text = letters, f"{BLANK if blank else ''}{text if text.isascii() else text.encode().decode('latin-1').translate(_SYMBOLS)}"
            elif blank and text[-1] in _STOPS and letter(stem := text.rstrip(_STOPS)):
                parts = (stem, text[len(stem) :].encode())
                new += [x for x in parts if x not in number]
                stopped.append((k, *(number[x] for x in parts)))
                continue
            else:
                kind = spaced if blank else starts
            kind[0].append(k)
            kind[1].append(text)
        self.first, self.many = (np.append(x, np.zeros(len(number) - known, np.int64)) for x in (self.first, self.many))
        if letters[0]:
            self._letters(*letters)
        for (at, words), before in ((spaced, " "), (starts, "\n")):
            for a in range(0, len(words), AT_ONCE):
                self._together(at[a : a + AT_ONCE], words[a : a + AT_ONCE], before)
        if alone[0]:
            self._alone(*alone)
        if stopped:
            both = np.array(stopped, np.int64)
            ids, upto = self._ids(both[:, 1:].ravel())
            self._know(both[:, 0].tolist(), ids, np.diff(upto[1::2], prepend=0))

    def of(self, texts: list[list[str | bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of texts, given as words, each with the end, one after the other; and how many each has."""
        if len(self.number) > REMEMBERED:
            self._forget()
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(chain(w, (None,)) for w in texts)), np.int64)
        self._learn()
        ids, upto = self._ids(at)
        stop = np.cumsum(np.array([len(w) + 1 for w in texts], np.int64))
        return ids, np.diff(upto[stop - 1], prepend=0)

    def words(self, text: str) -> list[str | bytes]:
        """The words of a text: strings without the blank before them, bytes where there is none."""
        if not self.by_word:
            return [text.encode()]
        if _LOOSE.search(text) is not None:
            first, *rest = _CUT.split(text)
            return [first.encode(), *(w[1:] for w in rest)]
        out: list[str | bytes] = []
        for line in text.split("\n"):
            first, *rest = line.split(" ")
            out.append(first.encode())
            out += rest
            out.append(b"\n")
        out.pop()
        return out


_BUILT: dict[str, WordIds] = {}

#: Columns that are added.
NEW = ("piece", "start", "length", "ids")


def token_pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END, text: str = "text") -> DataFrame:
    """``docs`` without the text, a row for each piece: piece (from 0), start (ids before it), length, ids (little-endian, 4 bytes each).

    The ids of a text, by the tokenizer file (JSON, read on the driver), and the id ``end`` make one
    piece; those of a longer one than ``capacity`` make full pieces after a first one that takes what is over.
    Null and empty texts are the end alone. Texts of any length are read whole. Repeated rows
    give pieces each. Other columns come back as they are; those named as the new ones are
    replaced. An empty table gives an empty one.
    """
    with open(tokenizer, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    other = [c for c in docs.columns if c != text and c.lower() not in NEW]
    row = F.struct(*[docs[c] for c in other]) if other else F.struct(F.lit(0).alias("none"))
    x = docs.select(row.alias("row"), docs[text].cast("string").alias("text"))
    schema = T.StructType([x.schema["row"], *(T.StructField(c, k) for c, k in zip(NEW, (T.IntegerType(), T.LongType(), T.LongType(), T.BinaryType()), strict=True))])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark = f"{tokenizer}:{len(shared.value)}:{end}"
        if mark not in _BUILT:
            _BUILT.clear()
            _BUILT[mark] = WordIds(shared.value, end)
        known = _BUILT[mark]
        for b in batches:
            at = 0
            while at < len(b):
                texts, size, low = [], 0, at
                while at < len(b) and (size < BLOCK or not texts):
                    texts.append(known.words(b.column(1)[at].as_py() or ""))
                    size += len(texts[-1])
                    at += 1
                yield from _pieces(b.slice(low, at - low), *known.of(texts), capacity).to_batches()

    out = x.mapInArrow(scan, schema)
    return out.select(*[F.col("row")[c].alias(c) for c in other], *NEW)


def _pieces(rows: pa.RecordBatch, ids: np.ndarray, lengths: np.ndarray, capacity: int) -> pa.Table:
    n = -(-lengths // capacity)
    of = np.repeat(np.arange(len(lengths)), n)
    piece = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    over = (lengths - (n - 1) * capacity)[of]
    start = np.where(piece == 0, 0, over + (piece - 1) * capacity)
    length = np.where(piece == 0, over, capacity)
    offsets = np.append(0, 4 * np.cumsum(length))
    # large offsets: ids of a block may have more bytes than 2 ** 31
    data = pa.Array.from_buffers(pa.large_binary(), len(of), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
    columns = [rows.column(0).take(pa.array(of)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), data.cast(pa.binary())]
    return pa.Table.from_arrays(columns, names=["row", *NEW])


def packing_plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Rows (length, first, upto, sequence, each, offset): pieces of a length with ranks from ``first`` to before ``upto`` go to the sequences from ``sequence`` on, ``each`` into one, from ``offset`` on.

    Rows are bounded by the capacity, whatever the counts are: a stretch of equal sequences is cut
    twice by a length at most, and filled again only by smaller lengths than its gap.
    """
    left = [0] * (capacity + 1)
    for size, n in counts.items():
        left[size] = n
    rank = [0] * (capacity + 1)
    rows: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap: stretches (first sequence, sequences)
    open_ = 0  # bit g: there are sequences of gap g
    made = 0

    def put(size: int, n: int, sequence: int, each: int, offset: int) -> None:
        rows.append((size, rank[size], rank[size] + n, sequence, each, offset))
        rank[size] += n
        left[size] -= n

    def leave(gap: int, first: int, n: int) -> None:
        nonlocal open_
        if gap and n:
            gaps.setdefault(gap, []).append((first, n))
            open_ |= 1 << gap

    least = capacity // 3 + 1
    for a in range(capacity, least - 1, -1):
        b = min(a, capacity - a)
        while left[a]:
            while b >= least and left[b] < 1 + (a == b):
                b -= 1
            n = left[a] if b < least else left[a] // 2 if a == b else min(left[a], left[b])
            put(a, n, made, 1, 0)
            if b >= least:
                put(b, n, made, 1, a)
            leave(capacity - a - (b if b >= least else 0), made, n)
            made += n
    for a in range(least - 1, 0, -1):
        while left[a]:
            fits = open_ >> a
            if not fits:
                n = -(-left[a] // (capacity // a))
                leave(capacity, made, n)
                made += n
                continue
            gap = a + (fits & -fits).bit_length() - 1
            first, n = gaps[gap].pop()
            if not gaps[gap]:
                open_ &= ~(1 << gap)
            each = gap // a
            full = min(n, left[a] // each)
            if full:
                put(a, full * each, first, each, capacity - gap)
                leave(gap - each * a, first, full)
            rest = min(left[a], each) if full < n else 0
            if rest:
                put(a, rest, first + full, rest, capacity - gap)
                leave(gap - rest * a, first + full, 1)
            leave(gap, first + full + bool(rest), n - full - bool(rest))
    return rows


def pack(pieces: DataFrame, length: str = "length", capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with sequence_id (from 0) and offset: where in which sequence of ``capacity`` tokens each goes.

    Each piece is in one sequence; the pieces of a sequence follow each other from 0 without gaps.
    Lengths that are null, less than 1 or more than the capacity can't be packed and get nulls.
    Repeated rows are pieces of their own. Columns named as the new ones are replaced. An empty
    table gives an empty one. Only counts for each length go to the driver, and the plan, bounded by
    the capacity, is broadcast. Pieces of one length, however many, are numbered by part of the
    table and carried on by counts of parts.
    """
    x = pieces.drop("sequence_id", "offset")
    at, part, place, before, size, low, high, sequence, each, offset = fresh(x, "_at", "_part", "_place", "_before", "_size", "_low", "_high", "_sequence", "_each", "_offset")
    x = stage_table(x.withColumn(at, F.monotonically_increasing_id()), "pieces")
    x = x.withColumn(size, F.when(F.col(length).between(1, capacity), F.col(length).cast("int"))).withColumn(part, F.shiftright(at, 33))
    counts = x.filter(F.col(size).isNotNull()).groupBy(size, part).agg(F.count(F.lit(1)).alias("n"))
    plan = packing_plan({r[0]: r[1] for r in counts.groupBy(size).agg(F.sum("n")).collect()}, capacity)
    w = Window.partitionBy(size).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(size, part, F.coalesce(F.sum("n").over(w), F.lit(0)).alias(before))
    x = x.withColumn(place, F.row_number().over(Window.partitionBy(size, part).orderBy(at)) - 1).join(starts, [size, part], "left")
    x = x.withColumn(place, F.col(place) + F.col(before)).drop(before)
    rows = x.sparkSession.createDataFrame(plan, f"{size}_p int, {low} long, {high} long, {sequence} long, {each} long, {offset} long")
    x = x.join(F.broadcast(rows), (F.col(size) == F.col(f"{size}_p")) & (F.col(place) >= F.col(low)) & (F.col(place) < F.col(high)), "left")
    nth = F.col(place) - F.col(low)
    return x.select(
        *[c for c in pieces.columns if c.lower() not in ("sequence_id", "offset")],
        (F.col(sequence) + F.floor(nth / F.col(each))).cast("long").alias("sequence_id"), (F.col(offset) + nth % F.col(each) * F.col(size)).cast("long").alias("offset"),
    )


def packing_report(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row per piece of each document."""
    x = token_pieces(docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"]), tokenizer, capacity, end)
    return pack(x.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32")), capacity=capacity)
