"""A probabilistic suffix tree over words: counting, divergence tests and scoring by longest suffix.

The tree (Ron, Singer and Tishby, 1996) has a state for each retained context of one to ``depth``
words. Evidence is absolute, whatever the size of the corpus: a word has an own estimate in a
state if it followed the context ``least`` times or more, and a context is retained if its count
times the divergence of its next-word distribution from that of its longest retained suffix is
``divergence`` nats or more. The rest of the mass of a state goes to the distribution of its
longest retained suffix, at the root to that of single words with one added to each count.

The tree grows with the corpus, so no task and no driver ever holds it. Texts are put into chunks
of about ``chunk`` words, once, and meet the corpus level by level. In a meeting each chunk sends
every distinct run of words once, as a 64-bit hash, with what it counts of it; the hashes are dealt
to buckets by their leading bits, a bucket adds up the chunks and answers each of them. Runs of
m words are counted only where both runs of m - 1 words in them occurred ``least`` times, which
loses none that does, and not where their count follows from that of a shorter run. Words, pairs or documents that are everywhere thus cost one hash a chunk and
make no hot task. Messages are sorted, as differences and by planes of bytes, and compressed.
A meeting is held in rounds, each with a part of the buckets, so that only a part of the messages
is on disk at a time.

Meeting m counts runs of m words and tests the contexts of m - 2 words.
"""

from __future__ import annotations

import functools
import gc
import uuid
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from catalume.sources.scratch import scratch_dir, stage_table


@dataclass(frozen=True)
class Settings:
    """How a tree is learned (the first four), and how the work is cut up (no result depends on it)."""

    #: Words of the longest contexts.
    depth: int = 4
    #: Times that a context and word must follow each other for an own estimate.
    least: int = 2
    #: What is taken from each count with an own estimate and given to the suffix; a multiple of 1/4.
    discount: float = 0.75
    #: A context is retained if its count times the divergence from its suffix (in nats) is this or more.
    divergence: float = 6.0
    #: Words of a chunk (one more text may end it), and bytes of text for each bucket of hashes and of chunks.
    chunk: int = 700_000
    bucket: int = 16_000_000
    #: Rounds of a large meeting (the first and the last are small), and buckets that a round has at least.
    rounds: int = 3
    least_buckets: int = 12


END = b"\n"  # no word holds white space

_MESSAGE = "what string, level int, bucket int, chunk long, keys binary, x binary, y binary, z binary"
_ANSWER = "what string, level int, bucket int, chunk long, data binary, total long, kinds long"


def tokens(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) words of a text in UTF-8 and the end."""
    words = text.lower().split() if text else []
    words.append(END)
    return words


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as text, is 2 modulo 7; the id null counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def _pack(x: np.ndarray) -> bytes:
    """Numbers in the fewest bytes, first the lowest bytes of all, then the next, compressed."""
    if x.dtype.kind in "iu" and x.dtype != np.uint8:
        top = int(x.max()) if len(x) else 0
        x = x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max), copy=False)
    bits = np.ascontiguousarray(x).view(f"u{x.itemsize}")
    planes = np.empty((x.itemsize, len(x)), np.uint8)
    for j in range(x.itemsize):
        planes[j] = bits >> (8 * j)
    return x.dtype.str.encode() + zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes) -> np.ndarray:
    kind = np.dtype(data[:3].decode())
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[3:]), np.uint8).reshape(kind.itemsize, -1)
    bits = planes[0].astype(f"u{kind.itemsize}")
    for j in range(1, kind.itemsize):
        if planes[j].any():
            bits |= planes[j].astype(bits.dtype) << (8 * j)
    return bits.view(kind)


def _by_frequency(ids: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words numbered anew: frequent ones first, those of about the same frequency (ranks of as many
    binary digits) by hash, so that both the numbers and the differences of hashes are small."""
    digits = np.empty(len(hashes), np.int32)
    digits[np.argsort(-np.bincount(ids, minlength=len(hashes)), kind="stable")] = np.frexp(np.arange(1, len(hashes) + 1))[1]
    order = np.lexsort((hashes, digits))
    number = np.empty(len(hashes), np.uint32)
    number[order] = np.arange(len(hashes), dtype=np.uint32)
    return number[ids], hashes[order]


def _sorted_keys(data: bytes) -> np.ndarray:
    """Sums of differences."""
    return np.cumsum(_unpack(data).astype(np.uint64), dtype=np.uint64)


def _table(schema: str, rows: list[dict]) -> pa.Table:
    kinds = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [f.split() for f in schema.split(", ")]
    return pa.table({name: pa.array([r.get(name) for r in rows], kinds[kind]) for name, kind in fields})


#: A chunk has one row with its words, and one for each level of what it knows (c or b).
_CHUNK_ROW = "chunk long, what string, level int, data binary, doc_ids binary, no_id binary, held binary, lengths binary, hashes binary, ids binary"


def _chunks(docs: DataFrame, most: int) -> DataFrame:
    """Rows (doc_id, held, text) as chunks: their words as numbers into the hashes of the chunk's words."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = TaskContext.get().partitionId() << 32
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__  # a new word gets the next number
        ids, lengths, doc_ids, held = [], [], [], []
        size = 0

        def give() -> Iterator[pa.RecordBatch]:
            words, hashes = _by_frequency(np.concatenate(ids), np.fromiter(map(xxhash.xxh3_64_intdigest, number), np.uint64, len(number)))
            row = {
                "chunk": made, "what": "words", "doc_ids": _pack(np.array([d or 0 for d in doc_ids], np.int64).view(np.uint64)), "no_id": _pack(np.array([d is None for d in doc_ids], np.uint8)),
                "held": _pack(np.array(held, np.uint8)), "lengths": _pack(np.array(lengths)),
                "hashes": _pack(np.diff(hashes, prepend=np.uint64(0))), "ids": _pack(words),
            }
            yield from _table(_CHUNK_ROW, [row]).to_batches()

        for b in batches:
            for d, h, t in zip(b.column(0), b.column(1), b.column(2).cast(pa.binary()), strict=True):
                words = tokens(t.as_py())
                ids.append(np.fromiter(map(number.__getitem__, words), np.uint32, len(words)))
                lengths.append(len(words))
                doc_ids.append(d.as_py())
                held.append(h.as_py())
                size += len(words)
                if size >= most:
                    yield from give()
                    made, size = made + 1, 0
                    number.clear()
                    ids, lengths, doc_ids, held = [], [], [], []
        if size:
            yield from give()

    return docs.mapInArrow(scan, _CHUNK_ROW)


def _bucket(x: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of hashes, in their order."""
    return (x >> np.uint64(40)) * np.uint64(buckets) >> np.uint64(24)


@dataclass(frozen=True)
class _Round:
    """A part of the buckets of a meeting: of ``buckets``, those from ``start`` to before ``stop``."""

    buckets: int
    start: int
    stop: int

    def has(self, x: np.ndarray) -> np.ndarray:
        """Whether the hashes are in its buckets."""
        number = _bucket(x, self.buckets)
        return (number >= self.start) & (number < self.stop)


def _rounds(meeting: int, how: Settings, buckets: int) -> list[_Round]:
    """Each bucket is in one round."""
    n = max(1, min(how.rounds, buckets // how.least_buckets)) if 1 < meeting < how.depth + 2 else 1
    return [_Round(buckets, r * buckets // n, (r + 1) * buckets // n) for r in range(n)]


def _stir(x: np.ndarray) -> None:
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)


def _before(x: np.ndarray) -> np.ndarray:
    """What is at the place before."""
    return np.concatenate((x[:1], x[:-1]))


class _Chunk:
    """A chunk, with what it knows so far: c[m] is the count of the run of m words that ends at a
    place (0 if it is less than ``least``), b[k] four times the mass of own estimates of the
    context of k words before it (1: it has some but isn't retained; 0: it has none, so longer
    contexts have none either and need no test). Of level 1 both are also kept by word
    (``of_word``), which takes less room. Arrays have the smallest type that holds them.

    A context is settled at a place if all its occurrences are followed by the word there. Longer
    contexts then say the same on less evidence, are never retained, and need no test; and runs
    that end with a settled context and this word are as many as those without the word.
    """

    def __init__(self, row: dict, how: Settings):
        self.how = how
        self.chunk = row["chunk"]
        self.ids, self.lengths = (_unpack(row[c]) for c in ("ids", "lengths"))
        self.word_hash = _sorted_keys(row["hashes"])  # differences below 0 have wrapped around, as the sums do
        self.lengths = self.lengths.astype(np.int64)
        self.held = _unpack(row["held"]).astype(bool)
        self.doc_ids, self.no_id = _unpack(row["doc_ids"]).astype(np.uint64).view(np.int64), _unpack(row["no_id"]).astype(bool)
        self.first = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(~self.held, self.lengths)
        self.c: dict[int, np.ndarray] = {}
        self.b: dict[int, np.ndarray] = {}
        self.of_word: dict[str, np.ndarray] = {}

    def inside(self, k: int) -> np.ndarray:
        """Whether the text has k words before a place."""
        out = np.ones(len(self.ids), bool)
        for j in range(k):
            out[np.minimum(self.first + j, len(out) - 1)] = False
        if k:
            out[self.first[self.lengths <= k] + self.lengths[self.lengths <= k] - 1] = False
        return out

    def runs(self, ends: np.ndarray, m: int) -> np.ndarray:
        """Hashes of the m words that end at the given places."""
        out = self.word_hash[self.ids[ends - (m - 1)]]
        for j in range(m - 2, -1, -1):
            out *= np.uint64(0x9E3779B97F4A7C15)
            out += self.word_hash[self.ids[ends - j]]
            _stir(out)
        return out

    def settled(self, k: int) -> np.ndarray:
        c = self.c[k + 1]
        return (c >= self.how.least) & (c == _before(self.c[k])) & self.inside(k)

    def counted(self, m: int) -> np.ndarray:
        """Places whose run of m words is counted."""
        often = self.c[m - 1] >= self.how.least
        ask = self.inside(m - 1) & often & _before(often)
        return np.flatnonzero(ask & ~self.settled(m - 2) if m > 2 else ask)

    def tested(self, k: int) -> np.ndarray:
        """Places whose context of k words may be retained: not if the context has as many
        occurrences as it takes, and this one isn't among those of an own estimate."""
        n = _before(self.c[k])
        dead = self.train & (n == self.how.least) & (self.c[k + 1] < self.how.least)
        ask = self.inside(k) & (n >= self.how.least) & ~dead
        return np.flatnonzero(ask & (self.b[k - 1] != 0) & ~self.settled(k - 1) if k > 1 else ask)

    def distinct(self, what: str, m: int, part: _Round | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The distinct sorted hashes that the chunk asks for (in a round, or in all); places; and the hash of each place."""
        some = part if part and part.stop - part.start < part.buckets else None
        if what == "count" and m == 1:
            places = np.arange(len(self.ids))
        else:
            places = self.counted(m) if what == "count" else self.tested(m)
        if m == 1:
            words = self.ids[places if what == "count" else places - 1]
            if some:
                here = some.has(self.word_hash)[words]
                places, words = places[here], words[here]
            asked = np.zeros(len(self.word_hash), bool)
            asked[words] = True
            u, rank = np.unique(self.word_hash[asked], return_inverse=True)
            return u, places, rank[np.cumsum(asked)[words] - 1]
        hashes = self.runs(places if what == "count" else places - 1, m)
        if some:
            here = some.has(hashes)
            places, hashes = places[here], hashes[here]
        u, at = np.unique(hashes, return_inverse=True)
        return u, places, at

    def take(self, what: str, m: int, answers: list[np.ndarray]) -> None:
        """Put the answers, in the order of the hashes, to their places."""
        _, places, at = self.distinct(what, m)
        said = np.concatenate(answers) if answers else np.zeros(0, np.uint8)
        if m == 1:
            of_word = np.zeros(len(self.word_hash), said.dtype)
            of_word[self.ids[places if what == "count" else places - 1]] = said[at]
            return self.put("c" if what == "count" else "b", 1, of_word)
        out = np.zeros(len(self.ids), said.dtype)
        out[places] = said[at]
        if what == "count" and m > 2:
            out = np.where(self.settled(m - 2), _before(self.c[m - 1]), out)
        return self.put("c" if what == "count" else "b", m, out)

    def known(self, what: str, m: int) -> dict:
        """The row of a level."""
        v = self.c[m] if what == "c" else self.b[m]
        return {"chunk": self.chunk, "what": what, "level": m, "data": _pack(self.of_word[what] if m == 1 else v)}

    def put(self, what: str, m: int, values: np.ndarray) -> None:
        """What is known of a level."""
        if m == 1:
            self.of_word[what] = values
            values = values[self.ids] if what == "c" else np.where(self.inside(1), _before(values[self.ids]), 0).astype(values.dtype)
        (self.c if what == "c" else self.b)[m] = values

    def root(self, total: int, kinds: int, places: np.ndarray | slice = slice(None)) -> np.ndarray:
        return ((self.of_word["c"].astype(np.float64) + 1) / (total + kinds + 1))[self.ids[places]]

    def probability(self, total: int, kinds: int, upto: int, places: np.ndarray | None = None) -> np.ndarray:
        """Of the words at the places (all) in the longest retained suffix of up to ``upto`` words."""
        places = np.arange(len(self.ids)) if places is None else places
        p = self.root(total, kinds, places)
        for k in range(1, upto + 1):
            some = np.flatnonzero(self.b[k][places] > 1)
            end = places[some]
            b, n, own = (x[at].astype(np.float64) for x, at in ((self.b[k], end), (self.c[k], end - 1), (self.c[k + 1], end)))
            p[some] = (np.where(own >= self.how.least, own - self.how.discount, 0.0) + (n - b / 4) * p[some]) / n
        return p

    def messages(self, what: str, m: int, part: _Round, total: int, kinds: int) -> Iterator[dict]:
        keys, places, at = self.distinct(what, m, part)
        if not len(keys):
            return
        train = self.train[places]
        if what == "count":
            columns = [np.bincount(at[train], minlength=len(keys))]
        else:
            every = np.zeros(len(keys), self.c[m].dtype)
            every[at] = self.c[m][places - 1]
            c = self.c[m + 1][places]
            has = np.flatnonzero(train & (c >= self.how.least))
            at, places, c = at[has], places[has], c[has].astype(np.float64)
            own = c - self.how.discount
            gain = np.log(own / (every[at] * self.probability(total, kinds, m - 1, places)))
            columns = [np.bincount(at, x, len(keys)).astype(np.float32) for x in (own / c * gain, own / c)] + [every]
        number = _bucket(keys, part.buckets)
        start = np.append(0, np.flatnonzero(np.diff(number)) + 1)
        for a, b in zip(start, np.append(start[1:], len(keys)), strict=True):
            sent = {name: _pack(x[a:b]) for name, x in zip("xyz", columns, strict=False)}
            yield {"what": what, "level": m, "bucket": int(number[a]), "chunk": self.chunk, "keys": _pack(np.diff(keys[a:b], prepend=np.uint64(0)))} | sent


def _load(rows: pa.Table, how: Settings) -> _Chunk:
    every = sorted(rows.to_pylist(), key=lambda r: r["level"] or 0)
    x = _Chunk(next(r for r in every if r["what"] == "words"), how)
    for r in every:
        if r["what"] != "words":
            x.put(r["what"], r["level"], _unpack(r["data"]))
    return x


def _hear(x: _Chunk, came: pa.Table, meeting: int) -> None:
    """Take the answers of a meeting, which come in the order of their buckets."""
    rows = sorted(came.to_pylist(), key=lambda r: r["bucket"])
    for what, m in _due(meeting, x.how.depth):
        x.take(what, m, [_unpack(r["data"]) for r in rows if r["what"] == what])


def _due(meeting: int, depth: int) -> list[tuple[str, int]]:
    """What a meeting asks."""
    return [("count", meeting)] * (1 <= meeting <= depth + 1) + [("test", meeting - 2)] * (1 <= meeting - 2 <= depth)


def _answerer(how: Settings) -> Callable[[pa.Table], pa.Table]:
    def answer(group: pa.Table) -> pa.Table:
        """Adds up what the chunks sent a bucket, and answers each of them."""
        rows = group.to_pylist()
        head = {k: rows[0][k] for k in ("what", "level", "bucket")}
        sent = [_sorted_keys(r["keys"]) for r in rows]
        keys, at = np.unique(np.concatenate(sent), return_inverse=True)
        column = lambda c: np.concatenate([_unpack(r[c]) for r in rows])
        summed = lambda c: np.bincount(at, column(c), len(keys))
        out = []
        if head["what"] == "count":
            c = summed("x").astype(np.int64)
            if head["level"] == 1:
                out.append(head | {"what": "total", "chunk": -1, "total": int(c.sum()), "kinds": int((c > 0).sum())})
            else:
                c[c < how.least] = 0
            say = c
        else:
            n = np.zeros(len(keys))
            n[at] = column("z")
            mass = np.round(4 * summed("y")) / 4  # sums of counts less the discount
            rest = n - mass
            # the rest of the mass is compared as one symbol that the suffix gives 1 at most
            gain = summed("x") + rest * np.log(np.maximum(rest, 1e-9) / n)
            kept = (mass > 0) & (gain >= how.divergence)
            say = np.where(kept, 4 * mass, mass > 0).astype(np.int64)
            out.append(head | {"what": "states", "chunk": -1, "data": _pack(np.stack([keys[kept], n[kept].astype(np.uint64), say[kept].astype(np.uint64)], 1).ravel()), "kinds": int(kept.sum())})
        stop = np.cumsum([len(x) for x in sent])
        for r, x, b in zip(rows, sent, stop, strict=True):
            out.append(head | {"chunk": r["chunk"], "data": _pack(say[at[b - len(x) : b]])})
        return _table(_ANSWER, out)

    return answer


def _asker(meeting: int, how: Settings, part: _Round, total: int, kinds: int) -> Callable[[pa.Table], pa.Table]:
    """What a chunk sends to a round of a meeting."""

    def ask(rows: pa.Table) -> pa.Table:
        x = _load(rows, how)
        return _table(_MESSAGE, [r for what, m in _due(meeting, how.depth) for r in x.messages(what, m, part, total, kinds)])

    return ask


def _hearer(meeting: int, how: Settings) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """What a chunk knows from the answers of a meeting."""

    def hear(rows: pa.Table, came: pa.Table) -> pa.Table:
        if not len(rows):
            return _table(_CHUNK_ROW, [])
        x = _load(rows, how)
        _hear(x, came, meeting)
        return _table(_CHUNK_ROW, [x.known("c" if what == "count" else "b", m) for what, m in _due(meeting, how.depth)])

    return hear


def _free(spark: SparkSession, *tables: DataFrame) -> None:
    """Delete staged tables, and shuffle files of jobs that ended: Spark does so when their objects are collected."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for x in tables:
        for folder in {f.rsplit("/", 1)[0] for f in x.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)
    gc.collect()
    spark.range(1, numPartitions=1).count()  # the scheduler holds on to the last job
    jvm.java.lang.System.gc()


_SCORE = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_STATE = "depth int, context long, n long, own double"


def _scores(x: _Chunk, total: int, kinds: int) -> pa.Table:
    root = x.root(total, kinds)
    by_text = lambda v: np.add.reduceat(v, x.first)
    return pa.table({
        "doc_id": pa.array(x.doc_ids, mask=x.no_id), "held_out": pa.array(x.held), "n_tokens": pa.array(x.lengths), "n_known": pa.array(by_text((x.c[1] > 0).astype(np.int64))),
        "train_tokens": pa.array(np.full(len(x.first), total, np.int64)), "base_score": pa.array(by_text(np.log10(root))), "score": pa.array(by_text(np.log10(x.probability(total, kinds, x.how.depth)))),
    })


def learn_and_score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", learn: Column | None = None, how: Settings = Settings()) -> tuple[DataFrame, DataFrame]:
    """Scores of all texts, and the states of the tree that was learned from those with ``learn``.

    Scores: as of :func:`score_texts`. States: depth, context (hash of its words), n (its count),
    own (mass of its own estimates, in counts); the rest of n goes to the longest retained suffix.
    """
    spark = docs.sparkSession
    out_of = ~learn if learn is not None else held_out(docs[doc_id].cast("long"))
    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), out_of.alias("held"), docs[text].alias("text"))
    buckets = 1 + (narrow.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // how.bucket
    # in buckets by chunk: what chunks know is read, and added to, without a shuffle
    name, path = f"chunks_{uuid.uuid4().hex}", f"{scratch_dir(spark)}/chunks-{uuid.uuid4().hex}"

    def save(rows: DataFrame) -> None:
        rows.write.format("parquet").bucketBy(buckets, "chunk").option("path", path).mode("append").saveAsTable(name)

    def by_chunk(answers: DataFrame) -> PandasCogroupedOps:
        return spark.table(name).groupBy("chunk").cogroup(answers.filter("chunk >= 0").groupBy("chunk"))

    save(_chunks(narrow, how.chunk))
    total = kinds = 0
    states = []
    for meeting in range(1, how.depth + 3):
        heard = []
        for part in _rounds(meeting, how, buckets):
            asked = spark.table(name).groupBy("chunk").applyInArrow(_asker(meeting, how, part, total, kinds), _MESSAGE)
            heard.append(stage_table(asked.groupBy("what", "level", "bucket").applyInArrow(_answerer(how), _ANSWER), "answers"))
            del asked
            _free(spark)  # the messages of a round go before the next
        came = functools.reduce(DataFrame.unionByName, heard)
        if meeting == 1:
            total, kinds = came.filter("what = 'total'").agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
        if meeting > 2:
            states.append(stage_table(came.filter("what = 'states' and kinds > 0").select("level", "data"), "states"))
        if meeting < how.depth + 2:
            save(by_chunk(came).applyInArrow(_hearer(meeting, how), _CHUNK_ROW))
            _free(spark, came)

    def score(rows: pa.Table, came: pa.Table) -> pa.Table:
        if not len(rows):
            return _table(_SCORE, [])
        x = _load(rows, how)
        _hear(x, came, how.depth + 2)
        return _scores(x, total, kinds)

    def unfold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for level, data in zip(*b.columns, strict=True):
                key, n, own = _unpack(data.as_py()).astype(np.uint64).reshape(-1, 3).T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), level.as_py(), np.int32)), pa.array(key.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(own / 4)], names=["depth", "context", "n", "own"])

    scores = stage_table(by_chunk(came).applyInArrow(score, _SCORE), "scored")
    chunks = spark.table(name)
    spark.sql(f"drop table {name}")
    _free(spark, came, chunks)
    every = states[0]
    for s in states[1:]:
        every = every.unionByName(s)
    return scores, every.mapInArrow(unfold, _STATE)


def score_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``.

    Learns from the documents that aren't held out. base_score: sum over tokens of
    log10((c + 1) / (N + V + 1)). score: log10 probability of the text in the tree, in which a
    word without an own estimate gets what the state leaves, times the suffix's probability.

    A null text is the end alone; an empty one too. A very long text is a chunk of its own. A null
    doc_id counts as the text '' for the split. Repeated rows are counted and scored each on its
    own. Other columns, whatever their names, are not looked at. An empty table gives an empty
    one; without training texts all counts are 0. Words and runs of words are known by 64-bit
    hashes: two that fall together share their counts.
    """
    return learn_and_score(docs, doc_id, text)[0]
