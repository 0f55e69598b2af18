"""Language identification by a byte convolutional network, trained in numpy.

Filters of several widths run over windows of bytes of fixed length, the largest response of each
filter in a window goes to a softmax over languages. All byte values are told apart but for case
of A-Z, digits, and kinds of white space. A text is cut into windows from its first to its last
byte, which overlap so that no filter misses a place; their log-probabilities are averaged, each
by the bytes that it adds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from catalume.sources.scratch import stage_table

#: Bytes of a window, widths of the filters, filters of each width.
WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
#: The sample to fit on: about so many documents of each language, three windows of each, and fewer
#: of each if there are so many languages that they would be more than this in all. All are learned.
PER_LANGUAGE, MOST_DOCUMENTS = 300, 60_000
EPOCHS, BATCH, RATE = 12, 64, 0.02
#: Windows that are scored together.
TOGETHER = 256
CLASSES = 256
#: Bytes from one window to the next.
STRIDE = WINDOW - max(WIDTHS) + 1


def _classes() -> bytes:
    """A-Z as a-z, digits as 0, white space as a space; other bytes are themselves. 0 pads."""
    table = bytearray(range(256))
    for b in range(26):
        table[65 + b] = 97 + b
    for b in range(10):
        table[48 + b] = 48
    for b in range(9, 14):
        table[b] = 32
    return bytes(table)


TABLE = _classes()


def windows(text: str) -> np.ndarray:
    """The whole text as rows of WINDOW byte classes, STRIDE apart; the last is padded."""
    x = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(TABLE), np.uint8)
    n = 1 + max(0, -(-(len(x) - WINDOW) // STRIDE))
    out = np.zeros((n - 1) * STRIDE + WINDOW, np.uint8)
    out[: len(x)] = x
    return np.lib.stride_tricks.sliding_window_view(out, WINDOW)[::STRIDE]


def weights(n_bytes: int, n: int) -> np.ndarray:
    """Bytes that each window of a text adds: the first all, others what doesn't overlap."""
    out = np.full(n, STRIDE)
    out[0] = min(n_bytes, WINDOW)
    if n > 1:
        out[-1] = n_bytes - WINDOW - (n - 2) * STRIDE
    return out


class ByteNet:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.filters = [rng.normal(0, 0.3, (k, CLASSES, FILTERS)).astype(np.float32) for k in WIDTHS]
        for w in self.filters:
            w[:, 0] = 0  # padding
        self.out = rng.normal(0, 0.1, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def responses(self, x: np.ndarray) -> list[np.ndarray]:
        """For each width, windows x positions x filters."""
        out = []
        for w, k in zip(self.filters, WIDTHS, strict=True):
            n = x.shape[1] - k + 1
            r = w[0][x[:, :n]]
            for o in range(1, k):
                r = r + w[o][x[:, o : o + n]]
            out.append(r)
        return out

    def fit(self, x: np.ndarray, y: np.ndarray, seed: int = 7) -> None:
        """Adam on the cross-entropy. Only the best position of a filter in a window has a gradient."""
        rng = np.random.default_rng(seed)
        params = [*self.filters, self.out, self.bias]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for epoch in range(EPOCHS):
            order = rng.permutation(len(x))
            for a in range(0, len(x), BATCH):
                b = order[a : a + BATCH]
                xb, yb = x[b], y[b]
                r = self.responses(xb)
                best = [q.argmax(1) for q in r]
                h = np.concatenate([np.take_along_axis(q, p[:, None], 1)[:, 0] for q, p in zip(r, best, strict=True)], 1)
                act = np.maximum(h, 0)
                z = act @ self.out + self.bias
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(b)), yb] -= 1
                p /= len(b)
                back = (p @ self.out.T) * (h > 0)
                grads = []
                for i, (w, k, at) in enumerate(zip(self.filters, WIDTHS, best, strict=True)):
                    g = np.zeros_like(w)
                    part = back[:, i * FILTERS : (i + 1) * FILTERS]
                    f = np.broadcast_to(np.arange(FILTERS), at.shape)
                    for o in range(k):
                        np.add.at(g[o], (np.take_along_axis(xb, at + o, 1), f), part)
                    g[:, 0] = 0
                    grads.append(g)
                grads += [act.T @ p, p.sum(0)]
                t += 1
                rate = RATE * (1 - epoch / EPOCHS)
                for q, g, mm, vv in zip(params, grads, m, v, strict=True):
                    mm += 0.1 * (g - mm)
                    vv += 0.01 * (g * g - vv)
                    q -= (rate / (1 - 0.9**t)) * mm / (np.sqrt(vv / (1 - 0.99**t)) + 1e-6)

    def tables(self) -> list[np.ndarray]:
        """Responses of the filters to two classes at once: fewer look-ups for each byte."""
        pair = lambda a, b: (a[:, None] + b[None]).reshape(CLASSES * CLASSES, FILTERS)
        two, three, four = self.filters
        return [pair(two[0], two[1]), pair(three[0], three[1]), three[2], pair(four[0], four[1]), pair(four[2], four[3])]

    def log_probabilities(self, x: np.ndarray, tables: list[np.ndarray]) -> np.ndarray:
        """One row for each window."""
        out = []
        for a in range(0, len(x), TOGETHER):
            w = x[a : a + TOGETHER]
            code = w[:, :-1].astype(np.int32) * CLASSES + w[:, 1:]
            h = [
                np.take(tables[0], code, 0).max(1),
                (np.take(tables[1], code[:, :-1], 0) + np.take(tables[2], w[:, 2:], 0)).max(1),
                (np.take(tables[3], code[:, :-2], 0) + np.take(tables[4], code[:, 2:], 0)).max(1),
            ]
            z = np.maximum(np.concatenate(h, 1), 0) @ self.out + self.bias
            z = z - z.max(1, keepdims=True)
            out.append(z - np.log(np.exp(z).sum(1, keepdims=True)))
        return np.concatenate(out)


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of the id, as text, is 2 modulo 4; the id null counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> ByteNet | None:
    """Fit on a bounded sample of the labelled rows that aren't held out; None without any.

    About PER_LANGUAGE documents of each language (fewer if that would be more than
    MOST_DOCUMENTS in all) by hash of id and text, repeated ones once, and of each the first, the
    middle and the last WINDOW characters.
    """
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"), docs[lang].alias("lang"))
    d = d.filter(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    counts = stage_table(d.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "languages")
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return None
    per = max(1, min(PER_LANGUAGE, MOST_DOCUMENTS // len(languages)))
    piece = lambda at: F.substring("text", at.cast("int"), F.lit(WINDOW))
    size = F.length("text")
    take = d.join(counts, "lang").filter(F.pmod(F.xxhash64("doc_id", "text"), F.col("n")) < per)
    rows = take.select("doc_id", "lang", F.array(piece(F.lit(1)), piece(F.greatest(F.lit(1), F.floor(size / 2) - WINDOW // 2)), piece(F.greatest(F.lit(1), size - WINDOW + 1))).alias("parts")).distinct().collect()
    x, y = [], []
    for r in sorted(rows, key=lambda r: (r["doc_id"] is None, r["doc_id"], r["lang"], r["parts"])):
        for part in set(r["parts"]):
            x.append(windows(part)[0])
            y.append(languages.index(r["lang"]))
    net = ByteNet(languages)
    if len(languages) > 1:
        order = np.lexsort(np.array(x).T[::-1])
        net.fit(np.array(x)[order], np.array(y)[order])
    return net


def identify(docs: DataFrame, net: ByteNet | None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1): one row per row of ``docs``; only the text is looked at.

    Null and empty texts, texts without a letter, and all texts if nothing could be learned are
    'und' with score 0. Very long texts are scored window by window, all of them; repeated rows
    each on its own; other columns aren't looked at. The broadcast network has some 40,000 weights
    and 49 for each language.
    """
    spark = docs.sparkSession
    lettered = F.coalesce(docs[text].rlike(r"\p{L}"), F.lit(False))
    d = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.when(lettered, docs[text]).alias("text"))
    shared = spark.sparkContext.broadcast(net)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = shared.value
        tables = n.tables() if n else None
        for b in batches:
            pred, score = ["und"] * b.num_rows, [0.0] * b.num_rows
            texts = b.column(1)
            start = 0
            while n is not None and start < b.num_rows:
                parts, rows, total, sizes = [], [], 0, []
                while start < b.num_rows and total < 16 * TOGETHER:
                    t = texts[start].as_py()
                    if t:
                        parts.append(windows(t))
                        rows.append(start)
                        sizes.append(len(t.encode("utf-8", "surrogatepass")))
                        total += len(parts[-1])
                    start += 1
                if not rows:
                    continue
                log = n.log_probabilities(np.concatenate(parts), tables)
                log *= np.concatenate([weights(k, len(p)) for k, p in zip(sizes, parts, strict=True)])[:, None]
                mean = np.add.reduceat(log, np.cumsum([0] + [len(p) for p in parts[:-1]]), 0) / np.array(sizes)[:, None]
                p = np.exp(mean - mean.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                for r, k, s in zip(rows, p.argmax(1), p.max(1), strict=True):
                    pred[r], score[r] = n.languages[k], float(s)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(pred), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return d.mapInArrow(scan, "doc_id long, lang_pred string, score double")


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score: one row per document row."""
    return identify(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
