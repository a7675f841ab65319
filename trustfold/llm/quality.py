"""Document quality by attention over passages (multiple-instance learning).

Every text is cut into passages of equal numbers of bytes. A passage is
encoded by how often each class of character follows each other one, how
varied its words are, and the lengths of words and lines. A document is the
sum of its passages' encodings, weighted by gated attention
(softmax of w . (tanh(V h) * sigmoid(U h))), and one logistic unit scores it.
Only document labels are needed: the attention learns which passages tell.

The weights are fitted on the driver, on a bounded sample of labelled rows;
scoring is a pass over all rows without a shuffle, in chunks of passages, so a
task never holds features of more than CHUNK_BYTES of text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trustfold.functions.storage import durable
from trustfold.llm.columns import text_key, whole

PASSAGE_BYTES = 1024
CHUNK_BYTES = 1 << 19
#: Bytes at which a passage counts for half of what its features say; a few words say little.
SPARSE_BYTES = 64
#: Classes of bytes: other, letters, capitals, digits, space, line end, signs of several kinds, bytes beyond ASCII.
CLASSES = ("", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", " \t", "\n\r", ".", ",;:", "!?", "|", "'\"()-", "#$%&*+/<=>@[\\]^_`{}~")
N_CLASSES = len(CLASSES) + 1
N_FEATURES = N_CLASSES * N_CLASSES + 5


@dataclass(frozen=True)
class Training:
    """Bounds and settings of the fit: labelled documents drawn, passages they may have in all, width, rounds, step."""

    documents: int = 6000
    passages: int = 40_000
    hidden: int = 24
    attention: int = 12
    rounds: int = 150
    rate: float = 0.02
    seed: int = 7


def _class_table() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[128:] = N_CLASSES - 1
    for number, signs in enumerate(CLASSES):
        for sign in signs:
            table[ord(sign)] = number
    return table


CLASS_OF = _class_table()


def passage_bounds(lengths: np.ndarray, size: int = PASSAGE_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(passages per text, length of each passage) of texts of ``lengths`` bytes; an empty text has one empty passage."""
    counts = np.maximum(1, -(-lengths // size))
    number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    of = np.repeat(np.arange(len(lengths)), counts)
    # equal parts: a passage ends where its share of the text does
    ends = lengths[of] * (number + 1) // counts[of]
    begins = lengths[of] * number // counts[of]
    return counts, ends - begins


def encode(data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Features of neighbouring passages that fill ``data`` (bytes)."""
    n = len(lengths)
    of = np.repeat(np.arange(n, dtype=np.int64), lengths)
    kind = CLASS_OF[data].astype(np.int64)
    after = np.concatenate([kind[1:], [0]]) if len(kind) else kind
    after[np.cumsum(lengths)[lengths > 0] - 1] = 0  # what follows belongs to the next passage
    pairs = np.bincount((of * N_CLASSES + kind) * N_CLASSES + after, minlength=n * N_CLASSES * N_CLASSES).reshape(n, -1)
    out = np.empty((n, N_FEATURES), np.float32)
    size = np.maximum(1, lengths)[:, None]
    out[:, :-5] = np.sqrt(pairs / size)
    # words: the six bytes from each start of a word tell most words apart; nothing beyond the passage counts,
    # so that its features do not depend on what lies in the same chunk
    blank = data <= 32
    ends = np.cumsum(lengths)
    fresh = np.concatenate([[True], blank[:-1]]) if len(data) else np.zeros(0, bool)
    fresh[(ends - lengths)[lengths > 0]] = True
    start = np.flatnonzero(~blank & fresh)
    code = np.zeros(len(start), np.uint64)
    padded = np.concatenate([data, np.zeros(6, np.uint8)])
    stop = ends[of[start]]
    for at in range(6):
        code = code * np.uint64(257) + np.where(start + at < stop, padded[start + at], 0).astype(np.uint64)
    word_of = of[start]
    words = np.bincount(word_of, minlength=n)
    both = np.unique(word_of.astype(np.uint64) << np.uint64(40) ^ code * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(24))
    distinct = np.bincount((both >> np.uint64(40)).astype(np.int64), minlength=n)[:n]
    lines = np.bincount(of[data == 10], minlength=n)
    some = np.maximum(1, words)
    out[:, -5] = distinct / some
    out[:, -4] = np.log1p(words) / 6
    out[:, -3] = lengths / some / 16
    out[:, -2] = lines / some
    out[:, -1] = lengths / (lengths + SPARSE_BYTES)
    np.clip(out, 0, 4, out=out)
    return out


def _texts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts, one after the other, and the length of each."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
    held = column.buffers()[2]
    data = np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]] if held is not None else np.zeros(0, np.uint8)
    return data, np.diff(offsets)


def encoded_passages(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text of each passage, features) in runs of about CHUNK_BYTES, over a column of texts without nulls."""
    data, lengths = _texts(column)
    counts, sizes = passage_bounds(lengths)
    of = np.repeat(np.arange(len(lengths)), counts)
    ends = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes):
        at = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, at + CHUNK_BYTES, "right")))
        yield of[begin:end], encode(data[at : ends[end - 1]], sizes[begin:end])
        begin = end


class Attention:
    """Gated attention over a bag of passages; all weights in one dictionary of arrays."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.w = weights

    @classmethod
    def fresh(cls, how: Training) -> Attention:
        rng = np.random.default_rng(how.seed)
        draw = lambda *shape: rng.normal(0, shape[0] ** -0.5, shape)
        return cls({
            "mean": np.zeros(N_FEATURES), "scale": np.ones(N_FEATURES),
            "W": draw(N_FEATURES, how.hidden), "b": np.zeros(how.hidden), "V": draw(how.hidden, how.attention),
            "U": draw(how.hidden, how.attention), "a": draw(how.attention), "c": draw(how.hidden), "d": np.zeros(1),
        })

    def scaled(self, x: np.ndarray) -> np.ndarray:
        """Features in standard units, bounded so that no single one decides, and drawn to the mean for short passages."""
        return np.clip((x - self.w["mean"]) / self.w["scale"], -3, 3) * x[:, -1:]

    def passages(self, x: np.ndarray) -> tuple[np.ndarray, ...]:
        """(hidden, tanh gate, sigmoid gate, attention logit) of each passage."""
        w = self.w
        h = np.tanh(self.scaled(x) @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        return h, t, s, (t * s) @ w["a"]

    def sums(self, x: np.ndarray, of: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Per bag: sum of exp(logit), and of exp(logit) times the passage's share of the score. Logits are bounded by |a|."""
        h, _, _, logit = self.passages(x)
        e = np.exp(logit)
        return np.bincount(of, e, n), np.bincount(of, e * (h @ self.w["c"]), n)

    def score(self, total: np.ndarray, weighed: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(weighed / total + self.w["d"])))

    def gradients(self, x: np.ndarray, of: np.ndarray, label: np.ndarray, weight: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.w, len(label)
        x = self.scaled(x)
        h = np.tanh(x @ w["W"] + w["b"])
        t, s = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = np.exp((t * s) @ w["a"])
        share = e / np.bincount(of, e, n)[of]
        z = np.stack([np.bincount(of, share * h[:, k], n) for k in range(h.shape[1])], 1)
        p = 1 / (1 + np.exp(-(z @ w["c"] + w["d"])))
        dp = weight * (p - label)
        # logit of the document, then attention, gates, hidden layer
        value = h @ w["c"]
        dlogit = dp[of] * share * (value - (z @ w["c"])[of])
        dt, ds = dlogit[:, None] * w["a"] * s * (1 - t * t), dlogit[:, None] * w["a"] * t * s * (1 - s)
        dh = (dp[of] * share)[:, None] * w["c"] + dt @ w["V"].T + ds @ w["U"].T
        dh *= 1 - h * h
        return {
            "W": x.T @ dh, "b": dh.sum(0), "V": h.T @ dt, "U": h.T @ ds, "a": (t * s).T @ dlogit, "c": z.T @ dp, "d": np.array([dp.sum()]),
        }


def train(x: np.ndarray, of: np.ndarray, label: np.ndarray, how: Training = Training()) -> Attention:
    """Fit by full-batch Adam on the mean log-loss; labels of one kind only give a constant score of that kind."""
    model = Attention.fresh(how)
    if not len(label) or label.min() == label.max():
        model.w["c"][:] = 0
        model.w["d"][:] = 4.0 if not len(label) or label[0] == 1 else -4.0
        return model
    model.w["mean"], model.w["scale"] = x.mean(0), x.std(0) + 0.05
    weight = np.full(len(label), 1 / len(label))
    first, second = ({k: np.zeros_like(model.w[k]) for k in ("W", "b", "V", "U", "a", "c", "d")} for _ in range(2))
    for step in range(1, how.rounds + 1):
        for k, g in model.gradients(x, of, label, weight).items():
            g = g + 1e-4 * model.w[k]
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            model.w[k] = model.w[k] - how.rate * first[k] / (1 - 0.9**step) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    return model


def held_out(doc_id: Column) -> Column:
    """Whether an id belongs to the third kept from training; null ids are."""
    return F.coalesce(F.crc32(doc_id.cast("long").cast("string").cast("binary")) % 3 == 1, F.lit(True))


def fit(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> Attention:
    """Weights from a sample of ``how.documents`` labelled rows that aren't held out, half of each label where there are enough.

    Rows are drawn by a hash of their id; of those, texts are taken in that
    order until ``how.passages`` passages are reached. An id with several
    labels counts by their mean, 0.5 as 1; null labels and ids are left out.
    """
    eligible = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("q"))
        .filter("doc_id is not null and q is not null").filter(~held_out(F.col("doc_id")))
        .groupBy("doc_id").agg(F.when(F.avg("q") >= 0.5, 1).otherwise(0).alias("label"))
    )
    order = F.xxhash64("doc_id", F.lit(how.seed))
    half = how.documents // 2
    few = eligible.filter("label = 0").orderBy(order).limit(half)
    many = eligible.filter("label = 1").orderBy(order).limit(half)
    drawn = few.union(many)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole(F.col("text")).cast("binary").alias("text"))
    joined = texts.join(F.broadcast(drawn), "doc_id").withColumn("key", F.xxhash64("text"))
    sample = durable(joined.groupBy("doc_id", "label").agg(F.min_by("text", "key").alias("text")), "sample")
    passages = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / PASSAGE_BYTES))
    sized = sample.select("doc_id", passages.alias("n")).orderBy(order).collect()  # at most how.documents rows of two numbers
    used, taken = 0, []
    for row in sized:
        if used + row["n"] <= how.passages:
            used += row["n"]
            taken.append(row["doc_id"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chosen = pa.array(taken, pa.int64())
        for batch in batches:
            batch = batch.filter(pc.is_in(batch.column("doc_id"), chosen))
            for number in range(batch.num_rows):
                x = np.concatenate([f for _, f in encoded_passages(batch.column("text").slice(number, 1))])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(number, 1), batch.column("label").slice(number, 1), pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())],
                    names=["doc_id", "label", "n", "x"],
                )

    got = sample.select("doc_id", "text", "label").mapInArrow(run, "doc_id long, label int, n long, x binary").toPandas().sort_values("doc_id")
    x = np.frombuffer(b"".join(map(bytes, got["x"])), np.float32).reshape(-1, N_FEATURES)
    return train(x, np.repeat(np.arange(len(got)), got["n"].to_numpy(np.int64)), got["label"].to_numpy(np.float64), how)


def scores(docs: DataFrame, model: Attention) -> DataFrame:
    """(doc_id, text_key, score) of every row's whole text; null and empty texts are one empty passage."""
    weights = model.w

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(weights)
        for batch in batches:
            n = batch.num_rows
            total, weighed = np.zeros(n), np.zeros(n)
            for of, x in encoded_passages(batch.column("text")):
                first = int(of[0])
                t, w = model.sums(x, of - first, int(of[-1]) - first + 1)
                total[first : first + len(t)] += t
                weighed[first : first + len(w)] += w
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("text_key"), pa.array(model.score(total, weighed))], names=["doc_id", "text_key", "score"]
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), whole(F.col("text")).cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, text_key long, score double")


def quality(docs: DataFrame, labels: DataFrame, how: Training = Training()) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row; without usable labels every text scores high.

    Repeated rows get a row each; extra columns are not carried.
    """
    found = scores(docs, fit(docs, labels, how))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def drop_low_quality(docs: DataFrame, labels: DataFrame, how: Training = Training(), least: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score below ``least``; all columns stay, in one pass and without a shuffle."""
    weights = fit(docs, labels, how).w
    names, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Attention(weights)
        for batch in batches:
            column = batch.column(names.index("text"))
            filled = pc.fill_null(column.cast(pa.binary()), b"")
            total, weighed = np.zeros(batch.num_rows), np.zeros(batch.num_rows)
            for of, x in encoded_passages(filled):
                first = int(of[0])
                t, w = model.sums(x, of - first, int(of[-1]) - first + 1)
                total[first : first + len(t)] += t
                weighed[first : first + len(w)] += w
            yield batch.filter(pa.array(model.score(total, weighed) >= least))

    return docs.mapInArrow(run, schema)
