"""Quality classifier: a byte-level convolutional network over overlapping chunks of the whole text."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relpoint.llm.common import arrow_map, fresh, read, remainder, small_batches, texts

#: Bytes of a chunk and from one chunk to the next.
CHUNK, STEP = 512, 448
#: Bytes that a filter sees, bytes from one place to the next, numbers for a byte, filters.
WIDTH, HOP, DEPTH, FILTERS = 8, 2, 6, 24
#: Labelled rows that the network learns from at most, in order of a hash of their id, and the bytes of
#: their texts: the row that reaches SAMPLE_BYTES is the last. Every chunk of a chosen text is learned.
SAMPLE_ROWS, SAMPLE_BYTES = 4000, 16_000_000
#: Chunks that the fit reads at most, over all of its steps (at least MIN_STEPS are made).
EFFORT, MIN_STEPS = 400_000, 20
STEPS, BATCH, RATE = 600, 32, 0.01
#: Scores of at least this much are accepted.
ACCEPT = 0.3
HELD_OUT = 5

_PLACES = CHUNK // HOP
_SPAN = CHUNK + WIDTH


def chunk_count(text: bytes) -> int:
    return max(1, -(-(len(text) - CHUNK + STEP) // STEP))


def chunks(text: bytes, n: int | None = None) -> np.ndarray:
    """The first n (or all) chunks of the text as rows of bytes, filled up with zeros; an empty text has one."""
    n = n or chunk_count(text)
    flat = np.zeros(STEP * (n - 1) + _SPAN, dtype=np.uint8)
    part = text[: len(flat)]
    flat[: len(part)] = np.frombuffer(part, dtype=np.uint8)
    return np.lib.stride_tricks.as_strided(flat, (n, _SPAN), (STEP, 1))


@dataclass
class Network:
    """Byte vectors, filters with their offsets, and the weights of mean and maximum over chunks."""

    embed: np.ndarray
    filters: np.ndarray
    offset: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    @classmethod
    def new(cls, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        size = WIDTH * DEPTH
        arrays = (
            draw.normal(0, 1, (256, DEPTH)),
            draw.normal(0, size**-0.5, (size, FILTERS)),
            np.zeros(FILTERS),
            draw.normal(0, 0.1, 2 * FILTERS),
            np.zeros(1),
        )
        return cls(*(a.astype(np.float32) for a in arrays))

    def parameters(self) -> list[np.ndarray]:
        return [self.embed, self.filters, self.offset, self.weights, self.bias]

    def windows(self, block: np.ndarray) -> np.ndarray:
        """Inputs of the filters at each place of each chunk."""
        flat = np.take(self.embed, block, axis=0).reshape(len(block), -1)
        row, item = flat.strides
        shape = (len(block), _PLACES, WIDTH * DEPTH)
        return np.lib.stride_tricks.as_strided(flat, shape, (row, HOP * DEPTH * item, item)).reshape(-1, WIDTH * DEPTH)

    def pooled(self, block: np.ndarray, step: int = 64) -> np.ndarray:
        """Each filter's largest answer in each chunk, before its offset."""
        found = [
            (self.windows(block[i : i + step]) @ self.filters).reshape(-1, _PLACES, FILTERS).max(axis=1)
            for i in range(0, len(block), step)
        ]
        return np.concatenate(found)

    def scores(self, documents: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text, from all of its chunks."""
        mean = np.zeros((len(documents), FILTERS), dtype=np.float64)
        top = np.zeros((len(documents), FILTERS), dtype=np.float64)
        for at, block, owners in self._blocks(documents):
            active = np.maximum(self.pooled(block) + self.offset, 0)
            starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
            rows = owners[starts]
            mean[rows] += np.add.reduceat(active, starts, axis=0, dtype=np.float64)
            top[rows] = np.maximum(top[rows], np.maximum.reduceat(active, starts, axis=0))
        count = np.array([chunk_count(d) for d in documents])[:, None]
        logit = np.hstack([mean / count, top]) @ self.weights.astype(np.float64) + float(self.bias[0])
        return 1 / (1 + np.exp(-np.clip(logit, -40, 40)))

    @staticmethod
    def _blocks(documents: list[bytes], size: int = 1024) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """Chunks of the texts in order, in blocks of bounded size, with the text each belongs to."""
        held, owners, n = [], [], 0
        for row, text in enumerate(documents):
            # A long text comes in pieces that start where a chunk does.
            total = chunk_count(text)
            for at in range(0, total, size):
                own = chunks(text[STEP * at : STEP * (at + size - 1) + _SPAN], min(size, total - at))
                held.append(own)
                owners.append(np.full(len(own), row))
                n += len(own)
                if n >= size:
                    yield row, np.concatenate(held), np.concatenate(owners)
                    held, owners, n = [], [], 0
        if held:
            yield len(documents), np.concatenate(held), np.concatenate(owners)

    def peaks(self, block: np.ndarray, step: int = 64) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's largest answer in each chunk, and its place; inputs are held for a few chunks."""
        top, where = [], []
        for i in range(0, len(block), step):
            answers = (self.windows(block[i : i + step]) @ self.filters).reshape(-1, _PLACES, FILTERS)
            where.append(answers.argmax(axis=1))
            top.append(np.take_along_axis(answers, where[-1][:, None, :], 1)[:, 0])
        return np.concatenate(top), np.concatenate(where)

    def gradient(self, block: np.ndarray, owners: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        """Gradient of the mean log loss of a few documents, in the order of the parameters."""
        best, where = self.peaks(block)
        active = np.maximum(best + self.offset, 0)
        starts = np.flatnonzero(np.r_[True, owners[1:] != owners[:-1]])
        sizes = np.diff(np.r_[starts, len(owners)])
        mean = np.add.reduceat(active, starts, axis=0) / sizes[:, None]
        top = np.maximum.reduceat(active, starts, axis=0)
        doc = np.hstack([mean, top])
        p = 1 / (1 + np.exp(-np.clip(doc @ self.weights + self.bias[0], -40, 40)))
        error = ((p - labels) / len(labels)).astype(np.float32)
        back = np.outer(error, self.weights)
        position = np.repeat(np.arange(len(labels)), sizes)
        # Chunks that share the maximum share its gradient.
        at_top = (active == top[position]).astype(np.float32)
        at_top /= np.add.reduceat(at_top, starts, axis=0)[position]
        chunk = (back[:, :FILTERS] / sizes[:, None])[position] + back[position, FILTERS:] * at_top
        chunk = np.where(active > 0, chunk, 0).astype(np.float32)
        filters, embed = np.zeros_like(self.filters), np.zeros_like(self.embed)
        for i in range(0, len(block), 1024):
            own = slice(i, i + 1024)
            first = where[own] * HOP
            symbols = np.take_along_axis(block[own], (first[:, :, None] + np.arange(WIDTH)).reshape(len(first), -1), 1)
            seen = np.take(self.embed, symbols, axis=0).reshape(len(first), FILTERS, -1)
            filters += np.einsum("cf,cfk->kf", chunk[own], seen)
            to_input = (chunk[own, :, None] * self.filters.T[None]).reshape(-1, DEPTH)
            np.add.at(embed, symbols.ravel(), to_input)
        return [embed, filters, chunk.sum(axis=0), doc.T @ error, error.sum(keepdims=True)]

    def fit(self, documents: list[np.ndarray], labels: np.ndarray, steps: int = STEPS, seed: int = 11) -> Network:
        """Adam on batches drawn from the documents (each given as its chunks); fewer steps where they are long."""
        draw = np.random.default_rng(seed)
        mean = sum(len(d) for d in documents) / len(documents)
        steps = min(steps, max(MIN_STEPS, int(EFFORT / (BATCH * mean))))
        first = [np.zeros_like(p) for p in self.parameters()]
        second = [np.zeros_like(p) for p in self.parameters()]
        for step in range(1, steps + 1):
            rows = draw.integers(0, len(documents), BATCH)
            block = np.concatenate([documents[i] for i in rows])
            owners = np.repeat(np.arange(BATCH), [len(documents[i]) for i in rows])
            rate = RATE * min(1.0, 2 * (1 - step / (steps + 1)))
            for p, g, m, v in zip(self.parameters(), self.gradient(block, owners, labels[rows]), first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        return self


def sample(
    docs: DataFrame,
    labels: DataFrame,
    rows: int = SAMPLE_ROWS,
    held_out: int = HELD_OUT,
    size: int = SAMPLE_BYTES,
):
    """Chunks and labels of labelled documents outside the held-out share, bounded by rows and bytes.

    Ids are chosen in the narrow table of labels, by a hash, and sent to the texts. Of what they meet, the
    first ``rows`` rows by that hash are taken whole until their texts reach ``size`` bytes. Rows equal in
    id and text count once; null ids and ids without a label or a row are never chosen.
    """
    ids = labels.where("quality is not null and doc_id is not null").where(remainder("doc_id", held_out) != 0)
    ids = ids.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    key = F.xxhash64(F.coalesce("text", F.lit("")))
    known = docs.select("doc_id", "text", key.alias("h")).join(F.broadcast(ids), "doc_id")
    lengths = known.groupBy("doc_id", "h").agg(F.max(F.octet_length("text")).alias("n"))
    first = lengths.orderBy(F.xxhash64("doc_id"), "doc_id", "h").limit(rows).collect()
    before = np.cumsum([0] + [r["n"] or 0 for r in first])
    chosen = [(r["doc_id"], r["h"]) for r, n in zip(first, before) if n < size]
    spark = docs.sparkSession
    picked = spark.createDataFrame(chosen, lengths.select("doc_id", "h").schema)
    texts_ = known.join(F.broadcast(picked), ["doc_id", "h"]).select("doc_id", "h", "quality", "text")

    small_batches(spark)
    got = texts_.groupBy("doc_id", "h").agg(F.first("quality").alias("quality"), F.first("text").alias("text"))
    got = got.select("quality", "text").toArrow()
    blocks = [chunks(text) for text in texts(got["text"])]
    order = sorted(range(len(blocks)), key=lambda i: blocks[i].tobytes())
    quality = got["quality"].to_numpy()
    return [blocks[i] for i in order], np.array([quality[i] > 0 for i in order], dtype=np.float32)


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, steps: int = STEPS) -> Network:
    """Network for ``labels.quality``; without labelled rows it answers 0.5 and more for any text."""
    documents, quality = sample(docs, labels, rows)
    network = Network.new()
    if not documents:
        network.weights[:] = 0
        return network
    return network.fit(documents, quality, steps)


def with_score(docs: DataFrame, network: Network, name: str) -> DataFrame:
    """``docs`` and the score of each whole text (null is empty; empty texts are scored too)."""
    small_batches(docs.sparkSession)
    place = docs.columns.index("text")
    shared = docs.sparkSession.sparkContext.broadcast(network)

    def each(batch: pa.RecordBatch) -> list[pa.Array]:
        return [pa.array(shared.value.scores(texts(batch.column(place))))]

    return arrow_map(docs, each, f"`{name}` double", docs.columns)


def keep_good(docs: DataFrame, labels: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` that score ``accept`` or more, columns unchanged. Labels of other documents are ignored.

    Null and empty texts are scored as one empty chunk; repeated rows get one score and stay or go together.
    """
    [score] = fresh(docs, "score")
    scored = with_score(docs, train(docs, labels), score)
    return scored.where(F.col(score) >= accept).drop(score)


def op9_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Score of every document, learned outside the held-out fifth; null and empty texts are scored too."""
    docs = read(spark, folder, "documents").select("doc_id", "text")
    network = train(docs, read(spark, folder, "labels"))
    # The text is needed no further than the score.
    scored = with_score(docs, network, "score")
    return scored.select(
        "doc_id",
        (remainder("doc_id", HELD_OUT) == 0).alias("held_out"),
        "score",
        (F.col("score") >= ACCEPT).cast("int").alias("predicted"),
    )


QUERIES = {"op9_quality": op9_quality}
#: A network isn't in SQL; tests measure held-out accuracy.
SQL: dict[str, str] = {}
