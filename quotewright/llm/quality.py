"""Quality of a document by a byte-level convolutional network, in numpy.

Bytes are embedded and run through learned filters. A chunk is two neighbouring blocks of bytes, so chunks
overlap by half and cover the whole document, however long. Each filter's response is max-pooled over the
chunk, a small layer turns the pooled responses into the chunk's evidence, and the strongest and the mean
evidence over all chunks make one probability.

The network learns from a bounded sample of labelled documents; only the bytes of a text are ever its input.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import keep_keys
from ..session import materialize
from .common import draw_sample, prepare

#: Bytes of a block; embedding size, width and number of the filters; size of the layer behind them.
BLOCK, EMBED, WIDTH, FILTERS, HIDDEN = 256, 6, 6, 16, 12
#: Labelled documents of each class to learn from, at most, and characters of the piece taken of a longer one.
SAMPLE_ROWS, SAMPLE_CHARS = 1200, 20_000
EPOCHS, BATCH, RATE = 14, 24, 0.01
#: Blocks that go through the filters at once.
AT_ONCE = 512


@dataclass
class Network:
    embed: np.ndarray
    filters: np.ndarray
    bias: np.ndarray
    layer: np.ndarray
    layer_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    combine: np.ndarray  # weights of strongest and mean evidence, and a constant

    @classmethod
    def start(cls, seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        near = lambda *shape: draw.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
        return cls(
            draw.normal(0, 0.5, (256, EMBED)).astype(np.float32), near(WIDTH * EMBED, FILTERS),
            np.zeros(FILTERS, np.float32), near(FILTERS, HIDDEN), np.full(HIDDEN, 0.1, np.float32),
            near(HIDDEN, 1)[:, 0], np.zeros(1, np.float32), np.array([0.7, 0.3, 0.0], np.float32))

    def _windows(self, flat: np.ndarray) -> np.ndarray:
        """The embedded bytes under the filters at every place but the last WIDTH - 1."""
        embedded = self.embed[flat].ravel()
        places = len(flat) - WIDTH + 1
        step = embedded.strides[0]
        return np.lib.stride_tricks.as_strided(
            embedded, (places, WIDTH * EMBED), (EMBED * step, step), writeable=False)

    def block_responses(self, flat: np.ndarray) -> np.ndarray:
        """Strongest response of each filter in each block; ``flat`` is whole blocks of bytes."""
        blocks = len(flat) // BLOCK
        padded = np.concatenate([flat, np.zeros(WIDTH - 1, np.uint8)])
        out = np.empty((blocks, FILTERS), np.float32)
        for at in range(0, blocks, AT_ONCE):
            end = min(blocks, at + AT_ONCE)
            windows = np.ascontiguousarray(self._windows(padded[at * BLOCK : end * BLOCK + WIDTH - 1]))
            out[at:end] = (windows @ self.filters).reshape(end - at, BLOCK, FILTERS).max(axis=1)
        return out + self.bias

    def evidence(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.maximum(pooled @ self.layer + self.layer_bias, 0)
        return hidden, hidden @ self.out + self.out_bias

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probability of good quality for each text."""
        flat, first = lay_out(texts)
        if not len(first):
            return np.zeros(0)
        low, high, owner, starts = chunks(first, len(flat) // BLOCK)
        responses = self.block_responses(flat)
        _, logits = self.evidence(np.maximum(responses[low], responses[high]))
        strongest = np.maximum.reduceat(logits, starts)
        mean = np.add.reduceat(logits, starts) / np.bincount(owner)
        total = self.combine[0] * strongest + self.combine[1] * mean + self.combine[2]
        # the last digits hang on which texts share a batch
        return np.round(1 / (1 + np.exp(np.clip(total.astype(np.float64), -40, 40))), 5)


def lay_out(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All texts' bytes, each padded to whole blocks, and the first block of each; an empty text has one block.

    The zeros in front of a text are as many as a filter at the end of the text before it can reach.
    """
    parts, first, at = [], [], 0
    for text in texts:
        raw = bytes(WIDTH - 1) + (text or "").encode()
        size = -(-len(raw) // BLOCK) * BLOCK
        parts.append(raw.ljust(size, b"\0"))
        first.append(at)
        at += size // BLOCK
    return np.frombuffer(b"".join(parts), np.uint8), np.array(first, np.int64)


def chunks(first: np.ndarray, blocks: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Chunks of all documents: their two blocks, their document, and where each document's chunks start.

    A document of one block is a chunk by itself.
    """
    count = np.diff(np.append(first, blocks))
    per_doc = np.maximum(count - 1, 1)
    starts = np.cumsum(per_doc) - per_doc
    owner = np.repeat(np.arange(len(first)), per_doc)
    low = first[owner] + np.arange(len(owner)) - starts[owner]
    return low, np.minimum(low + 1, (first + count - 1)[owner]), owner, starts


def _gradients(net: Network, texts: list[str], bad: np.ndarray) -> list[np.ndarray]:
    flat, first = lay_out(texts)
    blocks = len(flat) // BLOCK
    low, high, owner, starts = chunks(first, blocks)
    padded = np.concatenate([flat, np.zeros(WIDTH - 1, np.uint8)])
    windows = net._windows(padded)
    raw = (np.ascontiguousarray(windows) @ net.filters).reshape(blocks, BLOCK, FILTERS)
    where = raw.argmax(axis=1)
    responses = np.take_along_axis(raw, where[:, None, :], 1)[:, 0] + net.bias
    from_high = responses[high] > responses[low]
    pooled = np.where(from_high, responses[high], responses[low])
    hidden, logits = net.evidence(pooled)
    strongest = np.maximum.reduceat(logits, starts)
    size = np.bincount(owner).astype(np.float32)
    mean = np.add.reduceat(logits, starts) / size
    total = net.combine[0] * strongest + net.combine[1] * mean + net.combine[2]
    error = ((1 / (1 + np.exp(-total)) - bad) / len(bad)).astype(np.float32)

    to_combine = np.array([error @ strongest, error @ mean, error.sum()], np.float32)
    to_logits = (error * net.combine[1] / size)[owner] + np.where(
        logits == strongest[owner], (error * net.combine[0])[owner], 0)
    to_out, to_out_bias = hidden.T @ to_logits, to_logits.sum(keepdims=True)
    to_hidden = np.outer(to_logits, net.out) * (hidden > 0)
    to_layer, to_layer_bias = pooled.T @ to_hidden, to_hidden.sum(0)
    to_pooled = to_hidden @ net.layer.T
    to_responses = np.zeros_like(responses)
    np.add.at(to_responses, high, to_pooled * from_high)
    np.add.at(to_responses, low, to_pooled * ~from_high)
    # only the strongest place of a filter in a block passes anything on
    at = np.arange(blocks)[:, None] * BLOCK + where
    to_filters, to_embed = np.zeros_like(net.filters), np.zeros_like(net.embed)
    for f in range(FILTERS):
        to_filters[:, f] = to_responses[:, f] @ windows[at[:, f]]
        back = np.outer(to_responses[:, f], net.filters[:, f]).reshape(-1, EMBED)
        np.add.at(to_embed, padded[at[:, f, None] + np.arange(WIDTH)].ravel(), back)
    return [to_embed, to_filters, to_responses.sum(0), to_layer, to_layer_bias, to_out, to_out_bias, to_combine]


def train(texts: list[str], good: list[int], epochs: int = EPOCHS, seed: int = 7) -> Network | None:
    """A network from labelled texts (Adam); None unless both classes occur."""
    bad = 1 - np.array(good, np.float32)
    if not len(bad) or bad.min() == bad.max():
        return None
    net, draw = Network.start(seed), np.random.default_rng(seed)
    names = [field.name for field in fields(Network)]
    mean = [np.zeros_like(getattr(net, name)) for name in names]
    square = [np.zeros_like(m) for m in mean]
    by_class = [np.flatnonzero(bad == c) for c in (0, 1)]
    # as many steps whatever the size of the sample, with both classes alike in each
    steps = epochs * 2 * SAMPLE_ROWS // BATCH
    for step in range(1, steps + 1):
        picked = np.concatenate([draw.choice(rows, BATCH // 2) for rows in by_class])
        rate = RATE * min(1.0, 2.0 * (1 - step / (steps + 1)))
        for i, (name, g) in enumerate(zip(names, _gradients(net, [texts[p] for p in picked], bad[picked]))):
            mean[i] += 0.1 * (g - mean[i])
            square[i] += 0.001 * (g * g - square[i])
            change = mean[i] / (1 - 0.9**step) / (np.sqrt(square[i] / (1 - 0.999**step)) + 1e-8)
            setattr(net, name, (getattr(net, name) - rate * change).astype(np.float32))
    return net


def learn(
    docs: DataFrame, labels: DataFrame, fold_out: int = 0, folds: int = 5,
    id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality",
) -> Network | None:
    """Train on ``SAMPLE_ROWS`` documents of each class that are labelled and not in the held-out fold, or on all there
    are; None without both classes.

    The sample is picked by hashes (``draw_sample``) and the only data that reaches the driver. Of longer texts it
    holds a piece of ``SAMPLE_CHARS`` characters; an id with several texts or labels counts with each.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).where(
        F.col("label").isin(0, 1) & (fold_of(F.col("doc_id"), folds) != fold_out))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).where(F.col("text").isNotNull())
    # labels of documents that are there, by a hash of the id; ids alone are shuffled
    here = keep_keys(known, docs.select(F.col(id_col).alias("doc_id")), ["doc_id"]).distinct()
    nth = F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64("doc_id"), "doc_id"))
    drawn = here.withColumn("_nth", nth).where(F.col("_nth") <= 2 * SAMPLE_ROWS).drop("_nth")
    rows = materialize(texts.join(F.broadcast(materialize(drawn, "drawn-labels")), "doc_id"), "labelled-texts")  # 4 * SAMPLE_ROWS ids
    sample = draw_sample(rows, SAMPLE_ROWS, SAMPLE_CHARS)
    if len({r["label"] for r in sample}) < 2:
        return None
    return train([r["text"] for r in sample], [r["label"] for r in sample])


def fold_of(id_column, folds: int):
    return F.crc32(id_column.cast("string")) % folds


def score_quality(
    docs: DataFrame, network: Network | None, threshold: float = 0.3,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """``doc_id, score, predicted``: one row per input row, whole texts.

    A null text counts as empty. Without a network (nothing to learn from) every score is 0.5. Null ids and
    repeated rows pass through; other columns are ignored; an empty table gives an empty result.
    """
    spark = prepare(docs.sparkSession)
    sent = spark.sparkContext.broadcast(network)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(1).to_pylist()
            scores = np.full(len(texts), 0.5) if sent.value is None else sent.value.scores(texts)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["doc_id", "score"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    return rows.mapInArrow(run, f"doc_id {kind}, score double").withColumn(
        "predicted", (F.col("score") >= threshold).cast("int"))


def keep_good(docs: DataFrame, network: Network | None, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, with all their columns; scored as in ``score_quality``."""
    spark = prepare(docs.sparkSession)
    sent, place = spark.sparkContext.broadcast(network), docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if sent.value is not None:
                batch = batch.filter(pa.array(sent.value.scores(batch.column(place).to_pylist()) >= threshold))
            yield batch

    return docs.mapInArrow(run, docs.schema)
