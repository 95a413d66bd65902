"""Quality classifier: a byte-level convolutional network in numpy.

Every text is cut into overlapping chunks of bytes that together cover the whole
document. Learned filters of ``WIDTH`` bytes slide over each chunk and are
max-pooled; echo channels (does the 8-byte window repeat at a lag of 2..16 bytes?)
are mean-pooled beside them. A linear head turns the pooled features of a chunk
into a logit, and the logits of all chunks are averaged into one probability.

Training reads the whole texts of at most ``sample`` labelled documents and at most
``sample_bytes`` bytes of them, in the order of a hash of the id (one that does not fit
is passed over), so the driver holds a bounded number of bytes whatever the corpus. All
chunks of a document weigh as much as those of another. Scoring reads every byte.

Null and empty texts have one chunk of padding and get a defined score; repeated
rows score alike; of several labelled texts of one id the smallest one is learned from;
other columns are carried through or ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keytable.llm.storage import materialize, small_batches, text_column
from keytable.llm.words import encode

WIDTH, CELL, CELLS, HOP = 4, 128, 8, 7  # chunks of 8 cells, one cell shared with the next
LAGS = range(2, 17)
ECHO_SCALE = 5.0  # shares lie in 0..1; the filters' maxima are larger
N_FILTERS = 8
GAP = 32  # more than a filter or an echo looks ahead
THRESHOLD = 0.3  # a document scoring less is rejected


@dataclass
class Model:
    filters: np.ndarray  # (WIDTH, 256, N_FILTERS)
    head: np.ndarray  # N_FILTERS + 1 weights: pooled filters, echo
    bias: float

    def tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The filters summed over byte pairs: two gathers instead of four."""
        w = self.filters
        pair = lambda i: (w[i][None, :, :] + w[i + 1][:, None, :]).reshape(65536, -1)
        return pair(0), pair(2)


def layout(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in one byte array, each in cells of its own and followed by an empty one,
    so that no window reaches into the next text; how many cells hold each text; and
    which cells these are."""
    cells = np.array([max(1, -(-len(t) // CELL)) for t in texts], np.int64)
    start = np.cumsum(cells + 1) - cells - 1
    data = np.zeros(int((cells + 1).sum()) * CELL + GAP, np.uint8)
    for t, at in zip(texts, (start * CELL).tolist(), strict=True):
        data[at : at + len(t)] = np.frombuffer(t, np.uint8)
    own = np.repeat(start - (np.cumsum(cells) - cells), cells) + np.arange(int(cells.sum()))
    return data, cells, own


def cell_features(model: Model, data: np.ndarray, block: int = 2048) -> np.ndarray:
    """Max-pooled filters and mean echo of every cell, in blocks of bounded size."""
    t0, t1 = model.tables()
    n = (len(data) - GAP) // CELL
    out = np.empty((n, N_FILTERS + 1), np.float32)
    for a in range(0, n, block):
        b = min(n, a + block)
        part = data[a * CELL : b * CELL + 4]
        pairs = part[:-1].astype(np.int32) | (part[1:].astype(np.int32) << 8)
        size = (b - a) * CELL
        conv = t0.take(pairs[:size], axis=0)
        conv += t1.take(pairs[2 : size + 2], axis=0)
        out[a:b, :-1] = conv.reshape(b - a, CELL, N_FILTERS).max(axis=1)
        out[a:b, -1] = echo(data[a * CELL : b * CELL + GAP], b - a)
    return out


def echo(data: np.ndarray, n: int) -> np.ndarray:
    """Share of the probed positions (every fourth) of each cell whose next 8 bytes
    stand again 2 to 16 bytes later."""
    size = n * CELL
    windows = np.ndarray((len(data) - 7,), "<u8", np.ascontiguousarray(data), strides=(1,))  # one at every byte
    probe = windows[:size:4].copy()
    seen = np.zeros(len(probe), bool)
    for lag in LAGS:
        seen |= probe == windows[lag : size + lag : 4]
    seen &= probe != 0
    return ECHO_SCALE * seen.reshape(n, -1).mean(axis=1)


def chunk_features(cell: np.ndarray, cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of the overlapping chunks of every text, and the chunks of each."""
    first = np.concatenate(([0], np.cumsum(cells)[:-1]))
    count = np.maximum(1, -(-(cells - (CELLS - HOP)) // HOP))
    text = np.repeat(np.arange(len(cells)), count)
    k = np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count)
    start = first[text] + k * HOP
    end = np.minimum(start + CELLS, first[text] + cells[text])
    padded = np.concatenate((cell, cell[-1:]))
    at = np.column_stack((start, end)).ravel()
    out = np.empty((len(text), cell.shape[1]), np.float32)
    out[:, :-1] = np.maximum.reduceat(padded[:, :-1], at, axis=0)[::2]
    out[:, -1] = np.add.reduceat(padded[:, -1], at)[::2] / (end - start)
    return out, count


def head_logits(model: Model, chunks: np.ndarray) -> np.ndarray:
    pooled = chunks.copy()
    np.maximum(pooled[:, :-1], 0, out=pooled[:, :-1])
    return pooled @ model.head + model.bias


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    if not texts:
        return np.zeros(0)
    data, cells, own = layout(texts)
    chunks, count = chunk_features(cell_features(model, data)[own], cells)
    logit = np.add.reduceat(head_logits(model, chunks).astype(np.float64), np.cumsum(count) - count) / count
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(texts: list[bytes], labels: list[int], *, epochs: int = 24, batch: int = 128, rate: float = 0.02, seed: int = 7) -> Model:
    """Adam on the log loss of chunks, documents and classes weighted evenly. Deterministic."""
    rng = np.random.default_rng(seed)
    size = CELL * CELLS
    chunks = [max(1, -(-len(t) // size)) for t in texts]
    ys = [y for y, n in zip(labels, chunks, strict=True) for _ in range(n)]
    parts = [1 / n for n in chunks for _ in range(n)]
    model = Model(rng.normal(0, 0.1, (WIDTH, 256, N_FILTERS)).astype(np.float32), rng.normal(0, 0.3, N_FILTERS + 1).astype(np.float32), 0.0)
    if len(set(ys)) < 2:  # nothing to learn from: one constant score
        model.head[:] = 0
        model.bias = 0.0 if not ys else (4.0 if ys[0] else -4.0)
        return model
    x = np.zeros((len(ys), size), np.uint8)
    at = 0
    for t, n in zip(texts, chunks, strict=True):
        x[at : at + n].reshape(-1)[: len(t)] = np.frombuffer(t, np.uint8)
        at += n
    y = np.array(ys, np.float32)
    share = np.array(parts, np.float32)
    for c in (0, 1):  # both classes weigh half of all chunks
        share[y == c] *= 0.5 * len(y) / share[y == c].sum()
    echoes = np.array([echo(np.concatenate((r, np.zeros(GAP, np.uint8))), CELLS).sum() / max(1, -(-np.count_nonzero(r) // CELL)) for r in x], np.float32)
    params = [model.filters, model.head, np.zeros(1, np.float32)]
    m1, m2 = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        lr = rate * (1 - epoch / epochs) + 1e-3
        for a in range(0, len(order), batch):
            ids = order[a : a + batch]
            part = x[ids]
            t0, t1 = model.tables()
            padded = np.concatenate((part, np.zeros((len(part), 4), np.uint8)), axis=1)
            pairs = padded[:, :-1].astype(np.int32) | (padded[:, 1:].astype(np.int32) << 8)
            conv = t0.take(pairs[:, :size], axis=0)
            conv += t1.take(pairs[:, 2 : size + 2], axis=0)
            best = conv.argmax(axis=1)  # (batch, filters)
            pooled = np.take_along_axis(conv, best[:, None, :], 1)[:, 0, :]
            act = np.concatenate((np.maximum(pooled, 0), echoes[ids][:, None]), axis=1)
            p = 1 / (1 + np.exp(-np.clip(act @ model.head + params[2][0], -30, 30)))
            err = (p - y[ids]) * share[ids] / len(ids)
            back = err[:, None] * model.head[None, :-1] * (pooled > 0)
            grad = np.zeros_like(model.filters)
            for j in range(WIDTH):
                np.add.at(grad[j], (padded[np.arange(len(ids))[:, None], best + j], np.arange(N_FILTERS)[None, :]), back)
            grad[:, 0, :] = 0
            grads = [grad + 1e-5 * model.filters, act.T @ err + 1e-4 * model.head, np.array([err.sum()], np.float32)]
            step += 1
            for q, g, u, v in zip(params, grads, m1, m2, strict=True):
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                q -= lr * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
            model.filters[:, 0, :] = 0
    model.bias = float(params[2][0])
    return model


def train(docs: DataFrame, labels: DataFrame, *, sample: int = 4000, sample_bytes: int = 16 << 20, label: str = "quality") -> Model:
    """Fit on whole texts of labelled documents that are not held out, bounded as told
    above. Labels that are null are no labels; a document with contradicting labels
    counts as its smallest one."""
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0))
        .groupBy("doc_id").agg(F.min(label).cast("int").alias("__label"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    )
    # one text per id, so there are no more rows than in the sample
    texts = docs.select("doc_id", text_column(docs).alias("__text")).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "__label").agg(F.min("__text").alias("__text"))
    texts = materialize(texts, "sample")
    left, ids = sample_bytes, []
    sizes = sorted(texts.select(F.xxhash64("doc_id"), "doc_id", F.octet_length("__text")).collect())
    for _, doc_id, n in sizes:
        if n <= left:
            left -= n
            ids.append(doc_id)
    # where all fit the plan needs no list of them
    fitting = texts if len(ids) == len(sizes) else texts.where(F.col("doc_id").isin(ids))
    rows = sorted((r["doc_id"], encode(r["__text"]), r["__label"]) for r in fitting.collect()) if ids else []
    return fit([t for _, t, _ in rows], [y for _, _, y in rows])


def score(docs: DataFrame, model: Model, *, name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in column ``name``, in place of any
    column of that name."""
    docs = docs.drop(name)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [encode(t) for t in batch.column(at).to_pylist()]
            found = np.empty(len(texts))
            a = 0
            while a < len(texts):  # about 2 MB at a time
                b, total = a, 0
                while b < len(texts) and (b == a or total < 2 << 20):
                    total += len(texts[b])
                    b += 1
                found[a:b] = scores(shared.value, texts[a:b])
                a = b
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, schema)
