"""Quality classifier (operator 1): naive-Bayes support vectors.

A text becomes binary n-gram indicators: n-grams of lower-cased words, n-grams of
the text's shape (its characters by class, runs of letters and digits collapsed)
and n-grams of "this word repeats the one before". Indicators are scaled by the
log-count ratio of the two classes, vectors have unit length, and a linear
hinge-loss model is fitted to them by dual coordinate descent. Its weights are
interpolated with their mean magnitude, and margins become probabilities by a
logistic fit on rows that the model has not seen.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow
from factloom.llm import text_kernels as tk

_WORD_BITS = 18
_SHAPE3, _SHAPE5, _REPEAT = 16**3, 1 << 14, 16
#: Indicators below this number are kept as a dense matrix, one row per text.
DENSE = _SHAPE3 + _SHAPE5 + _REPEAT
FEATURES = DENSE + (1 << _WORD_BITS)

#: Documented bound of the fit: about so many labelled rows of each class.
SAMPLE_PER_CLASS = 4000
#: Documented bound of the fit: of a class whose texts are long, so many rows fewer that they have about so many bytes together.
SAMPLE_BYTES = 32 << 20


def _shape_classes() -> np.ndarray:
    out = np.full(256, 15, np.uint8)
    out[[0x20, *range(9, 14)]] = 0
    out[0x61:0x7B] = 1
    out[0x80:] = 1
    out[0x41:0x5B] = 2
    out[0x30:0x3A] = 3
    for kind, marks in enumerate((b".", b",;:", b"!", b"?", b"\"'`", b"()[]{}", b"-_~", b"|", b"#", b"*", b"&%$@"), start=4):
        out[list(marks)] = kind
    return out


_SHAPES = _shape_classes()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def indicators(chunk: tk.TextChunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The dense indicators (texts x DENSE), and the sparse ones as (text, feature) pairs."""
    n = len(chunk)
    dense = np.zeros((n, DENSE), bool)
    shape = _SHAPES[chunk.data]
    text_of = np.repeat(np.arange(n), np.diff(chunk.offsets))
    if len(shape):
        kept = np.ones(len(shape), bool)
        kept[1:] = (shape[1:] != shape[:-1]) | (shape[1:] > 3) | (text_of[1:] != text_of[:-1])
        shape, own = shape[kept].astype(np.int64), text_of[kept]
        if len(shape) >= 3:
            code = shape[:-2] + 16 * shape[1:-1] + 256 * shape[2:]
            inside = own[:-2] == own[2:]
            dense[own[:-2][inside], code[inside]] = True
        if len(shape) >= 5:
            code = shape[:-4] + 16 * (shape[1:-3] + 16 * (shape[2:-2] + 16 * (shape[3:-1] + 16 * shape[4:])))
            code = (tk.mix(code.astype(np.uint64)) >> np.uint64(50)).astype(np.int64)
            inside = own[:-4] == own[4:]
            dense[own[:-4][inside], _SHAPE3 + code[inside]] = True
    starts, ends, per_text = tk.words(chunk)
    if not len(starts):
        return dense, np.zeros(0, np.int64), np.zeros(0, np.int64)
    hashes = tk.segment_hashes(_LOWER[chunk.data], starts, ends)
    own = np.repeat(np.arange(n), np.diff(per_text))
    same = np.zeros(len(hashes), np.int64)
    same[1:] = (hashes[1:] == hashes[:-1]) & (own[1:] == own[:-1])
    code = same.copy()
    for k in (1, 2, 3):
        code[:-k] += np.where(own[k:] == own[:-k], same[k:], 0) << k
    dense[own, _SHAPE3 + _SHAPE5 + code] = True
    shift = np.uint64(64 - _WORD_BITS)
    one = own * FEATURES + DENSE + (hashes >> shift).astype(np.int64)
    pair = tk.ngram_hashes(hashes, 2)
    inside = own[1:] == own[:-1]
    two = own[1:][inside] * FEATURES + DENSE + (pair[inside] >> shift).astype(np.int64)
    keys = np.unique(np.concatenate([one, two]))
    return dense, keys // FEATURES, keys % FEATURES


@dataclass
class Model:
    """Ratio of each indicator, weight of each scaled indicator, and the calibration."""

    ratio: np.ndarray
    weight: np.ndarray
    bias: float
    slope: float
    shift: float

    def margins(self, chunk: tk.TextChunk) -> np.ndarray:
        dense, text, feature = indicators(chunk)
        n = len(chunk)
        product, square = self.ratio * self.weight, self.ratio * self.ratio
        total = dense @ product[:DENSE] + np.bincount(text, product[feature], n)
        norm = np.sqrt(dense @ square[:DENSE] + np.bincount(text, square[feature], n))
        return total / np.maximum(norm, 1e-12) + self.bias

    def scores(self, chunk: tk.TextChunk) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margins(chunk) + self.shift, -30, 30)))


def log_count_ratio(rows: list[np.ndarray], labels: np.ndarray, alpha: float = 1.0, least: int = 2) -> np.ndarray:
    """log of the smoothed share of each indicator in class 1 over that in class 0;
    0 for indicators that fewer than ``least`` texts have."""
    positive, negative = np.zeros(FEATURES), np.zeros(FEATURES)
    for row, label in zip(rows, labels, strict=True):
        (positive if label > 0 else negative)[row] += 1
    p, q = alpha + positive, alpha + negative
    ratio = np.log((p / max(1, (labels > 0).sum())) / (q / max(1, (labels <= 0).sum())))
    ratio[positive + negative < least] = 0
    return ratio


def dual_coordinate_descent(rows: list[np.ndarray], ratio: np.ndarray, labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """Weights and bias of the L2-regularised, L1-loss support vector machine on
    ratio-scaled indicators of unit length."""
    weight, bias = np.zeros(FEATURES), 0.0
    values = []
    for row in rows:
        x = ratio[row]
        values.append(x / max(np.sqrt((x * x).sum()), 1e-12))
    alpha, random = np.zeros(len(rows)), np.random.default_rng(seed)
    diagonal = np.array([(x * x).sum() + 1 for x in values])
    for _ in range(epochs):
        largest = 0.0
        for i in random.permutation(len(rows)):
            row, x, y = rows[i], values[i], labels[i]
            gradient = y * (weight[row] @ x + bias) - 1
            step = min(max(alpha[i] - gradient / diagonal[i], 0), cost) - alpha[i]
            if step:
                alpha[i] += step
                weight[row] += step * y * x
                bias += step * y
                largest = max(largest, abs(step))
        if largest < 1e-3:
            break
    return weight, bias


def _logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of Platt's scaling by Newton steps; targets are smoothed."""
    positive = max(1, (labels > 0).sum())
    negative = max(1, (labels <= 0).sum())
    target = np.where(labels > 0, (positive + 1) / (positive + 2), 1 / (negative + 2))
    slope, shift = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(slope * margins + shift, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((p - target) * margins).sum() + 1e-3 * slope, (p - target).sum()])
        h = np.array([[(w * margins * margins).sum() + 1e-3, (w * margins).sum()], [(w * margins).sum(), w.sum() + 1e-9]])
        step = np.linalg.solve(h, g)
        slope, shift = slope - step[0], shift - step[1]
        if np.abs(step).max() < 1e-8:
            break
    return float(slope), float(shift)


def fit(rows: list[np.ndarray], labels: np.ndarray, mix: float = 0.9) -> Model:
    """Fits on indicator rows and 0/1 labels. With one class, scores are near that class."""
    y = np.where(np.asarray(labels) > 0, 1.0, -1.0)
    if not len(y) or (y > 0).all() or (y < 0).all():
        return Model(np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 1.0, 0.0 if not len(y) else float(3 * y[0]))
    held = np.arange(len(rows)) % 4 == 3

    def weights(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        own = [rows[i] for i in np.flatnonzero(which)]
        ratio = log_count_ratio(own, y[which])
        weight, bias = dual_coordinate_descent(own, ratio, y[which])
        used = weight != 0
        mean = np.abs(weight[used]).mean() if used.any() else 0.0
        return ratio, np.where(used, (1 - mix) * mean + mix * weight, 0.0), bias

    def margins(which: np.ndarray, ratio: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
        return np.array([(ratio[r] * weight[r]).sum() / max(np.sqrt((ratio[r] ** 2).sum()), 1e-12) + bias for r in (rows[i] for i in np.flatnonzero(which))])

    slope, shift = 1.0, 0.0
    if len(set(y[held])) == 2 and len(set(y[~held])) == 2:
        slope, shift = _logistic(margins(held, *weights(~held)), y[held])
    return Model(*weights(np.ones(len(rows), bool)), slope, shift)


def held_out(key: str) -> Column:
    """True for rows that are never learned from; a null key is held out too."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", per_class: int = SAMPLE_PER_CLASS) -> Model:
    """Fits on about ``per_class`` labelled rows of each class at most, chosen by a hash of the key.

    Rows whose label or key is null, and held-out rows, are not used; a key with
    several labels has their rounded mean. A class with long texts is learned from fewer of them, SAMPLE_BYTES
    in the mean, each with all its indicators; so what reaches the driver is bounded, some 100 MB of
    indicators, whatever the texts. Only the sampled keys are broadcast, which ``per_class`` bounds.
    """
    marks = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull() & ~held_out(key)).groupBy(key).agg((F.avg(label) >= 0.5).cast("int").alias("_label"))
    sizes = docs.select(key, F.coalesce(F.octet_length(F.col(text).cast("string")), F.lit(0)).alias("_size")).join(marks, key)
    found = sizes.groupBy("_label").agg(F.count_distinct(key).alias("n"), F.sum("_size").alias("size")).collect()  # two rows
    part = {r["_label"]: min(1, per_class / r["n"], SAMPLE_BYTES / max(1, r["size"])) for r in found}
    grain = 1 << 40
    limit = F.when(F.col("_label") == 1, F.lit(int(grain * part.get(1, 1)))).otherwise(F.lit(int(grain * part.get(0, 1))))
    chosen = marks.where(F.pmod(F.xxhash64(key, F.lit(11)), F.lit(grain)) < limit)
    sample = docs.select(key, text).join(F.broadcast(chosen), key)

    def run(chunk, keys):
        dense, of, feature = indicators(chunk)
        bounds = np.searchsorted(of, np.arange(len(chunk) + 1))
        rows = [np.concatenate([np.flatnonzero(d), feature[a:b]]) for d, a, b in zip(dense, bounds[:-1], bounds[1:], strict=True)]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        yield [keys.field("_key"), keys.field("_label"), arrow.list_array(np.concatenate(rows), offsets, pa.int32())]

    keyed = sample.select(F.struct(F.col(key).cast("string").alias("_key"), "_label").alias("_keys"), text)
    found = arrow.map_columns(keyed, "_keys", text, "_key string, _label int, features array<int>", run).toArrow()
    order = np.argsort(np.array(found.column("_key").to_pylist(), dtype=object)) if found.num_rows else np.zeros(0, np.int64)
    features = found.column("features").combine_chunks() if found.num_rows else None
    rows = [features[int(i)].values.to_numpy(zero_copy_only=False) for i in order]
    marks = found.column("_label").to_numpy()[order] if found.num_rows else np.zeros(0)
    shuffle = np.random.default_rng(5).permutation(len(rows))
    return fit([rows[i] for i in shuffle], np.asarray(marks)[shuffle])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``score`` (0 to 1, higher: class 1 likelier) of every whole text; null counts as
    empty, repeated rows get equal scores, and other columns are not read. A task holds one
    chunk (512 KB of texts, or one longer text with about 100 bytes for each of its own)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(chunk, keys):
        yield [keys, shared.value.scores(chunk)]

    return arrow.map_texts(docs, key, text, "score double", run)


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """Trains, then scores and predicts every document."""
    scored = score(docs, train(docs, labels, key, text, label), key, text)
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def score_rows(df: DataFrame, model: Model, text: str = "text", out: str = "score") -> DataFrame:
    """Every row and column of ``df`` with the score as ``out`` (a column of that name is replaced)."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    others = [c for c in df.columns if c not in (text, out)]
    packed = df.select(F.struct(F.struct(*others).alias("row"), F.col(text).isNull().alias("null")).alias("_keys"), F.col(text).alias("_text"))

    def run(chunk, keys):
        nulls, row = keys.field("null").to_pylist(), keys.field("row")
        texts = pa.array([None if nulls[k] else chunk.text(k).decode() for k in range(len(chunk))], pa.string())
        yield [*(row.field(c) for c in others), texts, shared.value.scores(chunk)]

    fields = "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in others)
    return arrow.map_columns(packed, "_keys", "_text", f"{fields}`{text}` string, `{out}` double", run).select(*[c for c in df.columns if c != out], out)
