"""Language identification (operator 3).

Character n-grams (one to three characters, letters lower-cased, everything else
a gap) are hashed, weighted by TF-IDF with document frequencies over all training
documents, and put to unit length. A sparse multinomial logistic regression is
trained on a bounded sample by follow-the-regularised-leader with elastic-net
penalties; its temperature is then fitted on sampled rows kept apart.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from factloom.llm import arrow, bpe
from factloom.llm import text_kernels as tk
from factloom.llm.quality import held_out

BUCKETS = 1 << 14
#: Documented bound of the fit: about so many documents of each language.
SAMPLE_PER_LANGUAGE = 1000
#: Documented bound of the fit: about so many documents of all languages together, an equal share for each.
SAMPLE_ROWS = 16_000
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """The lower-cased code point of every letter (the same where that is not one
    character), 32 for all other code points."""
    out = np.full(0x110000, 32, np.uint32)
    for point in np.flatnonzero(bpe._classes() == bpe._LETTER).tolist():
        low = chr(point).lower()
        out[point] = ord(low) if len(low) == 1 else point
    return out


def term_counts(chunk: tk.TextChunk) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed n-grams (texts x BUCKETS), and which texts have a letter."""
    n = len(chunk)
    if not len(chunk.data):
        return np.zeros((n, BUCKETS), np.float32), np.zeros(n, bool)
    point = np.frombuffer(chunk.data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    place = np.flatnonzero((chunk.data & 0xC0) != 0x80)
    first = np.searchsorted(place, chunk.offsets)
    own = np.repeat(np.arange(n), np.diff(first))
    point = _letters()[point]
    lettered = np.bincount(own, point != 32, n) > 0
    kept = np.ones(len(point), bool)
    kept[1:] = (point[1:] != 32) | (point[:-1] != 32) | (own[1:] != own[:-1])
    point, own = point[kept].astype(np.uint64), own[kept]
    base = own * BUCKETS
    counts = np.zeros(n * BUCKETS, np.int64)
    code = point + np.uint64(1)
    for size in (1, 2, 3):
        if size > 1:
            if len(point) < size:
                break
            code = code[:-1] * np.uint64(0x110001) + point[size - 1 :]
        inside = own[: len(code)] == own[size - 1 :]
        bucket = (code * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(50)
        counts += np.bincount((base[: len(code)] + bucket.astype(np.int64))[inside], minlength=len(counts))
    return counts.reshape(n, BUCKETS).astype(np.float32), lettered


def tf_idf(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Sub-linear term frequency times inverse document frequency, rows of unit length."""
    x = np.log1p(counts) * idf
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-12)


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weight: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, counts: np.ndarray) -> np.ndarray:
        logits = (tf_idf(counts, self.idf) @ self.weight + self.bias) / self.temperature
        logits -= logits.max(1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(1, keepdims=True)


def follow_the_regularised_leader(rows: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, classes: int, alpha: float = 2.0, beta: float = 1.0, lasso: float = 0.02, ridge: float = 0.02, epochs: int = 4, seed: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights (BUCKETS x classes) and biases. ``lasso`` and ``ridge`` are the two parts
    of the elastic net; a weight whose gradient sum stays within ``lasso`` is zero."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))
    random = np.random.default_rng(seed)

    def solve(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= lasso, 0.0, -(z - np.sign(z) * lasso) / ((beta + np.sqrt(n)) / alpha + ridge))

    for _ in range(epochs):
        for i in random.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            own_z, own_n = z[at], n[at]
            w = solve(own_z, own_n)
            logits = x @ w
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[labels[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(own_n + g * g) - np.sqrt(own_n)) / alpha
            z[at] = own_z + g - step * w
            n[at] = own_n + g * g
    w = solve(z, n)
    return w[:-1], w[-1]


def _temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden section on its log."""

    def loss(t: float) -> float:
        x = logits / np.exp(t)
        x = x - x.max(1, keepdims=True)
        return float((np.log(np.exp(x).sum(1)) - x[np.arange(len(x)), labels]).mean())

    lo, hi, g = np.log(0.02), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - g * (hi - lo), lo + g * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(docs: DataFrame, key: str, text: str) -> tuple[np.ndarray, int]:
    """Over all rows of ``docs``: in how many texts each bucket occurs, and the number of
    texts. Each task sums its own texts first; the sums have BUCKETS rows at most."""
    spark = docs.sparkSession
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(arrow.BATCH_ROWS))

    def run(batches):
        total, texts = np.zeros(BUCKETS, np.int64), 0
        for batch in batches:
            for chunk in tk.text_chunks(batch.column(0)):
                counts, lettered = term_counts(chunk)
                total += (counts > 0).sum(0)
                texts += int(lettered.sum())
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1), pa.int32()), pa.array(np.append(total[at], texts), pa.int64())], names=["bucket", "n"])

    sums = arrow.mapped(docs.select(F.col(text).cast("string")), run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out, texts = np.zeros(BUCKETS, np.int64), 0
    for bucket, n in sums.toPandas().itertuples(index=False):  # bounded by BUCKETS rows
        if bucket < 0:
            texts = int(n)
        else:
            out[int(bucket)] = n
    return out, texts


def train(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = SAMPLE_PER_LANGUAGE) -> Model:
    """Fits on about ``per_language`` documents of each language, and on about SAMPLE_ROWS of all together, chosen
    by a hash of the key; where there are many languages, fewer of each are learned from, but each
    is learned. Document frequencies are of all training documents. The weights are BUCKETS numbers a language.
    Held-out rows and rows whose language, key or text is null are not used. A sampled text
    has BUCKETS counts at most, however long it is."""
    usable = docs.select(key, text, lang).where(F.col(lang).isNotNull() & F.col(key).isNotNull() & F.col(text).isNotNull() & ~held_out(key))
    counts = {r[lang]: r["n"] for r in usable.groupBy(lang).agg(F.count("*").alias("n")).collect()}  # a row a language
    languages = sorted(counts)
    per_language = min(per_language, max(1, SAMPLE_ROWS // max(1, len(languages))))
    frequency, texts = document_frequencies(usable, key, text)
    idf = np.where(frequency > 0, np.log((1 + texts) / (1 + frequency)) + 1, 0.0)
    if not languages:
        return Model([UNKNOWN], idf, np.zeros((BUCKETS, 1)), np.zeros(1), 1.0)
    grain = 1 << 40
    limit = F.create_map(*[F.lit(x) for name in languages for x in (name, int(grain * min(1, per_language / counts[name])))])
    sample = usable.where(F.pmod(F.xxhash64(key, F.lit(17)), F.lit(grain)) < F.try_element_at(limit, F.col(lang)))

    def run(chunk, keys):
        counted, lettered = term_counts(chunk)
        rows = [np.flatnonzero(c) if k else np.zeros(0, np.int64) for c, k in zip(counted, lettered, strict=True)]
        offsets = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=offsets[1:])
        at = np.concatenate(rows).astype(np.int32)
        value = np.concatenate([c[r] for c, r in zip(counted, rows, strict=True)])
        yield [keys.field("_key"), keys.field("_lang"), arrow.list_array(at, offsets, pa.int32()), arrow.list_array(value, offsets, pa.float32())]

    keyed = sample.select(F.struct(F.col(key).cast("string").alias("_key"), F.col(lang).alias("_lang")).alias("_keys"), text)
    found = arrow.map_columns(keyed, "_keys", text, "_key string, _lang string, at array<int>, n array<float>", run).toArrow().to_pydict()
    rows, labels = [], []
    for i in sorted(range(len(found["_key"])), key=lambda i: found["_key"][i]):
        at, n = np.array(found["at"][i], np.int64), np.array(found["n"][i])
        if len(at):
            x = np.log1p(n) * idf[at]
            rows.append((at, x / max(np.sqrt((x * x).sum()), 1e-12)))
            labels.append(languages.index(found["_lang"][i]))
    labels = np.array(labels, np.int64)
    apart = np.random.default_rng(9).random(len(rows)) < 0.2
    weight, bias = follow_the_regularised_leader([r for r, a in zip(rows, apart, strict=True) if not a], labels[~apart], len(languages))
    temperature = 1.0
    if apart.any():
        logits = np.array([x @ weight[at] + bias for (at, x), a in zip(rows, apart, strict=True) if a])
        temperature = _temperature(logits, labels[apart])
    return Model(languages, idf, weight, bias, temperature)


def predict(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``lang_pred`` and ``score`` (its calibrated probability) of every whole text. A
    text that is null or has no letter is ``und`` with score 0; repeated rows get equal results
    and other columns are not read. A task holds the counts of 512 texts, or one long text's code points."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(chunk, keys):
        own = shared.value
        counts, lettered = term_counts(chunk)
        p = own.probabilities(counts)
        best = p.argmax(1)
        yield [keys, [own.languages[b] if k else UNKNOWN for b, k in zip(best.tolist(), lettered.tolist(), strict=True)], np.where(lettered, p[np.arange(len(p)), best], 0.0)]

    return arrow.map_texts(docs, key, text, "lang_pred string, score double", run)


def identify(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """Trains, then predicts the language of every document."""
    return predict(docs, train(docs, key, text, lang), key, text).select(key, held_out(key).alias("held_out"), "lang_pred", "score")
