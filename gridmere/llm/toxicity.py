"""
Toxicity by compression distance: which of two zstandard dictionaries fits a text better.

One dictionary is trained on ordinary text. The other holds the same and, besides, a part
trained on what toxic text says that ordinary text doesn't. A document is cut into windows
of a few words; each is compressed with both, and the bytes the second saves are its
distance. A logistic curve over the largest and mean savings, fitted on labelled documents and
weighted to their true share of toxic ones, turns them into a probability.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridmere.llm.common import per_batch, texts

WINDOW_WORDS = 6
REJECT_AT = 0.7
_ORDINARY_BYTES, _TOXIC_BYTES = 16_384, 8_192
_FEATURES = 6
_ANCHOR = 64


def held_out(doc_id: Column) -> Column:
    """The third of documents whose labels are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _windows(words: list[bytes]) -> list[bytes]:
    return [
        b" " + b" ".join(words[i : i + WINDOW_WORDS]) + b" " for i in range(0, len(words), WINDOW_WORDS)
    ]


def _words(text: str) -> list[bytes]:
    return text.lower().encode().split()


def _compressor(content: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters.from_level(
        13, format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )
    book = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    book.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=book, compression_params=settings)


@dataclass
class ToxicityModel:
    """The dictionaries and the curve; without both classes in training, every score is 0."""

    ordinary: bytes = b""
    toxic: bytes = b""
    weights: tuple[float, ...] = ()

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def features(self, text: str) -> np.ndarray:
        """Of the bytes saved per window: largest, two largest, shares of 2 and 3 or more, means."""
        if "_two" not in self.__dict__:
            filler = b"\0" * len(self.toxic)  # both are of one length, so that distances cost the same
            self._two = _compressor(self.ordinary + filler), _compressor(self.ordinary + self.toxic)
        plain, other = self._two
        anchor = self.ordinary[-_ANCHOR:]  # found in both: a frame with one match pays for the next ones
        windows = [anchor + w for w in _windows(_words(text))]
        saved = np.array([len(plain.compress(w)) - len(other.compress(w)) for w in windows])
        if not len(saved):
            return np.zeros(_FEATURES)
        top = np.partition(saved, max(0, len(saved) - 2))[-2:]
        return np.array(
            [top.max(), top.sum(), (saved >= 2).mean(), (saved >= 3).mean(), saved.mean(), saved.clip(0).mean()]
        )

    def score(self, text: str) -> float:
        if not self.weights:
            return 0.0
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def _without_near_copies(rows: list[tuple[int, str]]) -> list[tuple[int, str]]:
    """Drops rows that share two of three min-hashes of five-word runs with an earlier one."""
    factors = [np.uint64(f) for f in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
    seen: list[set[int]] = [set() for _ in factors]
    kept = []
    for row in rows:
        words = _words(row[1])
        runs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + 5])) for i in range(max(1, len(words) - 4))]
        hashes = np.array(runs, "u8")
        least = [int((hashes * f).min()) for f in factors]
        if sum(v in s for v, s in zip(least, seen, strict=True)) < 2:
            kept.append(row)
        for v, s in zip(least, seen, strict=True):
            s.add(v)
    return kept


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, ...]:
    """Weighted logistic regression by Newton steps, with a slight penalty on its weights."""
    mean, spread = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = np.column_stack([np.ones(len(x)), (x - mean) / spread])
    w = np.zeros(z.shape[1])
    ridge = 0.1 * np.eye(z.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
        slope = z.T @ (weight * (p - y)) + ridge @ w
        w -= np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge, slope)
    slopes = w[1:] / spread
    return (float(w[0] - slopes @ mean), *map(float, slopes))


def fit(rows: list[tuple[int, str]], toxic_share: float) -> ToxicityModel:
    """
    A model from labelled texts (label, text). The toxic dictionary is trained on the words,
    with the blanks around them, that at least 1 % of the toxic texts use, and relatively eight times as
    many as of the ordinary ones.
    """
    rows = _without_near_copies(rows)
    toxic = [t for label, t in rows if label]
    ordinary = [t for label, t in rows if not label]
    if not toxic or not ordinary:
        return ToxicityModel()
    in_toxic, in_ordinary = (Counter(w for t in own for w in set(_words(t))) for own in (toxic, ordinary))
    own = {
        w for w, n in in_toxic.items()
        if n >= max(2, len(toxic) / 100) and n / len(toxic) >= 8 * (in_ordinary[w] + 1) / len(ordinary)
    }
    telling = [b" " + w + b" " for t in toxic for w in _words(t) if w in own]
    common = [w for t in ordinary for w in _windows(_words(t))]
    model = ToxicityModel(
        ordinary=_trained(_ORDINARY_BYTES, common), toxic=_trained(_TOXIC_BYTES, telling)
    )
    x = np.array([model.features(t) for t in toxic + ordinary])
    y = np.repeat([1.0, 0.0], [len(toxic), len(ordinary)])
    share = min(max(toxic_share, 1e-6), 1 - 1e-6)
    weight = np.where(y == 1, share / len(toxic), (1 - share) / len(ordinary)) * len(y)
    model.weights = _logistic(x, y, weight)
    return model


def _trained(size: int, samples: list[bytes]) -> bytes:
    """A trained dictionary; too few samples to train on are taken as they are."""
    if len(samples) > 50_000:
        samples = samples[:: len(samples) // 25_000]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(dict.fromkeys(samples))[-size:]


def learn(
    docs: DataFrame, labels: DataFrame, toxic_rows: int = 1500, ordinary_rows: int = 3000,
    longest: int = 20_000, doc_id: str = "doc_id", text: str = "text", label: str = "toxic",
) -> ToxicityModel:
    """
    Fits on a sample of the labelled documents that are not held out: at most `toxic_rows` and
    `ordinary_rows` of each class, by the order of a hash of doc_id, of texts of at most
    `longest` characters. That bounds what comes to the driver to 90 million characters.
    """
    known = labels.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(label).cast("int").alias("toxic"))
    known = known.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    order = [F.xxhash64("doc_id"), "doc_id"]
    some = known.where("toxic = 1").orderBy(*order).limit(2 * toxic_rows).unionByName(
        known.where("toxic = 0").orderBy(*order).limit(2 * ordinary_rows)
    )
    own = texts(docs, doc_id, text).where(F.length("text") <= longest)
    chosen = own.join(F.broadcast(some), "doc_id")  # at most 9,000 ids
    parts = [
        chosen.where(F.col("toxic") == value).orderBy(*order, "text").limit(most).select("toxic", "text")
        for value, most in ((1, toxic_rows), (0, ordinary_rows))
    ]
    rows = [(r["toxic"], r["text"]) for part in parts for r in part.collect()]
    total = sum(counts.values())
    return fit(rows, counts.get(1, 0) / total if total else 0.0)


def scores(docs: DataFrame, model: ToxicityModel, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """
    (doc_id, score): the probability of each whole text to be toxic. Only the text counts, so
    repeated texts score alike. Null texts are empty; a text without a word has no distance.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = [sent.value.score(t.as_py()) for t in batch.column("text")]
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.float64())], ["doc_id", "score"])

    return per_batch(texts(docs, doc_id, text), work, "doc_id long, score double")


def without_toxic(
    docs: DataFrame, model: ToxicityModel, at: float = REJECT_AT, text: str = "text"
) -> DataFrame:
    """The rows of `docs`, all columns as they are, that score below `at`."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        clean = [sent.value.score(t.as_py() or "") < at for t in batch.column(text)]
        return batch.filter(pa.array(clean, pa.bool_()))

    return per_batch(docs, work, docs.schema)
