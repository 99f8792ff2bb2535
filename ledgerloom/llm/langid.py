"""Language identification with string kernels.

**Kernel.** A text is lower-cased, every run of non-letters becomes one space, and the sets of its character n-grams of
each order in ``orders`` are hashed into ``1 << bits`` presence slots per order. The blended spectrum kernel of two texts
is the mean over the orders of ``|A & B| / sqrt(|A| |B|)``.

**Learning.** ``per_language`` documents of each language (the smallest hashes of doc_id: a documented bound) are turned
into presence bits on the executors; the first ``landmarks`` of each language are the Nystroem landmarks. One-versus-rest
kernel ridge regression on the Nystroem features gives weights on the landmarks. As the kernel is linear in the presence
bits of the scored text, landmarks and weights fold into one (slots x languages) matrix of fixed height, and whole batches
of texts are scored by one matrix product per order.

**Edge cases.** A null text, or one without a letter, is ``und`` with score 0; so is every text when there is nothing to learn
from. Equal scores go to the alphabetically first language. Rows that repeat are predicted alike. The score is the
regression's membership value for the predicted language, clipped to 0..1.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ledgerloom.llm.memory import task
from ledgerloom.session import ship

_BATCH = 64


@dataclass(frozen=True)
class Settings:
    orders: tuple[int, ...] = (2, 3, 4)
    bits: int = 15
    per_language: int = 200
    landmarks: int = 40
    ridge: float = 1e-2


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # orders x slots x languages
    settings: Settings


class _Letters:
    """Which code points are letters; filled page by page as texts need them."""

    def __init__(self):
        self.table = np.zeros(0x110000, bool)
        self.known = np.zeros(0x1100, bool)

    def __call__(self, points: np.ndarray) -> np.ndarray:
        for page in np.flatnonzero(np.bincount(points >> 8, minlength=1) > 0):
            if not self.known[page]:
                self.table[page << 8 : (page + 1) << 8] = [chr(i).isalpha() for i in range(page << 8, (page + 1) << 8)]
                self.known[page] = True
        return self.table[points]


_letters = None


def presence(text: str | None, settings: Settings) -> np.ndarray | None:
    """The presence bits (orders x slots, uint8) of the whole text; None without a letter."""
    global _letters
    if not text:
        return None
    _letters = _letters or _Letters()
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters(points)
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first non-letter of each run stays, as a space
    units = np.where(letter, points, np.uint32(32))[keep]
    units = np.concatenate(([np.uint32(32)], units, [np.uint32(32)] if units[-1] != 32 else [])).astype(np.uint32)
    out = np.zeros((len(settings.orders), 1 << settings.bits), np.uint8)
    code, order = units.copy(), 1
    for row, wanted in enumerate(settings.orders):
        while order < wanted and len(code) > 1:
            code = code[:-1] * np.uint32(0x01000193) + units[order:]
            order += 1
        mixed = (code ^ (code >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
        out[row, mixed >> np.uint32(32 - settings.bits)] = 1
    return out


def train_split(doc_id: Column) -> Column:
    """Held out: crc32 of the id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, settings: Settings = Settings()) -> Model:
    """Learn from text and lang of the rows that are not held out."""
    ship(docs.sparkSession)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    usable = own.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~train_split(F.col("doc_id")) & F.col("text").rlike(r"\p{L}"))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = usable.select("doc_id", "lang").withColumn("place", F.row_number().over(order)).where(F.col("place") <= settings.per_language).groupBy("doc_id", "lang").agg(F.min("place").alias("place"))

    def bits(batches):
        for batch in batches:
            rows = [(i, presence(x, settings)) for i, x in enumerate(batch.column(1).to_pylist())]
            kept = [i for i, x in rows if x is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int32())), batch.column(2).take(pa.array(kept, pa.int32())), batch.column(3).take(pa.array(kept, pa.int32())), pa.array([np.packbits(x).tobytes() for _, x in rows if x is not None], pa.binary())], ["doc_id", "lang", "place", "bits"])

    # at most per_language rows for each language, each of a fixed size: of rows that repeat a doc_id and lang one stands for all
    sample = usable.join(F.broadcast(chosen), ["doc_id", "lang"]).select("doc_id", "text", "lang", "place").mapInArrow(task(bits), "doc_id long, lang string, place int, bits binary").groupBy("lang", "place", "doc_id").agg(F.min("bits").alias("bits")).collect()
    sample.sort(key=lambda r: (r["place"], r["lang"], r["doc_id"], bytes(r["bits"])))
    languages = tuple(sorted({r["lang"] for r in sample}))
    slots = 1 << settings.bits
    if not languages:
        return Model((), np.zeros((len(settings.orders), slots, 0), np.float32), settings)

    def normed(rows: list) -> np.ndarray:
        x = np.stack([np.unpackbits(np.frombuffer(r["bits"], np.uint8)).reshape(len(settings.orders), slots) for r in rows]).astype(np.float32)
        x /= np.sqrt(np.maximum(x.sum(axis=2, keepdims=True), 1)) * np.sqrt(len(settings.orders))
        return x.reshape(len(rows), -1)

    marks = normed([r for r in sample if r["place"] <= settings.landmarks])
    inner = (marks @ marks.T).astype(np.float64)
    values, vectors = np.linalg.eigh(inner)
    good = values > 1e-6 * values[-1]
    root = vectors[:, good] / np.sqrt(values[good])
    features = np.concatenate([normed(sample[i : i + _BATCH]) @ marks.T for i in range(0, len(sample), _BATCH)]).astype(np.float64) @ root
    features = np.hstack([features, np.ones((len(features), 1))])
    target = np.array([[r["lang"] == c for c in languages] for r in sample], float)
    share = 1 / (target.sum(axis=0)[[languages.index(r["lang"]) for r in sample]])  # each language weighs the same
    scaled = features * share[:, None]
    solved = np.linalg.solve(scaled.T @ features + settings.ridge * share.mean() * np.eye(features.shape[1]), scaled.T @ target)
    folded = marks.T.astype(np.float64) @ (root @ solved[:-1])
    weights = folded.reshape(len(settings.orders), slots, len(languages)) / np.sqrt(len(settings.orders))
    return Model(languages, np.concatenate([weights, np.broadcast_to(solved[-1] / len(settings.orders), (len(settings.orders), 1, len(languages)))], axis=1).astype(np.float32), settings)


def scores(rows: np.ndarray, model: Model) -> np.ndarray:
    """Membership values of a batch of presence bits (batch x orders x slots)."""
    total = np.zeros((len(rows), len(model.languages)), np.float32)
    for n in range(rows.shape[1]):
        block = rows[:, n].astype(np.float32)
        norm = np.sqrt(np.maximum(block.sum(axis=1, keepdims=True), 1))
        total += block @ model.weights[n, :-1] / norm + model.weights[n, -1]
    return total


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` reduced to ``(doc_id, lang_pred, score)``, one row per input row."""
    return _with_scores(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), model, [0])


def identify(docs: DataFrame, model: Model, label: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with all its columns, and the prediction and its score added under two names (columns of those names are replaced)."""
    own = docs.drop(label, score)
    return _with_scores(own.select("*", F.col("text").cast("string").alias(_free_name(own))), model, list(range(len(own.columns))), label, score)


def _free_name(docs: DataFrame) -> str:
    return "_" * (1 + max(map(len, docs.columns)))


def _with_scores(docs: DataFrame, model: Model, keep: list[int], label: str = "lang_pred", score_name: str = "score") -> DataFrame:
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    names = [docs.columns[i] for i in keep]

    def run(batches):
        learned = shared.value
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            best = np.full(len(texts), -1)
            score = np.zeros(len(texts))
            for begin in range(0, len(texts) if learned.languages else 0, _BATCH):
                some = [(i, presence(texts[i].as_py(), learned.settings)) for i in range(begin, min(begin + _BATCH, len(texts)))]
                at = [i for i, x in some if x is not None]
                if at:
                    value = scores(np.stack([x for _, x in some if x is not None]), learned)
                    best[at] = value.argmax(axis=1)
                    score[at] = np.clip(value.max(axis=1).astype(float), 0, 1)
            labels = [learned.languages[i] if i >= 0 else "und" for i in best]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(labels, pa.string()), pa.array(score)], [*names, label, score_name])

    schema = T.StructType([docs.schema[i] for i in keep]).add(label, "string").add(score_name, "double")
    return docs.mapInArrow(task(run), schema)


def language_table(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``(doc_id, held_out, lang_pred, score)`` for every row of ``docs``, learned from its own rows that are not held out."""
    found = predict(docs, fit(docs, settings))
    return found.select("doc_id", train_split(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
