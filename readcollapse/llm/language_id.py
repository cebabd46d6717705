"""Language identification by a string kernel, Nystrom landmarks and one-versus-rest kernel ridge regression.

The kernel of two texts is the number of byte n-grams (1 to 4 bytes, letters folded, what is not a letter taken as a space)
that both hold, over the root of the product of their own numbers: a blended-spectrum presence kernel.  n-grams
are told apart by a hash of 16 bits.  Landmarks are training texts; a text's Nystrom features are its kernel values against
them times the inverse root of their own kernel matrix, and a ridge regression of +1/-1 gives each language a decision value.

Both steps are linear in the presence vector, so landmarks, whitening and regression weights are multiplied once on the
driver; a batch of texts is then scored by one matrix product, presence (texts x 65536) by weights (65536 x languages).

Defined results: `und` and score 0 for a text that is null or has no letter, and for all texts if nothing can be learned; a text of letters
that no training text has gets some language, with a score of about 1 / languages;
an empty table gives an empty result; repeated rows give repeated results; ties go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, fresh, labelled_sample, release, remainder, small_batches, text_slices, utf8

#: Bounds of what is fitted: training texts and landmarks of each language.
TRAIN_PER_LANGUAGE = 400
LANDMARKS_PER_LANGUAGE = 64
RIDGE = 0.1
BITS = 16
SEED = 4
#: Rows of a presence matrix.
ROWS = 32
#: The least score of an accepted document, as a multiple of what chance gives.
LEAST = 1.2

_FOLD = LOWER.copy()
_FOLD[[i for i in range(128) if not chr(i).isalpha()]] = 32


def presence(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x 65536 matrix of 0 and 1 (bytes)."""
    rows = len(offsets) - 1
    out = np.zeros(rows << BITS, np.uint8)
    folded = _FOLD[data].astype(np.uint32)
    base = (np.repeat(np.arange(rows), np.diff(offsets)) << BITS).astype(np.int64)
    left = np.repeat(offsets[1:], np.diff(offsets)) - np.arange(len(data))
    code = np.zeros(len(data), np.uint32)
    for n in range(1, 5):
        m = len(data) - n + 1
        if m <= 0:
            break
        code = code[:m] * np.uint32(257) + folded[n - 1 :] + np.uint32(1)
        slot = (code * np.uint32(2654435761) + np.uint32(n * 40503)) * np.uint32(2246822519) >> np.uint32(32 - BITS)
        whole = left[:m] >= n
        out[(base[:m] + slot)[whole]] = 1
    return out.reshape(rows, 1 << BITS)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray  # 65536 x languages; divide by the root of the number of n-grams

    def decide(self, present: np.ndarray) -> np.ndarray:
        norm = np.sqrt(np.maximum(present.sum(axis=1, dtype=np.int64), 1))
        return (present.astype(np.float32) @ self.weights) / norm[:, None].astype(np.float32)


def _chunks(texts: list[str]) -> Iterator[np.ndarray]:
    for i in range(0, len(texts), ROWS):
        yield presence(*utf8(pa.array(texts[i : i + ROWS], pa.string())))


def fit(texts: list[str], labels: list[str], landmarks: int = LANDMARKS_PER_LANGUAGE, ridge: float = RIDGE) -> Model:
    languages = sorted(set(labels))
    taken = [i for name in languages for i in [j for j, x in enumerate(labels) if x == name][:landmarks]]
    marks = np.concatenate([m.astype(np.float32) for m in _chunks([texts[i] for i in taken])]) if taken else np.zeros((0, 1 << BITS), np.float32)
    marks /= np.sqrt(np.maximum(marks.sum(axis=1, keepdims=True), 1))
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    good = values > 1e-8 * max(values.max(initial=0), 1e-30)
    whiten = vectors[:, good] / np.sqrt(values[good])
    kernel = np.concatenate([(p.astype(np.float32) @ marks.T) / np.sqrt(np.maximum(p.sum(axis=1, dtype=np.int64), 1))[:, None] for p in _chunks(texts)])
    z = kernel.astype(np.float64) @ whiten
    y = np.where(np.array(labels)[:, None] == np.array(languages)[None], 1.0, -1.0)
    # Each language weighs the same, however many texts it has.
    w = 1 / np.array([labels.count(x) for x in labels])
    solved = np.linalg.solve((z * w[:, None]).T @ z + ridge / len(languages) * np.eye(z.shape[1]) * w.mean(), (z * w[:, None]).T @ y)
    return Model(languages, (marks.T @ (whiten @ solved).astype(np.float32)).astype(np.float32))


def train(docs: DataFrame, lang: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """Fits on a bounded sample of rows with text and language."""
    rows = docs.select("doc_id", "text", F.octet_length("text").alias("size"), F.col(lang).alias("lang")).filter(F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("doc_id").isNotNull())
    sample, counts = labelled_sample(rows, "lang", per_language, SEED)
    return fit([r["text"] for r in sample], [r["lang"] for r in sample]) if counts else None


def _guess(text: pa.Array, model: Model | None) -> tuple[np.ndarray, np.ndarray]:
    """Languages and scores of texts."""
    known = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    best, value = np.full(len(text), "und", object), np.zeros(len(text))
    if model and known.any():
        f = model.decide(presence(*utf8(text))).astype(np.float64)
        e = np.exp(4 * (f - f.max(axis=1, keepdims=True)))
        top = f.argmax(axis=1)
        best = np.where(known, np.array(model.languages, object)[top], "und")
        value = np.where(known, (e / e.sum(axis=1, keepdims=True))[np.arange(len(f)), top], 0.0)
    return best, value


def guess(spark: SparkSession, model: Model | None):
    """An Arrow function of texts that gives struct (lang_pred, score); only texts go to Python."""
    small_batches(spark)
    names = model.languages if model else []
    held = spark.sparkContext.broadcast(model.weights) if model else None

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = Model(names, held.value) if held else None
        try:
            for column in batches:
                found = []
                for piece in text_slices(pa.RecordBatch.from_arrays([column], ["text"]), "text", 1 << 20):
                    for at in range(0, piece.num_rows, ROWS):
                        found.append(_guess(piece.column(0).slice(at, ROWS), own))
                best, value = (np.concatenate(x) for x in zip((np.zeros(0, object), np.zeros(0)), *found, strict=True))
                yield pa.StructArray.from_arrays([pa.array(best, pa.string()), pa.array(value, pa.float64())], ["lang_pred", "score"])
        finally:
            release()

    return run


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (text and others) with `prediction`, a struct of lang_pred and score, under a name that docs does not have; it is the last column."""
    return docs.withColumn(fresh(docs, "prediction"), guess(docs.sparkSession, model)(F.col("text")))


def identify(docs: DataFrame, held_out: tuple[int, int] = (4, 2)) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document; rows with remainder held_out[1] are not learned from."""
    out_of = remainder("doc_id", held_out[0]) == held_out[1]
    model = train(docs.filter(~out_of))
    found = predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", out_of.alias("held_out"), "prediction.lang_pred", "prediction.score")


def accept(docs: DataFrame, languages: Sequence[str] | None = None, least: float = LEAST) -> DataFrame:
    """Documents whose predicted language is one of `languages` (None: any that was learned), with a score of at least `least` times chance.

    What is null or has no letter goes, and so does a text that no learned language explains: its decision values are nearly equal, and its score is
    about that of chance, 1 / learned languages.  Rows and columns that stay are as they were.  If nothing can be learned, texts with a letter stay, unless
    `languages` names some.
    """
    model = train(docs.filter(remainder("doc_id", 4) != 2))
    if model is None:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)) if languages is None else F.lit(False))
    wanted = model.languages if languages is None else list(languages)
    found = predict(docs, model)
    kept = F.col(found.columns[-1])
    return found.filter(kept["lang_pred"].isin(wanted) & (kept["score"] >= min(1.0, least / len(model.languages)))).drop(found.columns[-1])
