"""Language identification with string kernels.

The kernel of two texts is the number of distinct character n-grams of length 1 to 3 that both have, over the geometric mean of
how many each has: a blended-spectrum presence kernel on the n-grams themselves, which fit into 63 bits. Landmark texts give the
Nystroem features, on which kernel ridge regression is fitted one versus rest. A text's kernel values follow from those of
its n-grams that some landmark has, so a batch of whole texts is scored by one product of their presence matrix over
these n-grams with the landmarks' and one with the coefficients.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seriesloom.llm.shared import small_batches

LENGTHS = (1, 2, 3)
#: Bounds of the training sample: languages (those with most rows), rows of each, characters of each, landmarks of each and of all.
MOST_LANGUAGES, TRAIN_PER_LANGUAGE, TRAIN_CHARS, LANDMARKS_PER_LANGUAGE, LANDMARKS = 64, 300, 1 << 15, 24, 256
RIDGE, SHARPNESS = 0.05, 4.0
#: Times as many rows as the sample takes that are ranked.
THINNED = 8
#: Characters whose n-grams are gathered at once.
AT_ONCE = 1 << 18
UNKNOWN = "und"

_LETTER = re.compile(r"[^\W\d_]")

def has_letter(text: str | None) -> bool:
    """Whether any character of the text is a letter."""
    return text is not None and any(m[0].isalpha() for m in _LETTER.finditer(text))


def grams(text: str) -> np.ndarray:
    """The distinct n-grams of the lower-cased text, in order: code points plus one, 21 bits each."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64) + 1
    found = [np.zeros(0, dtype=np.int64)]
    for start in range(0, len(points), AT_ONCE):
        part = points[start : start + AT_ONCE + max(LENGTHS) - 1]
        own = [part[:AT_ONCE]]
        for n in LENGTHS[1:]:
            if len(part) >= n:
                before = own[-1][: len(part) - n + 1]
                own.append((before << 21) | part[n - 1 : n - 1 + len(before)])
        found.append(np.unique(np.concatenate(own)))
    return np.unique(np.concatenate(found)) if len(found) > 2 else found[-1]


def kernel(a: np.ndarray, b: np.ndarray) -> float:
    """The kernel of two texts, from their n-grams."""
    return len(np.intersect1d(a, b, assume_unique=True)) / math.sqrt(max(len(a), 1) * max(len(b), 1))


@dataclass(frozen=True)
class Model:
    """languages; all n-grams of the landmarks, in order; which landmark has which, over the root of its number of n-grams;
    coefficients from kernel values to one-versus-rest scores."""

    languages: list[str]
    known: np.ndarray
    landmarks: np.ndarray
    coefficients: np.ndarray

    def kernels(self, texts: list[np.ndarray]) -> np.ndarray:
        """Kernel values of texts, given by their n-grams, with the landmarks."""
        out = np.zeros((len(texts), len(self.known)), dtype=np.float32)
        if len(self.known):
            for row, own in zip(out, texts, strict=True):
                at = np.minimum(np.searchsorted(self.known, own), len(self.known) - 1)
                row[at[self.known[at] == own]] = 1 / math.sqrt(max(len(own), 1))
        return out @ self.landmarks

    def predict(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and its score, 0 to 1, for each text."""
        margins = self.kernels([grams(t) for t in texts]) @ self.coefficients
        odds = np.exp(SHARPNESS * (margins - margins.max(axis=1, keepdims=True)))
        return margins.argmax(axis=1), 1 / odds.sum(axis=1, dtype=np.float64)


def fit(texts: list[str], languages: list[str], per_language: int = LANDMARKS_PER_LANGUAGE) -> Model:
    """Ridge regression of one-versus-rest targets on the Nystroem features of the landmarks, the first texts of each language."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], dtype=np.int64)
    each = max(1, min(per_language, LANDMARKS // max(len(names), 1)))
    chosen = [i for k in range(len(names)) for i in np.flatnonzero(label == k)[:each].tolist()]
    own = [grams(t) for t in texts]
    known = np.unique(np.concatenate([own[i] for i in chosen])) if chosen else np.zeros(0, dtype=np.int64)
    landmarks = np.zeros((len(known), len(chosen)), dtype=np.float32)
    for column, i in enumerate(chosen):
        landmarks[np.searchsorted(known, own[i]), column] = 1 / math.sqrt(max(len(own[i]), 1))
    model = Model(names, known, landmarks, np.zeros((len(chosen), len(names)), dtype=np.float32))
    between = np.concatenate([model.kernels(own[i : i + 128]) for i in range(0, len(own), 128)]).astype(np.float64)
    values, vectors = np.linalg.eigh(between[chosen])
    root = vectors / np.sqrt(np.maximum(values, 1e-6)) @ vectors.T
    features = between @ root
    targets = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    weight = 1 / np.maximum(np.bincount(label, minlength=len(names)), 1)[label]  # languages count alike
    weighted = features * weight[:, None]
    solved = np.linalg.solve(weighted.T @ features + RIDGE * np.eye(len(chosen)) / max(len(chosen), 1), weighted.T @ targets)
    return Model(names, known, landmarks, (root @ solved).astype(np.float32))


def held_out(id_col: str = "doc_id") -> Column:
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def training_rows(docs: DataFrame, *, id_col: str, text_col: str, lang_col: str, most: int) -> list[tuple[str, str]]:
    """Beginnings (of TRAIN_CHARS characters) of at most ``most`` labelled texts per language that are not held out.

    Chosen by the smallest hash of identifier and text, for the MOST_LANGUAGES languages with most rows. Each language is thinned by its
    own count to THINNED times as many first, and repeated rows count once, so that ranking sees few rows whatever the table; the
    driver gets at most MOST_LANGUAGES * most texts.
    """
    may = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~F.coalesce(held_out(id_col), F.lit(False)) & F.col(text_col).rlike(r"\p{L}"))
    may = may.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.xxhash64(F.col(id_col), F.col(text_col), F.lit("language sample")).alias("draw"))
    counts = may.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.col("n").desc(), "lang").limit(MOST_LANGUAGES).collect()
    if not counts:
        return []
    shares = F.broadcast(docs.sparkSession.createDataFrame([(r["lang"], min(1.0, THINNED * most / r["n"])) for r in counts], "lang string, share double"))
    thin = may.join(shares, "lang").where(F.pmod("draw", F.lit(1 << 32)) / float(1 << 32) < F.col("share"))
    each = thin.groupBy("lang", "draw").agg(F.min(F.substring("text", 1, TRAIN_CHARS)).alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("draw"))
    rows = each.withColumn("rank", rank).where(F.col("rank") <= most).collect()
    return [(r["text"], r["lang"]) for r in sorted(rows, key=lambda r: (r["lang"], r["draw"])) if has_letter(r["text"])]


def scorer(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, 128):
            texts = batch.column(2).to_pylist()
            known = [i for i, t in enumerate(texts) if has_letter(t)]
            names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
            if known and model.languages:
                best, values = model.predict([texts[i] for i in known])
                for i, k, v in zip(known, best.tolist(), values.tolist(), strict=True):
                    names[i], scores[i] = model.languages[k], v
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return score


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = TRAIN_PER_LANGUAGE) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs.

    held_out is crc32 of the id as text, modulo 3, being 1; such rows and rows without text or language take no part in
    learning, and a null id counts as not held out. Null texts and texts without a letter get ``und`` and score 0, as
    all rows do where nothing can be learned. Whole texts are scored, very long ones a part at a time. Repeated rows get the same
    result each; of languages that score the same the first by name wins. An empty table gives no rows; other columns are
    ignored, whatever they are called.
    """
    rows = training_rows(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, most=per_language)
    model = fit([t for t, _ in rows], [x for _, x in rows]) if rows else Model([], np.zeros(0, np.int64), np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32))
    columns = [F.col(id_col).cast("long").alias("doc_id"), F.coalesce(held_out(id_col), F.lit(False)).alias("held_out"), F.col(text_col)]
    return docs.select(*columns).mapInArrow(scorer(model), "doc_id long, held_out boolean, lang_pred string, score double")
