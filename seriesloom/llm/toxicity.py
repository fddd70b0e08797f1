"""Severity of toxicity by a cumulative-link ordinal model over words and their beginnings.

P(grade > k) = sigmoid(w.x - t_k): one weight per feature, shared by all thresholds t_0 < t_1. x says which of the chosen words
and beginnings of words, of 4 to 8 characters, a text has. The output is the expected grade.

Labels only say toxic or not, so grades are a convention, made without a text's own label: the sample is dealt into two
folds, marker words (high log-odds) of each fold grade the toxic texts of the other, and the half with the denser markers has grade 2.
Where rejection starts is also found across folds: each fold's model scores the other fold, and the first threshold
moves to where missed toxic texts and flagged clean ones, which weigh COST times as much, are fewest.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seriesloom.llm.shared import checkpointed, small_batches

#: Bounds of the training sample: rows by label, one per labelled id, and characters of each.
TRAIN_TOXIC, TRAIN_CLEAN, TRAIN_CHARS = 3000, 6000, 1 << 16
#: Features are chosen by texts that have them, log-odds, and log-odds in standard errors; markers by log-odds.
LEAST_TEXTS, CHOSEN_ODDS, CHOSEN_ERRORS, MARKER_ODDS = 3, 1.5, 2.0, 3.0
PENALTY, STEPS, REJECT_FROM, COST = 0.001, 400, 0.5, 20
BEGINNINGS = (4, 5, 6, 7, 8)
#: Words whose features a worker remembers.
MOST_KEPT = 100_000

_WORD = re.compile(r"\w+")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def features(word: str) -> list[str]:
    """The word, and its proper beginnings marked as such."""
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


@dataclass(frozen=True)
class Model:
    """Weight of each feature and the two thresholds."""

    weights: dict[str, float]
    thresholds: tuple[float, float]
    known: dict[str, tuple[str, ...]] = field(default_factory=dict, compare=False, repr=False)

    def weighing(self, word: str) -> tuple[str, ...]:
        """Those features of a word that have a weight."""
        found = self.known.get(word)
        if found is None:
            if len(self.known) >= MOST_KEPT:
                self.known.clear()
            found = tuple(f for f in features(word) if f in self.weights)
            if len(word) <= 64:
                self.known[word] = found
        return found

    def present(self, text: str | None) -> set[str]:
        return {f for own in map(self.weighing, set(words(text or ""))) for f in own}

    def above(self, text: str | None) -> list[float]:
        """P(grade > 0), P(grade > 1). Null counts as empty."""
        value = math.fsum(self.weights[f] for f in self.present(text))
        return [1 / (1 + math.exp(-max(-500.0, min(500.0, value - t)))) for t in self.thresholds]


COUNTS = ("bad_0", "good_0", "bad_1", "good_1")


def counter(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """In how many toxic and other texts of each fold a feature is; what a task has counted is passed on whenever it gets large."""
    counts = [Counter() for _ in COUNTS]

    def flush() -> pa.RecordBatch:
        names = list(set().union(*counts))
        out = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[f] for f in names], pa.int64()) for c in counts)], names=["feature", *COUNTS])
        for c in counts:
            c.clear()
        return out

    for batch in small_batches(batches):
        for text, toxic, fold in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            counts[2 * fold + (not toxic)].update({f for w in set(words(text)) for f in features(w)})
        if sum(map(len, counts)) > 2 * MOST_KEPT:
            yield flush()
    yield flush()


def vectoriser(chosen: dict[str, int], markers: list[frozenset[str]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Places of the chosen features that a text has, and its density of the other fold's markers."""
    keep = Model(dict.fromkeys(chosen, 0.0), (0.0, 1.0))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            places, density = [], []
            for text, fold in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                own, other = words(text), markers[1 - fold]
                places.append(sorted(chosen[f] for f in keep.present(text)))
                density.append(sum(any(f in other for f in keep.weighing(w)) for w in own) / max(len(own), 1))
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(places, pa.list_(pa.int32())), pa.array(density, pa.float64())], names=["toxic", "fold", "places", "density"])

    return run


def choose(bad: np.ndarray, good: np.ndarray, n_bad: int, n_good: int) -> tuple[np.ndarray, np.ndarray]:
    """Log-odds of features, and which tell enough."""
    odds = np.log((bad + 0.5) / (n_bad + 1)) - np.log((good + 0.5) / (n_good + 1))
    errors = np.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5))
    return odds, (bad + good >= LEAST_TEXTS) & (np.abs(odds) >= np.maximum(CHOSEN_ODDS, CHOSEN_ERRORS * errors))


def fit(n_features: int, rows: np.ndarray, columns: np.ndarray, grade: np.ndarray) -> tuple[np.ndarray, float, float]:
    """Weights and thresholds: accelerated gradient descent on the ordinal likelihood, toxic and other texts weighing alike, with a
    squared penalty. Text rows[i] has feature columns[i].
    """
    toxic = grade > 0
    weight = np.where(toxic, 0.5 / max(toxic.sum(), 1), 0.5 / max((~toxic).sum(), 1))
    w, t = np.zeros(n_features), np.array([1.0, 3.0])
    fast_w, fast_t, rate = w.copy(), t.copy(), 1.0
    for step in range(STEPS):
        score = np.bincount(rows, fast_w[columns], minlength=len(grade))
        pull, slope_t = np.zeros(len(grade)), np.zeros(2)
        for k in (0, 1):
            error = weight * (1 / (1 + np.exp(-np.clip(score - fast_t[k], -500, 500))) - (grade > k))
            pull += error
            slope_t[k] = -error.sum()
        slope_w = np.bincount(columns, pull[rows], minlength=n_features) + PENALTY * fast_w
        new_w, new_t = fast_w - rate * slope_w, fast_t - rate * slope_t
        new_t[1] = max(new_t[1], new_t[0] + 0.1)
        momentum = step / (step + 3)
        fast_w, fast_t = new_w + momentum * (new_w - w), new_t + momentum * (new_t - t)
        w, t = new_w, new_t
    return w, float(t[0]), float(t[1])


def best_cut(margins: np.ndarray, toxic: np.ndarray) -> float:
    """The margin from which on texts are rejected so that missed share + COST * flagged share is least; at most 1 from the model's own, 0.

    In the middle of the gap that has the least, the one nearest to 0.
    """
    ends = np.unique(np.concatenate([np.clip(margins, -1, 1), [-1.0, 0.0, 1.0]]))
    cuts = np.concatenate([[0.0], (ends[1:] + ends[:-1]) / 2])
    bad, good = np.sort(margins[toxic]), np.sort(margins[~toxic])
    loss = np.searchsorted(bad, cuts) / max(len(bad), 1) + COST * (len(good) - np.searchsorted(good, cuts)) / max(len(good), 1)
    least = cuts[loss <= loss.min() + 1e-12]
    return float(least[np.abs(least).argmin()])


def training_rows(docs: DataFrame, labels: DataFrame, most_toxic: int, most_clean: int) -> DataFrame:
    """text (its first TRAIN_CHARS characters), toxic and fold of at most so many labelled documents of each kind, those with the
    smallest hash of the id.

    The identifiers are chosen from the labels alone; they are few enough, by these bounds, to broadcast. Of rows that
    repeat an identifier the text with the smallest hash counts.
    """
    one = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    draw = one.withColumn("draw", F.xxhash64("doc_id", F.lit("toxicity sample")))
    ids = draw.where("toxic = 1").orderBy("draw", "doc_id").limit(most_toxic).union(draw.where("toxic = 0").orderBy("draw", "doc_id").limit(most_clean))
    ids = ids.select("doc_id", (F.col("toxic") == 1).alias("toxic"), F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(2)).cast("int").alias("fold"))
    found = docs.where("text is not null").select("doc_id", F.substring("text", 1, TRAIN_CHARS).alias("text")).join(F.broadcast(ids), "doc_id")
    each = found.groupBy("doc_id", "toxic", "fold").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    return each.select("text", "toxic", "fold")


def trained(docs: DataFrame, labels: DataFrame, most_toxic: int = TRAIN_TOXIC, most_clean: int = TRAIN_CLEAN) -> Model:
    """The model of the labelled rows of docs. The driver gets the chosen features and which texts of the sample have them, no text."""
    sample = checkpointed(training_rows(docs, labels, most_toxic, most_clean))
    sizes = Counter({(r["toxic"], r["fold"]): r["count"] for r in sample.groupBy("toxic", "fold").count().collect()})
    n = {toxic: [sizes[toxic, 0], sizes[toxic, 1]] for toxic in (True, False)}
    if not sum(n[True]) or not sum(n[False]):
        return Model({}, (5.0, 6.0))
    counts = sample.mapInArrow(counter, ", ".join(["feature string", *(f"{c} long" for c in COUNTS)])).groupBy("feature").agg(*(F.sum(c).alias(c) for c in COUNTS))
    total = F.col("bad_0") + F.col("good_0") + F.col("bad_1") + F.col("good_1")
    made = counts.where(total >= LEAST_TEXTS).select("feature", *COUNTS)
    # only what one of the three choices (whole sample, either fold) may take reaches the driver
    bad, good = F.col("bad_0") + F.col("bad_1"), F.col("good_0") + F.col("good_1")
    odds = F.abs(F.log((bad + 0.5) / (sum(n[True]) + 1)) - F.log((good + 0.5) / (sum(n[False]) + 1)))
    table = made.where((odds >= CHOSEN_ODDS) & (odds >= CHOSEN_ERRORS * F.sqrt(1 / (bad + 0.5) + 1 / (good + 0.5)))).orderBy("feature").toArrow()
    names = table.column("feature").to_pylist()
    c = {x: table.column(x).to_numpy().astype(np.float64) for x in COUNTS}
    folds = [choose(c[f"bad_{k}"], c[f"good_{k}"], n[True][k], n[False][k]) for k in (0, 1)]
    markers = [frozenset(np.array(names, dtype=object)[take & (own >= MARKER_ODDS)].tolist()) for own, take in folds]
    found = sample.mapInArrow(vectoriser({f: i for i, f in enumerate(names)}, markers), "toxic boolean, fold int, places array<int>, density double").toArrow()
    toxic, fold = np.array(found["toxic"].to_pylist(), dtype=bool), np.array(found["fold"].to_pylist(), dtype=np.int64)
    own, density = found["places"].combine_chunks(), found["density"].to_numpy()
    lengths = np.diff(own.offsets.to_numpy())
    rows, columns = np.repeat(np.arange(len(toxic)), lengths), own.flatten().to_numpy().astype(np.int64)
    grade = np.where(toxic, 1 + (density > np.median(density[toxic])), 0)

    margins = np.zeros(len(toxic))
    for k in (0, 1):
        mine = fold[rows] == k
        use = mine & folds[k][1][columns]
        place = np.cumsum(fold == k) - 1
        w, t, _ = fit(len(names), place[rows[use]], columns[use], grade[fold == k])
        score = np.bincount(rows[~mine], (w * folds[k][1])[columns[~mine]], minlength=len(toxic))
        margins[fold != k] = (score - t)[fold != k]
    cut = best_cut(margins, toxic) if min(map(min, n.values())) else 0.0
    w, low, high = fit(len(names), rows, columns, grade)
    return Model(dict(zip(names, w.tolist(), strict=True)), (low + cut, max(high, low + cut + 0.1)))


def scorer(model: Model) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def score(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            above = [model.above(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            severity = [sum(p) for p in above]
            grade = [sum(x >= 0.5 for x in p) for p in above]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(severity, pa.float64()), pa.array([p[0] for p in above], pa.float64()), pa.array(grade, pa.int32()), pa.array([p[0] >= REJECT_FROM for p in above], pa.bool_())],
                names=[*batch.schema.names[:-1], "expected_severity", "p_toxic", "grade", "toxic"],
            )

    return score


def severity(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, expected_severity (0 to 2), p_toxic, grade (0, 1, 2) and toxic for every row of docs.

    toxic is P(grade > 0) >= 0.5. Null texts count as empty and, as texts without a known feature, get the model's base
    rate. Whole texts are scored, whatever their length; repeated rows are scored each; an empty table gives no rows. Without
    labels of both kinds nothing is toxic. Other columns are ignored, whatever they are called.
    """
    schema = "doc_id long, expected_severity double, p_toxic double, grade int, toxic boolean"
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(scorer(model), schema)


def drop_toxic(docs: DataFrame, model: Model) -> DataFrame:
    """docs without the toxic rows, in its own columns and order, in one pass without a shuffle."""
    names = docs.columns

    def keep(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches):
            texts = batch.column(names.index("text")).to_pylist()
            yield batch.filter(pa.array([model.above(t)[0] < REJECT_FROM for t in texts], pa.bool_()))

    return docs.mapInArrow(keep, docs.schema)
