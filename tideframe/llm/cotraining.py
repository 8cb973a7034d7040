"""Quality classifier by co-training.

Two views of a document, its text and its metadata, each have a logistic regression. Over several rounds each view
labels the documents that it is most sure of, out of all unlabelled ones, and both are trained again on what the other
has added. Then each view's scores are calibrated on labelled rows kept aside, and the calibrated log odds are added up
to score all documents. Models are trained in numpy on a bounded sample of labelled rows and on the rows exchanged;
features and scores are worked out where the rows are, and only vectors of features come to the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tideframe.llm.common import bound_batches, documents, stage

#: Labelled rows of each class that training may use.
LABELLED_ROWS = 2000
#: Rounds, and rows of each class that a view passes on in each.
ROUNDS, PER_ROUND = 4, 100
_SOURCE_CELLS, _LANG_CELLS = 32, 16
_TEXT_FEATURES = 13
_punct = re.compile(r"[!-/:-@\[-`{-~]")


def text_features(text: str | None) -> np.ndarray:
    """Shares of character kinds, word lengths, and repetition of words, pairs and lines; over the whole text."""
    text = text or ""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    n = max(1, len(raw))
    kinds = np.bincount(raw, minlength=256)
    words = text.split()
    k = max(1, len(words))
    lines = [x for x in text.split("\n") if x.strip()]
    pairs = set(zip(words, words[1:]))
    symbols = sum(kinds[ord(c)] for c in "#*$%&|<>=@^~")
    return np.array(
        [
            np.log1p(len(words)) / 5,
            (kinds[97:123].sum() + kinds[128:].sum()) / n,
            kinds[65:91].sum() / n * 2,
            kinds[48:58].sum() / n * 5,
            symbols / n * 5,
            kinds[33] / n * 10,
            (kinds[46] + kinds[44]) / n * 10,
            len(raw) / k / 10,
            len(set(words)) / k,
            len(pairs) / max(1, len(words) - 1),
            len(set(lines)) / max(1, len(lines)),
            max(map(len, words), default=0) / 50,
            np.log1p(k / max(1, len(lines))) / 5,
        ]
    )


def metadata_cells(source: str | None, lang: str | None, n_chars: int | None) -> tuple[float, float, float, float]:
    """Cells of hashed source and language, log of the recorded length, and whether there is none."""
    return float(zlib.crc32((source or "").encode()) % _SOURCE_CELLS), float(zlib.crc32((lang or "").encode()) % _LANG_CELLS), float(np.log1p(max(0, n_chars or 0)) / 10), float(n_chars is None)


def metadata_features(cells: np.ndarray) -> np.ndarray:
    """Rows of metadata_cells as indicators of source and language, the length, its square, and whether it is missing."""
    x = np.zeros((len(cells), _SOURCE_CELLS + _LANG_CELLS + 3))
    at = np.arange(len(cells))
    x[at, cells[:, 0].astype(int)] = 1
    x[at, _SOURCE_CELLS + cells[:, 1].astype(int)] = 1
    x[:, -3], x[:, -2], x[:, -1] = cells[:, 2], cells[:, 2] ** 2, cells[:, 3]
    return x


@dataclass
class Logistic:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    def log_odds(self, x: np.ndarray) -> np.ndarray:
        z = (x - self.mean) / self.scale
        return np.clip(z @ self.weights[:-1] + self.weights[-1], -30, 30)


def fit(x: np.ndarray, y: np.ndarray, sample_weight: np.ndarray | None = None, ridge: float = 1.0, steps: int = 25) -> Logistic:
    """Ridge logistic regression by damped Newton steps, classes weighted alike."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = np.hstack(((x - mean) / scale, np.ones((len(x), 1))))
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    weight = weight if sample_weight is None else weight * sample_weight
    b = np.zeros(z.shape[1])
    penalty = np.full(len(b), ridge)
    penalty[-1] = 1e-3

    def loss(b: np.ndarray) -> float:
        u = z @ b
        return float((weight * (np.logaddexp(0, u) - y * u)).sum() + 0.5 * (penalty * b * b).sum())

    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        gradient = z.T @ (weight * (p - y)) + penalty * b
        hessian = (z * (weight * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ z + np.diag(penalty)
        move, size = np.linalg.solve(hessian, gradient), 1.0
        while size > 1e-6 and loss(b - size * move) > loss(b):  # halved until it helps
            size /= 2
        b = b - size * move
        if np.abs(size * move).max() < 1e-6:
            break
    return Logistic(mean, scale, b)


@dataclass
class CoTrained:
    text: Logistic
    meta: Logistic
    #: (slope, shift) of each view's calibrated log odds
    calibration: tuple[tuple[float, float], tuple[float, float]]
    prior: float

    def score(self, text_x: np.ndarray, meta_x: np.ndarray) -> np.ndarray:
        """Probability of good quality: the views' log odds over the prior's, added up."""
        total = np.full(len(text_x), self.prior)
        for view, x, (slope, shift) in ((self.text, text_x, self.calibration[0]), (self.meta, meta_x, self.calibration[1])):
            total += slope * view.log_odds(x) + shift - self.prior
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def platt(log_odds: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> tuple[float, float]:
    """Slope (at least 0) and shift that turn log odds into those of y; weight: of each row.

    Held towards 1 and 0, and found by Newton steps that are halved until they help, so that classes which a view
    tells apart without error give finite values.
    """
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / ((y == 0).sum() + 2))
    own = np.ones(len(y)) if weight is None else weight

    def loss(a: float, b: float) -> float:
        z = a * log_odds + b
        return float((own * (np.logaddexp(0, z) - target * z)).sum() + 0.5 * ((a - 1) ** 2 + b**2))

    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * log_odds + b, -30, 30)))
        w = own * p * (1 - p)
        g = np.array([(own * (p - target) * log_odds).sum() + a - 1, (own * (p - target)).sum() + b])
        h = np.array([[(w * log_odds**2).sum() + 1, (w * log_odds).sum()], [(w * log_odds).sum(), w.sum() + 1]])
        move, size = np.linalg.solve(h, g), 1.0
        while size > 1e-6 and loss(a - size * move[0], b - size * move[1]) > loss(a, b):
            size /= 2
        a, b = a - size * move[0], b - size * move[1]
        if np.abs(size * move).max() < 1e-6:
            break
    return max(0.0, float(a)), float(b)


#: most_sure(teacher, model, label, taken) gives rows (id, text features, metadata features) of the unlabelled documents
#: that a teacher's model is most sure to have the label, without those taken before.
MostSure = Callable[[str, Logistic, int, list], list[tuple[object, np.ndarray, np.ndarray]]]


def co_train(text_x: np.ndarray, meta_x: np.ndarray, y: np.ndarray, most_sure: MostSure, rate: float, rounds: int = ROUNDS) -> CoTrained:
    """Every fourth labelled row is kept aside for calibration. Pseudo-labels count half as much as labels.

    rate: share of good ones among all labels; rows kept aside are weighted to it.
    """
    aside = np.arange(len(y)) % 4 == 3 if len(y) >= 16 else np.zeros(len(y), bool)
    own = {v: [x[~aside], y[~aside], np.ones((~aside).sum())] for v, x in (("text", text_x), ("meta", meta_x))}
    models, taken = {v: fit(*own[v]) for v in own}, []
    for _ in range(rounds):
        for teacher, learner in (("text", "meta"), ("meta", "text")):
            for label in (0, 1):
                best = most_sure(teacher, models[teacher], label, taken)
                if not best:
                    continue
                taken.extend(x[0] for x in best)
                rows = np.array([x[1 if learner == "text" else 2] for x in best])
                own[learner] = [np.vstack((own[learner][0], rows)), np.concatenate((own[learner][1], np.full(len(best), label))), np.concatenate((own[learner][2], np.full(len(best), 0.5)))]
        models = {v: fit(*own[v]) for v in own}
    at = aside if aside.any() and len(set(y[aside].tolist())) == 2 else np.ones(len(y), bool)
    sampled = y[at].mean()
    weight = np.where(y[at] == 1, rate / sampled, (1 - rate) / (1 - sampled))
    calibration = tuple(platt(models[v].log_odds(x[at]), y[at], weight) for v, x in (("text", text_x), ("meta", meta_x)))
    return CoTrained(models["text"], models["meta"], calibration, float(np.log(rate / (1 - rate))))


# In Spark -----------------------------------------------------------------------------------------------------------


def log_odds(view: str, model: Logistic, features: Column) -> Column:
    """A view's log odds as an expression over the features column (text features, then metadata cells)."""
    slopes = model.weights[:-1] / model.scale
    base = float(model.weights[-1] - (model.mean * slopes).sum())
    if view == "text":
        total = reduce(lambda a, b: a + b, (features[i] * float(w) for i, w in enumerate(slopes)), F.lit(base))
    else:
        cells = [features[_TEXT_FEATURES + i] for i in range(4)]
        pick = lambda w, cell: F.get(F.array(*(F.lit(float(x)) for x in w)), cell.cast("int"))
        total = F.lit(base) + pick(slopes[:_SOURCE_CELLS], cells[0]) + pick(slopes[_SOURCE_CELLS:-3], cells[1]) + cells[2] * float(slopes[-3]) + cells[2] * cells[2] * float(slopes[-2]) + cells[3] * float(slopes[-1])
    return F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))


def _vectors(features: list[float]) -> tuple[np.ndarray, np.ndarray]:
    x = np.array(features)
    return x[:_TEXT_FEATURES], metadata_features(x[None, _TEXT_FEATURES:])[0]


@F.pandas_udf(ArrayType(DoubleType()))
def _features(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for text, source, lang, n_chars in parts:
        yield pd.Series([[*text_features(t), *metadata_cells(s, g, None if pd.isna(n) else int(n))] for t, s, g, n in zip(text, source, lang, n_chars)], dtype=object)


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled_rows: int = LABELLED_ROWS, per_round: int = PER_ROUND, confident: float = 0.9, model: CoTrained | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", n_chars_col: str = "n_chars", quality_col: str = "quality") -> DataFrame:
    """Returns id, score (probability of good quality) and kept (score >= threshold), one row for each row.

    labels: id and quality 0 or 1; other values, nulls, and rows of one id with both values are not used. Null and
    empty texts get the features of an empty text; null metadata has cells of its own. Rows that repeat an id are
    scored each; where it is labelled, the row with the least features trains. Without labels of both classes all
    scores are 0.5. An empty table gives an empty result. Other columns are not read.
    """
    bound_batches(docs.sparkSession)
    found = stage(docs.select(F.col(id_col).alias("id"), _features(F.col(text_col), F.col(source_col), F.col(lang_col), F.col(n_chars_col).cast("long")).alias("x")), "features")
    if model is None:
        marks = labels.where(F.col(quality_col).isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min(quality_col).alias("quality"), F.max(quality_col).alias("other")).where("quality = other").select("id", "quality")
        counts = {r["quality"]: r["count"] for r in marks.groupBy("quality").count().collect()}
        if len(counts) == 2:
            # A bounded set of ids to look up, hence a broadcast of bounded size.
            both = stage(_picked(marks.where("quality = 0"), labelled_rows, counts[0]).unionByName(_picked(marks.where("quality = 1"), labelled_rows, counts[1])), "labelled")
            got = found.join(F.broadcast(both), "id").groupBy("id", "quality").agg(F.min("x").alias("x")).orderBy(F.xxhash64("id"), "id").collect()
            pairs = [_vectors(r["x"]) for r in got]
            y = np.array([r["quality"] for r in got], float)

            def most_sure(teacher: str, teaching: Logistic, label: int, taken: list) -> list[tuple[object, np.ndarray, np.ndarray]]:
                odds = log_odds(teacher, teaching, F.col("x"))
                sure = odds > float(np.log(confident / (1 - confident))) if label else odds < -float(np.log(confident / (1 - confident)))
                used = both.select("id")
                if taken:
                    used = used.unionByName(docs.sparkSession.createDataFrame([(i,) for i in taken], f"id {found.schema['id'].dataType.simpleString()}"))
                free = found.where(sure & F.col("id").isNotNull()).join(F.broadcast(used), "id", "left_anti")
                best = free.select("id", "x", odds.alias("odds")).orderBy(F.desc("odds") if label else F.asc("odds"), "id", "x").limit(per_round).collect()
                return [(r["id"], *_vectors(r["x"])) for r in best]

            if len(set(y.tolist())) == 2:
                model = co_train(np.array([a for a, _ in pairs]), np.array([b for _, b in pairs]), y, most_sure, (counts[1] + 1) / (counts[0] + counts[1] + 2))
    if model is None:
        score = F.lit(0.5)
    else:
        total = F.lit(model.prior)
        for view, own, (slope, shift) in (("text", model.text, model.calibration[0]), ("meta", model.meta, model.calibration[1])):
            total = total + log_odds(view, own, F.col("x")) * slope + F.lit(shift - model.prior)
        score = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), total))))
    return found.select(F.col("id").alias(id_col), score.alias("score")).select(id_col, "score", (F.col("score") >= threshold).alias("kept"))


def _picked(df: DataFrame, rows: int, total: int) -> DataFrame:
    share = F.pmod(F.xxhash64("id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(share < 1.2 * rows / max(1, total) + 50 / max(1, total)).orderBy(share, "id").limit(rows)


def op6_cotraining_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
