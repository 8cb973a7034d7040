"""Language identification by a byte convolutional network.

Filters of several widths run over the bytes of fixed-length windows; each filter's largest response in a window feeds
a softmax over languages. The network is trained in numpy on a bounded sample of labelled rows. A text is cut into
windows over its whole length, and its prediction is the mean of its windows' log probabilities.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideframe.llm.common import bound_batches, documents

WINDOW = 256
WIDTHS = (2, 3, 4)
FILTERS = 8
#: Labelled rows of each language that training may use, of all languages together (at least one each), and passages of
#: each such row, spread evenly over its whole text.
SAMPLE_ROWS, ALL_ROWS, SAMPLE_WINDOWS = 500, 20_000, 16
UNKNOWN = "und"
_has_letter = regex.compile(r"\p{L}").search


@dataclass
class Network:
    languages: list[str]
    filters: dict[int, np.ndarray]  # width -> (width, 256, filters)
    bias: np.ndarray
    weights: np.ndarray
    offset: np.ndarray

    def pair_tables(self) -> list[tuple[int, np.ndarray, np.ndarray | None]]:
        """For each width, responses of its first two bytes as one table, and of the rest."""
        out = []
        for width, f in sorted(self.filters.items()):
            first = (f[0][:, None, :] + f[1][None, :, :]).reshape(65536, -1).astype(np.float32)
            rest = None if width == 2 else f[2].astype(np.float32) if width == 3 else (f[2][:, None, :] + f[3][None, :, :]).reshape(65536, -1).astype(np.float32)
            out.append((width, first, rest))
        return out


def windows_of(text: bytes, window: int = WINDOW) -> np.ndarray:
    """(windows, window) of bytes; the last one is moved back so that it is full, a short text is padded with spaces."""
    x = np.frombuffer(text, np.uint8)
    if len(x) <= window:
        return np.concatenate((x, np.full(window - len(x), 32, np.uint8)))[None, :]
    full = len(x) // window
    out = x[: full * window].reshape(full, window)
    return out if full * window == len(x) else np.concatenate((out, x[None, -window:]))


def responses(tables: list, x: np.ndarray) -> np.ndarray:
    """Largest response of each filter in each window, (windows, widths * filters)."""
    n, length = x.shape
    pairs = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
    out = []
    for width, first, rest in tables:
        at = length - width + 1
        r = first.take(pairs[:, :at].ravel(), axis=0)
        if width == 3:
            r += rest.take(x[:, 2:].ravel(), axis=0)
        elif width == 4:
            r += rest.take(pairs[:, 2 : 2 + at].ravel(), axis=0)
        out.append(r.reshape(n, at, -1).max(axis=1))
    return np.concatenate(out, axis=1)


def log_probabilities(net: Network, tables: list, x: np.ndarray) -> np.ndarray:
    h = np.maximum(responses(tables, x) + net.bias, 0)
    z = h @ net.weights + net.offset
    z -= z.max(axis=1, keepdims=True)
    return z - np.log(np.exp(z).sum(axis=1, keepdims=True))


def train(texts: list[list[bytes]], labels: list[str], filters: int = FILTERS, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 7) -> Network:
    """Adam on cross-entropy. Gradients of the filters flow to the place of each filter's largest response only.

    texts: passages of each text.
    """
    rng = np.random.default_rng(seed)
    languages = sorted(set(labels))
    xs, ys = [], []
    for passages, label in zip(texts, labels):
        w = np.concatenate([windows_of(x) for x in passages])
        xs.append(w)
        ys.extend([languages.index(label)] * len(w))
    x, y = np.concatenate(xs), np.array(ys)
    by_class = [np.flatnonzero(y == k) for k in range(len(languages))]
    n_h = filters * len(WIDTHS)
    net = Network(languages, {w: rng.normal(0, 0.3, (w, 256, filters)) for w in WIDTHS}, np.zeros(n_h), rng.normal(0, 0.1, (n_h, len(languages))), np.zeros(len(languages)))
    params = [*(net.filters[w] for w in WIDTHS), net.bias, net.weights, net.offset]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(c, max(1, batch // len(languages))) for c in by_class])
        xb, yb, n = x[pick], y[pick], len(pick)
        tops, places = [], []
        for w in WIDTHS:
            f = net.filters[w]
            r = sum(f[j][xb[:, j : WINDOW - w + 1 + j]] for j in range(w))
            places.append(r.argmax(axis=1))
            tops.append(r.max(axis=1))
        pre = np.concatenate(tops, axis=1) + net.bias
        h = np.maximum(pre, 0)
        z = h @ net.weights + net.offset
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(n), yb] -= 1
        p /= n
        back = (p @ net.weights.T) * (pre > 0)
        grads = []
        for i, w in enumerate(WIDTHS):
            g = np.zeros_like(net.filters[w])
            part = back[:, i * filters : (i + 1) * filters]
            for j in range(w):
                np.add.at(g[j], (xb[np.arange(n)[:, None], places[i] + j], np.arange(filters)[None, :]), part)
            grads.append(g)
        grads += [back.sum(axis=0), h.T @ p + 1e-4 * net.weights, p.sum(axis=0)]
        lr = rate * (1 - step / (steps + 1))
        for k, (q, g) in enumerate(zip(params, grads)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.999 * v[k] + 0.001 * g * g
            q -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    return net


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(4)) == 2, F.lit(False))


def passages(text: Column, many: int = SAMPLE_WINDOWS, size: int = WINDOW) -> Column:
    """Up to `many` passages of `size` characters, spread evenly from the begin of a text to its end."""
    n = F.length(text)
    count = F.least(F.lit(many), F.ceil(n / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), lambda i: F.substring(text, F.floor(i * F.greatest(n - size, F.lit(0)) / F.greatest(count - 1, F.lit(1))).cast("int") + 1, F.lit(size)))


def sample_labelled(docs: DataFrame, rows: int, id_col: str, text_col: str, lang_col: str) -> tuple[list[list[bytes]], list[str]]:
    """Passages of up to `rows` distinct labelled rows of each language, picked by a hash of id and text, outside the held-out
    part. All languages are learned; their counts are small against the rows."""
    labelled = docs.where(~held_out(id_col) & F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    counts = labelled.groupBy("lang").agg(F.count("*").alias("n"))  # one row a language
    languages = counts.count()
    if not languages:
        return [], []
    rows = max(1, min(rows, ALL_ROWS // languages))
    # Equal rows count once, and an id that repeats with other texts is so many rows.
    at = F.xxhash64("id", "text")
    share = F.pmod(at, F.lit(1 << 30)) / F.lit(float(1 << 30))
    likely = labelled.withColumn("at", at).join(F.broadcast(counts), "lang").where(share < 1.3 * rows / F.col("n") + 20 / F.col("n"))
    distinct = likely.select("lang", "at", passages(F.col("text")).alias("passages")).dropDuplicates(["lang", "at"])
    place = F.row_number().over(Window.partitionBy("lang").orderBy("at"))
    picked = distinct.withColumn("place", place).where(F.col("place") <= rows).orderBy("lang", "place").select("lang", "passages").collect()
    return [[x.encode("utf-8", "surrogatepass") for x in r["passages"]] for r in picked], [r["lang"] for r in picked]


def predict(net: Network | None, tables: list, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Language and score of each text, over all its windows."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    seen = [i for i, t in enumerate(texts) if net and t and _has_letter(t)]
    if not seen:
        return names, scores
    total, n = np.zeros((len(texts), len(net.languages))), np.zeros(len(texts))
    held: list[np.ndarray] = []
    own: list[int] = []

    def flush() -> None:
        if held:
            np.add.at(total, own, log_probabilities(net, tables, np.concatenate(held)))
            np.add.at(n, own, 1)
            held.clear()
            own.clear()

    for i in seen:
        w = windows_of(texts[i].encode("utf-8", "surrogatepass"))
        for begin in range(0, len(w), 1024):  # a very long text goes in parts
            held.append(w[begin : begin + 1024])
            own.extend([i] * len(held[-1]))
            if len(own) >= 1024:
                flush()
    flush()
    for i in seen:
        p = np.exp(total[i] / n[i])
        p /= p.sum()
        names[i], scores[i] = net.languages[int(p.argmax())], float(p.max())
    return names, scores


def with_language(docs: DataFrame, net: Network | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", to: str = "_language") -> DataFrame:
    """docs with a struct column `to` of lang_pred and score.

    Learns from rows with a language whose crc32(id as text) mod 4 is not 2 (unless net is given); predictions use
    the text alone. Training uses passages from all over up to `rows` rows of each language; predictions use whole texts.
    The column `to` is replaced where docs has one; all others pass.
    """
    bound_batches(docs.sparkSession)
    if net is None:
        texts, labels = sample_labelled(docs, rows, id_col, text_col, lang_col)
        net = train(texts, labels) if texts else None
    shared = docs.sparkSession.sparkContext.broadcast(net)

    @F.pandas_udf("lang_pred string, score double")
    def language(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        net = shared.value
        tables = net.pair_tables() if net else []
        for part in parts:
            names, scores = predict(net, tables, part.tolist())
            yield pd.DataFrame({"lang_pred": names, "score": scores})

    return docs.withColumn(to, language(F.col(text_col)))


def identify(docs: DataFrame, net: Network | None = None, rows: int = SAMPLE_ROWS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Returns id, held_out, lang_pred and score, one row for each row; see with_language().

    Null texts and texts without a letter are `und` with score 0; without labelled rows all texts are. Rows that
    repeat an id are predicted each. A null id is not held out. An empty table gives an empty result. Other columns
    are not read.
    """
    narrow = docs.select(id_col, text_col, lang_col)
    found = with_language(narrow, net, rows, id_col, text_col, lang_col)
    return found.select(F.col(id_col), held_out(id_col).alias("held_out"), F.col("_language.lang_pred").alias("lang_pred"), F.col("_language.score").alias("score"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))
