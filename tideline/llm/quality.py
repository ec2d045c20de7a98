"""Quality classifier learned from positives and unlabelled text.

A linear scorer is fitted by the non-negative unbiased risk (Kiryo et al., 2017)

    R(g) = prior * E_pos[l(g)] + max(0, E_web[l(-g)] - prior * E_pos[l(-g)])

with the logistic loss l: trusted positives, unlabelled web text, and the share of positives
in that text as class prior. When the part in max() falls below zero, the step goes against
its gradient, as the method has it, so that the scorer does not fit the positives by heart.

What a text looks like is a vector of shares: of its bytes, of hashed pairs of neighbouring
bytes, of signs and of repeated words, and a few of its lengths. Whole texts are read. Labels,
language, source and id are never inputs. The model is fitted on the driver from a bounded
sample (``SAMPLE_ROWS`` positives and as many unlabelled texts, of smallest hash); scoring is a
map over the documents without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.ngram_join import word_hashes
from tideline.llm.registry import named, query, table

#: Bound of the positives, and of the unlabelled texts, that the model is fitted on.
SAMPLE_ROWS = 8_000
PAIRS = 256
EXTRA = 10
FEATURES = 256 + PAIRS + EXTRA
#: Bytes by which a text counts as longer, so that shares of short texts stay calm.
CALM = 100
#: Rows that are worked on at a time on the driver.
ROW_BLOCK = 1_024
STEPS, RATE, DECAY = 600, 0.05, 1e-2
#: With fewer positives than this the weights are held back more, down to the prior alone.
FEW = 400


def describe(text: str | None) -> np.ndarray:
    """The feature vector of a whole text; null and empty texts give zeros."""
    out = np.zeros(FEATURES, dtype=np.float32)
    data = np.frombuffer((text or "").encode("utf-8", "replace"), dtype=np.uint8)
    n = len(data)
    if not n:
        return out
    counts = np.zeros(256)
    pairs = np.zeros(PAIRS)
    # In pieces, so that a very long text needs little memory beyond itself.
    for at in range(0, n, 1 << 20):
        part = data[at : at + (1 << 20) + 1]
        counts += np.bincount(part[: 1 << 20], minlength=256)
        wide = part.astype(np.uint16)
        pairs += np.bincount((wide[:-1] * 151 + wide[1:] * 7) & (PAIRS - 1), minlength=PAIRS)
    out[:256] = np.sqrt(counts / (n + CALM))
    out[256 : 256 + PAIRS] = np.sqrt(pairs / (n + CALM))
    signs = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum()
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[128:].sum()
    words = word_hashes(data.tobytes())
    number = len(words) + 10
    again = (words[1:] == words[:-1]).sum()
    apart = len(np.unique(words))
    out[-EXTRA:] = (
        np.log1p(n) / 10,
        np.log1p(len(words)) / 10,
        np.log1p(n / number) / 3,
        signs / (n + CALM),
        np.sqrt(signs / number),
        counts[65:91].sum() / (letters + CALM),
        (counts > 0).sum() / 100,
        # Words that repeat the one before, and words met before in the text.
        np.sqrt(again / number),
        (len(words) - apart) / number,
        np.sqrt((counts[33] + counts[124] + counts[35] + counts[36] + counts[42]) / number),
    )
    return out


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float
    mean: np.ndarray
    scale: np.ndarray
    prior: float

    def score(self, features: np.ndarray) -> np.ndarray:
        margin = ((features - self.mean) / self.scale) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(margin, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _parts(x: np.ndarray) -> Iterator[np.ndarray]:
    for at in range(0, len(x), ROW_BLOCK):
        yield x[at : at + ROW_BLOCK]


def _sum(x: np.ndarray, centre: np.ndarray | None = None) -> np.ndarray:
    """Column sums, of squared distances from ``centre`` if given, a block of rows at a time."""
    out = np.zeros(FEATURES)
    for part in _parts(x):
        out += part.sum(axis=0, dtype=float) if centre is None else ((part - centre) ** 2).sum(axis=0)
    return out


def _scaled(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    """``x`` in units of ``scale``; 32-bit arrays are changed in place."""
    out = x if x.dtype == np.float32 else x.astype(np.float32)
    for part in _parts(out):
        part -= mean.astype(np.float32)
        part /= scale.astype(np.float32)
    return out


def _margins(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The last entry of ``w`` is the bias, which has no column in ``x``."""
    return (x @ w[:-1].astype(np.float32)).astype(float) + w[-1]


def _weighted(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Sums of the columns, and of a column of ones, by ``weights``."""
    out = np.zeros(FEATURES + 1)
    for at in range(0, len(x), ROW_BLOCK):
        part = weights[at : at + ROW_BLOCK]
        out[:-1] += part.astype(np.float32) @ x[at : at + ROW_BLOCK]
    out[-1] = weights.sum()
    return out


def fit_nnpu(
    positives: np.ndarray,
    web: np.ndarray,
    prior: float,
    steps: int = STEPS,
    rate: float = RATE,
    decay: float = DECAY,
) -> Model:
    """Minimise the non-negative risk by Adam over whole gradients. Without positives or web
    text every score is the prior. 32-bit inputs are scaled in place, so they are held once."""
    rows = len(positives) + len(web)
    mean, scale = np.zeros(FEATURES), np.ones(FEATURES)
    if rows:
        mean = (_sum(positives) + _sum(web)) / rows
        scale = np.sqrt((_sum(positives, mean) + _sum(web, mean)) / rows) + 1e-3
    if not len(positives) or not len(web):
        odds = np.log(prior / (1 - prior)) if 0 < prior < 1 else 30.0 * (2 * prior - 1)
        return Model(np.zeros(FEATURES), float(odds), mean, scale, prior)
    p, u = _scaled(positives, mean, scale), _scaled(web, mean, scale)
    decay *= max(1.0, FEW / len(positives))
    w = np.zeros(FEATURES + 1)
    first, second = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, steps + 1):
        gp, gu = _margins(p, w), _margins(u, w)
        # Derivatives of the logistic loss: l'(g) = -s(-g) for label 1, s(g) for label 0.
        down = -(prior / len(p)) * _weighted(_sigmoid(-gp), p)
        rest = _weighted(_sigmoid(gu), u) / len(u) - (prior / len(p)) * _weighted(_sigmoid(gp), p)
        negative_risk = np.logaddexp(0, gu).mean() - prior * np.logaddexp(0, gp).mean()
        grad = down + rest if negative_risk >= 0 else -rest
        grad = grad + decay * np.append(w[:-1], 0.0)  # the bias is free to follow the prior
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        # Smaller steps towards the end, so that turning back does not decide the result.
        slow = rate * (1 - (t - 1) / steps)
        w = w - slow * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Model(w[:-1], float(w[-1]), mean, scale, prior)


def _described(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        packed = [describe(t).astype("<f4").tobytes() for t in batch["text"]]
        yield pd.DataFrame({"id": batch["id"], "at": batch["at"], "features": packed})


def held_out(id_text: Column) -> Column:
    """Whether labels of the document must not be learned from."""
    return F.coalesce(F.crc32(id_text.cast("binary")) % 3 == 1, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit from the labels that may be learned from; see the module for the bound.

    The class prior is the share of positives among those labels (they cover a random part of
    the documents); without labels it is 1/2. Rows with null ids or labels are not used.
    """
    ids = labels.filter(named(id_col).isNotNull() & named(label_col).isNotNull()).select(
        named(id_col).cast("string").alias("id"), named(label_col).alias("label")
    )
    open_to = ids.filter(~held_out(F.col("id")))
    share = open_to.agg(F.avg((F.col("label") == 1).cast("double"))).first()[0]
    prior = 0.5 if share is None else min(max(float(share), 0.01), 0.99)
    by_hash = [F.xxhash64("id"), F.col("id")]
    trusted = open_to.filter("label = 1").select("id").distinct().orderBy(*by_hash).limit(sample_rows)
    known = docs.select(named(id_col).cast("string").alias("id"))
    web = (
        known.filter(F.col("id").isNotNull() & ~held_out(F.col("id")))
        .distinct()
        .orderBy(F.xxhash64("id", F.lit(1)), "id")
        .limit(sample_rows)
    )
    texts = docs.select(
        named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("text")
    )

    def vectors(chosen: DataFrame) -> np.ndarray:
        # At most ``sample_rows`` ids: a bounded side to broadcast. Of rows with one id the text
        # of smallest hash is taken, so there is one vector per id.
        rows = texts.join(F.broadcast(chosen), "id", "left_semi").select("id", F.xxhash64("text").alias("at"), "text")
        described = rows.mapInPandas(_described, "id string, at long, features binary")
        one = described.groupBy("id").agg(F.min_by("features", F.struct("at", "features")).alias("features"))
        packed = one.orderBy("id").select("features").toArrow().column("features")
        out = np.zeros((len(packed), FEATURES), dtype=np.float32)
        for i, row in enumerate(packed):
            out[i] = np.frombuffer(row.as_buffer(), dtype="<f4")
        return out

    return fit_nnpu(vectors(trusted), vectors(web), prior)


def _scorer(model: Model):
    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = batch.pop("_text")
            out = np.zeros(len(texts))
            for at in range(0, len(texts), 512):
                part = np.vstack([describe(t) for t in texts.iloc[at : at + 512]])
                out[at : at + 512] = model.score(part.astype(float))
            yield batch.assign(score=out)

    return scored


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` (as text) and ``score`` (0 to 1) of each row; empty and null texts get a score too."""
    slim = docs.select(
        named(id_col).cast("string").alias("id"), named(text_col).cast("string").alias("_text")
    )
    return slim.mapInPandas(_scorer(model), "id string, score double")


def keep_good(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = 0.5,
) -> DataFrame:
    """Rows of ``docs`` that score ``least`` or more, columns as they were.

    The score is computed beside the row, without a join.
    """
    model = train(docs, labels, id_col, text_col)

    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            out = np.zeros(len(texts))
            for at in range(0, len(texts), 512):
                part = np.vstack([describe(t) for t in texts.iloc[at : at + 512]])
                out[at : at + 512] = model.score(part.astype(float))
            yield pd.Series(out)

    scorer = F.pandas_udf(scored, "double")
    return docs.filter(scorer(named(text_col).cast("string")) >= least)


@query("op7_quality_classifier")
def op7_quality_classifier(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = train(docs, table(spark, sf_dir, "labels"))
    scored = score(docs, model)
    return scored.select(
        F.col("id").cast("long").alias("doc_id"),
        held_out(F.col("id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"),
    )
