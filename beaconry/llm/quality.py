"""Quality classifier: naive Bayes support vectors.

n-gram indicators (words, word pairs, what stands between words, and runs of
three word shapes with the gaps between them) are scaled by the log-count ratios
of the two classes; a linear model of squared hinge loss over them is fitted by dual
coordinate descent and calibrated by Platt's method on out-of-fold margins.

Labels are learned only from rows whose crc32(doc_id as text) mod 5 is not 0,
at most ROWS of them; only texts are inputs of a score.

Defined results: a null or empty text has no n-grams and gets the model's
constant term as a score; without labels of both classes every score is the
label's mean (0.5 without any); a null doc_id counts as held out = null and is
scored; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm import linear
from beaconry.llm.common import whole

ROWS, FEATURES, THRESHOLD = 4_000, 1 << 16, 0.3


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 64-bit n-gram) of all n-grams."""
    from beaconry.llm.textvec import Words, mix

    w = Words(texts)
    h, doc, data = w.hash, w.doc, w.data
    if not len(h):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    upper = np.concatenate([[0], np.cumsum((data >= 65) & (data <= 90), dtype=np.int32)])
    lower = np.concatenate([[0], np.cumsum((data >= 97) & (data <= 122), dtype=np.int32)])
    digit = np.concatenate([[0], np.cumsum((data >= 48) & (data <= 57), dtype=np.int32)])
    s, e = w.start, w.end
    first = (data[s] >= 65) & (data[s] <= 90)
    ups, lows = upper[e] - upper[s], lower[e] - lower[s]
    shape = np.where(digit[e] > digit[s], 4, np.where(ups == 0, 0, np.where((ups == 1) & first & (lows > 0), 1, np.where((lows == 0) & (ups > 1), 2, 3)))).astype(np.uint64)
    pad = np.concatenate([data, np.zeros(4, np.uint8)]).astype(np.uint64)
    to = np.append(s[1:], len(data))
    width = np.minimum(to - e, 4)
    gap = width.astype(np.uint64)
    for k in range(3):
        gap = gap * np.uint64(257) + np.where(width > k, pad[e + k], np.uint64(256))
    same = np.zeros(len(h), np.uint64)
    same[1:] = (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])
    unit = (gap * np.uint64(5) + shape) * np.uint64(2) + same
    p = np.uint64(0x9E3779B97F4A7C15)
    out = [(doc, mix(h ^ np.uint64(1 << 60))), (doc, mix(gap + np.uint64(1 << 59)))]
    if len(h) > 1:
        two = doc[1:] == doc[:-1]
        out.append((doc[1:][two], mix(h[:-1] * p + h[1:])[two]))
    if len(h) > 2:
        three = doc[2:] == doc[:-2]
        out.append((doc[2:][three], mix((unit[:-2] * p + unit[1:-1]) * p + unit[2:])[three]))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


class Quality:
    """A fitted model."""

    def __init__(self, docs: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES):
        learn = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        s = linear.sample(docs, learn.select("doc_id", "quality"), ["quality"], "quality", ngrams, rows, features)
        y = s.labels[:, 0]
        self.table, self.link = s.table, linear.Link(s, y, np.zeros((len(y), 0)))

    def score(self):
        """A Column function: the score of a text."""
        table, link = self.table, self.link

        @F.pandas_udf("double")
        def quality(text: pd.Series) -> pd.Series:
            return pd.Series(linear.scores(text.tolist(), ngrams, table, [link])[:, 0])

        return quality


def classify(docs: DataFrame, labels: DataFrame, rows: int = ROWS, features: int = FEATURES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted of every row (see the module's text)."""
    score = Quality(docs, labels, rows, features).score()
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    out = docs.select("doc_id", held.alias("held_out"), score(whole()).alias("score"))
    return out.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
