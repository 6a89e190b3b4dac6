"""Toxicity by a classifier chain.

Categories are predicted one after another. Each link is a linear model over
word and word-beginning indicators, scaled by naive Bayes ratios, whose inputs
also hold the probabilities of all earlier categories; in training those are
out-of-fold predictions, so a later link never sees what an earlier one has
memorised. The last link is the label `toxic` itself.

`labels` has only the label toxic, so the categories before it are weak labels:
of the toxic rows, those whose text has a word of the category's seed list, and
`other` where no list matches. Lists are a parameter; word beginnings (4 to 6
bytes) carry what is learned over to inflected and invented forms.

Defined results: a null or empty text has no words and gets the model's constant
term; without labels of both classes a link gives the label's mean (0.5 without
any); an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from beaconry.llm import linear
from beaconry.llm.common import whole

ROWS, FEATURES, THRESHOLD = 8_000, 1 << 15, 0.5
CATEGORIES = {
    "insult": ("idiot", "moron", "loser", "clown", "scum"),
    "contempt": ("stupid", "worthless", "pathetic", "disgusting", "trash"),
}


def ngrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(text's number, 64-bit hash) of the lower-cased words and of their first 4, 5 and 6 bytes."""
    from beaconry.llm.textvec import Words, mix

    w = Words([t.lower() for t in texts])
    data = np.concatenate([w.data, np.zeros(8, np.uint8)]).astype(np.uint64)
    out = [(w.doc, w.hash)]
    head = np.zeros(len(w.start), np.uint64)
    for k in range(6):
        head = head * np.uint64(257) + data[w.start + k]
        if k >= 3:
            ok = w.end - w.start > k
            out.append((w.doc[ok], mix(head[ok] + np.uint64((k + 1) << 58))))
    return np.concatenate([x[0] for x in out]), np.concatenate([x[1] for x in out])


class Chain:
    """A fitted chain; names are its categories in order, the last one is `toxic`."""

    def __init__(self, docs: DataFrame, labels: DataFrame, categories: dict[str, tuple[str, ...]] | None = None, rows: int = ROWS, features: int = FEATURES):
        categories = CATEGORIES if categories is None else categories
        s = linear.sample(docs, labels.select("doc_id", "toxic"), ["toxic"], "toxic", ngrams, rows, features)
        toxic = s.labels[:, 0]
        number = {int(h): i for i, h in enumerate(s.hashes)}
        seen = np.zeros(len(toxic), bool)
        targets = {}
        for name, words in categories.items():
            own = {number.get(int(h & linear.LOW), -1) for h in _word_hashes(words)} - {-1}
            has = np.array([bool(own.intersection(x.tolist())) for x in s.rows], bool).reshape(-1)
            targets[name] = toxic * has
            seen |= has
        targets["other"] = toxic * ~seen
        targets["toxic"] = toxic
        self.table, self.names, self.links = s.table, list(targets), []
        dense = np.zeros((len(toxic), 0))
        for y in targets.values():
            link = linear.Link(s, y, dense)
            self.links.append(link)
            dense = np.column_stack([dense, link.out_of_fold])

    def score(self):
        """A Column function: a struct of each category's probability."""
        table, links, names = self.table, self.links, self.names

        @F.pandas_udf(", ".join(f"{x} double" for x in names))
        def chain(text: pd.Series) -> pd.DataFrame:
            return pd.DataFrame(linear.scores(text.tolist(), ngrams, table, links), columns=names)

        return chain


def _word_hashes(words: tuple[str, ...]) -> np.ndarray:
    from beaconry.llm.textvec import Words

    return Words(list(words)).hash


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """doc_id, p_<category> of each category, is_toxic of every row (see the module's text)."""
    chain = Chain(docs, labels, **how)
    out = docs.select("doc_id", chain.score()(whole()).alias("p"))
    return out.select("doc_id", *(F.col(f"p.{x}").alias(f"p_{x}") for x in chain.names), (F.col("p.toxic") >= threshold).alias("is_toxic"))


def clean(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **how) -> DataFrame:
    """The rows of docs, all columns, that the chain doesn't call toxic."""
    score = Chain(docs, labels, **how).score()
    return docs.filter(score(whole())["toxic"] < threshold)
