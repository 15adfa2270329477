"""Toxicity by compression distance.

A text is cut at spaces into windows, and each window is compressed with two pairs of dictionaries:

* trained: a zstandard dictionary trained on all windows of the toxic sample, against one trained on as
  many windows of ordinary text, both behind the same dictionary of ordinary text;
* excess: that ordinary dictionary followed by strings of toxic rows, against the same without them. The
  strings are not trained by zstandard: they are word n-grams that many toxic rows and (nearly) no
  ordinary rows hold, chosen greedily until each toxic row is covered several times.

The largest savings of the toxic side of each pair, the mean saving of the trained pair and the number of windows
are turned into a score by a logistic function, so 0.5 is the calibrated threshold. It is fitted on the same
rows, but their trained savings come from dictionaries trained without them (``FOLDS``).

The fit uses a bounded sample (``FIT_TOXIC`` and ``FIT_ORDINARY`` rows in the order of a hash of the
id, texts of at most ``FIT_CHARS`` characters) of the rows not held out; every text is scored whole.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_TOXIC, FIT_ORDINARY, FIT_CHARS = 1200, 3000, 8000
WINDOW = 48           # bytes; a window ends at the next space
LEVEL = 5
DICT_BYTES = 64 * 1024
GRAMS = range(4, 11)  # lengths of the strings looked for
TRAINED_BYTES = 32 * 1024
FOLDS = 3
COVER = 6             # strings wanted in each toxic row
MIN_SHARE = 0.035     # a string must be new evidence for this share of the toxic rows
ORDINARY_SHARE = 0.0005


def windows(text: str) -> list[bytes]:
    data, out, at = text.lower().encode(), [], 0
    while at < len(data):
        end = at + WINDOW
        if end < len(data):
            space = data.find(b" ", end)
            end = min(len(data) if space < 0 else space, at + 4 * WINDOW)
        out.append(data[at:end])
        at = end
    return out


def _strings(text: str) -> set[str]:
    out = set()
    for word in {w.strip(".,!?;:\"'()|") for w in text.lower().split()}:
        if 4 <= len(word) <= 40:
            word = f" {word} "
            for n in GRAMS:
                out.update(word[i:i + n] for i in range(len(word) - n + 1))
    return out


def toxic_strings(toxic: list[str], ordinary: list[str]) -> list[str]:
    """Strings that mark the toxic texts, most telling first."""
    held = defaultdict(set)
    for i, text in enumerate(toxic):
        for g in _strings(text):
            held[g].add(i)
    least = max(3, int(MIN_SHARE * len(toxic)))
    held = {g: rows for g, rows in held.items() if len(rows) >= least}
    common = Counter()
    for text in ordinary:
        common.update(_strings(text) & held.keys())
    held = {g: rows for g, rows in held.items() if common[g] <= ORDINARY_SHARE * len(ordinary)}
    need, chosen = np.full(len(toxic), COVER), []
    index = {g: np.fromiter(rows, dtype=np.int64) for g, rows in held.items()}
    while index:
        best = max(sorted(index), key=lambda g: (int((need[index[g]] > 0).sum()), len(g)))
        if (need[index[best]] > 0).sum() < least:
            break
        chosen.append(best)
        need[index[best]] -= 1
        near = [g for g in index if g in best or best in g or any(g[:n] == best[-n:] or best[:n] == g[-n:] for n in range(4, 11))]
        for g in near:
            del index[g]
    return chosen


def _trained(samples: list[bytes], size: int) -> bytes:
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()[-size:]
    except zstandard.ZstdError:  # too few samples to train on: the samples themselves
        return b" ".join(samples)[-size:]


def _shuffled_windows(texts: list[str]) -> list[bytes]:
    cut = sorted({w for t in texts for w in windows(t)})
    np.random.default_rng(10).shuffle(cut)
    return cut


def _compressor(dictionary: bytes):
    params = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, source_size=WINDOW, dict_size=len(dictionary), write_content_size=False, write_checksum=False, write_dict_id=False)
    c = zstandard.ZstdCompressor(compression_params=params, dict_data=zstandard.ZstdCompressionDict(
        dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT))
    c.compress(b"")
    return c


class Pair:
    """An ordinary and a toxic dictionary; small enough to travel with the tasks."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.ordinary, self.toxic = ordinary or b" " * 8, toxic or b" " * 8

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_both"}

    def savings(self, cut: list[bytes]) -> list[int]:
        """Bytes that the toxic dictionary saves on each window."""
        if "_both" not in self.__dict__:
            self._both = _compressor(self.ordinary), _compressor(self.toxic)
        a, b = self._both
        return [len(a.compress(w)) - len(b.compress(w)) for w in cut]


def trained_pair(toxic: list[str], ordinary: list[str]) -> Pair:
    """Dictionaries of all toxic windows and of as many ordinary ones, the other ordinary ones before both."""
    yes, no = _shuffled_windows(toxic), _shuffled_windows(ordinary)
    n = min(len(yes), len(no) // 2)
    base = _trained(no[n:], DICT_BYTES)
    return Pair(base + _trained(no[:n], TRAINED_BYTES), base + _trained(yes, TRAINED_BYTES))


def _largest(savings: list[int]) -> list[float]:
    best = sorted(savings, reverse=True)[:3]
    return [float(v) for v in best] + [0.0] * (3 - len(best))


class Model:
    """Dictionaries and logistic weights; small enough to travel with the tasks."""

    def __init__(self, toxic: list[str], ordinary: list[str], share: float | None = None):
        base = _trained(_shuffled_windows(ordinary), DICT_BYTES) or b" " * 8
        marks = "".join(reversed(toxic_strings(toxic, ordinary))).encode()
        self.excess = Pair(base + b" " * len(marks), base + marks)
        x, y = [], []
        for k in range(FOLDS):
            apart = trained_pair([t for i, t in enumerate(toxic) if i % FOLDS != k], [t for i, t in enumerate(ordinary) if i % FOLDS != k])
            x += [self.features(t, apart) for t in [*toxic[k::FOLDS], *ordinary[k::FOLDS]]]
            y += [1.0] * len(toxic[k::FOLDS]) + [0.0] * len(ordinary[k::FOLDS])
        self.trained = trained_pair(toxic, ordinary)
        x, y = np.array(x or [self.features("", self.trained)]), np.array(y or [0.0])
        # rows are weighted to the share of toxic labels in the whole table, not in the sample
        share = len(toxic) / max(1, len(y)) if share is None else share
        weight = np.where(y == 1, share * len(y) / max(1, len(toxic)), (1 - share) * len(y) / max(1, len(ordinary)))
        x = np.column_stack([np.ones(len(x)), x])
        self.weights = np.zeros(x.shape[1])
        for _ in range(30):  # Newton steps with a ridge, so separable data stay finite
            p = 1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))
            step = x.T @ (weight * (y - p)) - 0.1 * self.weights
            self.weights += np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(step)), step)

    def features(self, text: str, trained: Pair) -> list[float]:
        """The three largest savings of each pair, the mean saving of the trained one, the log of the number of windows."""
        cut = windows(text)
        told = trained.savings(cut)
        return [*_largest(self.excess.savings(cut)), *_largest(told), sum(told) / max(1, len(cut)), float(np.log(max(1, len(cut))))]

    def score(self, text: str) -> float:
        z = self.weights[0] + float(np.dot(self.weights[1:], self.features(text, self.trained)))
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def held_out(doc_id):
    return F.crc32(doc_id.cast("string")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic") -> Model:
    """Model from a bounded sample of labelled rows that are not held out. A label given twice counts
    as toxic if either says so; rows without text, id or label teach nothing."""
    marks = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    marks = marks.groupBy(F.col(doc_id).alias("id")).agg(F.max(label).alias("y"))
    share = marks.agg(F.avg((F.col("y") == 1).cast("int"))).first()[0]
    sample = marks.where("y = 1").orderBy(F.xxhash64("id"), "id").limit(FIT_TOXIC).unionByName(
        marks.where("y = 0").orderBy(F.xxhash64("id"), "id").limit(FIT_ORDINARY))
    rows = docs.where(F.length(F.col(text)).between(1, FIT_CHARS)).select(F.col(doc_id).alias("id"), F.col(text).alias("body"))
    got = rows.join(F.broadcast(sample), "id").dropDuplicates(["id"]).orderBy("id").collect()  # the bounded sample
    toxic = sorted({r["body"] for r in got if r["y"] == 1})
    return Model(toxic, sorted({r["body"] for r in got if r["y"] == 0} - set(toxic)), share)


def score(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, held_out, score (0 to 1), predicted (1 from 0.5).

    Null text counts as empty; an empty text has no window and gets the score of no saving. Equal
    texts get equal scores. A null id is not held out. Columns other than the text are no inputs.
    """
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))

    def apply(batches):
        for batch in batches:
            yield pd.DataFrame({"doc_id": batch["doc_id"], "score": [model.score(t) for t in batch["body"]]})

    out = rows.mapInPandas(apply, f"doc_id {kind}, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                      (F.col("score") >= 0.5).cast("int").alias("predicted"))
