"""Language identification: averaged hashed subword embeddings with a linear softmax, trained by stochastic gradient descent.

Subwords are runs of 1 to 4 code points of the lower-cased text, edges of words included, hashed into BUCKETS rows of a table of
embeddings. A document is the mean of its subwords' embeddings; a linear layer and a softmax give the languages' probabilities. Both
layers are learned together in numpy, from a bounded sample of labelled documents (SAMPLE rows of each language, those with the least hash of their id, a
documented parameter, so that rare languages are learned at every size). A temperature fitted on a part of the sample that training never sees calibrates the score, and the lowest score that still is
right as often as RELIABLE there is the rejection threshold. For prediction the two layers are multiplied into one table, since a mean commutes with
a linear map. The model's size does not depend on the input.

A text that is null or has no letter is `und` with score 0. Whole texts are read, in slices of bounded length. Rows with a null lang are never learned
from. Without any labelled row every document is `und`. Equal rows and rows that repeat an id are predicted each for itself; an empty table gives an empty result; extra columns are
neither read nor returned.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_batch

BUCKETS, DIMS, ORDERS = 1 << 15, 16, (1, 2, 3, 4)
SAMPLE, EPOCHS, RATE, RELIABLE, SEED = 750, 6, 0.5, 0.99, 17
#: Code points handled at once.
SLICE = 200_000
UNKNOWN = "und"


def _codes(text: str) -> np.ndarray:
    """The code points of a (lower-cased) text's letters; what stands between them is one zero."""
    x = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    x = np.where(_letters(x), x, 0)
    return x[np.append(True, (x[1:] != 0) | (x[:-1] != 0))] if len(x) else x


def _buckets(x: np.ndarray, lead: int) -> np.ndarray:
    """Buckets of the subwords of codes that end behind the first `lead` ones."""
    x, out = x.astype(np.uint64), []
    with np.errstate(over="ignore"):
        h = x + np.uint64(1)
        for n in range(1, max(ORDERS) + 1):
            if n > 1:
                h = h[: len(x) - n + 1] * np.uint64(0x100000001B3) + x[n - 1 :] + np.uint64(n)
            if n in ORDERS:
                v = h[max(0, lead - n + 1) :]
                v = (v ^ (v >> np.uint64(23))) * np.uint64(0x9E3779B97F4A7C15)
                out.append((v >> np.uint64(49)).astype(np.int64))
    return np.concatenate(out)


def subwords(text: str) -> np.ndarray:
    """Buckets of all subwords of a (lower-cased) text; characters other than letters count as one gap."""
    return _buckets(_codes(text), 0)


_TABLE: list[np.ndarray] = []


def _letters(x: np.ndarray) -> np.ndarray:
    if not _TABLE:
        t = np.zeros(0x110000, bool)
        t[[i for i in range(0x110000) if not 0xD800 <= i < 0xE000 and chr(i).isalpha()]] = True
        _TABLE.append(t)
    return _TABLE[0][x]


@dataclass
class Model:
    """A table of bucket by language, a bias, a temperature and the threshold of rejection."""

    langs: list[str]
    table: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, text: str) -> np.ndarray | None:
        total, n, x = np.zeros(len(self.langs)), 0, _codes(text.lower())
        for s in range(0, len(x), SLICE):
            lead = min(s, max(ORDERS) - 1)  # a slice starts with what subwords across the cut need
            b = _buckets(x[s - lead : s + SLICE], lead)
            total += self.table[b].sum(0, dtype=np.float64)
            n += len(b)
        return total / n + self.bias if self.langs and x.any() else None

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if text else None
        if z is None:
            return UNKNOWN, 0.0
        z = np.exp((z - z.max()) / self.temperature)
        return self.langs[int(z.argmax())], float(min(1.0, z.max() / z.sum()))


def _features(text: str) -> tuple[np.ndarray, np.ndarray]:
    b, c = np.unique(subwords(text.lower()), return_counts=True)
    return b, (c / max(1, c.sum())).astype(np.float32)


def train(rows: list[tuple[str, str]], epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """A model from (text, lang) rows; every fifth row only calibrates."""
    langs = sorted({lang for _, lang in rows})
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32)
    out, bias = np.zeros((DIMS, len(langs)), np.float32), np.zeros(len(langs), np.float32)
    made = [(*_features(t), langs.index(lang)) for t, lang in rows]
    made = [x for x in made if len(x[0])]
    learn, check = [x for i, x in enumerate(made) if i % 5], made[::5]
    if not learn:
        learn = check
    # Frequent subwords lie in all languages: mean embeddings are scaled up so that the softmax can tell small differences.
    gain = 20.0
    steps, step = max(1, epochs * len(learn)), 0
    for _ in range(epochs):
        for i in rng.permutation(len(learn)):
            b, w, y = learn[i]
            lr = rate * (1 - step / steps)
            step += 1
            mean = gain * (w @ emb[b])
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y] -= 1
            back = gain * (out @ p)
            out -= lr * 0.2 * np.outer(mean, p)
            bias -= lr * 0.1 * p
            emb[b] -= lr * w[:, None] * back[None, :]
    model = Model(langs, (gain * emb @ out).astype(np.float32), bias.astype(np.float64))
    zs = [(w @ model.table[b] + model.bias, y) for b, w, y in check]

    def loss(t: float) -> float:
        free = 1 / (len(zs) + 2)  # as if a few of the labels were drawn at random: no sample proves certainty
        return sum(np.logaddexp.reduce(z / t) - (1 - free) * z[y] / t - free * z.mean() / t for z, y in zs)

    model.temperature = float(min((1.15**k for k in range(-20, 30)), key=loss)) if zs else 1.0
    scored = sorted(((float(np.exp(z.max() / model.temperature - np.logaddexp.reduce(z / model.temperature))), int(z.argmax()) == y) for z, y in zs), reverse=True)
    right = 0
    for k, (score, ok) in enumerate(scored, 1):
        right += ok
        if right >= RELIABLE * k:
            model.threshold = score
    return model


def sample_of(docs: DataFrame, rows: int = SAMPLE) -> list[tuple[str, str]]:
    """Labelled rows outside the held-out fold, with a letter: at most `rows` of each language, those with the least hash of their id.

    The hash is cut, for each language, where that many of its rows are expected below it (a tenth more, to be sure), so tasks send little else to the driver.
    """
    fold = F.crc32(F.col("doc_id").cast("string")) % 5
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold != 0))
    bits, there = 40, F.col("there_")
    cut = F.when(there <= 2 * rows, F.lit(1 << bits)).otherwise((F.lit(float(1 << bits) * (1.1 * rows + 100)) / there).cast("long"))
    cuts = labelled.groupBy("lang").agg(F.count("*").alias("there_")).select("lang", cut.alias("cut_"))  # a row for each language
    h = F.pmod(F.xxhash64("doc_id"), F.lit(1 << bits))
    few = labelled.join(F.broadcast(cuts), "lang").filter((h < F.col("cut_")) & F.col("text").rlike(r"\p{L}")).select(h.alias("h"), "doc_id", "lang", "text").collect()
    few.sort(key=lambda r: (r["h"], r["doc_id"], r["lang"], r["text"]))
    taken, out = Counter(), []
    for r in few:
        taken[r["lang"]] += 1
        if taken[r["lang"]] <= rows:
            out.append((r["text"], r["lang"]))
    return out


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and reliable: whether the score reaches the calibrated threshold."""
    docs = docs.select("doc_id", "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(model or train(sample_of(docs)))  # BUCKETS times the number of languages

    def run(b: pa.RecordBatch) -> dict:
        m = shared.value
        found = [m.predict(t) for t in b.column("text").to_pylist()]
        ids = b.column("doc_id").to_pylist()
        return {
            "doc_id": ids,
            "held_out": [i is not None and crc32(str(i).encode()) % 5 == 0 for i in ids],
            "lang_pred": [x for x, _ in found],
            "score": [s for _, s in found],
            "reliable": [x != UNKNOWN and s >= m.threshold for x, s in found],
        }

    return by_batch(docs.select("doc_id", "text"), "doc_id long, held_out boolean, lang_pred string, score double, reliable boolean", run)
