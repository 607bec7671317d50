"""Quality by supervised subword embeddings.

A text is the average of learned vectors, one for each of its words and one for each character
n-gram of its words, with the words' ends marked; vectors share ``1 << BITS`` slots by a hash. A softmax
over the average gives the probability of the label. Vectors and output are trained together by
stochastic gradient descent in numpy.

The output is linear in the average, so the trained machine folds into one number for each slot,
kept as an integer: a text's sum is exact whatever the order of its words or the partitioning.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.arrow import in_text_parts
from siltrace.llm.words import mix

BITS = 17
GRAMS = (2, 3, 4)  # characters of an n-gram
LONGEST = 48  # characters of a word; a longer one is cut
AGAIN = "\x01"
PRIOR = 16  # features without weight that every average includes, so that few words say little
FIXED = 1 << 32  # units of a folded weight
CACHED_WORDS = 250_000  # of a Python worker, within a partition
_K = np.uint64(0x9FB21C651E98DF25)


def pieces(text: str | None) -> list[str]:
    """Words between white space, case and signs kept, longer ones than ``LONGEST`` cut; and for each
    pair of equal words side by side the word ``AGAIN``, as a pair's own slot would not tell that."""
    out = (text or "").split()
    if any(len(w) > LONGEST for w in out):
        out = [w[i : i + LONGEST] for w in out for i in range(0, len(w), LONGEST)]
    return out + [AGAIN] * sum(map(eq, out, out[1:]))


def slots(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The slots of all words' features, joined, and each word's number of features."""
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    width = int(size.max(initial=2))
    chars = np.zeros((len(words), width + GRAMS[-1]), np.uint64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
    rows = np.repeat(np.arange(len(words)), size - 2)
    chars[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size - 2) - size + 2, size - 2) + 1] = flat
    chars[:, 0] = 2
    chars[np.arange(len(words)), size - 1] = 3
    codes, used = [], []
    gram = np.zeros((len(words), width), np.uint64)
    for n in range(1, GRAMS[-1] + 1):
        gram = mix(gram * _K + chars[:, n - 1 : n - 1 + width])
        if n in GRAMS:
            codes.append(gram + np.uint64(n))
            used.append(np.arange(width) + n <= size[:, None])
    whole = np.zeros(len(words), np.uint64)
    for j in range(width):
        more = j < size
        whole[more] = mix(whole[more] * _K + chars[more, j])
    codes.append(mix(whole + np.uint64(1))[:, None])
    used.append(np.ones((len(words), 1), bool))
    use = np.concatenate(used, 1)
    return (np.concatenate(codes, 1)[use] >> np.uint64(64 - BITS)).astype(np.int32), use.sum(1)


@dataclass
class Model:
    """Folded weights of slots in units of 1 / ``FIXED``, and the bias."""

    weights: np.ndarray
    bias: float

    def sums(self, words: list[str]) -> list[tuple[int, int]]:
        """Each word's summed weights and number of features."""
        out: list[tuple[int, int]] = []
        for i in range(0, len(words), 4096):
            at, n = slots(words[i : i + 4096])
            total = np.concatenate([[0], np.cumsum(self.weights[at])])
            end = np.cumsum(n)
            out += zip((total[end] - total[end - n]).tolist(), n.tolist())
        return out

    def probability(self, total: np.ndarray, n: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(total / FIXED / (n + PRIOR) + self.bias, -50, 50)))


def _indexed(texts: list[str]) -> tuple[list[str], list[np.ndarray], list[np.ndarray]]:
    """Different words, and each text's words as numbers with how often it has them."""
    number: dict[str, int] = {}
    words, often = [], []
    for text in texts:
        found = Counter(pieces(text))
        words.append(np.fromiter((number.setdefault(w, len(number)) for w in found), np.int64, len(found)))
        often.append(np.fromiter(found.values(), float, len(found)))
    return list(number), words, often


def fit(docs: list[tuple[str, int]], dim: int = 8, steps: int = 600, batch: int = 32, rate: float = 4.0, seed: int = 13) -> Model:
    """Trains on (text, label) pairs by ``steps`` steps of ``batch`` texts drawn anew each pass.

    The rate falls to zero. Texts without words are left out;
    without both labels the model says the one there is, or 0 without any.
    """
    docs = [(t, y) for t, y in docs if t and not t.isspace()]
    y = np.array([y for _, y in docs], int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.int64), 20.0 if len(y) and y[0] else -20.0)
    names, words, often = _indexed([t for t, _ in docs])
    parts = [slots(names[i : i + 4096]) for i in range(0, len(names), 4096)]
    at, n = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    start = np.cumsum(n) - n
    size = np.array([(o * n[w]).sum() for w, o in zip(words, often)]) + PRIOR
    rng = np.random.default_rng(seed)
    vectors = (rng.random((1 << BITS, dim), np.float32) - 0.5) / dim
    out, bias = np.zeros((dim, 2)), np.zeros(2)
    order, left = [], steps
    while left:
        if len(order) < batch:
            order = [*order, *rng.permutation(len(y)).tolist()]
        mine, order = order[:batch], order[batch:]
        step = rate * left / steps
        left -= 1
        ids, inverse = np.unique(np.concatenate([words[k] for k in mine]), return_inverse=True)
        doc = np.repeat(np.arange(len(mine)), [len(words[k]) for k in mine])
        share = np.zeros((len(mine), len(ids)), np.float32)
        share[doc, inverse] = np.concatenate([often[k] / size[k] for k in mine])
        counts = n[ids]
        first = np.cumsum(counts) - counts
        used = at[np.arange(counts.sum()) - np.repeat(first - start[ids], counts)]
        hidden = share @ np.add.reduceat(vectors[used], first)
        logits = hidden @ out + bias
        p = np.exp(logits - logits.max(1, keepdims=True))
        p /= p.sum(1, keepdims=True)
        p[np.arange(len(mine)), y[mine]] -= 1
        error = p / len(mine)
        back = np.repeat(share.T @ (error @ out.T), counts, 0)  # of each feature
        for j in range(dim):
            vectors[:, j] -= step * len(mine) * np.bincount(used, back[:, j], len(vectors))
        out -= step * hidden.T @ error
        bias -= step * 0.1 * error.sum(0)
    folded = vectors @ (out[:, 1] - out[:, 0])
    return Model(np.round(folded * FIXED).astype(np.int64), float(bias[1] - bias[0]))


_sum_of: dict[str, int] = {}
_size_of: dict[str, int] = {}


def _forget() -> None:
    _sum_of.clear()
    _size_of.clear()


def _scores(texts: list[str | None], model: Model) -> np.ndarray:
    bags = [pieces(t) for t in texts]
    fresh = list(set().union(*bags) - _sum_of.keys())
    for word, (total, n) in zip(fresh, model.sums(fresh)):
        _sum_of[word], _size_of[word] = total, n
    total = np.array([sum(map(_sum_of.__getitem__, bag)) for bag in bags], np.int64)
    n = np.array([sum(map(_size_of.__getitem__, bag)) for bag in bags], np.int64)
    if len(_sum_of) > CACHED_WORDS:
        _forget()
    return model.probability(total, n)


def held_out(id_col) -> F.Column:
    """Rows whose labels are never used: crc32 of the id's text leaves 0 when divided by 5."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_rows: int = 4_000, max_chars: int = 20_000) -> Model:
    """Fits on a hash sample of about ``max_rows`` labelled rows of up to ``max_chars`` characters.

    Held-out rows and rows with a null id, text or label are left out; an id that is labelled twice
    counts as bad if one label says so, and rows with one id and several texts are all used. Empty
    tables give a model that says 0. Scoring has neither bound. The sample is drawn by a hash of
    the id, so it doesn't depend on partitioning.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    part = 1_000_000
    drawn = F.pmod(F.xxhash64("id", F.lit("quality")), F.lit(part)) < int(min(1.0, max_rows / max(1, named.count())) * part)
    few = named.where(drawn).groupBy("id").agg(F.min("y").alias("y"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t").between(1, max_chars)).where(drawn)
    rows = text.join(few, "id").select("id", "t", "y").collect()
    return fit([(r.t, r.y) for r in sorted(rows, key=lambda r: (r.id, r.t))])


def _judged(batch: pa.RecordBatch, text: str, model: Model) -> pa.RecordBatch:
    scores = _scores(batch.column(batch.schema.get_field_index(text)).to_pylist(), model)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores)], names=[*batch.schema.names, "_quality"])


def quality(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_quality`` from 0 to 1, without a shuffle; a column of that name is replaced.

    Whole texts are scored, however long; a word of over ``LONGEST`` characters is taken in pieces.
    Null and empty texts and texts without words score by the bias alone. Repeated rows get equal
    scores, an empty table gives no rows, and other columns are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop("_quality")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", _quality double"

    def judge(batch):
        return _judged(batch, text_col, shared.value)

    return source.mapInArrow(in_text_parts(judge, text_col, _forget), schema)
