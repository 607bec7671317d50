"""Toxicity by a support vector machine with a gap-weighted subsequence kernel.

The kernel compares two words by the three-character subsequences that they share, each
weighted by ``DECAY`` to the power of the characters that it spans (at most ``SPAN``), so
``idiot``, ``id.iot`` and ``idxiot`` stay close. A Nystroem map from landmark words makes the
machine linear. Labels belong to documents, and no label says which words are meant, so the
machine learns from several instances at once. Its instances are words; texts are not split into
sentences. All words of a document labelled 0 are negative, and of a document labelled 1 the words
that look worst are positive. They are chosen again after each turn of training. Because the
kernel has an explicit form, the trained machine folds into one weight per subsequence, and
scoring a word needs no landmark.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltrace.llm.arrow import SMALL, in_text_parts
from siltrace.llm.words import mix
from siltrace.session import small_batches

DECAY, SPAN, BITS = 0.7, 5, 20
_OFFSETS = [(0, i, j) for j in range(2, SPAN) for i in range(1, j)]
LONGEST = 40  # characters of a word; a longer one is cut into overlapping stretches
CACHED_WORDS = 250_000  # of a Python worker, within a partition
WORST = 4  # words of a document that its score looks at
HARDNESS = 0.5  # of the machine's margin: how much a miss costs
NO_WORDS = -1.0  # the margin of a word that isn't there, and the least that counts
_EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»„“”‘’¿¡…–—"
_INNER = re.compile(r"[\W\d_]+")
_SPELT = re.compile(r"(?<!\S)(?:\S[ \t]){2,}\S(?!\S)")


def _slots(units: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Subsequence slots and weights of each unit (0 where there is none); a start and an end mark are added."""
    width = max(map(len, units)) + 2
    chars = np.zeros((len(units), width + SPAN), np.uint64)
    flat = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32)
    size = np.fromiter(map(len, units), np.int64, len(units))
    rows = np.repeat(np.arange(len(units)), size)
    chars[rows, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size) + 1] = flat
    chars[:, 0] = 2
    chars[np.arange(len(units)), size + 1] = 3
    slots, weights = [], []
    for o in _OFFSETS:
        a, b, c = (chars[:, x : x + width] for x in o)
        code = mix((a * np.uint64(0x1F123BB5) + b) * np.uint64(0x9E3779B97F4A7C15) + c)
        slots.append((code >> np.uint64(64 - BITS)).astype(np.int32))
        weights.append(np.where((b > 0) & (c > 0), np.float32(DECAY ** (o[2] + 1)), np.float32(0)))
    return np.concatenate(slots, 1), np.concatenate(weights, 1)


def _norms(slots: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Lengths in kernel space; a subsequence that occurs twice adds its weights first."""
    order = np.argsort(np.where(weights > 0, slots, -1), axis=1, kind="stable")
    s, w = np.take_along_axis(np.where(weights > 0, slots, -1), order, 1), np.take_along_axis(weights, order, 1)
    total = np.cumsum(w, 1, dtype=np.float64)
    last = np.ones_like(s, bool)
    last[:, :-1] = s[:, 1:] != s[:, :-1]
    before = np.maximum.accumulate(np.where(np.concatenate([np.zeros((len(s), 1), bool), last[:, :-1]], 1), np.concatenate([np.zeros((len(s), 1)), total[:, :-1]], 1), 0), 1)
    return np.sqrt((np.where(last, total - before, 0) ** 2).sum(1)) + 1e-9


def kernel(a: list[str], b: list[str], strip: int = 64) -> np.ndarray:
    """The normalised kernel of all pairs, in strips of ``b`` so that no wide table is made."""
    if len(b) > strip:
        return np.concatenate([kernel(a, b[i : i + strip], strip) for i in range(0, len(b), strip)], 1)
    if not a or not b:
        return np.zeros((len(a), len(b)))
    (sa, wa), (sb, wb) = _slots(a), _slots(b)
    used = np.unique(sb[wb > 0])
    dense = np.zeros((len(used) + 1, len(b)))
    np.add.at(dense, (np.searchsorted(used, sb), np.arange(len(b))[:, None]), np.where(wb > 0, wb, 0))
    dense = dense[:-1] / _norms(sb, wb)
    at = np.clip(np.searchsorted(used, sa), 0, len(used) - 1)
    hit = np.where((used[at] == sa) & (wa > 0), wa, 0)
    out = np.zeros((len(a), len(b)))
    for k in range(sa.shape[1]):
        some = hit[:, k] > 0
        out[some] += hit[some, k, None] * dense[at[some, k]]
    return out / _norms(sa, wa)[:, None]


def units(text: str | None) -> set[str]:
    """The words to judge: lower-case, without edge punctuation; letters alone where signs or
    digits stand between them; and runs of single characters joined."""
    if not text:
        return set()
    low = text.lower()
    out = set(low.split())
    more = set()
    for w in [w for w in out if not w.isalpha()]:
        out.discard(w)
        w = w.strip(_EDGES)
        if w:
            more.add(w)
            if not w.isalpha() and (inner := _INNER.sub("", w)):
                more.add(inner)
    out |= more
    if " " in low:
        out.update(m[0].replace(" ", "").replace("\t", "") for m in _SPELT.finditer(low))
    long = {w for w in out if len(w) > LONGEST}
    for w in long:
        out.discard(w)
        out.update(w[i : i + LONGEST] for i in range(0, len(w), LONGEST // 2))
    return out


def _spread(words: list[str], most: int, close: float = 0.8) -> list[str]:
    """The first words of which no two are closer than ``close``, up to ``most``."""
    near, out = kernel(words, words), []
    for k in range(len(words)):
        if len(out) < most and (near[k, out] < close).all():
            out.append(k)
    return [words[k] for k in out]


@dataclass
class Model:
    """A trained machine: weights of subsequences, bias, and the logistic of the worst margins."""

    weights: np.ndarray
    bias: float
    slopes: np.ndarray
    shift: float

    def margins(self, words: list[str], norms: np.ndarray | None = None) -> np.ndarray:
        """Distances from the machine's plane; ``norms`` are the words' lengths, if known."""
        out = np.empty(len(words), np.float32)
        for i in range(0, len(words), 1024):
            s, w = _slots(words[i : i + 1024])
            out[i : i + 1024] = (self.weights[s] * w).sum(1) / (_norms(s, w) if norms is None else norms[i : i + 1024]) + self.bias
        return out

    def probability(self, worst: np.ndarray) -> np.ndarray:
        """Of rows with the margins of the ``WORST`` worst words."""
        return 1 / (1 + np.exp(-np.clip(np.clip(worst, NO_WORDS, 1) @ self.slopes + self.shift, -50, 50)))


def _svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 30) -> np.ndarray:
    """A linear machine with squared hinge loss, by Newton steps over the active rows."""
    w = np.zeros(x.shape[1])

    def loss(v):
        return v @ v / 2 + (c * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() / 2

    for _ in range(rounds):
        active = y * (x @ w) < 1
        a, ca = x[active], c[active]
        step = np.linalg.solve(np.eye(x.shape[1]) + (a * ca[:, None]).T @ a, (a * ca[:, None]).T @ y[active]) - w
        t, now = 1.0, loss(w)
        while t > 1e-4 and loss(w + t * step) > now:
            t /= 2
        w = w + t * step
        if np.abs(t * step).max() < 1e-6:
            break
    return w


def _logistic(x: np.ndarray, y: np.ndarray, rounds: int = 60) -> tuple[np.ndarray, float]:
    """Non-negative weights and a shift of a lightly penalised logistic fit."""
    x = np.concatenate([x, np.ones((len(x), 1))], 1).astype(float)
    b, used = np.zeros(x.shape[1]), np.ones(x.shape[1], bool)
    for _ in range(rounds):
        a = x[:, used]
        p = 1 / (1 + np.exp(-np.clip(a @ b[used], -50, 50)))
        step = np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.1 * np.eye(a.shape[1]), a.T @ (y - p) - 0.1 * b[used])
        b[used] += np.clip(step, -3, 3)
        wrong = b < 0
        wrong[-1] = False
        if wrong.any():  # a worse word never makes a text better
            b[wrong], used[wrong] = 0, False
        elif np.abs(step).max() < 1e-8:
            break
    return b[:-1], float(b[-1])


def _bags(docs: list[tuple[str | None, int]], marks: int = 8) -> tuple[list[str], list[np.ndarray], np.ndarray]:
    """Words, each document's words as numbers, and labels. ``docs`` is emptied, to save memory.

    A document that shares 3 of its ``marks`` least long words with an earlier one of the same
    label is left out, so that copies of one toxic text don't make all its words look toxic.
    """
    number: dict[str, int] = {}
    owner: dict[tuple[int, int], int] = {}
    bags, labels = [], []
    docs.reverse()
    while docs:
        text, label = docs.pop()
        words = units(text)
        sketch = [(label, zlib.crc32(w.encode())) for w in heapq.nsmallest(marks, (w for w in words if len(w) >= 8), key=hash_of)]
        shared: dict[int, int] = {}
        for w in sketch:
            if w in owner:
                shared[owner[w]] = shared.get(owner[w], 0) + 1
        if not words or max(shared.values(), default=0) >= 3:
            continue
        for w in sketch:
            owner.setdefault(w, len(bags))
        bags.append(np.fromiter((number.setdefault(w, len(number)) for w in words), np.int32, len(words)))
        labels.append(label)
    return list(number), bags, np.array(labels, int)


def _first_model(words: list[str], toxic: list[np.ndarray], clean: list[np.ndarray]) -> Model:
    """Weights by how much oftener a subsequence occurs in documents of one label: cautious log odds
    of holding it in one word at least, or in two, which finds the many forms of one stem."""

    def holders(bags):
        n = np.full((2, 1 << BITS), 0.5)
        for bag in bags:
            s, w = _slots([words[k] for k in bag])
            each = np.unique((s + (np.arange(len(s), dtype=np.int64)[:, None] << BITS))[w > 0])
            slots, many = np.unique(each & ((1 << BITS) - 1), return_counts=True)
            n[0, slots] += 1
            n[1, slots[many > 1]] += 1
        return n

    t, c = holders(toxic), holders(clean)
    odds = np.log(t / (len(toxic) + 1)) - np.log(c / (len(clean) + 1))
    sure = np.sign(odds) * np.maximum(0, np.abs(odds) - np.sqrt(1 / t + 1 / c))
    return Model(np.where(sure[1] > sure[0], sure[1], sure[0]).astype(np.float32), 0.0, np.zeros(WORST), 0.0)


def _machine(positive: dict[str, float], negative: dict[str, float], marks: list[str]) -> Model:
    """The machine over the landmarks' subspace, folded into weights of subsequences."""
    words = [*positive, *negative]
    label = np.array([1.0] * len(positive) + [-1.0] * len(negative))
    values, vectors = np.linalg.eigh(kernel(marks, marks))
    good = values > 1e-6 * values.max()
    root = vectors[:, good] / np.sqrt(values[good])
    x = np.ones((len(words), root.shape[1] + 1))
    for i in range(0, len(words), 1000):
        x[i : i + 1000, :-1] = kernel(words[i : i + 1000], marks) @ root
    often = np.array([*positive.values(), *negative.values()])
    w = _svm(x, label, np.where(label > 0, often / often[label > 0].sum(), often / often[label < 0].sum()) * len(label) * HARDNESS)
    alpha = root @ w[:-1]
    weights = np.zeros(1 << BITS)
    s, v = _slots(marks)
    np.add.at(weights, s, v * (alpha / _norms(s, v))[:, None])
    return Model(weights.astype(np.float32), float(w[-1]), np.zeros(WORST), 0.0)


def fit(docs: list[tuple[str | None, int]], landmarks: int = 256, negatives: int = 6_000, witnesses: int = 3, compared: int = 1_000, turns: int = 3) -> Model:
    """Trains on (text, label) pairs, which are copied. Without both labels it says 0 for everything.

    First each toxic document's worst words are guessed from the subsequences that its label
    goes with, over all toxic and ``compared`` clean documents. Then in each of ``turns`` the
    machine is trained on up to ``witnesses`` of the worst words of each toxic document against
    ``negatives`` clean words (frequent and random ones) and the worst word of each clean
    document, and the worst words are chosen again. A toxic document that looks no worse than
    most clean ones is left out of a turn: its label may be wrong. Landmarks are up to ``landmarks`` of
    these words that are not alike, three quarters of them positive, and as many hard clean
    ones again. Last, a logistic fit over the documents gives the probability from the margins of
    the ``WORST`` worst words.
    """
    words, bags, y = _bags(list(docs))
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), -1.0, np.zeros(WORST), -20.0)
    toxic, clean = [b for b, label in zip(bags, y) if label], [b for b, label in zip(bags, y) if not label]
    of_toxic, of_clean = (np.bincount(np.concatenate(x), minlength=len(words)) for x in (toxic, clean))
    norms = np.concatenate([_norms(*_slots(words[i : i + 1024])) for i in range(0, len(words), 1024)]).astype(np.float32)
    clear = of_toxic > of_clean  # a word that more clean documents hold is no witness
    known = np.flatnonzero(of_clean)
    by_hash = known[np.argsort([hash_of(words[k]) for k in known], kind="stable")]
    often = known[np.argsort(-of_clean[known], kind="stable")]
    base = list(dict.fromkeys([*often[: negatives // 4].tolist(), *by_hash[: negatives - negatives // 4].tolist()]))
    base = [k for k in base if not clear[k]]
    hard: dict[int, int] = {}
    margin = _first_model(words, toxic, clean[:compared]).margins(words, norms)
    model = None
    for turn in range(turns):
        chosen: dict[int, float] = {}
        near = float(np.median([margin[b].max() for b in clean]))
        for bag in toxic:
            able = bag[clear[bag]]
            able = able[np.argsort(-margin[able], kind="stable")[:witnesses]]
            able = able[(margin[able] >= near) & (margin[able] >= near + 0.5 * (margin[able[:1]] - near))] if len(able) else able
            for k in able.tolist():
                chosen[k] = chosen.get(k, 0.0) + 1.0 / len(able)
        if not chosen:
            break
        for bag in clean:
            k = int(bag[margin[bag].argmax()])
            if k not in chosen:
                hard[k] = hard.get(k, 0) + 1
        positive = {words[k]: n for k, n in sorted(chosen.items(), key=lambda x: (-x[1], words[x[0]]))}
        negative = {words[k]: float(of_clean[k]) ** 0.5 for k in [*base, *hard] if k not in chosen}
        if not negative:
            break
        worst = [words[k] for k in sorted(hard, key=lambda k: (-margin[k], words[k]))[: 4 * landmarks]]
        marks = [*_spread(list(positive)[: 4 * landmarks], landmarks * 3 // 4), *list(negative)[: landmarks // 4]]
        marks = list(dict.fromkeys([*marks, *_spread(worst, landmarks)]))
        model = _machine(positive, negative, marks)
        margin = model.margins(words, norms)
    if model is None:
        return Model(np.zeros(1 << BITS, np.float32), -1.0, np.zeros(WORST), -20.0)
    model.slopes, model.shift = _logistic(np.clip(np.stack([_worst(margin[b]) for b in bags]), NO_WORDS, 1), y)
    return model


def hash_of(word: str) -> int:
    """A stable code of a word, to sample words by."""
    return zlib.crc32(word.encode()) * 2654435761 % 4294967291


def _worst(margins: np.ndarray) -> np.ndarray:
    """The ``WORST`` largest margins, filled up with that of a text without words."""
    out = np.full(WORST, NO_WORDS, np.float32)
    top = np.sort(margins)[::-1][:WORST]
    out[: len(top)] = top
    return out


_known: dict[float, dict[str, float]] = {}


def _scores(texts: list[str | None], model: Model) -> list[float]:
    known = _known.setdefault(hash((model.bias, model.shift, float(model.weights.sum()))), {})
    sets = [units(t) for t in texts]
    fresh = list(set().union(*sets) - known.keys()) if sets else []
    if fresh:
        known.update(zip(fresh, model.margins(fresh).tolist()))
    none = [NO_WORDS] * WORST
    worst = np.array([(heapq.nlargest(WORST, map(known.__getitem__, s)) + none)[:WORST] for s in sets]).reshape(-1, WORST)
    if len(known) > CACHED_WORDS:
        known.clear()
    return model.probability(worst)


def held_out(id_col) -> F.Column:
    """Rows whose labels are never used: crc32 of the id's text leaves 2 when divided by 4."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = 5_000, max_chars: int = 40_000) -> Model:
    """Fits on a hash sample of about ``max_rows`` labelled rows of up to ``max_chars`` characters.

    Held-out rows and rows with a null id, text or label are left out; an id that is labelled
    twice counts as toxic if one label says so, and rows with one id and several texts are all used.
    Empty tables give a model that says 0. Scoring has neither bound. The sample is drawn by a
    hash of the id, so it doesn't depend on partitioning.
    """
    named = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y in (0, 1)").where(~held_out("id"))
    share = min(1.0, max_rows / max(1, named.count()))
    few = named.where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000)).groupBy("id").agg(F.max("y").alias("y"))
    text = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t").between(1, max_chars)).where(F.pmod(F.xxhash64("id", F.lit("train")), F.lit(1_000_000)) < int(share * 1_000_000))
    rows = text.join(few, "id").select("id", "t", "y").collect()
    return fit([(r.t, r.y) for r in sorted(rows, key=lambda r: (r.id, r.t))])


def _judged(batch: pa.RecordBatch, text: str, model: Model) -> pa.RecordBatch:
    scores = _scores(batch.column(batch.schema.get_field_index(text)).to_pylist(), model)
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.asarray(scores, float))], names=[*batch.schema.names, "_score"])


def toxicity(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``_score`` from 0 to 1, without a shuffle; a column of that name is replaced.

    Whole texts are scored, however long: the score is the logistic of the margins of the
    ``WORST`` worst words. A word of over ``LONGEST`` characters is judged in
    overlapping stretches of that many. Null and empty texts and texts without words score as
    if their words had the margin ``NO_WORDS``. Repeated rows get equal scores, an empty table
    gives no rows, and other columns are kept.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    source = docs.drop("_score")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema) + ", _score double"
    return source.mapInArrow(in_text_parts(lambda b: _judged(b, text_col, shared.value), text_col, lambda: _known.clear(), SMALL), schema)
