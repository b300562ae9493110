"""Toxicity by a support vector machine on gap-weighted subsequences, with Nyström landmarks."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidymesh.llm.common import modest_batches, release

#: Places, from the first, of the characters of a subsequence: three within five characters, four within five.
SHAPES = [(1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4), (1, 2, 3), (1, 2, 4), (1, 3, 4), (2, 3, 4)]
DECAY = 0.6
BITS = 18
WITNESSES = 2
WIDTH, STEP = 32, 16
#: Pieces that are learnt from in a long text.
SAMPLES = 20
_MULTIPLY = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)

_TABLE = str.maketrans({**dict.fromkeys("""'"*-_.`~^#&%$@+=<>{}[]\\""", None), **dict.fromkeys(",;:!?/|()", " ")})
_SPACED = re.compile(r"(?<!\S)\S(?:\s\S){2,}(?!\S)")


def units(text: str) -> set[str]:
    """Words in lower case without signs, and runs of three or more single characters as words of their own."""
    text = text.lower().translate(_TABLE)
    out = set(text.split())
    for m in _SPACED.finditer(text):
        out.add("".join(m[0].split()))
    return out


def windows(word: str) -> list[str]:
    """The word with its ends marked, or overlapping parts of one that is longer than WIDTH."""
    word = f"^{word}$"
    return [word] if len(word) <= WIDTH else [word[i : i + WIDTH] for i in range(0, len(word) - STEP, STEP)]


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hashed subsequences, weights), a row for each word: decay to the number of characters passed over, and 0 where
    the word ends before; the weights of a row are scaled to length 1."""
    codes = np.frombuffer("".join(x[:WIDTH].ljust(WIDTH, "\0") for x in words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), WIDTH).astype(np.uint64)
    width = max(5, int((codes > 0).sum(axis=1).max(initial=0)))
    codes = np.concatenate([codes[:, :width], np.zeros((len(words), 4), np.uint64)], axis=1)
    ids, weights = [], []
    for shape in SHAPES:
        key = codes[:, :width] * _MULTIPLY[0]
        for k, at in enumerate(shape, 1):
            key = (key ^ (key >> np.uint64(29))) * _MULTIPLY[k] + codes[:, at : at + width]
        key = (key ^ (key >> np.uint64(32))) * _MULTIPLY[0]
        ids.append((key >> np.uint64(64 - BITS)).astype(np.int32))
        weights.append((codes[:, shape[-1] : shape[-1] + width] > 0) * np.float32(DECAY ** (shape[-1] - len(shape))))
    ids, weights = np.concatenate(ids, axis=1), np.concatenate(weights, axis=1)
    return ids, weights / np.maximum(np.sqrt((weights**2).sum(axis=1, keepdims=True)), 1e-6)


def dot(words: list[str], table: np.ndarray, step: int = 4096) -> np.ndarray:
    """Sum of the table's values (one or a row each) over each word's subsequences."""
    out = []
    for k in range(0, len(words), step):
        ids, w = subsequences(words[k : k + step])
        out.append((table[ids] * w).sum(axis=1) if table.ndim == 1 else np.einsum("nfm,nf->nm", table[ids], w))
    return np.concatenate(out) if out else np.zeros((0, *table.shape[1:]), np.float32)


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised gap-weighted subsequence kernel between words and landmarks."""
    ids, w = subsequences(landmarks)
    present, at = np.unique(ids[w > 0], return_inverse=True)
    table = np.zeros((len(present) + 1, len(landmarks)), np.float32)
    np.add.at(table, (at, np.nonzero(w > 0)[0]), w[w > 0])
    place = np.full(1 << BITS, len(present), np.int32)
    place[present] = np.arange(len(present))
    out = np.zeros((len(words), len(landmarks)), np.float32)
    for k in range(0, len(words), 512):
        ids, w = subsequences(words[k : k + 512])
        rows, cols = np.nonzero((w > 0) & (place[ids] < len(present)))
        own = place[ids[rows, cols]]
        for i in range(0, len(rows), 16_384):
            r = rows[i : i + 16_384]
            np.add.at(out, k + r, table[own[i : i + 16_384]] * w[r, cols[i : i + 16_384]][:, None])
    return out


def svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float, rounds: int = 30) -> np.ndarray:
    """Weights and bias of the linear machine with squared hinge loss, by Newton steps on the rows inside the margin; sums are taken over
    blocks of rows, so no copy of all of them is made."""
    blocks = [slice(k, k + 1024) for k in range(0, len(x), 1024)]
    size = x.shape[1] + 1
    penalty = np.full(size, ridge)
    penalty[-1] = 1e-6
    w = np.zeros(size)

    def values(w: np.ndarray) -> np.ndarray:
        return np.concatenate([x[b].astype(np.float64) @ w[:-1] + w[-1] for b in blocks])

    def loss(w: np.ndarray) -> float:
        return float((weight * np.maximum(0, 1 - y * values(w)) ** 2).sum() + (penalty * w * w).sum())

    now = loss(w)
    for _ in range(rounds):
        inside = y * values(w) < 1
        left, right = np.diag(penalty), np.zeros(size)
        for b in blocks:
            own = np.concatenate([x[b][inside[b]], np.ones((int(inside[b].sum()), 1), x.dtype)], axis=1).astype(np.float64)
            weighed = own * weight[b][inside[b], None]
            left += weighed.T @ own
            right += weighed.T @ y[b][inside[b]]
        step = np.linalg.solve(left, right) - w
        scale = 1.0
        while scale > 1e-3 and loss(w + scale * step) > now:
            scale /= 2
        w = w + scale * step
        before, now = now, loss(w)
        if before - now < 1e-6 * max(1.0, before):
            break
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.1, rounds: int = 50) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - y) + ridge * w
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + ridge * np.eye(len(w))
        w -= np.linalg.solve(h, g)
    return w


TOP = 3


@dataclass
class Model:
    """``table``: the machine's weights on subsequences, which the landmarks' weights add up to; ``link``: from a
    document's greatest values and its number of words to a probability."""

    table: np.ndarray
    bias: float
    link: np.ndarray
    base: float = 0.0
    landmarks: list[str] = field(default_factory=list)

    def values(self, words: list[str]) -> np.ndarray:
        """The machine's value of each word; for a long one, the greatest of its parts'."""
        parts = [windows(x) for x in words]
        flat = dot([p for x in parts for p in x], self.table) + self.bias
        first = np.cumsum([0, *map(len, parts)])[:-1]
        return np.maximum.reduceat(flat, first) if len(words) else flat

    def probability(self, features: np.ndarray) -> np.ndarray:
        if not len(self.link):
            return np.full(len(features), self.base)
        return 1 / (1 + np.exp(-np.clip(features @ self.link[:-1] + self.link[-1], -30, 30)))


def features(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Each document's TOP greatest values (its words' come one after the other; -2 for none) and log(1 + words)."""
    out = np.full((len(counts), TOP + 1), -2.0)
    out[:, TOP] = np.log1p(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    order = np.lexsort((-values, owner))
    rank = np.arange(len(values)) - np.repeat(np.cumsum(counts) - counts, counts)
    kept = rank < TOP
    out[owner[kept], rank[kept]] = np.maximum(values[order][kept], -2.0)
    return out


def fit(texts: list[str], labels: list[int], landmarks: int = 384, words: int = 16_000, rounds: int = 3, seed: int = 1) -> Model:
    """Train on labelled texts, of which one in four sets the link from values to probabilities.

    Words of over WIDTH characters are taken apart into overlapping windows, here as in scoring. A toxic text says not which of its words is
    toxic, so words stand for their text: each toxic text has the words
    of the greatest values as its witnesses, first by the log odds of its subsequences and then by the machine, which
    is trained again with the new witnesses (``rounds`` times). Landmarks: witnesses, clean words like them, and
    clean words at random; the kernel with them, whitened, is what the machine sees.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, int)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros(0), float(y.mean()) if len(y) else 0.0)
    # each word and window is held once, texts as numbers of words
    words_at: dict[str, int] = {}
    place: dict[str, int] = {}
    docs = [np.array([words_at.setdefault(w, len(words_at)) for w in sorted(units(t))], np.int64) for t in texts]
    vocabulary = list(words_at)
    parts = [np.array([place.setdefault(p, len(place)) for p in windows(w)], np.int64) for w in vocabulary]  # as in scoring, all windows of a long word
    at = [np.unique(np.concatenate([np.zeros(0, np.int64), *(parts[w] for w in d)])) for d in docs]
    held = np.zeros(len(y), bool)
    for c in (0, 1):
        own = rng.permutation(np.flatnonzero(y == c))
        held[own[: max(1, len(own) // 4)] if len(own) > 1 else own] = True
    train = ~held if y[~held].min(initial=1) != y[~held].max(initial=0) else np.ones(len(y), bool)
    shown = list(place)
    seen = np.zeros((2, len(shown)))
    for i in np.flatnonzero(train):
        seen[y[i], at[i]] += 1
    totals = np.ones((2, 1 << BITS))
    for k in range(0, len(shown), 4096):
        ids, w = subsequences(shown[k : k + 4096])
        for c in (0, 1):
            totals[c] += np.bincount(ids[w > 0], np.repeat(seen[c, k : k + 4096], (w > 0).sum(axis=1)), 1 << BITS)
    odds = (np.log(totals[1]) - np.log(totals[0]) - math.log(totals[1].sum() / totals[0].sum())).astype(np.float32)
    value = dot(shown, odds)
    toxic = [at[i] for i in np.flatnonzero(train & (y == 1)) if len(at[i])]
    clean = np.flatnonzero(seen[0] > 0)
    if not toxic or not len(clean):
        return Model(np.zeros(1 << BITS, np.float32), 0.0, np.zeros(0), float(y.mean()))
    never = seen[0] == 0
    value = np.where(never, value, np.minimum(value, 0))
    for r in range(rounds):
        chosen = np.concatenate([own[np.argsort(-value[own], kind="stable")[:WITNESSES]] for own in toxic])
        witnesses = np.bincount(chosen[value[chosen] > 0] if (value[chosen] > 0).any() else chosen, minlength=len(value))
        positive = np.flatnonzero(witnesses)
        votes = witnesses[positive]
        hard = clean[np.argsort(-value[clean], kind="stable")][: words // 2]
        rest = rng.permutation(np.setdiff1d(clean, hard))[: words - len(hard)]
        if r == 0:
            third = landmarks // 3
            marks = np.concatenate([positive[np.argsort(-votes, kind="stable")][:third], hard[rng.permutation(min(len(hard), 4 * third))][:third], rest[:third]])
            names = [shown[k] for k in dict.fromkeys(marks.tolist())]
            s, u = np.linalg.eigh(kernel(names, names).astype(np.float64))
            whiten = u[:, s > 1e-4] / np.sqrt(s[s > 1e-4])
        own = np.concatenate([positive, hard, rest])
        target = np.where(np.arange(len(own)) < len(positive), 1.0, -1.0)
        many = np.concatenate([np.sqrt(votes), np.ones(len(own) - len(positive))])
        many[target > 0] *= (len(own) - len(positive)) / max(1.0, many[target > 0].sum()) / 4
        z = kernel([shown[k] for k in own], names) @ whiten.astype(np.float32)
        w = svm(z, target, many, ridge=0.01 * len(own) / 100)
        beta = (whiten @ w[:-1]).astype(np.float32)
        ids, weights = subsequences(names)
        table = np.bincount(ids.ravel(), (weights * beta[:, None]).ravel(), 1 << BITS).astype(np.float32)
        value = dot(shown, table) + w[-1]
    model = Model(table, float(w[-1]), np.zeros(0), landmarks=names)
    del z, shown
    kept = np.flatnonzero(held)
    x = features(model.values([vocabulary[w] for i in kept for w in docs[i]]), np.array([len(docs[i]) for i in kept]))
    model.link = logistic(x, y[kept])
    return model


class Values(dict):
    """Word to the machine's value, with the words not yet met put down."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> float:
        self.new.append(word)
        self[word] = math.nan
        return math.nan


def score_toxicity(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score", most: int = 150_000) -> DataFrame:
    """``docs`` plus the probability that each whole text is toxic (replaces a column of that name).

    Null, empty and blank texts have the probability of a text without words; repeated rows are scored each; an empty table gives an empty
    result. Each worker keeps the values of up
    to ``most`` words that it has met.
    """
    modest_batches(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != score_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Values()
        for batch in batches:
            texts, scores = batch.column(text_col), []
            for k in range(0, len(texts), 512):
                if len(known) > most:
                    known = Values()
                words = [list(units(t.as_py() or "")) for t in texts[k : k + 512]]
                got = [list(map(known.__getitem__, w)) for w in words]
                if known.new:
                    known.update(zip(known.new, model.values(known.new).tolist()))
                    known.new = []
                    got = [list(map(known.__getitem__, w)) for w in words]
                counts = np.array([len(x) for x in got], np.int64)
                scores.append(model.probability(features(np.fromiter((v for x in got for v in x), float, int(counts.sum())), counts)))
            column = pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), column], names=[*(f.name for f in fields), score_col])
        del known
        release()

    return docs.mapInArrow(run, T.StructType([*fields, T.StructField(score_col, T.DoubleType())]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows: int = 3000, chars: int = 20_000) -> Model:
    """A model from labelled rows: at most ``rows`` of each label, those of the least hash of the id among the ones
    that ``learn`` (an expression on the id) allows. Of a text of over ``chars`` characters, SAMPLES pieces that are spread evenly over
    it are learnt from, as many characters together.

    Rows with a null id, label or text teach nothing, nor do ids with both labels. Of rows that repeat an id, the least text teaches. So the
    driver gets at most 2 * ``rows`` texts of ``chars`` characters. Labels of one kind, or none, give a constant score.
    """
    allowed = labels.select(F.col(id_col), F.col(label_col).cast("int").alias("__y")).where(F.col(id_col).isNotNull() & F.col("__y").isin(0, 1))
    if learn is not None:
        allowed = allowed.where(learn)
    allowed = allowed.groupBy(id_col).agg(F.min("__y").alias("__y"), F.max("__y").alias("__most")).where("__y = __most").drop("__most")
    picked = None
    for y in (0, 1):
        own = allowed.where(F.col("__y") == y).orderBy(F.xxhash64(id_col), id_col).limit(rows)
        picked = own if picked is None else picked.unionByName(own)
    text, each = F.col("__t"), chars // SAMPLES
    start = lambda k: F.floor(k * (F.length(text) - each) / (SAMPLES - 1)).cast("int") + 1
    sampled = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: F.substring(text, start(k), F.lit(each))), " ")
    # at most 2 * rows ids, so this side is bounded
    found = docs.select(id_col, F.col(text_col).alias("__t")).where("__t IS NOT NULL").join(F.broadcast(picked), id_col)
    found = found.withColumn("__t", F.when(F.length("__t") <= chars, text).otherwise(sampled))
    found = found.groupBy(id_col, "__y").agg(F.min("__t").alias("__t")).toPandas().sort_values(id_col, kind="stable")
    model = fit(found["__t"].tolist(), found["__y"].tolist())
    release()
    return model


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that no label is learnt from: crc32 of the id as text has remainder 2 by 4."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))
