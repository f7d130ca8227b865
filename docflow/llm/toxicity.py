"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

Words of the whole text are hashed to embedding rows; filters of several widths run over the
word sequence, each is max-pooled over the text, and a logistic layer gives the score. Training
takes a bounded sample of labelled rows (`SAMPLE` of each label at most, chosen by hash); part of
it is held back to calibrate the score, so that 0.3 is the best single threshold, and to set a
threshold for each language. Only the text is an input of the score.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .words import PART_BYTES, Packed, parts, separators, slices, texts_of, tidy

#: Labelled rows of either label that training reads at most.
SAMPLE = 3000
BITS, DIMS, FILTERS, WIDTHS = 18, 8, 8, (1, 2, 3)
CUT = 0.3
#: A word gets an embedding if its texts carry the label this many standard deviations more often
#: than chance, and at odds this many times the common ones.
SURPRISE, LIFT = 2.0, 6.0
_WORD = separators(bytes(b for b in range(128) if not chr(b).isalnum()))


def encode(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed words of all texts, and where each text begins, with the total at the end."""
    packed = Packed([t.lower().encode() for t in texts], _WORD)
    rows = (packed.hashes() >> np.uint64(64 - BITS)).astype(np.int32)
    return rows, packed.first


@dataclass
class Model:
    rows: np.ndarray  # bucket -> embedding row; buckets that say nothing share row 0, which is zero
    embedding: np.ndarray
    filters: list[np.ndarray]  # by width: (width, DIMS, FILTERS)
    biases: list[np.ndarray]
    out: np.ndarray
    bias: float
    scale: tuple[float, float] = (1.0, 0.0)
    thresholds: dict[str, float] = field(default_factory=dict)

    def windows(self, words: np.ndarray, begin: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """By width: embedding rows (window, width) and text of each window that is not all zero.

        A window may reach over its text's end, where it reads zeros.
        """
        at = self.rows[words]
        live = np.flatnonzero(at)
        end = begin[1:]
        text = np.searchsorted(end, live, side="right")
        out = []
        for filters in self.filters:
            width = len(filters)
            start = (live[:, None] - np.arange(width)).ravel()
            owner = np.repeat(text, width)
            ok = start >= begin[owner]
            start, first = np.unique(start[ok], return_index=True)
            owner = owner[ok][first]
            place = start[:, None] + np.arange(width)
            inside = place < end[owner][:, None]
            out.append((np.where(inside, at[np.minimum(place, len(at) - 1)], 0), owner))
        return out

    def pooled(self, windows: list[tuple[np.ndarray, np.ndarray]], n: int) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """Max-pooled filter responses (text, width * filter), all-zero windows counting, and the
        windows they come from: text, filter and window of each that is not all zero."""
        values, places = [], []
        for filters, bias, (rows, owner) in zip(self.filters, self.biases, windows, strict=True):
            best = np.zeros((n, FILTERS), dtype=np.float32)
            found = (np.zeros(0, dtype=np.int64),) * 3
            if len(owner):
                total = self.embedding[rows[:, 0]] @ filters[0]
                for j in range(1, len(filters)):
                    total += self.embedding[rows[:, j]] @ filters[j]
                cuts = np.flatnonzero(np.diff(owner, prepend=-1))
                most = np.maximum.reduceat(total, cuts, axis=0)
                best[owner[cuts]] = np.maximum(most, 0)
                run = np.repeat(np.arange(len(cuts)), np.diff(np.append(cuts, len(owner))))
                window, f = np.nonzero((total == most[run]) & (total > 0))
                _, once = np.unique(owner[window] * FILTERS + f, return_index=True)
                found = owner[window[once]], f[once], window[once]
            places.append(found)
            values.append(np.maximum(best + bias, 0))
        return np.concatenate(values, axis=1), places

    def logits(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        return self.pooled(self.windows(words, begin), len(begin) - 1)[0] @ self.out + self.bias

    def scores(self, words: np.ndarray, begin: np.ndarray) -> np.ndarray:
        a, b = self.scale
        return 1 / (1 + np.exp(-np.clip(a * self.logits(words, begin).astype(np.float64) + b, -30, 30)))


def _start(words: np.ndarray, begin: np.ndarray, y: np.ndarray, rng: np.random.Generator) -> Model:
    """Embeddings of the words whose texts carry the label clearly more often than others.

    They start from that surprise, in standard deviations; all other words stay zero.
    """
    text = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
    seen, compact = np.unique(words, return_inverse=True)
    pairs = np.unique(compact.astype(np.int64) * len(begin) + text)
    word, label = pairs // len(begin), y[pairs % len(begin)]
    ones = np.bincount(word, weights=label, minlength=len(seen))
    all_ = np.bincount(word, minlength=len(seen))
    rate = min(max(y.mean(), 1e-6), 1 - 1e-6)
    surprise = (ones - all_ * rate) / np.sqrt(all_ * rate * (1 - rate) + 1)
    telling = (surprise > SURPRISE) & (ones * (1 - rate) > LIFT * rate * (all_ - ones))
    seen, surprise = seen[telling], surprise[telling]
    embedding = rng.normal(0, 0.02, (len(seen) + 1, DIMS)).astype(np.float32)
    embedding[1:, 0] += np.clip(surprise / 8, 0, 2)
    embedding[0] = 0
    rows = np.zeros(1 << BITS, dtype=np.int32)
    rows[seen] = np.arange(1, len(seen) + 1)
    filters = [rng.normal(0, 0.3, (w, DIMS, FILTERS)).astype(np.float32) for w in WIDTHS]
    for f in filters:
        f[:, 0, : FILTERS // 2] = np.abs(f[:, 0, : FILTERS // 2]) + 0.3
    return Model(rows, embedding, filters, [np.zeros(FILTERS, dtype=np.float32) for _ in WIDTHS], rng.normal(0, 0.1, FILTERS * len(WIDTHS)).astype(np.float32), float(np.log(rate / (1 - rate))))


def fit(texts: list[str], labels: list[int], langs: list[str], weights: list[float], *, epochs: int = 10, batch: int = 128, rate: float = 0.02, seed: int = 5) -> Model:
    """Trains on three quarters of the rows, calibrates on the rest. Deterministic.

    With no row, or rows of one label only, the model gives every text one score, on that label's
    side of the threshold.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, dtype=np.float64)
    if not len(y) or y.min() == y.max():
        model = _start(*encode(["a"]), np.array([0.5]), rng)
        model.out[:] = 0
        model.bias = 4.0 if len(y) and y[0] else -4.0
        return model
    order = rng.permutation(len(y))
    back, front = order[: len(y) // 4], order[len(y) // 4 :]
    if not 0 < y[front].sum() < len(front):
        front = order
    w = np.asarray(weights, dtype=np.float64)
    held: list[np.ndarray] = []
    for a, b in parts(map(len, texts), PART_BYTES // 2):
        words, begin = encode(texts[a:b])
        held += [words[i:j] for i, j in zip(begin[:-1], begin[1:], strict=True)]

    def joined(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        some = [held[i] for i in ids]
        return np.concatenate(some), np.cumsum([0, *map(len, some)])

    model = _start(*joined(front), y[front], rng)
    tensors = [model.embedding, model.out, *model.filters, *model.biases]
    first = [np.zeros_like(t) for t in tensors]
    second = [np.zeros_like(t) for t in tensors]
    lots = [(lot, model.windows(*joined(lot))) for lot in np.array_split(rng.permutation(front), max(1, len(front) // batch))]
    step = 0
    for epoch in range(epochs):
        for k in rng.permutation(len(lots)):
            chosen, windows = lots[k]
            pooled, places = model.pooled(windows, len(chosen))
            error = 1 / (1 + np.exp(-np.clip(pooled @ model.out + model.bias, -30, 30))) - y[chosen]
            error = (error * w[chosen] / w[chosen].sum()).astype(np.float32)
            grads = [np.zeros_like(t) for t in tensors]
            grads[1] = pooled.T @ error + 1e-4 * model.out
            back_pooled = np.outer(error, model.out) * (pooled > 0)
            for k, (filters, (rows, _), (owner, f, window)) in enumerate(zip(model.filters, windows, places, strict=True)):
                g = back_pooled[:, k * FILTERS : (k + 1) * FILTERS].astype(np.float32)
                grads[2 + len(WIDTHS) + k] = g.sum(axis=0)
                g = g[owner, f]
                for j in range(len(filters)):
                    row = rows[window, j]
                    np.add.at(grads[2 + k][j].T, f, model.embedding[row] * g[:, None])
                    np.add.at(grads[0], row, g[:, None] * filters[j].T[f])
            grads[0][0] = 0
            model.bias -= rate * float(error.sum())
            step += 1
            for t, g, a, b in zip(tensors, grads, first, second, strict=True):
                a *= 0.9
                a += 0.1 * g
                b *= 0.99
                b += 0.01 * g * g
                t -= rate * (1 - 0.7 * epoch / epochs) * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
    _calibrate(model, [held[i] for i in back], y[back], w[back], [langs[i] for i in back])
    return model


def _best_cut(scores: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """The middle of the widest run of thresholds with the fewest weighted errors."""
    order = np.argsort(scores, kind="stable")
    s, y, w = scores[order], y[order], w[order]
    wrong = np.concatenate([[0], np.cumsum(w * y)]) + np.concatenate([np.cumsum((w * (1 - y))[::-1])[::-1], [0]])
    edges = np.concatenate([[s[0] - 1], s, [s[-1] + 1]])
    middle, room = (edges[:-1] + edges[1:]) / 2, np.diff(edges)
    open_ = room > 0  # no threshold lies between equal scores
    good = np.flatnonzero(open_ & (wrong <= wrong[open_].min() + 1e-9))
    return float(middle[good[np.argmax(room[good])]])


def _calibrate(model: Model, held: list[np.ndarray], y: np.ndarray, w: np.ndarray, langs: list[str]) -> None:
    """Moves the logits so that the best threshold becomes CUT; then one threshold per language."""
    if not 0 < y.sum() < len(y):
        return
    logits = np.concatenate([model.logits(h, np.array([0, len(h)])) for h in held]).astype(np.float64)
    aim = float(np.log(CUT / (1 - CUT)))
    model.scale = (1.0, aim - _best_cut(logits, y, w))
    moved = logits + model.scale[1]
    for lang in sorted(set(langs)):
        own = np.array([x == lang for x in langs])
        ones = y[own].sum()
        if ones >= 5 and own.sum() - ones >= 5:  # a language with few rows keeps the common one
            cut = (len(moved[own]) * _best_cut(moved[own], y[own], w[own]) + 100 * aim) / (len(moved[own]) + 100)
            model.thresholds[lang] = float(1 / (1 + np.exp(-cut)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE) -> Model:
    """Fits on labelled documents that are not held out: `sample` rows of either label at most.

    Rows of a label are chosen by a hash of their id, at a rate that the count of that label
    gives, and weigh as many as they stand for. Null labels are left out.
    """
    known = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(~held_out(F.col("doc_id")))
    counts = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    chance = F.lit(0.0)
    for label, n in counts.items():
        chance = F.when(F.col("toxic") == label, F.lit(min(1.0, 0.9 * sample / n))).otherwise(chance)
    draw = F.pmod(F.xxhash64(F.lit("toxicity"), F.col("doc_id")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = known.where(draw < chance)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("lang", F.lit("")).alias("lang")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "lang", "toxic").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    got = {label: max(1, sum(r["toxic"] == label for r in rows)) for label in counts}
    return fit([r["text"] for r in rows], [int(r["toxic"] == 1) for r in rows], [r["lang"] for r in rows], [counts[r["toxic"]] / got[r["toxic"]] for r in rows])


def score(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """`docs` with `score` (0 to 1) of each whole text; null and empty texts have the score of no word.

    A column named `score` is replaced. Texts go through in parts of bounded size.
    """
    kept = [c for c in docs.columns if c.lower() != "score"]
    docs = docs.select(*kept)
    held = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    place = kept.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pickle.loads(held.value)
        for whole in batches:
            for batch in slices(whole, place, PART_BYTES // 2):
                out = model.scores(*encode(texts_of(batch.column(place)))) if batch.num_rows else np.zeros(0)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out)], [*kept, "score"])

    return docs.mapInArrow(tidy(run), T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def judge(scored: DataFrame, model: Model, *, lang: str = "lang") -> DataFrame:
    """Adds `threshold`, that of the row's language (else CUT), and `rejected`: score >= threshold."""
    cut = F.lit(CUT)
    for name, value in sorted(model.thresholds.items()):
        cut = F.when(F.col(lang) == name, F.lit(value)).otherwise(cut)
    return scored.withColumn("threshold", cut).withColumn("rejected", F.col("score") >= F.col("threshold"))
