"""Text quality with a generalised additive model with pairwise interactions.

Each text is described by a few numbers (shares of kinds of characters, word lengths, repetition).
Each number is cut into bins, and the model is a lookup table for each number plus tables for a few
pairs of them: the score is the logistic function of the sum of one entry from each.  The tables are
learnt by boosting in turns: a shallow tree on one number at a time, first all numbers round and
round, then the pairs that explain most of what is left.

Training takes the ``sample_rows`` labelled rows with the least hashes of their id, at most; the numbers
of all texts are computed once, in a pass over the texts that writes a narrow table.  Of equally good cuts
the first is taken, and of equally good pairs the one of the earlier features.

Nulls: a null text is empty and gets a score as well; rows with a null id or label aren't learnt from.
Without labelled rows every score is 0.5.  An empty table gives no rows; equal texts get equal scores.
Only ``doc_id``, ``text`` and the label are read, so other columns can't clash; a missing one raises.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corymb.llm import tokens
from corymb.llm.bytecnn import held_out
from corymb.llm.shared import materialise, need, small_batches

FEATURES = ("log_bytes", "upper", "digits", "symbols", "bangs", "bars", "space", "beyond_ascii", "word_length", "long_words", "repeat_next", "distinct", "symbol_runs", "stops", "line_length", "repeat_second", "symbol_words")


def _table(chars: str) -> np.ndarray:
    out = np.zeros(256, np.int32)
    out[np.frombuffer(chars.encode(), np.uint8)] = 1
    return out


_LOWER = _table("abcdefghijklmnopqrstuvwxyz")
_UPPER = _table("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_DIGIT = _table("0123456789")
_SYMBOL = _table("#$%&*@^~<>{}[]\\/+=_`")
_BANG, _BAR, _STOP, _LINE, _SPACE = _table("!?"), _table("|"), _table("."), _table("\n"), _table(" \t\n\r\x0b\x0c")
_HIGH = (np.arange(256) >= 128).astype(np.int32)


def describe(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The numbers of each of consecutive texts."""
    n_texts = len(offsets) - 1
    out = np.zeros((n_texts, len(FEATURES)))
    for lo, hi in tokens.runs(offsets):
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]

        def per_text(marks: np.ndarray, at: np.ndarray = at) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(marks)])
            return (sums[at[1:]] - sums[at[:-1]]).astype(float)

        size = np.diff(at).astype(float)
        full = np.maximum(size, 1)
        upper, lower, high = (per_text(t[part]) for t in (_UPPER, _LOWER, _HIGH))
        symbol = _SYMBOL[part]
        hashes, bounds = tokens.words(part, at, tokens.NOT_SPACE)
        count = np.maximum(np.diff(bounds), 1).astype(float)
        owner = np.repeat(np.arange(hi - lo), np.diff(bounds))
        in_text = lambda marks, b=bounds: (lambda s: (s[b[1:]] - s[b[:-1]]).astype(float))(np.concatenate([[0], np.cumsum(marks)]))
        again = np.zeros(len(hashes), bool)
        again[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
        second = np.zeros(len(hashes), bool)
        second[2:] = (hashes[2:] == hashes[:-2]) & (owner[2:] == owner[:-2])
        distinct = np.zeros(hi - lo)
        for i, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
            s = np.sort(hashes[a:b])
            distinct[i] = np.count_nonzero(s[1:] != s[:-1]) + (b > a)
        inside = tokens.NOT_SPACE[part]
        run = np.zeros(len(part), np.int32)
        run[2:] = symbol[2:] & symbol[1:-1] & symbol[:-2]
        starts = at[:-1][np.diff(at) > 0]
        run[starts] = run[np.minimum(starts + 1, len(part) - 1)] = 0  # a run lies within one text
        letters = per_text(inside.astype(np.int32))
        lines = per_text(_LINE[part]) + 1
        cols = [
            np.log1p(size), upper / np.maximum(upper + lower, 1), per_text(_DIGIT[part]) / full, per_text(symbol) / full, per_text(_BANG[part]) / full, per_text(_BAR[part]) / full,
            per_text(_SPACE[part]) / full, high / full, letters / count, np.minimum(letters / count, 40), in_text(again) / count, distinct / count,
            per_text(run) / full, per_text(_STOP[part]) / count, np.log1p(size / lines), in_text(second) / count, per_text(symbol) / count,
        ]
        out[lo:hi] = np.stack(cols, 1)
    return out


class Additive:
    """Lookup tables over bins, for single numbers and for pairs."""

    def __init__(self, bins: int = 32, pairs: int = 6, rounds: int = 60, pair_rounds: int = 30, rate: float = 0.15, leaves: int = 3, ridge: float = 2.0):
        self.bins, self.n_pairs, self.rounds, self.pair_rounds, self.rate, self.leaves, self.ridge = bins, pairs, rounds, pair_rounds, rate, leaves, ridge

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, i], "right") for i, e in enumerate(self.edges)], 1)

    def _tree(self, g: np.ndarray, h: np.ndarray) -> np.ndarray:
        """A tree of a few leaves over the bins, grown by the best cut each time: a value for each bin."""
        cuts = [0, len(g)]
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + self.ridge)
        for _ in range(self.leaves - 1):
            best = (1e-9, None)
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b - a > 1:
                    cg, ch = np.cumsum(g[a:b])[:-1], np.cumsum(h[a:b])[:-1]
                    gains = cg**2 / (ch + self.ridge) + (g[a:b].sum() - cg) ** 2 / (h[a:b].sum() - ch + self.ridge) - gain(a, b)
                    k = int(gains.argmax())
                    best = max(best, (float(gains[k]), a + k + 1), key=lambda x: x[0])
            if best[1] is None:
                break
            cuts = sorted([*cuts, best[1]])
        out = np.zeros(len(g))
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            out[a:b] = g[a:b].sum() / (h[a:b].sum() + self.ridge)
        return out

    def _corner(self, g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
        """The best pair of cuts, one on each axis: its gain, and a value for each cell."""
        cg, ch = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
        quarters = lambda c: [c, c[:, -1:] - c, c[-1:] - c, c[-1, -1] - c[:, -1:] - c[-1:] + c]
        parts = [(a, b) for a, b in zip(quarters(cg), quarters(ch), strict=True)]
        gains = sum(a**2 / (np.maximum(b, 0) + self.ridge) for a, b in parts)
        i, j = np.unravel_index(int(gains[:-1, :-1].argmax()), gains[:-1, :-1].shape)
        v = [float(a[i, j] / (max(b[i, j], 0) + self.ridge)) for a, b in parts]
        out = np.empty_like(g)
        out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
        return float(gains[i, j]), out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Additive:
        n, d = x.shape
        self.edges = [np.unique(np.quantile(x[:, i], np.linspace(0, 1, self.bins + 1)[1:-1])) for i in range(d)]
        b = self.binned(x)
        rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(rate / (1 - rate)))
        self.single = [np.zeros(len(e) + 1) for e in self.edges]
        self.double: dict[tuple[int, int], np.ndarray] = {}
        z = np.full(n, self.start)
        slopes = lambda z: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-z)))
        for _ in range(self.rounds):
            for i in range(d):
                g, h = slopes(z)
                step = self.rate * self._tree(np.bincount(b[:, i], g, len(self.single[i])), np.bincount(b[:, i], h, len(self.single[i])))
                self.single[i] += step
                z += step[b[:, i]]
        grid = lambda i, j, v: np.bincount(b[:, i] * len(self.single[j]) + b[:, j], v, len(self.single[i]) * len(self.single[j])).reshape(len(self.single[i]), -1)
        g, h = slopes(z)
        open_pairs = [(i, j) for i in range(d) for j in range(i) if len(self.edges[i]) and len(self.edges[j])]
        chosen = sorted(open_pairs, key=lambda p: -self._corner(grid(*p, g), grid(*p, h))[0])[: self.n_pairs]
        self.double = {p: np.zeros((len(self.single[p[0]]), len(self.single[p[1]]))) for p in chosen}
        for _ in range(self.pair_rounds):
            for i, j in chosen:
                g, h = slopes(z)
                step = self.rate * self._corner(grid(i, j, g), grid(i, j, h))[1]
                self.double[i, j] += step
                z += step[b[:, i], b[:, j]]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        b = self.binned(x)
        z = np.full(len(x), self.start)
        for i, t in enumerate(self.single):
            z += t[b[:, i]]
        for (i, j), t in self.double.items():
            z += t[b[:, i], b[:, j]]
        return 1 / (1 + np.exp(-z))


def features(docs: DataFrame) -> DataFrame:
    """(doc_id, one column for each of FEATURES)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = describe(*tokens.text_bytes(b.column("text")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x[:, i]) for i in range(x.shape[1]))], names=["doc_id", *FEATURES])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES))


def fit(described: DataFrame, labels: DataFrame, *, label: str = "quality", sample_rows: int = 20_000) -> Additive | None:
    known = need(labels, doc_id="long", **{label: "int"}).where(f"doc_id IS NOT NULL AND {label} IS NOT NULL").where(~held_out(F.col("doc_id"))).distinct()
    n = known.count()
    if not n:
        return None
    order = F.xxhash64("doc_id", label)
    chosen = known.where(F.pmod(order, F.lit(1_000_003)).cast("double") / 1_000_003 < min(1.0, 1.1 * sample_rows / n))
    joined = chosen.join(described, "doc_id").select(order.alias("order"), label, *FEATURES).orderBy("order", label, *FEATURES)
    table = np.array(sorted(tuple(r)[1:] for r in joined.limit(sample_rows).collect()), float)  # the documented bound
    if not len(table) or len(set(table[:, 0])) < 2:
        return None
    return Additive().fit(table[:, 1:], table[:, 0])


def quality_digest(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    small_batches(docs.sparkSession)
    described = materialise(features(need(docs, doc_id="long", text="string")), "features")
    shared = docs.sparkSession.sparkContext.broadcast(fit(described, labels))  # tables of some thousand numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES], 1)
            s = shared.value.score(x) if shared.value else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(s)], names=["doc_id", "score"])

    scored = described.mapInArrow(run, "doc_id long, score double")
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
