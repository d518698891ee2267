"""Language identification with a byte convolutional network in numpy.

A text's bytes are cut into fixed windows.  Each byte is embedded, filters of several widths slide over
the window, the greatest response of each filter is kept, and a softmax gives a probability for each
language.  A text's probabilities are the mean over its windows, weighted by their bytes; all windows
of a text are read.

The network is trained here, on a bounded sample of labelled rows, whose whole texts are cut into windows:
see :func:`fit`.

Nulls: texts that are null or hold no letter get ``und`` with score 0, as does every text when no row
is labelled.  Rows with a null id or language are never learnt from.  An empty table gives no rows;
repeated rows get equal predictions.  Input columns named like an output column are replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corymb.llm import tokens
from corymb.llm.batches import append_columns
from corymb.llm.shared import need

WIDTHS, FILTERS, EMBED, WINDOW, BATCH = (2, 3, 4), 16, 6, 256, 32
ADDED = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("lang_score", T.DoubleType())])
UNKNOWN = "und"


class ByteCNN:
    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: rng.normal(0, scale, shape).astype(np.float32)
        self.languages = languages
        self.p = {"embed": normal(256, EMBED, scale=0.5)}
        for w in WIDTHS:
            self.p[f"w{w}"] = normal(w * EMBED, FILTERS, scale=(2 / (w * EMBED)) ** 0.5)
            self.p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        self.p["out"] = normal(len(WIDTHS) * FILTERS, len(languages), scale=0.2)
        self.p["bias"] = np.zeros(len(languages), np.float32)

    def _slide(self, windows: np.ndarray, w: int) -> np.ndarray:
        """(windows, positions, w * EMBED): what each filter position sees."""
        x = self.p["embed"][windows].reshape(len(windows), -1)
        return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(x, w * EMBED, axis=1)[:, ::EMBED])

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The greatest response of each filter in each window, and where it is."""
        out, at = [], []
        for w in WIDTHS:
            seen = self._slide(windows, w)
            y = (seen.reshape(-1, w * EMBED) @ self.p[f"w{w}"]).reshape(len(windows), -1, FILTERS)
            best = y.argmax(1)
            out.append(np.take_along_axis(y, best[:, None], 1)[:, 0] + self.p[f"b{w}"])
            at.append(best)
        return np.concatenate(out, 1), at

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "tables"}

    def _pair_tables(self) -> dict[str, np.ndarray]:
        """What each filter adds for a byte, or for two bytes side by side, wherever they stand in it."""
        if "tables" not in self.__dict__:
            one = {(w, j): self.p["embed"] @ self.p[f"w{w}"][j * EMBED : (j + 1) * EMBED] for w in WIDTHS for j in range(w)}
            two = lambda w, j: (one[w, j][:, None] + one[w, j + 1][None]).reshape(65536, FILTERS)
            self.tables = {(w, j): two(w, j) if j + 1 < w else one[w, j] for w in WIDTHS for j in range(0, w, 2)}
        return self.tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """The forward pass; sliding filters are looked up, two bytes at a time."""
        tables, out = self._pair_tables(), []
        for lo in range(0, len(windows), BATCH):
            part = windows[lo : lo + BATCH]
            pairs = part[:, :-1].astype(np.uint16) * np.uint16(256) + part[:, 1:]
            peaks = []
            for w in WIDTHS:
                n = WINDOW - w + 1
                y = np.take(tables[w, 0], pairs[:, :n], 0)
                for j in range(2, w, 2):
                    y += np.take(tables[w, j], (pairs if j + 1 < w else part)[:, j : j + n], 0)
                while n > 1:  # halves against each other: long rows, unlike max(1)
                    half = (n + 1) // 2
                    y = np.maximum(y[:, :half], y[:, n - half :])
                    n = half
                peaks.append(y[:, 0] + self.p[f"b{w}"])
            z = np.maximum(np.concatenate(peaks, 1), 0) @ self.p["out"] + self.p["bias"]
            z = np.exp(z - z.max(1, keepdims=True))
            out.append(z / z.sum(1, keepdims=True))
        return np.concatenate(out) if out else np.zeros((0, len(self.languages)), np.float32)

    def step(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradients of the mean cross-entropy."""
        peaks, at = self.pooled(windows)
        hidden = np.maximum(peaks, 0)
        z = hidden @ self.p["out"] + self.p["bias"]
        z = np.exp(z - z.max(1, keepdims=True))
        dz = z / z.sum(1, keepdims=True)
        dz[np.arange(len(labels)), labels] -= 1
        dz /= len(labels)
        g = {"out": hidden.T @ dz, "bias": dz.sum(0), "embed": np.zeros_like(self.p["embed"])}
        back = (dz @ self.p["out"].T) * (peaks > 0)
        for i, w in enumerate(WIDTHS):
            d = back[:, i * FILTERS : (i + 1) * FILTERS]
            where = at[i][:, :, None] + np.arange(w)  # windows, filters, bytes
            byte = windows[np.arange(len(windows))[:, None, None], where]
            seen = self.p["embed"][byte].reshape(len(windows), FILTERS, w * EMBED)
            g[f"w{w}"] = np.einsum("nf,nfe->ef", d, seen)
            g[f"b{w}"] = d.sum(0)
            part = (d[:, :, None] * self.p[f"w{w}"].T[None]).reshape(-1, EMBED)
            for e in range(EMBED):
                g["embed"][:, e] += np.bincount(byte.ravel(), part[:, e], 256)
        return g

    def train(self, texts: list[bytes], labels: np.ndarray, *, steps: int = 500, batch: int = 96, rate: float = 0.004, seed: int = 11) -> ByteCNN:
        """Adam on random crops, long and short, of each text."""
        rng = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        by_label = [np.flatnonzero(labels == i) for i in range(len(self.languages))]
        for t in range(1, steps + 1):
            pick = np.array([rng.choice(by_label[i]) for i in rng.integers(0, len(self.languages), batch)])
            windows = np.zeros((batch, WINDOW), np.uint8)
            for row, i in enumerate(pick):
                raw = np.frombuffer(texts[i], np.uint8)
                n = min(len(raw), WINDOW if rng.random() < 0.5 else int(rng.integers(12, WINDOW)))
                at = int(rng.integers(0, len(raw) - n + 1))
                windows[row, :n] = raw[at : at + n]
            for k, g in self.step(windows, labels[pick]).items():
                m[k] += 0.1 * (g - m[k])
                s[k] += 0.001 * (g * g - s[k])
                self.p[k] -= (rate * (1 - t / (steps + 1)) * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def judge(model: ByteCNN | None, column: pa.Array) -> list[pa.Array]:
    """Predicted language and its probability for each text of a column."""
    data, offsets = tokens.text_bytes(column)
    n = len(offsets) - 1
    names, scores = [UNKNOWN] * n, np.zeros(n)
    for lo, hi in tokens.runs(offsets) if model else ():
        part, at = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        sizes = np.diff(at)
        letters = np.concatenate([[0], np.cumsum(_LETTER[part])])
        some = letters[at[1:]] > letters[at[:-1]]
        for i in np.flatnonzero(~some & (sizes > 0)):  # perhaps letters beyond ASCII
            some[i] = any(c.isalpha() for c in part[at[i] : at[i + 1]].tobytes().decode("utf-8", "replace"))
        total, weight = np.zeros((hi - lo, len(model.languages))), np.maximum(sizes, 1)
        each = np.where(some, -(-sizes // WINDOW), 0)
        owner = np.repeat(np.arange(hi - lo), each)
        start = at[owner] + (np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)) * WINDOW
        padded = np.concatenate([_FOLD[part], np.zeros(WINDOW, np.uint8)])
        for k in range(0, len(owner), 1024):
            own, first = owner[k : k + 1024], start[k : k + 1024]
            length = np.minimum(at[own + 1] - first, WINDOW)
            windows = padded[first[:, None] + np.arange(WINDOW)]
            windows[np.arange(WINDOW) >= length[:, None]] = 0
            np.add.at(total, own, model.probabilities(windows) * length[:, None])
        total /= weight[:, None]
        best = total.argmax(1)
        for i in np.flatnonzero(some):
            names[lo + i] = model.languages[best[i]]
        scores[lo:hi] = np.where(some, np.clip(total[np.arange(hi - lo), best], 0, 1), 0)
    return [pa.array(names, pa.string()), pa.array(scores, pa.float64())]


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept for testing: crc32 of its id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, *, sample_docs: int = 3000, seed: int = 7) -> ByteCNN | None:
    """A network for the languages of the labelled rows that aren't held out; None if there are none.

    It learns from ``sample_docs`` labelled rows at most, as many of each language and one at least, chosen by a hash of their id and text.
    Their whole texts go to the driver, and crops from anywhere in them are learnt from.
    """
    known = need(docs, doc_id="long", text="string", lang="string").where("doc_id IS NOT NULL AND lang IS NOT NULL AND text <> ''").where(~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # languages
    if not counts:
        return None
    each = max(1, sample_docs // len(counts))
    share = F.create_map(*(x for k, n in sorted(counts.items()) for x in (F.lit(k), F.lit(min(1.0, 1.2 * (each + 20) / n)))))
    keyed = known.withColumn("order", F.xxhash64("doc_id", "text", F.lit(seed)))
    chosen = keyed.where(F.pmod("order", F.lit(1_000_003)).cast("double") / 1_000_003 < F.element_at(share, F.col("lang"))).select("lang", "order", "text").distinct()
    place = F.row_number().over(Window.partitionBy("lang").orderBy("order", "text"))  # among about 1.2 of the sample
    rows = chosen.withColumn("place", place).where(F.col("place") <= each).select("lang", "order", "text").collect()
    rows = sorted((r["lang"], r["order"], r["text"].encode("utf-8", "replace")) for r in rows)
    languages = sorted({lang for lang, *_ in rows})
    if not languages:
        return None
    texts = [_FOLD[np.frombuffer(w, np.uint8)].tobytes() for *_, w in rows]
    return ByteCNN(languages, seed).train(texts, np.array([languages.index(lang) for lang, *_ in rows]))


def identify(df: DataFrame, model: ByteCNN | None) -> DataFrame:
    """``df`` (with a ``text``) plus ``lang_pred`` and ``lang_score``."""
    shared = df.sparkSession.sparkContext.broadcast(model)  # some thousand numbers
    at = [c.lower() for c in df.columns].index("text")
    return append_columns(df, lambda b: judge(shared.value, b.column(at)), ADDED, drop=tuple(ADDED.names))


def language_digest(docs: DataFrame) -> DataFrame:
    model = fit(docs)
    out = identify(need(docs, doc_id="long", text="string"), model)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))
