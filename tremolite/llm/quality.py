"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages. Each passage is encoded; gated attention, learnt from document
labels alone, weighs the passages; the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets as B
from .staging import labelled_sample

#: Words in a passage.
PASSAGE = 48
#: Most labelled documents that the model is fitted on: those of the least hashed ids. Bounds the driver's memory.
SAMPLE = 4_000
HIDDEN = 12
BUCKETS = 24

_KINDS = ["upper", "lower", "digit", "break", "space", "stop", "mark", "bar", "rest", "high"]


def _kinds() -> np.ndarray:
    """A kind for every byte value."""
    kind = np.full(256, _KINDS.index("rest"), np.int8)
    for name, values in (("upper", range(65, 91)), ("lower", range(97, 123)), ("digit", range(48, 58)), ("break", (10, 13)), ("space", (9, 11, 12, 32)), ("stop", b".,;:'\"()?-"), ("mark", b"!#$%&*@^~=+"), ("bar", b"|<>{}[]\\/_"), ("high", range(128, 256))):
        kind[list(values)] = _KINDS.index(name)
    return kind


_KIND = _kinds()
FEATURES = len(_KINDS) + 10 + BUCKETS


def passages(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and rows of all passages of a run of texts; a text without words has one passage of zeros."""
    n = len(at) - 1
    starts, ends, rows = B.spans(B.SPACE[b], at)
    first_word = np.searchsorted(rows, np.arange(n + 1))
    in_row = np.arange(len(rows)) - first_word[rows]
    cut = np.flatnonzero(in_row % PASSAGE == 0)
    bare = np.flatnonzero(first_word[1:] == first_word[:-1])
    owner = np.concatenate([rows[cut], bare])
    x = np.zeros((len(owner), FEATURES))
    if len(cut):
        m = len(cut)
        begin = starts[cut]
        finish = np.concatenate([begin[1:], [len(b)]])
        finish = np.minimum(finish, at[rows[cut] + 1])
        size = np.maximum(1, finish - begin).astype(float)
        kind = _KIND[b]
        for k in range(len(_KINDS)):
            c = np.concatenate([[0], np.cumsum(kind == k, dtype=np.int64)])
            x[:m, k] = (c[finish] - c[begin]) / size
        words = np.diff(np.concatenate([cut, [len(rows)]])).astype(float)
        length = (ends - starts).astype(float)
        total = lambda v: np.add.reduceat(v, cut)
        h = B.hashes(B.prefix_hashes(b, B.FOLDED), starts, ends)
        place = np.repeat(np.arange(m), words.astype(int))
        order = np.lexsort((h, place))
        repeat = np.concatenate([[False], (h[order][1:] == h[order][:-1]) & (place[order][1:] == place[order][:-1])])
        same = np.concatenate([[False], (h[1:] == h[:-1]) & (place[1:] == place[:-1])])
        o = len(_KINDS)
        x[:m, o] = np.bincount(place[order], repeat, m) / words
        x[:m, o + 1] = total(same.astype(float)) / words
        mean = total(length) / words
        x[:m, o + 2] = np.log1p(mean)
        x[:m, o + 3] = np.sqrt(np.maximum(0, total(length * length) / words - mean * mean)) / (1 + mean)
        x[:m, o + 4] = np.log(words) / np.log(PASSAGE)
        final, initial = kind[ends - 1], kind[starts]
        for i, wanted in enumerate(("stop", "mark", "bar")):
            x[:m, o + 5 + i] = total((final == _KINDS.index(wanted)).astype(float)) / words
        x[:m, o + 8] = total((initial == _KINDS.index("upper")).astype(float)) / words
        x[:m, o + 9] = total((length == 1).astype(float)) / words
        # how the words that repeat most across passages of the corpus are used: hashed word buckets
        bucket = (h % np.uint64(BUCKETS)).astype(np.int64)
        x[:m, o + 10 :] = np.bincount(place * BUCKETS + bucket, minlength=m * BUCKETS).reshape(m, BUCKETS) / words[:, None] - 1 / BUCKETS
    order = np.argsort(owner, kind="stable")
    return x[order], owner[order]


class AttentionModel:
    """Passage encoder, gated attention and a logistic score; fitted by Adam on whole bags."""

    def __init__(self, inputs: int = FEATURES, hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.w = {"W": rng.normal(0, 1 / np.sqrt(inputs), (inputs, hidden)), "b": np.zeros(hidden), "V": rng.normal(0, 0.3, (hidden, hidden)), "U": rng.normal(0, 0.3, (hidden, hidden)), "a": rng.normal(0, 0.3, hidden), "c": rng.normal(0, 0.3, hidden), "d": np.zeros(1)}
        self.mean, self.scale = np.zeros(inputs), np.ones(inputs)

    def forward(self, x: np.ndarray, rows: np.ndarray, n: int) -> dict:
        """x: passages in the order of rows, every one of the n bags present."""
        w = self.w
        x = np.clip((x - self.mean) / self.scale, -8, 8)
        h = np.tanh(x @ w["W"] + w["b"])
        t, g = np.tanh(h @ w["V"]), 1 / (1 + np.exp(-(h @ w["U"])))
        e = (t * g) @ w["a"]
        first = np.searchsorted(rows, np.arange(n))
        e = np.exp(e - np.maximum.reduceat(e, first)[rows])
        alpha = e / np.add.reduceat(e, first)[rows]
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        return {"x": x, "h": h, "t": t, "g": g, "alpha": alpha, "z": z, "first": first, "p": 1 / (1 + np.exp(-np.clip(z @ w["c"] + w["d"], -30, 30)))}

    def fit(self, x: np.ndarray, rows: np.ndarray, y: np.ndarray, rounds: int = 240, rate: float = 0.03, decay: float = 1e-4) -> AttentionModel:
        self.mean, self.scale = x.mean(0), np.maximum(x.std(0), 1e-3)
        n, w = len(y), self.w
        moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in w.items()}
        weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum()))
        for step in range(1, rounds + 1):
            f = self.forward(x, rows, n)
            dl = weight * (f["p"] - y)
            grad = {"c": f["z"].T @ dl, "d": np.array([dl.sum()])}
            dz = (dl[:, None] * w["c"])[rows]
            da = (dz * f["h"]).sum(1)
            de = f["alpha"] * (da - np.add.reduceat(f["alpha"] * da, f["first"])[rows])
            tg = f["t"] * f["g"]
            grad["a"] = tg.T @ de
            du = de[:, None] * w["a"]
            dt, dg = du * f["g"] * (1 - f["t"] ** 2), du * f["t"] * f["g"] * (1 - f["g"])
            grad["V"], grad["U"] = f["h"].T @ dt, f["h"].T @ dg
            dh = (f["alpha"][:, None] * dz + dt @ w["V"].T + dg @ w["U"].T) * (1 - f["h"] ** 2)
            grad["W"], grad["b"] = f["x"].T @ dh, dh.sum(0)
            for k, v in w.items():
                g = grad[k] + decay * v * (v.ndim > 1)
                m, s = moment[k]
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * min(1.0, 3 * (1 - step / rounds)) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        return self

    def score(self, b: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.forward(*passages(b, at), len(at) - 1)["p"] if len(at) > 1 else np.zeros(0)


def _bags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, at = B.text_buffers(batch.column(1))
        for i, j in B.runs(at):
            x, rows = passages(b[at[i] : at[j]], at[i : j + 1] - at[i])
            cut = np.searchsorted(rows, np.arange(j - i + 1))
            packed = [x[cut[r] : cut[r + 1]].astype("<f4").tobytes() for r in range(j - i)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(packed, pa.binary()), batch.column(2).slice(i, j - i)], ["y", "bag", "h"])


def fit_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> AttentionModel | None:
    """A model from the documents of at most 4,000 rows of ``labels`` with a 0/1 label, those of the least hashed
    ids; None unless both labels occur."""
    rows = labelled_sample(docs, labels, SAMPLE, id_col, text_col, label_col)
    got = rows.select("y", "text", "h").mapInArrow(B.tidied(_bags), "y double, bag binary, h long").toArrow().sort_by("h")
    y = got.column(0).to_numpy()
    if len(np.unique(y)) < 2:
        return None
    bags = [np.frombuffer(x, "<f4").reshape(-1, FEATURES) for x in got.column(1).to_pylist()]
    rows_of = np.repeat(np.arange(len(bags)), [len(x) for x in bags])
    return AttentionModel().fit(np.concatenate(bags).astype(float), rows_of, y)


def quality_scores(df: DataFrame, model: AttentionModel | None, id_col: str = "doc_id", text_col: str = "text", carry: bool = False) -> DataFrame:
    """Every row's id and ``score``, 0 to 1: how likely its whole text has label 1. With ``carry`` all of the
    row's columns come in one struct ``row`` instead of the id, so that no name can clash.

    The model is small and of fixed size. Without one (no labels of both kinds) every score is 0.5.
    Null and empty texts are one passage of zeros and get that bag's score. Long texts are bags of
    many passages; all count. Rows keep their ids, null or repeated. Nothing is shuffled. Empty
    table: empty result. Other columns are ignored.
    """
    kept = F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row") if carry else F.col(id_col)
    rows = df.select(kept, F.col(text_col).cast("string").alias("__text"))
    name = "row" if carry else id_col
    schema = rows.select(F.col(name), F.lit(0.0).alias("score")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, at = B.text_buffers(batch.column(1))
            scores = [model.score(b[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in B.runs(at)] if model else []
            B.shrink_powers()
            p = np.concatenate(scores) if scores else np.full(batch.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p)], [name, "score"])

    return rows.mapInArrow(B.tidied(run), schema)
