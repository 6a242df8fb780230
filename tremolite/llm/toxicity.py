"""Toxicity by weak supervision: many lexicon and pattern voters, a generative label model, a linear classifier.

1. Voters. Lexicons of words and of word beginnings are induced from labelled rows (terms far more
   frequent in toxic ones, near copies counted once) and dealt by kind and support into voters; a seed lexicon of insults
   and patterns (shouting; exclamation marks in a row; a lexicon word aimed at the reader; insults with
   their letters apart, with digits or signs for letters, or with a letter three times or more) vote as well,
   and others vote for clean. A disguised insult also counts as the plain word.
2. A generative label model, fitted by EM without labels, estimates how often each voter speaks in
   either class, starting from the known class balance, and which pairs of voters are correlated within the
   classes: a vote depends on the class and on the one voter it shares most with, found anew in every round.
3. A linear classifier over lexicon hits is trained on the model's posterior labels.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets as B
from .staging import labelled_sample, staged

#: Most labelled documents that lexicons, label model and classifier are fitted on: those of the least hashed ids.
SAMPLE = 12_000
#: Most terms of each kind in the induced lexicons.
TERMS = 4_000
#: A term enters a lexicon if it is in this many toxic rows and this many times likelier there.
SUPPORT, LIFT = 4, 6.0
GROUPS = 6
#: Nats by which a term's split between toxic and other rows must differ from chance, unless its stem leans too.
SURPRISE = 22.0
#: Bytes of the word beginnings that are terms, besides whole words.
PREFIXES = (4, 5, 6, 8)
#: Seed words of the first voter; disguised forms of them make pattern voters.
SEEDS = ("idiot", "moron", "stupid", "loser", "scum", "trash", "pathetic", "worthless", "disgusting", "clown")
#: Digits and signs that stand for letters; a 1 is read as i, then as l.
STANDS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}
DISGUISES = 3
#: Fixed words: the reader addressed, in the languages of the corpus.
ADDRESS = ("you", "your", "youre", "u", "ur", "du", "dich", "dir", "dein", "deine", "tu", "toi", "te", "vous", "votre", "ti", "usted", "tus")
#: Words between a lexicon hit and an address that it is aimed at.
AIM = 3

#: Bytes of words: letters, digits, and all bytes of letters beyond ASCII.
_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
KINDS = 1 + len(PREFIXES)
_READ = [np.arange(256, dtype=np.uint8) for _ in range(2)]
for _map in _READ:
    _map[[ord(c) for c in STANDS]] = [ord(c) for c in STANDS.values()]
_READ[1][ord("1")] = ord("l")


def terms(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hashes, rows, kinds, stems) of the words and word beginnings of a run of lower-cased texts, with
    repeats; the stem is the hash of the word's shortest beginning, or of a word that has none."""
    starts, ends, rows = B.spans(_APART[b], at)
    c = B.prefix_hashes(b)
    h, r, k = [B.hashes(c, starts, ends)], [rows], [np.zeros(len(rows), np.int8)]
    stem = np.where(ends - starts > PREFIXES[0], B.hashes(c, starts, np.minimum(ends, starts + PREFIXES[0])) ^ np.uint64(1), h[0])
    stems = [stem]
    for kind, n in enumerate(PREFIXES, 1):
        long = ends - starts > n
        h.append(B.hashes(c, starts[long], starts[long] + n) ^ np.uint64(kind))
        r.append(rows[long])
        k.append(np.full(int(long.sum()), kind, np.int8))
        stems.append(stem[long])
    return np.concatenate(h), np.concatenate(r), np.concatenate(k), np.concatenate(stems)


def _seed_hashes() -> np.ndarray:
    column = pa.array(SEEDS)
    return terms(*B.text_buffers(column))[0][: len(SEEDS)]


_ADDRESS = terms(*B.text_buffers(pa.array(ADDRESS)))[0][: len(ADDRESS)]


def _collapsed(b: np.ndarray) -> np.ndarray:
    """Where a byte differs from the one before it."""
    return np.concatenate([np.ones(min(1, len(b)), bool), b[1:] != b[:-1]])


_SEED_COLUMN = B.text_buffers(pa.array(SEEDS))
_SHORT = B.text_buffers(pa.array([bytes(b[_collapsed(b)]).decode() for b in (np.frombuffer(s.encode(), np.uint8) for s in SEEDS)]))


def _words_of(column: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    b, at = column
    return B.hashes(B.prefix_hashes(b), at[:-1], at[1:])


def _found(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, names: np.ndarray) -> np.ndarray:
    """The place in ``names`` of each span's hash, -1 for none."""
    order = np.argsort(names)
    h = B.hashes(B.prefix_hashes(b), starts, ends)
    i = order[np.minimum(np.searchsorted(names[order], h), len(names) - 1)]
    return np.where(names[i] == h, i, -1)


def disguised(b: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, disguises, seeds) of the disguised seeds in a run of lower-cased texts, each once: 0 letters
    apart by a sign or space, 1 digits or signs for letters, 2 a letter three times or more."""
    out = set()
    seeds, short = _words_of(_SEED_COLUMN), _words_of(_SHORT)
    row_of = lambda places: np.searchsorted(at, places, side="right") - 1
    plain_starts, plain_ends, plain_rows = B.spans(_APART[b], at)
    for read in _READ:
        m = read[b]
        starts, ends, rows = B.spans(_APART[m], at)
        changed = np.concatenate([[0], np.cumsum(m != b)])
        seed = _found(m, starts, ends, seeds)
        hit = (seed >= 0) & (changed[ends] > changed[starts])
        out |= set(zip(rows[hit].tolist(), [1] * int(hit.sum()), seed[hit].tolist(), strict=True))

        new = _collapsed(m)
        new[at[:-1][at[:-1] < len(m)]] = True
        thrice = np.concatenate([np.zeros(min(2, len(m)), bool), ~new[2:] & ~new[1:-1]])
        left, often = np.concatenate([[0], np.cumsum(new)]), np.concatenate([[0], np.cumsum(thrice)])
        seed = _found(m[new], left[starts], left[ends], short)
        hit = (seed >= 0) & (often[ends] > often[starts])
        out |= set(zip(rows[hit].tolist(), [2] * int(hit.sum()), seed[hit].tolist(), strict=True))

        one = np.flatnonzero(plain_ends - plain_starts == 1)
        if len(one):
            place = plain_starts[one]
            joined = np.concatenate([[False], (np.diff(place) == 2) & (np.diff(plain_rows[one]) == 0)])
            spot = np.arange(len(one)) + np.cumsum(~joined)
            apart = np.full(int(spot[-1]) + 1, 32, np.uint8)
            apart[spot] = m[place]
            text = apart.tobytes()
            for k, word in enumerate(SEEDS):
                found = text.find(word.encode())
                while found >= 0:
                    out.add((int(row_of(place[np.searchsorted(spot, found)])), 0, k))
                    found = text.find(word.encode(), found + 1)
    rows, kinds, seed = (np.array(x, np.int64) for x in zip(*sorted(out), strict=True)) if out else (np.zeros(0, np.int64),) * 3
    return rows, kinds, seed


def _lower(column: pa.Array) -> pa.Array:
    return pc.utf8_lower(pc.fill_null(column.cast(pa.large_string()), ""))


def _shout(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Share of capitals among the ASCII letters, at rows."""
    upper, letter = (b >= 65) & (b <= 90), ((b >= 65) & (b <= 90)) | ((b >= 97) & (b <= 122))
    sums = [np.concatenate([[0], np.cumsum(m, dtype=np.int64)]) for m in (upper, letter)]
    up, all_ = (s[at[1:]] - s[at[:-1]] for s in sums)
    return up / np.maximum(1, all_)


def _exclaimed(b: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Which rows have two exclamation marks in a row."""
    marks = b == 33
    both = np.flatnonzero(marks[:-1] & marks[1:]) if len(b) > 1 else np.zeros(0, np.int64)
    rows = np.searchsorted(at, both, side="right") - 1
    out = np.zeros(len(at) - 1)
    out[rows[both + 1 < at[rows + 1]]] = 1
    return out


def dependence(joint: np.ndarray, share: np.ndarray, least: float) -> np.ndarray:
    """The voter that each voter's vote depends on besides the class, -1 for none: a maximum spanning forest of the
    class-conditional mutual information of pairs, without pairs under ``least`` nats. ``joint`` has
    (class, voter, vote, voter, vote) chances, ``share`` the classes' shares."""
    m = joint.shape[1]
    at = np.arange(m)
    single = joint.sum(4)[:, at, :, at].transpose(1, 0, 2)
    outer = single[:, :, :, None, None] * single[:, None, None, :, :]
    info = np.einsum("c,cij->ij", share, (joint * np.log(joint / outer)).sum((2, 4)))
    np.fill_diagonal(info, -1)
    parent = np.full(m, -1)
    best, source, left = np.full(m, -1.0), np.full(m, -1), set(range(m))
    while left:
        i = max(left, key=lambda k: (best[k], -k))
        left.remove(i)
        parent[i] = source[i] if best[i] >= least else -1
        for k in left:
            if info[i, k] > best[k]:
                best[k], source[k] = info[i, k], i
    return parent


def label_model(votes: np.ndarray, prior: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Posterior of class 1 for every row of ``votes`` (rows x voters, -1 clean, 0 silent, 1 toxic), the
    voters' chances of each vote by class, and the voter that each one depends on (-1: none).

    The model generates a class by ``prior`` and each vote from the class and the vote of one other voter. EM
    estimates both the chances and, anew in every round, which pairs are correlated within the classes.
    """
    n, m = votes.shape
    seen = np.stack([votes == v for v in (-1, 0, 1)], 2).reshape(n, 3 * m).astype(np.float32)
    score = (votes == 1).sum(1) - 0.5 * (votes == -1).sum(1)
    toxic = max(1, round(prior * n))
    cut = np.sort(score)[::-1][min(n - 1, toxic - 1)]
    q = np.where(score >= max(cut, 1), 0.9, 0.02)
    at = np.arange(m)
    for _ in range(rounds):
        counts = np.stack([(seen * w[:, None].astype(np.float32)).T @ seen for w in (1 - q, q)]).reshape(2, m, 3, m, 3).astype(float)
        joint = (counts + 1 / 9) / np.array([(1 - q).sum() + 1, q.sum() + 1])[:, None, None, None, None]
        single = joint.sum(4)[:, at, :, at].transpose(1, 0, 2)
        chance = single / single.sum(2, keepdims=True)
        parent = dependence(joint, np.array([1 - q.mean(), q.mean()]), 4 * np.log(max(2, n)) / n)
        weight = (np.log(chance[1]) - np.log(chance[0])).reshape(-1)
        odds = np.log(prior / (1 - prior)) + seen[:, np.repeat(parent < 0, 3)] @ weight[np.repeat(parent < 0, 3)]
        for i in np.flatnonzero(parent >= 0).tolist():
            pair = joint[:, parent[i], :, i, :]
            ratio = np.log(pair / pair.sum(2, keepdims=True))
            odds += (ratio[1] - ratio[0])[votes[:, parent[i]] + 1, votes[:, i] + 1]
        new = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        done = np.abs(new - q).max() < 1e-4
        q = new
        if done:
            break
    return q, chance, parent


class ToxicityModel:
    """Lexicons (sorted hashes, with a voter and a weight each) and the classifier's other weights; of bounded size."""

    def __init__(self, hashes: np.ndarray, voter: np.ndarray, strength: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.voter, self.strength = hashes[order], voter[order], strength[order]
        self.voters = 1 + KINDS * GROUPS
        self.weights = np.zeros(0)

    def _hits(self, b: np.ndarray, at: np.ndarray, disguise: tuple[np.ndarray, np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Term index and row of every lexicon hit of a run of lower-cased texts, disguised seeds read as
        plain ones; words in each row; rows where a word of the lexicon is aimed at the reader."""
        h, rows, kinds, _ = terms(b, at)
        whole = int((kinds == 0).sum())
        words = np.bincount(rows[:whole], minlength=len(at) - 1)
        aimed = self._aimed(h[:whole], rows[:whole])
        hidden, _, seed = disguise
        if len(hidden):
            plain, of, _, _ = terms(*_SEED_COLUMN)
            again = [plain[of == k] for k in seed.tolist()]
            h, rows = np.concatenate([h, *again]), np.concatenate([rows, np.repeat(hidden, [len(x) for x in again])])
        if not len(self.hashes):
            return np.zeros(0, np.int64), np.zeros(0, np.int64), words, aimed
        i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
        hit = self.hashes[i] == h
        return i[hit], rows[hit], words, aimed

    def _aimed(self, h: np.ndarray, rows: np.ndarray) -> np.ndarray:
        """Rows where an address stands within AIM words of a whole word of the lexicon."""
        address = np.flatnonzero(np.isin(h, _ADDRESS))
        found = [rows[:0]]
        for step in (*range(-AIM, 0), *range(1, AIM + 1)):
            near = address[(address + step >= 0) & (address + step < len(h))]
            near = near[rows[near] == rows[near + step]]
            found.append(rows[near[np.isin(h[near + step], self.hashes)]])
        return np.unique(np.concatenate(found))

    def features(self, lower: tuple[np.ndarray, np.ndarray], shout: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(votes, features) of a run of texts."""
        b, at = lower
        n = len(at) - 1
        disguise = disguised(b, at)
        spelled = np.zeros((n, DISGUISES))
        spelled[disguise[0], disguise[1]] = 1
        term, rows, words, aim = self._hits(b, at, disguise)
        aimed = np.zeros(n)
        aimed[aim] = 1
        loud = _exclaimed(b, at)
        counts = np.bincount(rows * self.voters + self.voter[term], minlength=n * self.voters).reshape(n, self.voters)
        strength = np.zeros(n)
        np.maximum.at(strength, rows, self.strength[term])
        any_hit = counts.sum(1) > 0
        votes = np.concatenate([(counts > 0).astype(int), np.where(shout > 0.6, 1, 0)[:, None], loud[:, None].astype(int), aimed[:, None].astype(int), spelled.astype(int), np.where(~any_hit, -1, 0)[:, None], np.where(strength < np.log(2 * LIFT), -1, 0)[:, None], np.where(counts.astype(bool).sum(1) + spelled.sum(1) <= 1, -1, 0)[:, None]], 1)
        rate = np.log1p(counts)
        x = np.concatenate([(counts > 0).astype(float), rate, strength[:, None], np.log1p(counts.sum(1) / np.maximum(1, words) * 1000)[:, None], any_hit[:, None], shout[:, None], loud[:, None], aimed[:, None], spelled, np.log1p(words)[:, None] / 10, np.ones((n, 1))], 1)
        return votes, x

    def fit(self, x: np.ndarray, q: np.ndarray, rounds: int = 30, ridge: float = 1e-3) -> ToxicityModel:
        """Logistic regression on soft labels by Newton's method."""
        w = np.zeros(x.shape[1])
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (p - q) / len(q) + ridge * w
            hess = (x * (p * (1 - p))[:, None]).T @ x / len(q) + ridge * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w -= step / max(1, np.abs(step).max() / 4)
        self.weights = w
        return self

    def score(self, column: pa.Array) -> np.ndarray:
        """Scores of a string column."""
        raw, low = B.text_buffers(column), B.text_buffers(_lower(column))
        out = []
        for i, j in B.runs(low[1]):
            part = lambda t: (t[0][t[1][i] : t[1][j]], t[1][i : j + 1] - t[1][i])  # noqa: B023, E731
            _, x = self.features(part(low), _shout(*part(raw)))
            out.append(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30))))
        B.shrink_powers()
        return np.concatenate(out) if out else np.zeros(0)


def _distinct_terms(wanted: np.ndarray | None):
    """Each text's distinct terms (all, or places in ``wanted``), with kinds and stems, and a signature that near
    copies share: the three least rehashed terms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, at = B.text_buffers(_lower(batch.column(0)))
            for i, j in B.runs(at):
                h, rows, kinds, stems = terms(b[at[i] : at[j]], at[i : j + 1] - at[i])
                order = np.lexsort((h, rows))
                h, rows, kinds, stems = h[order], rows[order], kinds[order], stems[order]
                new = np.concatenate([[True], (h[1:] != h[:-1]) | (rows[1:] != rows[:-1])]) if len(h) else np.zeros(0, bool)
                h, rows, kinds, stems = h[new], rows[new], kinds[new], stems[new]
                cut = np.searchsorted(rows, np.arange(j - i + 1))
                sign = [b"".join(B.mixed(x ^ np.uint64(s)).min().tobytes() for s in (11, 23, 47)) if len(x) else b"" for x in (h[cut[r] : cut[r + 1]] for r in range(j - i))]
                if wanted is not None:
                    place = np.minimum(np.searchsorted(wanted, h), max(0, len(wanted) - 1))
                    hit = wanted[place] == h if len(wanted) else np.zeros(len(h), bool)
                    h, rows, kinds, stems = place[hit], rows[hit], kinds[hit], stems[hit]
                    cut = np.searchsorted(rows, np.arange(j - i + 1))
                pack = lambda v: pa.array([v[cut[r] : cut[r + 1]].tobytes() for r in range(j - i)], pa.binary())  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(sign, pa.binary()), pack(h), pack(kinds), pack(stems)], ["sign", "h", "kind", "stem"])

    return run


def _weights(signs: list[bytes]) -> np.ndarray:
    """One over the number of documents that share a signature."""
    counts = Counter(signs)
    return np.array([1 / counts[s] for s in signs])


def _induced(sample: DataFrame) -> ToxicityModel:
    """Lexicons of the terms that toxic rows have far more often than others. A term whose split
    could be chance counts only if its stem, over all words, also leans to toxic rows.

    The driver gets the terms of the toxic rows, and of the others only which of those terms they have.
    """
    schema = "sign binary, h binary, kind binary, stem binary"
    got = sample.where("y = 1").select("text").mapInArrow(_distinct_terms(None), schema).toArrow()
    of = lambda c, kind: [np.frombuffer(x, kind) for x in got.column(c).to_pylist()]
    weight, h = _weights(got.column("sign").to_pylist()), of("h", np.uint64)
    flat, counted = np.concatenate(h), np.repeat(weight, [len(x) for x in h])
    names, at, back = np.unique(flat, return_index=True, return_inverse=True)
    a = np.bincount(back, counted, minlength=len(names))
    kind, stem = np.concatenate(of("kind", np.int8))[at].astype(int), np.concatenate(of("stem", np.uint64))[at]
    often = a >= SUPPORT
    names, a, kind, stem = names[often], a[often], kind[often], stem[often]
    rest = sample.where("y = 0").select("text").mapInArrow(_distinct_terms(names), schema).select("sign", "h").toArrow()
    clean, c = _weights(rest.column("sign").to_pylist()), np.zeros(len(names))
    for w, x in zip(clean, rest.column("h").to_pylist(), strict=True):
        c[np.frombuffer(x, np.int64)] += w
    toxic, others = max(1.0, weight.sum()), max(1.0, clean.sum())
    lift = ((a - np.sqrt(a)) / toxic) / ((c + 0.5) / others)
    where = np.minimum(np.searchsorted(names, stem), max(0, len(names) - 1))
    leans = (names[where] == stem) & (a[where] / toxic >= LIFT * (c[where] + 0.5) / others) if len(names) else often[:0]
    share, found = toxic / (toxic + others), a / np.maximum(1e-9, a + c)
    with np.errstate(divide="ignore", invalid="ignore"):
        surprise = (a + c) * (found * np.log(found / share) + np.where(found < 1, (1 - found) * np.log((1 - found) / (1 - share)), 0))
    good = (lift >= LIFT) & (a >= 8 * c) & (leans | (surprise >= SURPRISE))
    names, kind, strength, support = names[good], kind[good], np.log(lift[good] + 1), a[good]
    keep = np.zeros(len(names), bool)
    for k in range(KINDS):
        mine = np.flatnonzero(kind == k)
        keep[mine[np.argsort(-strength[mine], kind="stable")[:TERMS]]] = True
    names, kind, strength, support = names[keep], kind[keep], strength[keep], support[keep]
    seeds = _seed_hashes()
    voter = np.where(np.isin(names, seeds), 0, 1 + kind * GROUPS + np.clip(np.log2(support / SUPPORT), 0, GROUPS - 1).astype(int))
    extra = np.setdiff1d(seeds, names)
    return ToxicityModel(np.concatenate([names, extra]), np.concatenate([voter, np.zeros(len(extra), int)]), np.concatenate([strength, np.full(len(extra), np.log(4 * LIFT))]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel | None:
    """A model from the documents of at most 12,000 rows of ``labels`` with a 0/1 label, those of the least hashed
    ids; None unless both labels occur."""
    sample = staged(labelled_sample(docs, labels, SAMPLE, id_col, text_col, label_col))
    share, kinds = sample.agg(F.avg("y"), F.count_distinct("y")).first()
    if kinds < 2:
        return None
    model = _induced(sample)
    parts = sample.select("text").mapInArrow(_featured(model), "votes binary, x binary").toArrow()
    votes = np.stack([np.frombuffer(v, np.int64) for v in parts.column(0).to_pylist()])
    x = np.stack([np.frombuffer(v, np.float64) for v in parts.column(1).to_pylist()])
    q, _, _ = label_model(votes.astype(np.int64), float(np.clip(share, 0.005, 0.5)))
    return model.fit(x, q)


def _featured(model: ToxicityModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, low = B.text_buffers(batch.column(0)), B.text_buffers(_lower(batch.column(0)))
            for i, j in B.runs(low[1]):
                part = lambda t: (t[0][t[1][i] : t[1][j]], t[1][i : j + 1] - t[1][i])  # noqa: B023, E731
                votes, x = model.features(part(low), _shout(*part(raw)))
                yield pa.RecordBatch.from_arrays([pa.array([v.tobytes() for v in votes.astype(np.int64)], pa.binary()), pa.array([v.tobytes() for v in x.astype(np.float64)], pa.binary())], ["votes", "x"])

    return run


def toxicity_scores(df: DataFrame, model: ToxicityModel | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id and ``score``, 0 to 1: how likely its whole text is toxic.

    The model is of bounded size. Without one (no labels of both kinds) every score is 0. Null and
    empty texts hit no lexicon and get the score of that. Rows keep their ids, null or repeated.
    Nothing is shuffled. Empty table: empty result. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = model.score(batch.column(1)) if model else np.zeros(batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p, pa.float64())], ["id", "score"])

    return rows.mapInArrow(run, f"id {kind}, score double").withColumnRenamed("id", id_col)
