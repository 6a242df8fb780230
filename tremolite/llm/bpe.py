"""Byte-level BPE by speculation: greedy tokens, checked pair by pair, merged exactly only where a check fails."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets as B

#: Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Bounds of what a worker remembers; past them it forgets and goes on.
WORDS_KEPT = 300_000
PAIRS_KEPT = 500_000
#: Fewer words than this, and words of more bytes than LONG, propose their tokens one at a time, not in lockstep.
FEW, LONG = 24, 96
#: Words of at most so many bytes are merged by looking through a list, longer ones with a heap.
SHORT = 32
_NONE = (1 << 60, -1)
#: Characters of text handled at a time, one text at least.
RUN = 1 << 19


def _byte_symbols() -> dict[str, int]:
    """The printable stand-in of every byte: itself where Latin-1 shows it, else the next free one from 256."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary read from a tokenizer file (JSON with vocab, merges and added tokens)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        symbol = _byte_symbols()
        raw = lambda s: bytes(symbol[c] for c in s)
        model = spec["model"]
        self.ids = {raw(s): i for s, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.bytes = [b""] * (1 + max([*self.ids.values(), *self.special.values()]))
        for b, i in [*self.ids.items(), *((s.encode(), i) for s, i in self.special.items())]:
            self.bytes[i] = b
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.merges = {}
        for rank, (a, b) in enumerate(merges):
            a, b = raw(a), raw(b)
            self.merges.setdefault((self.ids[a], self.ids[b]), (rank, self.ids[a + b]))
        self.single = [self.ids[bytes([i])] for i in range(256)]
        self._split = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self._pretokens = regex.compile(PATTERN).findall
        self._build_trie()
        self.forget()

    def forget(self) -> None:
        self._known: dict[str, bytes] = {}
        self._pairs: dict[int, bool] = {}

    def _build_trie(self) -> None:
        """Child of (node, byte) in an open-addressed table; the token, if any, that ends at a node."""
        child: dict[int, int] = {}
        token = [-1]
        for b, i in self.ids.items():
            node = 0
            for x in b:
                at = node << 8 | x
                if at not in child:
                    child[at] = len(token)
                    token.append(-1)
                node = child[at]
            token[node] = i
        self._walk, self._ends = child, token
        self._bits = max(10, (4 * len(child)).bit_length())
        self._keys = np.full(1 << self._bits, -1, np.int64)
        self._child = np.full(1 << self._bits, -1, np.int32)
        left, to = np.array(list(child), np.int64), np.array(list(child.values()), np.int32)
        slot = self._slot(left)
        while len(left):
            free = self._keys[slot] == -1
            self._keys[slot[free]] = left[free]
            won = self._keys[slot] == left
            self._child[slot[won]] = to[won]
            left, to, slot = left[~won], to[~won], (slot[~won] + 1) & (len(self._keys) - 1)
        self._token = np.array(token, np.int32)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self._bits)).astype(np.int64)

    def _step(self, node: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """Children, -1 where there is none."""
        key = node.astype(np.int64) << 8 | byte
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        rest = np.arange(len(key))
        while len(rest):
            held = self._keys[slot]
            hit = held == key[rest]
            out[rest[hit]] = self._child[slot[hit]]
            go = ~hit & (held != -1)
            rest, slot = rest[go], (slot[go] + 1) & (len(self._keys) - 1)
        return out

    def merge(self, word: bytes) -> list[int]:
        """Exact merging: the lowest-ranked adjacent pair first, the leftmost of equals, until none is left."""
        ids = [self.single[b] for b in word]
        if len(ids) <= SHORT:
            find, none = self.merges.get, _NONE
            rank = [find(p, none) for p in zip(ids, ids[1:], strict=False)]
            while rank and (best := min(rank)) is not none:
                i = rank.index(best)
                ids[i : i + 2] = [best[1]]
                del rank[i]
                if i:
                    rank[i - 1] = find((ids[i - 1], ids[i]), none)
                if i < len(rank):
                    rank[i] = find((ids[i], ids[i + 1]), none)
            return ids
        after, before = [*range(1, len(ids)), -1], [-1, *range(len(ids) - 1)]
        find = self.merges.get
        heap = [(m[0], i, ids[i], ids[i + 1], m[1]) for i in range(len(ids) - 1) if (m := find((ids[i], ids[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j < 0 or ids[j] != b:
                continue
            ids[i], ids[j] = made, -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (m := find((ids[x], ids[y]))):
                    heapq.heappush(heap, (m[0], x, ids[x], ids[y], m[1]))
        return [i for i in ids if i >= 0]

    def greedy(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Longest-match tokens of all words at once: the word and the token, in order."""
        length = np.fromiter(map(len, words), np.int64, len(words))
        b = np.frombuffer(b"".join(words), np.uint8)
        end = np.cumsum(length)
        at, word = end - length, np.arange(len(words))
        of, tokens = [], []
        while len(word):
            best, reach = np.full(len(word), -1, np.int32), at.copy()
            live, node, p = np.arange(len(word)), np.zeros(len(word), np.int32), at
            while len(live):
                node = self._step(node, b[p])
                ok = node >= 0
                live, node, p = live[ok], node[ok], p[ok] + 1
                token = self._token[node]
                ends = token >= 0
                best[live[ends]], reach[live[ends]] = token[ends], p[ends]
                more = p < end[word[live]]
                live, node, p = live[more], node[more], p[more]
            of.append(word)
            tokens.append(best)
            go = reach < end[word]
            word, at = word[go], reach[go]
        of, tokens = np.concatenate(of), np.concatenate(tokens)
        order = np.argsort(of, kind="stable")
        return of[order], tokens[order]

    def greedy_one(self, word: bytes) -> list[int]:
        """Longest-match tokens of one word, byte by byte."""
        walk, ends, out, at, n = self._walk, self._ends, [], 0, len(word)
        while at < n:
            node, p, best, reach = 0, at, -1, at
            while p < n and (node := walk.get(node << 8 | word[p])) is not None:
                p += 1
                if ends[node] >= 0:
                    best, reach = ends[node], p
            out.append(best)
            at = reach
        return out

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Whether merging the bytes of left and right gives just them (right -1: just left). All adjacent
        pairs fit exactly when the tokens are those that merging the whole word would give."""
        key, back = np.unique(left.astype(np.int64) << 32 | (right.astype(np.int64) + 1), return_inverse=True)
        if len(self._pairs) > PAIRS_KEPT:
            self._pairs = {}
        known = self._pairs
        for k in key.tolist():
            if k not in known:
                pair = [k >> 32, (k & 0xFFFFFFFF) - 1] if k & 0xFFFFFFFF else [k >> 32]
                known[k] = self.merge(b"".join(self.bytes[i] for i in pair)) == pair
        return np.fromiter(map(known.__getitem__, key.tolist()), bool, len(key))[back]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word (not empty), as little-endian unsigned 32-bit integers: proposed greedily, checked
        pair by pair, and merged exactly where a check fails."""
        out: list[bytes] = [b""] * len(words)
        together = [i for i, w in enumerate(words) if len(w) <= LONG]
        together = together if len(together) >= FEW else []
        of, tokens = self.greedy([words[i] for i in together]) if together else (np.zeros(0, np.int64), np.zeros(0, np.int32))
        alone = sorted(set(range(len(words))) - set(together))
        own = [self.greedy_one(words[i]) for i in alone]
        of = np.concatenate([of, np.repeat(np.arange(len(own)) + len(together), [len(t) for t in own])]).astype(np.int64)
        tokens = np.concatenate([tokens, np.array([t for part in own for t in part], np.int32)])
        last = np.concatenate([of[1:] != of[:-1], [True]])
        fit = self._fits(tokens, np.full(len(tokens), -1))
        inner = np.flatnonzero(~last)
        fit[inner] &= self._fits(tokens[inner], tokens[inner + 1])
        cut = np.searchsorted(of, np.arange(len(words) + 1))
        failed = np.zeros(len(words), bool)
        failed[of[~fit]] = True
        packed = tokens.astype("<u4").tobytes()
        for n, i in enumerate([*together, *alone]):
            out[i] = np.array(self.merge(words[i]), "<u4").tobytes() if failed[n] else packed[4 * cut[n] : 4 * cut[n + 1]]
        return out

    def pretokens(self, text: str) -> list[str]:
        """Pre-tokens in order; special tokens stand alone."""
        if self._split is None or not any(s in text for s in self.special):
            return self._pretokens(text)
        return [w for part in self._split.split(text) if part for w in ([part] if part in self.special else self._pretokens(part))]

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of every word, from memory or encoded now."""
        new = [w for w in words if w not in self._known]
        if new:
            if len(self._known) + len(new) > WORDS_KEPT:
                self._known = {}
                new = list(words)
            special = [w for w in new if w in self.special]
            self._known.update((w, np.array([self.special[w]], "<u4").tobytes()) for w in special)
            plain = [w for w in new if w not in self.special]
            words = [w.encode() for w in plain]
            self._known.update(zip(plain, self.encode_words(words) if words else [], strict=True))
        return self._known

    def encode_texts(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, packed."""
        split = [self.pretokens(t) for t in texts]
        ids = self.learn(set().union(*split)).__getitem__
        return [b"".join(map(ids, words)) for words in split]

    def decode(self, packed: bytes) -> str:
        """The text of packed ids; bytes that aren't UTF-8 become U+FFFD."""
        return b"".join(map(self.bytes.__getitem__, np.frombuffer(packed, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def tokenizer(path: str) -> ByteBpe:
    """One vocabulary per worker process."""
    return ByteBpe(path)


def text_runs(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of about RUN characters at a time; null counts as empty."""
    size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    at = np.concatenate([[0], np.cumsum(size, dtype=np.int64)])
    i = 0
    while i < len(size):
        j = max(i + 1, int(np.searchsorted(at, at[i] + RUN, side="right")) - 1)
        yield i, [t or "" for t in column.slice(i, j - i).to_pylist()]
        i = j


def bpe_encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decode: bool = False) -> DataFrame:
    """id, ``n_tokens``, ``ids`` (packed little-endian unsigned 32-bit integers) and, on request, ``decoded`` of every row.

    ``path`` names a byte-level BPE file that every executor can open. The strings of its added
    tokens are those tokens, wherever they stand. Each pre-token gets greedy longest-match tokens, all
    new pre-tokens of a run of texts in lockstep through a trie; then every adjacent pair of tokens
    is tested: would merging their bytes give these two? If all fit, the tokens are right; only words
    with a misfit are merged exactly. Nothing is shuffled.

    Null and empty texts have no ids and decode to the empty text. Rows keep their ids, null or
    repeated. Empty table: empty result. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for i, texts in text_runs(batch.column(1)):
                ids = bpe.encode_texts(texts)
                columns = [batch.column(0).slice(i, len(texts)), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decode:
                    columns.append(pa.array([bpe.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "ids", "decoded"][: len(columns)])

    return rows.mapInArrow(B.tidied(run), f"id {kind}, n_tokens long, ids binary" + ", decoded string" * decode).withColumnRenamed("id", id_col)


def bpe_decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id and ``decoded`` text of packed ids; null ids decode to the empty text."""
    rows = df.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([bpe.decode(x or b"") for x in part.column(1).to_pylist()], pa.string())], ["id", "decoded"])

    return rows.mapInArrow(B.tidied(run), f"id {kind}, decoded string").withColumnRenamed("id", id_col)
