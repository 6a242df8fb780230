"""Packing tokenized documents into sequences by minimum bin slack.

The fullest combination of lengths depends only on which lengths are left and how often, so bins are planned on the
histogram of lengths: a combination is taken for as many bins as its lengths allow. The pieces then find their
places by their rank among those of the same length.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import ranked, staged

#: Bounds of what a worker remembers of words and their ids. Past them it forgets what it hasn't met since the last time.
WORDS_KEPT, CHARS_KEPT = 300_000, 8_000_000
#: Words that the tokenizer is given at a time, and characters of text that are worked on together, one text at least.
TOGETHER, RUN = 4096, 1 << 22
#: The tokenizer's pattern of a word in lower case, and what ends the last token of each.
WORD, END = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+", "</w>"


class WordIds:
    """Ids of whole texts by a public tokenizer that lowers case and whose words never reach across white space.

    A run of texts is split at ASCII white space, where the tokenizer always parts words. Each different piece is
    parted into words, and each word is encoded once and remembered; the tokenizer gets many new words in one text,
    whose tokens are told apart by the mark of a word's end. The pieces' ids are then laid out for all texts at once. Where lower case and
    normal form might not commute, or a special token's string appears, the piece goes to the tokenizer as it is.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        self._special = [t.content for t in self._tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self._tokenizer.get_vocab()
        self._ends = np.zeros(1 + max(vocabulary.values()), bool)
        self._ends[[i for token, i in vocabulary.items() if token.endswith(END)]] = True
        self._find = regex.compile(WORD).findall
        self._pieces, self._words = _Memory(), _Memory()

    def _lower(self, text: str) -> str:
        """The text in lower case if its ids are surely the same."""
        low = text.lower()
        if not text.isascii() and ("Σ" in text or not is_normalized("NFC", text) or not is_normalized("NFC", low)):
            return text
        return text if any(s in low for s in self._special) else low

    def _plain(self, piece: str) -> bool:
        """Whether a piece is in lower case and normal form and holds no special token."""
        return piece == piece.lower() and (piece.isascii() or is_normalized("NFC", piece)) and not any(s in piece for s in self._special)

    def _whole(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """Ids of new words, many in one text; one by one if the tokens' ends don't tell them apart."""
        for i in range(0, len(words), TOGETHER):
            part = words[i : i + TOGETHER]
            ids = np.array(self._tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            cuts = 4 * (np.flatnonzero(self._ends[ids]) + 1)
            packed = ids.tobytes()
            if len(cuts) == len(part) and (not len(cuts) or cuts[-1] == len(packed)):
                cuts = cuts.tolist()
                self._words.now.update(zip(part, (packed[a:b] for a, b in zip([0, *cuts], cuts, strict=False)), strict=True))
            else:
                self._words.now.update(zip(part, self._whole(part), strict=True))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: empty), as little-endian unsigned 32-bit integers."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "").take(pa.array(np.arange(len(texts))))  # a slice's own copy
        ascii_ = pc.string_is_ascii(texts)
        simple = pc.and_(ascii_, pc.invert(pc.match_substring(texts, "<")))
        other = pa.array([self._lower(t) for t in texts.filter(pc.invert(simple)).to_pylist()], pa.large_string())
        texts = pc.replace_with_mask(pc.ascii_lower(texts), pc.invert(simple), other)
        split = pc.ascii_split_whitespace(texts)
        pieces = split.flatten().dictionary_encode()
        ids = self._pieces_of(pieces.dictionary)
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, at = np.cumsum(length) - length, pieces.indices.to_numpy()
        count = length[at]
        end = np.cumsum(count)
        every = np.frombuffer(b"".join(ids), "<u4")
        packed = every[np.repeat(start[at] - (end - count), count) + np.arange(end[-1] if len(end) else 0)].tobytes()
        cuts = np.concatenate([[0], end])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        cuts = (4 * cuts).tolist()
        return [packed[i:j] for i, j in zip(cuts, cuts[1:], strict=False)]

    def _pieces_of(self, different: pa.Array) -> list[bytes]:
        """The ids of different pieces."""
        every = different.to_numpy(zero_copy_only=False).tolist()
        new = self._pieces.unknown(every)
        array = pa.array(new, pa.large_string())
        words = pc.and_(pc.ascii_is_alpha(array), pc.and_(pc.string_is_ascii(array), pc.ascii_is_lower(array))).to_numpy(zero_copy_only=False).tolist()
        plain, parted, odd = [], [], []
        for piece, word in zip(new, words, strict=True):
            if word:
                plain.append(piece)
                parted.append((piece,))
            elif self._plain(piece):
                plain.append(piece)
                parted.append(self._find(piece))
            else:
                odd.append(piece)
        self._pieces.now.update(zip(odd, self._whole(odd), strict=True))
        self._learn(self._words.unknown(list(set().union(*parted))))
        ids = self._words.now.__getitem__
        self._pieces.now.update([(p, ids(w[0]) if len(w) == 1 else b"".join(map(ids, w))) for p, w in zip(plain, parted, strict=True)])
        return list(map(self._pieces.now.__getitem__, every))


def text_slices(column: pa.Array) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of about RUN bytes at a time."""
    at = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    i = 0
    while i < len(at):
        j = max(i + 1, int(np.searchsorted(at, (at[i - 1] if i else 0) + RUN, side="right")))
        yield i, column.slice(i, j - i)
        i = j


class _Memory:
    """Ids by word: those met lately (``now``) and, until enough others have come, those met before."""

    def __init__(self):
        self.now: dict[str, bytes] = {}
        self._before: dict[str, bytes] = {}
        self._chars = 0

    def unknown(self, words: list[str]) -> list[str]:
        """The words (all different) to be learnt; the others are in ``now`` until the next call."""
        if len(self.now) > WORDS_KEPT or self._chars > CHARS_KEPT:
            self.now, self._before, self._chars = {}, self.now, 0
        now, before = self.now, self._before
        missing = [w for w in words if w not in now]
        now.update([(w, before[w]) for w in missing if w in before])
        new = [w for w in missing if w not in before]
        self._chars += sum(map(len, missing))
        return new


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    """One tokenizer per worker process."""
    return WordIds(path)


def token_pieces(df: DataFrame, path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's ids, then ``end_id``, cut into pieces of ``capacity`` tokens (the last one may be shorter):
    id, ``piece`` (from 0), ``start`` (ids of the document before it), ``length``, ``ids`` (packed little-endian unsigned
    32-bit integers).

    ``path`` names a tokenizer file that every executor can open and whose words end at ASCII white space. A null or
    empty text is ``end_id`` alone. Rows keep their ids, null or repeated. Nothing is shuffled. Empty table: empty
    result. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind, size, end = rows.schema["id"].dataType.simpleString(), 4 * capacity, np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = _word_ids(path)
        for batch in batches:
            for i, texts in text_slices(batch.column(1)):
                cut = [[ids[a : a + size] for a in range(0, len(ids), size)] for ids in (x + end for x in words.encode(texts))]
                row = np.repeat(np.arange(i, i + len(cut)), [len(c) for c in cut])
                piece = np.concatenate([np.arange(len(c)) for c in cut]).astype(np.int32)
                ids = [x for c in cut for x in c]
                length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
                columns = [batch.column(0).take(pa.array(row)), pa.array(piece), pa.array(piece.astype(np.int64) * capacity), pa.array(length), pa.array(ids, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["id", "piece", "start", "length", "ids"])

    return rows.mapInArrow(run, f"id {kind}, piece int, start long, length long, ids binary").withColumnRenamed("id", id_col)


#: Which lengths a selection prefers among those that are equally full, by length and number left: those that hold the
#: most tokens, the longest, the most frequent.
PREFERENCES = (lambda length, n: (-length * n, -length), lambda length, n: (-length,), lambda length, n: (-n, -length))


def fullest(counts: dict[int, int], room: int, preference=PREFERENCES[1]) -> list[tuple[int, int]]:
    """(length, copies) of a selection from ``counts`` with the largest sum that ``room`` allows.

    Bit s of a bit set says that sum s can be made. Sums are made from the least preferred lengths to the most
    preferred ones and traced back, each length taking as many copies as the sum still allows.
    """
    sums, mask, stages = 1, (1 << (room + 1)) - 1, []
    for length in sorted((x for x, n in counts.items() if n and x <= room), key=lambda x: preference(x, counts[x]), reverse=True):
        copies, step = min(counts[length], room // length), 1
        stages.append((length, copies, sums))
        while copies:
            step = min(step, copies)
            sums |= (sums << (step * length)) & mask
            copies, step = copies - step, 2 * step
    target, taken = sums.bit_length() - 1, []
    for length, most, before in reversed(stages):
        copies = min(most, target // length)
        while not before >> (target - copies * length) & 1:
            copies -= 1
        if copies:
            taken.append((length, copies))
            target -= copies * length
    return taken


def patterns_by(counts: dict[int, int], capacity: int, preference) -> list[tuple[int, list[tuple[int, int]]]]:
    """``bin_patterns`` by one preference.

    Every bin starts with the longest length left and is filled up by the ``fullest`` of the others. As a selection
    stays the fullest while it can be made at all, it is repeated until one of its lengths runs out, so the
    work depends on the number of different lengths and not on that of pieces.
    """
    left, out = {length: n for length, n in counts.items() if n}, []
    while left:
        longest = max(left)
        left[longest] -= 1
        taken = dict(fullest(left, capacity - longest, preference))
        left[longest] += 1
        taken[longest] = taken.get(longest, 0) + 1
        bins = min(left[length] // copies for length, copies in taken.items())
        for length, copies in taken.items():
            left[length] -= bins * copies
            if not left[length]:
                del left[length]
        out.append((bins, sorted(taken.items(), reverse=True)))
    return out


def bin_patterns(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(bins, [(length, copies in each)]) that hold every piece of a histogram of lengths from 1 to ``capacity``: of the
    plans by each preference, the one of the fewest bins."""
    return min((patterns_by(counts, capacity, p) for p in PREFERENCES), key=lambda plan: sum(bins for bins, _ in plan))


def _places(patterns: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """Where the pieces of a length go, by rank: runs of (length, first rank, first bin, copies a bin, offset), sorted."""
    runs, used, first = [], {}, 0
    for bins, pattern in patterns:
        offset = 0
        for length, copies in pattern:
            runs.append((length, used.get(length, 0), first, copies, offset))
            used[length] = used.get(length, 0) + bins * copies
            offset += length * copies
        first += bins
    return tuple(np.array(c, np.int64) for c in zip(*sorted(runs), strict=True))


def pack_pieces(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``: every piece (a row with a ``length`` from 1 to ``capacity``) in a
    sequence of at most ``capacity`` tokens, offsets gapless from 0 in each.

    The histogram of lengths, at most ``capacity`` rows, goes to the driver, and the plan made from it, with at most
    some thousand runs of ranks whatever the number of pieces, goes to the tasks. Ranks come from a range-partitioned
    sort, so a length that very many pieces have is dealt out. Repeated rows each get a place of their own. Empty
    table: empty result. A length out of bounds, or null, is an error.
    """
    pieces = staged(pieces)
    bad = pieces.where(F.col("length").isNull() | ~F.col("length").between(1, capacity))
    if not bad.isEmpty():
        raise ValueError(f"lengths must be from 1 to {capacity}")
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return pieces.withColumns({"sequence_id": F.lit(0).cast("long"), "offset": F.lit(0).cast("long")})
    length, rank, first, copies, offset = _places(bin_patterns(counts, capacity))
    key = length << 48 | rank
    names = pieces.columns
    order = ranked(pieces.withColumn("__row", F.monotonically_increasing_id()), ["__row"], group="length", rank="__rank").select(*names, "__rank")
    at = names.index("length")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, r = batch.column(at).to_numpy().astype(np.int64), batch.column(len(names)).to_numpy().astype(np.int64)
            i = np.searchsorted(key, n << 48 | r, side="right") - 1
            bins, slot = np.divmod(r - rank[i], copies[i])
            columns = [*batch.columns[: len(names)], pa.array(first[i] + bins), pa.array(offset[i] + slot * n)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return order.mapInArrow(run, f"{schema}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """``sequence_id``, ``n_pieces``, ``length`` and ``ids`` of every packed sequence; a sequence's rows are few and hold at
    most its capacity."""
    rows = packed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    joined = F.aggregate("p", F.lit(b""), lambda whole, x: F.concat(whole, x["ids"]))
    return rows.select("sequence_id", F.size("p").alias("n_pieces"), F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + x["length"]).alias("length"), joined.alias("ids"))
