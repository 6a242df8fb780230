"""Edit-aware token counts: a table of pre-token segment trees, re-encoded only where edits touch.

``token_trees`` makes the trees of documents, ``with_edits`` puts an edit log beside them, and ``edit_trees`` gives
the trees and counts after the edits; its result is again a table of trees. The text lives in the leaves, so an
edit reads and writes only the leaves around it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import PATTERN, ByteBpe, text_runs, tokenizer

#: Pre-tokens in a new leaf of the tree; a leaf holds at most FULL times as many.
LEAF, FULL = 64, 4
#: Characters that a pre-token's match may look at beyond its own end: the one after a run of white space, and the
#: letters of a contraction.
CONTEXT = 3

#: A tree as a column: the texts of its leaves, the pre-tokens in each, and every pre-token's characters and tokens
#: (little-endian unsigned 32-bit integers). The sums above the leaves follow from these.
TREE = "struct<texts:array<string>,sizes:binary,chars:binary,tokens:binary>"
EDITS = "array<struct<start:int,end:int,put:string>>"
_TREE = pa.struct([("texts", pa.list_(pa.string())), ("sizes", pa.binary()), ("chars", pa.binary()), ("tokens", pa.binary())])
_EDITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("put", pa.string())]))


class SegmentTree:
    """Leaves of (text, characters and tokens of its pre-tokens), with sums up a binary tree."""

    def __init__(self, text: str, chars: list[int], tokens: list[int]):
        self._fill(text, chars, tokens)

    @classmethod
    def of(cls, leaves: list[list]) -> SegmentTree:
        """A tree over leaves as they are."""
        tree = cls.__new__(cls)
        tree.leaves = leaves
        tree._sum()
        return tree

    def _fill(self, text: str, chars: list[int], tokens: list[int]) -> None:
        self.leaves, at = [], 0
        for i in range(0, len(chars), LEAF):
            n = sum(chars[i : i + LEAF])
            self.leaves.append([text[at : at + n], chars[i : i + LEAF], tokens[i : i + LEAF]])
            at += n
        self._sum()

    def _sum(self) -> None:
        width = self.width = 1 << max(0, len(self.leaves) - 1).bit_length()
        pad = [0] * (width - len(self.leaves))
        self._chars = [0] * width + [len(x[0]) for x in self.leaves] + pad
        self._tokens = [0] * width + [sum(x[2]) for x in self.leaves] + pad
        for values in (self._chars, self._tokens):
            for node in range(width - 1, 0, -1):
                values[node] = values[2 * node] + values[2 * node + 1]

    @property
    def tokens(self) -> int:
        return self._tokens[1]

    @property
    def chars(self) -> int:
        return self._chars[1]

    @property
    def text(self) -> str:
        return "".join(x[0] for x in self.leaves)

    def find(self, char: int) -> tuple[int, int]:
        """The leaf that holds a character, and the characters before that leaf."""
        node, before, sums = 1, 0, self._chars
        while node < self.width:
            node *= 2
            if char - before >= sums[node] and sums[node + 1]:
                before += sums[node]
                node += 1
        return min(node - self.width, max(0, len(self.leaves) - 1)), before

    def replace(self, first: int, last: int, text: str, chars: list[int], tokens: list[int]) -> None:
        """Put pre-tokens in place of leaves first..last and update the sums above; leaves that would get too full
        make the tree anew."""
        count = last - first + 1
        if len(chars) > FULL * LEAF * count:
            before, after = self.leaves[:first], self.leaves[last + 1 :]
            flat = lambda k, middle: [v for x in before for v in x[k]] + middle + [v for x in after for v in x[k]]
            self._fill("".join(x[0] for x in before) + text + "".join(x[0] for x in after), flat(1, chars), flat(2, tokens))
            return
        size, at = max(1, -(-len(chars) // count)), 0
        for k in range(count):
            part = chars[k * size : (k + 1) * size]
            n = sum(part)
            self.leaves[first + k] = [text[at : at + n], part, tokens[k * size : (k + 1) * size]]
            at += n
            for values, total in ((self._chars, n), (self._tokens, sum(self.leaves[first + k][2]))):
                node = self.width + first + k
                change = total - values[node]
                while change and node:
                    values[node] += change
                    node //= 2


class CountedText:
    """A text's tree, kept in step with the text through edits. The tree counts bytes of packed ids."""

    def __init__(self, bpe: ByteBpe, text: str, words: list[str] | None = None, known: dict[str, bytes] | None = None):
        words = bpe.pretokens(text) if words is None else words
        known = bpe.learn(set(words)) if known is None else known
        self._start(bpe, SegmentTree(text, list(map(len, words)), list(map(len, map(known.__getitem__, words)))), any(s in text for s in bpe.special))

    @classmethod
    def of(cls, bpe: ByteBpe, tree: dict) -> CountedText:
        """From a tree column's value; nothing is encoded."""
        sizes, chars, tokens = (np.frombuffer(tree[c], "<u4").tolist() for c in ("sizes", "chars", "tokens"))
        leaves, at = [], 0
        for text, n in zip(tree["texts"], sizes, strict=True):
            leaves.append([text, chars[at : at + n], [4 * t for t in tokens[at : at + n]]])
            at += n
        made, whole = cls.__new__(cls), "".join(tree["texts"])
        made._start(bpe, SegmentTree.of(leaves), any(s in whole for s in bpe.special))
        return made

    def _start(self, bpe: ByteBpe, tree: SegmentTree, special: bool) -> None:
        self.bpe, self.tree, self.encoded = bpe, tree, 0
        self._widest, self._special = max([0, *map(len, bpe.special)]), special

    def packed(self) -> dict:
        """The tree as a column's value."""
        leaves = self.tree.leaves
        flat = lambda k: np.fromiter((v for x in leaves for v in x[k]), np.int64)
        as_bytes = lambda v: v.astype("<u4").tobytes()
        return {"texts": [x[0] for x in leaves], "sizes": as_bytes(np.array([len(x[1]) for x in leaves])), "chars": as_bytes(flat(1)), "tokens": as_bytes(flat(2) // 4)}

    @property
    def n_tokens(self) -> int:
        return self.tree.tokens // 4

    @property
    def text(self) -> str:
        return self.tree.text

    def edit(self, start: int, end: int, put: str) -> None:
        """Replace the characters start..end (cut to the text) and recount: from the last pre-token boundary that
        cannot have looked at the edit, until new and old boundaries meet behind it. The leaves read are those
        around the edit, twice as many each time that boundaries don't meet."""
        tree, length = self.tree, self.tree.chars
        start = min(max(0, start), length)
        end = min(max(start, end), length)
        if not length:
            again = CountedText(self.bpe, put)
            self.tree, self._special = again.tree, again._special
            self.encoded += sum(len(x[1]) for x in again.tree.leaves)
            return
        shift = len(put) - (end - start)
        first, at = tree.find(max(0, start - CONTEXT - self._widest - 1))
        last, _ = tree.find(min(end + CONTEXT + self._widest, length - 1))
        while True:
            old = "".join(x[0] for x in tree.leaves[first : last + 1])
            whole = at + len(old) == length
            new = old[: start - at] + put + old[end - at :]
            around = new[max(0, start - at - self._widest) : start - at + len(put) + self._widest]
            special = self._special or any(s in around for s in self.bpe.special)
            found = self._met(new, [n for x in tree.leaves[first : last + 1] for n in x[1]], start - at, end - at, shift, whole, special)
            if found:
                break
            last = min(len(tree.leaves) - 1, last + (last - first + 1))
        keep, words, resume = found
        self._special = special
        known = self.bpe.learn(set(words))
        self.encoded += len(words)
        join = lambda k, middle: (flat := [v for x in tree.leaves[first : last + 1] for v in x[k]])[:keep] + middle + flat[resume:]
        tree.replace(first, last, new, join(1, list(map(len, words))), join(2, [len(known[w]) for w in words]))

    def _met(self, new: str, chars: list[int], start: int, end: int, shift: int, whole: bool, special: bool) -> tuple[int, list[str], int] | None:
        """(old pre-tokens kept, new ones, old ones resumed at) within a stretch of text, or None if its end comes first."""
        bounds = list(accumulate(chars, initial=0))
        keep = max(0, bisect_right(bounds, start - CONTEXT - self._widest * special) - 1)
        at, beyond = bounds[keep], end + shift
        slack = 0 if whole else CONTEXT + self._widest
        words: list[str] = []
        for word in self._from(new, at, special):
            if at >= beyond and at + slack <= len(new):
                i = bisect_right(bounds, at - shift) - 1
                if bounds[i] == at - shift:
                    return keep, words, i
            if not whole and at + slack > len(new):
                return None
            words.append(word)
            at += len(word)
        return (keep, words, len(chars)) if whole else None

    def _from(self, text: str, at: int, special: bool) -> Iterator[str]:
        """Pre-tokens from a boundary on; a special token ends what stands before it."""
        if not special:
            yield from (m.group() for m in _PRE.finditer(text, at))
            return
        while at < len(text):
            word = next((s for s in self.bpe.special if text.startswith(s, at)), None)
            if word is None:
                stop = min([len(text), *(x for s in self.bpe.special if (x := text.find(s, at)) >= 0)])
                word = _PRE.match(text, at, stop).group()
            yield word
            at += len(word)


_PRE = regex.compile(PATTERN)


def packed_tree(text: str, words: list[str], ids: list[bytes]) -> tuple[int, dict]:
    """Tokens of a text, and the tree column's value of its pre-tokens, leaf by leaf, without building the tree."""
    chars = np.fromiter(map(len, words), "<u4", len(words))
    tokens = np.fromiter(map(len, ids), "<u4", len(ids)) // np.uint32(4)
    cuts = [0, *np.cumsum(chars, dtype=np.int64)[LEAF - 1 : -1 : LEAF].tolist(), len(text)] if words else []
    sizes = np.full(len(cuts[1:]), LEAF, "<u4")
    sizes[-1:] = len(words) - LEAF * (len(sizes) - 1)
    texts = [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    return int(tokens.sum()), {"texts": texts, "sizes": sizes.tobytes(), "chars": chars.tobytes(), "tokens": tokens.tobytes()}


def pattern_edits(text: str, finders: list[tuple[regex.Pattern, str]]) -> list[dict]:
    """Every match of each pattern in the text as it then is, from the last to the first, as edits to apply in order."""
    out = []
    for finder, put in finders:
        spans = [m.span() for m in finder.finditer(text)]
        out += [{"start": a, "end": b, "put": put} for a, b in reversed(spans)]
        cuts = [0, *(x for span in spans for x in span), len(text)]
        text = put.join(text[a:b] for a, b in zip(cuts[::2], cuts[1::2], strict=True))
    return out


def token_trees(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", patterns: list[tuple[str, str]] | None = None) -> DataFrame:
    """id, ``n_tokens`` and ``tree`` of every row; with ``patterns`` (regular expression, replacement) also the ``edits``
    that put the replacements in place of all matches, pattern by pattern.

    ``path`` names a byte-level BPE file. A null or empty text has an empty tree. Rows keep their ids, null or
    repeated. Nothing is shuffled. Empty table: empty result. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        finders = [(regex.compile(p), put) for p, put in patterns or []]
        for batch in batches:
            for i, texts in text_runs(batch.column(1)):
                split = [bpe.pretokens(t) for t in texts]
                known = bpe.learn(set().union(*split)).__getitem__
                trees = [packed_tree(t, words, list(map(known, words))) for t, words in zip(texts, split, strict=True)]
                columns = [batch.column(0).slice(i, len(texts)), pa.array([n for n, _ in trees], pa.int64()), pa.array([t for _, t in trees], _TREE)]
                if patterns is not None:
                    columns.append(pa.array([pattern_edits(t, finders) for t in texts], _EDITS))
                yield pa.RecordBatch.from_arrays(columns, ["id", "n_tokens", "tree", "edits"][: len(columns)])

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, tree {TREE}" + f", edits {EDITS}" * (patterns is not None)).withColumnRenamed("id", id_col)


def with_edits(trees: DataFrame, log: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Trees with the ``edits`` of a log (id, seq, start, end, put), in the order of ``seq``; a document's edits are as
    much of one row as the document is. A null ``put`` puts nothing; edits of ids without a tree are left out."""
    one = F.struct("seq", F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("put", F.lit("")).alias("put"))
    each = log.select(F.col(id_col).alias("__id"), one.alias("e")).groupBy("__id").agg(F.array_sort(F.collect_list("e")).alias("e"))
    edits = F.transform("e", lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["put"].alias("put")))
    return trees.join(each.select("__id", edits.alias("edits")), F.col(id_col).eqNullSafe(F.col("__id")), "left").drop("__id")


def edit_trees(trees: DataFrame, path: str, id_col: str = "doc_id", keep: bool = True) -> DataFrame:
    """id, ``n_tokens`` before, ``n_edits``, ``n_tokens_edited``, ``n_pretokens`` before, ``n_reencoded`` and, with ``keep``,
    the ``tree`` after the edits, from rows (id, tree, edits).

    Edits are applied one by one: each names characters of the text as the edits before it left it, and is cut
    to that text. ``n_reencoded`` counts the pre-tokens encoded again. A null list has no edits; a null tree is
    empty. Rows keep their ids, null or repeated. Nothing is shuffled.
    """
    rows = trees.select(F.col(id_col).alias("id"), "tree", F.col("edits").cast(EDITS).alias("edits"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded", "tree"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        for batch in batches:
            for i in range(0, batch.num_rows, 256):
                part = batch.slice(i, 256)
                counts, after = [], []
                for tree, edits in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    if tree and not edits:
                        n = int(np.frombuffer(tree["tokens"], "<u4").sum())
                        counts.append((n, 0, n, len(tree["tokens"]) // 4, 0))
                        after.append(tree)
                        continue
                    counted = CountedText.of(bpe, tree) if tree else CountedText(bpe, "")
                    before, n = counted.n_tokens, sum(len(x[1]) for x in counted.tree.leaves)
                    for e in edits or []:
                        counted.edit(e["start"], e["end"], e["put"] or "")
                    counts.append((before, len(edits or []), counted.n_tokens, n, counted.encoded))
                    after.append(counted.packed() if keep else None)
                columns = [part.column(0), *(pa.array(c, pa.int64()) for c in zip(*counts, strict=True))]
                yield pa.RecordBatch.from_arrays([*columns, *([pa.array(after, _TREE)] if keep else [])], names[: len(columns) + keep])

    return rows.mapInArrow(run, f"id {kind}, n_tokens long, n_edits long, n_tokens_edited long, n_pretokens long, n_reencoded long" + f", tree {TREE}" * keep).withColumnRenamed("id", id_col)


def edited_token_counts(df: DataFrame, path: str, edits: list[tuple[str, str]], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, ``n_tokens``, ``n_edits``, ``n_tokens_edited``, ``n_pretokens``, ``n_reencoded`` of every row: the counts of
    ``edit_trees`` on the trees of ``token_trees`` with the edits of its ``patterns``.

    Each text is encoded once, and a text with edits has its tree made, edited and counted where it is read, so
    no tree leaves its task. Null and empty texts have no tokens and no edits. Nothing is shuffled. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    names = ["id", "n_tokens", "n_edits", "n_tokens_edited", "n_pretokens", "n_reencoded"]

    def counts(bpe: ByteBpe, text: str, words: list[str], known: dict[str, bytes], finders: list) -> tuple[int, ...]:
        todo = pattern_edits(text, finders)
        if not todo:
            n = sum(map(len, map(known.__getitem__, words))) // 4
            return n, 0, n, len(words), 0
        counted = CountedText(bpe, text, words, known)
        before = counted.n_tokens
        for e in todo:
            counted.edit(e["start"], e["end"], e["put"])
        return before, len(todo), counted.n_tokens, len(words), counted.encoded

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokenizer(path)
        finders = [(regex.compile(p), put) for p, put in edits]
        for batch in batches:
            for i, texts in text_runs(batch.column(1)):
                split = [bpe.pretokens(t) for t in texts]
                known = bpe.learn(set().union(*split))
                found = [counts(bpe, t, words, known, finders) for t, words in zip(texts, split, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, len(texts)), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))], names)

    return rows.mapInArrow(run, f"id {kind}, " + ", ".join(f"{n} long" for n in names[1:])).withColumnRenamed("id", id_col)
