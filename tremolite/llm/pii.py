"""Personal data: checked base formats, and identifiers found by bootstrapped contextual patterns.

Seed entities (the base matches, and long values that mix letters and digits) induce lexical
patterns: the words and signs before a value, and the value's own shape. Patterns and values form a
graph; rounds of scoring let seeds vouch for patterns and patterns for values. Patterns that end
with high confidence and enough different values discover the values that no seed rule knows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bytesets as B
from .staging import matched, staged

KINDS = ("email", "ip", "card", "phone", "secret")
#: What a value that only patterns vouch for keeps of its best pattern's confidence.
TRUST = 0.9
CONFIDENCE = 0.6
SUPPORT = 5

#: What may stand before the @ of an e-mail address, and what must follow it.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Runs of digits are taken whole (a shorter one is followed by a digit, not a dot), so a long run costs one look.
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
#: Values of six letters and digits or more, however long; a run is taken whole, so it costs one look.
_VALUE = re.compile(r"(?<![A-Za-z0-9_])[A-Za-z0-9_]{6,}+")
#: A pattern names the word before a value by its last letters (at most 24) and the signs between (at most 4).
_BEFORE = re.compile(r"([^\W\d_]{1,24})([^\w\n]{1,4})\Z")
#: A word and the signs behind it, from the word's first letter on so that a long run of letters costs one look.
_KEY = re.compile(r"(?<![^\W\d_])([^\W\d_]++)([^\w\n]{1,4}+)")
_TOKEN = re.compile(r"\S+")
#: Letters and digits joined by single signs, as in keys of several parts; what closes a quotation or a sentence.
_JOINED = re.compile(r"[A-Za-z0-9_]++(?:[-./+~:][A-Za-z0-9_]++)*+=*+")
CLOSING = "\"'`.,;:!?)]}>»”’"
#: Words that a task of the second reading remembers; past them it forgets and goes on.
WORDS_KEPT = 200_000
#: Slots of the map of pattern hashes that the second reading gets, whatever the number of patterns.
SLOTS = 1 << 20
_TURN = re.compile(r"(?<=[A-Za-z])(?=[0-9])|(?<=[0-9])(?=[A-Za-z])")


def luhn(digits: str) -> bool:
    """Whether the Luhn sum of the digits is a multiple of ten."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        d = int(d) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping addresses, found from their @ signs."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return found


def base_spans(text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    """(start, kind, end) of the base matches in order, and the spans of those that have a base kind's length but failed its check."""
    found = [(a, 0, b) for a, b in emails(text)]
    failed = []
    for m in _IP.finditer(text):
        parts = m.group().split(".")
        if all(len(p) <= 3 and int(p or "0") <= 255 for p in (q.lstrip("0") for q in parts)):
            found.append((m.start(), 1, m.end()))
        elif all(len(p) <= 3 for p in parts):
            failed.append(m.span())
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19:
            found.append((m.start(), 2, m.end())) if luhn(digits) else failed.append(m.span())
    for m in _PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m.group()) <= 15:
            found.append((m.start(), 3, m.end()))
    return sorted(found), failed


class Taken:
    """Which spans of a text may not be added: those that overlap a base match, or lie wholly in a failed one."""

    def __init__(self, base: list[tuple[int, int, int]], failed: list[tuple[int, int]]):
        self.base = self._reach([(a, b) for a, _, b in base])
        self.failed = self._reach(failed)

    @staticmethod
    def _reach(spans: list[tuple[int, int]]) -> tuple[list[int], list[int]]:
        spans = sorted(spans)
        return [a for a, _ in spans], list(accumulate((b for _, b in spans), max))

    def overlaps(self, start: int, end: int) -> bool:
        i = bisect_left(self.base[0], end)
        return i > 0 and self.base[1][i - 1] > start

    def covers(self, start: int, end: int) -> bool:
        i = bisect_right(self.failed[0], start)
        return i > 0 and self.failed[1][i - 1] >= end


def patterns(text: str, start: int, end: int) -> list[str]:
    """The lexical patterns of a value: what stands before it, and its shape."""
    value = text[start:end]
    letters = re.match(r"[A-Za-z]*", value).group()
    signs = "".join(sorted({"9" if c.isdigit() else "A" if c.isupper() else "a" if c.islower() else c for c in value}))[:8]
    found = [f"shape {letters[:4] if len(letters) >= 3 else ''} {signs} {len(value)}"]
    if m := _BEFORE.search(text, max(0, start - 28), start):
        found.append(f"before {m.group(1).lower()}|{m.group(2)}")
    return found


def seed_secret(value: str) -> bool:
    """Whether a value's form alone marks it: long, letters and digits in turn."""
    return len(value) >= 16 and sum(c.isdigit() for c in value) >= 2 and len(_TURN.findall(value)) >= 3


def read(text: str) -> tuple[list[dict], list[dict]]:
    """Base spans of a text, and the occurrences of base and other values with their patterns."""
    base, failed = base_spans(text)
    spans = [{"start": a, "kind": k, "end": b} for a, k, b in base]
    seen = [dict(s, value=hash_of(text[s["start"] : s["end"]]), seed=s["kind"], patterns=patterns(text, s["start"], s["end"])) for s in spans]
    taken = Taken(base, failed)
    for m in _VALUE.finditer(text):
        value = m.group()
        if not any(c.isdigit() for c in value):
            continue
        if taken.overlaps(*m.span()) or taken.covers(*m.span()):
            continue
        seen.append({"start": m.start(), "kind": 4, "end": m.end(), "value": hash_of(value), "seed": 4 if seed_secret(value) else -1, "patterns": patterns(text, m.start(), m.end())})
    return spans, seen


class Names:
    """Hashes of any stretch of a text, each in a fixed number of steps."""

    def __init__(self, text: str):
        self._sums = B.prefix_hashes(np.frombuffer(text.encode("utf-8", "replace"), np.uint8))
        self._at = None
        if not text.isascii():
            c = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
            self._at = np.concatenate([[0], np.cumsum(1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000), dtype=np.int64)])

    def __call__(self, start: int, end: int) -> int:
        """``hash_of`` the characters from start to end."""
        if self._at is not None:
            start, end = self._at[start], self._at[end]
        return int(B.hashes(self._sums, np.array([start]), np.array([end]))[0].view(np.int64))


def behind(text: str, slots: bytes, words: dict[str, bool]) -> list[dict]:
    """The tokens behind each word and signs whose pattern is in ``slots``; ``vote`` unless a value of ``read`` starts
    there and speaks for the pattern already.

    Such a token has the bounds of the value and of the parts that single signs join to it; any other is the
    non-space run without what closes a quotation or sentence at its end. ``words`` remembers which are in ``slots``.
    """
    found, taken, starts, end, name = [], None, {}, 0, None
    for m in _KEY.finditer(text):
        word = m.group(1)
        known = words.get(word)
        if known is None:
            if len(words) > WORDS_KEPT:
                words.clear()
            known = words[word] = bool(slots[crc32(f"before {word[-24:].lower()}".encode("utf-8", "replace")) % SLOTS])
        if not known:
            continue
        word = word[-24:].lower()
        for n in range(1, len(m.group(2)) + 1):
            start = m.start(2) + n
            if start >= len(text) or text[start].isspace():
                continue
            pattern = f"before {word}|{m.group(2)[:n]}"
            if not slots[crc32(pattern.encode("utf-8", "replace")) % SLOTS]:
                continue
            if taken is None:
                base, failed = base_spans(text)
                taken, name = Taken(base, failed), Names(text)
                starts = {a: None for a, _, _ in base} | {v.start(): None for v in _VALUE.finditer(text) if any(c.isdigit() for c in v.group())}
            if end <= start:
                end = _TOKEN.match(text, start).end()
            if start in starts and (joined := _JOINED.match(text, start)):
                stop = joined.end()
            else:
                stop = end
                while stop > start and text[stop - 1] in CLOSING:
                    stop -= 1
            if stop == start or taken.overlaps(start, stop) or taken.covers(start, stop):
                continue
            found.append({"start": start, "end": stop, "pattern": pattern, "value": name(start, stop), "vote": start not in starts})
    return found


def hash_of(value: str) -> int:
    """A 64-bit name of a value."""
    b = np.frombuffer(value.encode("utf-8", "replace"), np.uint8)
    return int(B.hashes(B.prefix_hashes(b), np.array([0]), np.array([len(b)]))[0].view(np.int64))


_SPAN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32())])
_SEEN = pa.struct([("start", pa.int32()), ("kind", pa.int32()), ("end", pa.int32()), ("value", pa.int64()), ("seed", pa.int32()), ("patterns", pa.list_(pa.string()))])
_SCHEMA = "base array<struct<start:int,kind:int,end:int>>, seen array<struct<start:int,kind:int,end:int,value:bigint,seed:int,patterns:array<string>>>"


def _reads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        b, at = B.text_buffers(batch.column(2))
        for i, j in B.runs(at):
            part = b[at[i] : at[j]]
            places = np.flatnonzero(((part >= 48) & (part <= 57)) | (part == 64)) + at[i]
            base, seen = [[]] * (j - i), [[]] * (j - i)
            for r in np.unique(np.searchsorted(at, places, side="right") - 1).tolist():
                base[r - i], seen[r - i] = read(batch.column(2)[r].as_py())
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(base, pa.list_(_SPAN)), pa.array(seen, pa.list_(_SEEN))], ["id", "hash", "base", "seen"])


def _tokens(slots: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: dict[str, bool] = {}
        for batch in batches:
            _, at = B.text_buffers(batch.column(2))
            for i, j in B.runs(at):
                found, rows = [], []
                for r in range(i, j):
                    if text := batch.column(2)[r].as_py():
                        mine = behind(text, slots, words)
                        found += mine
                        rows += [r] * len(mine)
                pick, of = pa.array(rows, pa.int64()), lambda c, kind: pa.array([x[c] for x in found], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pick), batch.column(1).take(pick), of("start", pa.int32()), of("end", pa.int32()), of("pattern", pa.string()), of("value", pa.int64()), of("vote", pa.bool_())], ["id", "hash", "start", "end", "pattern", "value", "vote"])

    return run


def slots_of(patterns: DataFrame) -> bytes:
    """Which of SLOTS hashes the column ``pattern`` holds, and those of its words alone (what stands before the first |): a
    byte each; the driver gets SLOTS / 64 numbers at most."""
    patterns = patterns.select(F.explode(F.array("pattern", F.substring_index("pattern", "|", 1))).alias("pattern"))
    slot = F.pmod(F.crc32(F.col("pattern").cast("binary")), F.lit(SLOTS))
    words = patterns.select(slot.alias("s")).distinct().groupBy(F.expr("s div 64").alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(s % 64 as int))")).alias("bits")).collect()
    bits = np.zeros(SLOTS // 64, np.int64)
    bits[[r.w for r in words]] = [r.bits for r in words]
    return np.unpackbits(bits.view(np.uint8), bitorder="little").tobytes()


def confident_patterns(edges: DataFrame, confidence: float = CONFIDENCE, support: int = SUPPORT) -> DataFrame:
    """(pattern, kind) of the patterns that end with high confidence, from distinct (pattern, value, seed) edges.

    A pattern's confidence in a kind is the sum of its values' scores in it over one more than the
    number of its values; a value's score is 1 if a seed rule knows it, else TRUST times the best
    confidence of its confident patterns. Scores can only rise from round to round, so rounds go on until
    no confidence changes by a hundredth. Sums are pre-aggregated, so neither a common pattern nor a
    common value is gathered.
    """
    edges = staged(edges)
    size = edges.groupBy("pattern").agg(F.countDistinct("value").alias("n")).where(F.col("n") >= support).withColumnRenamed("pattern", "sp")
    edges = staged(edges.join(size, matched(F.col("pattern"), F.col("sp"))).drop("sp"))
    known = edges.where("seed >= 0").select("value", F.col("seed").alias("kind")).distinct().withColumn("score", F.lit(1.0))
    scores, mark = known, None
    while True:
        s = scores.withColumnRenamed("value", "sv")
        conf = edges.join(s, F.col("value") == F.col("sv")).groupBy("pattern", "kind", "n").agg((F.sum("score") / (F.col("n") + 1)).alias("confidence"))
        conf = staged(conf.where(F.col("confidence") >= confidence))
        now = tuple(conf.agg(F.count("*"), F.sum(F.floor(F.col("confidence") * 100))).first())
        if now == mark:
            break
        mark = now
        c = conf.select(F.col("pattern").alias("cp"), "kind", "confidence")
        told = edges.where("seed < 0").join(c, F.col("pattern") == F.col("cp")).groupBy("value", "kind").agg((F.max("confidence") * TRUST).alias("score"))
        scores = staged(known.unionByName(told))
    return conf.groupBy("pattern").agg(F.max_by("kind", F.struct("confidence", -F.col("kind"))).alias("kind"))


def personal_data(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: id, ``n_email``, ``n_ip``, ``n_card``, ``n_phone`` (base matches), ``base``, ``spans`` and ``n_added``.

    ``base`` and ``spans`` are strings of kind:start:end in code points, end exclusive, by start, then
    kind, joined by commas: the base matches, and those with what confident patterns add (``n_added``
    spans): the values of six letters and digits or more of kind ``secret``, and the token behind a confident word
    and signs, of the pattern's kind: a value with the parts that single signs join to it if one starts there, else any
    non-space run, of any length, without closing quotes, brackets and stops. For the latter a pattern is scored again
    with all tokens behind it, so that a word that other words mostly follow adds none. Of added spans of a kind that
    start together the longest counts; others may overlap. Values that overlap a base match are not added; what
    has the length of a base kind but fails its check is never evidence, nor added, nor is a value that lies wholly inside it.

    The texts are read once, where only documents with a digit or @ are looked at closer, and once more for
    the tokens if a pattern is confident; that reading gets a map of fixed size. Patterns and values
    are scored over all documents. Null and empty texts have no spans. Rows that repeat an id and text
    get equal results; a null id is kept. Empty table: empty result. Other columns are ignored.
    """
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("hash"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    made = staged(rows.mapInArrow(_reads, f"id {kind}, hash long, {_SCHEMA}"))
    seen = made.where("size(seen) > 0").select("id", "hash", F.explode("seen").alias("x")).select("id", "hash", "x.*")
    edges = seen.select(F.explode("patterns").alias("pattern"), "value", "seed").groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    edges = staged(edges)
    good = staged(confident_patterns(edges))
    open_ = seen.where("kind = 4").select("id", "hash", "start", "kind", "end", F.explode("patterns").alias("pattern"))
    added = open_.join(good.where("kind = 4").select(F.col("pattern").alias("gp")), F.col("pattern") == F.col("gp"), "left_semi").select("id", "hash", "start", "kind", "end")
    before = good.where("pattern like 'before %'").select(F.col("pattern").alias("bp"))
    if not before.isEmpty():
        slots = slots_of(before.withColumnRenamed("bp", "pattern"))
        tokens = rows.mapInArrow(_tokens(slots), f"id {kind}, hash long, start int, end int, pattern string, value long, vote boolean")
        tokens = staged(tokens.join(before, F.col("pattern") == F.col("bp"), "left_semi"))
        all_edges = edges.join(before, F.col("pattern") == F.col("bp"), "left_semi").unionByName(tokens.where("vote").select("pattern", "value", F.lit(-1).alias("seed")).distinct())
        sure = confident_patterns(all_edges).select(F.col("pattern").alias("gp"), F.col("kind").alias("kind"))
        added = added.unionByName(tokens.join(sure, F.col("pattern") == F.col("gp")).select("id", "hash", "start", "kind", "end"))
    added = added.groupBy("id", "hash", "start", "kind").agg(F.max("end").alias("end"))
    added = added.groupBy("id", "hash").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added")).withColumnsRenamed({"id": "aid", "hash": "ahash"})
    out = made.select("id", "hash", "base").join(added, F.col("id").eqNullSafe(F.col("aid")) & (F.col("hash") == F.col("ahash")), "left")
    name = F.array(*(F.lit(k) for k in KINDS))
    show = lambda a: F.array_join(F.transform(F.array_sort(a), lambda s: F.concat_ws(":", F.element_at(name, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    every = F.when(F.col("added").isNull(), F.col("base")).otherwise(F.concat("base", "added"))
    return out.select(F.col("id").alias(id_col), *(count(k) for k in range(4)), show(F.col("base")).alias("base"), show(every).alias("spans"), F.coalesce(F.size("added"), F.lit(0)).cast("long").alias("n_added"))
