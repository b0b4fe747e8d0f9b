"""Substring dedup: words in any window of 35 that occurs a second time anywhere are removed.

Suffixes (one for each word that a window starts at) are split by prefixes of variable length into groups that fit in
memory; each group's suffixes are sorted, which gives its suffix tree as order and LCPs, cut at a depth of 35 words: a
node at that depth or deeper with two leaves is a repeat, and the union of such nodes along a text is its maximal repeats.

1. A suffix is filed under the least 8-word gram that starts in its first 28 places (the rightmost of equal ones): the
   prefix that ends with that anchor has 8 to 35 words. Equal windows have equal anchors. Suffixes with one anchor
   follow one another and travel as one segment of text. Segments are counted by anchor over the whole corpus. An anchor
   with one segment is a leaf that can't branch at depth 35. Anchors with two or more are held in a bitmap of fixed
   size, which can only let further segments through.
2. Segments meet by anchor. Where an anchor has more than GROUP segments, the prefix is extended to the whole window:
   each suffix goes by itself, to the group of its 35 words. A window that met an equal one in its own task is settled
   there and one of them stands for all, so a passage that a third of all documents hold gives a few rows a task.
3. A group's suffixes are sorted by prefix doubling over exact words; neighbours with an LCP of 35 or more are leaves of
   one deep node. Their windows are joined back to their texts; a text that many rows hold is left to the adaptive
   planner, which splits it.

Within a task equality is by 128 bits of two hashes, across tasks by the words. The bitmap has 2^27 bits: from about a
hundred million repeated anchors on it lets most segments through, which costs shuffle (a segment has about three times
the bytes of the words it adds) and no result. Defined cases: a null or empty text has no words and keeps the empty text;
texts shorter than the window keep all words; rows that repeat are occurrences of their own; windows are judged on the
input. Input columns other than the text are carried through; those added start with `__tm_`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SpanHash, U, batch_of, mix, release, stage_table, text_or_empty, text_slices, word_spans

WINDOW = 35
ANCHOR_WORDS = 8
#: log2 of the bits of each bitmap of anchors: 16 MB in each task, whatever the corpus.
BITMAP_BITS = 27
#: Segments of an anchor beyond which its suffixes are filed by their whole window.
GROUP = 4096
#: Words of segments that are sorted at once, about, and windows that a task remembers to have settled.
CHUNK_WORDS = 400_000
REMEMBER = 1 << 18


class _Slice(NamedTuple):
    """Word bounds in bytes, and for each window: text, place in the text, first word, anchor's word, hashes of anchor and window."""

    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    place: np.ndarray
    p: np.ndarray
    pos: np.ndarray
    m: np.ndarray
    h: np.ndarray
    g: np.ndarray


class _Windows:
    def __init__(self, window: int, anchor: int):
        self.window, self.anchor = window, min(anchor, window)
        self.words, self.grams, self.second = SpanHash(51), SpanHash(52), SpanHash(53)

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> _Slice:
        starts, ends, first = word_spans(data, offsets)
        n, e = len(starts), np.zeros(0, np.int64)
        if n < self.window:
            return _Slice(starts, ends, e, e, e, e, e.view(U), e.view(U), e.view(U))
        h = self.words.bytes(data, starts, ends)
        s = self.grams.sums(h)
        at = np.arange(n - self.anchor + 1)
        m, pos, have, span = mix((s[at + self.anchor] - s[at]) * self.grams.down[at]), at, 1, self.window - self.anchor + 1
        while have < span:  # least of `have` grams from each place on, the rightmost of equal ones
            by = min(have, span - have)
            right = m[by:] <= m[:-by]
            m, pos = np.where(right, m[by:], m[:-by]), np.where(right, pos[by:], pos[:-by])
            have += by
        per = np.maximum(0, np.diff(first) - self.window + 1)
        doc = np.repeat(np.arange(len(per)), per)
        place = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
        p = place + first[:-1][doc]
        t = self.second.sums(mix(h))
        return _Slice(starts, ends, doc, place, p, pos[p], m[p], mix((s[p + self.window] - s[p]) * self.grams.down[p] + U(7)), mix((t[p + self.window] - t[p]) * self.second.down[p]))


def _anchors(window: int, anchor: int):
    schema = pa.schema([("anchor", pa.int64()), ("n", pa.int64())])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _Windows(window, anchor)
        for batch in it:
            for _, _, data, offsets in text_slices(batch):
                w = windows(data, offsets)
                if len(w.p):
                    used, n = np.unique(w.m[np.flatnonzero(np.diff(w.pos, append=-1))], return_counts=True)
                    yield batch_of(schema, used.view(np.int64), n)
        del windows
        release()

    return run


def _in(bitmap: np.ndarray, anchor: np.ndarray, bits: int) -> np.ndarray:
    b = (anchor >> U(64 - bits)).astype(np.int64)
    return (bitmap[b >> 3] >> (b & 7).astype(np.uint8) & 1).astype(bool)


class _Settled:
    """Windows of a task by two hashes: 2 where one stands for all already, 1 where one was sent as it is, 0 for others."""

    def __init__(self):
        self.h, self.g, self.state = np.zeros(0, U), np.zeros(0, U), np.zeros(0, np.int8)

    def of(self, h: np.ndarray, g: np.ndarray) -> np.ndarray:
        if not len(self.h):
            return np.zeros(len(h), np.int8)
        at = np.minimum(np.searchsorted(self.h, h), len(self.h) - 1)
        return np.where((self.h[at] == h) & (self.g[at] == g), self.state[at], 0)

    def put(self, h: np.ndarray, g: np.ndarray, state: np.ndarray) -> None:
        if len(self.h) + len(h) > REMEMBER:  # forgotten: they are sent once more
            self.__init__()
        h, g, state = np.concatenate([h, self.h]), np.concatenate([g, self.g]), np.concatenate([state, self.state])
        self.h, at = np.unique(h, return_index=True)  # the first of equal ones, which is the newest
        self.g, self.state = g[at], state[at]


def _runs(*breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last index of runs; breaks tell for each row but the first whether a run starts there."""
    start = np.ones(len(breaks[0]) + 1, bool)
    start[1:] = np.logical_or.reduce(breaks)
    first = np.flatnonzero(start)
    return first, np.append(first[1:], len(start)) - 1


_SEGMENTS = pa.schema([("a", pa.int64()), ("x", pa.int64()), ("k", pa.int64()), ("q", pa.int64()), ("n", pa.int32()), ("words", pa.binary())])


def _segments(window: int, anchor: int, held, bits: int):
    """Rows of _SEGMENTS: n suffixes from place q on of text k (q has the text's crc32 above), in the group (a, x).

    words: their text; without k they stand for windows that are settled. Rows without words are settled windows.
    """

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows, settled = _Windows(window, anchor), _Settled()
        live, hot = held.value
        for batch in it:
            key, crc = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
            for i, j, data, offsets in text_slices(batch):
                w = windows(data, offsets)
                at = np.flatnonzero(_in(live, w.m, bits))
                if not len(at):
                    continue
                doc, place, p, pos, m, h, g = (x[at] for x in w[2:])
                single = _in(hot, m, bits)
                order = np.lexsort((g, h))
                first, last = _runs(h[order][1:] != h[order][:-1], g[order][1:] != g[order][:-1])
                head, count = order[first], last - first + 1
                before = settled.of(h[head], g[head])
                met = (count > 1) | (before > 0)
                stands = met & (before < 2)
                new = stands | single[head] & (before == 0)
                settled.put(h[head][new], g[head][new], np.where(met[new], 2, 1).astype(np.int8))
                all_met, sent, stand = np.empty(len(at), bool), np.zeros(len(at), bool), np.zeros(len(at), bool)
                all_met[order] = np.repeat(met, count)
                sent[head[~met | stands]] = True
                stand[head[stands]] = True
                k, q = key[i:j][doc], (crc[i:j][doc] & 0x7FFFFFFF) << 32 | place

                x = np.flatnonzero(all_met)
                if len(x):
                    a, z = _runs(p[x][1:] != p[x][:-1] + 1, doc[x][1:] != doc[x][:-1])
                    a, z = x[a], x[z]
                    anywhere = mix(k[a].view(U) ^ mix(q[a].view(U)))
                    yield batch_of(_SEGMENTS, anywhere.view(np.int64), np.zeros(len(a), np.int64), k[a], q[a], (p[z] - p[a] + 1).astype(np.int32), pa.nulls(len(a), pa.binary()))
                x = np.flatnonzero(sent)
                if len(x):
                    a, z = _runs(pos[x][1:] != pos[x][:-1], p[x][1:] != p[x][:-1] + 1, stand[x][1:] != stand[x][:-1], single[x][1:])
                    a, z = x[a], x[z]
                    raw = data.tobytes()
                    words = [raw[s:e] for s, e in zip(w.starts[p[a]].tolist(), w.ends[p[z] + window - 1].tolist(), strict=True)]
                    yield batch_of(_SEGMENTS, m[a].view(np.int64), np.where(single[a], h[a].view(np.int64), 0), pa.array(k[a], pa.int64(), mask=stand[a]), q[a], (p[z] - p[a] + 1).astype(np.int32), pa.array(words, pa.binary()))
        del windows, settled
        release()

    return run


class Suffixes:
    """Sorted suffixes of words by prefix doubling (ranks of all runs of 1, 2, 4, .. words), up to `depth` words."""

    def __init__(self, words: np.ndarray, depth: int):
        self.ranks, n = [words], 1
        while 2 * n <= depth:
            self.ranks.append(self._rank(self.ranks[-1], n))
            n *= 2
        self.whole = self._rank(self.ranks[-1], depth - n) if depth > n else self.ranks[-1]

    @staticmethod
    def _rank(ranks: np.ndarray, after: int) -> np.ndarray:
        """Ranks of each place's and the place's `after` further on."""
        if len(ranks) <= after:
            return np.zeros(0, np.int64)
        return np.unique(ranks[: len(ranks) - after] * (int(ranks.max()) + 1) + ranks[after:], return_inverse=True)[1]

    def order(self, places: np.ndarray) -> np.ndarray:
        return np.argsort(self.whole[places], kind="stable")

    def lcp(self, a: np.ndarray, b: np.ndarray, room: np.ndarray) -> np.ndarray:
        """Words that the suffixes at a and b have in common, `room` at most."""
        common = np.zeros(len(a), np.int64)
        for i in reversed(range(len(self.ranks))):
            r = self.ranks[i]
            # twice, as the longest rank may be read again for the rest of the depth
            for _ in range(2 if i == len(self.ranks) - 1 else 1):
                x, y = a + common, b + common
                inside = np.maximum(x, y) < len(r)
                common += np.where(inside & (r[np.minimum(x, len(r) - 1)] == r[np.minimum(y, len(r) - 1)]), 1 << i, 0)
        return np.minimum(common, room)


def _sorted_out(rows: pa.Table, window: int) -> tuple[tuple[np.ndarray, ...], pa.Table]:
    """(k, q, n) of the runs of windows that are leaves of a deep node, and one row for each distinct window, as settled."""
    n = rows["n"].to_numpy().astype(np.int64)
    code: dict[bytes, int] = {}
    words = np.fromiter((code.setdefault(w, len(code)) for w in b"\n".join(rows["words"].to_pylist()).split()), np.int64)
    room = n + window - 1
    start = np.cumsum(room) - room
    row = np.repeat(np.arange(len(n)), n)
    offset = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = start[row] + offset
    suffixes = Suffixes(words, window)
    order = suffixes.order(at)
    a, b = order[:-1], order[1:]
    deep = suffixes.lcp(at[a], at[b], np.minimum(room[row[a]] - offset[a], room[row[b]] - offset[b])) >= window
    leaf = np.zeros(len(at), bool)
    leaf[a[deep]] = leaf[b[deep]] = True
    leaf &= rows["k"].is_valid().to_numpy()[row]
    x = np.flatnonzero(leaf)
    k, q = rows["k"].fill_null(0).to_numpy(), rows["q"].to_numpy()
    if len(x):
        first, last = _runs(row[x][1:] != row[x][:-1], x[1:] != x[:-1] + 1)
        first, last = x[first], x[last]
        found = k[row[first]], q[row[first]] + offset[first], last - first + 1
    else:
        found = k[:0], q[:0], n[:0]
    distinct = np.sort(row[order[np.flatnonzero(np.concatenate([[True], ~deep]))]])
    kept = rows.take(pa.array(distinct))
    return found, kept.set_column(2, _SEGMENTS.field("k"), pa.nulls(kept.num_rows, pa.int64()))


def _subtrees(window: int):
    """Spans of the windows of deep nodes, from _SEGMENTS sorted by (a, x)."""
    schema = pa.schema([("k", pa.int64()), ("crc", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def spans(k: np.ndarray, q: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        place = q & 0xFFFFFFFF
        return batch_of(schema, k, q >> 32, place.astype(np.int32), (place + n + window - 1).astype(np.int32))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending, held = _SEGMENTS.empty_table(), 0
        for batch in it:
            batch = pa.Table.from_batches([batch]).cast(_SEGMENTS)
            alone = pc.is_null(batch["words"])
            done = batch.filter(alone)
            yield spans(done["k"].to_numpy(), done["q"].to_numpy(), done["n"].to_numpy())
            batch = batch.filter(pc.invert(alone))
            pending, held = pa.concat_tables([pending, batch]), held + (pc.sum(batch["n"]).as_py() or 0) + (window - 1) * batch.num_rows
            if held < CHUNK_WORDS:
                continue
            pending = pending.combine_chunks()
            a, x = pending["a"].to_numpy(), pending["x"].to_numpy()
            last = int(np.flatnonzero((a == a[-1]) & (x == x[-1]))[0])
            if last:
                found, _ = _sorted_out(pending.slice(0, last), window)
                pending = pending.slice(last)
            elif x[-1]:  # a window found very often: each distinct one stands for those that were read
                found, pending = _sorted_out(pending, window)
            else:
                continue
            yield spans(*found)
            held = int(pc.sum(pending["n"]).as_py()) + (window - 1) * pending.num_rows
        if pending.num_rows:
            yield spans(*_sorted_out(pending.combine_chunks(), window)[0])
        del pending
        release()

    return run


def marks(texts: DataFrame, window: int = WINDOW, anchor: int = ANCHOR_WORDS, bits: int = BITMAP_BITS, group: int = GROUP) -> DataFrame:
    """(k, crc, spans) of the texts with repeated windows: spans are (start, end) in words. texts: text, k, crc."""
    counted = texts.select("text").mapInArrow(_anchors(window, anchor), "anchor long, n long").groupBy("anchor").agg(F.sum("n").alias("n")).filter("n > 1")
    word = F.shiftrightunsigned("anchor", 64 - bits)
    bit = F.expr("shiftleft(1L, cast(bit & 63 as int))")
    # the bitmaps in words of 64 bits: 2^bits / 64 rows at most
    packed = counted.select(word.alias("bit"), "n").groupBy(F.shiftrightunsigned("bit", 6).alias("w"))
    packed = packed.agg(F.bit_or(bit).alias("live"), F.bit_or(F.when(F.col("n") > group, bit).otherwise(F.lit(0).cast("long"))).alias("hot")).toArrow()
    bitmaps = np.zeros((2, max(1, (1 << bits) // 64)), np.int64)
    for row, name in enumerate(("live", "hot")):
        bitmaps[row, packed["w"].to_numpy()] = packed[name].to_numpy()
    held = texts.sparkSession.sparkContext.broadcast(bitmaps.view(np.uint8))

    segments = texts.select("text", "k", "crc").mapInArrow(_segments(window, anchor, held, bits), "a long, x long, k long, q long, n int, words binary")
    spans = segments.repartition("a", "x").sortWithinPartitions("a", "x").mapInArrow(_subtrees(window), "k long, crc long, start int, end int")
    # copies of one text say the same: they are reduced before they meet
    return spans.distinct().groupBy("k", "crc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))


def _remove():
    """Adds n_words, n_removed and the kept text to (…, __tm_text, __tm_starts, __tm_ends)."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            text, starts, ends = (batch.column(batch.schema.get_field_index(c)) for c in ("__tm_text", "__tm_starts", "__tm_ends"))
            cols = [(c, n) for c, n in zip(batch.columns, batch.schema.names, strict=True) if n not in ("__tm_text", "__tm_starts", "__tm_ends")]
            total, gone, kept = [], [], []
            for t, s, e in zip(text, starts, ends, strict=True):
                w = (t.as_py() or "").encode().split()
                total.append(len(w))
                if s.is_valid and len(s):
                    cover = np.zeros(len(w) + 1, np.int64)
                    np.add.at(cover, s.values.to_numpy(), 1)
                    np.add.at(cover, e.values.to_numpy(), -1)
                    stay = np.cumsum(cover)[:-1] == 0
                    w = [x for x, y in zip(w, stay.tolist(), strict=True) if y]
                gone.append(total[-1] - len(w))
                kept.append(b" ".join(w).decode())
            yield pa.RecordBatch.from_arrays([*[c for c, _ in cols], pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.string())], names=[*[n for _, n in cols], "__tm_n_words", "__tm_n_removed", "__tm_kept"])
        release()

    return run


def remove_repeats(docs: DataFrame, text: str = "text", window: int = WINDOW, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """docs without the text column, and __tm_n_words, __tm_n_removed, __tm_kept (kept words joined by one space)."""
    rest = [c for c in docs.columns if c != text]
    t = text_or_empty(F.col(text))
    keyed = docs.select(*rest, t.alias("__tm_text"), F.xxhash64(t).alias("__tm_k"), F.crc32(t).bitwiseAND(F.lit(0x7FFFFFFF)).alias("__tm_crc"))
    found = stage_table(marks(keyed.select(F.col("__tm_text").alias("text"), F.col("__tm_k").alias("k"), F.col("__tm_crc").alias("crc")), window, anchor), "repeats")
    both = keyed.join(found, (F.col("__tm_k") == found["k"]) & (F.col("__tm_crc") == found["crc"]), "left")
    both = both.select(*rest, "__tm_text", F.col("spans.start").alias("__tm_starts"), F.col("spans.end").alias("__tm_ends"))
    fields = [docs.schema[c] for c in rest]
    out = T.StructType([*fields, T.StructField("__tm_n_words", T.LongType()), T.StructField("__tm_n_removed", T.LongType()), T.StructField("__tm_kept", T.StringType())])
    return both.mapInArrow(_remove(), out)


def op10_substring_dedup(docs: DataFrame) -> DataFrame:
    out = remove_repeats(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("__tm_n_words").alias("n_words"), F.col("__tm_n_removed").alias("n_removed"), F.sha2("__tm_kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH w AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT r, i, hash(ws[i:i+34]) AS h, md5(array_to_string(ws[i:i+34], ' ')) AS m FROM (SELECT r, ws, unnest(range(1, greatest(1, len(ws) - 33))) AS i FROM w)
), d AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h, m) AS c FROM p) WHERE c > 1
), c AS (
  SELECT DISTINCT r, k FROM (SELECT r, unnest(range(i, i + 35)) AS k FROM d)
), u AS (
  SELECT r, unnest(ws) AS word, unnest(range(1, len(ws) + 1)) AS k FROM w
), j AS (
  SELECT u.r, count(c.k) AS n_removed, string_agg(word, ' ' ORDER BY u.k) FILTER (c.k IS NULL) AS kept
  FROM u LEFT JOIN c ON c.r = u.r AND c.k = u.k GROUP BY u.r
)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN j USING (r)
"""
