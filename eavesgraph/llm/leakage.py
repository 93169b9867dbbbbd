"""Passages of held-out items inside documents, by winnowing.

Documents and items become sequences of word hashes. Of the hashes of k
successive words the least of every window is kept, so any shared run of at
least k + window - 1 words shares a kept fingerprint. One pass over the corpus
keeps the fingerprints of regions dense in words of items; they are joined with
those of the items, and every hit is extended both ways to the longest stretch
of the item with few enough altered, left-out or added words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eavesgraph.llm import subtitles
from eavesgraph.session import BROADCAST_ROWS, drop_path, written

K, WINDOW = 3, 2
#: A stretch has at least this many words of the item ...
LEAST = 12
#: ... and at most one error for so many of them.
PER_ERROR = 6
#: Every stretch that is looked for has at least so many grams of the item among so many successive ones of the document.
DENSE, SPAN = 4, 12
#: Slots of the filter of grams, as powers of two: about 32 a gram, within these bounds (the largest takes 16 MB).
LEAST_BITS, MOST_BITS = 16, 27
#: Words kept with their hashes in a worker.
CACHE = 1_000_000
#: Cells of the extension that are worked on at once.
CELLS = 4_000_000
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
_GAP = 64


def words_of(text: str | None) -> list[str]:
    return subtitles.WORD.findall(subtitles.skeleton(subtitles.dialogue(text))) if text else []


class WordHashes(dict):
    """A 63-bit hash of each word, the same in every process."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1
        return h

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def gram_hashes(ids: np.ndarray, k: int = K) -> np.ndarray:
    """A 64-bit hash of the k words from each position; none where one is a gap (negative)."""
    n = len(ids) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    bad = np.zeros(n, bool)
    with np.errstate(over="ignore"):
        for i in range(k):
            part = ids[i : i + n]
            bad |= part < 0
            h = (h ^ part.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    h[bad] = _NONE
    return h


def winnow(h: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Positions of the least hash of every window of successive ones, the last of equals."""
    if not len(h):
        return np.zeros(0, np.int64)
    if len(h) <= window:
        at = np.array([len(h) - 1 - int(np.argmin(h[::-1]))])
    else:
        best = np.arange(window - 1, len(h))
        for back in range(1, window):
            other = np.arange(window - 1 - back, len(h) - back)
            best = np.where(h[other] < h[best], other, best)
        at = np.unique(best)
    return at[h[at] != _NONE]


def joined(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts with gaps before, between and after, start of each)."""
    size = np.array([len(p) for p in parts], np.int64)
    start = _GAP + np.cumsum(size + _GAP) - size - _GAP
    ids = np.full(int(size.sum()) + _GAP * (len(parts) + 1), -1, np.int64)
    for s, p in zip(start, parts):
        ids[s : s + len(p)] = p
    return ids, start


def neighbours_of(ids: np.ndarray, at: np.ndarray, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """The words before and after the grams at ``at``; -1 is none."""
    before = np.where(at > 0, ids[np.maximum(at - 1, 0)], -1)
    after = np.where(at + k < len(ids), ids[np.minimum(at + k, len(ids) - 1)], -1)
    return before, after


def lists(values: np.ndarray, count: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow list array of successive runs of ``values``."""
    offset = np.zeros(len(count) + 1, np.int32)
    np.cumsum(count, out=offset[1:])
    return pa.ListArray.from_arrays(pa.array(offset), pa.array(values, kind))


def slot_of(h: np.ndarray, bits: int) -> np.ndarray:
    return (h >> np.uint64(64 - bits)).astype(np.int64)


ITEM = "item_id long, words array<long>, grams array<long>, p array<int>, h array<long>, before array<long>, after array<long>"


def item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words, all grams, and fingerprints (position, hash, words around) of each item that is long enough."""
    hashes = WordHashes()
    for b in batches:
        rows = []
        for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w = hashes.of(words_of(t))
            if len(w) < LEAST:
                continue
            h = gram_hashes(w)
            at = winnow(h)
            rows.append((i, w, h.view(np.int64), at, h[at].view(np.int64), *neighbours_of(w, at)))
        if rows:
            cols = list(zip(*rows))
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            arrays = [pa.array(cols[0], pa.int64()), *(lists(np.concatenate(c), np.array([len(x) for x in c]), k) for c, k in zip(cols[1:], kinds))]
            yield pa.RecordBatch.from_arrays(arrays, ["item_id", "words", "grams", "p", "h", "before", "after"])


def gram_filter(items: DataFrame, n: int) -> tuple[np.ndarray, int]:
    """(64-bit words, bits): which slots of the hash range hold one of the ``n`` grams of the items.

    The slots are set by the executors; the driver gets at most 2^MOST_BITS / 64
    words. With more items the filter lets more through, and misses nothing.
    """
    grams = items.select(F.explode("grams").alias("g"))
    bits = min(MOST_BITS, max(LEAST_BITS, math.ceil(math.log2(max(n, 1))) + 5))
    slot = F.shiftrightunsigned("g", 64 - bits)
    packed = grams.groupBy(F.shiftright(slot, 6).alias("word")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(g, {64 - bits}) & 63 as int))")).alias("b"))
    out = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    for word, b in packed.toPandas().itertuples(index=False):
        out[word] = b
    return out.view(np.uint64), bits


def passes(h: np.ndarray, filter_: np.ndarray, bits: int) -> np.ndarray:
    s = slot_of(h, bits)
    return ((filter_[s >> 6] >> (s & 63).astype(np.uint64)) & np.uint64(1) > 0) & (h != _NONE)


REGION = "doc_id long, start int, words array<long>, p array<int>, h array<long>, before array<long>, after array<long>"


def regions_of(doc_ids: np.ndarray, parts: list[np.ndarray], filter_: np.ndarray, bits: int, reach: int) -> pa.RecordBatch | None:
    """The regions of documents that can hold a stretch, with their words and fingerprints.

    A stretch has DENSE grams of items among SPAN successive ones somewhere, so
    it lies within ``reach`` words of such a place.
    """
    ids, start = joined(parts)
    h = gram_hashes(ids)
    known = passes(h, filter_, bits)
    total = np.concatenate(([0], np.cumsum(known)))
    at = np.flatnonzero(total[SPAN:] - total[:-SPAN] >= DENSE) if len(known) >= SPAN else np.zeros(0, np.int64)
    if not len(at):
        return None
    # a window may begin in the gap before a text or end in the one after it
    doc = np.maximum(np.searchsorted(start, at + SPAN + K - 2, "right") - 1, 0)
    end = start + np.array([len(p) for p in parts])
    lo, hi = np.maximum(at - reach, start[doc]), np.minimum(at + SPAN + K - 1 + reach, end[doc])
    step = np.zeros(len(ids) + 1, np.int32)
    np.add.at(step, lo, 1)
    np.add.at(step, hi, -1)
    inside = np.concatenate(([0], np.cumsum(step[:-1]) > 0, [0])).astype(np.int8)
    edge = np.diff(inside)
    begin, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    doc = np.searchsorted(start, begin, "right") - 1
    prints = winnow(h)
    prints = prints[known[prints]]
    first, last = np.searchsorted(prints, begin), np.searchsorted(prints, stop - K + 1)
    n = np.maximum(last - first, 0)
    mine = prints[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
    before, after = neighbours_of(ids, mine)
    arrays = [
        pa.array(doc_ids[doc], pa.int64()),
        pa.array(begin - start[doc], pa.int32()),
        lists(ids[inside[1:-1] > 0], stop - begin, pa.int64()),
        lists(mine - np.repeat(begin, n), n, pa.int32()),
        *(lists(v, n, pa.int64()) for v in (h[mine].view(np.int64), before, after)),
    ]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "start", "words", "p", "h", "before", "after"])


class _Walk:
    """How far stretches go from given cells, with ever more errors."""

    def __init__(self, doc: np.ndarray, item: np.ndarray, step: int):
        self.doc, self.item, self.step = doc, item, step

    def slide(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Successive matching words from item position i and document position j on."""
        out = np.zeros(i.shape, np.int64)
        flat = out.ravel()
        i, j = i.ravel().copy(), j.ravel().copy()
        live = np.flatnonzero((i >= 0) & (j >= 0))
        while len(live):
            a, b = i[live], j[live]
            ok = (a >= 0) & (b >= 0) & (a < len(self.item)) & (b < len(self.doc))
            live, a, b = live[ok], a[ok], b[ok]
            live = live[self.item[a] == self.doc[b]]
            flat[live] += 1
            i[live] += self.step
            j[live] += self.step
        return out

    def last_match(self, p: np.ndarray, q: np.ndarray, far: np.ndarray, shift: np.ndarray, best: np.ndarray) -> None:
        """Raise ``best`` of each cell to the last match on any diagonal up to where it was followed.

        Errors never become fewer along a diagonal, so every place before the
        furthest one can be reached too.
        """
        cell, diagonal = np.nonzero(far > best[:, None])
        n, shift = far[cell, diagonal], shift[diagonal]
        while len(cell):
            i, j = q[cell] + self.step * n, p[cell] + self.step * (n + shift)
            ok = (n > best[cell]) & (n + shift > 0)
            inside = (i >= 0) & (i < len(self.item)) & (j >= 0) & (j < len(self.doc))
            hit = ok & inside
            hit[hit] = self.item[i[hit]] == self.doc[j[hit]]
            np.maximum.at(best, cell[hit], n[hit])
            go = ok & ~hit
            cell, n, shift = cell[go], n[go] - 1, shift[go]

    def reach(self, p: np.ndarray, q: np.ndarray, most: int) -> np.ndarray:
        """(cells, errors): the most item words after the cell (p, q) that end with a match.

        The furthest place on each diagonal is carried on from e errors to e + 1:
        an altered word keeps the diagonal, a left-out one leaves it for the one
        below, an added one for the one above.
        """
        s, width = self.step, 2 * most + 1
        shift = np.arange(-most, most + 1)
        none = -(1 << 40)
        far = np.full((len(p), width), none, np.int64)
        ended = np.zeros((len(p), most + 1), np.int64)
        far[:, most] = 0
        for e in range(most + 1):
            if e:
                new = far + 1
                new[:, :-1] = np.maximum(new[:, :-1], far[:, 1:] + 1)
                new[:, 1:] = np.maximum(new[:, 1:], far[:, :-1])
                new[new < 0] = none
                far = new
                ended[:, e] = ended[:, e - 1]
            on = far >= 0
            i = np.where(on, q[:, None] + s * (far + 1), -1)
            j = np.where(on, p[:, None] + s * (far + shift + 1), -1)
            far = np.where(on, far + self.slide(i, j), none)
            self.last_match(p, q, far, shift, ended[:, e])
        return ended


def longest_stretch(doc: np.ndarray, item: np.ndarray, p: np.ndarray, q: np.ndarray) -> tuple[int, int]:
    """(words, errors) of the longest stretch of the item through any of the matching cells (p, q); 0 words if none.

    A stretch begins and ends with a matching word, has at least LEAST words of
    the item and at most one error for each PER_ERROR of them; altered and
    left-out words count among the words of the item, added ones only as
    errors. Of equally long ones that with the fewest errors counts. Both sides
    of a cell are independent, so the result is exact for any lengths.
    """
    known = np.concatenate(([0], np.cumsum(np.isin(gram_hashes(doc), gram_hashes(item)))))
    width = min(SPAN, len(known) - 1)
    if not width or (known[width:] - known[:-width]).max() < DENSE:
        return 0, 0
    most = len(item) // PER_ERROR
    # one cell for each run of matching words on a diagonal is enough
    order = np.lexsort((q, p - q))
    p, q = p[order].astype(np.int64), q[order].astype(np.int64)
    back = _Walk(doc, item, -1).slide(q - 1, p - 1)
    cells = np.unique(np.stack((p - back, q - back)), axis=1)
    best = (0, 0)
    for lo in range(0, cells.shape[1], max(1, CELLS // (2 * most + 1))):
        a, b = cells[:, lo : lo + max(1, CELLS // (2 * most + 1))]
        left, right = (_Walk(doc, item, s).reach(a, b, most) for s in (-1, 1))
        for e in range(most + 1):
            n = 1 + max(int((left[:, k] + right[:, e - k]).max()) for k in range(e + 1))
            if n >= max(LEAST, PER_ERROR * e) and n > best[0]:
                best = (n, e)
    return best


def _extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        doc_id, item_id, doc, item, p, q = b.columns
        rows = []
        for i in range(b.num_rows):
            n, e = longest_stretch(*(c[i].values.to_numpy(zero_copy_only=False) for c in (doc, item, p, q)))
            if n:
                rows.append((doc_id[i].as_py(), item_id[i].as_py(), n, e))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], ["doc_id", "item_id", "n_words", "n_errors"])


def prints(rows: DataFrame, *keys: str) -> DataFrame:
    """One row per fingerprint: the keys, h, p and the words before and after."""
    return rows.select(*keys, F.inline(F.arrays_zip("h", "p", "before", "after")))


def leaked(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, n_words, n_errors): documents that hold a passage of an item.

    documents: doc_id, text; items: item_id, text; other columns are ignored.
    The corpus is read once, whatever the number of items; only its regions
    dense in grams of items go on, by a filter of bounded size. Their
    fingerprints are joined with those of the items by hash, where the word
    before or after must agree too: of the run of four words that every passage
    holds, a fingerprint covers three and one of those two is the fourth. So a
    frequent gram does not meet all its like. n_words and n_errors are those of
    the longest passage. A null or empty text holds nothing, items under 12
    words are never found, repeated documents and items give one row, and empty
    tables give an empty result.
    """
    spark = documents.sparkSession
    source = items.where("item_id is not null and text is not null").select(F.col("item_id").cast("long"), "text").distinct()
    wanted, scratch = written(source.mapInArrow(item_rows, ITEM).withColumn("sig", F.xxhash64("words")), "items")
    longest, n_items, n_grams, n_prints = wanted.agg(F.max(F.size("words")), F.count("*"), F.sum(F.size("grams")), F.sum(F.size("h"))).first()
    if not longest:
        drop_path(spark, scratch)
        return spark.createDataFrame([], "doc_id long, item_id long, n_words int, n_errors int")
    reach = longest + longest // PER_ERROR + 1
    shared = spark.sparkContext.broadcast(gram_filter(wanted, n_grams))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        filter_, bits = shared.value
        hashes = WordHashes()
        for b in batches:
            for lo in range(0, b.num_rows, 1000):
                part = b.slice(lo, 1000)
                out = regions_of(part.column(0).to_numpy(zero_copy_only=False), [hashes.of(words_of(t)) for t in part.column(1).to_pylist()], filter_, bits, reach)
                if out is not None and out.num_rows:
                    yield out

    texts = documents.where("doc_id is not null and text <> ''").select(F.col("doc_id").cast("long"), "text")
    regions, _ = written(texts.mapInArrow(run, REGION).withColumn("sig", F.xxhash64("words")), "regions")
    place = ["doc_id", "start", "sig"]
    of_items = prints(wanted, "item_id", "sig").withColumnsRenamed({"sig": "item_sig", "p": "q", "before": "i_before", "after": "i_after"})
    around = ((F.col("before") >= 0) & (F.col("before") == F.col("i_before"))) | ((F.col("after") >= 0) & (F.col("after") == F.col("i_after")))
    hits = prints(regions, *place).join(F.broadcast(of_items) if n_prints <= BROADCAST_ROWS else of_items, "h").where(around)
    cells = hits.groupBy(*place, "item_id", "item_sig").agg(F.collect_set(F.struct("p", "q")).alias("at"))
    both = cells.join(regions.select(*place, F.col("words").alias("doc")).dropDuplicates(place), place)
    texts_of = wanted.select("item_id", F.col("sig").alias("item_sig"), F.col("words").alias("item"))
    both = both.join(F.broadcast(texts_of) if n_items * longest <= 20 * BROADCAST_ROWS else texts_of, ["item_id", "item_sig"])
    found = both.select("doc_id", "item_id", "doc", "item", "at.p", "at.q").mapInArrow(_extend, "doc_id long, item_id long, n_words int, n_errors int")
    out = found.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_words", (-F.col("n_errors")).alias("e"))).alias("b"))
    return out.select("doc_id", "item_id", "b.n_words", (-F.col("b.e")).alias("n_errors"))
