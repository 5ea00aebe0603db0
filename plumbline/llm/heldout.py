"""Held-out passages in a corpus, found by winnowed fingerprints.

Words are the longest runs of letters and digits, case ignored. Every run of `k` words is hashed; of each `window`
consecutive hashes the least one (the last of equals) is kept as fingerprint, on both sides. Two texts that share
k + window - 1 words in a row have the same hashes there, so they keep a fingerprint in common: with k = 6 and
window = 7 no shared span of 12 words is missed. A fingerprint in common is then extended word by word in both
directions, and the pair is reported if the span that results has `least` words.

At scale: fingerprints of the corpus meet those of the held-out set in an equi-join whose small side is broadcast only
after its rows were counted; a corpus row brings its fingerprints and positions, never its text, to that join, and the
texts of the documents with a hit are read again for the extension. A hot fingerprint multiplies rows only by the
held-out items that hold it, and hits are reduced to one row per document and item before the extension.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import rows_at_most, written

WORD = re.compile(r"[^\W_]+")
BROADCAST_ROWS = 200_000  # of 16 bytes


def words_of(text: str | None) -> list[str]:
    """The longest runs of letters and digits, case ignored."""
    return WORD.findall(text.lower()) if text else []


class _WordHash(dict):
    """64-bit hashes of words; forgets all when it holds 500,000, so memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def winnow(word_hashes: np.ndarray, lengths: np.ndarray, k: int, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, fingerprint, word position) of the winnowed k-gram hashes of several texts.

    `word_hashes` holds the texts' words one after another, `lengths` the words of each. A text of fewer than
    k + window - 1 words but at least k keeps its least hash.
    """
    n = len(word_hashes)
    text = np.repeat(np.arange(len(lengths)), lengths)
    first = np.concatenate(([0], np.cumsum(lengths)[:-1])) if len(lengths) else np.empty(0, np.int64)
    none = np.empty(0, np.int64), np.empty(0, np.uint64), np.empty(0, np.int64)
    if n < k:
        return none
    h = word_hashes[: n - k + 1]
    for j in range(1, k):
        h = _mix(h) + word_hashes[j : n - k + 1 + j]
    h = _mix(h)
    own = text[: len(h)]
    ok = own == text[k - 1 :]
    # of each window of hashes within one text, the place of the least, the last of equals
    best, place = h.copy(), np.arange(len(h))
    span = 1
    best[~ok] = np.uint64(0xFFFFFFFFFFFFFFFF)
    full = best.copy()
    while span < window:
        step = min(span, window - span)
        a, b = best[:-step], best[step:]
        later = (b <= a) & (own[: len(a)] == own[step : step + len(b)])
        place = np.where(later, place[step:], place[:-step])
        best = np.where(later, b, a)
        span += step
    keep = place[ok[place]]
    # texts with fewer hashes than a window: the windows that begin in them run over their end, and count all the same
    marked = np.unique(keep)
    short = np.flatnonzero((lengths >= k) & (lengths < k + window - 1))
    if len(short):
        extra = [first[t] + np.argmin(full[first[t] : first[t] + lengths[t] - k + 1]) for t in short]
        marked = np.unique(np.concatenate((marked, np.array(extra, np.int64))))
    return own[marked], h[marked], marked - first[own[marked]]


def _fingerprints(k: int, window: int, words: int = 1_000_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = _WordHash().__getitem__

        def finish(keys: pa.Array, lists: list) -> pa.RecordBatch:
            lengths = np.array([len(x) for x in lists], np.int64)
            text, fp, pos = winnow(np.concatenate(lists), lengths, k, window)
            return pa.record_batch([keys.take(pa.array(text)), pa.array(fp.view(np.int64)), pa.array(pos.astype(np.int32))], names=["key", "fp", "pos"])

        for batch in batches:
            keys, lists, start, held = batch.column(0), [], 0, 0
            for i, text in enumerate(batch.column(1).to_pylist()):
                found = words_of(text)
                lists.append(np.fromiter(map(look, found), np.uint64, len(found)))
                held += len(found)
                if held > words or i + 1 == batch.num_rows:
                    yield finish(keys.slice(start, i + 1 - start), lists)
                    lists, start, held = [], i + 1, 0

    return run


def _extend(least: int, k: int):
    """Rows (key, item, text, passage, hits) to (key, item, words): the longest span through any of the hits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, most = [], []
            lists: dict[str, list[str]] = {}
            for r, (text, passage, hits) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("text", "passage", "hits")])):
                for t in (text, passage):
                    if t not in lists:
                        lists[t] = words_of(t)
                a, b, best = lists[text], lists[passage], 0
                for shift, positions in _by_shift(hits):
                    end = -1
                    for p in positions:
                        if p < end or p >= len(a) or p - shift >= len(b):  # covered, or a hit in another text of this id
                            continue
                        lo, hi = p, p
                        while lo > 0 and lo - shift > 0 and a[lo - 1] == b[lo - 1 - shift]:
                            lo -= 1
                        while hi < len(a) and hi - shift < len(b) and a[hi] == b[hi - shift]:
                            hi += 1
                        best, end = max(best, hi - lo), hi
                if best >= least:
                    rows.append(r)
                    most.append(best)
            took = pa.array(rows, pa.int64())
            yield pa.record_batch([batch.column("key").take(took), batch.column("item").take(took), pa.array(most, pa.int32())], names=["key", "item", "words"])

    return run


def _by_shift(hits: list[dict]) -> Iterator[tuple[int, list[int]]]:
    shifts: dict[int, list[int]] = {}
    for h in hits:
        shifts.setdefault(h["pos"] - h["at"], []).append(h["pos"])
    for shift, positions in shifts.items():
        yield shift, sorted(positions)


def leaks(corpus: DataFrame, id_col: str, text_col: str, heldout: DataFrame, item_col: str, passage_col: str, least: int = 12, k: int = 6) -> DataFrame:
    """(id_col, item_col, words): corpus rows whose text holds at least `least` consecutive words of an item's passage,
    with the length of the longest span found.

    k: words of a fingerprint, at most `least`; the window is least - k + 1. Null and empty texts and passages hold
    nothing. Rows of one id count once with all their texts; null ids are left out. Empty tables give no rows.
    """
    window = least - k + 1
    kinds = corpus.schema[id_col].dataType.simpleString(), heldout.schema[item_col].dataType.simpleString()
    texts = corpus.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text")).filter("key is not null and text is not null")
    passages = heldout.select(F.col(f"`{item_col}`").alias("item"), F.col(f"`{passage_col}`").alias("passage")).filter("item is not null and passage is not null").distinct()
    marks = texts.mapInArrow(_fingerprints(k, window), f"key {kinds[0]}, fp bigint, pos int")
    small = passages.select(F.struct("item", "passage").alias("key"), "passage")
    wanted = small.mapInArrow(_fingerprints(k, window), f"key struct<item:{kinds[1]},passage:string>, fp bigint, pos int")
    wanted = written(wanted.select("key.item", "key.passage", "fp", F.col("pos").alias("at")), "heldout")
    prints = wanted.select("fp", F.xxhash64("item", "passage").alias("which"), "at")
    bounded = rows_at_most(prints, BROADCAST_ROWS)
    met = marks.join(F.broadcast(prints) if bounded else prints, "fp").select("key", "which", "pos", "at")
    # one row per document and item: the places of their common fingerprints, at most as many as the document has
    hits = met.groupBy("key", "which").agg(F.collect_set(F.struct("pos", "at")).alias("hits"))
    hits = written(hits, "hits")
    named = wanted.select("item", "passage", F.xxhash64("item", "passage").alias("which")).distinct()
    keys = hits.select("key").distinct()
    found_texts = texts.join(F.broadcast(keys) if rows_at_most(keys, BROADCAST_ROWS) else keys, "key", "left_semi")
    both = hits.join(F.broadcast(named) if bounded else named, "which").join(found_texts, "key")
    spans = both.select("key", "item", "text", "passage", "hits").mapInArrow(_extend(least, k), f"key {kinds[0]}, item {kinds[1]}, words int")
    return spans.groupBy(F.col("key").alias(id_col), F.col("item").alias(item_col)).agg(F.max("words").alias("words"))
