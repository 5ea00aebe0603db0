"""Token ids of a whole corpus by a public byte-level BPE vocabulary, with long texts encoded in parts.

Tree concatenation. A text is cut into leaves, each leaf is encoded by itself, and neighbours are put together pair by
pair. Where a cut falls on a boundary that the vocabulary's splitting pattern must make anyway, the halves' ids simply
follow each other. Where a stretch has no such boundary (one unsplit piece: a long run of letters, digits, signs or
blanks), the ids around the join are decoded and encoded again, in a window that grows until its first id and its last
id are those that the halves have there; then the ids left and right of the window stand next to neighbours that they
were already encoded beside, so the sequence is the one that the whole piece has. (A sequence of BPE tokens is the
encoding of its text exactly if each two neighbours are the encoding of theirs.)

Texts of up to `leaf` characters are encoded where they are. Longer ones are cut into leaves that are spread over the
cluster, encoded there, and put together by document, so one huge document neither holds up a task nor grows in a
quadratic way.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# The splitting pattern belongs to the vocabulary; fixed value.
SPLIT = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 32_768
HELD = 500_000  # ids that a worker gathers before it passes them on
PIECE = 256  # bytes of an unsplit piece above which it is encoded by halves

_W = r"\p{White_Space}"
# Cuts after which a new piece begins whatever the surroundings: blank after non-blank; end of a run of letters or digits.
_SAFE = regex.compile(rf"(?<=[^{_W}])(?={_W})|(?<=\p{{L}})(?=[^\p{{L}}])|(?<=\p{{N}})(?=[^\p{{N}}])")
_LONG = regex.compile(rf"\p{{L}}{{{PIECE},}}+|\p{{N}}{{{PIECE},}}+|[^{_W}\p{{L}}\p{{N}}]{{{PIECE},}}+|{_W}{{{PIECE},}}+")
_BLANKS = re.compile(rf"\s{{{PIECE}}}")
_PIECES = regex.compile(SPLIT.replace(r"[^\s", rf"[^{_W}").replace(r"\s", _W).replace(r"\S", rf"[^{_W}]"))
_held: dict[str, tiktoken.Encoding] = {}


def encoding(vocabulary: str = DEFAULT_VOCABULARY) -> tiktoken.Encoding:
    """The vocabulary, read once by each Python worker; no special tokens, so their spellings are ordinary text."""
    if vocabulary not in _held:
        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        _held[vocabulary] = tiktoken.Encoding(os.path.basename(vocabulary), pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
    return _held[vocabulary]


def join_ids(enc: tiktoken.Encoding, left: list[int], right: list[int], window: int = 4) -> list[int]:
    """The ids of one unsplit piece from those of its two parts."""
    if not left or not right:
        return left + right
    w = window
    while True:
        i, j = max(0, len(left) - w), min(len(right), w)
        again = enc._encode_single_piece(b"".join(enc.decode_tokens_bytes(left[i:] + right[:j])))
        if (i == 0 or again[0] == left[i]) and (j == len(right) or again[-1] == right[j - 1]):
            return left[:i] + again + right[j:]
        w *= 2


def encode_piece(enc: tiktoken.Encoding, piece: bytes) -> list[int]:
    """Ids of one unsplit piece: halves, then the join, down to PIECE bytes."""
    if len(piece) <= PIECE:
        return enc._encode_single_piece(piece)
    half = len(piece) // 2
    return join_ids(enc, encode_piece(enc, piece[:half]), encode_piece(enc, piece[half:]))


def encode_text(enc: tiktoken.Encoding, text: str) -> list[int]:
    """Ids of a text; unsplit pieces above PIECE bytes go through encode_piece()."""
    if len(text) < PIECE or max(map(len, text.split()), default=0) < PIECE and not _BLANKS.search(text):
        return enc.encode_ordinary(text)
    out: list[int] = []
    at = 0
    for run in _LONG.finditer(text):
        inside = run.start()
        if inside < at:
            continue
        safe = inside
        while safe > at and not _is_safe(text, safe):
            safe -= 1
        out += enc.encode_ordinary(text[at:safe])
        at = safe
        while at <= inside:
            end = _PIECES.match(text, at).end()
            out += encode_piece(enc, text[at:end].encode("utf-8"))
            at = end
    return out + enc.encode_ordinary(text[at:])


def _is_safe(text: str, i: int) -> bool:
    return _SAFE.match(text, i) is not None


def leaves(text: str, leaf: int = LEAF) -> list[tuple[str, bool]]:
    """The text in parts of about `leaf` characters, each with whether its start lies within an unsplit piece.

    Looks for a safe cut in the second half of the leaf; where there is none the cut falls within a run, never before
    an apostrophe (which could begin a contraction) nor before the last blank of a run.
    """
    out, at, inside = [], 0, False
    while len(text) - at > leaf:
        cut, to = None, at + leaf
        for i in range(to, at + leaf // 2, -1):
            if _is_safe(text, i):
                cut = i
                break
        if cut is not None:
            out.append((text[at:cut], inside))
            at, inside = cut, False
            continue
        cut = to
        while cut < len(text) and not _may_cut(text, cut):
            cut += 1
        out.append((text[at:cut], inside))
        at, inside = cut, cut < len(text) and not _is_safe(text, cut)
    if at < len(text) or not out:
        out.append((text[at:], inside))
    return out


def _may_cut(text: str, i: int) -> bool:
    """Whether a cut at i is safe or falls within one piece so that both parts split as the whole does."""
    if _is_safe(text, i):
        return True
    if "'" in text[max(0, i - 3) : i + 1] or _kind(text[i - 1]) != _kind(text[i]):
        return False
    return _kind(text[i]) != 3 or i + 1 < len(text) and _kind(text[i + 1]) == 3


def _kind(c: str) -> int:
    """0 letter, 1 digit, 2 other sign, 3 blank."""
    return next(k for k, p in enumerate(_KINDS) if p.match(c))


_KINDS = [regex.compile(p) for p in (r"\p{L}", r"\p{N}", rf"[^{_W}\p{{L}}\p{{N}}]", _W)]


def _last_piece(text: str) -> int:
    """Bytes of the last piece of a leaf that was cut within a run."""
    at = max(0, len(text) - 1)
    while at > 0 and not _is_safe(text, at):
        at -= 1
    last = (at, at)
    while at < len(text):
        m = _PIECES.match(text, at)
        last = m.span()
        at = m.end()
    return len(text[last[0] :].encode("utf-8"))


def _first_piece(text: str) -> int:
    m = _PIECES.match(text)
    return len(text[: m.end()].encode("utf-8"))


def _split_ids(enc: tiktoken.Encoding, ids: list[int], size: int, last: bool) -> tuple[list[int], list[int]]:
    """ids cut so that `size` bytes stand in the last (or first) part."""
    lengths = np.array([len(x) for x in enc.decode_tokens_bytes(ids)])
    if last:
        k = len(ids) - int(np.searchsorted(np.cumsum(lengths[::-1]), size)) - 1
        return ids[:k], ids[k:]
    k = int(np.searchsorted(np.cumsum(lengths), size)) + 1
    return ids[:k], ids[k:]


class Part:
    """Ids of consecutive leaves; head and tail are the bytes that belong to a piece open to the left or right."""

    __slots__ = ("ids", "head", "tail", "whole", "open_left")

    def __init__(self, ids: list[int], head: int, tail: int, whole: bool, open_left: bool):
        self.ids, self.head, self.tail, self.whole, self.open_left = ids, head, tail, whole, open_left


def part_of(ids: list[int], text: str, open_left: bool) -> Part:
    head, tail = _first_piece(text) if text else 0, _last_piece(text) if text else 0
    return Part(ids, head, tail, head == len(text.encode("utf-8")), open_left)


def put_together(enc: tiktoken.Encoding, a: Part, b: Part) -> Part:
    """Two neighbouring parts as one."""
    if not b.open_left:
        return Part(a.ids + b.ids, a.head, b.tail, False, a.open_left)
    before, last = _split_ids(enc, a.ids, a.tail, True) if not a.whole else ([], a.ids)
    first, after = _split_ids(enc, b.ids, b.head, False) if not b.whole else (b.ids, [])
    ids = before + join_ids(enc, last, first) + after
    return Part(ids, a.head + b.head if a.whole else a.head, a.tail + b.tail if b.whole else b.tail, a.whole and b.whole, a.open_left)


def concatenate(enc: tiktoken.Encoding, parts: list[Part]) -> list[int]:
    """The tree: neighbours pair by pair, level by level."""
    while len(parts) > 1:
        parts = [put_together(enc, *parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0].ids if parts else []


def encode_long(enc: tiktoken.Encoding, text: str, leaf: int = LEAF) -> list[int]:
    """Ids of a text by leaves in one place; what the distributed form computes."""
    return concatenate(enc, [part_of(encode_text(enc, t), t, inside) for t, inside in leaves(text, leaf)])


def _encode_short(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for batch in batches:
            start, held, ids = 0, 0, []
            for i, text in enumerate(batch.column(1).to_pylist()):
                ids.append(encode_text(enc, text) if text else [])
                held += len(ids[-1])
                if held > HELD or i + 1 == batch.num_rows:  # lists of Python numbers are large: pass them on early
                    yield _rows(batch.column(0).slice(start, len(ids)), ids)
                    start, held, ids = i + 1, 0, []

    return run


def _rows(keys: pa.Array, ids: list[list[int]]) -> pa.RecordBatch:
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
    flat = np.fromiter((v for x in ids for v in x), np.int32, int(offsets[-1]))
    return pa.record_batch([keys, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))], names=["key", "ids"])


def _cut(leaf: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, row, text in zip(*[c.to_pylist() for c in batch.columns]):
                for k, (t, inside) in enumerate(leaves(text, leaf)):
                    yield pa.record_batch([pa.array([key], batch.column(0).type), pa.array([row]), pa.array([k], pa.int32()), pa.array([t]), pa.array([inside])], names=["key", "row", "k", "leaf", "inside"])

    return run


def _encode_leaves(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            parts = [part_of(encode_text(enc, t), t, i) for t, i in zip(b.column("leaf").to_pylist(), b.column("inside").to_pylist())]
            ids = _rows(b.column("key"), [p.ids for p in parts]).column("ids")
            yield pa.record_batch(
                [b.column("key"), b.column("row"), b.column("k"), ids, pa.array([p.head for p in parts], pa.int64()), pa.array([p.tail for p in parts], pa.int64()), pa.array([p.whole for p in parts]), pa.array([p.open_left for p in parts])],
                names=["key", "row", "k", "ids", "head", "tail", "whole", "open_left"],
            )

    return run


def _gather(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(vocabulary)
        for b in batches:
            ids = []
            for parts in b.column("parts").to_pylist():
                ids.append(concatenate(enc, [Part(p["ids"], p["head"], p["tail"], p["whole"], p["open_left"]) for p in parts]))
            yield _rows(b.column("key"), ids)

    return run


def encode_corpus(df: DataFrame, id_col: str, text_col: str, vocabulary: str = DEFAULT_VOCABULARY, leaf: int = LEAF) -> DataFrame:
    """(id_col, ids array<int>): one row per input row; null and empty texts have an empty list; a null id stays null.

    `vocabulary` is the path of the ranks on every executor. Texts above `leaf` characters are cut, spread, encoded and
    put together by document: a document's ids meet in one row, as the result demands, and no other document's do.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
    long = F.coalesce(F.length("text"), F.lit(0)) > leaf
    short = rows.filter(~long).mapInArrow(_encode_short(vocabulary), f"key {kind}, ids array<int>")
    marked = rows.filter(long).select("key", F.monotonically_increasing_id().alias("row"), "text")
    cut = marked.mapInArrow(_cut(leaf), f"key {kind}, row bigint, k int, leaf string, inside boolean")
    spread = cut.repartition(F.col("row"), F.col("k"))
    done = spread.mapInArrow(_encode_leaves(vocabulary), f"key {kind}, row bigint, k int, ids array<int>, head bigint, tail bigint, whole boolean, open_left boolean")
    gathered = done.groupBy("row").agg(F.first("key").alias("key"), F.array_sort(F.collect_list(F.struct("k", "ids", "head", "tail", "whole", "open_left"))).alias("parts"))
    put = gathered.select("key", "parts").mapInArrow(_gather(vocabulary), f"key {kind}, ids array<int>")
    return short.union(put).select(F.col("key").alias(id_col), "ids")
