"""Oversized texts cut at their strongest natural boundaries, with overlap.

Every place where a text may be cut has a strength: between functions (the less indented the stronger), between blocks
(likewise), after a line, between words. A sparse table over the strengths answers "the strongest place in this range,
the rightmost of equals" in constant time; each piece ends at the strongest place of its permissible window, which
begins `least` characters after the piece's own start and ends `limit` characters after it. Only if that window holds no
end of a function or block is the stretch before it asked too, back to the end of the piece before: a short piece comes
out where nothing else keeps the code whole. The next piece starts as far back as the overlap asks. Where a window holds no place at all (one endless word) it is cut at its end, but not
within a CR LF pair or before a combining mark.

Only texts above the limit leave the JVM, each by itself. The table covers a bounded stretch of a text at a time; the
places and their strengths are two arrays over the whole text. Time grows in proportion to the text.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT, OVERLAP = 2000, 200
BLOCK = 1100  # the least strength of a cut between functions or blocks
_STRETCH = 65_536  # places that one table covers
_WORD_PLACE = re.compile(r"(?<=[^\S\n])(?=\S)")
_FUNCTION = re.compile(
    r"(?:(?:export|default|public|private|protected|internal|static|final|abstract|async|pub(?:\([^)]*\))?|unsafe|extern|override|synchronized|const)\s+)*"
    r"(?:def\s+\w|class\s+\w|function\b\s*\*?\s*\w*\s*\(|func\s+[\w(]|fn\s+\w|impl\b|interface\s+\w|struct\s+\w|trait\s+\w|enum\s+\w|record\s+\w|mod\s+\w+\s*\{|namespace\s+\w)"
    r"|(?:(?:public|private|protected|static|final|abstract|synchronized)\s+)+[\w<>\[\],.? ]+\s\w+\s*\("
    r"|(?:export\s+)?(?:const|let|var)\s+\w+\s*=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|\w+\s*=>)"
)
_ATTACHED = re.compile(r"(?:@\w|#\[|#!\[|//|/\*|\*|#(?!include))")  # lines that belong to the function below them
_CONTINUES = re.compile(r"(?:[)\]}]|(?:else|elif|except|finally|catch|while\s*\(.*\);)\b)")
_CLOSES = re.compile(r"(?:[)\]}]+[;,)\]}]*|end)\s*$")


def places(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Places (offsets) at which the text may be cut, ascending, and their strengths.

    A place p cuts between text[p - 1] and text[p]. Strengths: 3000 less ten per indented column between functions,
    2000 less likewise between blocks, 1000 after a line, 10 between words.
    """
    strength: dict[int, int] = {m.start(): 10 for m in _WORD_PLACE.finditer(text)}
    lines = text.split("\n")
    starts, at = [], 0
    for line in lines:
        starts.append(at)
        at += len(line) + 1
    bare = [x.strip() for x in lines]
    indents = [len(x) - len(x.lstrip()) if b else 0 for x, b in zip(lines, bare)]
    above, last = "", 0  # the last line with text, and its indentation
    for i, b in enumerate(bare):
        if i:
            s = 1000
            if b and (not bare[i - 1] or (indents[i] < last or _CLOSES.match(above)) and not _CONTINUES.match(b)):
                s = 2000 - 10 * min(indents[i], 90)
            strength[starts[i]] = max(s, strength.get(starts[i], 0))
        if b and _FUNCTION.match(b):
            top = i
            while top and bare[top - 1] and _ATTACHED.match(bare[top - 1]):
                top -= 1
            if top:
                strength[starts[top]] = 3000 - 10 * min(indents[i], 90)
        if b:
            above, last = b, indents[i]
    strength.pop(0, None)
    strength.pop(len(text), None)
    order = np.array(sorted(strength), np.int64)
    return order, np.array([strength[p] for p in order.tolist()], np.int64)


class StrongestCut:
    """Sparse table for range maxima over boundary strengths; of equals the rightmost wins."""

    def __init__(self, at: np.ndarray, strength: np.ndarray):
        self.at, self.strength = at, strength
        self._from = self._to = 0
        self._levels: list[np.ndarray] = []

    def _build(self, lo: int, hi: int) -> None:
        self._from, self._to = lo, min(len(self.at), max(hi, lo + _STRETCH))
        # strength and index in one number, so that the maximum of equals is the last
        row = (self.strength[self._from : self._to] << np.int64(40)) | np.arange(self._from, self._to, dtype=np.int64)
        self._levels = [row]
        step = 1
        while 2 * step <= len(row):
            a = self._levels[-1]
            self._levels.append(np.maximum(a[:-step], a[step:]))
            step *= 2

    def query(self, first: int, last: int) -> int | None:
        """The strongest place p with first <= p <= last, or None."""
        lo, hi = np.searchsorted(self.at, (first, last + 1)).tolist()
        if lo >= hi:
            return None
        if lo < self._from or hi > self._to:
            self._build(lo, hi)
        k = (hi - lo).bit_length() - 1
        row = self._levels[k]
        best = max(int(row[lo - self._from]), int(row[hi - (1 << k) - self._from]))
        return int(self.at[best & (1 << 40) - 1])

    def strength_of(self, place: int) -> int:
        return int(self.strength[np.searchsorted(self.at, place)])


def _hard_cut(text: str, first: int, last: int) -> int:
    p = last
    while p > first and (text[p - 1 : p + 1] == "\r\n" or unicodedata.combining(text[p]) or text[p] in "‍️" or text[p - 1] == "‍"):
        p -= 1
    return p if p > first else last


def overlap_start(text: str, start: int, end: int, overlap: int) -> int:
    """Where the piece after text[start:end] starts: with that piece's last whole lines, as many as fit in `overlap`
    characters, or with its last `overlap` characters if it does not end with a whole line that fits."""
    if overlap <= 0:
        return end
    least = max(start, end - overlap)
    if text[end - 1] == "\n":
        found = text.find("\n", least - 1, end - 1) if least > 0 else -1
        if least == 0 or least == start and (start == 0 or text[start - 1] == "\n"):
            return least
        if found >= 0:
            return found + 1
    return least


def spans(text: str, limit: int = LIMIT, overlap: int = OVERLAP, least: int = 0) -> list[tuple[int, int]]:
    """The pieces of a text as (start, end) offsets, each at most `limit` long. Each begins within the piece before.

    All but the last are at least `least` long, unless the only place between functions or blocks, or the only place at
    all, comes earlier.
    """
    if limit <= overlap or limit < 1 or least > limit:
        raise ValueError("the limit must exceed the overlap, and not fall below the least length")
    if len(text) <= limit:
        return [(0, len(text))]
    cuts = StrongestCut(*places(text))
    out, start, done = [], 0, 0
    while True:
        if len(text) - start <= limit:
            out.append((start, len(text)))
            return out
        end = cuts.query(max(done + 1, start + least), start + limit)
        if end is None or cuts.strength_of(end) < BLOCK:
            early = cuts.query(done + 1, start + limit)
            if early is not None and (end is None or cuts.strength_of(early) >= BLOCK):
                end = early
        if end is None:
            end = _hard_cut(text, done + 1, start + limit)
        out.append((start, end))
        start, done = overlap_start(text, start, end, overlap), end


def _pieces(limit: int, overlap: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, no, content, first, last, offset = [], [], [], [], [], []
            for r, (text, line) in enumerate(zip(batch.column("content").to_pylist(), batch.column("start_line").to_pylist())):
                at = breaks = 0  # the line breaks before the piece's start are counted from piece to piece
                for k, (s, e) in enumerate(spans(text, limit, overlap, least)):
                    breaks += text.count("\n", at, s)
                    at = s
                    row.append(r)
                    no.append(k + 1)
                    content.append(text[s:e])
                    offset.append(s)
                    first.append(None if line is None else line + breaks)
                    last.append(None if line is None else line + breaks + text.count("\n", s, e - 1))
            keys = batch.column("key").take(pa.array(row, pa.int64()))
            yield pa.record_batch(
                [keys, pa.array(no, pa.int32()), pa.array(content, pa.string()), pa.array(first, pa.int32()), pa.array(last, pa.int32()), pa.array(offset, pa.int64())],
                names=["key", "piece_no", "content", "start_line", "end_line", "start_char"],
            )

    return run


def split_oversized(df: DataFrame, id_col: str = "chunk_id", content_col: str = "content", line_col: str = "start_line", limit: int = LIMIT, overlap: int = OVERLAP, least: int | None = None) -> DataFrame:
    """(id, piece_no from 1, content, start_line, end_line, start_char) of every row whose content exceeds `limit`
    characters (Unicode code points).

    least: see spans(); a quarter of the limit if None. end_line is the line of the piece's last character. Null and short contents give no rows; a null line gives null
    lines; repeated rows are cut once each (drop them before or after); other columns are not carried.
    """
    kind = df.schema[id_col].dataType.simpleString()
    rows = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{content_col}`").alias("content"), F.col(f"`{line_col}`").cast("int").alias("start_line"))
    cut = rows.filter(F.length("content") > limit).mapInArrow(_pieces(limit, overlap, limit // 4 if least is None else least), f"key {kind}, piece_no int, content string, start_line int, end_line int, start_char bigint")
    return cut.withColumnRenamed("key", id_col)
