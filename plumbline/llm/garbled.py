"""Text that was read in a wrong character encoding: found, and restored where its bytes survived.

Reading bytes in a wrong encoding changes only characters outside ASCII (for all encodings considered), so a garbled
text and a clean near-twin of it are equal once stripped of non-ASCII characters. Twins are joined on that skeleton, at
the level of sentences and of words: of the variants of one skeleton the most frequent and the shortest without losses are
the references, and every other variant is aligned with them, non-ASCII run by non-ASCII run. A transformation (the
encoding it was read in, the one it was written in) that maps aligned runs onto each other, in either direction, gets
their votes. The transformations learned so are applied to
all records, in turn until nothing changes (text may be garbled twice):

* written in UTF-8: sequences that are valid UTF-8 under the encoding read are decoded, if what comes out are characters
  that texts use. Valid sequences of several bytes hardly occur by chance.
* written in another one-byte encoding: any text decodes, so a word is taken as garbled only if its decoded form is a
  word of the corpus and the better word of the two: by the letter pairs of the corpus's words of natural shape (lower
  case, or one capital in front; one script), by shape, and where both leave it open by RATIO times as many texts.
* characters lost on the way: a replacement character is the decoder's own mark of a loss; control codes from the upper
  half and half sequences count only where votes show that UTF-8 was misread in the corpus. Words are restored from the
  most frequent clean word with the same skeleton, else the loss stays marked.

A garbled sequence that stands alone between ASCII quotes or backticks is quoted as a subject and is no case.

What is collected to the driver is bounded whatever the corpus: votes by pair of encodings, and counts by character.
Frequencies are numbers of distinct texts, so copies of one text, garbled or not, weigh as one. Counts of words and
variants combine before their shuffle; a frequent skeleton brings one row for each distinct variant. Nothing is too long
to learn from: words are taken in parts of WORD_PART characters, sentences in parts of SENTENCE_PART ASCII characters
(these stand at the same places in a garbled text and its twin).
"""

from __future__ import annotations

import bisect
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plumbline.session import rows_at_most, written

# The encodings considered.
READ = ("cp1252", "latin-1", "iso8859-15", "cp1250", "iso8859-2", "cp1251", "mac_roman", "cp437", "cp850", "cp852", "cp1254", "iso8859-9", "cp866", "koi8-r", "cp1253", "cp1257", "mac_cyrillic", "iso8859-5")
ONE_BYTE = [(r, w) for w in ("koi8-r", "cp1251", "cp866", "iso8859-5", "mac_cyrillic") for r in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic", "latin-1", "cp1252", "cp437", "cp850", "mac_roman") if r != w] + [
    (r, w) for w in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250") for r in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251") if r != w
]
LETTERS_ABOVE = {"cp1251", "cp866", "koi8-r", "mac_cyrillic", "iso8859-5", "cp1253"}  # encodings whose upper half is mostly letters
VOTES = 2  # distinct aligned pairs that a transformation needs
RATIO, WORD_DOCS, WORD_VOTES, WORD_LETTERS = 5, 2, 5, 3
LEAN = 1.0  # mean difference of the letter pairs' logarithms (base 2) that decides which of two words is garbled
BROADCAST_ROWS = 200_000
WORD_PART, SENTENCE_PART, LONG_SENTENCE = 64, 300, 2000

_RUN = re.compile(r"[^\x00-\x7f]+")
_TOKEN = re.compile(r"[A-Za-z]*[^\x00-\x7f][A-Za-z\u0080-\U0010ffff]*")
_SENTENCE = re.compile(r"\n+|(?<=[.!?:;])\s+")
_LOST = re.compile(r"�|[\x80-\x84\x86-\x9f]")
# Half sequences: lead bytes of UTF-8 with signs of the following bytes, again and again, as Latin-1 shows them when the
# control codes between them were dropped.
_HALF = re.compile("[\u00c2-\u00f4][\u00a1-\u00bf][\u00c2-\u00f4]*[\u00c2-\u00f4][\u00a1-\u00bf]")
_INVISIBLE = re.compile("[\\x80-\\xa0\\xad\\s]")
_SIGN = re.compile("[\u2010-\u205e\u20a0-\u20bf\u2100-\u27bf\u2900-\u2bff\ufe0f\U0001f300-\U0001faff]")  # signs that texts may use once
# A word that stands alone between ASCII quotes or backticks.
_QUOTED = re.compile(r"(?<=([\"'`]))(?:[^\W_]|[^\x00-\x7f])++(?=\1)")
_PIECE = re.compile(r"[^\x00-\x7f]*[\x00-\x7f]")


@lru_cache(maxsize=None)
def _table(read: str) -> dict[str, int]:
    """Character to byte, as a reader in this encoding showed it; bytes without a character show as control codes."""
    table: dict[str, int] = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(read)
        except UnicodeDecodeError:
            c = chr(b)
        table.setdefault(c, b)
    if read in ("cp1252", "cp1250", "cp1251", "cp1254", "cp1253", "cp1257"):
        for b in range(0x80, 0xA0):
            table.setdefault(chr(b), b)
    return table


def to_bytes(text: str, read: str) -> bytes | None:
    """The bytes that were read as `text` in the encoding `read`; None if it has no such bytes."""
    table = _table(read)
    try:
        return bytes(ord(c) if c < "\x80" else table[c] for c in text)
    except KeyError:
        return None


def decode(text: str, read: str, wrote: str) -> str | None:
    """`text`, read in `read`, as it was written in `wrote`; None if that does not fit."""
    raw = to_bytes(text, read)
    if raw is None:
        return None
    try:
        return raw.decode(wrote)
    except UnicodeDecodeError:
        return None


@lru_cache(maxsize=None)
def _sequences(read: str) -> re.Pattern[str]:
    """Runs of valid UTF-8 sequences of two to four bytes, as characters of the encoding `read`."""
    shown: dict[int, list[str]] = {}
    for c, b in _table(read).items():
        shown.setdefault(b, []).append(c)

    def some(lo: int, hi: int) -> str:
        return "[" + "".join(re.escape(c) for b in range(lo, hi + 1) for c in shown.get(b, [])) + "]"

    def has(lo: int, hi: int) -> bool:
        return any(b in shown for b in range(lo, hi + 1))

    follow = some(0x80, 0xBF)
    kinds = [some(lo, hi) + follow * n for lo, hi, n in ((0xC2, 0xDF, 1), (0xE0, 0xEF, 2), (0xF0, 0xF4, 3)) if has(lo, hi)]
    return re.compile("(?:" + "|".join(reversed(kinds)) + ")+")


def skeleton(text: str) -> str:
    """The text stripped of non-ASCII characters."""
    return _RUN.sub("", text)


def runs(text: str) -> list[tuple[int, str]]:
    """The non-ASCII runs of a text with their offsets in its skeleton."""
    out, gone = [], 0
    for m in _RUN.finditer(text):
        out.append((m.start() - gone, m.group()))
        gone += m.end() - m.start()
    return out


def align(variant: str, reference: str) -> list[tuple[str, str]]:
    """Aligned runs of two texts of one skeleton; empty if their runs stand at different places."""
    a, b = runs(variant), runs(reference)
    if [x for x, _ in a] != [x for x, _ in b]:
        return []
    return [(g, c) for (_, g), (_, c) in zip(a, b) if g != c]


def infer(variant: str, reference: str) -> list[tuple[str, str, str, str]]:
    """(read, wrote, garbled run, clean run) of each transformation that explains an aligned pair of runs.

    A run that was garbled twice votes for the transformation that explains its last step.
    """
    out = []
    for g, c in align(variant, reference):
        for read in READ:
            got = decode(g, read, "utf-8")
            if got == c or got is not None and any(decode(got, again, "utf-8") == c for again in READ[:4]):
                out.append((read, "utf-8", g, c))
        for read, wrote in ONE_BYTE:
            if len(g) == len(c) >= 2 and decode(g, read, wrote) == c:
                out.append((read, wrote, g, c))
    return out


@lru_cache(maxsize=None)
def _script(c: str) -> str:
    return unicodedata.name(c, "?").split(" ")[0]


def broken(word: str) -> bool:
    """Whether a capital follows a small letter, or scripts mix, inside the word."""
    return any(a.islower() and b.isupper() or _script(a) != _script(b) for a, b in zip(word, word[1:]))


def natural(word: str) -> bool:
    """Whether a word has the shape that most words have: one script, small letters behind the first."""
    return word.isalpha() and word[1:].islower() and _script(word[0]) in ("LATIN", "CYRILLIC", "GREEK") and not broken(word)


def letter_pairs(word: str) -> list[str]:
    folded = f"^{word.lower()}$"
    return [a + b for a, b in zip(folded, folded[1:])]


def is_garbled(word: str, n: int, decoded: str, n_decoded: int, letters: dict[str, int]) -> bool:
    """Whether, of two words that a one-byte transformation maps onto each other, `word` is the garbled one.

    letters: in how many distinct words of natural shape each pair of letters stands. Garbling breaks that shape, so these
    counts tell clean words however often a garbled text is repeated. The numbers of texts decide only what stays open.
    """

    def score(w: str) -> float:
        own = natural(w)
        pairs = letter_pairs(w)
        return sum(math.log2(1 + max(letters.get(p, 0) - own, 0)) for p in pairs) / len(pairs)

    lean = score(decoded) - score(word)
    if abs(lean) >= LEAN:
        return lean > 0
    if broken(word) != broken(decoded):
        return broken(word)
    if natural(word) != natural(decoded) and (lean > 0) == natural(decoded):
        return natural(decoded)  # letters and shape agree
    return n_decoded >= RATIO * n


def remains(run: str, clean: str) -> bool:
    """Whether a run is what is left of `clean`, misread from UTF-8, when its control codes and blanks were dropped."""
    return any(_INVISIBLE.sub("", clean.encode().decode(read, "ignore")) == _INVISIBLE.sub("", run) for read in ("latin-1", "cp1252"))


class Mapping:
    """What was learned: encodings that UTF-8 was read in, and how many texts use each character."""

    def __init__(self, reads: list[str], characters: dict[str, int]):
        self.reads = [r for r in READ if r in reads]
        self.used = {c for c, n in characters.items() if n >= 2}
        self._known: dict[str, str | None] = {}

    def plausible(self, text: str) -> bool:
        """Whether decoded text consists of characters that texts use."""
        for c in text:
            if c < "\x80" or c in self.used and not "\x80" <= c <= "\x9f":
                continue
            if not ("\xa1" <= c <= "\xff" or _SIGN.match(c) or "А" <= c <= "ё" and len(text) > 1):
                return False
            if unicodedata.category(c) in ("Cn", "Co", "Cc"):
                return False
        return True

    def step(self, text: str) -> str:
        """One decoding of every sequence that fits the first encoding that changes anything, in the order of READ."""
        for read in self.reads:

            def fix(m: re.Match[str], read: str = read) -> str:
                got = decode(m.group(), read, "utf-8")
                if got is None or not (self.plausible(got) or self.plausible(self.step(got)) and self.step(got) != got):
                    return m.group()
                return got

            covered = sum(len(m.group()) for m in _sequences(read).finditer(text))
            # letters of a script may chance to form a sequence: most of the run must be one
            if covered and (read not in LETTERS_ABOVE or 2 * covered > len(text)):
                after = _sequences(read).sub(fix, text)
                if after != text:
                    return after
        return text

    def restored(self, run: str) -> str | None:
        """The run decoded until nothing changes; None if it is neither garbled nor lossy. Runs repeat, so they are kept."""
        if run in self._known:
            return self._known[run]
        lost, now = "\ufffd" in run or self.reads and (_LOST.search(run) or _HALF.search(run)), run
        if lost or len(run) > 1 and any(_sequences(r).search(run) for r in self.reads):
            for _ in range(6):
                after = self.step(now)
                if after == now:
                    break
                now = after
        if len(self._known) > 200_000:
            self._known.clear()
        out = self._known[run] = now if now != run or lost else None
        return out

    def stretches(self, text: str) -> list[tuple[int, int, str]]:
        """(start, end, restored) of the garbled stretches; restored is equal to the stretch where characters were lost."""
        found = [(m.start(), m.end(), now) for m in _RUN.finditer(text) if (now := self.restored(m.group())) is not None]
        quoted = _quoted(text) if found else []
        return [x for x in found if not _within(quoted, x[0], x[1])]


def _quoted(text: str) -> list[tuple[int, int]]:
    """The words that stand alone between ASCII quotes or backticks, in order."""
    return [m.span() for m in _QUOTED.finditer(text)]


def _within(spans: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether text[start:end] lies within one of the spans, which are in order and do not meet."""
    k = bisect.bisect_right(spans, (start, len(spans) and spans[-1][1])) - 1
    return k >= 0 and spans[k][1] >= end


def tokens(text: str) -> Iterator[tuple[int, int]]:
    """The words with characters outside ASCII; long ones in parts."""
    for m in _TOKEN.finditer(text):
        if m.end() - m.start() <= WORD_PART:
            yield m.span()
        else:
            yield from ((a, min(a + WORD_PART, m.end())) for a in range(m.start(), m.end(), WORD_PART))


def sentences(text: str) -> set[str]:
    """The distinct sentences with characters outside ASCII and ASCII letters; long ones in parts of as many ASCII
    characters."""
    out = set()
    for s in _SENTENCE.split(text):
        if len(s) <= LONG_SENTENCE:
            out.add(s)
            continue
        at = [0, *[m.end() for k, m in enumerate(_PIECE.finditer(s), 1) if k % SENTENCE_PART == 0], len(s)]
        out.update(s[a:b] for a, b in zip(at, at[1:]))
    return {s for s in out if _RUN.search(s) and sum(c.isalpha() for c in skeleton(s)) >= 6}


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, copies) to their distinct words with non-ASCII characters: how many of the texts have each, and how many rows."""
    for batch in batches:
        counts: Counter[str] = Counter()
        rows: Counter[str] = Counter()
        for text, copies in zip(batch.column("text").to_pylist(), batch.column("copies").to_pylist()):
            words = {text[a:b] for a, b in tokens(text)}
            counts.update(words)
            for w in words:
                rows[w] += copies
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64()), pa.array([rows[w] for w in counts], pa.int64())], names=["word", "n", "copies"])


def _row_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(row, text) to (row, word): each text's distinct words with non-ASCII characters."""
    for batch in batches:
        words = [{text[a:b] for a, b in tokens(text)} for text in batch.column("text").to_pylist()]
        at = [r for r, w in zip(batch.column("row").to_pylist(), words) for _ in w]
        yield pa.record_batch([pa.array(at, pa.int64()), pa.array([x for w in words for x in w], pa.string())], names=["row", "garbled"])


def _sentences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to their distinct sentences that have both ASCII letters and other characters."""
    for batch in batches:
        counts: Counter[str] = Counter()
        for text in batch.column("text").to_pylist():
            counts.update(sentences(text))
        keys = [skeleton(s) for s in counts]
        yield pa.record_batch([pa.array(keys, pa.string()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["skeleton", "variant", "n"])


def _infer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        votes = set()
        for v, frequent, shortest in zip(*(batch.column(c).to_pylist() for c in ("variant", "reference", "shortest"))):
            votes.update(infer(v, frequent))
            # UTF-8 decodes in one direction only, so the garbled text of the two need not be the rarer one
            votes.update(x for a, b in ((frequent, v), (v, shortest), (shortest, v)) for x in infer(a, b) if x[1] == "utf-8")
        yield pa.record_batch([pa.array([v[k] for v in votes], pa.string()) for k in range(4)], names=["read", "wrote", "garbled", "clean"])


def _decoded_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) to (read, wrote, decoded, word, n) under each one-byte transformation that yields letters only."""
    for batch in batches:
        out: list[list] = [[], [], [], [], []]
        for word, n in zip(batch.column("word").to_pylist(), batch.column("n").to_pylist()):
            if len(word) < WORD_LETTERS or _LOST.search(word):
                continue
            for read, wrote in ONE_BYTE:
                got = decode(word, read, wrote)
                if got and got != word and got.isalpha():
                    for column, v in zip(out, (read, wrote, got, word, n)):
                        column.append(v)
        kinds = [pa.string()] * 4 + [pa.int64()]
        yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["read", "wrote", "decoded", "garbled", "n"])


def _letter_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts = Counter(p for w in batch.column("word").to_pylist() if len(w) >= WORD_LETTERS and natural(w) for p in letter_pairs(w))
        yield pa.record_batch([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], names=["pair", "n"])


def _directed(letters: dict[str, int]):
    """The rows (.., decoded, garbled, n, n_clean) whose garbled word is the garbled one of the two."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("garbled", "n", "decoded", "n_clean")))
            yield batch.filter(pa.array([is_garbled(*r, letters) for r in rows], pa.bool_()))

    return run


def _sound(mapping: Mapping):
    """The words that are neither garbled nor lossy."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not mapping.stretches(w) for w in batch.column("word").to_pylist()], pa.bool_()))

    return run


def _aligned(mapping: Mapping):
    """Twins to the runs that decoding does not restore, with the sound runs they are aligned with."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [
                (g, c)
                for a, b, short in zip(*(batch.column(x).to_pylist() for x in ("variant", "reference", "shortest")))
                # a garbled text may be the frequent one: then the shortest, if the run is what misreading leaves of it
                for g, c in [x for x in align(a, b) if not mapping.stretches(x[1])] or [x for x in align(a, short) if remains(*x)]
                if len(g) >= 3 and not mapping.stretches(c) and (found := mapping.stretches(g)) and found[0][2] != c
            ]
            yield pa.record_batch([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], names=["garbled", "clean"])

    return run


def _restore(mapping: Mapping):
    """Rows (key, text, words map) to (key, n_stretches, n_lost, restored) of the garbled texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, stretches, lost, restored = [], [], [], []
            for r, (text, words) in enumerate(zip(batch.column("text").to_pylist(), batch.column("words").to_pylist())):
                known = dict(words or [])
                found = mapping.stretches(text)
                spans = [(a, b, now) for a, b, now in found]
                taken = {(a, b) for a, b, _ in found}
                n_words = 0
                if known:
                    whole = {a for a, _, now in found if not _LOST.search(now) and not _RUN.search(now) or now.isalpha()}
                    quoted, places = _quoted(text), sorted(a for a, _ in taken)
                    replaced: list[tuple[int, int, str]] = []
                    for start, end in tokens(text):
                        inside = places[bisect.bisect_left(places, start) : bisect.bisect_left(places, end)]
                        if text[start:end] in known and not (inside and all(a in whole for a in inside)) and not _within(quoted, start, end):
                            replaced.append((start, end, known[text[start:end]]))
                            n_words += not inside
                    starts = [(a, b) for a, b, _ in replaced]
                    spans = [s for s in spans if not _within(starts, s[0], s[0] + 1)] + replaced
                if not spans:
                    continue
                out, at = [], 0
                for a, b, now in sorted(spans):
                    if a >= at:
                        out += [text[at:a], now]
                        at = b
                whole = "".join(out) + text[at:]
                rows.append(r)
                stretches.append(len(found) + n_words)
                lost.append(len(_LOST.findall(whole)) + sum(len(_HALF.findall(now)) for _, _, now in spans))
                restored.append(whole)
            keys = batch.column("key").take(pa.array(rows, pa.int64()))
            yield pa.record_batch([keys, pa.array(stretches, pa.int32()), pa.array(lost, pa.int32()), pa.array(restored, pa.string())], names=["key", "n_stretches", "n_lost", "restored"])

    return run


class Garbled:
    """Garbled texts of a table.

    df: any columns; id_col and text_col name those used. Null, empty and pure ASCII texts are never cases. Repeated rows
    repeat. An empty table learns nothing and has no cases.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str):
        self.id_col, self.kind = id_col, df.schema[id_col].dataType.simpleString()
        rows = df.select(F.col(f"`{id_col}`").alias("key"), F.col(f"`{text_col}`").alias("text"))
        self.texts = rows.filter(F.col("text").rlike("[^\\x00-\\x7f]"))
        # copies of a text are one text for all statistics
        self.distinct = written(self.texts.groupBy("text").agg(F.count(F.lit(1)).alias("copies")), "distinct")
        words = self.distinct.mapInArrow(_words, "word string, n bigint, copies bigint")
        self.words = written(words.groupBy("word").agg(F.sum("n").alias("n"), F.sum("copies").alias("copies")), "words")
        self._pairs: DataFrame | None = None

    def pairs(self) -> DataFrame:
        """(variant, reference, shortest): sentences and words with the variants of their skeleton that they are measured by."""
        if self._pairs is not None:
            return self._pairs
        sentences = self.distinct.select("text").mapInArrow(_sentences, "skeleton string, variant string, n bigint")
        stripped = F.regexp_replace("word", "[^\\x00-\\x7f]+", "")
        words = self.words.select(stripped.alias("skeleton"), F.col("word").alias("variant"), "n").filter("length(skeleton) >= 2")
        variants = sentences.union(words).groupBy("skeleton", "variant").agg(F.sum("n").alias("n"))
        # the references are the most frequent variant, of equals the shortest, and - a garbled text may stand in more
        # texts than the clean one - the shortest that lost nothing: reading UTF-8 wrong never shortens. One row per
        # skeleton comes out of sums that combine before the shuffle, so a frequent skeleton is no hot group.
        size = -F.length("variant")
        rank = F.struct(F.col("n"), size, F.col("variant"))
        sound = ~F.col("variant").rlike(f"{_LOST.pattern}|{_HALF.pattern}")
        variants = written(variants, "variants")
        reference = variants.groupBy("skeleton").agg(F.max(rank).getField("variant").alias("frequent"), F.max(F.when(sound, F.struct(size, F.col("n"), F.col("variant")))).getField("variant").alias("shortest"), F.count(F.lit(1)).alias("k"))
        references = reference.filter("k > 1").select("skeleton", F.col("frequent").alias("reference"), F.coalesce("shortest", "frequent").alias("shortest"))
        joined = variants.join(references, "skeleton").filter("variant <> reference or variant <> shortest")
        self._pairs = written(joined.select("variant", "reference", "shortest"), "pairs")
        return self._pairs

    def votes(self) -> DataFrame:
        """(read, wrote, votes): distinct aligned pairs of runs that each transformation explains."""
        found = self.pairs().mapInArrow(_infer, "read string, wrote string, garbled string, clean string")
        return found.distinct().groupBy("read", "wrote").agg(F.count(F.lit(1)).alias("votes"))

    def mapping(self) -> Mapping:
        reads = [r["read"] for r in self.votes().filter((F.col("votes") >= VOTES) & (F.col("wrote") == "utf-8")).collect()]
        letters = self.words.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"), "copies").filter("c rlike '[^\\\\x00-\\\\x7f]'").groupBy("c").agg(F.sum("copies").alias("n"))
        return Mapping(reads, {r["c"]: r["n"] for r in letters.collect()})

    def word_map(self, mapping: Mapping) -> DataFrame:
        """(garbled, clean): words of a wrong one-byte encoding, and words that lost characters, with their clean form."""
        decoded = self.words.mapInArrow(_decoded_words, "read string, wrote string, decoded string, garbled string, n bigint")
        sound = written(self.words.filter(F.col("copies") >= WORD_DOCS).select("word", "n").mapInArrow(_sound(mapping), "word string, n bigint"), "sound")
        clean = sound.select(F.col("word").alias("decoded"), F.col("n").alias("n_clean"))
        pairs = self.words.mapInArrow(_letter_pairs, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))
        letters = {r["pair"]: r["n"] for r in pairs.collect()}  # bounded by the letters of three scripts
        both = decoded.join(clean, "decoded")
        met = written(both.mapInArrow(_directed(letters), both.schema), "met")
        good = met.groupBy("read", "wrote").agg(F.count_distinct("decoded").alias("votes")).filter(F.col("votes") >= WORD_VOTES)
        swapped = met.join(F.broadcast(good.drop("votes")), ["read", "wrote"]).groupBy("garbled").agg(F.max(F.struct("n_clean", "decoded")).getField("decoded").alias("clean"))
        has_lost = F.col("word").rlike("[\\x80-\\x84\\x86-\\x9f\\uFFFD]")
        holes = F.regexp_replace("word", "[^\\x00-\\x7f]+", "?")
        lossy = self.words.filter(has_lost).select(F.col("word").alias("garbled"), holes.alias("holes")).filter("length(holes) >= 4")
        whole = sound.join(swapped.select(F.col("garbled").alias("word")), "word", "left_anti").groupBy(holes.alias("holes")).agg(F.max(F.struct("n", "word")).getField("word").alias("clean"))
        aligned = self.pairs().mapInArrow(_aligned(mapping), "garbled string, clean string").groupBy("garbled", "clean").count()
        aligned = aligned.groupBy("garbled").agg(F.max(F.struct("count", "clean")).getField("clean").alias("clean"))
        return swapped.union(lossy.join(whole, "holes").select("garbled", "clean")).union(aligned).groupBy("garbled").agg(F.min("clean").alias("clean"))

    def restored(self) -> DataFrame:
        """(id, n_stretches, n_lost, restored): garbled texts, their garbled stretches, characters still lost, and the
        text with what could be restored."""
        mapping = self.mapping()
        known = written(self.word_map(mapping), "known")
        small = rows_at_most(known, BROADCAST_ROWS)
        keyed = written(self.texts.withColumn("row", F.monotonically_increasing_id()), "texts")
        found = keyed.select("row", "text").mapInArrow(_row_words, "row bigint, garbled string").join(F.broadcast(known) if small else known, "garbled")
        by_row = found.groupBy("row").agg(F.map_from_entries(F.collect_list(F.struct("garbled", "clean"))).alias("words"))
        rows = keyed.join(by_row, "row", "left").select("key", "text", "words")
        out = rows.mapInArrow(_restore(mapping), f"key {self.kind}, n_stretches int, n_lost int, restored string")
        return out.withColumnRenamed("key", self.id_col)
