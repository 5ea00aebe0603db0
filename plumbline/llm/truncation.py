"""Values that were cut by a limit or on the way.

A storage limit shows as a length at which many values end and end openly - but in the unit that the store counts. So
each value's length is computed in several units (characters, UTF-8 bytes, UTF-16 units, entity-escaped, JSON-escaped
with and without ASCII only, with CR LF line ends, and what stands before a mark of the cut), values are grouped by unit
and length, and lengths are kept at which open endings pile up against the neighbouring lengths. A length in one unit
makes echoes in the others, so spikes compete: each open value is given to the strongest spike that it fills, a spike
that keeps most of its values is a limit, the values that it explains leave, and what remains is searched again.

Then endings decide, by what the limits say. A value that just fills a limit was cut unless its ending is complete: a
phrase or number, which may well be whole elsewhere, is not whole there. A value that fills no limit was cut on the way
only if its ending is open in itself: a mark of the cut, an open bracket or quote, half a character, an unfinished
sentence. Whole values that just fill a limit stay whole.

Limits are looked for among distinct values: a value that comes again and again, whole or cut, is one value. Lengths are
expressions that stay in the JVM; only the reading of an ending runs in Python, in batches. The counts by unit and length
combine before the shuffle. A limit holds at least LEAST_SHARE of the open values of its field, so no unit has more than
1 / LEAST_SHARE of them, whatever the size of the table: that is what comes to the driver and is broadcast.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import written

COMPLETE, OPEN, EITHER = "complete", "open", "either"
#: A limit: at least so many distinct open values, so large a part of the field's open values, and so many times the mean
#: of the NEAR lengths on either side (one added, so that emptiness around it proves nothing).
LEAST_AT_LIMIT, LEAST_SHARE, LEAST_PEAK, NEAR = 5, 0.01, 4.0, 8
#: How far below a limit an open value still shows it: a blank or up to three bytes of a character fell off behind the cut.
SLACK = 3
#: Two limits in different units are two readings of one if they share so large a part of their values.
SAME = 0.9
MARKED = ("marked_characters", "marked_utf8_bytes")

_MARK = re.compile(r"(?:\.\.\.|…|[\[(<{]\s*(?:truncated|cut|snip(?:ped)?|clipped|shortened|output omitted|\d+ (?:more|chars?|characters|bytes)[^\])>}]*|\.{3}|…)\s*[\])>}])\s*$", re.I)
_STOP = re.compile(r"[.!?。！？｡](?:[)\]}\"”’'»」』`*]*)$")
_CALL = re.compile(r"[A-Za-z_][\w.]*[(\[{]")
_WORDS = re.compile(r"\S+")
_NUMBER = re.compile(r"[-+]?(?:\d[\d_,]*)(?:\.\d+)?(?:[eE][-+]?\d+)?j?")
_CLOSERS = {")": "(", "]": "[", "}": "{"}
_KEYWORDS = {"True", "False", "None", "null", "true", "false", "NaN", "nan", "inf"}
PHRASE_WORDS, LOWER_WORDS = 3, 12  # the longest phrases that need no full stop: with a capital, and without


def _scan(value: str) -> str:
    """Whether a literal or call closes all its brackets and quotes: 'complete', 'open', or 'text' if it ends before the
    value does (then the value is no literal)."""
    stack: list[str] = []
    i, n = 0, len(value)
    while i < n:
        c = value[i]
        if c in "\"'":
            mark = value[i : i + 3] if value[i : i + 3] in ('"""', "'''") else c
            j = i + len(mark)
            while True:
                j = value.find(mark, j)
                if j < 0:
                    return OPEN
                back = j
                while value[back - 1] == "\\" and back > i + len(mark):
                    back -= 1
                if (j - back) % 2 == 0:
                    break
                j += 1
            i = j + len(mark)
            if not stack and i < n:
                return "text"
            continue
        if c in "([{":
            stack.append(c)
        elif c in _CLOSERS:
            if not stack or stack.pop() != _CLOSERS[c]:
                return "text"
            if not stack and i + 1 < n:
                return "text"
        i += 1
    return OPEN if stack else COMPLETE


def ending(value: str) -> str:
    """How a value ends: 'complete', 'open' (it was cut), or 'either'."""
    bare = value.rstrip()
    if not bare:
        return COMPLETE
    if bare[-1] == "�" or "\ud800" <= bare[-1] <= "\udbff":
        return OPEN
    if _MARK.search(bare) and not (bare[0] in "([{" and _scan(bare) == COMPLETE):
        return OPEN
    if bare in _KEYWORDS:
        return COMPLETE
    if _NUMBER.fullmatch(bare):
        return EITHER
    if bare[0] == "<":
        return COMPLETE if bare[-1] == ">" else OPEN
    if bare[0] in "([{\"'" or _CALL.match(bare):
        state = _scan(bare)
        if state != "text":
            return state
    if bare.count("`") % 2:
        return OPEN
    if _STOP.search(bare):
        return COMPLETE
    words = len(_WORDS.findall(bare))
    sentences = bool(re.search(r"[.!?] +\S", bare)) or bool(re.search(r"[。！？].", bare))
    if value != bare and words > 1:
        return OPEN
    if sentences or words > (PHRASE_WORDS if bare[0].isupper() else LOWER_WORDS):
        return OPEN
    return EITHER


def kept(value: str) -> str | None:
    """What stands before the mark of a cut; None if the value has no mark."""
    m = _MARK.search(value)
    if not m:
        return None
    before = value[: m.start()]
    return before[:-1] if before.endswith(" ") and m.group()[0] in "[(<{" else before  # the blank belongs to the mark


def _endings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        values = b.column("value").to_pylist()
        read = [ending(v) for v in values]
        before = [kept(v) if e == OPEN else None for v, e in zip(values, read)]
        sizes = [None if k is None else len(k) for k in before], [None if k is None else len(k.encode("utf-8", "surrogatepass")) for k in before]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(read, pa.string()), *[pa.array(x, pa.int32()) for x in sizes]], names=[*b.schema.names, "ending", *MARKED])


def _count(value: Column, chars: str) -> Column:
    """How many characters of `value` belong to the class `chars`."""
    return F.length(value) - F.length(F.regexp_replace(value, f"[{chars}]", ""))


def units(value: Column) -> dict[str, Column]:
    """The length of a value in each unit that a store may count in."""
    n = F.length(value)
    wide = _count(value, "\\x{10000}-\\x{10FFFF}")
    quotes = _count(value, '"\\\\\\\\\\n\\r\\t\\x08\\x0c')
    return {
        "characters": n,
        "utf8_bytes": F.octet_length(value),
        "utf16_units": n + wide,
        "entity_escaped": n + 4 * _count(value, "&") + 3 * _count(value, "<>") + 5 * _count(value, '"') + 4 * _count(value, "'"),
        "json_escaped": n + quotes,
        "json_ascii": n + quotes + 5 * _count(value, "^\\x00-\\x7f") + 6 * wide,
        "crlf": n + _count(value, "\\n") - 2 * _count(value, "\\r") + _count(value, "\\r"),
    }


class Limit(NamedTuple):
    field_name: str
    unit: str
    size: int
    n_open: int
    strength: int  # n_open with the values that fall short of it by SLACK at most: what competing spikes are ranked by


class Truncation:
    """Cut values of the fields of a table.

    df: any columns. Rows of one id count once (byte for byte the same, or the first found of them for each field).
    Null and empty values are never cut. An empty table has no limits and no cut values.
    """

    def __init__(self, df: DataFrame, id_col: str, fields: list[str]):
        pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f"`{f}`").alias("value")) for f in fields]))
        rows = df.select(F.col(f"`{id_col}`").alias("id"), pairs.alias("p")).select("id", "p.field_name", "p.value").filter("length(value) > 0")
        rows = rows.dropDuplicates(["id", "field_name"])
        measured = rows.select("*", F.unhex(F.md5(F.col("value").cast("binary"))).alias("digest"), *[c.cast("int").alias(k) for k, c in units(F.col("value")).items()])
        self.names = [*units(F.col("value")), *MARKED]
        kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in measured.schema.fields) + ", ending string, " + ", ".join(f"{k} int" for k in MARKED)
        read = measured.mapInArrow(_endings, kind).drop("value")
        self.values = written(read, "values")

    def _fills(self, limits: list[Limit], slack: int = 0) -> Column:
        """The limits that a value fills, or falls short of by at most `slack`, as structs (strength, -rank of the unit, unit,
        size), one for each unit at most."""
        kind = "array<struct<strength:bigint,rank:int,unit:string,size:int>>"
        none = F.array().cast(kind)
        out = none
        for field in sorted({x.field_name for x in limits}):
            own = [x for x in limits if x.field_name == field]
            each = []
            for rank, unit in enumerate(self.names):
                known = {x.size - short: x.strength for short in range(slack, -1, -1) for x in own if x.unit == unit}
                if known:
                    n = F.element_at(F.create_map(*[F.lit(v) for pair in known.items() for v in pair]), F.col(unit))
                    each.append(F.when(n.isNotNull(), F.struct(n.cast("bigint").alias("strength"), F.lit(-rank).alias("rank"), F.lit(unit).alias("unit"), F.col(unit).alias("size"))))
            out = F.when(F.col("field_name") == field, F.array_compact(F.array(*each)).cast(kind)).otherwise(out)
        return out

    def _spikes(self, left: DataFrame, open_: dict[str, int]) -> list[Limit]:
        """Lengths of the open values `left` that stand out from the lengths around them."""
        sizes = F.explode(F.array(*[F.struct(F.lit(k).alias("unit"), F.col(k).alias("size")) for k in self.names]))
        counts = left.select("field_name", sizes.alias("u")).filter("u.size is not null").groupBy("field_name", "u.unit", "u.size").agg(F.count(F.lit(1)).alias("n_open"))
        least = functools.reduce(lambda c, f: F.when(F.col("field_name") == f, F.lit(max(LEAST_AT_LIMIT, LEAST_SHARE * open_[f]))).otherwise(c), open_, F.lit(float(LEAST_AT_LIMIT)))
        high = counts.filter(F.col("n_open") >= least)
        # against the mean of the lengths around it, itself left out: a spike, not a slope
        around = high.select("field_name", "unit", F.col("size").alias("at"), F.explode(F.sequence(F.col("size") - NEAR, F.col("size") + NEAR)).alias("size")).filter("size <> at")
        level = around.join(counts, ["field_name", "unit", "size"]).groupBy("field_name", "unit", F.col("at").alias("size"))
        short = F.col("size").between(F.col("at") - SLACK, F.col("at") - 1)
        level = level.agg((F.sum("n_open") / (2.0 * NEAR)).alias("level"), F.sum(F.when(short, F.col("n_open")).otherwise(0)).alias("short"))
        peaks = high.join(level, ["field_name", "unit", "size"], "left").filter(F.col("n_open") >= LEAST_PEAK * (1 + F.coalesce("level", F.lit(0.0))))
        strength = F.col("n_open") + F.coalesce("short", F.lit(0))
        return [Limit(*r) for r in peaks.select("field_name", "unit", "size", "n_open", strength).collect()]

    @functools.cached_property
    def found(self) -> list[Limit]:
        """The limits, each with the distinct open values that it explains; bounded by LEAST_SHARE."""
        open_values = written(self.values.filter(F.col("ending") == OPEN).dropDuplicates(["field_name", "digest"]).select("field_name", *self.names), "open")
        open_ = {r.field_name: r["count"] for r in open_values.groupBy("field_name").count().collect()}
        limits: list[Limit] = []
        left = open_values
        while spikes := self._spikes(left, open_):
            fills = left.select("field_name", self._fills(spikes).alias("f")).filter("size(f) > 0").select("field_name", F.array_max("f").alias("b"), F.explode("f").alias("f"))
            both = fills.groupBy("field_name", "b.unit", "b.size", F.col("f.unit").alias("other"), F.col("f.size").alias("length")).count().collect()
            shared = {((r.field_name, r.unit, r.size), (r.field_name, r.other, r.length)): r["count"] for r in both}
            # the strongest of each field keeps all its values, so every round finds one
            kept_own = [x._replace(n_open=own) for x in spikes if 2 * (own := shared.get((x[:3], x[:3]), 0)) > x.n_open]
            limits += kept_own
            for x in kept_own:  # another length in another unit that nearly the same values have: neither reading can be ruled out
                for y in spikes:
                    n = shared.get((x[:3], y[:3]), 0)
                    if n >= SAME * x.n_open and not any(z.field_name == y.field_name and z.size == y.size for z in limits):
                        limits.append(y._replace(n_open=n))
            left = open_values.filter(F.size(self._fills(limits, SLACK)) == 0)
        return limits

    def limits(self) -> DataFrame:
        """(field_name, unit, size, n, n_open): lengths at which open endings pile up; n distinct values of that length,
        n_open open ones that no stronger limit explains."""
        spark = self.values.sparkSession
        known = spark.createDataFrame([(x.field_name, x.unit, x.size, x.n_open) for x in self.found], "field_name string, unit string, size int, n_open bigint")
        distinct = self.values.dropDuplicates(["field_name", "digest"])
        at = distinct.select("field_name", F.explode(self._fills(self.found)).alias("f")).groupBy("field_name", "f.unit", "f.size").agg(F.count(F.lit(1)).alias("n"))
        return at.join(F.broadcast(known), ["field_name", "unit", "size"]).select("field_name", "unit", "size", "n", "n_open")

    def verdicts(self) -> DataFrame:
        """(id, field_name, ending, units, cause): each value with the units in which it just fills a limit, and why it
        was cut: 'limit', 'elsewhere', or null if it is whole."""
        filled, short = [F.transform(self._fills(self.found, slack), lambda x: x["unit"]) for slack in (0, SLACK)]
        judged = self.values.select("id", "field_name", "ending", filled.alias("units"), (F.size(short) > 0).alias("near"))
        at = (F.col("ending") == EITHER) & (F.size("units") > 0) | (F.col("ending") == OPEN) & F.col("near")
        return judged.withColumn("cause", F.when(at, "limit").when(F.col("ending") == OPEN, "elsewhere")).drop("near")

    def cut(self) -> DataFrame:
        """(id, field_name) of the values that were cut."""
        return self.verdicts().filter("cause is not null").select("id", "field_name")
