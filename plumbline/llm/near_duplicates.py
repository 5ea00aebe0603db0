"""Near-duplicate records by a chosen-path similarity join.

Every record is a set of word shingles. Its MinHash values (value v at position i is the token (i, v)) stand for the
set: two records share a position with the probability of their Jaccard similarity. A run grows a random tree over the
records: a node hands each record to a child for every token that the node samples (on average `branching` of a
record's tokens), so records meet in a child exactly when they share a sampled token. A child that holds few records
is compared by brute force; a larger one is split again; one that keeps most of its parent's records is dense, and is
compared block by block. Independent runs repeat until the recall that the collision probabilities promise at the
threshold, for the depth that the tree really reached, is reached. An exact check of the shingle sets ends the join, so
every pair that comes out is right.

How the plan holds at scale: copies (equal word sequences) fold into one representative before the tree; a tree row is
(path, record number, sketch of 18 bytes), never text; bucket sizes are counted with map-side partial sums, so a hot bucket
is known, and split, before its rows are shuffled; no bucket above `bucket` rows is compared in one task, and dense ones in
cells of two blocks of `dense_block` rows, so each of their n rows moves n / dense_block times. A family of n different
texts that are all alike has n (n - 1) / 2 links, which are found and counted one by one: that work cannot be less.
"""

from __future__ import annotations

import functools
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.session import rows_at_most, written

WORD = re.compile(r"[a-z0-9_]+")
POSITIONS = 48
#: A sketch keeps the lowest PLANES bits of each MinHash value, one 48-bit number for each bit. Positions that differ in
#: any bit count against a candidate; it may show SLACK_SD standard deviations more than a pair at the threshold.
PLANES, SLACK_SD = 3, 3.6
_SKETCH = [f"s{k}" for k in range(PLANES)]
BROADCAST_ROWS = 500_000  # of 8 bytes each: at most a few MB


class _WordHash(dict):
    """64-bit hashes of words; forgets all when it holds 500,000, so memory is bounded."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


def words_of(text: str | None) -> list[str]:
    """The longest runs of a-z, 0-9 and _ in the lower-cased text."""
    return WORD.findall(text.lower()) if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def shingles(word_hashes: np.ndarray, lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of `size` words within each record, and how many each record has (repeats included).

    `word_hashes` holds the records' words one after another, `lengths` the words of each.
    """
    counts = np.maximum(lengths - size + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.empty(0, np.uint64), counts
    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    at = np.repeat(first - np.concatenate(([0], np.cumsum(counts)[:-1])), counts) + np.arange(total)
    h = word_hashes[at]
    for k in range(1, size):
        h = _mix(h) + word_hashes[at + k]
    return _mix(h), counts


def minhashes(hashes: np.ndarray, counts: np.ndarray, positions: int = POSITIONS) -> np.ndarray:
    """`positions` MinHash values (32 bits) of each record that has shingles, in order."""
    some = counts > 0
    starts = np.concatenate(([0], np.cumsum(counts[some])[:-1])).astype(np.int64)
    out = np.empty((int(some.sum()), positions), np.uint32)
    if not len(out):
        return out
    lo, hi = (hashes & np.uint64(0xFFFFFFFF)).astype(np.uint32), (hashes >> np.uint64(32)).astype(np.uint32)
    seeds = _mix(np.arange(1, positions + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    for i, seed in enumerate(seeds.tolist()):
        x = lo * np.uint32(seed & 0xFFFFFFFF | 1) + hi * np.uint32(seed >> 32 | 1)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x2C1B3C6D)
        x ^= x >> np.uint32(13)
        out[:, i] = np.minimum.reduceat(x, starts)
    return out


_BASE = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("key", T.BinaryType()),
        T.StructField("sig", T.BinaryType()),
    ]
)


def _describe(size: int, cells: int = 2_000_000):
    """Batches of (id, text) to (id, hash of the word sequence, MinHash values); records without shingles are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = _WordHash()
        look = hashed.__getitem__
        schema = pa.schema([("id", pa.string()), ("key", pa.binary()), ("sig", pa.binary())])

        def finish(ids: list, lists: list, lengths: list) -> pa.RecordBatch:
            lengths_ = np.array(lengths, np.int64)
            flat = np.concatenate(lists) if lists else np.empty(0, np.uint64)
            hashes, counts = shingles(flat, lengths_, size)
            sigs, some = minhashes(hashes, counts), np.flatnonzero(counts > 0)
            keys = [xxhash.xxh3_128_digest(lists[i].tobytes()) for i in some]
            return pa.record_batch(
                [pa.array([ids[i] for i in some], pa.string()), pa.array(keys, pa.binary()), pa.array([s.tobytes() for s in sigs], pa.binary())],
                schema=schema,
            )

        for batch in batches:
            ids, lists, lengths, held = [], [], [], 0
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                found = words_of(text)
                lists.append(np.fromiter(map(look, found), np.uint64, len(found)))
                ids.append(i)
                lengths.append(len(found))
                held += len(found)
                if held > cells:
                    yield finish(ids, lists, lengths)
                    ids, lists, lengths, held = [], [], [], 0
            if ids:
                yield finish(ids, lists, lengths)

    return run


def _children(branching: float, positions: int = POSITIONS):
    """Rows (rid, sig, nodes array, ...) to rows (rid, sig, sketch, children array): the sampled tokens of each node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = np.uint64(int(branching / positions * 2**64))
        where = _mix(np.arange(1, positions + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        names = ["rid", "sig", *_SKETCH, "parent_n", "paths"]
        for whole in batches:
            for start in range(0, whole.num_rows, 2000):
                batch = whole.slice(start, 2000)
                n = batch.num_rows
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint32).reshape(n, positions)
                token = _mix(sig.astype(np.uint64) + where[None, :])
                planes = [(((sig >> np.uint32(k)) & np.uint32(1)).astype(np.int64) << np.arange(positions, dtype=np.int64)).sum(1) for k in range(PLANES)]
                lists = batch.column("nodes")
                sizes = np.diff(lists.offsets.to_numpy())
                nodes = lists.flatten().to_numpy().view(np.uint64) if sizes.sum() else np.empty(0, np.uint64)
                rows = np.repeat(np.arange(n), sizes)
                owner, paths = [], []
                for a in range(0, len(nodes), 4000):
                    r, v = rows[a : a + 4000], nodes[a : a + 4000]
                    drawn = _mix(token[r] ^ _mix(v)[:, None])
                    k, pos = np.nonzero(drawn < limit)
                    owner.append(r[k])
                    paths.append(_mix(_mix(v[k] + np.uint64(0x632BE59BD9B4E019)) ^ token[r[k], pos]))
                owner_ = np.concatenate(owner) if owner else np.empty(0, np.int64)
                paths_ = np.concatenate(paths) if paths else np.empty(0, np.uint64)
                order = np.argsort(owner_, kind="stable")
                offsets = np.concatenate(([0], np.cumsum(np.bincount(owner_, minlength=n)))).astype(np.int32)
                yield pa.record_batch(
                    [batch.column("rid"), batch.column("sig"), *map(pa.array, planes), batch.column("parent_n"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(paths_[order].view(np.int64)))],
                    names=names,
                )

    return run


def run_success(similarity: float, branching: float, depth: int, positions: int = POSITIONS) -> float:
    """The probability that one run brings a pair of this similarity together at `depth`."""
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - branching / positions * similarity * p) ** positions
    return p


def runs_for(target: float, similarity: float, branching: float, depth: int) -> int:
    """Independent runs after which a pair at the threshold was met with the probability `target`."""
    return max(1, math.ceil(math.log(1 - target) / math.log(1 - run_success(similarity, branching, depth))))


def expected_recall(runs: int, similarity: float, branching: float, depth: int, positions: int = POSITIONS) -> float:
    """The part of the pairs of this similarity that `runs` runs bring together at `depth`. All runs see the same MinHash
    values, so the mean is taken over how many of them agree."""
    return sum(math.comb(positions, m) * similarity**m * (1 - similarity) ** (positions - m) * (1 - (1 - _success(m, branching, depth, positions)) ** runs) for m in range(positions + 1))


def _success(agreeing: int, branching: float, depth: int, positions: int) -> float:
    p = 1.0
    for _ in range(depth):
        p = 1 - (1 - branching / positions * p) ** agreeing
    return p


def runs_needed(target: float, similarity: float, branching: float, depth: int) -> int:
    """The least number of runs whose expected recall reaches the target."""
    runs = 1
    while expected_recall(runs, similarity, branching, depth) < target:
        runs += 1
    return runs


def _describe_text(df: DataFrame, id_col: str, text_cols: list[str]) -> DataFrame:
    """(id, text): the text columns joined by a blank, null as empty. Ids that are null have no pairs and are left out."""
    text = F.concat_ws(" ", *[F.coalesce(F.col(f"`{c}`"), F.lit("")) for c in text_cols])
    return df.select(F.col(f"`{id_col}`").cast("string").alias("id"), text.alias("text")).filter("id is not null")


def _exact(threshold: float, size: int):
    """Rows (ra, rb, ta, tb) to (ra, rb, similarity) of the pairs whose shingle sets reach the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, frozenset] = {}

        def of(rid: int, text: str) -> frozenset:
            got = kept.get(rid)
            if got is None:
                if len(kept) > 2000:
                    kept.clear()
                w = words_of(text)
                got = kept[rid] = frozenset(zip(*[w[k:] for k in range(size)]))
            return got

        for batch in batches:
            out = ([], [], [])
            for ra, rb, ta, tb in zip(*[c.to_pylist() for c in batch.columns]):
                a, b = of(ra, ta), of(rb, tb)
                both = len(a & b)
                s = both / (len(a) + len(b) - both)
                if s >= threshold:
                    for column, v in zip(out, (ra, rb, s)):
                        column.append(v)
            yield pa.record_batch([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())], names=["ra", "rb", "similarity"])

    return run


def _prune(df: DataFrame, rids: DataFrame, how: str) -> DataFrame:
    """`df` semi or anti joined with record numbers: broadcast up to BROADCAST_ROWS numbers, else shuffled."""
    small = rows_at_most(rids, BROADCAST_ROWS)
    return df.join(F.broadcast(rids) if small else rids.hint("merge"), "rid", how)


class NearDuplicates:
    """The join of one table. `pairs` are between representatives of equal word sequences, `members` says which rows
    each stands for.

    df: any columns; id_col and text_cols name those used. Rows of one id count once. A null text is empty; a record of
    fewer than `shingle` words has no shingles and no partner. An empty table gives empty results.
    threshold: least Jaccard similarity of the shingle sets (default 0.8 on five words).
    bucket: rows up to which a node is compared by brute force. target_recall: see runs_needed(). max_depth: nodes that are
    still too large there are compared as dense ones.
    """

    def __init__(self, df: DataFrame, id_col: str, text_cols: list[str], threshold: float = 0.8, shingle: int = 5, bucket: int = 48, branching: float = 2.0, target_recall: float = 0.999, max_depth: int = 8, dense_block: int = 512):
        self.threshold, self.shingle, self.bucket, self.branching, self.max_depth = threshold, shingle, bucket, branching, max_depth
        self.target_recall, self.dense_block = target_recall, dense_block
        unequal = (1 - threshold) * (1 - 0.5**PLANES)
        self.most_unequal = math.ceil(POSITIONS * unequal + SLACK_SD * math.sqrt(POSITIONS * unequal * (1 - unequal)))
        self.texts = _describe_text(df, id_col, text_cols)
        described = self.texts.mapInArrow(_describe(shingle), _BASE).withColumn("rid", F.monotonically_increasing_id())
        self.base = written(described, "sets")
        # rid of the representative of each word sequence; fixed-width sums combine before the shuffle, whatever the skew
        first = self.base.groupBy("key").agg(F.min("rid").alias("rep"), F.count(F.lit(1)).alias("n")).filter("n > 1")
        self.copied = written(first.select("key", "rep"), "copied")
        again = self.base.select("key", "rid").join(self.copied, "key").filter("rid <> rep")
        self.again = written(again.select("rid", "rep"), "again")

    def members(self) -> DataFrame:
        """(id, rid): the representative's number of every record that has shingles, one row per id."""
        base = self.base.select("id", "rid")
        small = rows_at_most(self.again, BROADCAST_ROWS)
        joined = base.join(F.broadcast(self.again) if small else self.again, "rid", "left")
        return joined.select("id", F.coalesce("rep", "rid").alias("rid")).distinct()

    def candidates(self) -> DataFrame:
        """(ra, rb), ra < rb: record numbers that met in a node and whose sketches agree well enough."""
        reps = _prune(self.base.select("rid", "sig"), self.again.select("rid"), "left_anti")
        runs = runs_needed(self.target_recall, self.threshold, self.branching, 3)
        met, depth = self._grow(reps, 1, runs)
        more = runs_needed(self.target_recall, self.threshold, self.branching, depth) - runs
        if more > 0:
            met += self._grow(reps, runs + 1, more)[0]
        found = met[0]
        for further in met[1:]:
            found = found.union(further)
        return found.distinct()

    def _grow(self, reps: DataFrame, first: int, runs: int) -> tuple[list[DataFrame], int]:
        """What meets in `runs` trees from number `first` on, and the depth of the deepest."""
        seeds = [int(x) for x in _mix(np.arange(first, first + runs, dtype=np.uint64)).view(np.int64)]
        level = reps.withColumn("nodes", F.array(*[F.lit(s) for s in seeds])).withColumn("parent_n", F.lit(2**62))
        kind = f"rid bigint, sig binary, {''.join(f'{x} bigint, ' for x in _SKETCH)}parent_n bigint, paths array<bigint>"
        met = []
        for depth in range(1, self.max_depth + 1):
            grown = level.mapInArrow(_children(self.branching), kind)
            rows = grown.select("rid", "sig", *_SKETCH, "parent_n", F.explode("paths").alias("path"))
            counts = rows.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.max("parent_n").alias("parent_n"))
            hot = written(counts.filter(F.col("n") > self.bucket), "hot")
            small = rows_at_most(hot, BROADCAST_ROWS)
            known = F.broadcast(hot.select("path", "n")) if small else hot.select("path", "n")
            cool = rows.select("path", "rid", *_SKETCH).join(known, "path", "left_anti")
            met.append(self._compare(cool, ["path"]))
            if hot.isEmpty():
                break
            dense = (F.col("n") * 2 >= F.col("parent_n")) if depth < self.max_depth else F.lit(True)
            known = hot.filter(dense).select("path", "n")
            blocks = rows.select("path", "rid", *_SKETCH).join(F.broadcast(known) if small else known, "path")
            met.append(self._compare(self._blocks(blocks), ["path", "cell"]))
            known = hot.filter(~dense).select("path", F.col("n").alias("parent_n"))
            split = rows.select("path", "rid", "sig").join(F.broadcast(known) if small else known, "path")
            level = split.select("rid", "sig", F.array("path").alias("nodes"), "parent_n")
            if depth < self.max_depth:
                level = written(level, "level")
        return met, depth

    def _blocks(self, rows: DataFrame) -> DataFrame:
        """Rows of dense nodes, once for each block that theirs is compared with: a cell holds two blocks at most."""
        many = F.ceil(F.col("n") / self.dense_block).cast("long")
        own = F.pmod(F.xxhash64("rid"), F.col("many"))
        other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("many") - 1))
        out = rows.withColumn("many", many).withColumn("own", own).withColumn("other", other)
        cell = F.least("own", "other") * F.col("many") + F.greatest("own", "other")
        return out.select("path", cell.alias("cell"), "rid", *_SKETCH)

    def _compare(self, rows: DataFrame, on: list[str]) -> DataFrame:
        a = rows.select(*on, F.col("rid").alias("ra"), *[F.col(x).alias(f"a{x}") for x in _SKETCH])
        b = rows.select(*on, F.col("rid").alias("rb"), *[F.col(x).alias(f"b{x}") for x in _SKETCH])
        differs = functools.reduce(lambda x, y: x.bitwiseOR(y), [F.col(f"a{x}").bitwiseXOR(F.col(f"b{x}")) for x in _SKETCH])
        near = F.bit_count(differs) <= self.most_unequal
        return a.join(b.hint("merge"), on).filter((F.col("ra") < F.col("rb")) & near).select("ra", "rb")

    def pairs(self) -> DataFrame:
        """(ra, rb, similarity), ra < rb: every pair of representatives that reaches the threshold."""
        cands = written(self.candidates(), "candidates")
        ids = cands.select(F.explode(F.array("ra", "rb")).alias("rid")).distinct()
        named = written(self.base.select("rid", "id").join(ids, "rid", "left_semi"), "named")
        small = rows_at_most(named, BROADCAST_ROWS // 8)
        # an id that was delivered twice has one text per delivery, byte for byte the same
        texts = self.texts.join(F.broadcast(named) if small else named, "id").groupBy("rid").agg(F.first("text").alias("text"))
        texts = written(texts, "texts")
        a = texts.select(F.col("rid").alias("ra"), F.col("text").alias("ta"))
        b = texts.select(F.col("rid").alias("rb"), F.col("text").alias("tb"))
        both = cands.join(a, "ra").join(b, "rb").select("ra", "rb", "ta", "tb")
        return both.mapInArrow(_exact(self.threshold, self.shingle), "ra bigint, rb bigint, similarity double")


def expand_pairs(pairs: DataFrame, members: DataFrame, part: int = 5_000) -> DataFrame:
    """(id_a, id_b), id_a < id_b: all pairs of different ids behind the representatives' pairs, and within a class.

    A class of n rows is cut into n / part parts, and whatever is paired with it is repeated for each, so one class with a
    third of all rows is expanded by many tasks.
    """
    members = written(members, "members")
    sizes = written(members.groupBy("rid").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("rid", F.ceil(F.col("n") / part).cast("int").alias("parts")), "shared")
    large = sizes.filter("parts > 1")
    small = rows_at_most(large, BROADCAST_ROWS)

    def parts_of(df: DataFrame, rid: str) -> DataFrame:
        known = large.select(F.col("rid").alias(rid), "parts")
        return df.join(F.broadcast(known) if small else known, rid, "left").withColumn("parts", F.coalesce("parts", F.lit(1)))

    def spread(df: DataFrame, rid: str) -> DataFrame:
        """Each row in the part of its id."""
        return parts_of(df, rid).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")).drop("parts")

    def repeated(df: DataFrame, rid: str) -> DataFrame:
        """Each row once for every part."""
        return parts_of(df, rid).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).drop("parts")

    copied = _prune(members, sizes.select("rid"), "left_semi")
    within = spread(copied, "rid").select("rid", "part", F.col("id").alias("x")).join(repeated(copied, "rid").select("rid", "part", F.col("id").alias("y")), ["rid", "part"]).filter("x < y")
    a = spread(members.select(F.col("rid").alias("ra"), "id"), "ra").withColumnRenamed("id", "x")
    b = spread(members.select(F.col("rid").alias("rb"), "id"), "rb").withColumnRenamed("id", "y")
    left = repeated(pairs.select("ra", "rb"), "ra").join(a, ["ra", "part"]).select("rb", "x")
    across = repeated(left, "rb").join(b, ["rb", "part"]).filter("x <> y")
    both = across.select("x", "y").union(within.select("x", "y"))
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def components(pairs: DataFrame, nodes: DataFrame, rounds: int = 40) -> DataFrame:
    """(rid, component): the least record number in each connected component of the links.

    Large-star and small-star steps by turns (Kiveris et al.), each written to the shared folder, until nothing moves.
    """
    edges = written(pairs.select(F.greatest("ra", "rb").alias("u"), F.least("ra", "rb").alias("v")).distinct(), "edges")
    for _ in range(rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        small_least = large.groupBy("u").agg(F.min("v").alias("m"))
        step = large.join(small_least, "u")
        small = step.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        moved = written(small, "star")
        same = moved.exceptAll(edges).isEmpty() and edges.exceptAll(moved).isEmpty()
        edges = moved
        if same:
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("rid").distinct().join(edges.select(F.col("u").alias("rid"), F.col("v").alias("component")), "rid", "left").select("rid", F.coalesce("component", "rid").alias("component"))


def groups(join: NearDuplicates) -> DataFrame:
    """One row per id: its class of equal texts, its group of linked classes, and the other classes it is linked with.

    Records without shingles are classes and groups of their own (class_id null stands for "no shingles").
    """
    pairs = written(join.pairs(), "pairs")
    members = written(join.members(), "members")
    names = members.groupBy("rid").agg(F.min("id").alias("class_id"))
    comp = components(pairs, members)
    links = pairs.select(F.explode(F.array("ra", "rb")).alias("rid")).groupBy("rid").agg(F.count(F.lit(1)).alias("n_links"))
    heads = written(names.join(comp, "rid"), "heads")
    group_ids = heads.groupBy("component").agg(F.min("class_id").alias("group_id"))
    described = heads.join(group_ids, "component").join(links, "rid", "left").select("rid", "class_id", "group_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    every = join.texts.select("id").distinct()
    named = members.join(described, "rid").select("id", "class_id", "group_id", "n_links")
    return every.join(named, "id", "left").select("id", "class_id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
