"""Fuzzy line deduplication by MinHash (operator 6).

Lines are the pieces between line breaks. A line is the set of its character shingles of
``SHINGLE`` code points (a shorter line is one shingle). Equal lines are collapsed first.
``BANDS`` bands of ``ROWS`` MinHash values each make the candidates: at the threshold of
``THRESHOLD`` a pair shares a band with probability 1 - (1 - 0.8^5)^10 = 0.98. Every line
of a bucket is verified, by the exact Jaccard similarity of the shingle sets, against the
bucket's smallest line; where that leaves a bucket's lines in different components, against
its next smallest, ``STARS`` times at most, until few pairs are left a line; and then every
pair of lines that still are in different components. So no pair of a bucket that matters
goes unchecked, and buckets of thousands of variants of a few lines stay linear. The last
pairs are never a table: a bucket's lines are sent once, in tiles of two parts if it is
large, and only links that join components come back. Of a tile's pairs only those are
compared in full whose parity maps (a bit for each place, flipped by every shingle that
falls on it) differ in no more bits than similar sets may in shingles. Verified pairs are joined by the
distributed union-find of ``components``; of each component the first line stays, that of
the smallest ``doc_id`` (null last), at ties of the smallest document key, then of the
smallest line number.

Documents are read twice: split into a table of lines, and rewritten. Their texts are
shuffled once at most (twice if rows repeat), and those of lines only if they share a bucket (where those are too
many to broadcast, a bit set lets few others through). Tables are deleted when used up.

``dedup_lines`` rewrites the documents. Cases: blank lines (white space only) are layout:
they are neither compared nor counted, and are dropped where they would follow another
blank or lead the text, in documents that lose a line; a document whose lines are all
duplicates is dropped, one that had no line to begin with (null, empty or blank text)
stays as it is; rows equal in ``doc_id`` and text hold the same lines, so only one of
them, whichever comes first, keeps them and the others go; lines and texts of any length
are used whole; a column ``n_chars`` of integer type is set to the new length where the
text changed, all other columns are passed through, whatever their names. An empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .common import cut, discard, measured, place, sieve, sifted, sized, thrifty
from .components import components
from .simhash import keyed
from .text import Column, mix

SHINGLE = 6
BANDS = 10
ROWS = 5
THRESHOLD = 0.8
STARS = 4
_rng = np.random.default_rng(6)
_A = (_rng.integers(1, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64).astype(np.uint32)
#: Pairs a line up to which all that are left are compared instead of another star.
EASY = 512
#: Bits of a line's parity map.
PARITY = 1 << 10
#: Lines, and bytes of them, of a part of a large bucket.
PART_ROWS = 1 << 11
PART_BYTES = 1 << 20
_CHUNK = 1 << 17
_VERIFIED = 1 << 22
#: Bytes of lines, and pairs of them, that a task of the last comparison gets.
_TASK_BYTES = 1 << 23
_TASK_PAIRS = 1 << 24


def _points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of UTF-8 rows, and offsets counted in them."""
    lead = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
    return np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32), lead[offsets]


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hash of every shingle of every row (rows may not be empty), and the start of each row's run."""
    point, off = _points(data, offsets)
    size = np.diff(off)
    count = np.maximum(size - SHINGLE + 1, 1)
    first = np.cumsum(count) - count
    start = np.arange(int(count.sum())) + np.repeat(off[:-1] - first, count)
    wide = np.concatenate([point, np.zeros(SHINGLE, np.uint32)]).astype(np.uint64) + np.uint64(1)
    rolled = np.zeros(len(point), np.uint64)
    for k in range(SHINGLE):
        rolled *= np.uint64(0x100000001B3)
        rolled += wide[k : k + len(point)]
    h = rolled[start]
    short = np.flatnonzero(size < SHINGLE)
    if len(short):
        part = np.zeros(len(short), np.uint64)
        for k in range(SHINGLE):
            part = part * np.uint64(0x100000001B3) + np.where(k < size[short], wide[off[short] + k], np.uint64(0))
        h[first[short]] = part
    return mix(h), first


def signatures(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Band keys (rows, BANDS) of non-empty rows; the band number is part of the key."""
    h, first = shingles(data, offsets)
    h = (h >> np.uint64(32)).astype(np.uint32)
    out = np.zeros((len(first), BANDS), np.uint64)
    hashed = np.empty_like(h)
    for k in range(BANDS * ROWS):
        np.multiply(h, _A[k], out=hashed)
        hashed += _B[k]
        least = np.minimum.reduceat(hashed, first)
        band = out[:, k // ROWS]
        out[:, k // ROWS] = mix(band * np.uint64(0x9E3779B97F4A7C15) + least + np.uint64(k))
    return out


def jaccard(a: str, b: str) -> float:
    """Exact Jaccard similarity of the shingle sets."""
    x, y = ({s[i : i + SHINGLE] for i in range(max(len(s) - SHINGLE + 1, 1))} for s in (a, b))
    return len(x & y) / len(x | y)


def lines_of(docs: DataFrame) -> DataFrame:
    """``(doc_id, k1, k2, row, no, line, h1, h2)``, written: every line that isn't blank, ``row`` numbering the rows of ``docs``."""
    flat = keyed(docs).withColumn("row", F.monotonically_increasing_id())
    i, t = f"_{place(docs, 'doc_id')}", f"_{place(docs, 'text')}"
    each = flat.select(F.col(i).alias("doc_id"), "k1", "k2", "row", F.posexplode(F.split(F.col(t), "\n")).alias("no", "line"))
    return cut(each.filter(F.col("line").rlike(r"[^ \t\r\f\x0B]")).withColumns({"h1": F.xxhash64("line"), "h2": F.xxhash64(F.lit(3), "line")}))


def texts_of(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """``(h1, line)``, written: the lines of the hashes ``wanted(h1)``, each once."""
    each = lines.select("h1", "line")
    if measured(wanted) > common.BROADCAST_BYTES:  # else all lines' texts would be shuffled
        bits = each.sparkSession.sparkContext.broadcast(sieve(wanted))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h1, once = np.unique(batch.column(0).to_numpy(zero_copy_only=False), return_index=True)
                yield batch.take(pa.array(once[sifted(bits.value, h1)]))

        each = each.mapInArrow(thrifty(run), each.schema)
    return cut(each.join(sized(wanted), "h1", "left_semi").dropDuplicates(["h1"]))


def _banded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h1 = batch.column(0).to_numpy(zero_copy_only=False)
        _, once = np.unique(h1, return_index=True)
        batch = batch.take(pa.array(once))
        col = Column(batch.column(1))
        keys = [signatures(data, off) for _, _, data, off in col.chunks(_CHUNK)]
        keys = (np.concatenate(keys) if keys else np.zeros((0, BANDS), np.uint64)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(keys[:, b]) for b in range(BANDS)]], ["h1", *[f"b{b}" for b in range(BANDS)]])


def _sets(texts: pa.Array) -> list[np.ndarray]:
    """The sorted shingle set of each line."""
    out = []
    for _, _, data, off in Column(texts).chunks(_CHUNK):
        h, start = shingles(data, off)
        out += [np.unique(h[i:j]) for i, j in zip(start.tolist(), [*start[1:].tolist(), len(h)], strict=True)]
    return out


def _near(a: np.ndarray, b: np.ndarray, left: pa.Array, right: pa.Array) -> np.ndarray:
    """Which of the pairs reach the threshold; the shingles of a line (known by its hash) are sorted once."""
    _, first, which = np.unique(np.concatenate([a, b]), return_index=True, return_inverse=True)
    sets = _sets(pa.concat_arrays([left, right]).take(pa.array(first)))
    out = np.zeros(len(a), bool)
    for k, (i, j) in enumerate(zip(which[: len(a)].tolist(), which[len(a) :].tolist(), strict=True)):
        x, y = sets[i], sets[j]
        if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)) - 1e-9:
            continue
        both = np.sort(np.concatenate([x, y]))
        shared = np.count_nonzero(both[1:] == both[:-1])
        out[k] = shared >= THRESHOLD * (len(both) - shared) - 1e-9
    return out


def verify(pairs: DataFrame, text: DataFrame) -> DataFrame:
    """The pairs ``(a, b)`` of line hashes whose exact similarity reaches the threshold, written; ``text(h1, line)`` has their lines."""
    one = text.select(F.col("h1").alias("a"), F.col("line").alias("x"))
    two = text.select(F.col("h1").alias("b"), F.col("line").alias("y"))
    both = pairs.select("a", "b").join(one, "a").join(two, "b").select("a", "b", "x", "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = np.cumsum(np.diff(Column(batch.column(2)).offsets) + np.diff(Column(batch.column(3)).offsets))
            at = 0
            while at < batch.num_rows:  # slices of bounded size
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + _VERIFIED, side="right")))
                part = batch.slice(at, to - at)
                one, two = (part.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                near = _near(one, two, part.column(2), part.column(3))
                yield pa.RecordBatch.from_arrays([pa.array(one[near]), pa.array(two[near])], ["a", "b"])
                at = to

    return cut(both.mapInArrow(thrifty(run), "a bigint, b bigint"))


def _parity(sets: list[np.ndarray]) -> np.ndarray:
    """Parity maps ``(words, sets)``: bit b tells whether a set has an odd number of shingles that fall on b.

    Two maps differ in at most as many bits as their sets do in shingles.
    """
    out = np.zeros((PARITY // 64, len(sets)), np.uint64)
    for lo in range(0, len(sets), 1 << 12):
        some = sets[lo : lo + (1 << 12)]
        row = np.repeat(np.arange(len(some)), np.fromiter(map(len, some), np.int64, len(some)))
        at = row * PARITY + (np.concatenate(some) & np.uint64(PARITY - 1)).astype(np.int64)
        odd = (np.bincount(at, minlength=len(some) * PARITY) & 1).astype(np.uint8).reshape(len(some), PARITY)
        out[:, lo : lo + len(some)] = np.packbits(odd, axis=1).view(np.uint64).T
    return out


def _possible(size: np.ndarray, group: np.ndarray, part: np.ndarray, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of places of a tile, in order of the first, that may join two groups: by size and parity map ``odd`` their sets can be similar.

    None that is similar is lost. Of one part all pairs are looked at, of two those across.
    """
    _, which, n = np.unique(group, return_inverse=True, return_counts=True)
    rows = np.flatnonzero(which != n.argmax())  # any such pair has a line outside the largest group
    rank = np.full(len(size), len(size))
    rank[rows] = np.arange(len(rows))
    most = 1 + int(part.min() == part.max())  # parts a pair may have in common, and one
    one, two = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    step = max(1, (1 << 17) // len(size))
    for lo in range(0, len(rows), step):
        r = rows[lo : lo + step, None]
        ok = (group[r] != group) & (rank[r] < rank) & ((part[r] == part) < most)
        ok &= np.minimum(size[r], size) >= THRESHOLD * np.maximum(size[r], size) - 1e-9
        apart = np.zeros(ok.shape, np.uint16)
        for word in odd:
            apart += np.bitwise_count(word[r] ^ word)
        ok &= apart <= (1 - THRESHOLD) / (1 + THRESHOLD) * (size[r] + size) + 1e-6
        i, j = np.nonzero(ok)
        one.append(r[i, 0])
        two.append(j)
    return np.concatenate(one), np.concatenate(two)


def _joins(sets: list[np.ndarray], group: np.ndarray, part: np.ndarray, odd: np.ndarray) -> list[tuple[int, int]]:
    """Places of similar sets that join the groups of a tile: of one part all pairs are compared, of two those across.

    A pair is compared in full only if ``_possible`` names it.
    """
    one, two = _possible(np.fromiter(map(len, sets), np.int64, len(sets)), group, part, odd)
    if not len(one):
        return []
    some = np.unique(np.concatenate([one, two]))
    size = np.fromiter((len(sets[k]) for k in some.tolist()), np.int64, len(some))
    start = np.cumsum(size) - size
    _, shingle = np.unique(np.concatenate([sets[k] for k in some.tolist()]), return_inverse=True)
    has = np.zeros(int(shingle.max()) + 1, bool)
    begin = np.flatnonzero(np.append(True, one[1:] != one[:-1]))
    group, i_of, j_of = group[some], np.searchsorted(some, one[begin]), np.searchsorted(some, two)
    out = []
    for i, lo, hi in zip(i_of.tolist(), begin.tolist(), [*begin[1:].tolist(), len(two)], strict=True):
        at = j_of[lo:hi]
        at = at[group[at] != group[i]]
        if not len(at):
            continue
        mine = shingle[start[i] : start[i] + size[i]]
        has[mine] = True
        n = size[at]
        first = np.cumsum(n) - n
        shared = np.add.reduceat(has[shingle[np.repeat(start[at] - first, n) + np.arange(int(n.sum()))]], first, dtype=np.int64)
        has[mine] = False
        near = at[shared >= THRESHOLD * (n + size[i] - shared) - 1e-9]
        if len(near):
            joined, first = np.unique(group[near], return_index=True)
            out += [(int(some[i]), int(some[j])) for j in near[first].tolist()]
            group[np.isin(group, joined)] = group[i]
    return out


def verify_buckets(member: DataFrame, text: DataFrame) -> DataFrame:
    """Links ``(a, b)``, written, that join the lines of ``member(bucket, h1, c)`` as far as lines of a bucket and of different
    components ``c`` are similar. No table of pairs is made: a line goes once to each tile of its bucket."""
    each = cut(member.select("bucket", "h1", "c").join(text, "h1").withColumn("size", F.octet_length("line")))
    parts = F.ceil(F.greatest(F.count("*") / PART_ROWS, F.sum("size") / PART_BYTES))
    sizes = cut(each.groupBy("bucket").agg(parts.cast("int").alias("parts"), F.count("*").cast("double").alias("n"), F.sum("size").cast("double").alias("bytes")))
    total = sizes.agg(F.sum(F.expr("bytes * parts")), F.sum(F.expr("n * n / 2"))).first()
    tasks = min(50_000, 1 + int(max((total[0] or 0) / _TASK_BYTES, (total[1] or 0) / _TASK_PAIRS)))
    large = sizes.filter("parts > 1").select("bucket", "parts")
    tiled = each.join(sized(large), "bucket", "left").fillna(1, ["parts"]).withColumn("part", F.expr("cast(pmod(xxhash64(h1, 9), parts) as int)"))
    tiled = tiled.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiled = tiled.select("bucket", F.least("part", "other").alias("x"), F.greatest("part", "other").alias("y"), "part", "h1", "c", "line")
    tile = ["bucket", "x", "y"]

    def links(batch: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        part, h1, c = (batch.column(i).to_numpy(zero_copy_only=False) for i in (3, 4, 5))
        _, first, which = np.unique(h1, return_index=True, return_inverse=True)
        sets = _sets(batch.column(6).take(pa.array(first)))
        odd = _parity(sets)
        found = [(lo + i, lo + j) for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True) for i, j in _joins([sets[k] for k in which[lo:hi].tolist()], c[lo:hi], part[lo:hi], odd[:, which[lo:hi]])]
        at = np.array(found, np.int64).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array(h1[at[:, 0]]), pa.array(h1[at[:, 1]])], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            whole = pa.Table.from_batches([*held, batch]).combine_chunks().to_batches()[0]
            keys = np.stack([whole.column(i).to_numpy(zero_copy_only=False) for i in range(3)])
            ends = np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1  # the last tile may go on in the next batch
            if len(ends):
                yield from sliced(whole, ends)
            held = [whole.slice(int(ends[-1]) if len(ends) else 0)]
        for rest in held:
            yield from links(rest, np.array([rest.num_rows]))

    def sliced(whole: pa.RecordBatch, ends: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Slices of bounded size, a tile at least."""
        total = np.cumsum(np.diff(Column(whole.column(6)).offsets))[ends - 1]
        at = 0
        while at < len(ends):
            lo, before = (int(ends[at - 1]), int(total[at - 1])) if at else (0, 0)
            to = max(at + 1, int(np.searchsorted(total, before + _VERIFIED, side="right")))
            yield from links(whole.slice(lo, int(ends[to - 1]) - lo), ends[at:to] - lo)
            at = to

    # a number of its own, as tasks merged by bytes would get too many pairs
    found = cut(tiled.repartition(tasks, *tile).sortWithinPartitions(*tile).mapInArrow(thrifty(run), "a bigint, b bigint"))
    discard(each, sizes)
    return found


def line_components(lines: DataFrame) -> DataFrame:
    """``(node, root)`` of the lines of ``lines_of`` (by hash ``h1``) that are similar to another."""
    names = [f"b{b}" for b in range(BANDS)]
    banded = lines.select("h1", "line").mapInArrow(thrifty(_banded), "h1 bigint, " + ", ".join(f"{n} bigint" for n in names))
    buckets = banded.select("h1", F.explode(F.array(*names)).alias("bucket"))
    least = F.min("h1").over(Window.partitionBy("bucket"))
    star = cut(buckets.withColumn("m", least).filter("m <> h1").groupBy("bucket", "m", "h1").agg(F.lit(1).alias("one")).drop("one"))
    pairs = star.select(F.col("m").alias("a"), F.col("h1").alias("b")).distinct()
    wanted = cut(star.select(F.explode(F.array("m", "h1")).alias("h1")).distinct())
    text = texts_of(lines, wanted)
    found = verify(pairs, text)
    member = star.select("bucket", "h1")  # a line that has been compared with its whole bucket leaves it
    for step in range(STARS):
        roots = components(found)
        placed = member.join(roots.withColumnRenamed("node", "h1"), "h1", "left").select("bucket", "h1", F.coalesce("root", "h1").alias("c"))
        spread = placed.groupBy("bucket").agg(F.min("c").alias("lo"), F.max("c").alias("hi"), F.min("h1").alias("m")).filter("lo <> hi").select("bucket", "m")
        member = cut(placed.join(spread, "bucket"))
        left = member.groupBy("bucket").agg(F.count("*").cast("double").alias("n")).agg(F.sum("n"), F.sum(F.expr("n * (n - 1) / 2"))).first()
        if left[0] is None:
            discard(star, wanted, text)
            return roots
        if step == STARS - 1 or left[1] <= EASY * left[0]:
            found = found.unionByName(verify_buckets(member, text))
            break
        first = member.filter("h1 = m").select("bucket", F.col("c").alias("cm"))
        rest = member.filter("h1 <> m").join(first, "bucket").filter("c <> cm").select(F.col("m").alias("a"), F.col("h1").alias("b"))
        member = member.filter("h1 <> m").select("bucket", "h1")
        found = found.unionByName(verify(rest.distinct(), text))
    discard(star, wanted, text)
    return components(found)


def fates(lines: DataFrame) -> DataFrame:
    """``(k1, k2, loses, twice, kept)``, written: by key of the documents that lose a line or whose row repeats,
    and the numbers of the lines that stay if any is lost; null if none stays."""
    roots = line_components(lines)
    each = lines.select("doc_id", "k1", "k2", "no", "h1", "h2")
    joined = each.join(sized(cut(roots.withColumnRenamed("node", "h1"))), "h1", "left")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "k1", "k2", "no")
    x, y = F.coalesce("root", "h1").alias("x"), F.when(F.col("root").isNull(), F.col("h2")).alias("y")
    first = joined.select(x, y, order.alias("o")).groupBy("x", "y").agg(F.min("o").alias("o")).select("o.k1", "o.k2", "o.no")
    kept = first.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("no")).alias("kept"))
    per = lines.groupBy("k1", "k2", "row").count().groupBy("k1", "k2").agg(F.max("count").alias("n"), (F.count("*") > 1).alias("twice"))
    loses = F.expr("kept is null or size(kept) < n")
    each = per.join(kept, ["k1", "k2"], "left").select("k1", "k2", loses.alias("loses"), "twice", F.when(loses, F.col("kept")).alias("kept"))
    return cut(each.filter("loses or twice"))


def _thinned(text: str, kept: list[int]) -> str:
    """The text's blank lines and those of ``kept``, without blank lines in a row or ahead."""
    out, after_blank, keep = [], True, set(kept)
    for no, line in enumerate(text.split("\n")):
        blank = not line.strip(" \t\r\f\x0b")
        if (blank and not after_blank) or (not blank and no in keep):
            out.append(line)
            after_blank = blank
    return "\n".join(out)


def dedup_lines(docs: DataFrame) -> DataFrame:
    """``docs`` with one line of each component left."""
    lines = lines_of(docs)
    fate = fates(lines)
    discard(lines)
    t, names = place(docs, "text"), [f"_{i}" for i in range(len(docs.columns))]
    told = keyed(docs).join(sized(fate, "32 + 4 * coalesce(size(kept), 0)"), ["k1", "k2"], "left")
    if fate.filter("twice").limit(1).count():
        told = told.filter("twice is null or not twice").unionByName(told.filter("twice").dropDuplicates(["k1", "k2"]))
    told = told.filter("loses is null or not loses or kept is not null").select(*names, "kept")
    counted = [i for i, f in enumerate(docs.schema.fields) if f.name == "n_chars" and f.dataType.typeName() in ("long", "integer")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays, kept = list(batch.columns[:-1]), batch.column(len(names))
            some = kept.is_valid()
            new = [_thinned(text, k) for text, k in zip(arrays[t].filter(some).to_pylist(), kept.filter(some).to_pylist(), strict=True)]
            if new:
                arrays[t] = pc.replace_with_mask(arrays[t], some, pa.array(new, arrays[t].type))
                for i in counted:
                    arrays[i] = pc.replace_with_mask(arrays[i], some, pa.array([len(x) for x in new], arrays[i].type))
            yield pa.RecordBatch.from_arrays(arrays, names)

    return told.mapInArrow(thrifty(run), told.select(*names).schema).toDF(*docs.columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet"))
