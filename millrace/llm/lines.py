"""Fuzzy line dedup by MinHash.

Lines are normalised (white space runs to one space, trimmed, lower case); a line is named by a 128-bit digest. Its set of
SHINGLE-character shingles gets one-permutation MinHash minima in BANDS x ROWS bins, once; two lines with Jaccard similarity
0.8 share a band with probability 0.97, at 0.85 with 0.999 (a test measures it, with few distinct shingles too). What is shuffled is a band's hash and the line's id, a hash with the size of its set in front, packed to 12 bytes and gathered by
range of the band's hash; a task sorts some ranges at a time, a large one in runs that go to files, and a bucket's members stream by in order of size; where sizes differ by
more than the similarity allows, it is split. Texts of
lines in buckets with two or more members are then fetched in one more pass over the documents, which a bitmap of candidate
ids (BITMAP bits, whatever the input) keeps from shuffling most others; exact Jaccard is computed on them, skipping pairs that
already are connected. Links are joined up by distributed components, and of each component just the first line by (doc_id,
line number) is kept.

A bucket of more than BLOCK lines is looked at in blocks, each together with PIVOTS first lines of the bucket and the end of
the block before, which is linear. Where that leaves a bucket's lines in several components, the lines outside the largest are
compared with all lines of buckets of that component whose sizes allow it, again in blocks, so that no link is lost.

Edge cases: null text is one blank line; blank lines are never removed; lines shorter than a shingle are padded with NUL to
one; null doc_ids come last; whole rows that repeat are decided alike, so a line that only repeats in them stays in each; long
lines are shingled whole, in pieces of _CHUNK characters; extra columns pass through ``deduplicated`` unchanged, whatever
their names; an empty table gives no rows.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import bitmap_of, bitmap_rows, cut, fresh, in_bitmap, mix64, row_batches, text_values, whole_batches, with_bit
from millrace.llm.components import components

SHINGLE = 5
BANDS, ROWS = 12, 6
SIMILARITY = 0.8
BLOCK, PIVOTS = 224, 16
BITMAP = 1 << 25
SEEN = 200_000
_BINS = BANDS * ROWS
# small enough for a core's cache
_CHUNK = 1 << 15
_KEY_BITS = 52
# a line's size code is the logarithm of its number of distinct shingles; codes of similar lines are this close
_CODES = 120
_GAP = int(np.ceil(-np.log(SIMILARITY) * _CODES)) + 2
_MULT = np.uint64(0x9E3779B97F4A7C15)
# shingle hashes that are sorted together with line numbers are cut to these bits
_HASH_BITS = 52
_LOW = np.uint64((1 << _HASH_BITS) - 1)
# of a band's hash the first bits name a range and 32 more go with the id; lines that meet by chance are told apart by the exact comparison
_RANGE_BITS = 14
_ROW = np.dtype([("band", "<u4"), ("id", "<i8")])
_FULL = np.dtype([("band", "<i8"), ("id", "<i8")])
# rows that a task packs at once; rows that it sorts at once, in whole ranges; rows that it holds of a range at most, beyond which they go to a temporary file
PACKED, SORTED, RUN = 1 << 20, 1 << 18, 1 << 20


# what makes white space inside a line differ from single spaces
_UNEVEN = (b"  ", b"\t", b"\r", b"\x0b", b"\x0c")


def lines_of(text: bytes) -> list[bytes]:
    """The normalised lines of a text; blank ones are empty."""
    low = text.lower() if text.isascii() else text.decode().lower().encode()
    found = low.split(b"\n")
    if any(x in low for x in _UNEVEN):
        return [b" ".join(x.split()) for x in found]
    return [x.strip() for x in found]


def digests(lines: list[bytes]) -> np.ndarray:
    """128 bits for each line, as two 64-bit numbers."""
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(x) for x in lines]), ">u8").astype(np.uint64).reshape(-1, 2)


def key_of(names: np.ndarray) -> np.ndarray:
    return names[:, 0] >> np.uint64(64 - _KEY_BITS)


def _code_points(lines: list[bytes]) -> np.ndarray:
    """Of all lines, a line feed after each; short lines are padded."""
    padded = [x if len(x) >= 4 * SHINGLE or (n := len(x.decode())) >= SHINGLE else x + b"\0" * (SHINGLE - n) for x in lines]
    return np.frombuffer((b"\n".join(padded) + b"\n").decode().encode("utf-32-le"), np.uint32)


def _shingles(points: np.ndarray) -> np.ndarray:
    """A hash of _HASH_BITS bits for each run of SHINGLE code points."""
    x = points.astype(np.uint64)
    x += np.uint64(1)
    n = max(0, len(x) - SHINGLE + 1)
    h = x[:n].copy()
    for k in range(1, SHINGLE):
        h *= _MULT
        h += x[k : k + n]
    h ^= h >> np.uint64(32)
    h *= _MULT
    h ^= h >> np.uint64(29)
    h *= _MULT
    h >>= np.uint64(64 - _HASH_BITS)
    return h


def _long_set(line: bytes) -> np.ndarray:
    """The distinct shingle hashes of one line, sorted, a piece of _CHUNK characters at a time."""
    points = _code_points([line])[:-1]
    return np.unique(np.concatenate([np.unique(_shingles(points[k : k + _CHUNK + SHINGLE - 1])) for k in range(0, len(points), _CHUNK)]))


def _line_sets(lines: list[bytes]) -> Iterator[tuple[int, int, np.ndarray]]:
    """For runs of lines, at to stop: (line number from at, hash) of each distinct shingle as one number, sorted. A line of more than _CHUNK bytes comes alone."""
    at = 0
    while at < len(lines):
        stop, total = at + 1, len(lines[at])
        while stop < len(lines) and total + len(lines[stop]) < _CHUNK and stop - at < 1 << 64 - _HASH_BITS:
            total += len(lines[stop]) + 1
            stop += 1
        if len(lines[at]) >= _CHUNK:
            yield at, stop, _long_set(lines[at])
        else:
            points = _code_points(lines[at:stop])
            ends = points == 10
            line = np.cumsum(ends, dtype=np.uint64)
            x = _shingles(points)
            n = len(x)
            inside = (line[:n] == line[SHINGLE - 1 :]) & ~ends[:n]
            x |= line[:n] << np.uint64(_HASH_BITS)
            x = x[inside]
            x.sort()
            yield at, stop, x[np.concatenate(([True], x[1:] != x[:-1]))]
        at = stop


def shingle_sets(lines: list[bytes]) -> list[np.ndarray]:
    """The distinct shingle hashes of each line, sorted."""
    out = []
    for at, stop, x in _line_sets(lines):
        edges = np.searchsorted(x, np.arange(1, stop - at, dtype=np.uint64) << np.uint64(_HASH_BITS))
        out += np.split(x & _LOW, edges)
    return out


def minima(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The least hash of each line in each of _BINS bins, 0 if there is none, and each line's number of distinct shingles."""
    out, sizes = np.zeros((len(lines), _BINS), np.uint64), np.zeros(len(lines), np.int64)
    for at, stop, x in _line_sets(lines):
        line = (x >> np.uint64(_HASH_BITS)).astype(np.int64)
        sizes[at:stop] = np.bincount(line, minlength=stop - at)
        # sorted by line and hash, whose upper bits are the bin: the first of each bin is its least
        where = line * _BINS + ((((x >> np.uint64(_HASH_BITS - 24)) & np.uint64(0xFFFFFF)) * np.uint64(_BINS)) >> np.uint64(24)).astype(np.int64)
        first = np.flatnonzero(np.concatenate(([True], where[1:] != where[:-1])))
        out[at:stop].reshape(-1)[where[first]] = (x[first] & _LOW) + np.uint64(1)
    return out, sizes


def signatures(lines: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """One row of band hashes for each line, and its number of distinct shingles."""
    out, sizes = minima(lines)
    rows = np.flatnonzero((out == 0).any(axis=1))
    if len(rows):  # an empty bin takes over the value of the next one to the right that isn't, marked with the distance
        part, column = out[rows], np.arange(2 * _BINS)
        filled = np.where(np.tile(part != 0, 2), column, 2 * _BINS)
        source = np.minimum.accumulate(filled[:, ::-1], axis=1)[:, ::-1][:, :_BINS]
        distance = (source - column[:_BINS]).astype(np.uint64)
        out[rows] = np.take_along_axis(part, source % _BINS, axis=1) + distance * np.uint64(0x51ED270B51ED270B)
    bands = np.zeros((len(lines), BANDS), np.uint64)
    for r in range(ROWS):
        bands = mix64(bands * _MULT + out[:, r::ROWS])
    return mix64(bands + np.arange(BANDS, dtype=np.uint64)), sizes


def ids_of(names: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A line's id: its size code, then its key; as a signed number it is never negative."""
    codes = np.minimum((np.log(np.maximum(sizes, 1)) * _CODES).astype(np.uint64), np.uint64((1 << 63 - _KEY_BITS) - 1))
    return ((codes << np.uint64(_KEY_BITS)) | key_of(names)).view(np.int64)


def _packed(bands: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(range, rows): bands and ids, those of a range as one value."""
    for k in range(0, len(bands), 4 * PACKED):
        part = bands[k : k + 4 * PACKED]
        order = np.argsort((part >> np.uint64(64 - _RANGE_BITS)).astype(np.uint16), kind="stable")
        part, rows = part[order], np.empty(len(part), _ROW)
        rows["band"] = (part >> np.uint64(32 - _RANGE_BITS)).astype(np.uint32)
        rows["id"] = ids[k : k + 4 * PACKED][order]
        of = (part >> np.uint64(64 - _RANGE_BITS)).astype(np.int32)
        starts = np.concatenate(([0], np.flatnonzero(of[1:] != of[:-1]) + 1))
        offsets = (np.append(starts, len(of)) * _ROW.itemsize).astype(np.int32)
        values = pa.BinaryArray.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(rows.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(of[starts]), values], names=["range", "rows"])


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(range, rows) of the bands of each line; lines that the task has seen lately are left out."""
    seen: set[bytes] = set()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    for batch in row_batches(batches):
        named = {x: xxhash.xxh3_128_digest(x) for x in dict.fromkeys(x for t in text_values(batch.column(0)) for x in lines_of(t)) if x}
        new = [x for x, name in named.items() if name not in seen]
        if not new:
            continue
        names = digests(new)
        if len(seen) > SEEN:
            seen.clear()
        seen.update(named.values())
        bands, sizes = signatures(new)
        held.append((bands.reshape(-1), np.repeat(ids_of(names, sizes), BANDS)))
        if sum(len(x) for x, _ in held) >= PACKED:
            yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held = []
    if held:
        yield from _packed(*(np.concatenate(x) for x in zip(*held, strict=True)))


def _in_order(rows: np.ndarray) -> np.ndarray:
    return rows[np.lexsort((rows["id"], rows["band"]))]


def _spilled(rows: np.ndarray) -> np.ndarray:
    """The same rows in a file that goes when they do."""
    with tempfile.TemporaryFile() as file:
        rows.tofile(file)
        file.flush()
        return np.memmap(file, rows.dtype, "r")


def _merged(runs: list[np.ndarray], step: int = 10_000) -> Iterator[np.ndarray]:
    """The rows of sorted runs in order, ``step`` of each run at a time."""
    at = [0] * len(runs)
    while runs:
        windows = [np.array(run[k : k + step]) for run, k in zip(runs, at, strict=True)]
        # no row that isn't in a window comes before the least last row of windows that don't end their run
        last = min((w[-1].item() for w, run, k in zip(windows, runs, at, strict=True) if k + step < len(run)), default=None)
        for i, w in enumerate(windows if last else []):
            low, high = np.searchsorted(w["band"], last[0]), np.searchsorted(w["band"], last[0], "right")
            windows[i] = w[: low + np.searchsorted(w["id"][low:high], last[1], "right")]
            at[i] += len(windows[i])
        yield _in_order(np.concatenate(windows))
        if last is None:
            return


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of packed rows sorted by range: (band, id), sorted; without lines that are alone in a band, unless they went to files."""
    held: list[tuple[int, np.ndarray]] = []
    runs: list[np.ndarray] = []
    last, n = None, 0

    def rows() -> np.ndarray:
        out = np.empty(n, _FULL)
        packed = np.concatenate([x for _, x in held])
        out["band"] = np.repeat(np.array([r for r, _ in held], np.int64) << 32, [len(x) for _, x in held]) | packed["band"].astype(np.int64)
        out["id"] = packed["id"]
        held.clear()
        return out

    def settled() -> Iterator[pa.RecordBatch]:
        if runs:
            parts = _merged(runs + [_in_order(rows())] * (n > 0))
        else:
            every = rows()
            order = np.argsort(every["band"])
            same = np.diff(every["band"][order]) == 0
            parts = [_in_order(every[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]])]
        for part in parts:
            for k in range(0, len(part), 10_000):
                yield pa.RecordBatch.from_arrays([pa.array(part[c][k : k + 10_000].copy()) for c in ("band", "id")], names=["band", "id"])
        runs.clear()

    for batch in whole_batches(batches):
        for of, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if of != last and (n >= SORTED or runs):
                yield from settled()
                n = 0
            elif n >= RUN:
                runs.append(_spilled(_in_order(rows())))
                n = 0
            held.append((of, np.frombuffer(packed, _ROW)))
            last, n = of, n + len(held[-1][1])
    if held or runs:
        yield from settled()


_GROUPS = pa.schema([("group", pa.int64()), ("id", pa.int64()), ("segment", pa.int64())])


class _Segment:
    """Groups of one segment, a part of a bucket, from its members in order: all at once, or if there are many, in blocks."""

    def __init__(self, band: int):
        self.band, self.name, self.first, self.last, self.rest = band, None, None, None, np.zeros(0, np.int64)

    def put(self, members: np.ndarray, more: bool) -> list[tuple[np.ndarray, int | None]]:
        """(members, segment) of groups. Takes whole blocks from ``members``, or all if no ``more`` come; what is left is in ``rest``."""
        if self.first is None and not more and len(members) <= BLOCK:
            return [(members, None)] if len(members) > 1 else []
        out, stop = [], len(members) // BLOCK * BLOCK if more else len(members)
        for k in range(0, stop, BLOCK):
            block = members[k : k + BLOCK]
            if self.first is None:
                self.first, self.last = block[:PIVOTS], block[:0]
                self.name = int(mix64((block[:1] ^ np.int64(self.band)).view(np.uint64)).view(np.int64)[0])
            out.append((np.unique(np.concatenate((self.first, self.last, block))), self.name))
            self.last = block[-PIVOTS:]
        self.rest = members[stop:]
        return out


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (band, id): (group, id, segment). Groups are named by their members; only large segments have names."""
    found: list[tuple[np.ndarray, int | None]] = []
    segment, ids = None, np.zeros(0, np.int64)

    def full() -> pa.RecordBatch:
        sizes = np.array([len(g[0]) for g in found])
        flat = np.concatenate([g[0] for g in found])
        first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        names = mix64(np.add.reduceat(mix64(flat.view(np.uint64)), first) + sizes.astype(np.uint64)).view(np.int64)
        of = np.repeat(np.arange(len(found)), sizes)
        out = [pa.array(names[of]), pa.array(flat), pa.array([g[1] for g in found], pa.int64()).take(pa.array(of))]
        found.clear()
        return pa.RecordBatch.from_arrays(out, schema=_GROUPS)

    for batch in whole_batches(batches):
        bands, new = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(2))
        if segment is None:
            segment = _Segment(int(bands[0]))
        else:  # the last segment may go on
            bands, new = np.concatenate((np.full(len(ids), segment.band), bands)), np.concatenate((ids, new))
        keep = np.concatenate(([True], (bands[1:] != bands[:-1]) | (new[1:] != new[:-1])))
        bands, new = bands[keep], new[keep]
        codes = new >> _KEY_BITS
        edges = np.flatnonzero((bands[1:] != bands[:-1]) | (codes[1:] - codes[:-1] > _GAP)) + 1
        starts, ends = np.concatenate(([0], edges)), np.append(edges, len(new))
        for k in np.flatnonzero((ends - starts > 1) | (starts == 0)).tolist():
            if k < len(starts) - 1:
                found += (segment if k == 0 else _Segment(int(bands[starts[k]]))).put(new[starts[k] : ends[k]], False)
        if len(starts) > 1:
            segment = _Segment(int(bands[-1]))
        ids = new[starts[-1] :]
        if len(ids) > 4 * BLOCK:
            found += segment.put(ids[:-1], True)
            ids = np.concatenate((segment.rest, ids[-1:]))
        if sum(len(g[0]) for g in found) > 5000:
            yield full()
    if segment is not None:
        found += segment.put(ids, False)
    if found:
        yield full()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets have that Jaccard similarity at least."""
    if min(len(a), len(b)) < least * max(len(a), len(b)):
        return False
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (len(a) + len(b) - common)


def plausible(sets: list[np.ndarray], least: float) -> list[tuple[int, int]]:
    """Pairs that may be similar, likely ones first. Sets have no more in common than the lesser counts in each of 64 buckets add up to."""
    n = len(sets)
    if n <= 6:
        return [(i, j) for i in range(n) for j in range(i + 1, n)]
    sizes = np.array([len(x) for x in sets])
    counts = np.bincount(np.repeat(np.arange(n) * 64, sizes) + (np.concatenate(sets) & np.uint64(63)).astype(np.int64), minlength=64 * n).reshape(n, 64)
    common = np.zeros((n, n), np.int64)
    for k in range(64):
        common += np.minimum(counts[:, k][:, None], counts[:, k][None, :])
    union = sizes[:, None] + sizes[None, :] - common
    i, j = np.nonzero(np.triu(common >= least * union, 1))
    order = np.argsort(-(common[i, j] / union[i, j]), kind="stable")
    return list(zip(i[order].tolist(), j[order].tolist(), strict=True))


def jaccard_links(names: list, sets: list[np.ndarray], least: float = SIMILARITY) -> list[tuple]:
    """Links that connect what exact Jaccard connects, from each line to the first of its component; pairs that already are connected aren't compared."""
    if len(names) == 2:
        return [(names[1], names[0])] if similar(*sets, least) else []
    label = list(range(len(names)))

    def find(x: int) -> int:
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for i, j in plausible(sets, least):
        a, b = find(i), find(j)
        if a != b and similar(sets[i], sets[j], least):
            label[max(a, b)] = min(a, b)
    return [(name, names[find(k)]) for k, name in enumerate(names) if find(k) != k]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows (group, name, line) sorted by group: verified links."""
    groups, names, lines = [], [], []

    def settle(stop: int) -> pa.RecordBatch | None:
        """Links of the groups among the first ``stop`` rows, which then go."""
        out, sets = [], shingle_sets(lines[:stop])
        edges = [0, *(k for k in range(1, stop) if groups[k] != groups[k - 1]), stop]
        for a, b in zip(edges, edges[1:]):
            if b - a > 1:
                out += jaccard_links(names[a:b], sets[a:b])
        del groups[:stop], names[:stop], lines[:stop]
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in zip(*out, strict=True)], names=["a", "b"]) if out else None

    for batch in row_batches(batches):
        groups += batch.column(0).to_pylist()
        names += batch.column(1).to_pylist()
        lines += text_values(batch.column(2))
        stop = len(groups)
        while stop and groups[stop - 1] == groups[-1]:
            stop -= 1
        if stop and (links := settle(stop)) is not None:
            yield links
    if groups and (links := settle(len(groups))) is not None:
        yield links


def _line_rows(bitmap: np.ndarray):
    """doc_id, mark, line_no, name and key of each line that isn't blank, and its text if its key is in the bitmap and the task hasn't passed it on lately.
    For each document also a row of its own, with line_no -1 and its number of lines as key."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("line_no", pa.int32()), ("name", pa.binary()), ("key", pa.int64()), ("norm", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in row_batches(batches):
            every = [lines_of(t) for t in text_values(batch.column(2))]
            n, counts = len(every), np.array([len(row) for row in every], np.int64)
            own = [pa.array(np.full(n, -1, np.int32)), pa.nulls(n, pa.binary()), pa.array(counts), pa.nulls(n, pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *own], schema=schema)
            found = [[(i, x) for i, x in enumerate(row) if x] for row in every]
            lines = [x for row in found for _, x in row]
            if not lines:
                continue
            of = pa.array(np.repeat(np.arange(len(found)), [len(row) for row in found]))
            names = digests(lines)
            key, raw = key_of(names), names.astype(">u8").tobytes()
            texts: list[str | None] = [None] * len(lines)
            for k in np.flatnonzero(in_bitmap(bitmap, key)).tolist():
                if (name := raw[16 * k : 16 * k + 16]) not in seen:
                    seen.add(name)
                    texts[k] = lines[k].decode()
            if len(seen) > SEEN:
                seen.clear()
            numbers = pa.array([i for row in found for i, _ in row], pa.int32())
            name = pa.FixedSizeBinaryArray.from_buffers(pa.binary(16), len(lines), [None, pa.py_buffer(raw)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(of), batch.column(1).take(of), numbers, name, pa.array(key.view(np.int64)), pa.array(texts, pa.string())], schema=schema)

    return run


def _key() -> Column:
    return F.col("id").bitwiseAND(F.lit((1 << _KEY_BITS) - 1))


def _texts(rows: DataFrame) -> DataFrame:
    """key, name and norm of the rows with a text, each line once; dealt by key, as the join with groups needs them."""
    return rows.where(F.col("norm").isNotNull()).select("key", "name", "norm").repartition("key").dropDuplicates(["key", "name"])


def _verified(groups: DataFrame, texts: DataFrame) -> DataFrame:
    """``groups``: group, key; ``texts``: key, name, norm. Links between names, exact."""
    rows = groups.join(texts, "key").select("group", "name", "norm")
    return rows.repartition("group").sortWithinPartitions("group", "name").mapInArrow(_verify, "a binary, b binary")


def _blocks(members: DataFrame, name: str) -> DataFrame:
    """``members`` (cluster, id, key) with a block number in order of size, for 2 x BLOCK lines at most, and the block's least and greatest size codes."""
    code = F.shiftright("id", _KEY_BITS)
    counts = members.groupBy("cluster", code.alias("code")).agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("cluster").orderBy("code").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("cluster", "code", F.floor(before / BLOCK).alias("at"), F.ceil(F.col("n") / BLOCK).alias("parts"))
    number = F.struct("at", F.pmod(F.xxhash64("id"), F.col("parts")).alias("part"))
    return members.withColumn("code", code).join(counts, ["cluster", "code"]).select("cluster", "id", "key", "code", number.alias(name))


def _across(large: DataFrame, texts: DataFrame, root: DataFrame) -> DataFrame | None:
    """``large``: segment, id. Groups (group, key) that compare the lines outside a segment's largest component with all lines of its segments; None if there are none."""
    named = large.withColumn("key", _key()).join(texts.select("key", "name"), "key")
    labelled = cut(named.join(root, F.col("name") == F.col("node"), "left").select("segment", "id", "key", F.coalesce("root", "name").alias("root")))
    counts = labelled.groupBy("segment", "root").agg(F.count("*").alias("n"))
    main = counts.groupBy(F.col("segment").alias("s")).agg(F.max(F.struct("n", "root"))["root"].alias("cluster"), F.count("*").alias("roots")).where("roots > 1").select("s", "cluster")
    # one large component has segments in several bands: they are looked at together
    members = cut(labelled.join(main, F.col("segment") == F.col("s")).select("cluster", "id", "key", "root").distinct())
    rest = members.where(F.col("root") != F.col("cluster")).select("cluster", "id", "key").distinct()
    if rest.isEmpty():
        return None
    rest, blocks = cut(_blocks(rest, "chunk")), cut(_blocks(members.select("cluster", "id", "key").distinct(), "block"))

    def ranges(df: DataFrame, of: str) -> DataFrame:
        return df.groupBy("cluster", of).agg(F.min("code").alias(f"{of}_low"), F.max("code").alias(f"{of}_high"))

    near = (F.col("chunk_low") <= F.col("block_high") + _GAP) & (F.col("block_low") <= F.col("chunk_high") + _GAP)
    pairs = cut(ranges(rest, "chunk").join(ranges(blocks, "block"), "cluster").where(near).select("cluster", "chunk", "block", F.xxhash64("cluster", "chunk", "block").alias("group")))
    return pairs.join(rest, ["cluster", "chunk"]).select("group", "key").union(pairs.join(blocks, ["cluster", "block"]).select("group", "key")).distinct()


def similar_lines(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``docs``: doc_id, mark, text. The lines that aren't blank (doc_id, mark, line_no, name), for those that are linked to another node (the name) and root, and the documents (doc_id, mark, n_lines)."""
    packed = docs.select("text").mapInArrow(_bands, "range int, rows binary").repartition("range").sortWithinPartitions("range")
    groups = cut(packed.mapInArrow(lambda batches: _groups(_shared(batches)), "group long, id long, segment long").distinct())
    keyed = groups.select("group", _key().alias("key"))
    rows = cut(docs.select("doc_id", "mark", "text").mapInArrow(_line_rows(bitmap_of(keyed, "key", BITMAP)), "doc_id long, mark long, line_no int, name binary, key long, norm string"))
    large = groups.where(F.col("segment").isNotNull()).select("segment", "id").distinct()
    root = components(_verified(keyed.repartition("key").distinct(), _texts(rows)))
    if not large.isEmpty():
        more = _across(large, _texts(rows), root)
        if more is not None:
            # only texts of lines that are compared again are shuffled again
            more = cut(more)
            marked, bit = with_bit(rows.where(F.col("norm").isNotNull()), F.col("key"), bitmap_rows(more, "key", BITMAP), BITMAP)
            root = components(root.select(F.col("node").alias("a"), F.col("root").alias("b")).union(_verified(more, _texts(marked.where(F.col(bit))))))
    lines, own = rows.where("line_no >= 0").select("doc_id", "mark", "line_no", "name"), rows.where("line_no < 0")
    return lines, root, own.select("doc_id", "mark", F.col("key").alias("n_lines"))


def decisions(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, n_lines, removed (numbers of removed lines from 0, ascending)."""
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(t).alias("mark"), t.alias("text"))
    lines, root, sizes = similar_lines(rows)
    # only lines that are repeated or linked may go
    repeated = lines.groupBy("name").agg(F.count("*").alias("n")).where("n > 1").select(F.col("name").alias("node"), F.col("name").alias("root"))
    concerned = repeated.join(root, "node", "left_anti").union(root.select("node", "root"))
    named = cut(lines.join(concerned, F.col("name") == F.col("node")).select("doc_id", "mark", "line_no", "root"))
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "line_no")
    # written, so that the join with a very common line can be split
    first = cut(named.groupBy(F.col("root").alias("r")).agg(F.min(order).alias("first")))
    late = named.join(first, F.col("root") == F.col("r")).where(order != F.col("first"))
    gone = late.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("k")).agg(F.array_sort(F.collect_set("line_no")).alias("removed"))
    return sizes.join(gone, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("k")), "left").select("doc_id", "mark", "n_lines", F.coalesce("removed", F.array().cast("array<int>")).alias("removed"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with removed lines taken out of the text; other columns unchanged."""
    d, k, r = (fresh(docs.columns, f"__{x}") for x in ("d", "k", "removed"))
    gone = decisions(docs, doc_id, text).where(F.size("removed") > 0).dropDuplicates(["doc_id", "mark"]).select(F.col("doc_id").alias(d), F.col("mark").alias(k), F.col("removed").alias(r))
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    joined = docs.join(gone, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(t) == F.col(k)), "left")
    kept = F.array_join(F.filter(F.split(t, "\n", -1), lambda x, i: ~F.array_contains(r, i)), "\n")
    return joined.select(*(F.when(F.col(r).isNotNull(), kept).otherwise(F.col(f"`{c}`")).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns))
