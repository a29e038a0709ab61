"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two 64-bit fingerprints that differ in at most 3 bits differ in at most 2 on some two of three blocks of 21, 21 and 22
bits. So each distinct fingerprint has three projections (all but one block), and from each it emits the ball of radius 1,
half of 2: the projection itself and every variant with one bit flipped. Balls of linked fingerprints meet in a variant.
(Balls on the full 64 bits would need radius 2 on one side: 2,081 variants a document instead of 130.)

Variants are shuffled; within a variant's bucket, links are found and verified without looking at all pairs: members with
equal left-out blocks are within 2 bits of each other, so only different left-out blocks are compared, and each bucket
gives a spanning forest, fewer rows than it has members. Components are then joined up over the whole input.

A bucket holds distinct fingerprints only, 8 bytes each. They agree in 42 bits but for one, so there are 44 x 2^22 of them at
the very most, and as many copies as one likes of a document are one.

Edge cases: null or wordless text has fingerprint zero, linked like any other; repeated rows share a component; a
component whose ids are all null has a null component_id; null ids never are the smallest; an empty table gives no rows;
long texts are hashed whole, _STEP shingles at a time; extra columns pass through ``keep_one`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bitmap_rows, cut, fresh, lowered, row_batches, row_mark, text_values, whole_batches, with_bit
from millrace.llm.components import components

SHINGLE = 3
SEED = 42
RADIUS = 3
BITMAP = 1 << 25
# the blocks' bits; a projection leaves one of them out
BLOCKS = [range(0, 21), range(21, 42), range(42, 64)]
_LEFT_OUT = [np.uint64(sum(1 << b for b in block)) for block in BLOCKS]
_STEP = 1 << 16
_TOGETHER = 1 << 19


def fingerprint(text: bytes, width: int = SHINGLE, seed: int = SEED) -> int:
    """SimHash over XXH64 of space-joined shingles of a text's white-space words, repeats included."""
    words = lowered(text).split()
    if not words:
        return 0
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= width:
        return digest(joined, seed)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = (ends - [len(w) + 1 for w in words])[: len(words) - width + 1].tolist()
    ends = (ends - 1)[width - 1 :].tolist()
    counts = np.zeros(64, np.int64)
    for k in range(0, len(starts), _STEP):
        h = np.array([digest(joined[a:b], seed) for a, b in zip(starts[k : k + _STEP], ends[k : k + _STEP], strict=True)], ">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(starts)).tobytes(), "big")


# The primes of XXH64.
_P = [np.uint64(x) for x in (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)]


def _turn(x: np.ndarray, bits: int) -> np.ndarray:
    return x << np.uint64(bits) | x >> np.uint64(64 - bits)


def xxh64_many(raw: bytes, starts: np.ndarray, ends: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each piece raw[start:end], those of equal length side by side."""
    p1, p2, p3, p4, p5 = _P
    padded = raw + bytes(8)
    eights = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    fours = np.ndarray((len(raw) + 1,), "<u4", padded, strides=(1,))
    ones, sizes = np.frombuffer(padded, np.uint8), ends - starts
    out, order = np.empty(len(starts), np.uint64), np.argsort(sizes, kind="stable")
    edges = np.flatnonzero(np.diff(sizes[order], prepend=-1, append=-1))
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        where, size, at = order[a:b], int(sizes[order[a]]), 0
        base = starts[where]
        if size >= 32:
            lanes = [np.full(b - a, (seed + x) % (1 << 64), np.uint64) for x in (int(p1) + int(p2), int(p2), 0, -int(p1))]
            while at + 32 <= size:
                lanes = [_turn(v + eights[base + at + 8 * k] * p2, 31) * p1 for k, v in enumerate(lanes)]
                at += 32
            h = _turn(lanes[0], 1) + _turn(lanes[1], 7) + _turn(lanes[2], 12) + _turn(lanes[3], 18)
            for v in lanes:
                h = (h ^ _turn(v * p2, 31) * p1) * p1 + p4
        else:
            h = np.full(b - a, (seed + int(p5)) % (1 << 64), np.uint64)
        h = h + np.uint64(size)
        while at + 8 <= size:
            h = _turn(h ^ _turn(eights[base + at] * p2, 31) * p1, 27) * p1 + p4
            at += 8
        if at + 4 <= size:
            h = _turn(h ^ fours[base + at].astype(np.uint64) * p1, 23) * p2 + p3
            at += 4
        while at < size:
            h = _turn(h ^ ones[base + at].astype(np.uint64) * p5, 11) * p1
            at += 1
        h = (h ^ h >> np.uint64(33)) * p2
        h = (h ^ h >> np.uint64(29)) * p3
        out[where] = h ^ h >> np.uint64(32)
    return out


def majority(hashes: np.ndarray, first: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The bits set in over half of each run of hashes. Eight bits at a time are counted in the bytes of 64-bit sums, over 255 hashes at most."""
    place = np.arange(len(hashes)) - np.repeat(first, many)
    blocks = np.flatnonzero(place % 255 == 0)
    sums = np.stack([np.add.reduceat(hashes >> np.uint64(k) & np.uint64(0x0101010101010101), blocks) for k in range(8)], axis=1)
    counts = sums.astype("<u8").view(np.uint8).reshape(-1, 8, 8).transpose(0, 2, 1).reshape(-1, 64)
    counts = np.add.reduceat(counts, np.flatnonzero(place[blocks] == 0), axis=0, dtype=np.int64)
    return np.packbits(2 * counts > many[:, None], axis=1, bitorder="little").reshape(-1).view("<u8").astype(np.uint64)


def fingerprints_of(texts: list[bytes], width: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    """``fingerprint`` of each text: short ones together, long ones each by itself."""
    out, at = np.zeros(len(texts), np.uint64), 0
    while at < len(texts):
        stop, size = at + 1, len(texts[at])
        while stop < len(texts) and size + len(texts[stop]) <= _TOGETHER:
            size += len(texts[stop])
            stop += 1
        if size > _TOGETHER:
            out[at] = fingerprint(texts[at], width, seed)
            at = stop
            continue
        joined = [b" ".join(lowered(t).split()) for t in texts[at:stop]]
        some = [k for k, t in enumerate(joined) if t.count(b" ") >= width]
        for k, t in enumerate(joined):
            if t and t.count(b" ") < width:  # one shingle
                out[at + k] = xxhash.xxh64_intdigest(t, seed)
        if some:
            raw = b"\n".join([joined[k] for k in some])
            chars = np.frombuffer(raw, np.uint8)
            gaps = np.flatnonzero((chars == 32) | (chars == 10))
            starts, ends = np.concatenate(([0], gaps + 1)), np.append(gaps, len(raw))
            text = np.concatenate(([0], np.cumsum(chars[gaps] == 10)))
            whole = np.flatnonzero(text[: len(text) - width + 1] == text[width - 1 :])
            hashes, of = xxh64_many(raw, starts[whole], ends[whole + width - 1], seed), text[whole]
            first = np.flatnonzero(np.diff(of, prepend=-1))
            many = np.diff(np.append(first, len(of)))
            out[at + np.array(some)] = majority(hashes, first, many)
        at = stop
    return out


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_batches(batches):
        prints = fingerprints_of(text_values(batch.column(0))).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), batch.column(3), pa.array(prints)], names=["doc_id", "mark", "row", "fp"])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, mark (a hash of the text), row (a hash of the whole row), fp (the fingerprint as a signed long)."""
    rows = docs.select(F.col(f"`{text}`").alias("t"), F.col(f"`{doc_id}`").cast("long").alias("d"), F.xxhash64(f"`{text}`").alias("m"), row_mark(docs).alias("r"))
    return cut(rows.mapInArrow(_fingerprints, "doc_id long, mark long, row long, fp long"))


def variants(prints: DataFrame) -> DataFrame:
    """which (projection), variant, fp: the ball of radius 1 around each projection of each distinct fingerprint. JVM-side."""
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x

    def ball(k: int) -> Column:
        masks = F.array(*(F.lit(signed(m)) for m in [0, *(1 << b for b in range(64) if b not in BLOCKS[k])]))
        projected = F.col("fp").bitwiseAND(F.lit(signed(~int(_LEFT_OUT[k]) & (1 << 64) - 1)))
        return F.transform(masks, lambda m: F.struct(F.lit(k).cast("byte").alias("which"), projected.bitwiseXOR(m).alias("variant")))

    arrays = [ball(k) for k in range(len(BLOCKS))]
    return prints.select("fp", F.explode(F.concat(*arrays)).alias("v")).select("v.which", "v.variant", "fp")


def _roots(n: int, pairs: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Component label of each of n members."""
    parent = list(range(n))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in pairs:
        for x, y in zip(a.tolist(), b.tolist(), strict=True):
            x, y = find(x), find(y)
            if x != y:
                parent[max(x, y)] = min(x, y)
    return np.array([find(x) for x in range(n)])


def bucket_links(variant: int, which: int, members: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links that a bucket vouches for. ``members``: distinct fingerprints, sorted.

    Any two members differ in at most 2 projected bits; in none if both are centres or both differ from the variant in the
    same bit, in one if just one is a centre. Links over 2 left-out bits with one projected bit, and over 3 with none, are
    found here for centres; every such pair has a bucket in which one of the two (or both) is the centre.
    """
    out = _LEFT_OUT[which]
    rest = members & out
    values, first, group = np.unique(rest, return_index=True, return_inverse=True)
    pairs = [(np.arange(len(members)), first[group])]
    bits = np.array([1 << b for b in BLOCKS[which]], np.uint64)

    def meet(sources: np.ndarray, masks: np.ndarray) -> None:
        for m in masks:
            wanted = rest[sources] ^ m
            at = np.searchsorted(values, wanted)
            at[at == len(values)] = 0
            hit = values[at] == wanted
            if hit.any():
                pairs.append((sources[hit], first[at[hit]]))

    if len(values) > 1:
        heads = first
        centres = np.flatnonzero((members & ~out) == np.uint64(variant))
        if len(values) <= 64:  # few left-out blocks: compare them directly, and centres with all members' blocks
            d = np.bitwise_count(values[:, None] ^ values[None, :])
            a, b = np.nonzero(np.triu(d == 1))
            pairs.append((heads[a], heads[b]))
            if len(centres):
                d = np.bitwise_count(rest[centres][:, None] ^ values[None, :])
                a, b = np.nonzero(d == 2)
                pairs.append((centres[a], heads[b]))
                d = np.bitwise_count(rest[centres][:, None] ^ rest[centres][None, :])
                a, b = np.nonzero(np.triu(d == 3))
                pairs.append((centres[a], centres[b]))
        else:
            meet(heads, bits)
            if len(centres):
                i, j = np.triu_indices(len(bits), 1)
                meet(centres, bits[i] | bits[j])
                n = len(bits)
                of_centre = {int(rest[c]): c for c in centres}
                three = [np.uint64(int(bits[x]) | int(bits[y]) | int(bits[z])) for x in range(n) for y in range(x + 1, n) for z in range(y + 1, n)]
                if len(centres) * len(centres) <= len(centres) * len(three):
                    for c in centres:
                        d = np.bitwise_count(rest[centres] ^ rest[c])
                        b = centres[d == 3]
                        pairs.append((np.full(len(b), c), b))
                else:
                    for m in three:
                        a = [(c, of_centre[v]) for c in centres.tolist() if (v := int(rest[c] ^ m)) in of_centre]
                        pairs.append(tuple(np.array(x, np.int64) for x in zip(*a, strict=True)) if a else (np.zeros(0, np.int64), np.zeros(0, np.int64)))
    root = _roots(len(members), pairs)
    at = np.flatnonzero(root != np.arange(len(members)))
    return members[at], members[root[at]]


def _links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows sorted by (which, variant, fp): the links of each bucket."""
    held: tuple[np.ndarray, ...] | None = None

    def found(which: np.ndarray, variant: np.ndarray, fp: np.ndarray) -> Iterator[pa.RecordBatch]:
        new = np.flatnonzero((variant[1:] != variant[:-1]) | (which[1:] != which[:-1])) + 1
        starts, ends = np.concatenate(([0], new)), np.concatenate((new, [len(fp)]))
        a, b = [], []
        for s, e in zip(*(x[ends - starts > 1].tolist() for x in (starts, ends)), strict=True):
            members = np.unique(fp[s:e].view(np.uint64))
            if len(members) == 2:  # the usual bucket
                if int(members[0] ^ members[1]).bit_count() <= RADIUS:
                    a.append(members[1:])
                    b.append(members[:1])
            elif len(members) > 2:
                x, y = bucket_links(int(variant[s]) & (1 << 64) - 1, int(which[s]), members)
                a.append(x)
                b.append(y)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in whole_batches(batches):
        rows = tuple(batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        if held is not None:
            rows = tuple(np.concatenate(x) for x in zip(held, rows, strict=True))
        which, variant, fp = rows
        last = np.flatnonzero((variant != variant[-1]) | (which != which[-1]))
        at = int(last[-1]) + 1 if len(last) else 0
        held = tuple(x[at:] for x in rows)
        if at:
            yield from found(which[:at], variant[:at], fp[:at])
    if held is not None:
        yield from found(*held)


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, mark, row, fp, component_id, keeper (the row of the component that stays: mark, row)."""
    prints = fingerprints(docs, doc_id, text)
    # per distinct fingerprint, its least document; null ids come last
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "mark", "row")
    least = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("doc_id"), F.min(order).alias("keeper")))
    balls = variants(least).repartition("which", "variant").sortWithinPartitions("which", "variant")
    root = components(balls.mapInArrow(_links, "a long, b long"))
    rooted = least.join(root, least["fp"] == root["node"], "left").select("fp", F.coalesce("root", "fp").alias("root"), "doc_id", "keeper")
    heads = rooted.groupBy(F.col("root").alias("r")).agg(F.min("doc_id").alias("component_id"), F.min("keeper").alias("keeper"))
    named = cut(rooted.join(heads, F.col("root") == F.col("r")).select(F.col("fp").alias("f"), "component_id", F.struct(heads["keeper"]["mark"].alias("mark"), heads["keeper"]["row"].alias("row")).alias("keeper")))
    return prints.join(named, F.col("fp") == F.col("f"), "left").select("doc_id", "mark", "row", "fp", "component_id", "keeper")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` with just one document of each component, its least id; columns unchanged.

    Of rows that share that id, the one with the least hashes of text and of the whole row stays; of equal rows, one."""
    m, r = (fresh(docs.columns, f"__{x}") for x in ("mark", "row"))
    members, own = cut(near_duplicates(docs, doc_id, text)), [F.col(f"`{c}`") for c in docs.columns]
    keeps = F.struct("mark", "row") == F.col("keeper")
    keepers = cut(members.where(keeps).select(F.col("mark").alias(m), F.col("row").alias(r)).distinct())
    # rows that go, or that are repeated as a whole; all others stay, and their texts needn't be shuffled
    repeated = members.groupBy("mark", "row").agg(F.count("*").alias("n")).where("n > 1")
    doubtful = cut(bitmap_rows(members.where(~keeps).select("row").union(repeated.select("row")), "row", BITMAP))
    marked, bit = with_bit(docs.withColumns({m: F.xxhash64(f"`{text}`"), r: row_mark(docs)}), F.col(r), doubtful, BITMAP)
    # equal rows lie together after the join, so this takes no further shuffle
    chosen = marked.where(F.col(bit)).join(keepers, [r, m], "left_semi").dropDuplicates([r, m])
    return marked.where(~F.col(bit)).select(*own).unionAll(chosen.select(*own))
