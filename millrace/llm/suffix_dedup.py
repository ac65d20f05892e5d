"""Operator 5, removal of repeated byte strings by a sparse suffix array with bucket-pointer refinement.

Every string of `length` bytes holds the smallest hash among its `gram`-byte grams; suffixes that begin at
such a gram (anchors) are enough to find every repeated string, since equal strings hold equal anchors at
equal places.  The steps:

1. texts are stored once in compressed units of about UNIT bytes;
2. each unit's distinct anchor hashes meet in hash buckets; those in two units or more go back to their units, with a level by the
   number of units that hold them.  Above `hash_units` units they are counted in groups of units first;
3. units cut out the bytes around such anchors (what any string of `length` bytes over the anchor can reach).
   Of equal surroundings within a unit only those of the smallest document go on: the others are
   removed already.  So a hot passage sends one row a unit, however many documents hold it; above `group_units` units
   the same is done over groups of units, level by level, before a bucket meets its rows.  An anchor in more than `frequent[0]`
   units does not go to one bucket: the strings over it are split by how far they reach to its right, into 3 stretches, and in more than
   `frequent[1]` units into one for each string.  What all strings of a stretch share is longer than the anchor, so
   different surroundings go to different buckets, and those equal within a stretch are combined as above;
4. in a bucket, the suffixes that begin at anchors are sorted to `length` bytes by bucket-pointer refinement.  The q-grams at an
   offset give the initial buckets of the suffixes that begin there; beginning with the last offsets, each bucket is refined by
   sorting on the bucket pointers of the suffixes `q` further on, which are refined already, and the new
   pointers serve the suffixes before them in turn.  So each offset costs one sort, however deep its suffixes
   are told apart.  The same over reversed bytes sorts what stands before an anchor.  Neighbours' common
   lengths give classes of equal strings at every depth, and each class's smallest document;
5. removed stretches go back to their units, which write the kept bytes.

Hashes only propose; equality is decided on bytes.  Nulls and empty texts keep nothing and lose nothing; a
null doc_id is larger than every other; rows with equal doc_id never remove from each other; empty tables
give empty results; other columns are not read.  A very long text is a unit of its own and takes its task some 100 times
its bytes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import large_text, record, slices, staged, texts
from millrace.llm.words import byte_values, prefix_hash, sliding, span_hash

LENGTH, GRAM = 50, 24
UNIT = 2 << 20
#: Bytes of text for one bucket of hashes and for one of surroundings, and the fewest buckets; units that meet in one step.
HASH_BYTES, BUCKET_BYTES, LEAST_BUCKETS, GROUP_UNITS = 32 << 20, 4 << 20, 64, 4096
#: Units whose hashes meet in one step; units that hold an anchor, above which its strings are split by stretches, and each for itself.
HASH_UNITS, FREQUENT = 1 << 16, (1 << 12, 1 << 16)
#: Bytes of the grams that give initial buckets.
Q = 8
_NONE = np.iinfo(np.int64).max
_MASK = np.uint64((1 << 40) - 1)


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(np.ascontiguousarray(a).tobytes())


def _unzip(data: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


def units(docs: DataFrame, unit_bytes: int = UNIT) -> DataFrame:
    """unit, size, ids, sizes, data: many texts in one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", unit_bytes):
                column = large_text(part.column("text"))
                off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
                raw = np.frombuffer(column.buffers()[2] or b"", np.uint8)[off[0] : off[-1]]
                yield record(unit=pa.array([n], pa.int64()), size=pa.array([len(raw)], pa.int64()), ids=pa.array([part.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                             sizes=pa.array([np.diff(off).tolist()], pa.list_(pa.int64())), data=pa.array([_zip(raw)], pa.binary()))
                n += 1

    return docs.mapInArrow(run, "unit long, size long, ids array<long>, sizes array<long>, data binary")


class Unit:
    def __init__(self, row: dict, length: int, gram: int):
        self.raw = _unzip(row["data"], np.uint8)
        self.ids = row["ids"]
        self.doc = np.array([_NONE if i is None else i for i in self.ids], np.int64)
        self.bounds = np.concatenate(([0], np.cumsum(np.array(row["sizes"], np.int64)))).astype(np.int64)
        self.length, self.gram = length, gram

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """Places and hashes.  Grams over a text's end are dropped afterwards; they only add anchors before it."""
        q, w = self.gram, self.length - self.gram + 1
        n = len(self.raw) - q + 1
        if n < 1:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        prefix = prefix_hash(byte_values(self.raw))
        at = np.arange(n)
        g = span_hash(prefix, at, at + q)
        own = g
        inner = self.bounds[1:-1]
        if len(inner):  # grams that reach into the next text never are the smallest
            over = (inner[:, None] - np.arange(1, q)).ravel()
            over = over[(over >= 0) & (over < n)]
            own = g.copy()
            own[over] = np.uint64(0xFFFFFFFFFFFFFFFF)
        if n >= w:
            least = sliding(own, w, np.minimum)
            reach = np.zeros(n + w - 1, np.uint64)
            reach[w - 1 : w - 1 + len(least)] = least
            keep = own <= sliding(reach, w, np.maximum)[:n]
            if len(inner):
                keep[over] = False
            at = np.flatnonzero(keep)
        elif len(inner):
            at = np.setdiff1d(at, over)
        return at, g[at]


def split_hash(h: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """The bucket and 40 further bits."""
    return (h % np.uint64(buckets)).astype(np.int64), (h >> np.uint64(20)) & _MASK


def _five(h: np.ndarray) -> np.ndarray:
    return h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T


def _eight(data: bytes) -> np.ndarray:
    five = _unzip(data, np.uint8).reshape(5, -1)
    out = np.zeros((five.shape[1], 8), np.uint8)
    out[:, :5] = five.T
    return out.view("<u8").ravel()


def _by_bucket(bucket: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(bucket, kind="stable")
    cuts = np.flatnonzero(np.diff(bucket[order])) + 1
    for at in np.split(order, cuts):
        if len(at):
            yield int(bucket[at[0]]), at


def _send_hashes(batches, buckets: int, length: int, gram: int):
    for batch in batches:
        for row in batch.to_pylist():
            _, h = Unit(row, length, gram).anchors()
            bucket, key = split_hash(np.unique(h), buckets)
            names, blobs = [], []
            for b, at in _by_bucket(bucket):
                names.append(b)
                blobs.append(_zip(_five(np.unique(key[at]))))
            yield record(bucket=pa.array(names, pa.int64()), unit=pa.array([row["unit"]] * len(names), pa.int64()), keys=pa.array(blobs, pa.binary()))


def _by_level(k: np.ndarray, every: np.ndarray, level: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """Those of the keys k that are among `every` (in order), for each level of theirs; below level 0 none."""
    if len(every):
        at = np.minimum(np.searchsorted(every, k), len(every) - 1)
        own = np.where(every[at] == k, level[at], -1)
        for x in np.unique(own[own >= 0]).tolist():
            yield x, _zip(_five(k[own == x]))


def _level(units: np.ndarray, frequent: tuple[int, int]) -> np.ndarray:
    return np.where(units > 1, (units[:, None] > np.array(frequent)).sum(1), -1)


_ANSWER = pa.schema([("unit", pa.int64()), ("bucket", pa.int64()), ("level", pa.int32()), ("keys", pa.binary())])


def _answered(t: pa.Table, keys: list[np.ndarray], every: np.ndarray, level: np.ndarray) -> pa.Table:
    rows = [(u, b, x, data) for u, b, k in zip(t.column("unit").to_pylist(), t.column("bucket").to_pylist(), keys, strict=True) for x, data in _by_level(k, every, level)]
    return pa.table([pa.array(list(c), f.type) for c, f in zip(zip(*rows, strict=True) if rows else ([],) * 4, _ANSWER, strict=True)], schema=_ANSWER)


def _shared(t: pa.Table, frequent: tuple[int, int]) -> pa.Table:
    """Of one bucket: the keys that two units or more have, for each unit that has them."""
    keys = [_eight(x) for x in t.column("keys").to_pylist()]
    every, units = np.unique(np.concatenate(keys), return_counts=True)
    return _answered(t, keys, every, _level(units, frequent))


def _counted(t: pa.Table) -> pa.Table:
    """Of one bucket and a group of units: its keys, and in how many of the units each is."""
    every, units = np.unique(np.concatenate([_eight(x) for x in t.column("keys").to_pylist()]), return_counts=True)
    return pa.table({"bucket": t.column("bucket")[:1], "group": t.column("group")[:1], "keys": pa.array([_zip(_five(every))], pa.binary()), "units": pa.array([_zip(units.astype("<i8"))], pa.binary())})


def _common(t: pa.Table, frequent: tuple[int, int]) -> pa.Table:
    """Of one bucket and all groups: the keys that two units or more have, for each group that has them."""
    keys = [_eight(x) for x in t.column("keys").to_pylist()]
    every, at = np.unique(np.concatenate(keys), return_inverse=True)
    units = np.zeros(len(every), np.int64)
    np.add.at(units, at, np.concatenate([_unzip(x, "<i8") for x in t.column("units").to_pylist()]))
    level = _level(units, frequent)
    rows = [(g, x, data) for g, k in zip(t.column("group").to_pylist(), keys, strict=True) for x, data in _by_level(k, every, level)]
    return pa.table({"bucket": pa.array([t.column("bucket")[0].as_py()] * len(rows), pa.int64()), "group": pa.array([g for g, _, _ in rows], pa.int64()), "level": pa.array([x for _, x, _ in rows], pa.int32()), "keys": pa.array([d for _, _, d in rows], pa.binary())})


def _handed_on(t: pa.Table, common: pa.Table) -> pa.Table:
    """Of one bucket and a group of units: what `_common` found, for each unit."""
    found = [_eight(x) for x in common.column("keys").to_pylist()]
    every = np.concatenate(found) if found else np.zeros(0, np.uint64)
    level = np.repeat(np.array(common.column("level").to_pylist(), np.int64), [len(x) for x in found])
    order = np.argsort(every)
    return _answered(t, [_eight(x) for x in t.column("keys").to_pylist()], every[order], level[order])


def shared_keys(hashes: DataFrame, n_units: int, hash_units: int, frequent: tuple[int, int]) -> DataFrame:
    """hashes: bucket, unit, keys.  unit, bucket, level, keys: those in two units or more.  No task meets more than `hash_units` units or groups of them."""
    schema = "unit long, bucket long, level int, keys binary"
    if n_units <= hash_units:
        return hashes.groupBy("bucket").applyInArrow(lambda t: _shared(t, frequent), schema)
    hashes = staged(hashes.withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(-(-n_units // hash_units)))), "hashes")
    counted = hashes.groupBy("bucket", "group").applyInArrow(_counted, "bucket long, group long, keys binary, units binary")
    common = counted.groupBy("bucket").applyInArrow(lambda t: _common(t, frequent), "bucket long, group long, level int, keys binary")
    return hashes.groupBy("bucket", "group").cogroup(common.groupBy("bucket", "group")).applyInArrow(_handed_on, schema)


def _packed(start: np.ndarray, end: np.ndarray) -> bytes:
    return _zip(np.concatenate((start, end)).astype("<i8"))


def _merged(start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open stretches."""
    if not len(start):
        return start, end
    order = np.argsort(start, kind="stable")
    start, end = start[order], np.maximum.accumulate(end[order])
    head = np.concatenate(([True], start[1:] > end[:-1]))
    return start[head], end[np.append(np.flatnonzero(head)[1:] - 1, len(end) - 1)]


def stretches(side: int, level: int) -> list[tuple[int, int]]:
    """How far strings reach to the right of an anchor, from and to, by level: all as one, in 3, each for itself."""
    return [(int(p[0]), int(p[-1])) for p in np.array_split(np.arange(side + 1), min((1, 3, side + 1)[level], side + 1))]


def _aside(unit: int, buckets: int) -> int:
    """The bucket where what is removed already passes through; not that of its bytes, where a hot passage would bring all units' rows."""
    return (unit * 0x9E3779B97F4A7C15 % (1 << 64) >> 20) % buckets


def _send_surroundings(batches, hash_buckets: int, buckets: int, length: int, gram: int):
    side = length - gram
    for batch in batches:
        for row in batch.to_pylist():
            unit = Unit(row, length, gram)
            at, h = unit.anchors()
            bucket, key = split_hash(h, hash_buckets)
            order = np.lexsort((key, bucket))
            at, bucket, key, h = at[order], bucket[order], key[order], h[order]
            doc = np.searchsorted(unit.bounds, at, "right") - 1
            wanted, level = np.zeros(len(at), bool), np.zeros(len(at), np.int8)
            cut = np.searchsorted(bucket, np.arange(hash_buckets + 1))
            for x in row["lists"] or ():
                a, b = cut[x["bucket"]], cut[x["bucket"] + 1]
                own = a + np.flatnonzero(np.isin(key[a:b], _eight(x["keys"])))
                wanted[own], level[own] = True, x["level"]
            again = (key[1:] == key[:-1]) & (bucket[1:] == bucket[:-1])
            first = np.flatnonzero(np.concatenate(([True], ~again))) if len(at) else np.zeros(0, np.int64)
            if len(at):
                number = np.concatenate(([0], np.cumsum(~again)))
                low, high = np.minimum.reduceat(unit.doc[doc], first), np.maximum.reduceat(unit.doc[doc], first)
                wanted |= (low != high)[number]
            pick = np.flatnonzero(wanted)
            at, doc, h, level = at[pick], doc[pick], h[pick], level[pick]
            # what a string over the anchor can reach within its text
            left, right = np.minimum(at - unit.bounds[doc], side), np.minimum(unit.bounds[doc + 1] - at - gram, side)
            prefix = prefix_hash(byte_values(unit.raw)) if level.any() else None
            for x in np.unique(level).tolist():
                for a, b in stretches(side, x):
                    rows = np.flatnonzero((level == x) & (left >= side - b) & (right >= a))
                    if len(rows):
                        # by what all strings of the stretch share
                        same = span_hash(prefix, at[rows] - (side - b), at[rows] + gram + a) if x else h[rows]
                        sent = _sent(unit, row["unit"], at[rows], doc[rows], np.minimum(left[rows], side - a), np.minimum(right[rows], b), (same % np.uint64(buckets)).astype(np.int64), buckets)
                        if sent.num_rows:
                            yield sent


def _sent(unit: Unit, name: int, at: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, bucket: np.ndarray, buckets: int) -> pa.RecordBatch:
    """A row for each bucket: the surroundings of its anchors, beyond left and right zeros that are never looked at; and a row for what is removed already."""
    length, gram = unit.length, unit.gram
    side = length - gram
    place = at[:, None] + np.arange(-side, gram + side)
    inside = (place >= (at - left)[:, None]) & (place < (at + gram + right)[:, None])
    around = np.where(inside, unit.raw[np.clip(place, 0, len(unit.raw) - 1)], 0).astype(np.uint8)
    later = repeated_alike(alike(around, left, right, length, gram), unit.doc[doc])
    some = later & (left + right + gram >= length)
    removed_a, removed_b = _merged(at[some] - left[some], (at + gram + right)[some])
    keep = ~later
    at, bucket, doc, around, left, right = (x[keep] for x in (at, bucket, doc, around, left, right))
    out: dict[str, list] = {"bucket": [], "n": [], "meta": [], "around": []}
    for b, rows in _by_bucket(bucket):
        rows = rows[np.argsort(at[rows])]
        out["bucket"].append(b)
        out["n"].append(len(rows))
        out["meta"].append(_zip(np.concatenate((at[rows], unit.doc[doc[rows]], left[rows], right[rows])).astype("<i8")))
        out["around"].append(_zip(around[rows]))
    if len(removed_a):  # these pass through to the end
        out["bucket"].append(_aside(name, buckets))
        out["n"].append(0)
        out["meta"].append(_packed(removed_a, removed_b))
        out["around"].append(b"")
    return record(bucket=pa.array(out["bucket"], pa.int64()), unit=pa.array([name] * len(out["bucket"]), pa.int64()), n=pa.array(out["n"], pa.int64()), meta=pa.array(out["meta"], pa.binary()), around=pa.array(out["around"], pa.binary()))


def refine(buckets: np.ndarray, later: np.ndarray) -> np.ndarray:
    """Buckets sorted anew within themselves on the pointers `later` of the suffixes further on."""
    order = np.lexsort((later, buckets))
    a, b = buckets[order], later[order]
    out = np.empty(len(buckets), np.int64)
    out[order] = np.concatenate(([0], np.cumsum((a[1:] != a[:-1]) | (b[1:] != b[:-1])))) if len(order) else 0
    return out


def gram_buckets(grams: np.ndarray) -> np.ndarray:
    """Initial buckets: numbers, in order, of q-grams of up to 8 bytes."""
    padded = np.zeros((len(grams), 8), np.uint8)
    padded[:, : grams.shape[1]] = grams
    return np.unique(padded.view(">u8").ravel(), return_inverse=True)[1].astype(np.int64)


def bucket_pointers(strings: np.ndarray, q: int = Q) -> np.ndarray:
    """For strings of equal size, one a row: the pointer of each's bucket once sorted to its full size; equal strings share it."""
    starts = range(0, strings.shape[1], q)
    pointer = gram_buckets(strings[:, starts[-1] :])
    for o in reversed(starts[:-1]):  # the suffixes at o + q are refined to the end: theirs are the pointers to sort on
        pointer = refine(gram_buckets(strings[:, o : o + q]), pointer)
    return pointer


def suffix_classes(strings: np.ndarray, least: int) -> np.ndarray:
    """Classes of strings that agree in their first `least` bytes, in one more, and so on to all; n x (sizes)."""
    n, size = strings.shape
    order = np.argsort(bucket_pointers(strings), kind="stable")
    s = strings[order]
    differ = s[1:] != s[:-1]
    common = np.where(differ.any(1), differ.argmax(1), size)
    out = np.zeros((n, size - least + 1), np.int64)
    for d in range(least, size + 1):
        out[order[1:], d - least] = np.cumsum(common < d)
    return out


def alike(around: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> np.ndarray:
    """Numbers of equal surroundings: what an anchor's suffix and what stands before it, each as far as it reaches, are equal."""
    side = length - gram
    ahead = refine(bucket_pointers(around[:, side:]), right)
    return refine(ahead, refine(bucket_pointers(around[:, :side][:, ::-1]), left)) if side else ahead


def repeated_alike(same: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Rows of whose surroundings a smaller document has equal ones."""
    lowest = np.full(int(same.max(initial=-1)) + 1, _NONE, np.int64)
    np.minimum.at(lowest, same, doc)
    return doc > lowest[same]


def repeated(around: np.ndarray, doc: np.ndarray, left: np.ndarray, right: np.ndarray, length: int, gram: int) -> np.ndarray:
    """n x (side + 1): does the string that begins `side - j` bytes before the anchor also begin in a smaller document?"""
    side = length - gram
    n = len(doc)
    to_right = suffix_classes(around[:, side:], gram)
    to_left = suffix_classes(around[:, : side + gram][:, ::-1], gram)
    out = np.zeros((n, side + 1), bool)
    for j in range(side + 1):  # the string takes side - j bytes before the anchor and j after it
        ok = np.flatnonzero((left >= side - j) & (right >= j))
        if len(ok) < 2:
            continue
        key = to_right[ok, j] * (n + 1) + to_left[ok, side - j]
        order = np.argsort(key, kind="stable")
        head = np.flatnonzero(np.concatenate(([True], np.diff(key[order]) != 0)))
        low = np.minimum.reduceat(doc[ok][order], head)
        out[ok[order], j] = doc[ok][order] > np.repeat(low, np.diff(np.append(head, len(ok))))
    return out


def _opened(t: pa.Table, length: int, gram: int):
    """A bucket's rows: which pass through, which hold surroundings, and these as arrays with each one's row."""
    n, meta, data = (t.column(c).to_pylist() for c in ("n", "meta", "around"))
    passing, full = ([i for i, k in enumerate(n) if bool(k) == own] for own in (False, True))
    parts = [_unzip(meta[i], "<i8").reshape(4, -1) for i in full]
    around = [_unzip(data[i], np.uint8).reshape(-1, 2 * length - gram) for i in full]
    at, doc, left, right = np.concatenate(parts, 1) if full else np.zeros((4, 0), np.int64)
    return passing, full, (at, doc, left, right, np.concatenate(around) if full else None, np.repeat(np.arange(len(full)), [n[i] for i in full]))


def _combine(t: pa.Table, length: int, gram: int, width: int, buckets: int) -> pa.Table:
    """Of a bucket and some units: of equal surroundings those of the smallest document go on, as within a unit."""
    passing, full, (at, doc, left, right, around, where) = _opened(t, length, gram)
    rows = {c: t.column(c).take(pa.array(passing, pa.int64())).to_pylist() for c in t.schema.names}
    if full:
        later = repeated_alike(alike(around, left, right, length, gram), doc)
        some = later & (left + right + gram >= length)
        cut = np.searchsorted(where, np.arange(len(full) + 1))
        for k, i in enumerate(full):
            here = np.arange(cut[k], cut[k + 1])
            row = {c: t.column(c)[i].as_py() for c in t.schema.names}
            if len(keep := here[~later[here]]):
                new = {"n": len(keep), "meta": _zip(np.concatenate((at[keep], doc[keep], left[keep], right[keep])).astype("<i8")), "around": _zip(around[keep])}
                for c in rows:
                    rows[c].append(new.get(c, row[c]))
            if len(drop := here[some[here]]):
                new = {"bucket": _aside(row["unit"], buckets), "n": 0, "meta": _packed(*_merged(at[drop] - left[drop], (at + gram + right)[drop])), "around": b""}
                for c in rows:
                    rows[c].append(new.get(c, row[c]))
    rows["group"] = [g // width for g in rows["group"]]
    return pa.table({f.name: pa.array(rows[f.name], f.type) for f in t.schema})


def _resolve(t: pa.Table, length: int, gram: int) -> pa.Table:
    side = length - gram
    passing, full, (at, doc, left, right, around, where) = _opened(t, length, gram)
    unit, meta = t.column("unit").to_pylist(), t.column("meta").to_pylist()
    out_unit, blobs = [unit[i] for i in passing], [meta[i] for i in passing]
    if full:
        row, j = np.nonzero(repeated(around, doc, left, right, length, gram))
        begin = at[row] - side + j
        cut = np.searchsorted(where[row], np.arange(len(full) + 1))
        for k, i in enumerate(full):
            if cut[k + 1] > cut[k]:
                a = begin[cut[k] : cut[k + 1]]
                out_unit.append(unit[i])
                blobs.append(_packed(*_merged(a, a + length)))
    return pa.table({"unit": pa.array(out_unit, pa.int64()), "gone": pa.array(blobs, pa.binary())})


def _finish(batches, length: int, gram: int):
    for batch in batches:
        for row in batch.to_pylist():
            unit = Unit(row, length, gram)
            parts = [_unzip(x, "<i8").reshape(2, -1) for x in row["lists"] or ()]
            gone = np.zeros(len(unit.raw) + 1, np.int32)
            for a, b in parts:
                np.add.at(gone, a, 1)
                np.add.at(gone, b, -1)
            keep = np.cumsum(gone[:-1]) == 0
            ids, size, cut, runs, digest, spans = [], [], [], [], [], []
            for i, (a, b) in enumerate(zip(unit.bounds[:-1].tolist(), unit.bounds[1:].tolist(), strict=True)):
                k = keep[a:b]
                edge = np.flatnonzero(np.diff(np.concatenate(([0], (~k).view(np.int8), [0]))))
                ids.append(unit.ids[i]), size.append(b - a), cut.append(int(b - a - k.sum())), runs.append(len(edge) // 2)
                spans.append(edge.reshape(-1, 2).tolist())
                digest.append(hashlib.sha256(unit.raw[a:b][k].tobytes()).hexdigest())
            yield record(doc_id=pa.array(ids, pa.int64()), n_bytes=pa.array(size, pa.int64()), n_removed=pa.array(cut, pa.int64()), n_spans=pa.array(runs, pa.int64()), kept_sha256=pa.array(digest, pa.string()), removed=pa.array(spans, pa.list_(pa.list_(pa.int64()))))


def remove_repeats(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text", unit_bytes: int = UNIT, group_units: int = GROUP_UNITS, hash_units: int = HASH_UNITS, frequent: tuple[int, int] = FREQUENT) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and removed: the [start, end) byte stretches."""
    if not 8 <= gram <= length or length - gram > 250:
        raise ValueError("8 <= gram <= length <= gram + 250")
    stored = staged(units(texts(docs, id_col, text_col), unit_bytes), "units")
    size = stored.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    hash_buckets, buckets = max(LEAST_BUCKETS, int(size.b) // HASH_BYTES), max(LEAST_BUCKETS, int(size.b) // BUCKET_BYTES)
    # partitions follow the data, so that no task's share grows with it
    most = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    by_unit = lambda df: df.repartition(max(most, size.n // 4), "unit")
    rows = by_unit(stored.select("unit", "data", "ids", "sizes"))
    hashes = stored.select("unit", "data", "ids", "sizes").mapInArrow(lambda b: _send_hashes(b, hash_buckets, length, gram), "bucket long, unit long, keys binary")
    lists = by_unit(shared_keys(hashes, size.n, hash_units, frequent)).groupBy("unit").agg(F.collect_list(F.struct("bucket", "level", "keys")).alias("lists"))
    around = rows.join(lists, "unit", "left").mapInArrow(lambda b: _send_surroundings(b, hash_buckets, buckets, length, gram), "bucket long, unit long, n long, meta binary, around binary")
    groups = -(-size.n // group_units)
    if groups > 1:
        around = around.withColumn("group", F.pmod(F.xxhash64("unit"), F.lit(groups)))
        while groups > 1:
            around = around.groupBy("bucket", "group").applyInArrow(lambda t: _combine(t, length, gram, group_units, buckets), around.schema)
            groups = -(-groups // group_units)
    around = around.repartition(max(most, buckets // 2), "bucket")
    gone = around.groupBy("bucket").applyInArrow(lambda t: _resolve(t, length, gram), "unit long, gone binary")
    gone = by_unit(gone).groupBy("unit").agg(F.collect_list("gone").alias("lists"))
    return rows.join(gone, "unit", "left").mapInArrow(lambda b: _finish(b, length, gram), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<array<long>>")
