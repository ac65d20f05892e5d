"""Operator 9, SimHash near-duplicates by bit-sliced comparison.

Fingerprints are made once a document and stored.  Equal fingerprints are one class, so only distinct ones
are compared.  Their 64 bits are cut into bands; two fingerprints at `radius` or fewer differing bits agree
on all but `radius` bands at least, so every link lies in a bucket of some choice of agreeing bands.  The
number of bands follows the number of fingerprints (all choices are exact; more bands make smaller
buckets).  Within a task the fingerprints of a batch are held as 64 bit planes; all pairs at one lag are compared
at once by carry-save counters over shifted planes, and words of 64 pairs are abandoned once all
exceed the radius.  A bucket above `tile` fingerprints is split into tiles that meet pairwise.  A tile gives a
spanning forest of its links, never its pairs; components come from alternating star steps over stored edges.

`similar` is the same for a similarity of word shingles in place of a radius: fingerprints are wider (two words of 64 bits), the
radius is what pairs of that similarity differ in, plus two standard deviations, and no band of bits could be free of
differences, so buckets are those of texts that agree in two of six minima of hashed shingles, as texts of similarity 0.8 do
with a chance of 0.998.  Buckets are compared bit-sliced as above.

A null or empty text, or one without words, has fingerprint zero and links like any other; shorter texts are
one shingle.  Repeated rows share a fingerprint and stay rows of their own.  component_id is the
smallest id reachable, null ids left out (null only if all are null).  Empty tables give empty results; other
columns are not read.  A very long text is one slice, and takes its task some 100 bytes for each of its words.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import map_texts, record, release, staged, texts
from millrace.llm.words import NONSPACE, Words, mix

SHINGLE, SEED, RADIUS, TILE = 3, 42, 2, 1024
SIMILARITY, MINIMA = 0.8, 6


def fingerprints_of(column: pa.Array, shingle: int = SHINGLE, seed: int = SEED) -> np.ndarray:
    words = Words(column, NONSPACE, hashed=False)
    n_texts, n_words = len(words.first) - 1, words.counts()
    out = np.zeros(n_texts, np.uint64)
    if not len(words):
        return out
    # words joined by one space each: a shingle is one stretch of this
    sizes = words.end - words.start
    to = np.concatenate(([0], np.cumsum(sizes + 1)))
    joined = np.full(to[-1], 0x20, np.uint8)
    inside = np.ones(to[-1], bool)
    inside[to[1:] - 1] = False
    mark = np.zeros(len(words.data) + 1, np.int8)
    np.add.at(mark, words.start, 1)
    np.add.at(mark, words.end, -1)
    joined[inside] = words.data[np.cumsum(mark[:-1], dtype=np.int8).view(bool)]
    data = joined.tobytes()
    span = np.minimum(shingle, n_words)
    n_shingles = np.where(n_words > 0, n_words - span + 1, 0)
    owner = np.repeat(np.arange(n_texts), n_shingles)
    begin = np.concatenate(([0], np.cumsum(n_shingles)))
    first = np.arange(len(owner)) - begin[owner] + words.first[owner]
    last = first + span[owner] - 1
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(data[a:b], seed) for a, b in zip(to[first].tolist(), (to[last + 1] - 1).tolist(), strict=True)), np.uint64, len(first))
    full = np.flatnonzero(n_shingles)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    step = 1 << 15
    votes = np.zeros((n_texts, 64), np.int64)
    for a in range(0, len(h), step):  # bounded: 64 counters a shingle
        part, own = h[a : a + step], owner[a : a + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        heads = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        votes[own[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.int32)
    out[full] = ((votes[full] * 2 > n_shingles[full, None]) * weights).sum(1, dtype=np.uint64)
    return out


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp: the 64 bits as a long.  Id and text_hash find a row again, without its text."""

    def make():
        return lambda part: record(doc_id=part.column("doc_id"), text_hash=part.column("text_hash"), fp=pa.array(fingerprints_of(part.column("text"), shingle, seed).view(np.int64)))

    return map_texts(texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64("text")), make, "doc_id long, text_hash long, fp long")


def _planes(fps: np.ndarray) -> np.ndarray:
    """A row for each bit, 64 fingerprints a word; fps: one row a fingerprint, of one word or more."""
    bits = np.unpackbits(np.ascontiguousarray(fps).view(np.uint8).reshape(len(fps), -1), axis=1, bitorder="little")
    padded = np.zeros((bits.shape[1], -(-len(fps) // 64) * 64), np.uint8)
    padded[:, : len(fps)] = bits.T
    return np.packbits(padded, axis=1, bitorder="little").view(np.uint64)


def _pack(flags: np.ndarray) -> np.ndarray:
    padded = np.zeros(-(-len(flags) // 64) * 64, bool)
    padded[: len(flags)] = flags
    return np.packbits(padded, bitorder="little").view(np.uint64)


def close_pairs(planes: np.ndarray, allowed: np.ndarray, lag: int, radius: int) -> np.ndarray:
    """The i for which i and i + lag differ in at most radius bits, among those allowed."""
    size = planes.shape[1]
    skip, shift = divmod(lag, 64)
    live = np.flatnonzero(allowed)
    over = ~allowed[live]
    width = (radius + 1).bit_length()
    counters = [np.zeros(len(live), np.uint64) for _ in range(width)]
    everything = np.uint64(0xFFFFFFFFFFFFFFFF)
    wide = np.zeros((len(planes), size + skip + 2), np.uint64)
    wide[:, :size] = planes
    for b in range(len(planes)):
        low = wide[b, live + skip]
        other = (low >> np.uint64(shift)) | (wide[b, live + skip + 1] << np.uint64(64 - shift)) if shift else low
        carry = planes[b, live] ^ other
        for k in range(width):  # carry-save: one more difference in every pair that has the bit
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        over |= carry
        if b % 8 == 7:
            more, equal = np.zeros(len(live), np.uint64), np.full(len(live), everything)
            for k in range(width - 1, -1, -1):
                if radius >> k & 1:
                    equal &= counters[k]
                else:
                    more |= equal & counters[k]
                    equal &= ~counters[k]
            over |= more
            keep = over != everything
            if not keep.all():  # abandon words whose pairs all exceed the radius
                live, over, counters = live[keep], over[keep], [c[keep] for c in counters]
                if not len(live):
                    return np.zeros(0, np.int64)
    word, bit = np.nonzero(np.unpackbits((~over).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little"))
    return live[word] * 64 + bit


def forest(fps: np.ndarray, bucket: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Rows sorted by bucket.  For each row the row that stands for its links, the smallest of them."""
    n = len(fps)
    root = np.arange(n)
    begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if n else np.zeros(0, np.int64)
    largest = int(np.diff(np.append(begin, n)).max()) if n else 0
    if largest < 2:
        return root
    planes = _planes(fps)
    for lag in range(1, largest):
        same = bucket[lag:] == bucket[:-lag]
        i = close_pairs(planes, _pack(np.concatenate((same, np.zeros(lag, bool)))), lag, radius)
        if not len(i):
            continue
        j = i + lag
        while True:  # join roots until both ends of every pair agree
            a, b = root[i], root[j]
            if (differ := a != b).any():
                np.minimum.at(root, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
                while (deeper := root[root]).tobytes() != root.tobytes():
                    root = deeper
            else:
                break
    return root


def _linked(batches, radius: int, prints: list[str]):
    """Partitions sorted by bucket: whole buckets, many at a time."""
    left = None

    def links(t: pa.Table) -> pa.RecordBatch | None:
        fps = np.stack([t.column(c).to_numpy().view(np.uint64) for c in prints], 1)
        keys = [t.column(c).to_numpy() for c in ("choice", "key", "tile")]
        new = np.zeros(len(fps), bool)
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        root = forest(fps, np.cumsum(new), radius)
        at = np.flatnonzero(root != np.arange(len(root)))
        if len(at):
            node = t.column("node").to_numpy()
            a, b = node[at], node[root[at]]
            return record(u=pa.array(np.minimum(a, b)), v=pa.array(np.maximum(a, b)))
        return None

    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = pa.concat_tables([left, t]) if left is not None else t
        keys = [t.column(c).to_numpy() for c in ("choice", "key", "tile")]
        last = np.ones(t.num_rows, bool)
        for k in keys:
            last &= k == k[-1]
        cut = int(last.argmax())  # where the last bucket, which may go on, begins
        if cut:
            out = links(t.slice(0, cut).combine_chunks())
            if out is not None:
                yield out
        left = t.slice(cut).combine_chunks()
    if left is not None and left.num_rows > 1:
        out = links(left)
        if out is not None:
            yield out


def bucket_links(rows: DataFrame, radius: int, tile: int, prints: list[str]) -> DataFrame:
    """rows: node, its fingerprint's words `prints`, and the buckets (choice, key) that it is in.  Edges u < v between nodes whose closure
    is that of all links within buckets."""
    sizes = rows.groupBy("choice", "key").count().filter("count > 1")
    # a bucket of one has no pair; one above `tile` is split, and its parts meet pairwise
    rows = rows.join(sizes, ["choice", "key"]).withColumn("k", F.ceil(F.col("count") / tile).cast("int"))
    rows = rows.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("k")).cast("int"))
    rows = rows.select("choice", "key", "node", *(p for p in prints if p != "node"), F.explode(F.when(F.col("k") == 1, F.array(F.lit(0).cast("long"))).otherwise(
        F.transform(F.sequence(F.lit(0), F.col("k") - 1), lambda j: F.least(j, F.col("mine")).cast("long") * F.col("k") + F.greatest(j, F.col("mine"))))).alias("tile"))
    rows = rows.repartition("choice", "key", "tile").sortWithinPartitions("choice", "key", "tile")
    return rows.mapInArrow(lambda batches: _linked(batches, radius, prints), "u long, v long").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, bands: int | None = None) -> DataFrame:
    """Edges u < v between distinct fingerprints (column fp) whose closure is that of all links."""
    if bands is None:
        n, bands = distinct.count(), radius + 1
        while bands < radius + 4 and n >> (64 * (bands - radius) // bands):  # more than one to a bucket
            bands += 1
    cuts = [64 * k // bands for k in range(bands + 1)]
    choices = list(combinations(range(bands), bands - radius))
    keys = [sum(((1 << cuts[b + 1]) - (1 << cuts[b])) for b in c) for c in choices]
    masks = F.array(*(F.lit(k - (1 << 64) if k >> 63 else k).cast("long") for k in keys))
    rows = distinct.select(F.col("fp").alias("node"), F.posexplode(masks).alias("choice", "mask")).select("node", "choice", F.col("node").bitwiseAND(F.col("mask")).alias("key"))
    return bucket_links(rows, radius, tile, ["node"])


def components(edges: DataFrame) -> DataFrame:
    """node, root (the component's smallest node) of every node with an edge, by alternating star steps.

    Each step is stored; the steps end when every edge is a star's and no edge changes."""
    edges = staged(edges, "edges")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
        large = both.join(least, both.u == least.w).filter("v > u").select(F.col("m").alias("u"), "v").filter("u < v").distinct()
        # small star: a node's smaller neighbours and the node itself go to the smallest of them
        down = large.select(F.col("v").alias("u"), F.col("u").alias("v"))
        lowest = down.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), "m")
        small = down.join(lowest, down.u == lowest.w).select(F.col("m").alias("a"), F.explode(F.array("u", "v")).alias("b")).filter("a < b").select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()
        before, edges = edges, staged(small, "edges")
        release(before)
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen or not now[0]:
            return edges.groupBy("v").agg(F.min("u").alias("root")).select(F.col("v").alias("node"), "root").unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())
        seen = now


def named(classes: DataFrame, edges: DataFrame) -> DataFrame:
    """classes: node, least; gives each node's component: its root, and the smallest id in it."""
    roots = components(edges).select(F.col("node").alias("linked"), "root")
    # only linked nodes have a root other than themselves
    linked = classes.join(roots, classes.node == roots.linked).select("linked", "root", "least")
    # in two steps, so that no component meets in one task
    parts = linked.groupBy("root", F.pmod(F.xxhash64("linked"), F.lit(16))).agg(F.min("least").alias("least"))
    names = parts.groupBy("root").agg(F.min("least").alias("name"))
    linked = linked.select("linked", "root").join(names, "root").select("linked", "root", "name")
    out = classes.join(linked, classes.node == linked.linked, "left")
    return staged(out.select("node", F.coalesce("root", "node").alias("root"), F.when(F.col("linked").isNull(), F.col("least")).otherwise(F.col("name")).alias("component_id")), "classes")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, shingle: int = SHINGLE, seed: int = SEED, tile: int = TILE, bands: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, fp, component_id, root (a fingerprint of the component): one row a document."""
    own = staged(fingerprints(docs, shingle, seed, id_col, text_col), "fingerprints")
    classes = own.groupBy(F.col("fp").alias("node")).agg(F.min("doc_id").alias("least"))
    by_fp = named(classes, links(classes.select(F.col("node").alias("fp")), radius, tile, bands))
    return own.join(by_fp, own.fp == by_fp.node).select("doc_id", "text_hash", "fp", "component_id", "root")


def radius_of(similarity: float, bits: int) -> int:
    """Differing bits of texts of this Jaccard similarity: their mean and two standard deviations."""
    p = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return int(bits * p + 2 * math.sqrt(bits * p * (1 - p)))


def sketches_of(column: pa.Array, shingle: int, minima: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of 2 words, and the smallest hashes of the shingles under `minima` orders; of fewer words the whole sequence is the shingle."""
    words = Words(column, NONSPACE)
    n_texts, count = len(words.first) - 1, words.counts()
    fps, least = np.zeros((n_texts, 2), np.uint64), np.zeros((n_texts, minima), np.uint64)
    hashes, owners = [], []
    owner = words.owner()
    for k in range(1, shingle + 1):
        if k == shingle or (count == k).any():
            g, ok = words.grams(k)
            at = np.flatnonzero(ok if k == shingle else ok & (count[owner] == k))
            hashes.append(g[at])
            owners.append(owner[at])
    h, owner = np.concatenate(hashes), np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    h, owner = h[order], owner[order]
    if not len(h):
        return fps, least
    heads = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
    full, size = owner[heads], np.diff(np.append(heads, len(h)))
    for i in range(minima):
        least[full, i] = np.minimum.reduceat(mix(h + np.uint64((2 * i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))), heads)
    weights, step = np.uint64(1) << np.arange(64, dtype=np.uint64), 1 << 15
    for word, value in enumerate((h, mix(h ^ np.uint64(0xD6E8FEB86659FD93)))):
        votes = np.zeros((n_texts, 64), np.int64)
        for a in range(0, len(h), step):  # bounded: 64 counters a shingle
            part, mine = value[a : a + step], owner[a : a + step]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            first = np.flatnonzero(np.concatenate(([True], mine[1:] != mine[:-1])))
            votes[mine[first]] += np.add.reduceat(bits, first, axis=0, dtype=np.int32)
        fps[full, word] = ((votes[full] * 2 > size[:, None]) * weights).sum(1, dtype=np.uint64)
    return fps, least


def similar(docs: DataFrame, similarity: float = SIMILARITY, shingle: int = 5, minima: int = MINIMA, tile: int = TILE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text_hash, component_id, root (a text's hash): one row a document.  Copies of a text are one node, whatever their number."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            fps, least = sketches_of(part.column("text"), shingle, minima)
            own = np.ascontiguousarray(least).view(np.int64)
            return record(doc_id=part.column("doc_id"), text_hash=part.column("text_hash"), f0=pa.array(fps[:, 0].copy().view(np.int64)), f1=pa.array(fps[:, 1].copy().view(np.int64)), **{f"m{i}": pa.array(own[:, i].copy()) for i in range(minima)})

        return work

    columns = ["f0", "f1", *(f"m{i}" for i in range(minima))]
    hashed = texts(docs, id_col, text_col).withColumn("text_hash", F.xxhash64(F.coalesce("text", F.lit(""))))
    own = staged(map_texts(hashed, make, "doc_id long, text_hash long, " + ", ".join(f"{c} long" for c in columns)), "sketches")
    classes = own.groupBy(F.col("text_hash").alias("node")).agg(F.min("doc_id").alias("least"), *(F.min(c).alias(c) for c in columns))
    pairs = list(combinations(range(minima), 2))
    keys = F.array(*(F.xxhash64(f"m{i}", f"m{j}") for i, j in pairs))
    rows = classes.select("node", "f0", "f1", F.posexplode(keys).alias("choice", "key"))
    by_text = named(classes.select("node", "least"), bucket_links(rows, radius_of(similarity, 128), tile, ["f0", "f1"]))
    return own.select("doc_id", "text_hash").join(by_text, F.col("text_hash") == by_text.node).select("doc_id", "text_hash", "component_id", "root")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Whole rows: of each component of `similar` texts the one of the smallest id (nulls last; of repeated rows any one)."""
    found = similar(docs, id_col=id_col, text_col=text_col, **options)
    order = F.struct(F.col("doc_id").isNull().alias("a"), F.col("doc_id").alias("b"), F.col("text_hash").alias("c"))
    kept = found.groupBy("root").agg(F.min(order).alias("k")).select(F.col("k.b").alias("__id"), F.col("k.c").alias("__hash"))
    # the row as one struct: none of its columns can clash
    own = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(f"`{id_col}`").cast("long").alias("id"), F.xxhash64(own).alias("own"))
    rows = rows.join(kept, rows["id"].eqNullSafe(kept["__id"]) & (rows["own"] == kept["__hash"]))
    # rows repeated with id and text: one of them
    rank = Window.partitionBy("__id", "__hash").orderBy(F.xxhash64("row"))
    return rows.withColumn("n", F.row_number().over(rank)).filter("n = 1").select("row.*")
