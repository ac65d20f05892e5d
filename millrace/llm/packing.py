"""Operator 2, best-fit packing by exact-complement hashing.

Texts are tokenized once, cut into pieces of at most `capacity` tokens, and only the counts of piece
lengths (at most `capacity` numbers) reach the driver.  There a plan is made on counts: lengths, and the sums of pairs
and of triples of lengths, are indexed by value; the largest length left opens sequences, whose gap is looked up in
the index of singles, then of pairs, then of triples, and the combination found is consumed as often as the counts allow;
what finds no exact fill is placed best-fit, largest first, with as many exact sequences opened again as
that needs.  Every step uses up a length or a kind of gap, so the plan stays proportional to `capacity`
squared whatever the input.  Pieces then take their places by their rank among pieces of their length,
counted in salted buckets so that no length meets in one task.

Null and empty texts are the closing token alone; repeated rows are packed each for itself; pieces of equal length are
ranked by id, place and checksum; a null id stays null; an empty table gives an empty result; other columns are not read.
A very long text is one slice: its task holds it and its ids (some ten times its bytes) and cuts it into as many pieces as it takes.
"""

from __future__ import annotations

import json
import os
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import large_text, map_texts, record, staged, texts

CAPACITY = 2048
#: The pre-tokenizer pattern of byte-level BPE.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters whose classes no Unicode version disputes; other texts go whole through the library.
_PLAIN = re.compile("[\t\n\f\r -~¡-ɏ‐-‧]*")
_LITTLE = sys.byteorder == "little" and array("I").itemsize == 4


def _byte_letters() -> dict[str, int]:
    """The letters that byte-level vocabularies write bytes with: printable ones as they are, the others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteEncoder:
    """Ids of a byte-level BPE file as little-endian bytes.

    The file's library is the measure.  Where its merges rank by their ids (checked when the file is opened), its vocabulary is
    run by the faster of the two installed implementations, which takes ids for ranks; texts with special strings or with
    characters on whose class Unicode versions differ go whole through the library itself."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.fast = self._ranked(path)

    def _ranked(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec.get("pre_tokenizer") or {}
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        letters = _byte_letters()
        ids = [model["vocab"].get(x + y, -1) for x, y in pairs]
        if model.get("type") != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer") or ids != sorted(set(ids)) or ids[:1] == [-1] or model.get("dropout") or model.get("ignore_merges"):
            return None
        ranks = {bytes(letters[c] for c in t): i for t, i in model["vocab"].items() if t not in self.special}
        return tiktoken.Encoding("ranked", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, text: str) -> bytes:
        if self.fast is None or not _PLAIN.fullmatch(text) or any(s in text for s in self.special):
            ids = self.library.encode(text, add_special_tokens=False).ids
        else:
            ids = self.fast.encode_ordinary(text)
        return array("I", ids).tobytes() if _LITTLE else np.array(ids, "<u4").tobytes()


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): a longer text's first piece takes what is over."""

    def make():
        encoder, end = ByteEncoder(tokenizer_path), np.array([closing], "<u4").tobytes()

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            doc, piece, start, length, crc, ids = [], [], [], [], [], []
            for i, text in enumerate(large_text(part.column("text")).to_pylist()):
                data = encoder.encode(text) + end
                n = len(data) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                    doc.append(i), piece.append(k), start.append(a), length.append(b - a)
                    crc.append(zlib.crc32(own := data[4 * a : 4 * b]))
                    if with_ids:
                        ids.append(np.frombuffer(own, "<u4").astype(np.int32))
            out = dict(doc_id=part.column("doc_id").take(pa.array(doc, pa.int64())), piece=pa.array(piece, pa.int32()), start=pa.array(start, pa.int64()), length=pa.array(length, pa.int64()), ids_crc32=pa.array(crc, pa.int64()))
            return record(**out, **({"ids": pa.array(ids, pa.list_(pa.int32()))} if with_ids else {}))

        return work

    return map_texts(texts(docs, id_col, text_col), make, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


class Complements:
    """Hash maps from a gap to what fills it exactly: a single length, a pair or a triple, under the counts at hand.

    Pairs are indexed by their sum, larger length first; triples by theirs, as a length and the sum of a pair, which the
    map of pairs then gives.  Counts only fall, so an entry that fails once fails for good and each map's cursors only move forward:
    all look-ups together cost no more than the entries, at most capacity squared of them."""

    def __init__(self, counts: np.ndarray):
        self.counts = counts.tolist()
        top = len(counts) - 1
        have = np.flatnonzero(counts)
        larger, smaller = (x.ravel() for x in np.meshgrid(have, have, indexing="ij"))
        ok = (larger >= smaller) & (larger + smaller < top)
        larger, total = larger[ok], (larger + smaller)[ok]
        self.pairs, self.pair_at, self.pair_end = self._by_sum(total, larger, top)
        sums = np.unique(total)
        first, rest = (x.ravel() for x in np.meshgrid(have, sums, indexing="ij"))
        ok = first + rest < top
        self.triples, self.triple_at, self.triple_end = self._by_sum((first + rest)[ok], first[ok], top)

    @staticmethod
    def _by_sum(total: np.ndarray, first: np.ndarray, top: int) -> tuple[np.ndarray, list[int], list[int]]:
        order = np.lexsort((-first, total))
        cut = np.searchsorted(total[order], np.arange(top + 1)).tolist()
        return first[order].astype(np.int32), cut[:-1], cut[1:]

    def _pair(self, gap: int) -> tuple[int, int] | None:
        counts, at, end = self.counts, self.pair_at, self.pair_end[gap]
        while at[gap] < end:
            a = int(self.pairs[at[gap]])
            b = gap - a
            if counts[b] > (a == b) and counts[a]:
                return a, b
            at[gap] += 1
        return None

    def _pair_beside(self, gap: int, taken: int) -> tuple[int, int] | None:
        """A pair once a piece of length `taken` has gone: no cursor moves, as the piece may come back."""
        counts, k, end = self.counts, self.pair_at[gap], self.pair_end[gap]
        while k < end:
            a = int(self.pairs[k])
            b = gap - a
            if counts[a] > (a == taken) + (a == b) and counts[b] > (b == taken):
                return a, b
            if taken not in (a, b) and k == self.pair_at[gap]:
                self.pair_at[gap] += 1
            k += 1
        return None

    def fill(self, gap: int) -> tuple[int, ...] | None:
        if gap <= 0:
            return None
        if self.counts[gap]:
            return (gap,)
        if two := self._pair(gap):
            return two
        at, end = self.triple_at, self.triple_end[gap]
        while at[gap] < end:
            a = int(self.triples[at[gap]])
            if self.counts[a] and (two := self._pair_beside(gap - a, a)):
                return (a, *two)
            at[gap] += 1
        return None


Kinds = list[tuple[tuple[int, ...], int]]


def plan(lengths: dict[int, int], capacity: int = CAPACITY) -> Kinds:
    """Kinds of sequences, as the lengths in them, and how many of each; counts in, counts out.

    Lengths are opened largest first and their gaps filled exactly from the maps; what finds no exact fill is placed best-fit, and
    where that leaves more sequences than the tokens need, `repair` opens some of the exact ones again."""
    counts = np.zeros(capacity + 1, np.int64)
    for n, k in lengths.items():
        counts[n] = k
    maps, done, rest = Complements(counts), [], {}
    left = maps.counts
    for n in range(capacity, 0, -1):
        while left[n]:
            left[n] -= 1  # the opener itself; it goes now, with a fill or without
            found = () if n == capacity else maps.fill(capacity - n)
            left[n] += 1
            if found is None:
                rest[n], left[n] = left[n], 0
                break
            kind = (n, *found)
            times = min(left[x] // kind.count(x) for x in set(kind))
            for x in kind:
                left[x] -= times
            done.append((kind, times))
    return repair(done, best_fit(rest, capacity), capacity)


def best_fit(lengths: dict[int, int], capacity: int) -> Kinds:
    """Best fit, largest first, on counts: sequences by gap, sorted; each step uses up a length or a kind of sequence."""
    bins: dict[int, Kinds] = defaultdict(list)
    gaps: list[int] = []

    def put(kind: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(kind)
        if not bins[gap]:
            insort(gaps, gap)
        bins[gap].append((kind, times))

    for n in sorted(lengths, reverse=True):
        left = lengths[n]
        while left:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                per = min(capacity // n, left)
                put((n,) * per, left // per)
                left -= left // per * per
                continue
            gap = gaps[at]
            kind, times = bins[gap].pop()
            if not bins[gap]:
                gaps.pop(at)
            use = min(left, times)
            if times > use:
                put(kind, times - use)
            put((*kind, n), use)
            left -= use
    return [x for kinds in bins.values() for x in kinds]


def repair(exact: Kinds, loose: Kinds, capacity: int) -> Kinds:
    """Fewer sequences where exact fills have used up small lengths that the loose sequences lack.

    The loose ones and a few exact ones, those of most lengths first, are taken apart and placed best-fit together; twice as many
    exact ones each time, until the sequences are as few as the tokens allow or nothing is left to open.  The plan of fewest
    sequences stays, of equals the one that opened fewest."""
    total = lambda kinds: sum(k for _, k in kinds)
    fewest = -(-sum(sum(kind) * k for kind, k in [*exact, *loose]) // capacity)
    best, most = [*exact, *loose], total(exact)
    exact = sorted(exact, key=lambda x: (-len(x[0]), x[0]))
    opened = 4
    while total(best) > fewest and opened < 2 * most:
        lengths: dict[int, int] = defaultdict(int)
        kept, room = [], min(opened, most)
        for kind, k in exact:
            take = min(k, room)
            room -= take
            for n in kind if take else ():
                lengths[n] += take
            if k > take:
                kept.append((kind, k - take))
        for kind, k in loose:
            for n in kind:
                lengths[n] += k
        if total(found := [*kept, *best_fit(lengths, capacity)]) < total(best):
            best = found
        opened *= 2
    return best


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to pieces (doc_id, piece, start, length, ids_crc32), which must be stored: they are read twice."""
    by_length = pieces.groupBy("length").count()
    lengths = {r["length"]: r["count"] for r in by_length.collect()}  # at most `capacity` rows
    slots: dict[int, list[tuple[int, int, int]]] = defaultdict(list)  # by length: first rank, first sequence, offset
    given: dict[int, int] = defaultdict(int)
    base = 0
    for kind, times in plan(lengths, capacity):
        offset = 0
        for n in kind:
            slots[n].append((given[n], base, offset))
            given[n] += times
            offset += n
        base += times
    table = {n: tuple(np.array(x, np.int64) for x in zip(*rows, strict=True)) for n, rows in slots.items()}
    sent = pieces.sparkSession.sparkContext.broadcast(table)  # proportional to capacity, see plan()
    buckets = max(64, sum(lengths.values()) // 10_000_000)
    columns = pieces.columns
    salted = pieces.withColumn("__bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)))
    before = salted.groupBy("length", "__bucket").count().select(
        F.col("length").alias("__length"), F.col("__bucket").alias("__b"),
        (F.sum("count").over(Window.partitionBy("length").orderBy("__bucket")) - F.col("count")).alias("__before"))
    ranked = salted.withColumn("__own", F.row_number().over(Window.partitionBy("length", "__bucket").orderBy("doc_id", "piece", "start", "ids_crc32")))
    ranked = ranked.join(before, (F.col("length") == F.col("__length")) & (F.col("__bucket") == F.col("__b"))).select(*columns, (F.col("__before") + F.col("__own") - 1).alias("__rank"))

    def place(batches):
        for batch in batches:
            n, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            sequence, offset = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)
            for one in np.unique(n).tolist():
                at = np.flatnonzero(n == one)
                first, start, off = sent.value[one]
                k = np.searchsorted(first, rank[at], "right") - 1
                sequence[at], offset[at] = start[k] + rank[at] - first[k], off[k]
            yield record(**{c: batch.column(c) for c in columns}, sequence_id=pa.array(sequence), offset=pa.array(offset))

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return ranked.mapInArrow(place, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, closing: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokenizes once into a stored table of pieces, then packs that."""
    return pack(staged(tokenized_pieces(docs, tokenizer_path, capacity, closing, with_ids, id_col, text_col), "pieces"), capacity)
