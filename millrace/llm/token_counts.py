"""Operator 3, token counts: pieces are counted once for each distinct pre-token of the corpus.

A pre-token is a run of word marks with the characters after it, up to the next mark or line end, or a
line end with the characters after it.  No piece of the vocabulary may hold a mark after another
character, or a line end (checked when the model is opened), so merges never cross a pre-token's bounds
and a text's count is the sum over its pre-tokens.  The steps:

1. the `frequent` most frequent pre-tokens of a bounded sample of the texts are counted once on the driver and sent to all
   tasks; which they are affects the cost alone;
2. units of some MB of text sum what those give each document, and send their other distinct pre-tokens, with the documents that
   hold them and how often, to hash buckets;
3. a bucket meets each of its distinct pre-tokens once, counts its pieces and joins the counts to the documents' frequencies;
4. a unit's sums come together again.

A pre-token is in one bucket or among the frequent ones, never both, so it is encoded once over the whole corpus however many
documents, copies or tasks hold it, and one that stands in most documents is one entry a unit.  Id lists of texts are never made.

Nulls and empty texts count 0 tokens; repeated rows give repeated results; a null id stays null; an empty
table gives an empty result; other columns are not read; which of equally frequent pre-tokens are sent is settled by their
characters.  A very long text is a unit of its own and takes its task some 10 times its bytes; where a vocabulary does not
split, texts are encoded whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import large_text, map_texts, record, slices, texts

MARK = "▁"
_PRE = re.compile(f"{MARK}+[^{MARK}\n]*|\n[^{MARK}\n]*")
#: Pre-tokens that are sent to all tasks, the longest such, the texts whose frequencies choose them, and their bytes at most.
FREQUENT, LONGEST, SAMPLE, FREQUENT_BYTES = 100_000, 64, 4000, 8 << 20
#: Bytes of text in a unit, and of text for one bucket; the fewest buckets.
UNIT, BUCKET_BYTES, LEAST_BUCKETS = 4 << 20, 16 << 20, 64
_ROW = "bucket long, unit long, ids array<long>, bytes array<long>, counts array<long>, tokens binary, sizes binary, holders binary"


def pre_tokens(text: str) -> list[str]:
    return _PRE.findall(MARK + text.replace(" ", MARK)) if text else []


class PieceCounter:
    def __init__(self, model_path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        self.splits = not any("\n" in p or re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def count(self, distinct: list[str]) -> list[int]:
        """Pieces of each pre-token."""
        # encode() puts a mark in front: it stands for a pre-token's own first mark, and is one piece too many before a line end;
        # an empty text gets none, but a mark alone is a piece
        ids = self.model.encode([p[1:] if p[0] == MARK else p for p in distinct], num_threads=1)
        return [1 if p == MARK else len(x) if p[0] == MARK else len(x) - 1 for p, x in zip(distinct, ids, strict=True)]


@lru_cache(maxsize=2)
def _counter(model_path: str) -> PieceCounter:
    """Opened once a worker, not once a bucket."""
    return PieceCounter(model_path)


def _zip(a: np.ndarray | bytes) -> bytes:
    return zstandard.ZstdCompressor(level=3).compress(a if isinstance(a, bytes) else np.ascontiguousarray(a).tobytes())


def _unzip(data: bytes, kind=np.int32) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), kind)


class Unit:
    """Documents, what the frequent pre-tokens give them, and where the others stand."""

    def __init__(self, known: dict[str, int]):
        self.known, self.bytes = known, 0
        self.ids: list[int | None] = []
        self.size: list[int] = []
        self.sums: list[int] = []
        self.places: dict[str, int] = {}
        self.token: list[int] = []
        self.doc: list[int] = []
        self.times: list[int] = []

    def add(self, doc_id: int | None, text: str, size: int) -> None:
        found = Counter(pre_tokens(text))
        counts = list(map(self.known.get, found))
        if None in counts:
            places = self.places
            for k, (p, n) in zip(counts, found.items(), strict=True):
                if k is None:
                    self.token.append(places.setdefault(p, len(places)))
                    self.times.append(n)
            self.doc += [len(self.ids)] * (len(self.token) - len(self.doc))
            counts = [k or 0 for k in counts]
        self.ids.append(doc_id), self.size.append(size), self.sums.append(sum(map(mul, counts, found.values())))
        self.bytes += size

    def rows(self, number: int, buckets: int) -> pa.RecordBatch:
        """Its own row, which passes through the bucket stage, and one row for each bucket that it has pre-tokens for."""
        tokens = pa.array(list(self.places), pa.large_string())
        hashes = np.fromiter((xxhash.xxh3_64_intdigest(p.encode()) for p in self.places), np.uint64, len(tokens))
        bucket = (hashes % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        tokens, bucket = tokens.take(pa.array(order)), bucket[order]
        new = np.empty(len(order), np.int64)
        new[order] = np.arange(len(order))
        token, doc, times = (np.array(x, np.int64) for x in (self.token, self.doc, self.times))
        token = new[token] if len(token) else token
        by_token = np.argsort(token, kind="stable")
        token, doc, times = token[by_token], doc[by_token], times[by_token]
        offsets = np.frombuffer(tokens.buffers()[1], np.int64)[: len(tokens) + 1] if len(tokens) else np.zeros(1, np.int64)
        data = tokens.buffers()[2].to_pybytes() if len(tokens) else b""
        begin = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.zeros(0, np.int64)
        cut, at = [*begin.tolist(), len(bucket)], np.searchsorted(token, [*begin, len(bucket)]).tolist()
        blobs, sizes, holders = [], [], []
        for k in range(len(begin)):
            a, b = cut[k], cut[k + 1]
            blobs.append(_zip(data[offsets[a] : offsets[b]]))
            sizes.append(_zip(np.diff(offsets[a : b + 1]).astype("<i8")))
            own = slice(at[k], at[k + 1])
            holders.append(_zip(np.concatenate((token[own] - a, doc[own], times[own])).astype("<i4")))
        n = len(begin)
        return record(
            bucket=pa.array([number % buckets, *bucket[begin].tolist()], pa.int64()), unit=pa.array([number] * (n + 1), pa.int64()), ids=pa.array([self.ids, *[None] * n], pa.list_(pa.int64())), bytes=pa.array([self.size, *[None] * n], pa.list_(pa.int64())),
            counts=pa.array([self.sums, *[None] * n], pa.list_(pa.int64())), tokens=pa.array([None, *blobs], pa.binary()), sizes=pa.array([None, *sizes], pa.binary()), holders=pa.array([None, *holders], pa.binary()))


def _units(batches: Iterator[pa.RecordBatch], known: dict[str, int], buckets: int, limit: int) -> Iterator[pa.RecordBatch]:
    number = TaskContext.get().partitionId() << 32
    unit = Unit(known)
    for batch in batches:
        for part in slices(batch):
            text = large_text(part.column("text"))
            for row in zip(part.column("doc_id").to_pylist(), text.to_pylist(), pc.binary_length(text).to_pylist(), strict=True):
                unit.add(*row)
            if unit.bytes >= limit:
                yield unit.rows(number, buckets)
                number, unit = number + 1, Unit(known)
    if unit.ids:
        yield unit.rows(number, buckets)


def distinct_tokens(t: pa.Table) -> tuple[list[str], list[np.ndarray]]:
    """Of a bucket's rows with pre-tokens: the distinct ones, and each row's as places among them."""
    parts, n = [], []
    for data, sizes in zip(t.column("tokens").to_pylist(), t.column("sizes").to_pylist(), strict=True):
        offsets = np.concatenate(([0], np.cumsum(_unzip(sizes, "<i8")))).astype("<i8")
        n.append(len(offsets) - 1)
        parts.append(pa.LargeStringArray.from_buffers(n[-1], pa.py_buffer(offsets.tobytes()), pa.py_buffer(_unzip(data, np.uint8).tobytes())))
    coded = pa.concat_arrays(parts).dictionary_encode()
    return coded.dictionary.to_pylist(), np.split(coded.indices.to_numpy(), np.cumsum(n)[:-1])


def _joined(t: pa.Table, model_path: str) -> pa.Table:
    """A bucket: its pre-tokens counted, and summed for each unit's documents; the units' own rows as they are."""
    own = t.filter(pc.is_valid(t.column("ids"))).select(["unit", "ids", "bytes", "counts"])
    asked = t.filter(pc.is_valid(t.column("tokens")))
    unit, sums = [], []
    if asked.num_rows:
        distinct, places = distinct_tokens(asked)
        pieces = np.array(_counter(model_path).count(distinct), np.int64)
        for u, at, holders in zip(asked.column("unit").to_pylist(), places, asked.column("holders").to_pylist(), strict=True):
            token, doc, times = _unzip(holders, "<i4").reshape(3, -1)
            total = np.zeros(int(doc.max()) + 1, np.int64)
            np.add.at(total, doc, pieces[at][token] * times)
            unit.append(u)
            sums.append(total)
    none = pa.nulls(len(unit), pa.list_(pa.int64()))
    more = pa.table({"unit": pa.array(unit, pa.int64()), "ids": none, "bytes": none, "counts": pa.array(sums, pa.list_(pa.int64()))})
    return pa.concat_tables([own, more.cast(own.schema)]) if own.num_rows else more


def _together(t: pa.Table, limit: int) -> pa.Table:
    """A unit's documents with all its sums."""
    whole = pc.index(pc.is_valid(t.column("ids")), True).as_py()
    ids, size = t.column("ids")[whole].as_py(), t.column("bytes")[whole].as_py()
    total = np.zeros(len(ids), np.int64)
    for counts in t.column("counts"):
        own = counts.values.to_numpy()
        total[: len(own)] += own
    return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_tokens": pa.array(total), "over_limit": pa.array(total > limit)})


def frequent_tokens(docs: DataFrame, n_docs: int, most: int, sample: int) -> list[str]:
    """The `most` most frequent pre-tokens of about `sample` texts, those with the smallest hashes of id and text."""

    def make():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            found = Counter(p for t in part.column("text").to_pylist() if t for p in pre_tokens(t))
            found = {p: n for p, n in found.items() if len(p) <= LONGEST}
            return record(token=pa.array(list(found), pa.string()), n=pa.array(list(found.values()), pa.int64()))

        return work

    place = F.pmod(F.xxhash64(F.lit("tokens"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    some = docs.filter(place < min(1.0, sample / max(n_docs, 1))).filter("text is not null")
    counted = map_texts(some, make, "token string, n long").groupBy("token").agg(F.sum("n").alias("n"))
    out, size = [], 0
    for r in counted.orderBy(F.desc("n"), "token").limit(most).collect():
        size += len(r.token.encode())
        if size > FREQUENT_BYTES:
            break
        out.append(r.token)
    return out


def count_tokens(docs: DataFrame, model_path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT, sample: int = SAMPLE, unit_bytes: int = UNIT, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (more than `limit` tokens) of every whole text."""
    docs, counter = texts(docs, id_col, text_col), PieceCounter(model_path)
    if not counter.splits:

        def whole():
            model = PieceCounter(model_path).model

            def work(part: pa.RecordBatch) -> pa.RecordBatch:
                text = large_text(part.column("text"))
                n = pa.array([len(model.encode(t)) for t in text.to_pylist()], pa.int64())
                return record(doc_id=part.column("doc_id"), n_bytes=pc.binary_length(text).cast(pa.int64()), n_tokens=n, over_limit=pc.greater(n, limit))

            return work

        return map_texts(docs, whole, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
    size = docs.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    buckets = max(LEAST_BUCKETS, int(size.b) // bucket_bytes)
    known = frequent_tokens(docs, size.n, frequent, sample)
    sent = docs.sparkSession.sparkContext.broadcast(dict(zip(known, counter.count(known), strict=True)))  # FREQUENT_BYTES of characters at most
    rows = docs.mapInArrow(lambda batches: _units(batches, sent.value, buckets, unit_bytes), _ROW)
    sums = rows.groupBy("bucket").applyInArrow(lambda t: _joined(t, model_path), "unit long, ids array<long>, bytes array<long>, counts array<long>")
    return sums.groupBy("unit").applyInArrow(lambda t: _together(t, limit), "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
