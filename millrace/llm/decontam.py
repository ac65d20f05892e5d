"""Operator 7, benchmark decontamination by winnowing.

A window is 13 consecutive words of an item (all its words, if it has fewer).  Of each 7 consecutive
7-grams, documents and items keep those with the smallest hash: a shared window has the same smallest
hash on both sides, so every shared window leaves at least one shared fingerprint.  A shared fingerprint
is extended word by word, on the words themselves, to the longest common run; a run of 13 words or more
is hit.  Items of fewer than 13 words are looked up by the hash of all their words.

The fingerprints of the benchmark are sent to all tasks only while `broadcast_items` and
`broadcast_bytes` hold; a larger benchmark is joined to the documents' fingerprints by a shuffle, and each
document is then compared only with the items that it shares a fingerprint with, found once a text however many
documents repeat it.

Null texts have no words, and nothing hit; an item without words has no window; a null item_id is written
as an empty string; items of the same item_id count once; repeated documents give repeated rows; empty
tables give empty results or no hits; other columns are not read.  A very long text is one slice, and takes its task some 100
bytes for each of its words.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import filter_texts, map_texts, record, texts, unused
from millrace.llm.words import Words, sliding

WINDOW, GRAM = 13, 7
SCHEMA = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, item_ids array<string>, spans array<array<long>>"
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def winnow(words: Words, window: int, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Words where a kept gram begins, and the hashes there.  Ties are all kept."""
    g, ok = words.grams(gram)
    w = window - gram + 1
    if len(g) < w:
        at = np.flatnonzero(ok)
        return at, g[at]
    value = np.where(ok, g, _TOP)
    least = sliding(value, w, np.minimum)
    # a window that reaches into the next text has no say about this one beyond what it adds: more kept grams, never fewer
    reach = np.full(len(g) + w - 1, 0, np.uint64)
    reach[w - 1 : w - 1 + len(least)] = least
    most = sliding(reach, w, np.maximum)
    at = np.flatnonzero(ok & (value <= most[: len(g)]))
    return at, g[at]


class Items:
    """A benchmark's words and fingerprints."""

    def __init__(self, ids: list, item_texts: list, window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.ids = ["" if i is None else str(i) for i in ids]
        words = Words(pa.array(item_texts, pa.string()))
        self.words = [[words.word(i) for i in range(a, b)] for a, b in zip(words.first[:-1].tolist(), words.first[1:].tolist(), strict=True)]
        counts, owner = words.counts(), words.owner()
        at, hashes = winnow(words, window, gram)
        places: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for i, h in zip(at.tolist(), hashes.tolist(), strict=True):
            if counts[owner[i]] >= window:
                places[h].append((int(owner[i]), i - int(words.first[owner[i]])))
        self.places = dict(places)
        self.keys = np.array(sorted(self.places), np.uint64)
        self.short: dict[int, dict[int, list[int]]] = {}
        for n in sorted(set(counts[(counts > 0) & (counts < window)].tolist())):
            g, _ = words.grams(n)
            by: dict[int, list[int]] = defaultdict(list)
            for item in np.flatnonzero(counts == n).tolist():
                by[int(g[words.first[item]])].append(item)
            self.short[n] = dict(by)


def _among(hashes: np.ndarray, keys: np.ndarray) -> np.ndarray:
    if not len(keys):
        return np.zeros(len(hashes), bool)
    return keys[np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)] == hashes


def find_hits(words: Words, items: Items) -> tuple[np.ndarray, dict[int, set[int]]]:
    """Flags of the words that are hit, and each text's items with occurring windows."""
    hit, by_text = np.zeros(len(words), bool), defaultdict(set)
    at, hashes = winnow(words, items.window, items.gram)
    seen: dict[tuple[int, int], int] = {}
    owner = words.owner()
    which = np.flatnonzero(_among(hashes, items.keys))
    for i, h in zip(at[which].tolist(), hashes[which].tolist(), strict=True):
        text = int(owner[i])
        low, high = int(words.first[text]), int(words.first[text + 1])
        for item, j in items.places[h]:
            if seen.get((item, i - j), -1) > i:
                continue
            own = items.words[item]
            a, b = i, i
            while b < high and b - i + j < len(own) and words.word(b) == own[b - i + j]:
                b += 1
            while b > i and a > low and a - i + j > 0 and words.word(a - 1) == own[a - 1 - i + j]:
                a -= 1
            seen[(item, i - j)] = max(b, i + 1)
            if b - a >= items.window:
                hit[a:b] = True
                by_text[text].add(item)
    for n, by in items.short.items():
        g, ok = words.grams(n)
        for i in np.flatnonzero(ok & _among(g, np.array(sorted(by), np.uint64))).tolist():
            for item in by[int(g[i])]:
                if all(words.word(i + x) == w for x, w in enumerate(items.words[item])):
                    hit[i : i + n] = True
                    by_text[int(owner[i])].add(item)
    return hit, by_text


def _runs(flags: np.ndarray) -> list[list[int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return edge.reshape(-1, 2).tolist()


def _digest(ids: list[str]) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()


def _result(part: pa.RecordBatch, words: Words, hit: np.ndarray, by_text: dict[int, set[int]], names) -> pa.RecordBatch:
    n_words = words.counts()
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    ids = [sorted({names(t, i) for i in by_text[t]}) if t in by_text else [] for t in range(len(n_words))]
    spans = [_runs(hit[words.first[t] : words.first[t + 1]]) if n_hit[t] else [] for t in range(len(n_words))]
    empty = _digest([])
    return record(doc_id=part.column("doc_id"), n_words=pa.array(n_words, pa.int64()), n_hit=pa.array(n_hit, pa.int64()), n_items=pa.array([len(x) for x in ids], pa.int64()),
                  items_sha256=pa.array([_digest(x) if x else empty for x in ids], pa.string()), contaminated=pa.array((n_hit > 0) & (20 * n_hit >= n_words)),
                  item_ids=pa.array(ids, pa.list_(pa.string())), spans=pa.array(spans, pa.list_(pa.list_(pa.int64()))))


def _benchmark(benchmark: DataFrame, item_id_col: str, item_text_col: str, most_items: int, most_bytes: int):
    """The benchmark, and its rows if they are within the bounds of a broadcast."""
    bench = benchmark.select(F.col(item_id_col).cast("string").alias("item_id"), F.col(item_text_col).cast("string").alias("text"))
    size = bench.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()
    if size.n > most_items or size.b > most_bytes:
        return bench, None
    rows = bench.collect()  # within the bounds
    return bench, bench.sparkSession.sparkContext.broadcast(([r.item_id for r in rows], [r.text for r in rows]))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_items: int = 20_000, broadcast_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated, and the real output: item_ids and the spans of hit words."""
    docs = texts(docs, id_col, text_col)
    bench, sent = _benchmark(benchmark, item_id_col, item_text_col, broadcast_items, broadcast_bytes)
    if sent is not None:

        def make():
            items = Items(*sent.value, window, gram)

            def work(part: pa.RecordBatch) -> pa.RecordBatch:
                words = Words(part.column("text"))
                hit, by_text = find_hits(words, items)
                return _result(part, words, hit, by_text, lambda t, i: items.ids[i])

            return work

        return map_texts(docs, make, SCHEMA)

    def compare():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            outs = []
            for one, items in _with_items(part, window, gram):
                words = Words(one.column("text"))
                hit, by_text = find_hits(words, items)
                outs.append(_result(one, words, hit, by_text, lambda t, k, items=items: items.ids[k]))
            return pa.Table.from_batches(outs).combine_chunks().to_batches()[0]

        return work

    return map_texts(_by_join(docs, bench, window, gram, "doc_id", "text"), compare, SCHEMA)


def _contaminated(words: Words, items: Items) -> np.ndarray:
    hit, _ = find_hits(words, items)
    total = np.concatenate(([0], np.cumsum(hit)))
    n_hit = total[words.first[1:]] - total[words.first[:-1]]
    return (n_hit > 0) & (20 * n_hit >= words.counts())


def keep_clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, broadcast_items: int = 20_000, broadcast_bytes: int = 16 << 20, id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Whole rows of the documents that are not contaminated."""
    bench, sent = _benchmark(benchmark, item_id_col, item_text_col, broadcast_items, broadcast_bytes)
    if sent is not None:

        def make():
            items = Items(*sent.value, window, gram)
            return lambda part: (~_contaminated(Words(part.column(text_col)), items)).tolist()

        return filter_texts(docs, make, text_col)

    def each():
        return lambda part: [not _contaminated(Words(one.column(text_col)), items)[0] for one, items in _with_items(part, window, gram)]

    return filter_texts(_by_join(docs, bench, window, gram, id_col, text_col), each, text_col).select(*(F.col(f"`{c}`") for c in docs.columns))


def _with_items(part: pa.RecordBatch, window: int, gram: int):
    name = part.schema.names[-1]  # added last by _by_join
    for i, near in enumerate(part.column(name).to_pylist()):
        yield part.slice(i, 1), Items([x["item_id"] for x in near or ()], [x["item_text"] for x in near or ()], window, gram)


def _by_join(docs: DataFrame, bench: DataFrame, window: int, gram: int, id_col: str, text_col: str) -> DataFrame:
    """For a benchmark of any size: a shuffle join of fingerprints gives each document the items it shares one with, as __items."""

    def item_prints():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            keys, names, sizes = [], [], []
            for name, text in zip(part.column("item_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                items = Items([name], [text], window, gram)
                own = [*items.places, *(h for by in items.short.values() for h in by)]
                keys += own
                names += [name] * len(own)
                sizes += [*[0] * len(items.places), *(n for n, by in items.short.items() for _ in by)]
            return record(key=pa.array(np.array(keys, np.uint64).view(np.int64)), item_id=pa.array(names, pa.string()), size=pa.array(sizes, pa.int32()))

        return work

    prints = map_texts(bench.repartition("item_id"), item_prints, "key long, item_id string, size int")
    short = sorted(r[0] for r in prints.filter("size > 0").select("size").distinct().collect())  # below `window` values

    def doc_prints():
        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            words = Words(part.column("text"))
            owner, keys, docs_at = words.owner(), [], []
            at, hashes = winnow(words, window, gram)
            for here, h in [(at, hashes), *((np.flatnonzero(ok), g[ok]) for g, ok in (words.grams(n) for n in short))]:
                keys.append(h)
                docs_at.append(owner[here])
            key, doc = np.concatenate(keys), np.concatenate(docs_at).astype(np.int64)
            own = part.column("doc").take(pa.array(doc))
            return record(key=pa.array(key.view(np.int64)), doc=own)

        return work

    # one row for each key: a key that many items share is not multiplied before the item sets meet a document
    by_key = prints.groupBy("key").agg(F.collect_set(F.coalesce("item_id", F.lit(""))).alias("names"))
    # a text stands for all its copies, whatever their ids; texts that share a hash only get more items to look for
    mine = lambda: F.xxhash64(F.col(f"`{text_col}`").cast("string"))
    found = map_texts(docs.select(F.col(f"`{text_col}`").cast("string").alias("text"), mine().alias("doc")), doc_prints, "key long, doc long").distinct()
    pairs = found.join(by_key, "key").select("doc", F.explode("names").alias("item_id")).distinct()
    whole = bench.select(F.coalesce("item_id", F.lit("")).alias("item_id"), F.col("text").alias("item_text"))
    near = pairs.join(whole, "item_id").groupBy("doc").agg(F.collect_list(F.struct("item_id", "item_text")).alias("items"))
    own, name = unused(docs, "__id"), unused(docs, "__items")
    near = near.select(F.col("doc").alias(own), F.col("items").alias(name))
    return docs.join(near, mine() == near[own], "left").drop(own)
