"""Each operator against a brute-force version, and on nulls, empty texts and tables, long texts, ties, repeated rows and clashing columns."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from pyspark.sql import functions as F

from millrace.llm import decontam, langid, licenses, packing, quality, secrets, simhash, suffix_dedup, token_counts, topk
from millrace.llm.common import texts

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SYLLABLES = "ba do ki lu mé no pé ra sü to".split()


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def prose(r, n):
    return " ".join("".join(r.choices(SYLLABLES, k=r.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    base = [prose(r, r.randint(1, 60)) for _ in range(60)]
    out = list(base)
    out += base[:6]  # exact copies
    out += [b + " " + prose(r, 1) for b in base[:8]]  # near copies
    out += [prose(r, 10) + " " + base[20] + ". " + prose(r, 10), "Été\n\n  déjà-vu\t" + base[21], prose(r, 6000), base[3] * 3]
    rows = list(enumerate(out)) + [(1000, None), (1001, ""), (1002, " \n\t "), (1003, "!!! ???"), (5, out[5]), (5, "another text of one id"), (None, out[7]), (None, None)]
    r.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With columns that the operators' own could clash with."""
    made = spark.createDataFrame(rows, "doc_id long, text string")
    return made.withColumns({c: F.lit("clash") for c in ("fp", "unit", "score", "length", "labels", "component_id", "size", "word", "bucket", "n", "row", "own", "__items", "__id")}).repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.filter("false")


def by_id(found):
    out = defaultdict(list)
    for r in found:
        out[r.doc_id].append(r)
    return out


def agree(found, rows, value, expected):
    """The results of each id, as many as it has rows."""
    got, want = defaultdict(Counter), defaultdict(Counter)
    for r in found:
        got[r.doc_id][value(r)] += 1
    for i, t in rows:
        want[i][expected(i, t)] += 1
    assert got == want


def test_license_scans(spark, rows, none):
    extra = [(2000, "Released under the MIT License. Under-the mit LICENSE!"), (2001, "cc by nc cc by nc, apache license version 2 mit"), (2002, "nc by cc license mit the under"), (2003, "x " * 30000 + "cc BY-nc"),
             (2004, "Permission is hereby granted, free of charge, to any person who gets a copy of this software and the documentation files, to deal in the software without restriction"), (2005, "This work is licensed under the GNU General Public License, version 3.")]
    rows = rows + extra
    templates = licenses.default_templates()

    def brute(i, text):
        w, base, labels, best = words(text), [], set(), 0.0
        for t in templates:
            if t.ordered:
                for a in range(len(w) - len(t.words) + 1):
                    if tuple(w[a : a + len(t.words)]) == t.words:
                        base.append((a, t.label))
                        best = 1.0
                continue
            own = set(t.words)
            share = max((len(own & set(w[a : a + t.width])) for a in range(max(1, len(w) - t.width + 1))), default=0) / len(own)
            if share >= t.threshold - 1e-12:
                labels.add(t.label)
                best = max(best, share)
        names = sorted({k for _, k in base})
        return (len(w), len(base), min(base)[0] if base else None, max(base)[0] if base else None, ",".join(names), ",".join(sorted(labels | set(names))), round(best, 9))

    found = licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    agree(found, rows, lambda r: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9)), brute)
    assert by_id(found)[2004][0].labels == "mit" and by_id(found)[2002][0].labels == ""
    assert licenses.scan_licenses(none).count() == 0


def test_packing_is_whole_and_tight(docs, rows, none):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    found = packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True).collect()
    expected = Counter()
    for i, t in rows:
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            expected[i, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()), tuple(ids[a:b])] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32, tuple(r.ids)) for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, n in sorted(own):
            assert offset == at
            at += n
        assert at <= 2048
    assert len(sequences) <= -(-sum(r.length for r in found) // 2048) + 1
    assert packing.pack_documents(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0


def test_plan_fills_exactly():
    done = packing.plan({6: 2, 4: 1, 3: 1, 1: 1, 10: 3, 5: 2}, 10)
    assert sum(k for _, k in done) == 6 and all(sum(kind) == 10 for kind, _ in done)
    r = random.Random(1)
    for _ in range(20):
        lengths = Counter(r.choices(range(1, 101), k=300))
        done = packing.plan(dict(lengths), 100)
        assert sum((Counter({n: kind.count(n) * k for n in set(kind)}) for kind, k in done), Counter()) == lengths
        assert all(sum(kind) <= 100 for kind, _ in done)
        assert sum(k for _, k in done) <= least_bins(lengths, 100) + 2


def test_complements_are_all_found():
    """Every answer of the maps against all combinations, while lengths are consumed."""
    r = random.Random(3)
    for _ in range(40):
        counts = np.zeros(41, np.int64)
        for n, k in Counter(r.choices(range(1, 40), k=r.randint(1, 14))).items():
            counts[n] = k
        maps = packing.Complements(counts)
        for _ in range(12):
            gap = r.randint(0, 39)
            at_hand = [n for n, k in enumerate(maps.counts) for _ in range(min(k, 3))]
            fills = [{c for c in itertools.combinations(at_hand, size) if sum(c) == gap} for size in (1, 2, 3)]
            found = maps.fill(gap) if gap else None
            if found is None:
                assert not gap or not any(fills)
                continue
            assert tuple(sorted(found)) in next(f for f in fills if f)
            for n in found:
                maps.counts[n] -= 1


@pytest.mark.parametrize("sf, fewest", [("sf0.001", 96), ("sf0.01", 481)])
def test_plan_of_whole_tables(sf, fewest):
    """As few sequences as the tokens need, with singles, pairs and triples in use."""
    import pyarrow.parquet as pq

    encoder, lengths = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json")), Counter()
    for text in pq.read_table(f"/root/testdata/{sf}/documents.parquet", columns=["text"]).column("text").to_pylist():
        whole, over = divmod(len(encoder.encode(text or "")) // 4 + 1, 2048)
        lengths.update([2048] * whole + [over] * (over > 0))
    done = packing.plan(dict(lengths))
    assert sum((Counter({n: kind.count(n) * k for n in set(kind)}) for kind, k in done), Counter()) == lengths
    assert sum(k for _, k in done) == fewest == -(-sum(n * k for n, k in lengths.items()) // 2048)
    assert all(any(len(kind) == size and sum(kind) == 2048 for kind, _ in done) for size in (2, 3, 4))


def least_bins(lengths, capacity):
    """Martello and Toth's lower bound: no large lengths share a bin, and small ones fill what these leave."""
    best = 0
    for k in range(capacity // 2 + 1):
        large = sum(c for n, c in lengths.items() if n > capacity - k)
        middle = [(n, c) for n, c in lengths.items() if capacity // 2 < n <= capacity - k]
        small = sum(n * c for n, c in lengths.items() if k <= n <= capacity // 2)
        room = sum((capacity - n) * c for n, c in middle)
        best = max(best, large + sum(c for _, c in middle) + max(0, -(-(small - room) // capacity)))
    return best


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "don't 'll\x1c\x85 ﷺ日本", "naïve café’s — “q”\t\t1²½", "  x\n\n y  ", "\x00\x01", "x" * 500, "İ ſ ＡＢ"])
def test_encoder_is_the_library(text):
    encoder = packing.ByteEncoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert np.frombuffer(encoder.encode(text), "<u4").tolist() == encoder.library.encode(text, add_special_tokens=False).ids


def test_token_counts(spark, rows, none):
    model = public_tokenizers.path("piece_bpe_32k.model")
    rows = rows + [(3000, "  two  spaces\n\nlines\n "), (3001, "▁mark a▁b"), (3002, "<s> </s> <unk> <0x0A>"), (3003, "日本語 ﷺ \x00\t"), (3004, "y" * 9000), (3005, "\n"), (3006, " ")]
    library = token_counts.PieceCounter(model).model

    def brute(i, text):
        n = len(library.encode(text or ""))
        return len((text or "").encode()), n, n > 4096

    df = spark.createDataFrame(rows * 2, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("bucket", "unit", "ids", "bytes", "counts", "tokens", "n_tokens", "token")})
    # no frequent ones, and many units; all frequent; one unit a task
    for options in ({"frequent": 0, "unit_bytes": 1000}, {}, {"frequent": 20, "sample": 10, "bucket_bytes": 500}):
        agree(token_counts.count_tokens(df, model, **options).collect(), rows * 2, lambda r: (r.n_bytes, r.n_tokens, r.over_limit), brute)
    assert token_counts.count_tokens(none, model).count() == 0


def test_each_pre_token_is_counted_once(rows):
    """Over all units, buckets and the frequent ones, on whole texts and their copies."""
    found = Counter(p for _, t in rows * 3 for p in token_counts.pre_tokens(t or ""))
    known = dict.fromkeys([p for p, _ in found.most_common(50)], 1)
    batches = []
    for number in range(7):
        unit = token_counts.Unit(known)
        for i, t in (rows * 3)[number::7]:
            unit.add(i, t or "", len((t or "").encode()))
        batches.append(unit.rows(number, 5))
    table = pa.Table.from_batches(batches)
    assert table.filter(pa.compute.is_valid(table.column("ids"))).num_rows == 7
    asked = table.filter(pa.compute.is_valid(table.column("tokens")))
    counted = Counter()
    for b in range(5):
        distinct, places = token_counts.distinct_tokens(asked.filter(pa.compute.equal(asked.column("bucket"), b)))
        counted.update(distinct)
        assert sorted(set(np.concatenate(places).tolist())) == list(range(len(distinct)))
    assert set(counted.values()) == {1} and set(counted) == set(found) - set(known)


def test_top_k(spark):
    r = np.random.default_rng(3)
    rows = [(i, [float(x) for x in r.integers(-3, 4, 4) / 8]) for i in range(230)]
    bad = [(300, None), (400, [1.0, None, 1.0, 1.0]), (500, [float("nan")] * 4), (600, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0] * 4), (700, [0.5, 0.5]), (7, [1.0] * 4)]
    df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash")).repartition(40)
    valid = rows + [(700, [0.5, 0.5]), (7, [1.0] * 4)]
    for options in ({}, {"block_bytes": 64}):
        got = defaultdict(list)
        for x in topk.top_k(df, F.col("vec_id") % 100 == 0, **options).collect():
            got[x.query_id].append((x.rank, x.vec_id, x.score))
        for q, v in ((i, v) for i, v in valid if i % 100 == 0):
            own = sorted(((-sum(int(np.floor(1024 * a)) * int(np.floor(1024 * b)) for a, b in zip(v, w, strict=True)), i) for i, w in valid if i != q and len(w) == len(v)))[:10]
            assert sorted(got[q]) == [(k + 1, i, -s) for k, (s, i) in enumerate(own)]
        assert {q for q, found in got.items() if found} == {0, 100, 200}
    assert topk.top_k(df.filter("false"), F.col("vec_id") % 100 == 0).count() == 0
    huge = spark.createDataFrame([(0, [1e300, 1.0]), (100, [-1e300, 1e16]), (1, [1.0, 2.0]), (2, [1e300, 5.0]), (3, [-3.0, 1e15]), (4, [1e308, 1.0])], "vec_id long, embedding array<double>")
    top, low = (1 << 63) - 1, -(1 << 63)
    got = {(x.query_id, x.vec_id): (x.rank, x.score) for x in topk.top_k(huge, F.col("vec_id") % 100 == 0).collect()}
    assert [got[0, i] for i in (1, 2, 3, 100)] == [(1, top), (2, top), (3, low), (4, low)] and len(got) == 8
    assert [got[100, i] for i in (3, 0, 1, 2)] == [(1, top), (2, low), (3, low), (4, low)]
    big = np.array([[2.0**40, 3.0]])
    assert topk.scores(big, np.array([[2.0**20, 1.0]])).tolist() == [[2**60 + 3]]


def test_suffix_dedup(docs, rows, none):
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        for a in range(len(b) - 49):
            s = b[a : a + 50]
            first[s] = min(first.get(s, float("inf")), float("inf") if i is None else i)

    def brute(i, t):
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for a in range(len(b) - 49):
            if first[b[a : a + 50]] < (float("inf") if i is None else i):
                gone[a : a + 50] = True
        runs = sum(1 for k, g in itertools.groupby(gone.tolist()) if k)
        return len(b), int(gone.sum()), runs, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest()

    # small units, and groups of two of them, level by level
    for options in ({}, {"unit_bytes": 4000, "group_units": 2}, {"unit_bytes": 4000}, {"unit_bytes": 4000, "group_units": 2, "hash_units": 2, "frequent": (1, 2)}):
        found = suffix_dedup.remove_repeats(docs, **options).collect()
        agree(found, rows, lambda r: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256), brute)
        assert sum(r.n_removed > 0 for r in found) > 10
    assert suffix_dedup.remove_repeats(none).count() == 0


def frequent_passages():
    """A link, a passage below and one above the length, all in every document and each time among other words; and a text of copies."""
    r = random.Random(8)
    link, short, long = "https://www.example.com/archive/", prose(r, 20)[:45], prose(r, 40)[:70]
    rows = [(i, "".join(f"{r.getrandbits(90):x}{x}{r.getrandbits(90):x}" for x in r.sample([link, short, long], 3))) for i in range(150)]
    return [*rows, (150, rows[3][1] * 3), (3, rows[9][1]), (None, rows[4][1])]


def removed_by_force(rows):
    first = {}
    for i, t in rows:
        t = t.encode()
        for a in range(len(t) - 49):
            first[t[a : a + 50]] = min(first.get(t[a : a + 50], float("inf")), float("inf") if i is None else i)

    def runs(i, t):
        t = t.encode()
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - 49):
            if first[t[a : a + 50]] < (float("inf") if i is None else i):
                gone[a : a + 50] = True
        edge = np.flatnonzero(np.diff(np.concatenate(([0], gone, [0]))))
        return tuple(edge.tolist())

    return runs


@pytest.mark.parametrize("frequent, hash_units", [((2, 5), 4), ((0, 10**6), 10**6), ((0, 0), 3), ((10**6, 10**6), 2)])
def test_suffix_dedup_of_frequent_strings(spark, frequent, hash_units):
    rows = frequent_passages()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    found = suffix_dedup.remove_repeats(docs, unit_bytes=2000, group_units=3, hash_units=hash_units, frequent=frequent).collect()
    agree(found, rows, lambda r: tuple(x for p in r.removed for x in p), removed_by_force(rows))


def test_suffix_dedup_splits_frequent_strings(spark):
    """No bucket gets the surroundings of a frequent string from all units, once equal ones have met."""
    rows = frequent_passages()[:150]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    units = pa.Table.from_pylist([r.asDict() for r in suffix_dedup.units(docs, 1000).collect()]).to_batches(max_chunksize=1)
    hashes = pa.Table.from_batches(list(suffix_dedup._send_hashes(units, 1, 50, 24)))
    # an anchor or stretch that goes to one bucket is in 5 units at most, in each of these once a document
    bound = 5 * max(len(u.column("ids")[0]) for u in units)
    assert bound < 50
    largest = {}
    for frequent in ((2, 5), (10**6, 10**6)):
        shared = suffix_dedup._shared(hashes, frequent).to_pylist()
        lists = [[x for x in shared if x["unit"] == u.column("unit")[0].as_py()] for u in units]
        sent = pa.Table.from_batches(list(suffix_dedup._send_surroundings([pa.RecordBatch.from_pylist([u.to_pylist()[0] | {"lists": x}]) for u, x in zip(units, lists, strict=True)], 1, 1 << 30, 50, 24)))
        sent, size = sent.append_column("group", pa.array([0] * sent.num_rows, pa.int64())), Counter()
        for b, n in zip(sent.column("bucket").to_pylist(), sent.column("n").to_pylist(), strict=True):
            size[b] += n
        largest[frequent] = 0
        for b in (b for b, n in size.items() if n > bound):
            met = suffix_dedup._combine(sent.filter(pa.compute.equal(sent.column("bucket"), b)), 50, 24, 1, 1 << 30)
            rest = sum(n for n, own in zip(met.column("n").to_pylist(), met.column("bucket").to_pylist(), strict=True) if own == b)
            largest[frequent] = max(largest[frequent], rest)
    assert largest[10**6, 10**6] >= 150 and largest[2, 5] <= bound


def test_bucket_pointers_sort_suffixes():
    r = np.random.default_rng(5)
    for n, size in ((1, 50), (2, 8), (300, 50), (300, 13), (400, 3)):
        strings = r.integers(0, 2, (n, size)).astype(np.uint8)
        strings[n // 2 :] = strings[: n - n // 2]
        strings[n // 3 :, size // 2] ^= 1
        keys = [x.tobytes() for x in strings]
        pointer = suffix_dedup.bucket_pointers(strings).tolist()
        rank = {k: i for i, k in enumerate(sorted(set(keys)))}
        assert [rank[k] for k in keys] == pointer
        least = size // 3
        classes = suffix_dedup.suffix_classes(strings, least)
        for d in range(least, size + 1):
            same = {}
            for k, c in zip(keys, classes[:, d - least].tolist(), strict=True):
                assert same.setdefault(k[:d], c) == c
            assert len(set(same.values())) == len(same)


def test_language_id(spark, docs, none):
    r = random.Random(2)
    tongues = {"aa": "bado kilu mano".split(), "bb": "xeth wrok zzif".split(), "ru": "привет мир слово".split()}
    speak = lambda k, n: " ".join(r.choices(tongues[k], k=n))
    train = [(i, speak(k, 40), k) for i, k in enumerate(list(tongues) * 30)] + [(900, None, "aa"), (901, "bado", None)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    assert model.languages == ["aa", "bb", "ru"]
    tests = [(1, speak("aa", 5)), (2, speak("bb", 2000)), (3, speak("ru", 3)), (4, speak("aa", 20) + " " + speak("bb", 60)), (5, None), (6, ""), (7, "123 !?"), (8, speak("aa", 4).upper()), (None, speak("bb", 9))]
    found = {x.doc_id: x for x in langid.identify(spark.createDataFrame(tests, "doc_id long, text string"), model).collect()}
    assert [found[i].lang_pred for i in (1, 2, 3, 4, 5, 6, 7, 8, None)] == ["aa", "bb", "ru", "bb", "und", "und", "und", "aa", "bb"]
    assert [(s.lang, s.first_word, s.end_word) for s in found[4].spans] == [("aa", 0, 20), ("bb", 20, 80)]
    assert all(0 <= x.score <= 1 for x in found.values())
    assert {x.lang_pred for x in langid.identify(docs, langid.train(none.withColumn("lang", F.lit("x")))).collect()} == {"und"}


def test_words_are_letters():
    assert langid.words_of("½ ② Ⅷ ٣ 12 _ --") == []
    assert langid.words_of("x² Été_½日本 l'an") == ["x", "été", "日本", "l", "an"]


def test_viterbi_is_optimal():
    r = np.random.default_rng(4)
    for _ in range(60):
        s = r.normal(0, 3, (r.integers(1, 7), 3)).astype(np.float32)
        cost = lambda path, s=s: sum(float(s[t, k]) for t, k in enumerate(path)) - 2.5 * sum(a != b for a, b in itertools.pairwise(path))
        best = max(map(cost, itertools.product(range(3), repeat=len(s))))
        assert abs(cost(langid.viterbi(s, 2.5).tolist()) - best) < 1e-4
        top = s.sum(0, dtype=np.float64).argmax()
        if langid.settled(s, np.array([0, len(s)]), np.array([top]), 2.5)[0]:
            assert abs(cost([int(top)] * len(s)) - best) < 1e-4


@pytest.mark.parametrize("bounds", [{}, {"broadcast_items": 0}])
def test_decontamination(spark, docs, rows, none, bounds):
    t = dict((i, x) for i, x in rows if i is not None)
    long = max((x for x in t.values() if x and len(words(x)) < 100), key=len)
    items = [("1", long), ("2", prose(random.Random(9), 20)), ("10", " ".join(words(t[70] or "x")[:5]) or "x"), ("3", None), ("4", "..."), (None, " ".join(words(long)[2:30])), ("1", long), ("5", "bado")]

    def brute(i, text):
        w = words(text)
        hit, ids = set(), set()
        for name, it in items:
            own = words(it)
            n = min(13, len(own))
            wins = {tuple(own[a : a + n]) for a in range(len(own) - n + 1)} if n else set()
            for a in range(len(w) - n + 1) if n else ():
                if tuple(w[a : a + n]) in wins:
                    hit.update(range(a, a + n))
                    ids.add(name or "")
        return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)

    bench = spark.createDataFrame(items, "item_id string, text string").withColumn("key", F.lit("clash"))
    found = decontam.contamination(docs, bench, **bounds).collect()
    agree(found, rows, lambda r: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated), brute)
    kept = decontam.keep_clean(docs, bench, **bounds)
    assert kept.columns == docs.columns
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == Counter((i, x) for i, x in rows if not brute(i, x)[-1])
    assert decontam.contamination(none, bench, **bounds).count() == 0
    assert not any(r.n_hit for r in decontam.contamination(docs, bench.filter("false"), **bounds).collect())


def test_quality(spark, docs, none):
    r = random.Random(8)
    good = [(i, prose(r, 30), 1) for i in range(60)]
    bad = [(i + 100, " ".join(w.upper() + "!!" for w in prose(r, 30).split()), 0) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(None, 1), (5, None), (7, 9)], "doc_id long, quality int")
    model = quality.train(texts(df), labels)
    tests = [(i, prose(r, 30)) for i in range(30)] + [(i + 100, " ".join(w.upper() + "!!" for w in prose(r, 30).split())) for i in range(30)] + [(500, None), (501, ""), (None, "x"), (502, prose(r, 9000))]
    found = by_id(quality.score_quality(spark.createDataFrame(tests, "doc_id long, text string"), model).collect())
    assert np.mean([found[i][0].predicted for i in range(30)]) > 0.95 and np.mean([found[i + 100][0].predicted for i in range(30)]) < 0.05
    assert all(0 <= x[0].score <= 1 for x in found.values()) and found[500][0].score == found[501][0].score
    flat = quality.train(texts(df), labels.filter("false"))
    assert {round(x.score, 6) for x in quality.score_quality(docs, flat).collect()} == {0.5}
    assert quality.score_quality(none, model).count() == 0


def test_dual_coordinate_descent_reaches_the_optimum():
    rows = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([2])]
    values = [np.ones(len(x)) for x in rows]
    y, cost = np.array([1.0, 1.0, -1.0, -1.0]), np.ones(4)
    w, b = quality.dual_coordinate_descent(rows, values, y, cost, epochs=2000, tolerance=1e-10)
    x = np.zeros((4, 4))
    for i, f in enumerate(rows):
        x[i, f] = 1
    x[:, 3] = 1
    v = np.concatenate((w[:3], [b]))
    slack = np.maximum(1 - y * (x @ v), 0)
    assert np.allclose(v, 2 * ((slack * y) @ x), atol=1e-5)  # the gradient of v.v/2 + sum of slack squared is zero


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(rows):
    fps = [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if (fps[a] ^ fps[b]).bit_count() <= 2:
            root[find(a)] = find(b)
    least = defaultdict(list)
    for x in range(len(rows)):
        least[find(x)].append(rows[x][0])
    return fps, [min((i for i in least[find(x)] if i is not None), default=None) for x in range(len(rows))]


@pytest.mark.parametrize("options", [{}, {"tile": 4}, {"bands": 5}])
def test_simhash(docs, rows, none, options):
    fps, component = brute_components(rows)
    found = simhash.near_duplicates(docs, **options).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in found) == Counter((i, f, c) for (i, _), f, c in zip(rows, fps, component, strict=True))
    roots = {}
    for r in found:
        roots.setdefault(r.root, set()).add(r.component_id)
    assert all(len(x) == 1 for x in roots.values())
    assert simhash.near_duplicates(none).count() == 0


def shingles(text, k=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else {None}


def near_copies(r, text, n):
    """Copies with some words changed, put in or taken out."""
    out = []
    for _ in range(n):
        w = text.split()
        for _ in range(r.randint(1, max(1, len(w) // 60))):
            at, new = r.randrange(len(w)), prose(r, 1)
            w[at : at + r.randint(0, 1)] = [new] * r.randint(0, 2)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("options", [{}, {"tile": 16}])
def test_similar_texts_are_found_and_others_left(spark, none, options):
    r = random.Random(21)
    unlike = [prose(r, r.randint(20, 300)) for _ in range(150)]
    passage = prose(r, 30)
    unlike += [f"{prose(r, 60)} {passage} {prose(r, 60)}" for _ in range(60)]  # a passage in common is no likeness
    groups = [[t, *near_copies(r, t, r.randint(1, 12))] for t in (prose(r, r.randint(60, 400)) for _ in range(60))]
    rows = list(enumerate([*unlike, *(t for g in groups for t in g)]))
    found = {x.doc_id: x.component_id for x in simhash.similar(spark.createDataFrame(rows, "doc_id long, text string"), **options).collect()}
    assert all(found[i] == i for i in range(len(unlike)))
    number, hit, total = len(unlike), 0, 0
    for g in groups:
        own, sets = range(number, number + len(g)), [shingles(t) for t in g]
        number += len(g)
        assert {found[i] for i in own} <= set(own)
        for a, b in itertools.combinations(range(len(g)), 2):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                total += 1
                hit += found[own[a]] == found[own[b]]
    assert total > 500 and hit >= 0.98 * total


def test_one_document_of_each_group_stays(spark, docs, rows, none):
    r = random.Random(3)
    base = prose(r, 200)
    more = [(5, "x " + base), (5, base), (None, base + " y"), (None, prose(r, 90)), (None, None), (8, ""), (9, "ba do"), (10, "ba do"), (11, "ba ki")]
    made = spark.createDataFrame(more * 2, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("row", "own", "n", "root", "node", "f0", "m0", "__id", "component_id")})
    kept = simhash.keep_one(made)
    assert kept.columns == made.columns
    got = sorted((str(x.doc_id), x.text or "") for x in kept.collect())
    assert [i for i, _ in got] == ["11", "5", "8", "9", "None"] and got[-1][1] == more[3][1] and got[1][1] in (more[0][1], more[1][1])
    assert simhash.keep_one(docs).columns == docs.columns and simhash.keep_one(none).count() == 0
    # components that hold rows of one id are two groups all the same
    two = spark.createDataFrame([(5, base), (5, prose(r, 150))], "doc_id long, text string")
    assert simhash.keep_one(two).count() == 2


def test_bit_sliced_comparison_and_long_chains(spark):
    r = np.random.default_rng(6)
    fps = r.integers(0, 1 << 63, 300, dtype=np.uint64)
    fps[150:] = fps[:150] ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64)) ^ (np.uint64(1) << r.integers(0, 64, 150).astype(np.uint64))
    planes = simhash._planes(fps)
    for lag in (1, 63, 64, 150, 299):
        got = simhash.close_pairs(planes, simhash._pack(np.arange(300) < 300 - lag), lag, 2)
        assert sorted(got.tolist()) == [i for i in range(300 - lag) if int(fps[i] ^ fps[i + lag]).bit_count() <= 2]
    chain = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(1000 + i, 1300) for i in range(50)], "u long, v long")
    roots = {x.node: x.root for x in simhash.components(chain).collect()}
    assert set(roots) == {*range(201), *range(1000, 1050), 1300} and all(v == (0 if k < 500 else 1000) for k, v in roots.items())


def test_secrets(spark, rows, none):
    r = random.Random(12)
    key = lambda n=40: "".join(r.choices("0123456789abcdef", k=n))
    mixed = lambda n=32: "".join(r.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=n))
    more = [(4000 + i, f'{prose(r, 12)} token = "{key()}" {prose(r, 12)}') for i in range(60)] + [(5000 + i, f"{prose(r, 8)} API_KEY: {mixed()} {prose(r, 8)}") for i in range(60)]
    more += [(6000, "AKIA" + "A1B2C3D4E5F6G7H8 AKIA12 deadbeef " + "0123456789abcdef"), (6001, "password=short passwd = longenough12+/ Secret:'x'"), (6002, "é" * 5 + f' token="{key()}"'), (6003, "ſecret=abcdefghijklmn toKen=abcdefghijklmn")]
    rows = rows + more

    def brute(i, text):
        text, out = text or "", []
        for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.I | re.A):
            if len(m.group(2)) >= 12:
                out.append((m.start(), 0, m.end()))
        out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
        out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m.group()) >= 16]
        written = ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))
        return (*(sum(k == n for _, k, _ in out) for n in range(3)), hashlib.sha256(written.encode()).hexdigest(), written)

    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text"))
    net = secrets.train(texts(df))
    found = secrets.find_secrets(df, net).collect()
    agree(found, rows, lambda r: (r.n_assign, r.n_access, r.n_hex, r.base_sha256, ",".join(s for s in r.spans.split(",") if not s.startswith("cnn"))), brute)
    free = [f"{prose(r, 8)} {x} {prose(r, 8)}" for x in (mixed() for _ in range(40)) if re.search("[0-9]", x) and re.search("[a-z]", x)]
    caught = sum(bool(more) for _, more in secrets.spans_of(free, net))
    assert caught >= 0.8 * len(free)
    clean = [prose(r, 40) for _ in range(50)]
    assert not any(more for _, more in secrets.spans_of(clean, net))
    hidden = secrets.redact(df, net)
    assert hidden.columns == df.columns and hidden.count() == len(rows)
    for x in hidden.collect():
        assert x.text is None or not secrets.base_spans(x.text) and len(x.text) == x.n_chars
    assert secrets.train(texts(none)) is None and secrets.find_secrets(none, None).count() == 0
