"""Operators 6 and 8 as queries: held-out accuracy, a brute-force version, and repeated rows and clashing columns under a trained model."""

import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import langid, licenses, quality, queries
from millrace.llm.common import texts

SF = "/root/testdata/sf0.01"
LATIN = {"aa": "ba do ki lu ma", "bb": "sch ung eit pf ler", "cc": "tion eau ux oi ment"}


def prose(r, lang, n):
    own = LATIN[lang].split() if lang in LATIN else ["при", "вет", "мир", "но"]
    return " ".join("".join(r.choices(own, k=r.randint(1, 4))) for _ in range(n))


def fold(i, n):
    return zlib.crc32(str(i).encode()) % n


def test_language_query_on_held_out_documents(spark):
    found = queries.op6_language_id(spark, SF).collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    assert len(found) == len(lang) and all(r.held_out == (fold(r.doc_id, 4) == 2) and 0 <= r.score <= 1 for r in found)
    held = [r.lang_pred == lang[r.doc_id] for r in found if r.held_out and lang[r.doc_id] is not None]
    assert len(held) > 150 and np.mean(held) >= 0.98


def test_quality_query_on_held_out_labels(spark):
    found = {r.doc_id: r for r in queries.op8_quality_classifier(spark, SF).collect()}
    assert len(found) == spark.read.parquet(f"{SF}/documents.parquet").count() and all(r.held_out == (fold(i, 5) == 0) and r.predicted == (r.score >= 0.3) for i, r in found.items())
    held = [(r.quality, found[r.doc_id]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if fold(r.doc_id, 5) == 0 and r.quality is not None]
    assert len(held) > 50 and np.mean([r.predicted == y for y, r in held]) >= 0.95
    up, down = ([r.score for y, r in held if y == k] for k in (1, 0))
    assert np.mean([a > b for a in up for b in down]) >= 0.98


def brute_language(train, penalty=langid.SWITCH):
    """Counts by dictionaries, every word scored alone, and dynamic programming over all words and languages."""
    languages = sorted({k for _, k in train})
    size, counts, letters = 1 << langid.BITS, {k: Counter() for k in languages}, defaultdict(Counter)
    for text, lang in train:
        for w in langid.words_of(text):
            counts[lang].update(langid.gram_numbers([w])[0].tolist())
            letters[langid.script_of(w)][lang] += len(w)
    total = Counter()
    for by in letters.values():
        total.update(by)

    def score(w):
        by = letters.get(langid.script_of(w), Counter())
        can = [k for k in languages if langid.script_of(w) in letters and by[k] >= 0.01 * max(total[k], 1)]
        if not can:
            return [0.0] * len(languages)
        grams = langid.gram_numbers([w])[0].tolist()
        like = {k: sum(math.log(counts[k][g] + langid.SMOOTH) - math.log(sum(counts[k].values()) + langid.SMOOTH * size) for g in grams) for k in can}
        best = max(like.values())
        return [max(like[k] - best, -langid.CLIP) if k in like else -2 * langid.CLIP for k in languages]

    def predict(text):
        words = langid.words_of(text or "")
        if not words:
            return "und", 0.0
        s = [score(w) for w in words]
        v, back = [(x, None) for x in s[0]], []
        for row in s[1:]:
            step = []
            for j, x in enumerate(row):
                at = max(range(len(row)), key=lambda i: v[i][0] - penalty * (i != j))
                step.append((v[at][0] - penalty * (at != j) + x, at))
            back.append([a for _, a in step])
            v = step
        k = max(range(len(languages)), key=lambda i: v[i][0])
        path = [k]
        for b in reversed(back):
            k = b[k]
            path.append(k)
        path.reverse()
        share = Counter()
        for w, k in zip(words, path, strict=True):
            share[k] += len(w)
        best = max(sorted(share), key=lambda k: share[k])
        evidence = [sum(s[i][j] for i in range(len(words)) if path[i] == best) for j in range(len(languages))]
        posterior = 1 / sum(math.exp(min(max(e - evidence[best], -700), 30)) for e in evidence)
        return languages[best], min(1.0, share[best] / sum(share.values()) * posterior)

    return predict


def test_language_against_brute_force(spark):
    r = random.Random(4)
    train = [(i, prose(r, k, 30), k) for i, k in enumerate([*LATIN, "ru"] * 12)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    tests = [" ".join(prose(r, k, r.randint(1, 25)) for k in r.choices([*LATIN, "ru"], k=r.randint(1, 4))) for _ in range(60)] + [None, "", "12 !", "日本", prose(r, "aa", 3000)]
    rows = [(i, t) for i, t in enumerate(tests)] + [(None, tests[0])] + [(3, tests[3])] * 3
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("lang", "score", "spans", "lang_pred", "gram", "n", "script")})
    brute = brute_language([(t, k) for _, t, k in train])
    want, got = defaultdict(list), defaultdict(list)
    for i, t in rows:
        want[i].append(brute(t))
    for x in langid.identify(docs, model).collect():
        got[x.doc_id].append((x.lang_pred, x.score))
    assert got.keys() == want.keys()
    for i in want:
        assert [a for a, _ in got[i]] == [a for a, _ in want[i]] and [b for _, b in got[i]] == pytest.approx([b for _, b in want[i]], abs=1e-3)


def test_many_languages(spark):
    """More than a task holds at once, and than any fixed number."""
    letters = "abcdefghijklmnopqrstuvwxyz"
    train = [(i, f"{a}{b}{a}{b} {a}{b}{b}", f"{a}{b}") for i, (a, b) in enumerate((a, b) for a in letters[:10] for b in letters[10:20])]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string").repartition(2))
    assert len(model.languages) == 100
    found = {x.doc_id: x.lang_pred for x in langid.identify(spark.createDataFrame(train, "doc_id long, text string, lang string"), model).collect()}
    assert sum(found[i] == k for i, _, k in train) >= 98


def test_quality_is_of_each_text_alone(spark):
    """Whatever stands beside it; repeated ids in the labelled texts; clashing columns."""
    r = random.Random(9)
    good = [(i, prose(r, "aa", 30), 1) for i in range(60)]
    bad = [(i + 100, prose(r, "bb", 30).upper() + " !!", 0) for i in range(60)]
    df = spark.createDataFrame([(i, t) for i, t, _ in good + bad] + [(0, good[0][1])] * 200 + [(None, "x y")] * 50, "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in good + bad] + [(0, 1), (0, 1)], "doc_id long, quality int").withColumn("text", F.lit("clash"))
    model = quality.train(texts(df), labels.select("doc_id", "quality"))
    again = quality.train(texts(df.dropDuplicates()), labels.select("doc_id", "quality"))
    assert np.array_equal(model.weight, again.weight) and model.bias == again.bias
    rows = [(i, t) for i, t, _ in good[:20] + bad[:20]] * 2 + [(900, None), (900, ""), (None, "ba do")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("quality", "features", "score", "predicted", "x")})
    got = defaultdict(list)
    for x in quality.score_quality(docs, model).collect():
        got[x.doc_id].append(round(x.score, 9))
    for i, t in rows:
        alone = round(float(model.score(texts_column([t]))[0]), 9)
        assert alone in got[i]
    assert sum(map(len, got.values())) == len(rows)


def texts_column(values):
    import pyarrow as pa

    return pa.array(values, pa.string())


def test_licenses_of_repeated_rows_and_clashing_columns(spark):
    rows = [(1, "under the MIT license"), (1, "under the MIT license"), (2, None), (None, "cc by nc"), (None, "cc by nc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("word", "n", "labels", "score", "blocks", "n_words", "base_labels")})
    found = Counter((x.doc_id, x.n_words, x.base_labels) for x in licenses.scan_licenses(docs).collect())
    assert found == {(1, 4, "mit"): 2, (2, 0, ""): 1, (None, 3, "cc-by-nc"): 2}
