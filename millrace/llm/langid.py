"""Operator 6, language identification of mixed text.

Script ranges narrow the languages that a word can be in to those that use its script in training; every word
gets a log-likelihood for each of them from character n-grams (hashed), and Viterbi with a penalty for each switch of
language labels every word of the text.  Spans are runs of equal labels; the prediction is the language with most
letters, its score the share of letters times the posterior of its spans.

The model learns from at most `per_language` labelled texts a language, those with the smallest hashes of their
ids and texts; whole texts are read.  No labelled text, no language: everything is `und`, as are null texts and texts
without a letter (score 0).  Ties go to the language that sorts first.  Repeated rows give repeated results;
a null id stays null; empty tables give empty results; other columns are not read.  Any number of languages is learned: the model
takes 128 KB for each, on the driver and in every task.  A very long text is one slice, and takes its task some 20 bytes for each
of its words and languages.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import filter_texts, map_texts, record
from millrace.llm.words import byte_values, mix, prefix_hash, span_hash

UNKNOWN = "und"
PER_LANGUAGE, HELD_LANGUAGES = 3000, 64
BITS, ORDERS = 15, (1, 2, 3)
SWITCH, CLIP, SMOOTH = 14.0, 9.0, 0.5
MEMO = 200_000
#: The first also takes numerals that are not decimal digits; it is the faster one.
_WORD, _LETTERS = re.compile(r"[^\W\d_]+"), regex.compile(r"\p{L}+")

#: Where the scripts' ranges of code points begin (a range ends where the next begins).
SCRIPTS = ((0x0000, "latin"), (0x0370, "greek"), (0x0400, "cyrillic"), (0x0530, "armenian"), (0x0590, "hebrew"), (0x0600, "arabic"), (0x0900, "devanagari"), (0x0980, "bengali"), (0x0A00, "gurmukhi"), (0x0A80, "gujarati"), (0x0B00, "oriya"), (0x0B80, "tamil"), (0x0C00, "telugu"), (0x0C80, "kannada"), (0x0D00, "malayalam"), (0x0D80, "sinhala"), (0x0E00, "thai"), (0x0E80, "lao"), (0x0F00, "tibetan"), (0x1000, "myanmar"), (0x10A0, "georgian"), (0x1100, "hangul"), (0x1200, "ethiopic"), (0x1780, "khmer"), (0x1E00, "latin"), (0x1F00, "greek"), (0x2000, "other"), (0x2C60, "latin"), (0x2C80, "other"), (0x3040, "kana"), (0x3100, "han"), (0x3130, "hangul"), (0x3190, "han"), (0xAC00, "hangul"), (0xD7B0, "other"), (0xF900, "han"), (0xFB00, "latin"), (0xFB13, "armenian"), (0xFB1D, "hebrew"), (0xFB50, "arabic"), (0xFF00, "latin"), (0xFF66, "kana"), (0xFFA0, "hangul"), (0xFFE0, "other"), (0x20000, "han"), (0x30000, "other"))
_STARTS = [a for a, _ in SCRIPTS]


def script_of(word: str) -> str:
    return SCRIPTS[bisect_right(_STARTS, ord(word[0])) - 1][1]


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case; numerals such as a half or a superscript two are none."""
    text = text.lower()
    found = _WORD.findall(text)
    return found if all(map(str.isalpha, found)) else _LETTERS.findall(text)


def gram_numbers(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams of the words, each word between underscores, and of whole words; and each gram's word."""
    coded = [w.encode() for w in words]
    data = np.frombuffer(b"_" + b"__".join(coded) + b"_", np.uint8)
    size = np.fromiter(map(len, coded), np.int64, len(coded)) + 2
    end = np.cumsum(size)
    owner = np.repeat(np.arange(len(words)), size)
    room = end[owner] - np.arange(len(data))
    value = byte_values(data)
    h, grams, owners = np.zeros(len(data), np.uint64), [], []
    for n in range(1, max(ORDERS) + 1):
        h[: len(data) - n + 1] = h[: len(data) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + value[n - 1 :]
        if n in ORDERS:
            at = np.flatnonzero(room >= n)
            grams.append(mix(h[at] + np.uint64(n)) >> np.uint64(64 - BITS))
            owners.append(owner[at])
    grams.append(span_hash(prefix_hash(value), end - size, end) >> np.uint64(64 - BITS))
    owners.append(np.arange(len(words)))
    return np.concatenate(grams).astype(np.int64), np.concatenate(owners)


class Model:
    def __init__(self, languages: list[str], counts: np.ndarray, scripts: dict[str, np.ndarray]):
        """counts: languages x grams; scripts: each script's letters by language."""
        self.languages = languages
        total = counts.sum(1, keepdims=True)
        self.log = (np.log(counts + SMOOTH) - np.log(total + SMOOTH * counts.shape[1])).astype(np.float32)
        letters = sum(scripts.values()) if scripts else np.zeros(len(languages))
        self.uses = {s: n >= 0.01 * np.maximum(letters, 1) for s, n in scripts.items()}

    def word_scores(self, words: list[str]) -> np.ndarray:
        """Each language's log-likelihood of each word against the best, cut at -CLIP; languages without the word's script get -2 CLIP."""
        none = np.zeros(len(self.languages), bool)
        ok = np.array([self.uses.get(script_of(w), none) for w in words])
        gram, owner = gram_numbers(words)
        s = np.stack([np.bincount(owner, weights=row[gram], minlength=len(words)) for row in self.log], 1)
        top = np.where(ok, s, -np.inf).max(1, keepdims=True)
        known = ok.any(1, keepdims=True)
        s = np.where(ok, np.maximum(s - np.where(known, top, 0), -CLIP), -2 * CLIP)
        return np.where(known, s, 0).astype(np.float32)


def settled(s: np.ndarray, first: np.ndarray, best: np.ndarray, penalty: float) -> np.ndarray:
    """Texts in which no stretch of another language gains more than one switch costs: their best single language is optimal.

    s: scores of all words; first: each text's first word (n + 1, no text empty); best: each text's language."""
    n = len(best)
    owner = np.repeat(np.arange(n), np.diff(first))
    gain = s.astype(np.float64) - s[np.arange(len(s)), best[owner]][:, None]
    after = np.cumsum(gain, 0)
    apart = (owner * (4 * CLIP * (len(s) + 1)))[:, None]  # lowers each text below all before it, so that minima start anew
    before = after - gain
    rise = after - (np.minimum.accumulate(before - apart, 0) + apart)
    return np.maximum.reduceat(rise.max(1), first[:-1]) <= penalty


def viterbi(s: np.ndarray, penalty: float) -> np.ndarray:
    """Labels with the largest sum of scores less penalties."""
    v, back = s[0].tolist(), []
    for row in s[1:].tolist():
        top = max(v)
        least = top - penalty
        back.append((v.index(top), [x >= least for x in v]))
        v = [(x if x >= least else least) + y for x, y in zip(v, row, strict=True)]
    out = np.zeros(len(s), np.int64)
    k = out[-1] = v.index(max(v))
    for t in range(len(back) - 1, -1, -1):
        top, stay = back[t]
        if not stay[k]:
            k = top
        out[t] = k
    return out


class Labeller:
    def __init__(self, model: Model, penalty: float = SWITCH):
        self.model, self.penalty = model, penalty
        self.memo: dict[str, int] = {}
        self.rows = np.zeros((0, len(model.languages)), np.float32)
        self.size = np.zeros(0, np.int64)

    def labels(self, texts: list[str | None]) -> list[tuple[str, float, list[dict], float]]:
        """Language, score, spans and known share of each text; new words are scored together.

        The known share is that of all languages: each span's share of the letters times its posterior."""
        words = [words_of(t) if t and self.model.languages else [] for t in texts]
        new = list(set().union(*words).difference(self.memo))
        if len(self.memo) + len(new) > MEMO:
            self.memo.clear()
            new = list(set().union(*words))
        if new:
            base = len(self.memo)
            self.memo.update(zip(new, range(base, base + len(new)), strict=True))
            self.rows = np.concatenate((self.rows[:base], self.model.word_scores(new)))
            self.size = np.concatenate((self.size[:base], np.fromiter(map(len, new), np.int64, len(new))))
        out: list[tuple[str, float, list[dict], float]] = [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        full = [i for i, w in enumerate(words) if w]
        if not full:
            return out
        first = np.concatenate(([0], np.cumsum([len(words[i]) for i in full])))
        at = np.fromiter(map(self.memo.__getitem__, chain.from_iterable(words)), np.int64, first[-1])
        s, size = self.rows[at], self.size[at]
        total = np.add.reduceat(s, first[:-1], axis=0, dtype=np.float64)
        best = total.argmax(1)
        one = settled(s, first, best, self.penalty)
        alone = 1 / np.exp(np.clip(total - total[np.arange(len(full)), best][:, None], -700, 0)).sum(1)
        for k, i in enumerate(full):
            a, b = int(first[k]), int(first[k + 1])
            if one[k]:
                name = self.model.languages[best[k]]
                out[i] = name, float(alone[k]), [{"lang": name, "first_word": 0, "end_word": b - a}], float(alone[k])
            else:
                out[i] = self._mixed(s[a:b], size[a:b])
        return out

    def _mixed(self, s: np.ndarray, size: np.ndarray) -> tuple[str, float, list[dict], float]:
        label = viterbi(s, self.penalty)
        share = np.bincount(label, weights=size, minlength=s.shape[1])
        best = int(share.argmax())
        evidence = s[label == best].sum(0, dtype=np.float64)
        posterior = 1 / np.exp(np.clip(evidence - evidence[best], -700, 30)).sum()
        cut = np.concatenate(([0], np.flatnonzero(np.diff(label)) + 1, [len(label)]))
        spans = [{"lang": self.model.languages[label[a]], "first_word": a, "end_word": b} for a, b in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True)]
        own = np.add.reduceat(s, cut[:-1], axis=0, dtype=np.float64)
        sure = 1 / np.exp(np.clip(own - own[np.arange(len(own)), label[cut[:-1]]][:, None], -700, 30)).sum(1)
        known = (np.add.reduceat(size, cut[:-1]) * sure).sum() / size.sum()
        return self.model.languages[best], float(min(1.0, share[best] / size.sum() * posterior)), spans, float(min(1.0, known))


def train(labelled: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    """labelled: doc_id, text, lang.  Counts are made on the executors; the driver gets languages x 2**BITS numbers at most."""
    labelled = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # a row a language
    languages = sorted(sizes)
    if not languages:
        return Model([], np.zeros((0, 1 << BITS)), {})
    frequent = [k for k in languages if sizes[k] > per_language]  # of the others all texts
    share = F.create_map(*(x for k in frequent for x in (F.lit(k), F.lit(per_language / sizes[k])))) if frequent else F.create_map(F.lit(""), F.lit(1.0))
    place = F.pmod(F.xxhash64(F.lit("langid"), "doc_id", "text"), F.lit(1 << 40)) / float(1 << 40)
    sample = labelled.filter(place < F.coalesce(F.try_element_at(share, F.col("lang")), F.lit(1.0))).select("text", "lang")
    number = {k: i for i, k in enumerate(languages)}

    def count(batches):
        n: dict[int, np.ndarray] = {}
        letters: Counter[tuple[int, str]] = Counter()

        def grams():
            for k, row in n.items():
                j = np.flatnonzero(row)
                yield record(lang=pa.array(np.full(len(j), k), pa.int32()), gram=pa.array(j, pa.int32()), script=pa.nulls(len(j), pa.string()), n=pa.array(row[j], pa.int64()))
            n.clear()

        for batch in batches:
            words: dict[int, Counter] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                words.setdefault(number[lang], Counter()).update(words_of(text))
            for k, found in words.items():
                if found:
                    gram, owner = gram_numbers(list(found))
                    more = np.bincount(gram, weights=np.fromiter(found.values(), np.int64, len(found))[owner], minlength=1 << BITS).astype(np.int64)
                    n[k] = n[k] + more if k in n else more
                for w, times in found.items():
                    letters[k, script_of(w)] += len(w) * times
                if len(n) >= HELD_LANGUAGES:  # what a task holds does not grow with the languages
                    yield from grams()
        yield from grams()
        yield record(lang=pa.array([k for k, _ in letters], pa.int32()), gram=pa.array([-1] * len(letters), pa.int32()), script=pa.array([s for _, s in letters], pa.string()), n=pa.array(list(letters.values()), pa.int64()))

    rows = sample.mapInArrow(count, "lang int, gram int, script string, n long").groupBy("lang", "gram", "script").agg(F.sum("n").alias("n")).toArrow()
    lang, gram, script, n = (rows.column(c).to_numpy(zero_copy_only=False) for c in ("lang", "gram", "script", "n"))
    counts = np.zeros((len(languages), 1 << BITS))
    counts[lang[gram >= 0], gram[gram >= 0]] = n[gram >= 0]
    scripts: dict[str, np.ndarray] = {}
    for i in np.flatnonzero(gram < 0):
        scripts.setdefault(script[i], np.zeros(len(languages)))[lang[i]] += n[i]
    return Model(languages, counts, scripts)


def identify(docs: DataFrame, model: Model, penalty: float = SWITCH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score, and spans (lang, first_word, end_word)."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # languages x 2**BITS numbers

    def make():
        labeller = Labeller(sent.value, penalty)

        def work(part: pa.RecordBatch) -> pa.RecordBatch:
            out = labeller.labels(part.column("text").to_pylist())
            return record(doc_id=part.column("doc_id"), lang_pred=pa.array([x[0] for x in out], pa.string()), score=pa.array([x[1] for x in out], pa.float64()),
                          spans=pa.array([x[2] for x in out], pa.list_(pa.struct([("lang", pa.string()), ("first_word", pa.int64()), ("end_word", pa.int64())]))))

        return work

    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_texts(docs, make, "doc_id long, lang_pred string, score double, spans array<struct<lang: string, first_word: long, end_word: long>>")


def keep_known(docs: DataFrame, model: Model, least: float = 0.5, penalty: float = SWITCH, text_col: str = "text") -> DataFrame:
    """Whole rows of the texts of which a share of at least `least` is known to be of some language, whichever and however many."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        labeller = Labeller(sent.value, penalty)

        return lambda part: [lang != UNKNOWN and known >= least for lang, _, _, known in labeller.labels(part.column(text_col).to_pylist())]

    return filter_texts(docs, make, text_col)
