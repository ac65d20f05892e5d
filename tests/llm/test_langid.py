"""Operator 6's filter on mixed texts."""

import random

from millrace.llm import langid

SYLLABLES = {"aa": "ba do ki lu".split(), "bb": "sch ung eit pf".split(), "cc": "tion eau ux oi".split()}


def prose(r, lang, n):
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(2, 4))) for _ in range(n))


def test_an_even_mixture_of_three_languages_stays(spark):
    r = random.Random(3)
    rows = [(i, prose(r, lang, 60), lang) for i, lang in enumerate(sorted(SYLLABLES) * 30)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    mixed = " ".join(prose(r, lang, n) for lang, n in (("aa", 30), ("bb", 22), ("cc", 16)))
    even = " ".join(prose(r, lang, 25) for lang in SYLLABLES)
    docs = spark.createDataFrame([(1, mixed), (2, even), (3, prose(r, "aa", 20)), (4, "123 !?"), (5, None), (6, "жук лес мир")], "doc_id long, text string")
    found = {x.doc_id: x for x in langid.identify(docs, model).collect()}
    assert found[2].score < 0.5 and {s.lang for s in found[2].spans} == set(SYLLABLES)
    assert {x.doc_id for x in langid.keep_known(docs, model).collect()} == {1, 2, 3}
