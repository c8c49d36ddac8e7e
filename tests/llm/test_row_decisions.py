"""Decisions on rows and training samples where ids are null or repeated and texts have many copies."""

from __future__ import annotations

import random

from taskloom.llm import decontamination, jaccard, language


def prose(seed, n, alphabet="abcdefgh"):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice(alphabet) for _ in range(rng.randint(3, 8))) for _ in range(n))


def test_clean_rows_with_null_or_repeated_ids_stay(spark):
    passage = prose(1, 12)
    texts = [prose(k, 40) for k in range(10, 16)]
    leak = f"{texts[0]} {passage} {texts[1]}"
    rows = [(None, leak), (None, texts[2]), (None, None), (7, leak), (7, texts[3]), (8, texts[4]), (7, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = [tuple(r) for r in decontamination.without_leaks(docs, bench).collect()]
    assert sorted(kept, key=str) == sorted([r for r in rows if r[1] != leak], key=str)


def test_unrelated_rows_with_null_or_repeated_ids_stay(spark):
    texts = [prose(k, 40) for k in range(20, 26)]
    rows = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (5, texts[3]), (4, texts[3]), (6, texts[4]), (6, texts[4])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in jaccard.keep_one(docs).collect()]
    expected = [(None, texts[0]), (None, texts[1]), (5, texts[2]), (4, texts[3]), (6, texts[4])]
    assert sorted(kept, key=str) == sorted(expected, key=str)


def trained_on(spark, monkeypatch, rows, train_docs):
    """Texts that the fit reads for each language: each text holds a word of its own."""
    seen = []
    keep = language.written

    def spy(counts):
        out = keep(counts)
        seen.extend((r["lang"], r["word"], r["n"]) for r in out.collect())
        return out

    monkeypatch.setattr(language, "written", spy)
    language.fit(spark.createDataFrame(rows, "text string, lang string"), train_docs=train_docs, rounds=0)
    return {(lang, word.strip()): n for lang, word, n in seen}


def test_copies_do_not_push_a_language_out_of_the_sample(spark, monkeypatch):
    names = ["".join(random.Random(k).choices("abcdefghij", k=12)) for k in range(600)]
    rows = [(names[k % 3], "xx") for k in range(3000)]
    rows += [(name, "yy") for name in names[3:]] + [(names[3], "yy")] * 2000
    got = trained_on(spark, monkeypatch, rows, 100)
    assert {word: n for (lang, word), n in got.items() if lang == "xx"} == dict.fromkeys(names[:3], 1)
    other = [n for (lang, _), n in got.items() if lang == "yy"]
    assert 60 < len(other) < 150 and set(other) == {1}
