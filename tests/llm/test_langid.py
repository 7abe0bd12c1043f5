import random

import pytest
import zlib
from collections import Counter

from tallyloom.llm import langid, queries

SYLLABLES = {"en": ["th", "ing", "he", "and", "er", "wh"], "fr": ["eau", "oux", "é", "que", "le", "ai"], "de": ["sch", "ung", "ß", "ei", "tz", "ä"]}


def prose(r, lang, n):
    return " ".join("".join(r.choice(SYLLABLES[lang]) for _ in range(r.randint(1, 4))) for _ in range(n))


def corpus(spark):
    r = random.Random(1)
    rows = [(i, prose(r, lang := r.choice(list(SYLLABLES)), r.randint(3, 60)), lang) for i in range(300)]
    return spark.createDataFrame(rows, "id long, text string, lang string"), rows


def test_held_out_accuracy(spark):
    df, _ = corpus(spark)
    profiles = langid.learn(df.where("id % 2 = 0"))
    assert profiles.languages == ["de", "en", "fr"]
    got = langid.identify(df.where("id % 2 = 1"), profiles, id_col="id").join(df.select("id", "lang"), langid.F.col("doc_id") == langid.F.col("id")).collect()
    assert sum(r.lang_pred == r.lang for r in got) >= 0.97 * len(got)
    assert all(0 <= r.score <= 1 for r in got)


def test_profile_matches_plain_counts():
    from collections import Counter

    text = "Das daß das; éa"
    plain = Counter()
    for w in text.lower().split():
        padded = f" {w} "
        for n in langid.ORDERS:
            for k in range(len(padded) - n + 1):
                gram = padded[k : k + n]
                if any(c.isalpha() for c in gram) and " " not in gram[1:-1]:
                    plain[gram] += 1
    code, count = langid.ngram_counts(text)

    def number(gram):
        out = 0
        for c in gram:
            out = out * 0x110000 + ord(c)
        return out

    assert dict(zip(code.tolist(), count.tolist())) == {number(g): n for g, n in plain.items()}


def test_undetermined_and_empty(spark, docs, empty, texts):
    df, _ = corpus(spark)
    rows = {r.doc_id: r for r in langid.identify(docs, langid.learn(df)).collect()}
    for i in (1, 2, 3, 12):
        assert (rows[i].lang_pred, rows[i].score) == ("und", 0.0)
    assert rows[6].lang_pred in SYLLABLES
    none = langid.learn(empty.selectExpr("doc_id AS id", "text", "lang"))
    assert {r.lang_pred for r in langid.identify(docs, none).collect()} == {"und"}
    assert langid.identify(empty, none).count() == 0


def plain_profile(texts, size):
    """The most frequent n-grams of some texts, ties by code points."""
    total = Counter()
    for t in texts:
        for w in t.lower().split():
            padded = f" {w} "
            for n in langid.ORDERS:
                for k in range(len(padded) - n + 1):
                    g = padded[k : k + n]
                    if any(c.isalpha() for c in g) and " " not in g[1:-1]:
                        total[g] += 1
    number = lambda g: sum(ord(c) * 0x110000**k for k, c in enumerate(reversed(g)))
    return [g for g, _ in sorted(total.items(), key=lambda x: (-x[1], number(x[0])))[:size]]


def test_query_matches_plain_distances(spark, texts, tmp_path):
    """The whole query: training rows, profiles, out-of-place sums, ties by name, held_out."""
    r = random.Random(8)
    rows = [(i, t, lang, "s", 0) for i, t, lang, _ in texts] + [(1000 + i, prose(r, lang := r.choice(list(SYLLABLES)), r.randint(1, 400)), lang, "s", 0) for i in range(120)]
    rows += [(5000, "", "en", "s", 0), (5001, None, "xx", "s", 0), (5002, prose(r, "fr", 30_000), "fr", "s", 0), rows[-1]]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2 if i is not None else False
    size = 400
    by = {}
    for i, t, lang, *_ in rows:
        if t is not None and lang is not None and held(i) is False:
            by.setdefault(lang, []).append(t)
    profiles = {lang: plain_profile(t, size) for lang, t in by.items()}
    places = {lang: {g: k for k, g in enumerate(p)} for lang, p in profiles.items() if p}

    def predict(t):
        own = plain_profile([t or ""], size)
        if not own:
            return "und", 0.0
        sums = {lang: sum(min(abs(at[g] - k), size) if g in at else size for k, g in enumerate(own)) for lang, at in places.items()}
        best = min(sorted(sums), key=sums.get)
        return best, 1 - sums[best] / (size * len(own))

    got = sorted(((x.doc_id, x.held_out, x.lang_pred, round(x.score, 9)) for x in queries.op1_language_id(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted(((i, held(i), *(lambda p: (p[0], round(p[1], 9)))(predict(t))) for i, t, *_ in rows), key=str)


def test_sample_is_bounded_and_the_rows_of_least_hash(spark):
    """A label with many rows, an id that repeats: never more than the sample, always the same rows."""
    df = spark.range(4000).selectExpr("IF(id < 300, 7, id) AS id", "concat('w', id) AS text", "IF(id % 4 = 0, 'b', 'a') AS lang")
    hashes = sorted(x.h for x in df.where("lang = 'a'").selectExpr("xxhash64(id) AS h").collect())
    profiles = langid.learn(df, profile_size=100_000, sample_per_language=200)
    kept = {x.text for x in df.where(langid.F.col("lang") == "a").withColumn("h", langid.F.xxhash64("id")).where(langid.F.col("h") < hashes[200]).collect()}
    assert len(profiles.languages) == 2 and len(kept) >= 100
    codes = set(profiles.codes.tolist())
    found = sum(any(int(c) in codes for c in langid.ngram_counts(t)[0]) for t in kept)
    assert found == len(kept)


@pytest.mark.parametrize("ids", [7, 8, 9, 10, None])
def test_rows_that_share_an_id_are_learned_from(spark, ids):
    """Whatever the id's hash, a language is sampled up to the bound."""
    rows = [(ids, "the one and only text", "en") for _ in range(3000)] + [(ids, f"ein satz mit nummer {k}", "de") for k in range(500)] + [(k, "un texte de plus", "fr") for k in range(2500)]
    df = spark.createDataFrame(rows, "id long, text string, lang string").repartition(5)
    profiles = langid.learn(df, sample_per_language=1000)
    assert profiles.languages == ["de", "en", "fr"]
    counts = dict(sampled(df.where("lang = 'de'"), 1000) | sampled(df.where("lang = 'en'"), 1000) | sampled(df.where("lang = 'fr'"), 1000))
    assert counts == {"de": 500, "en": 1000, "fr": 1000}


def sampled(df, bound):
    """How many rows learn() counts: the n-gram function is watched through an accumulator."""
    seen = df.sparkSession.sparkContext.accumulator(0)
    plain = langid.ngram_counts

    def counting(text):
        seen.add(1)
        return plain(text)

    langid.ngram_counts = counting
    try:
        lang = langid.learn(df, sample_per_language=bound).languages[0]
    finally:
        langid.ngram_counts = plain
    return {lang: seen.value}
