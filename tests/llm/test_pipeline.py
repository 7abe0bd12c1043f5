import re
from collections import Counter

import corpus_pipeline
from tallyloom.llm import queries, simhash


def test_stages_narrow_and_pack(spark, docs, texts, tmp_path):
    columns = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in texts], columns).write.parquet(f"{tmp_path}/documents.parquet")
    now = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = [now]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert now.columns == kept[0].columns, name
            now.write.parquet(f"{tmp_path}/{name}")
            now = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(now)
    start, language, exact, near, mixed, packed = kept
    assert {1, 2, 3, 12}.isdisjoint(r.doc_id for r in language.collect())
    contents = [re.sub(r"[\x20\x09-\x0d]", "", r.text) for r in exact.collect()]
    assert len(contents) == len(set(contents)) == len({re.sub(r"[\x20\x09-\x0d]", "", r.text) for r in language.collect()})
    fps = [simhash.fingerprint(r.text) for r in near.collect()]
    assert all((a ^ b).bit_count() > 4 for i, a in enumerate(fps) for b in fps[:i])
    copies = Counter(r.doc_id for r in mixed.collect())
    assert max(copies.values()) <= 2
    lengths = Counter()
    for r in packed.collect():
        lengths[r.doc_id] += r.length
    assert set(lengths) == set(copies)
    total = corpus_pipeline.run(spark, str(tmp_path)).agg({"length": "sum"}).first()[0]
    assert total == sum(lengths.values())


def test_rows_go_only_by_their_own_decision(spark, texts, tmp_path):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    own = {
        (None, "badge chief adj high deaf big chafed idea"),
        (None, "cage hid beach fade jig aged bid edge fad"),
        (700, "jade beige chide bead fig hedge dig fab if"),
        (700, "gab hide chief cab ache jab debate fed jib"),
    }
    copies = {(701, "jade  beige chide bead fig hedge dig fab if"), (None, "gab hide  chief cab ache jab debate fed jib")}
    # a copy has the longer text, so that it stays and the row of id 700 goes, but not the other of that id
    rows = [(i, t, lang, s, len(t or "")) for i, t, lang, s in texts if i is not None and i >= 20] + [(i, t, "en", "a", len(t)) for i, t in sorted(own | copies, key=str)]
    docs = spark.createDataFrame(rows, schema)
    asked = own | copies
    seen = lambda df: {(r.doc_id, r.text) for r in df.collect()} & asked
    assert seen(corpus_pipeline.language_id(spark, docs, str(tmp_path))) == asked
    after = corpus_pipeline.exact(spark, docs, str(tmp_path))
    assert seen(after) == {x for x in asked if (x[0], x[1]) not in {(700, "jade beige chide bead fig hedge dig fab if"), (700, "gab hide chief cab ache jab debate fed jib")}}
    none = spark.createDataFrame([(i, t, "en", "a", len(t)) for i, t in sorted(own, key=str)], schema)
    assert seen(corpus_pipeline.exact(spark, none, str(tmp_path))) == own
    assert seen(corpus_pipeline.near(spark, none, str(tmp_path))) == own
    again = none.union(spark.createDataFrame([(3, "cage hid beach fade jig aged bid edge fad", "en", "a", 9)], schema))
    assert {(r.doc_id, r.text) for r in corpus_pipeline.near(spark, again, str(tmp_path)).collect()} == own - {(None, "cage hid beach fade jig aged bid edge fad")} | {(3, "cage hid beach fade jig aged bid edge fad")}


def test_an_empty_table_gives_no_pieces(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_further_columns_stay_as_they_are(spark, docs, tmp_path):
    """Columns named as those that the operators use inside: each row keeps its own."""
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, str(tmp_path))
        assert after.columns == docs.columns, name
        assert {(r.keep_id, r.part, r.id, r.fp, r.spans) for r in after.collect()} == {(7, 1, 2, 3, "x")}, name


def test_every_operator_is_registered():
    numbers = [int(k[2:].split("_")[0]) for k in queries.queries()]
    assert numbers == list(range(1, 11))
    assert 4 <= len(corpus_pipeline.STAGES) <= 5
