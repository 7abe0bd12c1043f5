from __future__ import annotations

import hashlib
import re

from pyspark.sql import functions as F

from tallyloom.llm import fill_in_middle as fim

UNITS = re.compile(r"[ \t-\r]*[^ \t-\r]+|[ \t-\r]+")


def plain(i, t) -> tuple:
    t = t or ""
    units = UNITS.findall(t)
    n = len(units)
    d = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(d[8 * k : 8 * k + 8], 16) for k in range(4)]
    lo, hi = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
    form = "plain" if not t or any(x in t for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50 else "spm" if h[3] % 100 < 80 else "psm"
    out = {"plain": t, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    chars = (None, None) if form == "plain" else (len(p), len(m))
    return (i, n, form, *chars, sha(out), sha(t))


def check(df, rows):
    assert sorted(map(tuple, fim.fill_in_middle_digests(df).collect()), key=str) == sorted((plain(i, t) for i, t in rows), key=str)


def test_against_plain_cuts(docs, texts):
    check(docs, [(r[0], r[1]) for r in texts])


def test_texts_that_hold_the_delimiter_its_escape_or_markers(spark):
    odd = ["\x01\x02 \x02e \x02d\x01 x", "\x02", "\x01", "a\x02\x02d b\x01e", "x <P> y", "a<S>", "<M>", "a < P> <", "x< <x <", "\x00 \x01", "é b c d", "  lead", "trail \n\t ", " \t", "$0 $1 \\ b"]
    rows = [(i, odd[i % len(odd)]) for i in range(240)]
    check(spark.createDataFrame(rows, "doc_id long, text string"), rows)
    forms = {r.form for r in fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert forms == {"plain", "psm", "spm"}


def test_long_texts_and_rates(spark):
    rows = [(i, "word " * 30_000 + "x" * 100_000) for i in range(4)] + [(i, "　日本 " * 50 + " " * 5000) for i in range(4, 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    check(df, rows)
    assert {r.form for r in fim.fill_in_middle(df, rate=100, spm_rate=0).collect()} == {"psm"}
    assert {r.form for r in fim.fill_in_middle(df, rate=0).collect()} == {"plain"}


def test_restored_from_output_alone(spark):
    rows = [(i, f"a<b c<S d {i} <P e M> <") for i in range(60)]
    found = fim.fill_in_middle(spark.createDataFrame(rows, "doc_id long, text string"), rate=100, spm_rate=50)
    back = {r.doc_id: r.text for r in found.select("doc_id", fim.restored(F.col("output"), F.col("form")).alias("text")).collect()}
    assert back == dict(rows)


def test_no_rows_and_no_python(spark, empty):
    assert fim.fill_in_middle_digests(empty).count() == 0
    plan = fim.fill_in_middle_digests(spark.createDataFrame([(1, "a b")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_columns_that_clash(spark):
    df = spark.createDataFrame([(1, "a b c", 9, "f", "p", "h", 4)], "doc_id long, text string, n int, form string, prefix string, h string, id int")
    check(df, [(1, "a b c")])
