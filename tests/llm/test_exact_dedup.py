import hashlib
import re
from collections import defaultdict

from tallyloom.llm.exact_dedup import exact_dedup


def test_groups_and_survivors_match_a_plain_count(docs, texts):
    got = sorted(map(tuple, exact_dedup(docs, salts=3).collect()), key=str)
    groups = defaultdict(list)
    for i, t, _, _ in texts:
        groups[re.sub(r"[\x20\x09-\x0d]", "", t or "")].append((i, len(t or "")))
    want = []
    for content, rows in groups.items():
        keep = min(rows, key=lambda r: (-r[1], r[0] is None, r[0] or 0))[0]
        want += [(i, keep, len(rows), i == keep, hashlib.sha256(content.encode()).hexdigest()) for i, _ in rows]
    assert got == sorted(want, key=str)


def test_one_hot_content_over_many_partitions(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, concat('x ', id), 'the  same') AS text").repartition(20)
    rows = exact_dedup(df).where("kept").collect()
    assert len(rows) == 1001
    assert {r.group_size for r in rows} == {1, 2000}


def test_empty_table(empty):
    assert exact_dedup(empty).count() == 0


def test_no_python_in_the_plan(docs):
    plan = exact_dedup(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
