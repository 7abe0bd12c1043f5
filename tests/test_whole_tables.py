"""Queries whose result must cover the whole of their tables, over tables made here."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.plans import registry


def _part(spark, sf_dir, n):
    spark.range(1, n + 1).selectExpr("id AS p_partkey", "'part' AS p_name", "'Brand#1' AS p_brand", "'TYPE' AS p_type", "CAST(1 AS INT) AS p_size").write.parquet(f"{sf_dir}/part.parquet")


def test_candidates_cover_every_place(spark, tmp_path):
    n = 1_040
    _part(spark, tmp_path, n)
    best = {r.place_id: r for r in registry.queries()["candidate_best"](spark, str(tmp_path)).collect()}
    assert sorted(best) == list(range(1, n + 1))
    # of four places that follow each other one has the id of the first, if that has one
    assert all(best[k].candidate_id == f"k{k}" for k in range(1_000, n - 3) if k % 5)
    status = {r.place_id: r.status for r in registry.queries()["candidate_status"](spark, str(tmp_path)).collect()}
    assert sorted(status) == list(range(1, n + 1))
    assert all(status[k] == "pass" for k in range(1_000, n - 3) if k % 5)


def _visits(spark, sf_dir, visits):
    """visits: (source, place, date, discount); every source has an order, and a path unless its id % 4 = 1."""
    rows = [(s, k, p, 1, d, 100.0, 10.0, "A", "F", x) for k, (s, p, d, x) in enumerate(visits, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_shipdate string, l_extendedprice double, l_quantity double, l_returnflag string, l_linestatus string, l_discount double").withColumn("l_shipdate", F.to_date("l_shipdate")).write.parquet(f"{sf_dir}/lineitem.parquet")
    orders = sorted({v[0] for v in visits})
    spark.createDataFrame([(s, 1, "p", "2000-01-01", "O") for s in orders], "o_orderkey long, o_custkey long, o_orderpriority string, o_orderdate string, o_orderstatus string").write.parquet(f"{sf_dir}/orders.parquet")


def test_markers_count_visits_of_any_date(spark, tmp_path):
    _part(spark, tmp_path, 12)
    # place 4: an old visit without a path; 11: old visits of low confidence; 12: a good new one and a bad old one
    _visits(spark, tmp_path, [(1, 4, "1995-05-05", 0.0), (2, 11, "1995-05-05", 0.1), (3, 11, "1999-01-01", 0.08), (4, 12, "2001-05-05", 0.0), (6, 12, "1996-05-05", 0.12)])
    reasons = {r.place_id: r.audit_reasons.split(";") for r in registry.queries()["audit_status"](spark, str(tmp_path)).collect()}
    assert "missing_storage_path" in reasons[4] and "low_avg_confidence" not in reasons[4]
    assert "low_avg_confidence" in reasons[11] and "low_avg_confidence" in reasons[12]
    top = {r.reason: r.n for r in registry.queries()["reason_topk"](spark, str(tmp_path)).collect()}
    assert top["missing_storage_path"] == 1 and top["low_avg_confidence"] == 2


def test_gates_read_the_visits_of_every_batch(spark, tmp_path):
    _part(spark, tmp_path, 12)
    _visits(spark, tmp_path, [(s, 3, "2001-01-01", 0.0) for s in (2, 3, 4, 6, 7)] + [(5, 4, "2001-01-01", 0.0), (10, 4, "2001-01-01", 0.2)])
    orders = spark.read.parquet(f"{tmp_path}/orders.parquet")
    orders.union(orders.where("o_orderkey = 2").withColumn("o_orderkey", F.lit(8).cast("long"))).write.parquet(f"{tmp_path}/more.parquet")  # 8: a batch without visits
    (tmp_path / "orders.parquet").rename(tmp_path / "fewer.parquet")
    (tmp_path / "more.parquet").rename(tmp_path / "orders.parquet")
    codes = {}
    for r in registry.queries()["quality_gates"](spark, str(tmp_path)).collect():
        codes.setdefault(r.batch_id, set()).add(r.code)
    assert {b for b, c in codes.items() if "zero_normalized_visits" in c} == {8}
    assert "missing_storage_path" in codes[5] and "low_average_confidence" in codes[10] and codes[4] == {"quality_pass"}
    decided = {r.batch_id: r.decision for r in registry.queries()["gate_policy_fail"](spark, str(tmp_path)).collect()}
    assert decided == {b: "load" if b < 5 else "stopped" for b in codes}


def test_points_in_squares_count_every_place(spark, tmp_path):
    _part(spark, tmp_path, 30)
    counted = sum(r.n for r in registry.queries()["poi_pip_counts"](spark, str(tmp_path)).collect())
    # at 33 + id * 5e-3, 126 + id * 28e-3: in square 0 up to id 21, but for ids whose coordinates are missing
    assert counted == len([k for k in range(1, 22) if k % 11 != 2])


def test_upserts_keep_every_old_row(spark, tmp_path):
    _part(spark, tmp_path, 1_520)
    places = registry.queries()["upsert_place"](spark, str(tmp_path)).collect()
    assert sorted(r.id for r in places if r.id is not None) == list(range(1, 1_521))
    assert {r.id for r in places if r.name.startswith("upd ") and r.id} >= {k for k in range(1_500, 1_521) if k % 3 == 0 and k % 4}
    _visits(spark, tmp_path, [(s, 3, "2001-01-01", 0.0) for s in range(2, 12)])  # visit ids 21, 32, 43, ..., 120
    sources = registry.queries()["upsert_source"](spark, str(tmp_path)).collect()
    assert {r.hash: r.title for r in sources} == {f"h{s}": "new" if s % 5 < 2 else "old" for s in range(2, 12)}
    visits = registry.queries()["upsert_visit"](spark, str(tmp_path)).collect()
    ids = [s * 10 + k for k, s in enumerate(range(2, 12), 1)]
    assert {r.visit_id: r.party_size for r in visits if r.department_name} == {v: 2 if v % 3 == 0 else 1 for v in ids if v % 10 != 7 and v != 87}


def test_upsert_agency_keeps_every_old_row(spark, tmp_path):
    spark.createDataFrame([(k, "Supplier#00000000" + str(k), k) for k in (1, 2, 3, 5)], "s_suppkey long, s_name string, s_nationkey long").write.parquet(f"{tmp_path}/supplier.parquet")
    spark.createDataFrame([(k, f"N{k}", 0) for k in (1, 2, 3, 5)], "n_nationkey long, n_name string, n_regionkey long").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(0, "R")], "r_regionkey long, r_name string").write.parquet(f"{tmp_path}/region.parquet")
    got = registry.queries()["upsert_agency"](spark, str(tmp_path)).collect()
    assert {r.region: r.v for r in got} == {"N1": 1, "N2": 2, "N3": -3, "N5": 5}


def test_every_region_has_a_colour(spark, tmp_path):
    # five values: ranks 0, 1/4, ... 1, of which 1/4 and 3/4 give the lightness 73.5 and 48.5
    rows = [(k, 1, 100.0 * k, "BUILDING") for k in (1, 2, 4, 5, 7)]
    spark.createDataFrame(rows, "c_custkey long, c_nationkey long, c_acctbal double, c_mktsegment string").write.parquet(f"{tmp_path}/customer.parquet")
    got = registry.queries()["lens_colours"](spark, str(tmp_path)).where("metric_key = 'BUILDING'").collect()
    assert [r.colour for r in sorted(got, key=lambda r: int(r.adm_cd))] == [f"hsl(173,58%,{x}%)" for x in (86, 74, 61, 48, 36)]


def test_orphans_have_no_visit_of_any_date(spark, tmp_path):
    _part(spark, tmp_path, 8)
    _visits(spark, tmp_path, [(1, 3, "1993-01-01", 0.0), (2, 4, "2001-09-09", 0.0)])
    ids = lambda name: sorted(r.id for r in registry.queries()[name](spark, str(tmp_path)).collect())
    assert ids("orphan_places") == [1, 2, 5, 6, 7, 8]
    assert ids("orphan_delete") == [1, 3, 4, 5, 7]  # of the orphans with even ids none stays
