"""The stored listings table: its rows against a plain loop, and how its rows are shuffled."""

import datetime as dt
import random

from playbill.plans import td


def tables(spark, folder, seed=4):
    rnd = random.Random(seed)
    day = lambda i: dt.datetime(1998, 1, 1) + dt.timedelta(days=i)
    data = {
        "nation": ([(i, f"LAND {i}", 0) for i in range(25)], "n_nationkey int, n_name string, n_regionkey int"),
        "customer": ([(i, f"C{i}", i % 25, "BUILDING") for i in range(12)], "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string"),
        "supplier": ([(i, f"S{i % 3}") for i in range(6)] + [(0, "S9"), (7, None)], "s_suppkey bigint, s_name string"),
        "part": ([(i, f"name {i % 4}", f"type {i}", f"B{i % 2}") for i in range(8)] + [(2, "another", None, "B7")], "p_partkey bigint, p_name string, p_type string, p_brand string"),
        "orders": ([(i, rnd.randrange(12), "OFP"[i % 3], 100.0 * i, day(rnd.randrange(90)), "5-LOW") for i in range(1, 40)] + [(3, 1, "O", 9.0, day(2), "5-LOW")],
                   "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string"),
        # Some lines name parts or suppliers that do not exist, some none.
        "lineitem": ([(rnd.choice([*range(1, 36), None]), rnd.choice([*range(10), None]), rnd.choice([*range(9), None])) for _ in range(160)], "l_orderkey bigint, l_partkey bigint, l_suppkey bigint"),
    }
    for name, (rows, schema) in data.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return {name: rows for name, (rows, _) in data.items()}


def test_orders_are_put_together_in_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    data = tables(spark, tmp_path)
    monkeypatch.setattr(td, "TASK_LINES", 10)
    stored = td.layout(td.td(spark, str(tmp_path)))
    plan = stored._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "hashpartitioning(l_orderkey" in plan and ", 17), REPARTITION_BY_NUM" in plan
    want = []
    for key, *_ in data["orders"]:
        lines = [(p, s) for k, pk, sk in data["lineitem"] if k == key for p in data["part"] if p[0] == pk for s in data["supplier"] if s[0] == sk]
        least = lambda values: min((v for v in values if v is not None), default="")
        want.append((key, least(p[1] for p, _ in lines), least(p[2] for p, _ in lines), sorted({s[1] for _, s in lines} - {None})))
    got = [(r.ingest_ord, r.title, r.category, r.source_names) for r in stored.collect()]
    assert sorted(got) == sorted(want) and any(len(r[3]) > 2 for r in got) and len(got) == 40


def test_the_stored_table_has_all_rows_and_their_last_day(spark, tmp_path):
    tables(spark, tmp_path)
    got = td.listings(spark, str(tmp_path), with_last=True)
    assert sorted(r.ingest_ord for r in got.collect()) == sorted([*range(1, 40), 3])
    assert got.filter("last_date IS DISTINCT FROM greatest(start_date, coalesce(end_date, start_date))").isEmpty()
