"""The query over hosts rejects bad hosts, and failing documents of hosts that are not trusted."""

from __future__ import annotations

import duckdb

from cairnfield.llm import host_rules


def test_a_watched_rule_rejects_the_document_unless_its_host_is_trusted(spark, tmp_path):
    good = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    bad = lambda k: "# " * 60 + good(k)
    rows = [(i, bad(i), "spam") for i in range(60)] + [(1_000 + i, good(i), f"g{i % 6}") for i in range(300)]
    rows += [(5_000, bad(7), "tiny"), (5_001, good(1), None), (5_002, bad(8), None)]
    rows += [(9_000 + i, good(i), "vast") for i in range(600)] + [(8_000, bad(3), "vast")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = {r["doc_id"]: r for r in host_rules.op10_host_rules(spark, str(tmp_path)).collect()}
    assert not any(r["base_failed"] for r in out.values())
    assert all(out[i]["host_failed"] and not out[i]["kept"] for i in range(60))
    # One failure: a fluke on a trusted host, a fault where little is known, though that host is not rejected.
    assert out[8_000]["kept"] and not out[8_000]["doc_failed"]
    for i in (5_000, 5_002):
        assert out[i]["doc_failed"] and not out[i]["kept"] and not out[i]["host_failed"]
    assert out[5_001]["kept"] and all(out[1_000 + i]["kept"] for i in range(300))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    said = con.execute(f"select doc_id, host_failed, doc_failed, kept from ({host_rules.ORACLE_SQL})").fetchall()
    assert sorted(said) == sorted((i, r["host_failed"], r["doc_failed"], r["kept"]) for i, r in out.items())


def test_a_host_with_most_documents_can_be_bad(spark, tmp_path):
    good = lambda k: " ".join(f"w{k}x{i}" for i in range(80))
    rows = [(i, "# " * 70 + good(i), "spam") for i in range(600)] + [(1_000 + i, good(i), f"g{i % 6}") for i in range(300)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    out = host_rules.op10_host_rules(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out if r["host_failed"]} == set(range(600))
