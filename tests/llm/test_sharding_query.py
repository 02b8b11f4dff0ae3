"""The sharding query against the table it read and the files it wrote."""

import hashlib
from collections import Counter, defaultdict

import edge
import pyarrow.parquet as pq

from quartermark.llm import queries, sharding
from quartermark.llm.queries import table

SF = "/root/testdata/sf0.01"


def test_every_column_of_the_query(spark, monkeypatch):
    held = []
    plain = sharding.compact_arrivals
    monkeypatch.setattr(sharding, "compact_arrivals", lambda *a, **k: held.append(plain(*a, **k)) or held[0])
    got = queries.op9_sharding(spark, SF).collect()
    want = {r["doc_id"]: (r["text"] or "").encode() for r in table(spark, SF, "documents").collect()}
    assert Counter(r["doc_id"] for r in got) == Counter(want.keys())
    assert all(r["n_bytes"] == len(want[r["doc_id"]]) and r["text_md5"] == hashlib.md5(want[r["doc_id"]]).hexdigest() for r in got)

    store, files = held[0], defaultdict(list)
    for r in got:
        files[r["shard"]].append(r)
    on_disk = {p.getPath().toUri().getPath().split("/data/")[-1]: (p.getPath().toUri().getPath(), p.getLen()) for p in store._listed(f"{store.folder}/data")}
    for name, rows in files.items():
        path, size = on_disk[name]
        assert {(r["shard_rows"], r["shard_bytes"], r["tier"]) for r in rows} == {(len(rows), size, sharding.tier_of(size))}
        assert sorted(pq.ParquetFile(path).read(columns=["doc_id"])["doc_id"].to_pylist()) == sorted(r["doc_id"] for r in rows)
    # four arrivals, and a version that merges what there is to merge
    merged = bool(sharding.plan_runs(store.shards(4), store.target, store.min_run))
    assert {r["version"] for r in got} == {4 + merged} and len(store.shards(4)) >= 4
    assert {s.path.split("/data/")[-1] for s in store.shards()} == set(files)
    assert sharding.plan_runs(store.shards(), store.target, store.min_run) == []


def test_arrivals_are_the_rows_of_their_hash(spark):
    store = sharding.compact_arrivals(table(spark, SF, "documents").select("doc_id", "text"))
    dealt = Counter(r[0] for r in spark.sql(f"select pmod(xxhash64(doc_id), 4) from parquet.`{SF}/documents.parquet`").collect())
    sizes = [sum(s.rows for s in store.shards(v)) for v in range(5)]
    assert [b - a for a, b in zip(sizes, sizes[1:], strict=False)] == [dealt[i] for i in range(4)]


def test_extra_columns_with_clashing_names(spark):
    docs = edge.documents(spark)
    clashing = docs.selectExpr("*", "1 as __qm_slot", "2 as __QM_shard", "3 as path", "4 as rows", "5 as __qm_arrival")
    rows = sharding.compact_arrivals(clashing).read()
    assert rows.columns[:-1] == clashing.columns

    def bag(df):
        return Counter(map(repr, df.select(clashing.columns).collect()))

    assert bag(rows) == bag(clashing)
