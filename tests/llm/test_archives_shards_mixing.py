import base64
import hashlib
from collections import Counter

import edge
import numpy as np
import pytest
from pyspark.sql import functions as F

from quartermark.llm import mixing, sharding, warc


def pages(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate(edge.texts())]
    rows += [(500, None, rows[3][2]), (1, "http://again", rows[1][2]), (None, "u", rows[2][2]), (None, "u", "only nulls"), (None, None, None), (501, "bad\r\nurl: x", "\r\n\r\nWARC/1.1")]
    return spark.createDataFrame([(*r, 0, "x") for r in rows], "page_id long, url string, html string, digest int, first_id string").repartition(3)


def plain_archive(rows, least=0):
    first = {}
    for i, h in rows:
        if i is not None:
            first[h] = min(i, first.get(h, i))
    out = []
    for i, h in rows:
        data = h.encode()
        to = first.get(h) if len(data) >= least and first.get(h) != i else None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if to is None else "revisit", to))
    return Counter(out)


@pytest.mark.parametrize("least, frame, bundle", [(0, 1 << 18, 1 << 26), (100, 300, 200), (0, 1, 1)])
def test_round_trip(spark, monkeypatch, least, frame, bundle):
    monkeypatch.setattr(warc, "FRAME_BYTES", frame)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", bundle)
    p = pages(spark)
    want = plain_archive([(r["page_id"], r["html"] or "") for r in p.collect()], least)
    assert Counter(tuple(r) for r in warc.archive_round_trip(p, least).collect()) == want
    assert warc.archive_round_trip(p.limit(0)).count() == 0


def test_every_record_has_an_id_of_its_own(spark, tmp_path):
    p = pages(spark)
    index = warc.write_archive(warc.plan_records(p), str(tmp_path))
    assert index.select("record_id").distinct().count() == index.count() == p.count()
    assert warc.read_archive(index, str(tmp_path)).count() == p.count()


def test_frames_open_alone_and_the_library_reads_the_bundle(tmp_path):
    import io

    import pyarrow as pa
    import zstandard

    path = tmp_path / "b"
    w = warc.BundleWriter(open(path, "wb"))
    records = [warc.build_record(i, "u", b"x" * 100_000, None, warc.payload_digest(b"x" * 100_000)) for i in range(9)]
    where = [w.add(r) for r in records]
    w.close()
    data = path.read_bytes()
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert whole == b"".join(records)
    with pa.OSFile(str(path)) as f:
        table = warc.seek_table(f)
        assert len(table) == 3
        frame, at, n = where[5]
        f.seek(table[frame][0])
        plain = zstandard.ZstdDecompressor().decompress(f.read(table[frame][1]), max_output_size=table[frame][2])
    assert plain[at: at + n] == records[5]


# --- shards -----------------------------------------------------------------------------

def fingerprint(df, columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def test_compaction_keeps_every_row(spark, tmp_path):
    docs = edge.documents(spark)
    store = sharding.ShardStore(spark, str(tmp_path), target=1 << 20, min_run=2)
    for i in range(5):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(5)) == i).repartition(2))
    assert store.append(docs.limit(0)) == 6
    before = store.shards()
    assert store.compact() == 7 and len(store.shards()) < len(before)
    assert fingerprint(store.read(), docs.columns) == fingerprint(docs, docs.columns)
    assert sum(s.rows for s in store.shards()) == docs.count()
    assert store.compact() == 7 or sum(s.rows for s in store.shards()) == docs.count()


def test_versions_stay_readable_until_they_expire(spark, tmp_path):
    docs = edge.documents(spark)
    store = sharding.ShardStore(spark, str(tmp_path), target=1 << 20, min_run=2)
    for i in range(4):
        store.append(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) == i))
    held = store.read(4)
    assert store.compact() == 5
    assert held.count() == store.read(4).count() == store.read(5).count() == docs.count()
    assert fingerprint(store.read(2), docs.columns) == fingerprint(docs.where(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(4)) < 2), docs.columns)
    assert store.expire(2) == 0 and store.read(4).count() == docs.count()
    assert store.expire(1) > 0 and store.shards(5) == store.shards()
    assert fingerprint(store.read(), docs.columns) == fingerprint(docs, docs.columns)
    assert not (tmp_path / "manifest" / "v00000004.json").exists()


def test_compaction_of_an_empty_table(spark):
    docs = edge.documents(spark)
    store = sharding.compact_arrivals(docs.limit(0))
    rows = store.read()
    assert rows.count() == 0 and rows.columns[:-1] == docs.columns and store.compact() == store.version() == 4


def test_arrivals_of_one_pass_are_versions_of_their_own(spark, tmp_path):
    docs = edge.documents(spark)
    store = sharding.ShardStore(spark, str(tmp_path))
    part = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(3)).cast("int")
    assert store.append_each(docs, part, 3) == 3
    for i in range(3):
        assert fingerprint(store.read(i + 1), docs.columns) == fingerprint(docs.where(part <= i), docs.columns)


def test_two_writers_cannot_take_one_version(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path))
    store.commit([], 0)
    with pytest.raises(Exception, match="(?i)exist"):
        store.commit([], 0)
    assert store.version() == 1


def test_plan_merges_runs_of_similar_size():
    def shard(i, size):
        return sharding.Shard(f"s{i:03d}", 1, size, sharding.tier_of(size))

    small = [shard(i, 1 << 17) for i in range(40)]
    large = [shard(100 + i, 1 << 25) for i in range(9)]
    runs = sharding.plan_runs(small + large + [shard(200, 1 << 22)], 1 << 22, 4)
    merged = [s.path for r in runs for s in r]
    assert len(merged) == len(set(merged)) and set(merged) <= {s.path for s in small}
    assert all(sum(s.bytes for s in r) <= (1 << 22) + (1 << 17) for r in runs)
    assert sharding.plan_runs(small[:3], 1 << 22, 4) == []


# --- mixing -----------------------------------------------------------------------------

def test_mixing_on_awkward_rows(spark):
    docs = edge.documents(spark)
    labelled = mixing.labelled_domains(docs, edge.labels(spark))
    mixed, f = mixing.with_rates(docs, labelled, keep_text=True)
    rows = mixed.collect()
    assert len(rows) == docs.count() and set(mixed.columns) == {*docs.columns, f}
    for r in rows:
        v = r[f]
        assert v["rate"] >= 0 and v["copies"] in (int(v["rate"]), int(v["rate"]) + 1)
        assert v["n_tokens"] == len([w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", r["text"] or "")])
    assert mixing.with_rates(docs.limit(0), labelled)[0].count() == 0
    assert mixing.with_rates(docs, labelled.limit(0))[0].count() == docs.count()


def test_posteriors_know_the_language(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    labelled = mixing.labelled_domains(docs, spark.read.parquet(f"{d}/labels.parquet"))
    mixed, f = mixing.with_rates(docs, labelled)
    at = {x: i for i, x in enumerate(mixing.TARGETS)}
    got = [(r["lang"], r[f]["posterior"], r[f]["rate"], r[f]["n_tokens"]) for r in mixed.collect()]
    right = np.mean([np.argmax(p) == at[x] for x, p, _, _ in got])
    total = sum(n for *_, n in got)
    shares = [sum(r * n * p[i] / sum(p) for _, p, r, n in got) / total for i in at.values()]
    print("accuracy", right, "shares", shares)
    assert right > 0.9 and np.allclose(shares, list(mixing.TARGETS.values()), rtol=0.02)
