"""Chunk store operators on small hand-made chunks."""

import hashlib
import json

from pyspark.sql import functions as F

from rastermill.operators import chunks
from rastermill.sources import readers, sinks


def sha(data):
    return hashlib.sha256(data).hexdigest()


def blobs(spark, *data):
    return spark.createDataFrame([(bytearray(d), len(d), k) for k, d in enumerate(data)], "data binary, bytes bigint, seq bigint")


def store_of(spark, *data):
    return spark.createDataFrame([(sha(d), bytearray(d), len(d)) for d in data], "sha string, data binary, bytes bigint")


def shas(df, column="sha"):
    return sorted(r[0] for r in df.select(column).collect())


def test_put_hashes_and_deduplicates(spark):
    put = sinks.sink_chunks_put(store_of(spark, b"known"), blobs(spark, b"hello", b"hello", b"known", b"other"), order="seq")
    assert shas(put) == sorted([sha(b"hello"), sha(b"other")])
    assert put.filter(F.col("sha") == sha(b"hello")).first().seq == 0
    assert all(len(s) == 64 for s in shas(put))


def test_put_twice_adds_nothing(spark, tmp_path):
    path = str(tmp_path / "chunks")
    first = sinks.sink_chunks_put(store_of(spark), blobs(spark, *[b"chunk-%d" % k for k in range(5)]))
    sinks.write_chunks(first.select("sha", "data", "bytes"), path)
    stored = spark.read.parquet(path)
    assert stored.count() == 5
    assert sinks.sink_chunks_put(stored, blobs(spark, b"chunk-1", b"chunk-2")).count() == 0
    assert readers.src_raw_tiles(stored, stored.limit(0)).count() == 0
    row = readers.src_raw_tiles(stored, spark.createDataFrame([(sha(b"chunk-3"),), ("0" * 64,)], "sha string")).collect()
    assert [bytes(r.data) for r in row] == [b"chunk-3"]


def test_store_stats(spark):
    row = chunks.store_stats(store_of(spark, b"x" * 10, b"y" * 5), limit_gb=15 * 2 / 1024**3).first()
    assert (row.chunk_count, row.total_bytes, row.used_pct) == (2, 15, 50.0)
    empty = chunks.store_stats(store_of(spark).limit(0)).first()
    assert (empty.chunk_count, empty.total_bytes, empty.used_pct) == (0, 0, 0.0)


def test_limit_accepts_a_prefix(spark):
    incoming = spark.createDataFrame([("a", 512, 0), ("b", 1024, 1), ("c", 10, 2), ("a", 512, 3)], "sha string, bytes bigint, seq bigint")
    store = store_of(spark).limit(0)
    assert shas(sinks.sink_storage_limit(store, incoming, int(0.000001 * 1024**3))) == ["a"]
    assert shas(sinks.sink_storage_limit(store, incoming, 1536)) == ["a", "b"]
    assert shas(sinks.sink_storage_limit(store, incoming, 0)) == ["a", "b", "c"]


def test_volume_gate(spark):
    store = spark.createDataFrame([("a", 1024**3)], "sha string, bytes bigint")
    incoming = blobs(spark, b"x")
    assert sinks.sink_volume_gate(store, incoming, 1.0).count() == 0
    assert sinks.sink_volume_gate(store, incoming, 1.1).count() == 1


def test_tampered_chunk_is_found(spark):
    held = spark.createDataFrame([(sha(b"good"), bytearray(b"good")), (sha(b"original"), bytearray(b"tampered!"))], "sha string, data binary")
    refs = spark.createDataFrame(
        [("ok", sha(b"good")), ("ok", sha(b"good")), ("bad", sha(b"good")), ("bad", sha(b"original")), ("gone", sha(b"missing"))], "item_id string, sha string"
    )
    got = {r.item_id: tuple(r)[1:] for r in chunks.verify_items(refs, held).collect()}
    assert got == {"ok": (2, 2, 0, 0, "OK"), "bad": (2, 1, 1, 0, "FAILED"), "gone": (1, 0, 0, 1, "FAILED")}


def test_delete_reports(spark):
    store = store_of(spark, b"a", b"b")
    kept, report = chunks.delete_chunks(store, spark.createDataFrame([(sha(b"a"),), ("no",)], "sha string"))
    assert shas(kept) == [sha(b"b")]
    assert {r.sha: r.existed for r in report.collect()} == {sha(b"a"): True, "no": False}


def test_evict_oldest_stops_at_target(spark):
    df = spark.createDataFrame([("a", 10, 1), ("b", 10, 2), ("c", 10, 3)], "sha string, bytes bigint, mtime bigint")
    assert shas(chunks.evict_oldest(df, 30)) == []
    assert shas(chunks.evict_oldest(df, 29)) == ["a"]
    assert shas(chunks.evict_oldest(df, 10)) == ["a", "b"]
    assert shas(chunks.evict_oldest(df, 0)) == ["a", "b", "c"]


def test_evict_safe_keeps_sole_copies(spark):
    df = spark.createDataFrame([(c, 10, k) for k, c in enumerate("abcde")], "sha string, bytes bigint, mtime bigint")
    placements = spark.createDataFrame(
        [("b", 1), ("b", 2), ("c", 1), ("c", 2), ("c", 3), ("d", 1), ("d", 2), ("d", 3), ("e", 1)], "sha string, node bigint"
    )
    log = spark.sql("SELECT 'c' AS sha, TIMESTAMP_NTZ '2024-01-30 00:00:00' AS ts")
    evict = lambda target: shas(chunks.evict_safe(df, placements, log, target, "2024-01-31 00:00:00"))
    assert evict(40) == ["d"]
    assert evict(30) == ["b", "d"]
    assert evict(0) == ["b", "c", "d"]  # a and e exist once


def test_sync_is_complete_after_one_run(spark):
    remote_chunks = store_of(spark, b"1", b"2", b"3").select("sha", "data").unionByName(
        spark.createDataFrame([(sha(b"4"), bytearray(b"broken"))], "sha string, data binary")
    )
    refs = spark.createDataFrame(
        [("x", sha(b"1")), ("x", sha(b"2")), ("y", sha(b"3")), ("z", sha(b"4")), ("z", sha(b"5"))], "item_id string, sha string"
    )
    items = spark.createDataFrame([("x", "s2"), ("y", "s2"), ("z", "new")], "id string, collection string")
    local_items = spark.createDataFrame([("x", "s2"), ("mine", "s2")], "id string, collection string")
    local_chunks = store_of(spark, b"1", b"2").select("sha", "data")
    plan = {r.collection: tuple(r)[1:] for r in chunks.sync_plan(local_items, local_chunks, items, refs).collect()}
    assert plan == {"s2": (False, 1, 1, 2), "new": (True, 1, 2, 0)}
    only = chunks.sync_plan(local_items, local_chunks, items, refs, collections=["new"]).collect()
    assert [r.collection for r in only] == ["new"]
    first = chunks.sync_plan(local_items, local_chunks, items, refs, max_items=1).collect()
    assert sorted(tuple(r) for r in first) == [("new", True, 1, 2, 0), ("s2", False, 0, 0, 0)]  # what comes after the stop keeps its row

    # a broken copy beside a good one, on either side of it, loses nothing
    bad = spark.createDataFrame([(sha(b"3"), bytearray(b"broken"))], "sha string, data binary")
    for offered in (bad.unionByName(remote_chunks), remote_chunks.unionByName(bad)):
        _, kept, wrong = chunks.sync_apply(local_items, local_chunks, items, refs, offered)
        assert shas(kept) == sorted([sha(b"1"), sha(b"2"), sha(b"3")]) and sha(b"3") not in shas(wrong)
    after_items, after_chunks, errors = chunks.sync_apply(local_items, local_chunks, items, refs, remote_chunks)
    assert shas(after_chunks) == sorted([sha(b"1"), sha(b"2"), sha(b"3")])
    assert {r.sha: r.error for r in errors.collect()} == {sha(b"4"): "hash mismatch", sha(b"5"): "not found"}
    assert shas(after_items, "id") == ["mine", "x", "y", "z"]
    good = refs.filter("item_id <> 'z'")
    _, again, no_errors = chunks.sync_apply(after_items, after_chunks, items, good, remote_chunks)
    assert again.count() == 3 and no_errors.count() == 0


def test_orphans_and_keepers_make_the_store(spark):
    store = store_of(spark, b"a", b"b", b"c")
    refs = spark.createDataFrame([("x", sha(b"a")), ("y", sha(b"a"))], "item_id string, sha string")
    orphans = chunks.orphan_chunks(store, refs)
    kept = chunks.has_chunk(store.select("sha"), refs)
    assert shas(orphans.select("sha").unionByName(kept)) == shas(store)
    assert chunks.orphan_summary(orphans).first().orphaned_bytes == 2


def test_chunk_refs_and_map(spark):
    items = spark.createDataFrame([("i", {"B04": ["s1", "s2"], "B08": ["s3"]})], "item_id string, chunk_hashes map<string,array<string>>")
    placements = spark.createDataFrame([("s1", 2), ("s1", 1), ("s1", 2)], "sha string, node bigint")
    got = {(r.band, r.idx): (r.sha, r.nodes) for r in chunks.chunk_map(chunks.chunk_refs(items), placements, ["B04"]).collect()}
    assert got == {("B04", 0): ("s1", [1, 2]), ("B04", 1): ("s2", [])}
    whole = spark.createDataFrame([("i", {"*": ["s1", "s3"]})], "item_id string, chunk_hashes map<string,array<string>>")
    assert shas(chunks.chunk_map(chunks.chunk_refs(whole), placements, ["B04"])) == ["s1", "s3"]


def test_upsert_last_write_wins(spark):
    stored = spark.createDataFrame([("a", "x", 0), ("b", "x", 0)], "id string, collection string, version bigint")
    updates = spark.createDataFrame([("a", "y", 1), ("a", "z", 2), ("c", "new", 1)], "id string, collection string, version bigint")
    items, collections = sinks.sink_items_upsert(stored, updates, spark.createDataFrame([("x",)], "id string"))
    assert {r.id: r.collection for r in items.collect()} == {"a": "z", "b": "x", "c": "new"}
    assert shas(collections, "id") == ["new", "x", "y", "z"]


def test_catalogue_row_decoding(spark):
    rows = spark.createDataFrame(
        [("a", "2024-01-01T00:00:00Z", '{"grid:width": 10, "grid:band_names": ["B04"], "datetime": "x"}', '["h1","h2"]'), ("b", "", "{}", '{"B04":["h3"]}')],
        "id string, datetime string, properties_json string, chunk_hashes_json string",
    )
    a, b = readers.decode_items(rows).orderBy("id").collect()
    assert a.properties.width == 10 and a.properties.band_names == ["B04"] and a.chunk_hashes == {"*": ["h1", "h2"]}
    assert b.chunk_hashes == {"B04": ["h3"]} and b.dt is None and a.dt is not None


def test_stored_geometry_assets_and_other_properties_come_back(spark):
    stored = spark.createDataFrame(
        [("a", "c", 1.0, 2.0, 3.0, 4.0, "2024", '{"type":"Point","coordinates":[1.5,2.5]}', '{"B04":{"href":"x"}}', '{"datetime":"2024","grid:width":10,"eo:cloud_cover":7.5,"note":"grid:5"}', "[]"),
         ("b", "c", 1.0, 2.0, 3.0, 4.0, "2024", None, None, None, None)],
        "id string, collection string, bbox_west double, bbox_south double, bbox_east double, bbox_north double, datetime string, geometry string, assets string, properties_json string, chunk_hashes_json string",
    )
    documents = sinks.sink_stac_json(readers.decode_items(stored)).select(F.col("json").alias("value"))
    a, b = readers.decode_stac(documents).orderBy("id").collect()
    assert json.loads(a.geometry) == {"type": "Point", "coordinates": [1.5, 2.5]} and json.loads(a.assets) == {"B04": {"href": "x"}}
    assert a.properties.width == 10 and {k: v.toPython() for k, v in a.other_properties.items()} == {"eo:cloud_cover": 7.5, "note": "grid:5"}
    assert json.loads(b.geometry)["type"] == "Polygon" and json.loads(b.assets) == {}
    assert '"license":' in sinks.collection_json(spark.createDataFrame([("c",)], "id string")).first().json


def test_stac_round_trip(spark, tmp_path):
    items = spark.createDataFrame(
        [("a", "c", 1.0, 2.0, 3.0, 4.0, "2024", {"B04": ["h"]})],
        "id string, collection string, bbox_west double, bbox_south double, bbox_east double, bbox_north double, datetime string, chunk_hashes map<string,array<string>>",
    )
    sinks.write_json_documents(sinks.sink_replica_export(items, "c"), str(tmp_path / "out"))
    back = readers.src_stac_json(spark, str(tmp_path / "out")).first()
    assert (back.id, back.collection, back.bbox_north, back.datetime, back.chunk_hashes) == ("a", "c", 4.0, "2024", {"B04": ["h"]})
    assert "chunk_hashes" not in sinks.sink_stac_json(items).first().json
    assert '"extent":{"spatial"' in sinks.collection_json(spark.createDataFrame([("c",)], "id string")).first().json


def test_chunk_files(spark, tmp_path):
    name = sha(b"data")
    folder = tmp_path / name[:2] / name[2:4]
    folder.mkdir(parents=True)
    (folder / name).write_bytes(b"data")
    (folder / "note.txt").write_bytes(b"no chunk")
    assert [(r.sha, bytes(r.data), r.bytes) for r in readers.read_chunk_files(spark, str(tmp_path)).collect()] == [(name, b"data", 4)]


def test_audit_tail(spark, tmp_path):
    path = str(tmp_path / "audit")
    entries = spark.createDataFrame([("1", "ingest", "x", "ip", True), ("2", "auth_fail", "y", "ip", False)], "ts string, action string, detail string, ip string, ok boolean")
    sinks.sink_audit_append(entries, path)
    spark.createDataFrame([("not json",)], "value string").write.mode("append").text(path)
    assert [(r.action, r.ok) for r in readers.src_audit(spark, path).collect()] == [("auth_fail", False), ("ingest", True)]
    assert readers.src_audit(spark, path, 1).count() == 1
