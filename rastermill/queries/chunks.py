"""Queries over hash-addressed chunks."""

from __future__ import annotations

from pyspark.sql import functions as F

from rastermill.fixtures import NOW, Inputs
from rastermill.operators import chunks
from rastermill.registry import query
from rastermill.sources import readers, sinks


def _refs(i: Inputs):
    return i.item_chunks.select(F.col("item_no").alias("item_id"), F.col("tile_no").alias("idx"), F.col("chunk_no").alias("sha"))


def _store(i: Inputs):
    return i.stored.withColumnRenamed("chunk_no", "sha")


REFS = ("item_chunks", "stored")


@query(
    "chunk_availability",
    """SELECT item_no AS item_id, tile_no AS idx, r.chunk_no AS sha, s.chunk_no IS NOT NULL AS local
       FROM item_chunks r LEFT JOIN stored s ON r.chunk_no = s.chunk_no""",
    REFS,
)
def _(i: Inputs):
    return chunks.chunk_availability(_refs(i), _store(i))


@query(
    "missing_chunks",
    "SELECT item_no AS item_id, tile_no AS idx, chunk_no AS sha FROM item_chunks WHERE chunk_no NOT IN (SELECT chunk_no FROM stored)",
    REFS,
)
def _(i: Inputs):
    return chunks.missing_chunks(_refs(i), _store(i))


@query("has_chunk", "SELECT l_partkey AS sha, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT chunk_no FROM stored) GROUP BY 1", ("stored",))
def _(i: Inputs):
    asked = i.lineitem.select(F.col("l_partkey").alias("sha"))
    return chunks.has_chunk(asked, _store(i)).groupBy("sha").agg(F.count(F.lit(1)).alias("n"))


@query("delete_chunks", "SELECT chunk_no AS sha, bytes FROM stored WHERE chunk_no NOT IN (SELECT l_partkey FROM lineitem WHERE l_discount > 0.08)", ("stored",))
def _(i: Inputs):
    doomed = i.lineitem.filter("l_discount > 0.08").select(F.col("l_partkey").alias("sha"))
    return chunks.delete_chunks(_store(i), doomed)[0]


@query(
    "delete_chunks_report",
    "SELECT DISTINCT l_partkey AS sha, l_partkey IN (SELECT chunk_no FROM stored) AS existed FROM lineitem WHERE l_discount > 0.08",
    ("stored",),
)
def _(i: Inputs):
    doomed = i.lineitem.filter("l_discount > 0.08").select(F.col("l_partkey").alias("sha"))
    return chunks.delete_chunks(_store(i), doomed)[1]


@query(
    "items_needed",
    "SELECT item_no AS item_id, count(*) AS chunk_count FROM item_chunks WHERE chunk_no NOT IN (SELECT chunk_no FROM stored) GROUP BY item_no",
    REFS,
)
def _(i: Inputs):
    return chunks.items_needed(chunks.missing_chunks(_refs(i), _store(i)))


@query("orphan_chunks", "SELECT chunk_no AS sha, bytes FROM stored WHERE chunk_no NOT IN (SELECT chunk_no FROM item_chunks)", REFS)
def _(i: Inputs):
    return chunks.orphan_chunks(_store(i), _refs(i))


@query(
    "orphan_summary",
    """SELECT count(*) AS orphaned_chunks, CAST(coalesce(sum(bytes),0) AS BIGINT) AS orphaned_bytes,
              round_even(coalesce(sum(bytes),0) / 1048576.0::DOUBLE, 1) AS orphaned_mb
       FROM stored WHERE chunk_no NOT IN (SELECT chunk_no FROM item_chunks)""",
    REFS,
)
def _(i: Inputs):
    return chunks.orphan_summary(chunks.orphan_chunks(_store(i), _refs(i)))


@query("store_stats",
    """SELECT count(*) AS chunk_count, CAST(sum(bytes) AS BIGINT) AS total_bytes, round_even(sum(bytes)/1073741824.0::DOUBLE, 2) AS used_gb,
              round_even(sum(bytes)/(0.5::DOUBLE*1073741824)*100, 1) AS used_pct FROM stored""", ("stored",))
def _(i: Inputs):
    return chunks.store_stats(_store(i), 0.5)


@query("sink_chunks_put",
    """SELECT sha, min(doc_id) AS doc_id, any_value(bytes) AS bytes FROM chunks
       WHERE sha NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY sha""", ("chunks",))
def _(i: Inputs):
    english = i.chunks.filter("lang = 'en'").select(sinks.content_hash().alias("sha"))
    incoming = i.chunks.select("doc_id", "data", "bytes")
    return sinks.sink_chunks_put(english, incoming, order="doc_id").select("sha", "doc_id", "bytes")


@query("sink_storage_limit",
    """WITH fresh AS (SELECT sha, min(doc_id) AS seq, any_value(bytes) AS bytes FROM chunks
                      WHERE sha NOT IN (SELECT sha256(text) FROM documents WHERE lang = 'en') GROUP BY sha),
       used AS (SELECT sum(bytes) AS used FROM (SELECT DISTINCT sha, bytes FROM chunks WHERE lang = 'en')),
       lim AS (SELECT CAST(floor(used + (SELECT sum(bytes) FROM fresh) * 0.4) AS BIGINT) AS lim FROM used),
       run AS (SELECT sha, seq, bytes, sum(bytes) OVER (ORDER BY seq) AS running FROM fresh)
       SELECT sha, seq, bytes FROM run WHERE running + (SELECT used FROM used) <= (SELECT lim FROM lim)""", ("chunks",))
def _(i: Inputs):
    hashed = i.chunks.select(sinks.content_hash().alias("sha"), "bytes", F.col("doc_id").alias("seq"), "lang")
    store = hashed.filter("lang = 'en'").select("sha", "bytes").distinct()
    other = hashed.join(store.select("sha"), "sha", "left_anti").select("sha", "bytes").distinct()
    used, new = (df.agg(F.sum("bytes")).scalar() for df in (store, other))
    limit = F.floor(used + new * F.lit(0.4))
    return sinks.sink_storage_limit(store, hashed.select("sha", "bytes", "seq"), limit)


@query("sink_volume_gate",
    "SELECT doc_id, bytes FROM chunks WHERE (SELECT sum(bytes) FROM stored) / 1073741824.0 < 1.0", ("chunks", "stored"))
def _(i: Inputs):
    return sinks.sink_volume_gate(_store(i), i.chunks.select("doc_id", "bytes"), 1.0)


@query("src_raw_tiles", "SELECT DISTINCT sha, bytes FROM chunks WHERE source IN (SELECT source FROM documents WHERE lang='en') AND lang='en'", ("chunks",))
def _(i: Inputs):
    stored = i.chunks.withColumn("sha", sinks.content_hash()).dropDuplicates(["sha"]).select("sha", "data", "bytes")
    wanted = i.documents.filter("lang = 'en'").select(F.sha2(F.encode("text", "UTF-8"), 256).alias("sha"))
    return readers.src_raw_tiles(stored, wanted).select("sha", F.octet_length("data").cast("bigint").alias("bytes"))


def _verify_inputs(i: Inputs):
    held = i.chunks.filter("source <> 'src7'").select(F.col("claimed_sha").alias("sha"), "data").dropDuplicates(["sha"])
    refs = i.chunks.select((F.col("doc_id") % 97).alias("item_id"), F.col("claimed_sha").alias("sha"))
    return refs, held


VERIFY = """held AS (SELECT claimed_sha, bool_and(claimed_sha = sha) AS ok FROM chunks WHERE source <> 'src7' GROUP BY claimed_sha),
   v AS (SELECT doc_id % 97 AS item_id, count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS corrupted,
                count(*) FILTER (ok IS NULL) AS missing FROM chunks c LEFT JOIN held h ON c.claimed_sha = h.claimed_sha GROUP BY 1)"""


@query("verify_items", f"WITH {VERIFY} SELECT *, CASE WHEN corrupted + missing = 0 THEN 'OK' ELSE 'FAILED' END AS integrity FROM v", ("chunks",))
def _(i: Inputs):
    return chunks.verify_items(*_verify_inputs(i))


@query("verify_summary",
    f"""WITH {VERIFY} SELECT item_id % 4 AS collection, count(*) AS items, count(*) FILTER (corrupted + missing = 0) AS items_ok,
            CAST(sum(total) AS BIGINT) AS total, CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(corrupted) AS BIGINT) AS corrupted,
            CAST(sum(missing) AS BIGINT) AS missing FROM v GROUP BY 1""", ("chunks",))
def _(i: Inputs):
    verified = chunks.verify_items(*_verify_inputs(i)).withColumn("collection", F.col("item_id") % 4)
    return chunks.verify_summary(verified)


AGED = "aged AS (SELECT chunk_no AS sha, bytes, (chunk_no * 7919) % 1000 AS mtime FROM stored)"


def _aged(i: Inputs):
    return i.stored.select(F.col("chunk_no").alias("sha"), "bytes", (F.col("chunk_no") * 7919 % 1000).alias("mtime"))


@query("evict_oldest",
    f"""WITH {AGED}, run AS (SELECT *, sum(bytes) OVER (ORDER BY mtime, sha) AS running FROM aged)
        SELECT sha, bytes, mtime FROM run WHERE running - bytes < (SELECT sum(bytes) FROM aged) - 2000000""", ("stored",))
def _(i: Inputs):
    return chunks.evict_oldest(_aged(i), 2_000_000)


@query("evict_safe",
    f"""WITH {AGED}, copies AS (SELECT chunk_no AS sha, count(DISTINCT node_no) AS copies FROM placements GROUP BY 1),
        hot AS (SELECT DISTINCT chunk_no AS sha FROM access_log WHERE ts > TIMESTAMP '2024-01-24'),
        ranked AS (SELECT a.sha, bytes, mtime, copies, CASE WHEN h.sha IS NOT NULL THEN 2 WHEN copies = 2 THEN 1 ELSE 0 END AS step
                   FROM aged a JOIN copies c ON a.sha = c.sha LEFT JOIN hot h ON a.sha = h.sha WHERE copies > 1),
        run AS (SELECT *, sum(bytes) OVER (ORDER BY step, mtime, sha) AS running FROM ranked)
        SELECT sha, bytes, mtime, copies, step FROM run WHERE running - bytes < (SELECT sum(bytes) FROM aged) - 2000000""",
    ("stored", "placements", "access_log"))
def _(i: Inputs):
    placements = i.placements.select(F.col("chunk_no").alias("sha"), F.col("node_no").alias("node"))
    log = i.access_log.select(F.col("chunk_no").alias("sha"), "ts")
    return chunks.evict_safe(_aged(i), placements, log, 2_000_000, NOW)


def _sync_inputs(i: Inputs):
    local = i.items.filter("width > 1830 AND collection <> 'landsat-c2-l2'").select("id", "collection")
    remote = i.items.select("id", "collection")
    refs = _refs(i).withColumn("item_id", F.concat(F.lit("item-"), F.col("item_id").cast("string")))
    return local, remote, refs.join(remote.select(F.col("id").alias("item_id")), "item_id", "left_semi")


SYNC = """loc AS (SELECT id, collection FROM items WHERE width > 1830 AND collection <> 'landsat-c2-l2'),
   rem AS (SELECT id, collection FROM items),
   cnt AS (SELECT concat('item-', CAST(item_no AS STRING)) AS id, count(*) AS total, count(*) FILTER (s.chunk_no IS NULL) AS missing
           FROM item_chunks c LEFT JOIN stored s ON c.chunk_no = s.chunk_no GROUP BY 1),
   st AS (SELECT rem.id, rem.collection, coalesce(total,0) AS total, coalesce(missing,0) AS missing,
                 rem.id IN (SELECT id FROM loc) AND coalesce(missing,0) = 0 AS complete FROM rem LEFT JOIN cnt ON rem.id = cnt.id)"""
PLAN = """SELECT collection, collection NOT IN (SELECT collection FROM loc) AS new_collection, count(*) FILTER (NOT complete) AS items,
   CAST(coalesce(sum(missing) FILTER (NOT complete),0) AS BIGINT) AS chunks_missing,
   CAST(sum(CASE WHEN complete THEN total ELSE total - missing END) AS BIGINT) AS chunks_skipped FROM {src} GROUP BY collection"""


@query("sync_plan", f"WITH {SYNC} {PLAN.format(src='st')}", ("items", "item_chunks", "stored"))
def _(i: Inputs):
    local, remote, refs = _sync_inputs(i)
    return chunks.sync_plan(local, _store(i), remote, refs)


@query("sync_plan_limited",
    f"""WITH {SYNC}, cut AS (SELECT collection, id FROM st WHERE NOT complete ORDER BY collection, id LIMIT 1 OFFSET 599),
        seen AS (SELECT *, (SELECT count(*) FROM cut) = 0 OR (collection, id) <= (SELECT (collection, id) FROM cut) AS reached FROM st),
        part_st AS (SELECT id, collection, CASE WHEN reached THEN total ELSE 0 END AS total, CASE WHEN reached THEN missing ELSE 0 END AS missing,
                           complete OR NOT reached AS complete FROM seen)
        {PLAN.format(src='part_st')}""", ("items", "item_chunks", "stored"))
def _(i: Inputs):
    local, remote, refs = _sync_inputs(i)
    return chunks.sync_plan(local, _store(i), remote, refs, max_items=600)


def _apply_inputs(i: Inputs):
    local_chunks = i.chunks.filter("lang <> 'en'").select(F.col("claimed_sha").alias("sha"), "data").dropDuplicates(["sha"])
    remote_chunks = i.chunks.filter("source <> 'src3'").select(F.col("claimed_sha").alias("sha"), "data")
    # a broken copy beside each chunk of every third document
    broken = i.chunks.filter("source <> 'src3' AND doc_id % 3 = 0").select(F.col("claimed_sha").alias("sha"), F.lit(b"broken").alias("data"))
    remote_chunks = broken.unionByName(remote_chunks)
    refs = i.chunks.select((F.col("doc_id") % 97).alias("item_id"), F.col("claimed_sha").alias("sha"))
    remote_items = refs.select(F.col("item_id").alias("id")).distinct().withColumn("origin", F.lit("remote"))
    local_items = i.chunks.filter("lang = 'es'").select((F.col("doc_id") % 97).alias("id"), F.lit("local").alias("origin")).distinct()
    return local_items, local_chunks, remote_items, refs, remote_chunks


APPLY = """loc AS (SELECT DISTINCT claimed_sha AS c FROM chunks WHERE lang <> 'en'),
   rem AS (SELECT claimed_sha AS c, bool_or(claimed_sha = sha) AS ok FROM chunks WHERE source <> 'src3' GROUP BY 1),
   lacking AS (SELECT doc_id % 97 AS item, claimed_sha AS c FROM chunks WHERE claimed_sha NOT IN (SELECT c FROM loc)),
   wanted AS (SELECT DISTINCT c FROM lacking)"""


@query("sync_apply", f"WITH {APPLY} SELECT c AS sha FROM loc UNION ALL SELECT c FROM wanted JOIN rem USING (c) WHERE ok", ("chunks",))
def _(i: Inputs):
    return chunks.sync_apply(*_apply_inputs(i))[1].select("sha")


@query("sync_apply_items",
    f"""WITH {APPLY} SELECT id, CASE WHEN id IN (SELECT doc_id % 97 FROM documents WHERE lang = 'es') AND id NOT IN (SELECT item FROM lacking) THEN 'local' ELSE 'remote' END AS origin
        FROM (SELECT DISTINCT doc_id % 97 AS id FROM documents)""", ("chunks",))
def _(i: Inputs):
    return chunks.sync_apply(*_apply_inputs(i))[0].select("id", "origin")


@query("sync_apply_errors",
    f"""WITH {APPLY} SELECT wanted.c AS sha, CASE WHEN ok IS NULL THEN 'not found' ELSE 'hash mismatch' END AS error
        FROM wanted LEFT JOIN rem ON wanted.c = rem.c WHERE NOT coalesce(ok, FALSE)""", ("chunks",))
def _(i: Inputs):
    return chunks.sync_apply(*_apply_inputs(i))[2]


@query("chunk_map",
    """WITH holders AS (SELECT chunk_no, list_sort(list(DISTINCT node_no)) AS nodes FROM placements GROUP BY 1)
       SELECT item_no AS item_id, tile_no AS idx, r.chunk_no AS sha, coalesce(nodes, []) AS nodes
       FROM item_chunks r LEFT JOIN holders h ON r.chunk_no = h.chunk_no""", ("item_chunks", "placements"))
def _(i: Inputs):
    placements = i.placements.select(F.col("chunk_no").alias("sha"), F.col("node_no").alias("node"))
    return chunks.chunk_map(_refs(i), placements)


BAND_OF = "CASE WHEN item_no % 3 = 0 THEN '*' WHEN tile_no % 2 = 0 THEN 'B04' ELSE 'B08' END"


@query("chunk_map_bands",
    f"""WITH holders AS (SELECT chunk_no, list_sort(list(DISTINCT node_no)) AS nodes FROM placements GROUP BY 1)
       SELECT item_no AS item_id, tile_no AS idx, {BAND_OF} AS band, r.chunk_no AS sha, coalesce(nodes, []) AS nodes
       FROM item_chunks r LEFT JOIN holders h ON r.chunk_no = h.chunk_no WHERE {BAND_OF} IN ('*', 'B04')""", ("item_chunks", "placements"))
def _(i: Inputs):
    placements = i.placements.select(F.col("chunk_no").alias("sha"), F.col("node_no").alias("node"))
    refs = i.item_chunks.selectExpr("item_no AS item_id", "tile_no AS idx", f"{BAND_OF} AS band", "chunk_no AS sha")
    return chunks.chunk_map(refs, placements, ["B04"])


@query("chunk_grid",
    """SELECT id AS item_id, collection, CASE WHEN seq % 3 = 0 THEN 'legacy' ELSE 'band-level' END AS format,
              CASE WHEN seq % 3 = 0 THEN 512 ELSE 256 END AS tile_size, 1 AS tile_cols, CAST(1 + seq % 4 AS INT) AS tile_rows, width,
              CASE WHEN seq % 3 = 0 THEN 3 ELSE 2 END AS total_chunks FROM items""", ("items",))
def _(i: Inputs):
    other = F.col("seq") % 3 != 0
    properties = F.to_json(F.struct(
        F.when(other, "band-level").alias("grid:chunk_format"), F.when(other, 256).alias("grid:tile_size"),
        (1 + F.col("seq") % 4).alias("grid:tile_rows"), F.col("width").alias("grid:width"),
    ))
    hashes = F.when(other, F.lit('{"B04":["a","b"],"B08":["c"]}')).otherwise(F.lit('["a","b","c"]'))
    rows = i.items.select(F.col("id").alias("item_id"), "collection", "datetime", properties.alias("properties_json"), hashes.alias("chunk_hashes_json"))
    grid = chunks.chunk_grid(readers.decode_items(rows), ["B04"])
    return grid.select("item_id", "collection", "format", "tile_size", "tile_cols", "tile_rows", "width", "total_chunks")


@query("validate_report",
    """WITH per AS (SELECT concat('item-', CAST(item_no AS STRING)) AS id, count(s.chunk_no) AS l, count(*) FILTER (s.chunk_no IS NULL) AS m
                    FROM item_chunks c LEFT JOIN stored s ON c.chunk_no = s.chunk_no GROUP BY 1),
       hit AS (SELECT request_id, id FROM aois a JOIN items i ON a.collection = i.collection AND bbox_east >= west AND bbox_west <= east
               AND bbox_north >= south AND bbox_south <= north AND datetime >= date_from AND datetime <= concat(date_to,'T23:59:59')),
       s AS (SELECT request_id, sum(l) AS l, sum(m) AS m FROM hit JOIN per USING (id) GROUP BY 1)
       SELECT request_id, CAST(coalesce(l,0) AS BIGINT) AS local_chunks, CAST(coalesce(m,0) AS BIGINT) AS missing_chunks,
              coalesce(m,0) > 0 AS needs_download FROM aois LEFT JOIN s USING (request_id)""", ("aois", "items", "item_chunks", "stored"))
def _(i: Inputs):
    refs = _refs(i).withColumn("item_id", F.concat(F.lit("item-"), F.col("item_id").cast("string")))
    return chunks.validate_report(i.aois, i.items, refs, _store(i))
