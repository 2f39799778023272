"""Domain tables derived from the generic test tables.

Every derivation is one SELECT. Most are written in the dialect both Spark SQL
and DuckDB understand, so the same text feeds the library and the SQL twin.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()

# the moment the registries and logs are evaluated at: 2024-01-31T00:00:00Z
NOW_SECONDS = 1706659200
NOW = "2024-01-31 00:00:00"


def _collection(column: str) -> str:
    return (
        f"CASE {column} % 4 WHEN 0 THEN 'sentinel-2-l2a' WHEN 1 THEN 'sentinel-1-grd' "
        "WHEN 2 THEN 'landsat-c2-l2' ELSE 'sentinel-2-l2a_derived' END"
    )


PORTABLE = {
    "items": f"""
        SELECT concat('item-', CAST(o_orderkey AS STRING)) AS id, {_collection('o_custkey')} AS collection,
               CAST((o_custkey*37) % 3500 AS DOUBLE)/10 - 175 AS bbox_west,
               CAST((o_orderkey*13) % 1600 AS DOUBLE)/10 - 80 AS bbox_south,
               CAST((o_custkey*37) % 3500 AS DOUBLE)/10 - 174 + o_orderkey % 3 AS bbox_east,
               CAST((o_orderkey*13) % 1600 AS DOUBLE)/10 - 79 AS bbox_north,
               concat(CAST(CAST(o_orderdate AS DATE) AS STRING),'T00:00:00Z') AS datetime,
               CAST(300000 + 109800*(o_custkey % 9) + 500*(o_orderkey % 4) AS DOUBLE) AS west_m,
               CAST(4000000 + 109800*(o_orderkey % 7) AS DOUBLE) AS south_m,
               CAST(CASE o_orderkey % 3 WHEN 0 THEN 10980 WHEN 1 THEN 5490 ELSE 1830 END AS INT) AS width,
               o_orderkey AS seq
        FROM {{orders}}""",
    # (order, line) is not unique in the source table, so references collapse to one chunk
    "item_chunks": """
        SELECT l_orderkey AS item_no, l_linenumber AS tile_no, MIN(l_partkey) AS chunk_no
        FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    # collections may be announced before they have an item
    "collections": f"""
        SELECT id, concat('Title of ', id) AS title FROM (
            SELECT DISTINCT {_collection('o_custkey')} AS id FROM {{orders}}
            UNION ALL SELECT concat('planned-', CAST(n_nationkey AS STRING)) AS id FROM {{nation}} WHERE n_regionkey = 0) AS c""",
    "stored": """
        SELECT p_partkey AS chunk_no, CAST(p_size AS BIGINT)*1000 AS bytes FROM {part} WHERE p_size > 5
        UNION ALL SELECT 10000000 + s_suppkey, CAST(500 AS BIGINT) FROM {supplier}""",
    "placements": """
        SELECT DISTINCT l_partkey AS chunk_no, (l_partkey + l_linenumber % (1 + l_partkey % 7)) % 12 AS node_no FROM {lineitem}""",
    "nodes": f"""
        SELECT s_suppkey AS node_id, s_name AS node_name, {NOW_SECONDS} - (s_suppkey*7) % 600 AS last_seen_s,
               CAST(floor(s_acctbal) AS BIGINT) AS chunks_bytes, s_suppkey % 5 AS item_count,
               s_suppkey % 7 * 10 AS chunk_count,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE concat('n', CAST(s_suppkey AS STRING)) END AS url
        FROM {{supplier}}""",
    "access_log": f"""
        SELECT event_id, user_id AS chunk_no, ts, event_type AS access_type, {_collection('user_id')} AS collection_id
        FROM {{events}}""",
    "download_log": f"""
        SELECT event_id, ts, CASE WHEN event_type IN ('purchase','signup') THEN 'source' ELSE 'user' END AS origin,
               CASE user_id % 3 WHEN 0 THEN 'cdse' WHEN 1 THEN 'element84' ELSE 'wekeo' END AS provider,
               {_collection('user_id')} AS collection_id, CAST(floor(value*1000000) AS BIGINT) AS bytes
        FROM {{events}}""",
    "bandwidth_log": """
        SELECT event_id, ts, CASE event_id % 3 WHEN 0 THEN 'upload' ELSE 'download' END AS direction,
               CAST(floor(value*1000000) AS BIGINT) AS bytes, user_id % 30 - 10 AS nice, user_id % 7 AS account_id
        FROM {events}""",
    "account_log": """
        SELECT event_id AS seq, ts, user_id % 25 AS account_id, event_type <> 'error' AS success,
               CAST(floor(value*1000) AS BIGINT) AS bytes
        FROM {events}""",
    "requests": """
        SELECT event_id AS seq, ts, user_id % 20 AS client,
               CASE WHEN event_id % 11 = 0 THEN '/health' ELSE '/stac/search' END AS path
        FROM {events}""",
    "users_local": """
        SELECT c_custkey AS user_id, c_name AS username, 1000 + c_custkey % 50 AS updated_at, TRUE AS active
        FROM {customer} WHERE c_mktsegment <> 'MACHINERY'""",
    "users_remote": """
        SELECT c_custkey AS user_id,
               CASE WHEN c_custkey % 60 = 0 THEN 'Customer#000000001' ELSE c_name END AS username,
               1010 + c_custkey % 35 AS updated_at, c_custkey % 4 <> 0 AS active
        FROM {customer} WHERE c_acctbal >= 4000""",
    "products": """
        SELECT p_partkey AS product_id, p_type AS product_type, CAST(p_size*2 AS DOUBLE) AS cloud_cover,
               CAST(p_partkey % 340 - 170 AS DOUBLE) AS west, CAST((p_partkey*3) % 160 - 80 AS DOUBLE) AS south,
               concat('2024-0', CAST(1 + p_partkey % 9 AS STRING), '-1', CAST(p_partkey % 10 AS STRING), 'T10:00:00Z') AS date
        FROM {part}""",
    # one line item = one pixel of a bulk scene; duplicates of a pixel are removed where it matters
    "pixels_wide": """
        SELECT l_orderkey AS scene, l_linenumber AS y, l_partkey AS x, CAST(l_quantity*100 AS INT) AS b04,
               CAST(floor(l_extendedprice/10) AS INT) AS b08, CAST(floor(l_tax*10000) AS INT) AS b02,
               CAST(floor(l_discount*10000) AS INT) AS b03, CAST(l_suppkey % 12 AS INT) AS scl
        FROM {lineitem}""",
    # search requests made from customers: an area, a period and a collection each
    "aois": f"""
        SELECT c_custkey AS request_id, {_collection('c_custkey')} AS collection,
               CAST((c_custkey*53) % 3400 AS DOUBLE)/10 - 175 AS west,
               CAST((c_custkey*29) % 1600 AS DOUBLE)/10 - 80 AS south,
               CAST((c_custkey*53) % 3400 AS DOUBLE)/10 - 175 + 1 + (c_custkey % 5)*(c_custkey % 2) AS east,
               CAST((c_custkey*29) % 1600 AS DOUBLE)/10 - 80 + 0.5 + c_custkey % 4 AS north,
               CASE WHEN c_custkey % 11 = 0 THEN '2030-01-01' ELSE concat(CAST(1995 + c_custkey % 5 AS STRING), '-01-01') END AS date_from,
               CASE WHEN c_custkey % 11 = 0 THEN '2030-12-31' ELSE concat(CAST(1996 + c_custkey % 5 AS STRING), '-06-30') END AS date_to
        FROM {{customer}}""",
}

# Bands of a derived scene, in band_no order.
SCENE_BANDS = ("B02", "B03", "B04", "B08", "B8A", "B11", "SCL", "B12")

SPARK_ONLY = {
    "node_collections": f"""
        SELECT s_suppkey AS node_id, {_collection('(s_suppkey + k)')} AS collection
        FROM {{supplier}} LATERAL VIEW explode(sequence(0, CAST(s_suppkey % 3 AS INT))) AS k""",
    "tiles": """
        SELECT vec_id DIV 8 AS scene, CAST(vec_id % 8 AS INT) AS band_no,
               element_at(array('B02','B03','B04','B08','B8A','B11','SCL','B12'), CAST(vec_id % 8 AS INT) + 1) AS band,
               transform(embedding, v -> CAST(CASE WHEN vec_id % 8 = 6 THEN floor((CAST(v AS DOUBLE)+1)*5000) % 12
                                              ELSE floor((CAST(v AS DOUBLE)+1)*5000) END AS INT)) AS pixels
        FROM {embeddings}""",
    "chunks": """
        SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN sha2(encode(concat(text,'x'),'UTF-8'),256)
                            ELSE sha2(encode(text,'UTF-8'),256) END AS claimed_sha,
               encode(text,'UTF-8') AS data, CAST(octet_length(text) AS BIGINT) AS bytes, source, lang
        FROM {documents}""",
}

DUCK_ONLY = {
    "node_collections": f"""
        SELECT node_id, {_collection('(node_id + k)')} AS collection
        FROM (SELECT s_suppkey AS node_id, unnest(range(s_suppkey % 3 + 1)) AS k FROM supplier)""",
    "pixels": """
        SELECT scene, band_no, CASE band_no WHEN 0 THEN 'B02' WHEN 1 THEN 'B03' WHEN 2 THEN 'B04' WHEN 3 THEN 'B08'
                    WHEN 4 THEN 'B8A' WHEN 5 THEN 'B11' WHEN 6 THEN 'SCL' ELSE 'B12' END AS band, y, x,
               CASE WHEN band_no = 6 THEN raw % 12 ELSE raw END AS dn
        FROM (SELECT vec_id // 8 AS scene, CAST(vec_id % 8 AS INT) AS band_no, CAST((p-1)//8 AS INT) AS y,
                     CAST((p-1)%8 AS INT) AS x, CAST(floor((CAST(v AS DOUBLE)+1)*5000) AS INT) AS raw
              FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding,1) AS p FROM embeddings))""",
    "cube": """
        SELECT scene, y, x, max(CASE WHEN band='B02' THEN dn END) AS b02, max(CASE WHEN band='B03' THEN dn END) AS b03,
               max(CASE WHEN band='B04' THEN dn END) AS b04, max(CASE WHEN band='B08' THEN dn END) AS b08,
               max(CASE WHEN band='B8A' THEN dn END) AS b8a, max(CASE WHEN band='B11' THEN dn END) AS b11,
               max(CASE WHEN band='SCL' THEN dn END) AS scl, max(CASE WHEN band='B12' THEN dn END) AS b12
        FROM pixels GROUP BY scene, y, x""",
    "chunks": """
        SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN sha256(concat(text,'x')) ELSE sha256(text) END AS claimed_sha,
               sha256(text) AS sha, CAST(strlen(text) AS BIGINT) AS bytes, source, lang FROM documents""",
}


class Inputs:
    """Lazy access to base and derived tables of one data folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder.rstrip("/")
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def base(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE_TABLES:
            return self.base(name)
        text = SPARK_ONLY.get(name) or PORTABLE.get(name)
        if text is None:
            raise AttributeError(name)
        used = {t: self.base(t) for t in BASE_TABLES if "{" + t + "}" in text}
        return self.spark.sql(text, **used)


_DEPENDS = {"cube": ("pixels",)}


def with_tables(names: tuple[str, ...], sql: str) -> str:
    """Put the derived tables ``names`` in front of ``sql`` as CTEs."""
    ordered: list[str] = []
    for name in names:
        for needed in (*_DEPENDS.get(name, ()), name):
            if needed not in ordered:
                ordered.append(needed)
    if not ordered:
        return sql
    parts = []
    for name in ordered:
        text = DUCK_ONLY.get(name) or PORTABLE[name]
        for t in BASE_TABLES:
            text = text.replace("{" + t + "}", t)
        parts.append(f"{name} AS ({text})")
    body = sql.strip()
    if body[:15].upper() == "WITH RECURSIVE ":
        return "WITH RECURSIVE " + ",\n".join(parts) + ",\n" + body[15:]
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(parts) + ",\n" + body[5:]
    return "WITH " + ",\n".join(parts) + "\n" + body
