"""Manifest, history and log views over the test tables, in Spark and as DuckDB common table expressions.

Both forms follow one rule each, so that a plan and its SQL read the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.hashing import audit_body

DAYS = 30
DAY_0 = 1_704_067_200  # 2024-01-01
CHUNK = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as a manifest: path, content, size, mtime_secs, mtime_nanos, mode."""
    d = table(spark, sf_dir, "documents")
    return d.select(F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string")).alias("path"), F.sha2("text", 256).alias("content"), F.col("n_chars").alias("size"), F.col("doc_id").alias("mtime_secs"), (F.col("doc_id") % 1000).cast("int").alias("mtime_nanos"), F.lit(420).alias("mode"))


def doc_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same after edits by modulus of doc_id: deleted, edited (some with unchanged stamps), touched and added paths."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    edited, stamped = i % 11 == 5, (i % 11 == 5) & (i % 22 != 5)
    kept = d.where(i % 17 != 3).select(
        F.concat_ws("/", "source", "lang", i.cast("string")).alias("path"),
        F.when(edited, F.sha2(F.concat("text", F.lit("#")), 256)).otherwise(F.sha2("text", 256)).alias("content"),
        (F.col("n_chars") + stamped.cast("int")).alias("size"),
        (i + stamped.cast("int") + (i % 19 == 2).cast("int")).alias("mtime_secs"),
        (i % 1000).cast("int").alias("mtime_nanos"),
        F.lit(420).alias("mode"),
    )
    added = d.where(i % 13 == 7).select(F.concat(F.lit("new/"), i.cast("string")).alias("path"), F.sha2(F.concat(F.lit("new"), "text"), 256).alias("content"), F.col("n_chars").alias("size"), i.alias("mtime_secs"), (i % 1000).cast("int").alias("mtime_nanos"), F.lit(420).alias("mode"))
    return kept.unionByName(added)


DOC_SQL = """doc_old AS (
    SELECT source || '/' || lang || '/' || doc_id AS path, sha256(text) AS content, n_chars AS size, doc_id AS mtime_secs, (doc_id % 1000)::INTEGER AS mtime_nanos, 420 AS mode FROM documents
), doc_new AS (
    SELECT source || '/' || lang || '/' || doc_id AS path, CASE WHEN doc_id % 11 = 5 THEN sha256(text || '#') ELSE sha256(text) END AS content,
        n_chars + (doc_id % 11 = 5 AND doc_id % 22 <> 5)::INTEGER AS size, doc_id + (doc_id % 11 = 5 AND doc_id % 22 <> 5)::INTEGER + (doc_id % 19 = 2)::INTEGER AS mtime_secs, (doc_id % 1000)::INTEGER AS mtime_nanos, 420 AS mode
    FROM documents WHERE doc_id % 17 <> 3
    UNION ALL SELECT 'new/' || doc_id, sha256('new' || text), n_chars, doc_id, (doc_id % 1000)::INTEGER, 420 FROM documents WHERE doc_id % 13 = 7
)"""


def lineitem_old(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a manifest by order and line; contents hash whole numbers only."""
    x = table(spark, sf_dir, "lineitem")
    cents = [F.round(F.col(c) * 100).cast("long").cast("string") for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax")]
    path = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string"))
    return x.select("l_orderkey", path.alias("path"), F.sha2(F.concat_ws("|", *cents, "l_returnflag", "l_linestatus"), 256).alias("content"))


def lineitem_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    old, k = lineitem_old(spark, sf_dir), F.col("l_orderkey")
    kept = old.where(k % 97 != 0).withColumn("content", F.when(k % 89 == 1, F.sha2(F.concat("content", F.lit("#")), 256)).otherwise(F.col("content")))
    return kept.unionByName(old.where(k % 101 == 5).withColumn("path", F.concat(F.lit("new/"), "path")))


LINEITEM_SQL = """li_old AS (
    SELECT l_orderkey, l_orderkey || '/' || l_linenumber AS path, sha256(concat_ws('|', round(l_quantity * 100)::BIGINT, round(l_extendedprice * 100)::BIGINT, round(l_discount * 100)::BIGINT, round(l_tax * 100)::BIGINT, l_returnflag, l_linestatus)) AS content FROM lineitem
), li_new AS (
    SELECT l_orderkey, path, CASE WHEN l_orderkey % 89 = 1 THEN sha256(content || '#') ELSE content END AS content FROM li_old WHERE l_orderkey % 97 <> 0
    UNION ALL SELECT l_orderkey, 'new/' || path, content FROM li_old WHERE l_orderkey % 101 = 5
)"""


def history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of 30 daily snapshots: seq, actor, path (a user), content (the user's last event so far; none after an error)."""
    e = table(spark, sf_dir, "events")
    day = F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date"))
    last = e.withColumn("day", day).groupBy("user_id", "day").agg(F.max_by(F.struct("event_type", F.sha2(F.concat(F.col("event_id").cast("string"), "props"), 256).alias("content")), F.struct("ts", "event_id")).alias("e"))
    until = F.coalesce(F.lead("day").over(Window.partitionBy("user_id").orderBy("day")) - 1, F.lit(DAYS - 1))
    held = last.withColumn("until", until).where("e.event_type <> 'error' AND until >= day")
    entries = held.select(F.explode(F.sequence("day", "until")).alias("seq"), F.concat(F.lit("u/"), F.col("user_id").cast("string")).alias("path"), F.col("e.content").alias("content"))
    return entries.withColumn("actor", actor_of(F.col("seq")))


def actor_of(seq):
    return F.when(seq % 3 == 1, "alice").when(seq % 3 == 2, "bob")


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each day: seq, snapshot_id, parent_id, timestamp_secs, actor, message, files. Days 7, 17 and 27 are off the chain; pairs of days share a second."""
    entries = history(spark, sf_dir)
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "content"))), lambda x: F.concat(x["path"], F.lit("="), x["content"])), ",")
    days = entries.groupBy("seq").agg(body.alias("body"), F.count("*").alias("files"))
    s = days.select("seq", F.sha2(F.concat(F.lit("snap:"), F.col("seq").cast("string"), F.lit(":"), "body"), 256).alias("snapshot_id"), "files")
    before = F.when(F.col("seq") % 10 == 8, F.col("seq") - 2).otherwise(F.col("seq") - 1)
    parents = s.select(F.col("seq").alias("p_seq"), F.col("snapshot_id").alias("parent_id"))
    s = s.withColumn("before", before).join(parents, F.col("before") == F.col("p_seq"), "left")
    return s.select("seq", "snapshot_id", "parent_id", (F.lit(DAY_0) + F.floor(F.col("seq") / 2) * 86400).cast("long").alias("timestamp_secs"), actor_of(F.col("seq")).alias("actor"), F.concat(F.lit("day "), F.col("seq").cast("string")).alias("message"), "files")


HISTORY_SQL = """ev AS (
    SELECT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS day, ts, event_id, event_type, sha256(event_id || props) AS content FROM events
), ev_last AS (
    SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) = 1
), ev_held AS (
    SELECT *, coalesce(lead(day) OVER (PARTITION BY user_id ORDER BY day) - 1, 29) AS until FROM ev_last
), hist AS (
    SELECT seq::INTEGER AS seq, 'u/' || user_id AS path, content, CASE seq % 3 WHEN 1 THEN 'alice' WHEN 2 THEN 'bob' END AS actor
    FROM ev_held, generate_series(0, 29) AS g(seq) WHERE event_type <> 'error' AND seq BETWEEN day AND until
), snaps0 AS (
    SELECT seq, sha256('snap:' || seq || ':' || string_agg(path || '=' || content, ',' ORDER BY path)) AS snapshot_id, count(*) AS files FROM hist GROUP BY seq
), snaps AS (
    SELECT a.seq, a.snapshot_id, b.snapshot_id AS parent_id, (1704067200 + (a.seq // 2) * 86400)::BIGINT AS timestamp_secs, CASE a.seq % 3 WHEN 1 THEN 'alice' WHEN 2 THEN 'bob' END AS actor, 'day ' || a.seq AS message, a.files
    FROM snaps0 a LEFT JOIN snaps0 b ON b.seq = CASE WHEN a.seq % 10 = 8 THEN a.seq - 2 ELSE a.seq - 1 END
), walk(snapshot_id, depth) AS (
    SELECT snapshot_id, 0::BIGINT FROM snaps WHERE seq = 29
    UNION ALL SELECT s.parent_id, w.depth + 1 FROM walk w JOIN snaps s ON s.snapshot_id = w.snapshot_id WHERE s.parent_id IS NOT NULL
)"""


def linked_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log for each user as it was written: user_id, seq, ts, event, detail, prev, hash."""
    e = table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("event"), F.col("props").alias("detail"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "ts", "event", "detail"))).alias("rows"))
    start = F.struct(F.lit("").alias("prev"), F.array().cast("array<struct<seq:bigint,ts:bigint,event:string,detail:string,prev:string,hash:string>>").alias("done"))

    def link(state, row):
        seq = F.size(state["done"]).cast("long")
        hash_ = F.sha2(audit_body(seq, row["ts"], row["event"], row["detail"], state["prev"]), 256)
        entry = F.struct(seq.alias("seq"), row["ts"].alias("ts"), row["event"].alias("event"), row["detail"].alias("detail"), state["prev"].alias("prev"), hash_.alias("hash"))
        return F.struct(hash_.alias("prev"), F.concat(state["done"], F.array(entry)).alias("done"))

    return rows.select("user_id", F.explode(F.aggregate("rows", start, link, lambda s: s["done"])).alias("e")).select("user_id", "e.*")


def audit_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The logs after tampering, with line_no: some entries are altered, some dropped."""
    u, seq = F.col("user_id"), F.col("seq")
    altered = linked_chain(spark, sf_dir).withColumn("event", F.when((u % 5 == 2) & (seq == 11), "span").otherwise(F.col("event")))
    return altered.where(~((u % 7 == 3) & (seq == 20))).withColumn("line_no", seq)


CHAIN_SQL = """raw AS (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq, floor(epoch(ts))::BIGINT AS ts, event_type AS event, props AS detail FROM events
), linked(user_id, seq, ts, event, detail, prev, hash) AS (
    SELECT user_id, seq, ts, event, detail, '', sha256('[' || seq || ',' || ts || ',' || to_json(event) || ',' || to_json(detail) || ',""]') FROM raw WHERE seq = 0
    UNION ALL SELECT r.user_id, r.seq, r.ts, r.event, r.detail, l.hash, sha256('[' || r.seq || ',' || r.ts || ',' || to_json(r.event) || ',' || to_json(r.detail) || ',"' || l.hash || '"]')
    FROM linked l JOIN raw r ON r.user_id = l.user_id AND r.seq = l.seq + 1
), audit AS (
    SELECT user_id, seq AS line_no, seq, ts, CASE WHEN user_id % 5 = 2 AND seq = 11 THEN 'span' ELSE event END AS event, detail, prev, hash FROM linked WHERE NOT (user_id % 7 = 3 AND seq = 20)
), placed AS (
    SELECT *, row_number() OVER w - 1 AS pos, coalesce(lag(hash) OVER w, '') AS before FROM audit WINDOW w AS (PARTITION BY user_id ORDER BY line_no)
), checked AS (
    SELECT *, seq = pos AND prev = before AND hash = sha256('[' || seq || ',' || ts || ',' || to_json(event) || ',' || to_json(detail) || ',' || to_json(prev) || ']') AS ok FROM placed
)"""


def chunk_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fixed chunks of 512 characters of documents: doc_id, pos, piece, hash."""
    from tidemark.operators.chunks import fixed

    return fixed(table(spark, sf_dir, "documents"), CHUNK)


CHUNK_SQL = """occ AS (
    SELECT doc_id, pos::INTEGER AS pos, substring(text, pos * 512 + 1, 512) AS piece, sha256(substring(text, pos * 512 + 1, 512)) AS hash
    FROM documents, LATERAL (SELECT unnest(range(ceil(length(text) / 512.0)::BIGINT)) AS pos)
)"""
