"""Registry of the reference-parity queries and of their DuckDB counterparts.

``QUERIES`` maps a name to f(spark, sf_dir); ``ORACLE_SQL`` has the same rows as SQL over
the test tables. Queries without SQL are those of operators that SQL can't express.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scalars
from tidemark.functions.hashing import audit_body, fan_out, json_string, purge_id, short
from tidemark.operators import chains, chunks, diff, history, purge, replication, undo, watching
from tidemark.plans import fixtures as fx
from tidemark.sources import manifests
from tidemark.sources.shared import shared_dir, stored
from tidemark.streaming.watch import OUTPUT as WATCHED
from tidemark.streaming.watch import debounced

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
HEAD = 29


def query(sql: str | None = None):
    """Register a plan under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


DIFF_SQL = "SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS status FROM {new} a FULL JOIN {old} b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.content <> b.content"
DOC_DIFF_SQL = DIFF_SQL.format(new="doc_new", old="doc_old")


# --- diff and drift ---------------------------------------------------------------------


@query(f"WITH {fx.DOC_SQL} {DOC_DIFF_SQL}")
def q_diff_paths(spark, sf):
    return diff.diff(fx.doc_new(spark, sf), fx.doc_old(spark, sf))


COUNTS_SQL = "SELECT count(*) FILTER (status = 'added') AS added, count(*) FILTER (status = 'modified') AS modified, count(*) FILTER (status = 'deleted') AS deleted FROM d"


@query(f"WITH {fx.DOC_SQL}, d AS ({DOC_DIFF_SQL}) {COUNTS_SQL}")
def q_diff_counts(spark, sf):
    return diff.counts(q_diff_paths(spark, sf))


@query(f"WITH {fx.LINEITEM_SQL} {DIFF_SQL.format(new='li_new', old='li_old')}")
def q_diff_lineitem(spark, sf):
    return diff.diff(fx.lineitem_new(spark, sf), fx.lineitem_old(spark, sf))


SAME_STAMP = "a.size = b.size AND a.mtime_secs = b.mtime_secs AND a.mtime_nanos = b.mtime_nanos"
DRIFT_SQL = f"""SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'added' WHEN a.path IS NULL THEN 'deleted' WHEN a.content <> b.content THEN 'modified' ELSE 'touched' END AS status
FROM doc_new a FULL JOIN doc_old b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR """


@query(f"WITH {fx.DOC_SQL} {DRIFT_SQL} NOT ({SAME_STAMP})")
def q_drift_fast(spark, sf):
    return diff.drift(fx.doc_new(spark, sf), fx.doc_old(spark, sf))


@query(f"WITH {fx.DOC_SQL} {DRIFT_SQL} NOT ({SAME_STAMP}) OR a.content <> b.content")
def q_drift_full(spark, sf):
    return diff.drift(fx.doc_new(spark, sf), fx.doc_old(spark, sf), full=True)


@query(f"WITH {fx.DOC_SQL} SELECT a.path FROM doc_new a JOIN doc_old b ON a.path = b.path WHERE {SAME_STAMP} AND a.content <> b.content")
def q_drift_forged(spark, sf):
    """Paths that only the full comparison finds."""
    full, fast = q_drift_full(spark, sf).where("status = 'modified'"), q_drift_fast(spark, sf)
    return full.join(fast, "path", "left_anti").select("path")


@query(f"WITH {fx.DOC_SQL}, d AS ({DRIFT_SQL} NOT ({SAME_STAMP})) SELECT coalesce(bool_or(status <> 'touched'), false) AS dirty, count(*) = 0 AS clean FROM d")
def q_dirty_gate(spark, sf):
    return q_drift_fast(spark, sf).agg(diff.is_dirty(F.lit(None)).alias("dirty"), (F.count("*") == 0).alias("clean"))


@query(f"WITH {fx.DOC_SQL}, e AS (SELECT path, content, size AS pos FROM doc_old UNION ALL SELECT path, content, size + 1 AS pos FROM doc_new) SELECT path, arg_max(content, pos) AS content, max(pos) AS pos FROM e GROUP BY path")
def q_dup_path_last_wins(spark, sf):
    old, new = fx.doc_old(spark, sf), fx.doc_new(spark, sf)
    entries = old.select("path", "content", F.col("size").alias("pos")).unionByName(new.select("path", "content", (F.col("size") + 1).alias("pos")))
    return diff.last_wins(entries)


# --- revert -----------------------------------------------------------------------------

LIVE_SQL = "live AS (SELECT *, CASE WHEN mtime_secs % 23 = 1 THEN 'symlink' ELSE 'file' END AS kind FROM doc_new)"


def live(spark, sf):
    return fx.doc_new(spark, sf).withColumn("kind", F.when(F.col("mtime_secs") % 23 == 1, "symlink").otherwise("file"))


@query(f"WITH {fx.DOC_SQL}, {LIVE_SQL} SELECT b.path, b.content, b.size FROM doc_old b LEFT JOIN live a ON a.path = b.path WHERE a.path IS NULL OR a.kind <> 'file' OR a.content <> b.content")
def q_revert_write_set(spark, sf):
    return diff.write_set(fx.doc_old(spark, sf), live(spark, sf)).select("path", "content", "size")


@query(f"WITH {fx.DOC_SQL} SELECT path, 'removed' AS action FROM doc_new WHERE path NOT IN (SELECT path FROM doc_old)")
def q_revert_extras(spark, sf):
    return diff.extras(fx.doc_new(spark, sf), fx.doc_old(spark, sf))


@query(f"""WITH {fx.DOC_SQL}, {LIVE_SQL} SELECT b.path, 'restored' AS action FROM doc_old b LEFT JOIN live a ON a.path = b.path WHERE a.path IS NULL OR a.kind <> 'file' OR a.content <> b.content
UNION ALL SELECT path, 'skipped_extra' FROM doc_new WHERE path NOT IN (SELECT path FROM doc_old)""")
def q_revert_keep_extra(spark, sf):
    return diff.revert_plan(fx.doc_old(spark, sf), live(spark, sf), keep_extra=True)


DIRS_SQL = """{name} AS (SELECT DISTINCT array_to_string(parts[1:n], '/') AS dir, n AS depth FROM (SELECT parts, unnest(range(1, len(parts))) AS n FROM (SELECT string_split(path, '/') AS parts FROM {rel})))"""


@query(f"WITH {fx.DOC_SQL}, {DIRS_SQL.format(name='d_new', rel='doc_new')}, {DIRS_SQL.format(name='d_old', rel='doc_old')} SELECT dir, depth::INTEGER AS depth FROM d_new WHERE dir NOT IN (SELECT dir FROM d_old) ORDER BY depth DESC, dir")
def q_prune_dirs(spark, sf):
    return diff.empty_directories(fx.doc_new(spark, sf), fx.doc_old(spark, sf)).orderBy(F.col("depth").desc(), "dir")


# --- predicates and scalars -------------------------------------------------------------

PATTERNS = ["blog", "/fr/"]


@query("SELECT page_id, url FROM pages WHERE NOT contains(url, 'blog') AND NOT contains(url, '/fr/') AND NOT list_has_any(string_split(url, '/'), ['.tidemark', '.git', '.DS_Store'])")
def q_scan_filter(spark, sf):
    pages = fx.table(spark, sf, "pages").select("page_id", "url")
    return pages.where(~scalars.ignored(F.col("url"), PATTERNS) & ~scalars.excluded(F.col("url")))


SEGMENT_SQL = "len(list_filter(string_split({p}, '/'), lambda s: s IN ('', '.', '..'))) = 0 AND octet_length(encode({p})) <= 1024 AND NOT contains({p}, '\\')"


@query(f"SELECT page_id, {SEGMENT_SQL.format(p='url')} AS url_safe, {SEGMENT_SQL.format(p='rel')} AS rel_safe FROM (SELECT page_id, url, regexp_replace(url, '^[a-z]+://', '') AS rel FROM pages)")
def q_safe_path(spark, sf):
    rel = F.regexp_replace("url", "^[a-z]+://", "")
    return fx.table(spark, sf, "pages").select("page_id", scalars.safe_path(F.col("url")).alias("url_safe"), scalars.safe_path(rel).alias("rel_safe"))


@query("""WITH e AS (SELECT CASE WHEN doc_id % 31 = 4 THEN '../' || doc_id ELSE source || '/' || doc_id END AS path, CASE WHEN doc_id % 37 = 5 THEN -1 ELSE n_chars END AS size, CASE WHEN doc_id % 29 = 3 THEN 0 ELSE 1 END AS n FROM documents)
SELECT 'unsafe_path' AS "constraint", path FROM e WHERE starts_with(path, '../') UNION ALL SELECT 'no_chunks', path FROM e WHERE size > 0 AND n = 0 UNION ALL SELECT 'negative_size', path FROM e WHERE size < 0""")
def q_validate_violations(spark, sf):
    i = F.col("doc_id")
    path = F.when(i % 31 == 4, F.concat(F.lit("../"), i.cast("string"))).otherwise(F.concat_ws("/", "source", i.cast("string")))
    has = F.when(i % 29 == 3, F.array().cast("array<string>")).otherwise(F.array(F.sha2("text", 256)))
    entries = fx.table(spark, sf, "documents").select(path.alias("path"), F.when(i % 37 == 5, F.lit(-1).cast("long")).otherwise(F.col("n_chars")).alias("size"), has.alias("chunks"))
    return diff.violations(entries, scalars.safe_path(F.col("path")))


@query("""WITH e AS (SELECT source, count(*) AS files, sum(ceil(length(text) / 500.0)) AS n FROM documents WHERE text <> '' GROUP BY source), m AS (SELECT avg(n) AS n, avg(files) AS files FROM e)
SELECT 'too_many_chunks' AS "constraint", NULL::VARCHAR AS path FROM e, m WHERE e.n > floor(m.n) UNION ALL SELECT 'too_many_files', NULL FROM e, m WHERE e.files > floor(m.files)""")
def q_validate_limits(spark, sf):
    """Limits that some manifests reach: the mean over the sources, each a manifest."""
    d = fx.table(spark, sf, "documents").where("text <> ''")
    pieces = F.sequence(F.lit(1), F.ceil(F.length("text") / 500).cast("int"))
    entries = d.select("source", F.col("doc_id").cast("string").alias("path"), F.lit(1).alias("size"), F.transform(pieces, lambda k: k.cast("string")).alias("chunks"))
    mean = entries.groupBy("source").agg(F.sum(F.size("chunks")).alias("n"), F.count("*").alias("files")).agg(F.floor(F.avg("n")), F.floor(F.avg("files"))).first()
    return diff.violations(entries, F.lit(True), mean[0], mean[1], key="source")


@query("SELECT doc_id, ((doc_id * 37) & 511)::BIGINT AS mode FROM documents")
def q_mode_mask(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", scalars.mode_bits(F.col("doc_id") * 37).alias("mode"))


@query("SELECT url, regexp_replace(url, '[^A-Za-z0-9.-]', '_', 'g') AS ref FROM pages")
def q_ref_names(spark, sf):
    return fx.table(spark, sf, "pages").select("url", scalars.ref_name(F.col("url")).alias("ref"))


@query("""SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;') AS escaped FROM pages""")
def q_xml_escape(spark, sf):
    return fx.table(spark, sf, "pages").select("page_id", scalars.xml_escaped(F.col("html")).alias("escaped"))


@query("SELECT event_id, coalesce(CASE WHEN event_id % 3 = 0 THEN event_id % 5 END, CASE WHEN event_id % 3 = 1 THEN 128 + event_id % 15 END, 1)::BIGINT AS code FROM events")
def q_exit_code(spark, sf):
    i = F.col("event_id")
    return fx.table(spark, sf, "events").select("event_id", scalars.exit_code(F.when(i % 3 == 0, i % 5), F.when(i % 3 == 1, i % 15)).cast("long").alias("code"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M:%SZ') AS shown, strftime(DATE '1970-01-01' + (floor(epoch(ts))::BIGINT // 86400)::INTEGER, '%Y-%m-%d') AS day FROM events")
def q_civil_date(spark, sf):
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return fx.table(spark, sf, "events").select("event_id", scalars.shown_time(secs).alias("shown"), scalars.civil_date(F.floor(secs / 86400).cast("int")).cast("string").alias("day"))


@query("SELECT doc_id, sha256(text)[1:12] AS short, sha256(text)[1:2] AS prefix, sha256(source || ':' || sha256(text))[1:16] AS purge_id, doc_id * 1000000000 + 7 AS stamp FROM documents")
def q_hash_forms(spark, sf):
    h = F.sha2("text", 256)
    return fx.table(spark, sf, "documents").select("doc_id", short(h).alias("short"), fan_out(h).alias("prefix"), purge_id(F.col("source"), h).alias("purge_id"), scalars.stamp_nanos(F.col("doc_id"), F.lit(7)).alias("stamp"))


@query("""SELECT event_id, to_json(props)::VARCHAR AS quoted, sha256('[' || event_id || ',' || floor(epoch(ts))::BIGINT || ',' || to_json(event_type) || ',' || to_json(props) || ',""]') AS hash FROM events""")
def q_json_forms(spark, sf):
    """JSON string literals and the hash of an audit entry's body."""
    e = fx.table(spark, sf, "events")
    body = audit_body(F.col("event_id"), F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("event_type"), F.col("props"), F.lit(""))
    return e.select("event_id", json_string(F.col("props")).alias("quoted"), F.sha2(body, 256).alias("hash"))


@query("SELECT doc_id, chr(39) || replace(source || chr(39) || lang, chr(39), chr(39) || chr(92) || chr(39) || chr(39)) || chr(39) AS quoted, contains(source, '1') AS has_one, replace(replace(source || chr(34) || lang, chr(92), chr(92) || chr(92)), chr(34), chr(92) || chr(34)) AS escaped, source || ', ' || lang AS shown FROM documents")
def q_quoting(spark, sf):
    return fx.table(spark, sf, "documents").select("doc_id", scalars.shell_quoted(F.concat("source", F.lit("'"), "lang")).alias("quoted"), scalars.ignored(F.col("source"), ["1"]).alias("has_one"), scalars.script_escaped(F.concat("source", F.lit('"'), "lang")).alias("escaped"), scalars.enumerated(F.array("source", "lang")).alias("shown"))


@query(f"WITH {fx.DOC_SQL} SELECT string_split(path, '/')[1] AS snapshot_id, path, content, size, mode::INTEGER AS mode FROM doc_old")
def q_manifest_round_trip(spark, sf):
    """Manifests of each source as JSON documents with byte-array hashes, read back."""
    old = fx.doc_old(spark, sf).withColumns({"snapshot_id": F.split("path", "/")[0], "pos": F.col("mtime_secs"), "chunks": F.array("content")})
    heads = old.select("snapshot_id").distinct().select("snapshot_id", F.lit(3).alias("version"), F.sha2("snapshot_id", 256).alias("parent_id"), F.lit(1).cast("long").alias("timestamp_secs"), F.lit("m").alias("message"), F.lit(None).cast("string").alias("actor"), F.array().cast("array<string>").alias("unstable"))
    back = manifests.entries(manifests.decoded(manifests.encoded(heads, old)))
    return back.select("snapshot_id", "path", "content", "size", "mode")


# --- chunks -----------------------------------------------------------------------------


@query(f"WITH {fx.CHUNK_SQL} SELECT doc_id, pos, hash FROM occ")
def q_chunks_fixed(spark, sf):
    return fx.chunk_occurrences(spark, sf).select("doc_id", "pos", "hash")


@query(f"WITH {fx.CHUNK_SQL} SELECT count(*) AS occurrences, count(DISTINCT hash) AS chunks FROM occ")
def q_chunk_dedup(spark, sf):
    return fx.chunk_occurrences(spark, sf).agg(F.count("*").alias("occurrences"), F.count_distinct("hash").alias("chunks"))


EDIT_SQL = """occ2 AS (
    SELECT doc_id, pos::INTEGER AS pos, sha256(substring(t, pos * 512 + 1, 512)) AS hash
    FROM (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN '#' || text ELSE text || '#' END AS t FROM documents), LATERAL (SELECT unnest(range(ceil(length(t) / 512.0)::BIGINT)) AS pos)
)"""


@query(f"WITH {fx.CHUNK_SQL}, {EDIT_SQL} SELECT count(*) AS kept FROM (SELECT DISTINCT doc_id, hash FROM occ INTERSECT SELECT DISTINCT doc_id, hash FROM occ2)")
def q_chunk_overlap(spark, sf):
    """Chunks that an edit keeps: one character put in front of a third of the documents, behind the others."""
    d = fx.table(spark, sf, "documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("#"), "text")).otherwise(F.concat("text", F.lit("#"))).alias("text"))
    edited = chunks.fixed(d, fx.CHUNK).select("doc_id", "hash")
    return fx.chunk_occurrences(spark, sf).select("doc_id", "hash").intersect(edited).agg(F.count("*").alias("kept"))


@query(f"WITH {fx.CHUNK_SQL} SELECT doc_id, sha256(string_agg(piece, '' ORDER BY pos)) AS content, count(*) AS n_chunks, sum(length(piece))::BIGINT AS size FROM occ GROUP BY doc_id")
def q_reassemble(spark, sf):
    occ = fx.chunk_occurrences(spark, sf)
    whole = chunks.reassembled(occ.select("doc_id", "pos", "hash"), occ.select("hash", "piece").dropDuplicates(["hash"]), key="doc_id")
    return whole.select("doc_id", F.sha2("whole", 256).alias("content"), "n_chunks", F.length("whole").cast("long").alias("size"))


@query()
def q_cdc_chunks(spark, sf):
    """Content-defined chunks; sizes fit texts of some kilobytes."""
    return chunks.content_defined(fx.table(spark, sf, "documents"), least=256, average=1024, most=4096)


@query("SELECT doc_id, strlen(text) AS bytes, sha256(text) AS content, true AS within FROM documents WHERE text <> ''")
def q_cdc_whole(spark, sf):
    """What content-defined chunks must hold: in order they give the text again, and all but the last are within the bounds."""
    d = fx.table(spark, sf, "documents").select("doc_id", F.col("text").cast("binary").alias("data"))
    parts = q_cdc_chunks(spark, sf).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("pos", "start", "length"))).alias("p"))
    piece = lambda p: F.hex(F.substring(F.col("data"), (p["start"] + 1).cast("int"), p["length"].cast("int")))
    within = F.forall("p", lambda p: (p["length"] <= 4096) & ((p["length"] >= 256) | (p["pos"] == F.size("p") - 1)))
    whole = F.unhex(F.array_join(F.transform("p", piece), ""))
    return d.join(parts, "doc_id").select("doc_id", F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["length"]).alias("bytes"), F.sha2(whole, 256).alias("content"), within.alias("within"))


STORED_SQL = "stored AS (SELECT DISTINCT hash, CASE WHEN ascii(hash) % 7 = 1 THEN piece || '!' ELSE piece END AS piece FROM occ)"


@query(f"WITH {fx.CHUNK_SQL}, {STORED_SQL} SELECT count(*) FILTER (sha256(piece) = hash) AS ok, count(*) FILTER (sha256(piece) <> hash) AS corrupt FROM stored")
def q_object_verify(spark, sf):
    objects = fx.chunk_occurrences(spark, sf).select("hash", "piece").dropDuplicates(["hash"])
    damaged = objects.withColumn("piece", F.when(F.ascii("hash") % 7 == 1, F.concat("piece", F.lit("!"))).otherwise(F.col("piece")))
    return chunks.object_counts(damaged, F.col("piece"))


@query(f"WITH {fx.CHUNK_SQL} SELECT DISTINCT hash, length(piece)::BIGINT AS length FROM occ WHERE hash NOT IN (SELECT hash FROM occ WHERE doc_id % 2 = 0)")
def q_insert_if_absent(spark, sf):
    occ = fx.chunk_occurrences(spark, sf)
    new = chunks.absent(occ.select("hash", F.length("piece").cast("long").alias("length")), occ.where("doc_id % 2 = 0").select("hash"))
    return new.select("hash", "length")


# --- history ----------------------------------------------------------------------------

WITH_HISTORY = f"WITH RECURSIVE {fx.HISTORY_SQL}"
LISTED_SQL = "listed AS (SELECT s.*, w.depth, w.depth IS NOT NULL AS in_chain FROM snaps s LEFT JOIN walk w USING (snapshot_id))"


def head_of(snaps):
    return snaps.where(F.col("seq") == HEAD)


def listed(spark, sf):
    snaps = fx.snapshots(spark, sf)
    return history.listing(snaps, history.chain(snaps, head_of(snaps)))


@query(f"{WITH_HISTORY} SELECT snapshot_id, depth FROM walk")
def q_chain_walk(spark, sf):
    snaps = fx.snapshots(spark, sf)
    return history.chain(snaps, head_of(snaps))


@query(f"{WITH_HISTORY} SELECT snapshot_id, seq FROM snaps WHERE snapshot_id NOT IN (SELECT snapshot_id FROM walk)")
def q_orphans(spark, sf):
    snaps = fx.snapshots(spark, sf)
    return history.orphans(snaps, history.chain(snaps, head_of(snaps))).select("snapshot_id", "seq")


@query(f"{WITH_HISTORY}, {LISTED_SQL} SELECT snapshot_id[1:12] AS id, strftime(make_timestamp(timestamp_secs * 1000000), '%Y-%m-%d %H:%M:%SZ') AS shown, message, files, depth IS NOT NULL AND depth = 0 AS is_head FROM (SELECT * FROM listed ORDER BY timestamp_secs DESC, in_chain DESC, depth ASC NULLS LAST, snapshot_id LIMIT 20)")
def q_log_topk(spark, sf):
    rows = history.log(listed(spark, sf))
    return rows.select(short(F.col("snapshot_id")).alias("id"), scalars.shown_time(F.col("timestamp_secs")).alias("shown"), "message", "files", F.coalesce(F.col("depth") == 0, F.lit(False)).alias("is_head"))


@query(f"{WITH_HISTORY} SELECT h.path, h.content, s.snapshot_id FROM hist h JOIN snaps s ON s.seq = h.seq WHERE h.seq = 29 ORDER BY path")
def q_show(spark, sf):
    snaps, entries = fx.snapshots(spark, sf), fx.history(spark, sf)
    return entries.join(head_of(snaps).select("seq", "snapshot_id"), "seq").select("path", "content", "snapshot_id").orderBy("path")


@query(f"{WITH_HISTORY} SELECT upper(snapshot_id[1:4]) AS prefix, count(*) AS hits, min(snapshot_id) AS first FROM snaps GROUP BY 1")
def q_resolve_prefix(spark, sf):
    """For each snapshot's four-digit prefix, how many snapshots it could mean."""
    snaps = fx.snapshots(spark, sf)
    asked = snaps.select(F.upper(F.substring("snapshot_id", 1, 4)).alias("prefix")).distinct()
    hits = asked.join(snaps, F.lower("prefix") == F.substring("snapshot_id", 1, 4))
    return hits.groupBy("prefix").agg(F.count("*").alias("hits"), F.min("snapshot_id").alias("first"))


@query(f"{WITH_HISTORY} SELECT snapshot_id, files FROM snaps")
def q_files_per_snapshot(spark, sf):
    return fx.snapshots(spark, sf).select("snapshot_id", "files")


# --- undo -------------------------------------------------------------------------------

UNDO_SQL = f"""{WITH_HISTORY}, prev AS (SELECT seq + 1 AS seq, path, content AS before FROM hist),
t AS (
    SELECT h.path, h.seq, p.before FROM hist h LEFT JOIN prev p ON p.path = h.path AND p.seq = h.seq WHERE h.actor = 'alice' AND h.content IS DISTINCT FROM p.before
    UNION ALL SELECT p.path, p.seq, p.before FROM prev p WHERE p.seq IN (SELECT seq FROM snaps WHERE actor = 'alice') AND NOT EXISTS (SELECT 1 FROM hist h WHERE h.path = p.path AND h.seq = p.seq)
), touched AS (SELECT path, arg_min_null(before, seq) AS before FROM t GROUP BY path),
af AS (SELECT path, content, min(seq) AS since FROM hist WHERE actor = 'alice' GROUP BY path, content),
eff AS (SELECT h.path, arg_max(h.content, h.seq) AS content, max(h.seq) AS seq FROM hist h LEFT JOIN af ON af.path = h.path AND af.content = h.content WHERE h.actor IS DISTINCT FROM 'alice' AND (since IS NULL OR since > h.seq) GROUP BY h.path),
head AS (SELECT path, content FROM hist WHERE seq = 29),
undone AS (
    SELECT path, content, source FROM (
        SELECT coalesce(h.path, t.path) AS path, CASE WHEN t.path IS NOT NULL THEN coalesce(e.content, t.before) ELSE h.content END AS content,
            CASE WHEN t.path IS NULL THEN 'head' WHEN e.content IS NOT NULL THEN 'effective' ELSE 'before' END AS source
        FROM head h FULL JOIN touched t ON t.path = h.path LEFT JOIN eff e ON e.path = coalesce(h.path, t.path)
    ) WHERE content IS NOT NULL
)"""


def undo_inputs(spark, sf):
    return fx.history(spark, sf), fx.snapshots(spark, sf)


@query(f"{UNDO_SQL} SELECT path, before FROM touched")
def q_undo_touched(spark, sf):
    return undo.touched(*undo_inputs(spark, sf), "alice")


@query(f"{UNDO_SQL} SELECT path, content, seq FROM eff")
def q_undo_effective(spark, sf):
    return undo.effective(fx.history(spark, sf), "alice")


@query(f"{UNDO_SQL} SELECT path, content, source FROM undone")
def q_undo_manifest(spark, sf):
    return undo.manifest(*undo_inputs(spark, sf), "alice", HEAD)


# beside the users' paths, one that alice alone makes for every fifth user
OWN_SQL = f"""{WITH_HISTORY}, hist2 AS (SELECT seq, path, content, actor FROM hist UNION ALL
    SELECT s.seq, 'own/' || u.user_id, sha256('own ' || u.user_id), s.actor FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 5 = 0) u JOIN snaps s ON s.seq >= 3 * (u.user_id % 9) + 1
){UNDO_SQL[len(WITH_HISTORY) :].replace("hist", "hist2")}"""


@query(f"{OWN_SQL} SELECT path FROM touched WHERE path NOT IN (SELECT path FROM undone)")
def q_undo_removed(spark, sf):
    entries, snaps = undo_inputs(spark, sf)
    users = fx.table(spark, sf, "events").where("user_id % 5 = 0").select("user_id").distinct()
    own = users.join(snaps.select("seq", "actor"), F.col("seq") >= 3 * (F.col("user_id") % 9) + 1)
    own = own.select("seq", F.concat(F.lit("own/"), F.col("user_id").cast("string")).alias("path"), F.sha2(F.concat(F.lit("own "), F.col("user_id").cast("string")), 256).alias("content"), "actor")
    return undo.removed(entries.unionByName(own), snaps, "alice", HEAD)


# --- tombstones and purge ---------------------------------------------------------------

TOMB_SQL = "tomb AS (SELECT path, content FROM doc_old WHERE mtime_secs % 41 = 6)"


def tombstones(spark, sf):
    return fx.doc_old(spark, sf).where("mtime_secs % 41 = 6").select("path", "content")


@query(f"WITH {fx.DOC_SQL}, {TOMB_SQL} SELECT path, content FROM doc_new WHERE path NOT IN (SELECT path FROM tomb) AND content NOT IN (SELECT content FROM tomb)")
def q_tombstone_filter(spark, sf):
    return purge.surviving(fx.doc_new(spark, sf).select("path", "content"), tombstones(spark, sf))


@query(f"WITH {fx.DOC_SQL}, {TOMB_SQL}, bad AS (SELECT DISTINCT path, content, mtime_secs AS pos FROM doc_new WHERE path IN (SELECT path FROM tomb) OR content IN (SELECT content FROM tomb)) SELECT arg_min(path, (pos, path)) AS path, count(*) AS n FROM bad")
def q_purged_refusal(spark, sf):
    entries = fx.doc_new(spark, sf).select("path", "content", F.struct(F.col("mtime_secs").alias("at"), "path").alias("pos"))
    return purge.first_refused(entries, tombstones(spark, sf))


SWEEP_SQL = f"""WITH {fx.CHUNK_SQL}, used AS (SELECT d.source AS path, d.lang AS snapshot_id, o.hash FROM occ o JOIN documents d USING (doc_id)),
swept AS (SELECT hash, CASE WHEN bool_or(path <> 'src0') THEN 'retained_shared' ELSE 'delete' END AS action FROM used GROUP BY hash HAVING bool_or(path = 'src0'))"""


def occurrences(spark, sf):
    """Chunks by source as path and language as snapshot."""
    d = fx.table(spark, sf, "documents")
    return chunks.fixed(d, fx.CHUNK).join(d.select("doc_id", F.col("source").alias("path"), F.col("lang").alias("snapshot_id")), "doc_id")


@query(f"{SWEEP_SQL} SELECT hash, action FROM swept")
def q_purge_sweep(spark, sf):
    return purge.sweep(occurrences(spark, sf), "src0")


@query(f"""{SWEEP_SQL} SELECT (SELECT count(*) FROM swept WHERE action = 'delete' AND ascii(hash) % 2 = 0) AS chunks_removed, (SELECT count(*) FROM swept WHERE action = 'retained_shared') AS chunks_retained_shared,
(SELECT count(DISTINCT snapshot_id) FROM used WHERE path = 'src0') AS manifests_touched""")
def q_purge_counts(spark, sf):
    """Of the objects only those of even first digit codes exist."""
    used = occurrences(spark, sf)
    return purge.purge_counts(used, used.where(F.ascii("hash") % 2 == 0), "src0")


@query(f"WITH {fx.DOC_SQL}, {TOMB_SQL} SELECT n.path, n.content FROM doc_new n WHERE (n.path, n.content) IN (SELECT (path, content) FROM tomb)")
def q_cert_tombstone(spark, sf):
    return purge.certified(fx.doc_new(spark, sf).select("path", "content"), tombstones(spark, sf))


# --- chains -----------------------------------------------------------------------------

WITH_CHAIN = f"WITH RECURSIVE {fx.CHAIN_SQL}"


@query(f"""{WITH_CHAIN} SELECT user_id, count(*) AS entries, coalesce(bool_and(ok), true) AS valid, coalesce(arg_min(CASE WHEN NOT ok THEN seq END, CASE WHEN NOT ok THEN pos END), -1) AS first_bad, coalesce(min(CASE WHEN NOT ok THEN pos END), count(*)) AS valid_prefix FROM checked GROUP BY user_id""")
def q_audit_verify(spark, sf):
    """first_bad is -1 where the chain is valid."""
    return chains.verdicts(fx.audit_chain(spark, sf), "user_id").fillna(-1, ["first_bad"])


@query(f"{WITH_CHAIN} SELECT user_id, max(seq) + 1 AS entries, arg_max(hash, line_no) AS tip FROM audit GROUP BY user_id")
def q_audit_tip(spark, sf):
    return chains.tips(fx.audit_chain(spark, sf), "user_id")


ANCHOR_SQL = """anchors AS (SELECT user_id, (user_id % 25)::BIGINT AS audit_len, coalesce((SELECT hash FROM linked l WHERE l.user_id = u.user_id AND l.seq = u.user_id % 25 - 1), '') AS audit_tip FROM (SELECT DISTINCT user_id FROM audit) u)"""


@query(f"""{WITH_CHAIN}, {ANCHOR_SQL} SELECT a.user_id, a.audit_len, a.audit_tip, a.audit_len = 0 OR (count(*) FILTER (c.ok) = a.audit_len AND arg_max(c.hash, c.pos) = a.audit_tip) IS TRUE AS ok
FROM anchors a LEFT JOIN checked c ON c.user_id = a.user_id AND c.pos < a.audit_len GROUP BY a.user_id, a.audit_len, a.audit_tip""")
def q_anchor_prefix(spark, sf):
    """A checkpoint of each user's log, of a length by user; tips are those before any tampering."""
    length = F.col("user_id") % 25
    tip = F.coalesce(F.max(F.when(F.col("seq") == length - 1, F.col("hash"))), F.lit(""))
    anchors = fx.linked_chain(spark, sf).groupBy("user_id").agg(tip.alias("audit_tip")).select("user_id", length.alias("audit_len"), "audit_tip")
    return chains.anchored(fx.audit_chain(spark, sf), stored(anchors, "anchors"), "user_id")  # a row for each user, read twice


FILES_SQL = """files AS (
    SELECT user_id, event_id AS millis, 0 AS n, hash AS file_hash, CASE WHEN event_id % 19 = 4 THEN 'lost' ELSE prev END AS prev_anchor FROM linked JOIN (SELECT user_id, seq, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS seq FROM events)) USING (user_id, seq)
)"""


def anchor_files(spark, sf):
    ids = fx.table(spark, sf, "events").select("user_id", "event_id")
    seq = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1).cast("long")
    log = fx.audit_chain(spark, sf).select("user_id", "seq", "hash", "prev")
    x = log.join(ids.withColumn("seq", seq), ["user_id", "seq"])
    return x.select("user_id", F.col("event_id").alias("millis"), F.lit(0).alias("n"), F.col("hash").alias("file_hash"), F.when(F.col("event_id") % 19 == 4, "lost").otherwise(F.col("prev")).alias("prev_anchor"))


@query(f"""{WITH_CHAIN}, {FILES_SQL}, kept AS (SELECT f.* FROM files f JOIN audit a ON a.user_id = f.user_id AND a.hash = f.file_hash)
SELECT user_id, millis, CASE WHEN before IS NULL THEN 'first' WHEN prev_anchor = before THEN 'linked' ELSE 'broken' END AS state FROM (SELECT *, lag(file_hash) OVER (PARTITION BY user_id ORDER BY millis, n) AS before FROM kept)""")
def q_anchor_links(spark, sf):
    state = F.when(F.col("linked").isNull(), "first").when(F.col("linked"), "linked").otherwise("broken")
    return chains.links(anchor_files(spark, sf), "user_id").select("user_id", "millis", state.alias("state"))


@query("""SELECT event_id, 'anchor-' || millis || CASE WHEN n > 0 THEN '-' || n ELSE '' END || '.json' AS name FROM (SELECT event_id, millis, row_number() OVER (PARTITION BY millis ORDER BY event_id) - 1 AS n FROM (SELECT event_id, floor(epoch(ts))::BIGINT // 3600 AS millis FROM events))""")
def q_anchor_names(spark, sf):
    secs = F.unix_timestamp(F.col("ts").cast("timestamp"))
    return chains.anchor_names(fx.table(spark, sf, "events").select("event_id", "ts"), F.floor(secs / 3600), "event_id").select("event_id", "name")


@query("""SELECT user_id, event_id, coalesce(t >= max(t) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM (SELECT user_id, event_id, floor(epoch(ts))::BIGINT + (event_id * 7919) % 90000 AS t FROM events)""")
def q_fleet_accept(spark, sf):
    t = F.unix_timestamp(F.col("ts").cast("timestamp")) + (F.col("event_id") * 7919) % 90000
    orders = fx.table(spark, sf, "events").select("user_id", "event_id", t.alias("t"))
    return chains.accepted(orders, "user_id", ts="t", arrival="event_id").select("user_id", "event_id", "accepted")


# --- replication, peers, windows --------------------------------------------------------


def pull_sides(spark, sf):
    occ = fx.chunk_occurrences(spark, sf)
    code = F.ascii(F.substring("hash", 2, 1))
    return occ.where("doc_id % 2 = 0"), occ.where(code % 3 != 0), occ.where(code % 4 == 1)


HAVE_SQL = f"""WITH {fx.CHUNK_SQL}, needed AS (SELECT DISTINCT hash FROM occ WHERE doc_id % 2 = 0), remote AS (SELECT DISTINCT hash FROM occ WHERE ascii(hash[2:2]) % 3 <> 0), here AS (SELECT DISTINCT hash FROM occ WHERE ascii(hash[2:2]) % 4 = 1)"""


@query(f"{HAVE_SQL} SELECT hash FROM needed WHERE hash IN (SELECT hash FROM remote) AND hash NOT IN (SELECT hash FROM here)")
def q_have_fetch(spark, sf):
    return replication.fetch_set(*pull_sides(spark, sf))


@query(f"""{HAVE_SQL}, x AS (SELECT hash IN (SELECT hash FROM remote) AS r, hash IN (SELECT hash FROM here) AS l FROM needed)
SELECT count(*) AS needed, count(*) FILTER (r AND NOT l) AS fetched, count(*) FILTER (NOT (r AND NOT l)) AS skipped, count(*) FILTER (NOT r AND NOT l) AS remote_missing FROM x""")
def q_pull_counts(spark, sf):
    return replication.pull_counts(*pull_sides(spark, sf))


@query("SELECT 'host' || (user_id % 40) AS addr, arg_min(event_type = 'view', event_id) AS secured, min(event_id) AS arrival FROM events GROUP BY 1")
def q_peers_dedup(spark, sf):
    e = fx.table(spark, sf, "events")
    return replication.peers(e.select(F.concat(F.lit("host"), (F.col("user_id") % 40).cast("string")).alias("addr"), (F.col("event_type") == "view").alias("secured"), F.col("event_id").alias("arrival")))


STREAM_PATH_SQL = "CASE WHEN event_id % 13 = 0 THEN '.git/' || event_type ELSE event_type || '/' || (event_id % 50) END"


@query(f"SELECT DISTINCT 'r' || (user_id % 10) AS root, {STREAM_PATH_SQL} AS path FROM events WHERE event_id % 13 <> 0")
def q_watch_stream(spark, sf):
    """All paths that the debounced stream reports for the recorded events, windows laid together; ends when no window is open."""
    i = F.col("event_id")
    path = F.when(i % 13 == 0, F.concat(F.lit(".git/"), "event_type")).otherwise(F.concat("event_type", F.lit("/"), (i % 50).cast("string")))
    events = watch_events(spark, sf).select(F.concat(F.lit("r"), (F.col("user_id") % 10).cast("string")).alias("root"), path.alias("path"))
    out = shared_dir(spark, "watch-stream")
    spark.createDataFrame([], WATCHED).write.parquet(f"{out}/windows")
    batches = lambda batch, _: batch.write.mode("append").parquet(f"{out}/windows")
    query = debounced(events).writeStream.foreachBatch(batches).option("checkpointLocation", f"{out}/checkpoint").trigger(processingTime="250 milliseconds").start()
    try:
        for _ in range(200):  # timers make batches without end, so that the stream is never idle by itself
            done = query.recentProgress
            if query.awaitTermination(0.25):
                break
            if sum(p["numInputRows"] for p in done) and not done[-1]["numInputRows"] and not done[-1]["stateOperators"][0]["numRowsTotal"]:
                break
    finally:
        query.stop()
    if query.exception():
        raise query.exception()
    return spark.read.schema(WATCHED).parquet(f"{out}/windows").select("root", F.explode("paths").alias("path")).distinct()


def watch_events(spark, sf):
    """The events table as a stream, be it a file or a folder of files."""
    schema, source = fx.table(spark, sf, "events").schema, f"{sf}/events.parquet"
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(source)
    folder = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isDirectory()
    reader = spark.readStream.schema(schema)
    return reader.parquet(source) if folder else reader.option("pathGlobFilter", "events.parquet").parquet(sf)


WINDOW_SECS = 6 * 3600


@query(f"""WITH RECURSIVE e AS (SELECT DISTINCT user_id, floor(epoch(ts))::BIGINT AS t FROM events), w(user_id, opened) AS (
    SELECT user_id, min(t) FROM e GROUP BY user_id
    UNION ALL SELECT w.user_id, (SELECT min(t) FROM e WHERE e.user_id = w.user_id AND e.t >= w.opened + {WINDOW_SECS}) AS o FROM w WHERE EXISTS (SELECT 1 FROM e WHERE e.user_id = w.user_id AND e.t >= w.opened + {WINDOW_SECS})
) SELECT user_id, opened FROM w""")
def q_watch_windows(spark, sf):
    e = fx.table(spark, sf, "events").select("user_id", F.unix_timestamp(F.col("ts").cast("timestamp")).alias("t"))
    return watching.windows(e, "user_id", "t", WINDOW_SECS)
