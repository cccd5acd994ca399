"""Registered queries of the transcript, hygiene and inventory flows, each with DuckDB SQL.

The tables stand in for the flows' stores: conversations are transcripts, events
timed sessions and facts, documents records, labels review verdicts, embeddings
record vectors, pages link sources; the relational tables serve where only keys matter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.text import QUOTE_EXCLUSIONS, SECRETS, has_shape, qualified_id, title_from_path
from heddle.operators import audit, curation, duplicates, hygiene, inventory, judge, matching, sessions, store, vectors
from heddle.params import CATEGORIES
from heddle.plans.samples import SOURCES, STORE1, STORE2, STORE3, THREADS
from heddle.plans.storage import materialize, shared_path
from heddle.sources import sqlite, stores
from heddle.sources.stores import project_store
from heddle.streaming.sessions import drain_sessions, event_stream

AS_OF = "2024-01-31 00:00:00"
MACHINE_OPENING = "^(The|La|Er) "
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("n"), "role", "text")


def timed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.timed_sessions(table(spark, sf_dir, "events"), "user_id", "ts")


def micros(*names: str) -> list:
    return [F.unix_micros(F.col(n).cast("timestamp")).alias(n) for n in names]


KEPT = "(SELECT conv_id AS session_id, turn AS n, role, text FROM conversations WHERE role IN ('user', 'assistant') AND trim(coalesce(text, '')) <> '')"
TIMED = "(SELECT user_id AS session_id, min(ts) AS first_at, max(ts) AS last_at, count(*) AS message_count FROM events WHERE ts IS NOT NULL GROUP BY user_id)"
LISTED = f"(SELECT session_id, count(*) AS message_count, min(n) AS first_n, max(n) AS last_n FROM {KEPT} GROUP BY session_id)"


# --- sessions ---------------------------------------------------------------------------


@query(LISTED[1:-1])
def session_list(spark, sf_dir):
    """Sessions with their message counts and spans."""
    return sessions.session_list(messages(spark, sf_dir))


@query(f"SELECT session_id, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, message_count FROM {TIMED} WHERE last_at > TIMESTAMP '2024-01-30 12:00:00'")
def session_incremental_since(spark, sf_dir):
    """Sessions with messages strictly later than a time."""
    s = sessions.since(timed(spark, sf_dir), "2024-01-30 12:00:00")
    return s.select("session_id", *micros("first_at", "last_at"), "message_count")


@query(f"SELECT session_id, message_count FROM {TIMED} WHERE last_at <= TIMESTAMP '{AS_OF}' - INTERVAL 30 MINUTES")
def session_live_guard(spark, sf_dir):
    """Sessions that aren't being written to."""
    return sessions.not_live(timed(spark, sf_dir), F.lit(AS_OF).cast("timestamp")).select("session_id", "message_count")


STATUS = f"""(SELECT session_id, count(*) AS message_count,
  CASE WHEN count(*) < 4 OR coalesce(regexp_matches(arg_min(text, n) FILTER (WHERE role = 'user'), '{MACHINE_OPENING}'), false)
       THEN 'skipped-trivial' ELSE 'open' END AS status
  FROM {KEPT} GROUP BY session_id)"""


@query(STATUS[1:-1])
def session_trivial_skip(spark, sf_dir):
    """Sessions that aren't worth a run."""
    return sessions.with_status(messages(spark, sf_dir), MACHINE_OPENING)


def _budget(limit: int) -> str:
    return f"SELECT * FROM (SELECT session_id, message_count, row_number() OVER (ORDER BY session_id) AS run_place, sum(message_count) OVER (ORDER BY session_id)::BIGINT AS run_messages FROM {LISTED}) WHERE run_place <= {limit} AND run_messages <= 150"


@query(_budget(3))
def session_budget(spark, sf_dir):
    """The first sessions that a run may take: three, or 150 messages."""
    return sessions.within_budget(sessions.session_list(messages(spark, sf_dir)), ["session_id"]).select("session_id", "message_count", "run_place", "run_messages")


@query(_budget(1000))
def session_budget_messages(spark, sf_dir):
    """The same under the bound on messages alone."""
    listed = sessions.session_list(messages(spark, sf_dir))
    return sessions.within_budget(listed, ["session_id"], sessions_max=1000).select("session_id", "message_count", "run_place", "run_messages")


@query(f"SELECT session_id, epoch_us(last_at) AS last_at FROM {TIMED} WHERE NOT (session_id % 2 = 0 AND last_at <= TIMESTAMP '2024-01-30 12:00:00')")
def cursor_anti_join(spark, sf_dir):
    """Sessions that the cursor lacks or has seen shorter."""
    s = timed(spark, sf_dir)
    cursor = s.where("session_id % 2 = 0").select("session_id", F.lit("2024-01-30 12:00:00").cast("timestamp").alias("at"))
    return sessions.unresolved(s, cursor).select("session_id", *micros("last_at"))


RESOLVED = "session_id % 7 <> 3 OR last_at < TIMESTAMP '2024-01-30 18:00:00'"


@query(f"WITH s AS (SELECT *, {RESOLVED} AS done FROM {TIMED}) SELECT epoch_us(max(last_at)) AS high_water, count(*) AS n_resolved FROM s WHERE done AND last_at < coalesce((SELECT min(last_at) FROM s WHERE NOT done), TIMESTAMP '9999-01-01')")
def cursor_high_water(spark, sf_dir):
    """How far the cursor may move."""
    s = timed(spark, sf_dir)
    return sessions.high_water(s, s.where(RESOLVED)).select(*micros("high_water"), "n_resolved")


PLACED = f"(SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY n, role, text) AS place FROM {KEPT})"


@query(f"SELECT session_id, n, place, (place - 1) // 4 AS window_no FROM {PLACED}")
def message_windows(spark, sf_dir):
    """Windows of four messages."""
    return sessions.windows(messages(spark, sf_dir), 4).select("session_id", "n", "place", "window_no")


@query(
    f"""WITH p AS (SELECT *, (place - 1) // 4 AS window_no FROM {PLACED}),
    w AS (SELECT session_id, window_no, count(*) AS n_recent FROM p GROUP BY ALL)
    SELECT w.session_id, w.window_no, w.n_recent, count(p.place) AS n_tail,
           coalesce(string_agg(p.role || ': ' || left(p.text, 40), ' / ' ORDER BY p.place), '') AS tail
    FROM w LEFT JOIN p ON p.session_id = w.session_id AND p.place BETWEEN w.window_no * 4 - 4 AND w.window_no * 4
    GROUP BY w.session_id, w.window_no, w.n_recent"""
)
def window_earlier_tail(spark, sf_dir):
    """Windows with the five messages before them."""
    return sessions.window_tails(messages(spark, sf_dir), 4)


@query(f"SELECT session_id, md5(string_agg(role || ': ' || text, chr(10) ORDER BY place)) AS transcript_md5 FROM {PLACED} GROUP BY session_id")
def speaker_transcripts(spark, sf_dir):
    """Speaker-labelled transcripts, by digest."""
    return sessions.transcript(messages(spark, sf_dir)).select("session_id", F.md5("transcript").alias("transcript_md5"))


@query(f"SELECT concat_ws(':', 'store1', 'host', session_id, n) AS id, role FROM {KEPT}")
def qualified_message_ids(spark, sf_dir):
    """Message ids that are unique over stores and machines."""
    kept = sessions.kept_messages(messages(spark, sf_dir))
    return kept.select(qualified_id(F.lit("store1"), F.lit("host"), F.col("session_id").cast("string"), F.col("n").cast("string")).alias("id"), "role")


@query(r"SELECT page_id, coalesce(nullif(coalesce(list_filter(string_split(replace(url, '\', '/'), '/'), lambda x: x <> '')[-1], url), ''), 'Unknown') AS title FROM pages")
def title_from_url(spark, sf_dir):
    """Titles from paths."""
    return table(spark, sf_dir, "pages").select("page_id", title_from_path(F.col("url")).alias("title"))


@query(f"WITH s AS (SELECT session_id, message_count, CASE WHEN status = 'open' AND session_id % 3 = 0 THEN 'processed' ELSE status END AS status FROM {STATUS}) SELECT count(*) AS found, count(*) FILTER (WHERE status = 'skipped-trivial') AS skipped_trivial, count(*) FILTER (WHERE status = 'processed') AS processed, count(*) FILTER (WHERE status = 'open') AS deferred, coalesce(sum(message_count) FILTER (WHERE status = 'processed'), 0)::BIGINT AS messages FROM s")
def collection_report(spark, sf_dir):
    """Counts of a collection run."""
    s = sessions.with_status(messages(spark, sf_dir), MACHINE_OPENING)
    return sessions.collection_report(s.withColumn("status", F.when((F.col("status") == "open") & (F.col("session_id") % 3 == 0), "processed").otherwise(F.col("status"))))


@query(f"SELECT session_id, epoch_us(first_at) AS first_at, epoch_us(last_at) AS last_at, message_count FROM {TIMED}")
def stream_sessions(spark, sf_dir):
    """Sessions of a drained stream."""
    path = f"{sf_dir}/events.parquet"
    s = drain_sessions(event_stream(spark, path, spark.read.parquet(path).schema), "user_id", "ts")
    return s.select("session_id", *micros("first_at", "last_at"), "message_count")


@query(f"SELECT session_id, message_count FROM {LISTED} WHERE session_id = 7")
def session_point_lookup(spark, sf_dir):
    """One session by its id."""
    return sessions.by_id(sessions.session_list(messages(spark, sf_dir)), 7).select("session_id", "message_count")


@query(f"SELECT session_id, message_count FROM {TIMED} ORDER BY last_at DESC, session_id LIMIT 3")
def first_run_most_recent(spark, sf_dir):
    """What a first run takes."""
    return sessions.most_recent(timed(spark, sf_dir)).select("session_id", "message_count")


@query(f"SELECT row_number() OVER (ORDER BY last_at, session_id) AS place, '{{\"id\":' || session_id || ',\"messageCount\":' || message_count || ',\"lastMessageAt\":\"' || strftime(last_at, '%Y-%m-%dT%H:%M:%S.%g') || 'Z\"}}' AS json FROM {TIMED}")
def session_listing_json(spark, sf_dir):
    """The listing as documents, oldest first."""
    return sessions.listing(timed(spark, sf_dir).select("session_id", "message_count", "last_at"))


@query("SELECT user_id AS id FROM events GROUP BY user_id HAVING max(ts) > TIMESTAMP '2024-01-30 12:00:00'")
def items_touched_since(spark, sf_dir):
    """Records that changed since the last run."""
    items = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated"))
    return hygiene.touched_since(items, "2024-01-30 12:00:00").select("id")


@query("SELECT id FROM (SELECT user_id AS id, max(ts) AS u FROM events GROUP BY user_id) ORDER BY u DESC, id LIMIT 20")
def items_first_run(spark, sf_dir):
    """Records that a first run looks at."""
    items = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(F.max("ts").alias("updated"))
    return hygiene.touched_since(items, None, 20).select("id")


# --- duplicates and merging -------------------------------------------------------------


@query("SELECT md5(text) AS text_md5, count(*) AS n, min(doc_id) AS canonical_id FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1")
def exact_duplicates(spark, sf_dir):
    """Texts that several records have."""
    return duplicates.exact_groups(table(spark, sf_dir, "documents"), "doc_id", "text")


PAIRS = r"""
  reps AS MATERIALIZED (SELECT text, min(doc_id) AS id FROM documents WHERE text IS NOT NULL GROUP BY text),
  words AS (SELECT id, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w FROM reps),
  tok AS (SELECT id, unnest(w) AS t, generate_subscripts(w, 1) AS p, len(w) AS n FROM words),
  sh AS MATERIALIZED (SELECT DISTINCT id, s FROM (
    SELECT id, p, n, concat_ws(' ', t, lead(t, 1) OVER o, lead(t, 2) OVER o, lead(t, 3) OVER o, lead(t, 4) OVER o) AS s
    FROM tok WINDOW o AS (PARTITION BY id ORDER BY p)) WHERE p <= greatest(n - 4, 1)),
  size AS MATERIALIZED (SELECT id, count(*) AS n FROM sh GROUP BY id),
  pairs AS MATERIALIZED (
    SELECT id_a, id_b, k / (a.n + b.n - k) AS similarity
    FROM (SELECT x.id AS id_a, y.id AS id_b, count(*)::DOUBLE AS k FROM sh x JOIN sh y ON x.s = y.s AND x.id < y.id GROUP BY ALL)
    JOIN size a ON a.id = id_a JOIN size b ON b.id = id_b WHERE k / (a.n + b.n - k) >= 0.9)"""


def _pairs(spark, sf_dir):
    return duplicates.near_pairs(duplicates.representatives(table(spark, sf_dir, "documents"), "doc_id", "text"))


@query(f"WITH {PAIRS} SELECT id_a, id_b, round(similarity, 6) AS similarity FROM pairs")
def near_duplicate_pairs(spark, sf_dir):
    """Pairs of different texts with a shingle similarity of 0.9."""
    return _pairs(spark, sf_dir).select("id_a", "id_b", F.round("similarity", 6).alias("similarity"))


@query(
    f"""WITH RECURSIVE {PAIRS},
    e AS (SELECT id_a AS a, id_b AS b FROM pairs UNION SELECT id_b, id_a FROM pairs),
    reach AS (SELECT id AS a, id AS b FROM reps UNION SELECT r.a, e.b FROM reach r JOIN e ON e.a = r.b),
    comp AS (SELECT a AS id, min(b) AS cluster_id FROM reach GROUP BY a),
    links AS (SELECT a AS id, count(*) AS n FROM e GROUP BY a)
    SELECT d.doc_id AS id, coalesce(c.cluster_id, d.doc_id) AS cluster_id, coalesce(l.n, 0) AS n_links
    FROM documents d LEFT JOIN reps r ON r.text = d.text LEFT JOIN comp c ON c.id = r.id LEFT JOIN links l ON l.id = r.id"""
)
def duplicate_clusters(spark, sf_dir):
    """Every record with its near-duplicate cluster and its links to different texts."""
    return duplicates.clusters(table(spark, sf_dir, "documents"), "doc_id", "text")


@query(
    f"""WITH {PAIRS.replace(">= 0.9", ">= 0.4")},
    s AS (SELECT CASE WHEN id_a % 2 = 1 THEN id_a ELSE id_b END AS newcomer_id, CASE WHEN id_a % 2 = 1 THEN id_b ELSE id_a END AS e
          FROM pairs WHERE id_a % 2 <> id_b % 2)
    SELECT newcomer_id, count(*) AS n_matches, min(e) AS established_id, CASE WHEN count(*) = 1 THEN 'gate' ELSE 'cluster' END AS route FROM s GROUP BY newcomer_id"""
)
def newcomer_vs_established(spark, sf_dir):
    """Newcomers (odd ids) beside established records that are alike by 0.4."""
    reps = duplicates.representatives(table(spark, sf_dir, "documents"), "doc_id", "text")
    return duplicates.newcomers(duplicates.near_pairs(reps, 0.4), F.col("id") % 2 == 1)


@query(
    """WITH k AS (SELECT user_id AS cluster_id, event_type AS category, count(*) AS n, max(ts) AS newest FROM events GROUP BY ALL),
    c AS (SELECT cluster_id, category FROM k QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY n DESC, newest DESC, category) = 1)
    SELECT e.user_id AS cluster_id, max(value) AS exposure, max(value) AS strength, round(avg(value), 6) AS sentiment, count(*) AS n_merged,
           any_value(c.category) AS category, count(DISTINCT props) AS n_details,
           md5(array_to_string(list_sort(list(DISTINCT props)), ' / ')) AS details_md5, any_value(m.name) AS name
    FROM events e JOIN c ON c.cluster_id = e.user_id
    JOIN (SELECT user_id, name FROM (SELECT user_id, event_type || event_id % 3 AS name, count(*) AS n FROM events GROUP BY ALL)
          QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, length(name) DESC, name) = 1) m ON m.user_id = e.user_id GROUP BY e.user_id"""
)
def merge_numeric_rules(spark, sf_dir):
    """Clusters merged by rule."""
    e = table(spark, sf_dir, "events")
    v = F.col("value")
    return hygiene.merged(e.select(F.col("user_id").alias("cluster_id"), v.alias("exposure"), v.alias("strength"), v.alias("sentiment"), F.col("event_type").alias("category"), F.col("ts").alias("at"), F.col("props").alias("detail"), F.concat("event_type", (F.col("event_id") % 3).cast("string")).alias("name"))).withColumn("details_md5", F.md5(F.array_join("details", " / "))).drop("details")


@query("WITH r AS (SELECT doc_id, count(*) AS refs FROM labels GROUP BY doc_id) SELECT md5(text) AS cluster_id, arg_min(d.doc_id, (-coalesce(refs, 0), d.doc_id)) AS canonical_id, count(*) AS n FROM documents d LEFT JOIN r USING (doc_id) GROUP BY text HAVING count(*) > 1")
def canonical_record(spark, sf_dir):
    """The record of each exact cluster that keeps its id."""
    members = table(spark, sf_dir, "documents").select(F.md5("text").alias("cluster_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created"))
    refs = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    return hygiene.canonical(members, refs).where("n > 1")


@query(
    """WITH o AS (SELECT c_nationkey AS owner, c_mktsegment AS value, min(right(c_name, 1)) AS type, max((c_acctbal > 9000)::INT) AS p FROM customer GROUP BY ALL)
    SELECT owner, type, value, row_number() OVER (PARTITION BY owner ORDER BY p DESC, type, value) = 1 AS is_primary FROM o"""
)
def identifier_union(spark, sf_dir):
    """Identifiers once per value, one of them primary."""
    c = table(spark, sf_dir, "customer")
    return hygiene.identifier_union(c.select(F.col("c_nationkey").alias("owner"), F.col("c_mktsegment").alias("value"), F.right("c_name", F.lit(1)).alias("type"), (F.col("c_acctbal") > 9000).alias("is_primary")), "owner")


# --- vectors ----------------------------------------------------------------------------

COSINE = "round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


@query(f"SELECT a.vec_id AS query_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY {COSINE} DESC, b.vec_id) AS rank, b.vec_id AS id, {COSINE} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0 QUALIFY rank <= 3")
def vector_topk_neighbors(spark, sf_dir):
    """The three most similar records of every twentieth."""
    v = _vectors(spark, sf_dir)
    return vectors.nearest(v, v.where("id % 20 = 0"), 3)


@query(f"SELECT a.vec_id AS id_a, b.vec_id AS id_b, {COSINE} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE} >= 0.4")
def vector_pairs_threshold(spark, sf_dir):
    """Pairs of records over a similarity."""
    return vectors.similar_pairs(_vectors(spark, sf_dir), 0.4)


# --- decay, bloat, facts, graph ---------------------------------------------------------


@query(f"SELECT user_id AS id, epoch_us(max(ts)) AS mentioned FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY")
def stale_items(spark, sf_dir):
    """Records that nothing touched for a day."""
    t = F.max("ts")
    items = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(t.alias("mentioned"), t.alias("retrieved"), t.alias("updated"))
    return hygiene.stale(items, F.lit(AS_OF).cast("timestamp"), 1).select("id", *micros("mentioned"))


@query("SELECT doc_id, round(greatest(0.0, 0.05 + 0.9 * quality - 0.1), 6)::DOUBLE AS exposure FROM labels WHERE toxic <> 1")
def decay_one_notch(spark, sf_dir):
    """Unprotected records, one notch lower."""
    items = table(spark, sf_dir, "labels").select("doc_id", (0.05 + 0.9 * F.col("quality")).alias("exposure"), (F.col("toxic") == 1).alias("p"))
    return hygiene.decayed(items, "exposure", "p").drop("p")


@query("SELECT doc_id AS id, length(text) AS n_chars, row_number() OVER (ORDER BY length(text) DESC, doc_id) AS place FROM documents WHERE length(text) > 750 ORDER BY n_chars DESC, id LIMIT 5")
def bloat_worst_first(spark, sf_dir):
    """The five longest records."""
    return hygiene.bloated(table(spark, sf_dir, "documents"), "doc_id", "text")


def _facts(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("fact_id"), F.col("user_id").alias("subject"), F.col("event_type").alias("predicate"), F.col("value").alias("object"), F.col("ts").alias("at"))


FACTS = """(SELECT a.event_id AS fact_id, a.user_id AS subject, a.event_type AS predicate, a.value AS object,
  coalesce(min(value) OVER later <> value OR max(value) OVER later <> value, false) AS superseded,
  coalesce(min(value) OVER equal <> value OR max(value) OVER equal <> value, false) AS conflict
  FROM events a WINDOW later AS (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING),
                       equal AS (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN CURRENT ROW AND CURRENT ROW))"""


@query(f"SELECT fact_id, superseded, conflict FROM {FACTS}")
def superseded_facts(spark, sf_dir):
    """Facts that a later one replaces."""
    return hygiene.superseded(_facts(spark, sf_dir)).select("fact_id", "superseded", "conflict")


@query(f"SELECT subject, predicate, object FROM {FACTS} WHERE NOT superseded")
def current_facts(spark, sf_dir):
    """Facts that still hold."""
    return hygiene.superseded(_facts(spark, sf_dir)).where("not superseded").select("subject", "predicate", "object")


@query(
    """SELECT event_id AS fact_id, row_number() OVER w AS step,
    CASE WHEN lead(value) OVER w <> value THEN epoch_us(lead(ts) OVER w) END AS valid_until
    FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)"""
)
def fact_timeline(spark, sf_dir):
    """Facts with the time until which they held."""
    return hygiene.timeline(_facts(spark, sf_dir)).select("fact_id", "step", *micros("valid_until"))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
def orphan_items(spark, sf_dir):
    """Records without any link."""
    links = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("src"), F.lit(None).cast("long").alias("dst"))
    return hygiene.orphans(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), links)


# --- proposals, budget, report ----------------------------------------------------------


@query("SELECT doc_id % 10 AS report_id, doc_id AS target_id FROM labels WHERE quality = 1 AND toxic <> 1")
def approved_unexecuted_proposals(spark, sf_dir):
    """Approved proposals that haven't run."""
    p = table(spark, sf_dir, "labels").select((F.col("doc_id") % 10).alias("report_id"), F.col("doc_id").alias("target_id"), (F.col("quality") == 1).alias("approved"), (F.col("toxic") == 1).alias("executed"))
    return hygiene.cleared_proposals(p, False).select("report_id", "target_id")


def _mutations(spark, sf_dir):
    decay = table(spark, sf_dir, "labels").where("quality = 0").select(F.lit(2).alias("phase"), F.lit("decay").alias("op"), F.col("doc_id").alias("target_id"), F.lit(None).cast("long").alias("replaced_by"), F.col("toxic").cast("double").alias("priority"))
    split = hygiene.bloated(table(spark, sf_dir, "documents"), "doc_id", "text").select(F.lit(3).alias("phase"), F.lit("split").alias("op"), F.col("id").alias("target_id"), F.lit(None).cast("long").alias("replaced_by"), F.col("n_chars").cast("double").alias("priority"))
    found = table(spark, sf_dir, "documents")
    groups = duplicates.exact_groups(found, "doc_id", "text")
    copies = found.select("doc_id", F.md5("text").alias("text_md5")).join(groups, "text_md5").where("doc_id <> canonical_id")
    merge = copies.select(F.lit(1).alias("phase"), F.lit("merge").alias("op"), F.col("doc_id").alias("target_id"), F.col("canonical_id").alias("replaced_by"), F.lit(1.0).alias("priority"))
    return hygiene.budgeted([merge, decay, split])


MUTATIONS = """(SELECT *, row_number() OVER (ORDER BY phase, priority DESC, target_id, op) AS place FROM (
    SELECT 1 AS phase, 'merge' AS op, doc_id AS target_id, c AS replaced_by, 1.0::DOUBLE AS priority
    FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS c FROM documents) WHERE doc_id <> c
    UNION ALL SELECT 2, 'decay', doc_id, NULL, toxic::DOUBLE FROM labels WHERE quality = 0
    UNION ALL (SELECT 3, 'split', doc_id, NULL, length(text)::DOUBLE FROM documents WHERE length(text) > 750 ORDER BY length(text) DESC, doc_id LIMIT 5))
    QUALIFY place <= 25)"""


@query(f"SELECT place, phase, op, target_id, replaced_by FROM {MUTATIONS}")
def budgeted_mutations(spark, sf_dir):
    """The mutations that one run may make."""
    return _mutations(spark, sf_dir).select("place", "phase", "op", "target_id", "replaced_by")


@query(
    f"""SELECT count(*) FILTER (WHERE op = 'merge') AS n_merge, count(*) FILTER (WHERE op = 'decay') AS n_decay, count(*) FILTER (WHERE op = 'split') AS n_split,
    count(*) FILTER (WHERE op = 'invalidate') AS n_invalidate, count(*) FILTER (WHERE op = 'reconnect') AS n_reconnect, count(*) AS used,
    CASE WHEN count(*) >= 25 THEN arg_max(target_id, place)::VARCHAR ELSE 'clean' END AS resume_point FROM {MUTATIONS}"""
)
def gardening_report(spark, sf_dir):
    """The report of that run."""
    return hygiene.report(_mutations(spark, sf_dir))


@query("SELECT id_mod AS certain, 'executed' AS outcome, n FROM (SELECT quality = 0 AS id_mod, count(*) AS n FROM labels GROUP BY ALL) WHERE id_mod UNION ALL SELECT false, 'deferred', count(*) FROM labels WHERE quality <> 0")
def routed_removals(spark, sf_dir):
    """Where removals go in autonomous mode."""
    r = table(spark, sf_dir, "labels").select((F.col("quality") == 0).alias("certain"))
    return hygiene.routed(r, True).groupBy("certain", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("WITH g AS (SELECT *, row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1 AS gone FROM documents) SELECT source, count(*) AS n_before, count(*) FILTER (WHERE NOT gone) AS n_after FROM g GROUP BY source")
def store_stats(spark, sf_dir):
    """Counts per store before and after copies go."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", F.md5("text").alias("h"))
    first = docs.groupBy("h").agg(F.min("id").alias("first"))
    gone = docs.join(first, "h").where("id <> first").select(F.col("id").alias("target_id"))
    return hygiene.store_stats(docs, "source", gone)


# --- checks on text ---------------------------------------------------------------------


def _bank(bank: tuple[tuple[str, str], ...]) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches(text, '{p}') THEN '{n}'" for n, p in bank) + " END"


@query(f"SELECT doc_id, {_bank(SECRETS)} AS shape FROM documents WHERE shape IS NOT NULL")
def secret_shaped_values(spark, sf_dir):
    """Records with secret-shaped values."""
    return table(spark, sf_dir, "documents").select("doc_id", has_shape(F.col("text"), SECRETS).alias("shape")).where("shape is not null")


@query(f"SELECT page_id, {_bank(QUOTE_EXCLUSIONS)} AS shape FROM (SELECT page_id, url AS text FROM pages) WHERE shape IS NOT NULL")
def quote_exclusions(spark, sf_dir):
    """Texts that can't be quotes."""
    return table(spark, sf_dir, "pages").select("page_id", has_shape(F.col("url"), QUOTE_EXCLUSIONS).alias("shape")).where("shape is not null")


@query("SELECT b.item_id AS quote_id, d.doc_id AS id FROM benchmark b JOIN documents d ON contains(d.text, b.text) WHERE b.text <> ''")
def verbatim_quotes(spark, sf_dir):
    """Quotes that stand verbatim in a record."""
    q = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    return matching.verbatim(q, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT event_type AS name, count(*) AS n FROM events WHERE event_type IN ('click', 'purchase', 'absent') GROUP BY event_type")
def missing_facts_semi(spark, sf_dir):
    """Found facts that were missing."""
    missing = spark.createDataFrame([("click",), ("purchase",), ("absent",)], "name string")
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("name")).join(missing, "name", "left_semi").groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    """SELECT c_custkey AS candidate_id, coalesce(i.p, n.p) AS person_id, CASE WHEN i.p IS NOT NULL THEN 'identifier' WHEN n.p IS NOT NULL THEN 'name' ELSE 'new' END AS matched_by
    FROM customer c
    LEFT JOIN (SELECT s_suppkey AS k, min(s_suppkey) AS p FROM supplier GROUP BY ALL) i ON i.k = c_custkey % 300
    LEFT JOIN (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END AS name, s_nationkey, min(s_suppkey) AS p FROM supplier GROUP BY ALL) n
      ON n.name = c_mktsegment AND n.s_nationkey = c_nationkey"""
)
def identifier_first_match(spark, sf_dir):
    """Candidates matched by identifier, then by name."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("candidate_id"), (F.col("c_custkey") % 300).alias("identifier"), F.col("c_mktsegment").alias("name"), F.col("c_nationkey").alias("relationship"))
    s = table(spark, sf_dir, "supplier")
    by_id = s.select(F.col("s_suppkey").alias("identifier"), F.col("s_suppkey").alias("person_id"))
    by_name = s.select(F.when(F.col("s_suppkey") % 2 == 0, "BUILDING").otherwise("MACHINERY").alias("name"), F.col("s_nationkey").alias("relationship"), F.col("s_suppkey").alias("person_id"))
    return matching.person_match(c, by_id, by_name)


@query("SELECT c_custkey AS id, c_mktsegment AS name, c_custkey % 5 + 1 AS confidence FROM customer WHERE c_custkey % 5 + 1 >= 3 AND c_mktsegment NOT IN ('HOUSEHOLD')")
def storable_people(spark, sf_dir):
    """Candidates that are sure enough and not excluded."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), (F.col("c_custkey") % 5 + 1).alias("confidence"))
    return matching.storable(c, spark.createDataFrame([("HOUSEHOLD",)], "name string")).select("id", "name", "confidence")


@query(
    r"""WITH p AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM benchmark),
    d AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM documents),
    s AS (SELECT item_id AS phrase_id, doc_id AS id, count(*) AS n_shared FROM p JOIN d USING (w) GROUP BY ALL)
    SELECT phrase_id, id, n_shared, row_number() OVER (PARTITION BY phrase_id ORDER BY n_shared DESC, id) AS rank FROM s QUALIFY rank <= 6"""
)
def search_candidates(spark, sf_dir):
    """The six best homes of each phrase."""
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("phrase_id"), F.col("text").alias("phrase"))
    return matching.search_hits(p, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text"))


@query("SELECT target, count(DISTINCT page_id) AS n_pages FROM (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]*)\"', 1)) AS target FROM pages) GROUP BY target")
def reverse_links(spark, sf_dir):
    """Pages by what they link to."""
    links = table(spark, sf_dir, "pages").select("page_id", F.explode(F.regexp_extract_all("html", F.lit('href="([^"]*)"'), F.lit(1))).alias("target"))
    return links.distinct().groupBy("target").agg(F.count(F.lit(1)).alias("n_pages"))


def _categories() -> str:
    return ", ".join(f"'{c}'" for c in CATEGORIES)


@query(
    f"""WITH r AS (SELECT doc_id AS id, coalesce([{_categories()}][doc_id % 12 + 1], 'Other') AS category, text AS description, (doc_id % 5 - 2) / 1.6 AS sentiment, (doc_id % 11) / 9.0 AS exposure FROM documents)
    SELECT id, array_to_string(list_filter([CASE WHEN category IN ({_categories()}) THEN NULL ELSE 'category' END, CASE WHEN sentiment BETWEEN -1 AND 1 THEN NULL ELSE 'sentiment' END,
      CASE WHEN exposure BETWEEN 0 AND 1 THEN NULL ELSE 'exposure' END, CASE WHEN length(description) <= CASE WHEN category = 'Technical' THEN 900 ELSE 500 END THEN NULL ELSE 'description_length' END],
      lambda x: x IS NOT NULL), ',') AS broken FROM r WHERE broken <> ''"""
)
def record_contract_violations(spark, sf_dir):
    """Records that break the judge's contract."""
    d, i = table(spark, sf_dir, "documents"), F.col("doc_id")
    kinds = F.array(*map(F.lit, CATEGORIES))
    r = d.select(i.alias("id"), F.coalesce(F.get(kinds, (i % 12).cast("int")), F.lit("Other")).alias("category"), F.col("text").alias("description"), ((i % 5 - 2) / F.lit(1.6)).alias("sentiment"), ((i % 11) / F.lit(9.0)).alias("exposure"))
    return judge.violations(r, judge.record_rules()).select("id", "broken")


# --- audits -----------------------------------------------------------------------------


@query("SELECT symbol, count(DISTINCT source) AS n_files FROM (SELECT string_split(text, ' ')[1] AS symbol, source FROM documents) GROUP BY symbol HAVING n_files > 1")
def duplicated_symbols_across_files(spark, sf_dir):
    """Names that several files declare."""
    return audit.duplicated_symbols(table(spark, sf_dir, "documents").select(F.get(F.split("text", " "), F.lit(0)).alias("symbol"), F.col("source").alias("file")))


@query(
    """WITH e AS (SELECT n_name AS message, count(*) AS n FROM nation WHERE n_nationkey < 20 GROUP BY n_name),
    a AS (SELECT n_name AS message, count(*) AS n FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 9 = 0 GROUP BY n_name)
    SELECT coalesce(e.message, a.message) AS message, coalesce(e.n, 0) AS n_expected, coalesce(a.n, 0) AS n_actual,
    CASE WHEN a.n IS NULL THEN 'missing' WHEN e.n IS NULL THEN 'unexpected' WHEN a.n > e.n THEN 'repeated' ELSE 'ok' END AS verdict
    FROM e FULL JOIN a ON e.message = a.message"""
)
def expected_vs_actual_audit(spark, sf_dir):
    """Commit messages, each wanted once."""
    n = table(spark, sf_dir, "nation")
    s = table(spark, sf_dir, "supplier").where("s_suppkey % 9 = 0")
    return audit.commit_audit(n.where("n_nationkey < 20").select(F.col("n_name").alias("message")), s.join(n, s.s_nationkey == n.n_nationkey).select(F.col("n_name").alias("message")))


MAPPED = "SELECT n_regionkey AS target, n_name AS symbol, n_nationkey % 3 = 0 AS exported, (n_regionkey + n_nationkey % 2) AS destination FROM nation WHERE n_nationkey % 5 <> 0"


def _decls(spark, sf_dir):
    return table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_regionkey").alias("target"), F.col("n_name").alias("symbol"))


def _mapped(spark, sf_dir):
    n = F.col("n_nationkey")
    return table(spark, sf_dir, "nation").where(n % 5 != 0).select(F.col("n_regionkey").alias("target"), F.col("n_name").alias("symbol"), (n % 3 == 0).alias("exported"), (F.col("n_regionkey") + n % 2).alias("destination"))


DECLS = "SELECT n_regionkey AS target, n_name AS symbol FROM nation WHERE n_nationkey % 4 <> 0"


@query(f"SELECT *, 'unmapped' AS side FROM ({DECLS} EXCEPT SELECT target, symbol FROM ({MAPPED})) UNION ALL SELECT *, 'undeclared' FROM (SELECT target, symbol FROM ({MAPPED}) EXCEPT {DECLS})")
def symbol_map_coverage(spark, sf_dir):
    """Symbols that the map or the source lacks."""
    return audit.uncovered(_decls(spark, sf_dir), _mapped(spark, sf_dir))


@query(f"SELECT m.target, m.symbol, m.destination FROM ({MAPPED}) m WHERE exported AND destination <> target AND EXISTS (SELECT 1 FROM nation JOIN supplier ON s_nationkey = n_nationkey WHERE s_suppkey % 5 <> n_regionkey AND n_regionkey = m.target AND n_name = m.symbol)")
def compat_reexports(spark, sf_dir):
    """Moved symbols that others import."""
    s, n = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    edges = s.join(n, s.s_nationkey == n.n_nationkey).select((F.col("s_suppkey") % 5).alias("src_file"), F.col("n_regionkey").alias("target_file"), F.col("n_name").alias("name"))
    return audit.compat_exports(_mapped(spark, sf_dir), edges).select("target", "symbol", "destination")


@query(f"SELECT target, symbol FROM ({MAPPED}) WHERE destination <> target INTERSECT {DECLS}")
def leftover_symbols(spark, sf_dir):
    """Moved symbols that are still declared."""
    return audit.leftovers(_mapped(spark, sf_dir), _decls(spark, sf_dir)).select("target", "symbol")


@query("SELECT symbol, path, count(*) AS n FROM (SELECT doc_id AS path, unnest(regexp_extract_all(text, '[A-Za-z_][A-Za-z0-9_]*')) AS symbol FROM documents) WHERE symbol IN (SELECT string_split(text, ' ')[1] FROM benchmark) GROUP BY ALL")
def leftover_mentions(spark, sf_dir):
    """Files that still name moved symbols."""
    symbols = table(spark, sf_dir, "benchmark").select(F.get(F.split("text", " "), F.lit(0)).alias("symbol"))
    return audit.leftover_mentions(symbols, table(spark, sf_dir, "documents").select(F.col("doc_id").alias("path"), "text"))


@query("SELECT 1 AS plan, r_regionkey AS step, r_regionkey + 3 AS stated, coalesce(n, 0) AS moved, coalesce(n, 0) = r_regionkey + 3 AS ok FROM region LEFT JOIN (SELECT n_regionkey, count(*) AS n FROM nation GROUP BY ALL) ON n_regionkey = r_regionkey")
def step_tally(spark, sf_dir):
    """Moved symbols against the number stated."""
    steps = table(spark, sf_dir, "region").select(F.lit(1).alias("plan"), F.col("r_regionkey").alias("step"), (F.col("r_regionkey") + 3).alias("stated"))
    return audit.step_tally(steps, table(spark, sf_dir, "nation").select(F.lit(1).alias("plan"), F.col("n_regionkey").alias("step")))


@query("WITH RECURSIVE l AS (SELECT n_nationkey AS id, 0 AS level FROM nation WHERE n_nationkey = 0 UNION ALL SELECT n_nationkey, level + 1 FROM l JOIN nation ON n_nationkey // 2 = l.id AND n_nationkey > 0) SELECT id, level FROM l")
def plan_levels(spark, sf_dir):
    """Plans in dependency order."""
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("id"))
    return audit.plan_levels(n, n.where("id > 0").select("id", F.floor(F.col("id") / 2).cast("int").alias("needs")))


@query("SELECT p_partkey AS plan, row_number() OVER (ORDER BY CASE p_size % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 WHEN 2 THEN 3 ELSE 4 END, p_size, p_partkey) AS place FROM part")
def plan_order(spark, sf_dir):
    """Plans by pattern, the easiest first."""
    size = F.col("p_size")
    pattern = F.when(size % 4 == 0, "pure move").when(size % 4 == 1, "unit move").when(size % 4 == 2, "block extraction").otherwise("other")
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("plan"), pattern.alias("pattern"), size.alias("difficulty"))
    return audit.plan_order(p).select("plan", "place")


@query("SELECT session_id, 'source:store1:host:' || session_id || ' collected:2024-02-01' AS tags FROM (SELECT DISTINCT conv_id AS session_id FROM conversations)")
def tagged_records(spark, sf_dir):
    """Records with their tags."""
    s = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id")).distinct()
    return s.select("session_id", F.array_join(store.tags(F.lit("store1"), "host", F.col("session_id"), "2024-02-01"), " ").alias("tags"))


@query(
    f"""SELECT session_id, arg_max(status, row(seen, status)) AS status, epoch_us(max(seen)) AS at FROM (
      SELECT session_id, 'skipped-trivial' AS status, last_at - INTERVAL 1 DAY AS seen FROM {TIMED} WHERE session_id % 2 = 0
      UNION ALL SELECT session_id, 'processed', last_at FROM {TIMED} WHERE session_id % 3 = 0) GROUP BY session_id"""
)
def cursor_write(spark, sf_dir):
    """The cursor after a run."""
    s = timed(spark, sf_dir)
    row = lambda df, status, at: df.select(F.lit("t").alias("tool"), "session_id", F.lit(status).alias("status"), at.alias("at"))
    old = row(s.where("session_id % 2 = 0"), "skipped-trivial", F.col("last_at") - F.expr("interval 1 day"))
    return store.advanced(old, row(s.where("session_id % 3 = 0"), "processed", F.col("last_at"))).select("session_id", "status", *micros("at"))


@query("SELECT * FROM (VALUES ('graph', 'dedup', false, 'search'), ('graph', 'decay', true, ''), ('graph', 'split', false, 'search'), ('graph', 'invalidate', true, ''), ('graph', 'reconnect', true, ''), ('graph', 'summarize', false, 'diary'), ('graph', 'report', true, '')) t(store, phase, runs, missing)")
def capability_survey(spark, sf_dir):
    """Phases that a store's capabilities allow."""
    return store.phases(spark.createDataFrame([("graph", "graph"), ("graph", "mutate")], "store string, capability string"))


# --- inventories and readers, over hand-made inputs -------------------------------------


def _found(spark) -> DataFrame:
    files = spark.createDataFrame(list(SOURCES.items()), "path string, text string")
    return materialize(inventory.inventory(files), "inventory")


DECLARED = """
  ('lib/model.dart', 'enum', 'Kind', 1, 1, 'yes'), ('lib/model.dart', 'class', 'Model', 3, 7, 'yes'),
  ('lib/my_model.dart', 'function', '_name', 3, 3, 'no'), ('lib/page.dart', 'widget (stateless)', 'Page', 3, 8, 'yes'),
  ('src/core/mod.rs', 'mod', 'store', 1, 1, 'yes'), ('src/core/mod.rs', 'fn', 'limit', 2, 2, 'pub(crate)'),
  ('src/core/mod.rs', 'static', 'COUNT', 3, 3, 'no'), ('src/core/mod.rs', 'struct', 'Key', 4, 4, 'yes'),
  ('src/core/mod.rs', 'fn', 'raw', 5, 5, 'no'), ('src/core/store.rs', 'impl', 'impl Key', 4, 7, 'no'),
  ('src/shop/api.py', 'function', 'fetch', 5, 6, 'yes'), ('src/shop/models.py', 'const', '__all__', 4, 4, 'no'),
  ('src/shop/models.py', 'const', 'LIMIT', 6, 6, 'yes'), ('src/shop/models.py', 'class', 'Item', 10, 14, 'yes'),
  ('src/shop/models.py', 'function', 'hidden', 17, 18, 'no'), ('tests/test_api.py', 'function', 'test_fetch', 4, 5, 'yes'),
  ('web/card.tsx', 'component', 'Card', 5, 8, 'yes'), ('web/util.ts', 'function', 'price', 1, 1, 'yes'),
  ('web/util.ts', 'type', 'Id', 2, 2, 'yes'), ('web/util.ts', 'enum', 'Color', 3, 3, 'no'), ('web/util.ts', 'const', 'LIMIT', 4, 4, 'no')"""


@query(f"SELECT * FROM (VALUES {DECLARED}) t(file, kind, name, start, \"end\", exported)")
def inventory_decls(spark, sf_dir):
    """Declarations of the sample files."""
    return _found(spark).where("section = 'decl'").select("file", "kind", "name", "start", "end", "exported")


@query(
    """SELECT * FROM (VALUES ('src/core/store.rs', 'src/core/mod.rs', 'limit'), ('src/core/store.rs', 'src/core/mod.rs', 'Key'),
    ('src/shop/api.py', 'src/shop/models.py', 'models'), ('src/shop/api.py', 'src/shop/models.py', 'Item'), ('src/shop/api.py', 'src/shop/models.py', 'LIMIT'),
    ('tests/test_api.py', 'src/shop/api.py', 'shop.api'), ('lib/my_model.dart', 'lib/model.dart', '*'), ('lib/page.dart', 'lib/model.dart', '*'),
    ('web/card.tsx', 'web/util.ts', 'price')) t(src_file, target_file, name)"""
)
def inventory_import_edges(spark, sf_dir):
    """Imports among the sample files."""
    return inventory.import_edges(_found(spark))


@query(
    """SELECT * FROM (VALUES ('src/core/store.rs', 'impl Key', 'id'), ('src/core/store.rs', 'impl Key', 'text'), ('src/shop/models.py', 'Item', 'label'),
    ('lib/model.dart', 'Model', 'twice'), ('lib/page.dart', 'Page', 'Page'), ('lib/page.dart', 'Page', 'build')) t(file, owner, name)"""
)
def inventory_members(spark, sf_dir):
    """Members of the sample files' declarations."""
    return _found(spark).where("section = 'member'").select("file", "owner", "name")


@query("SELECT file, name, kind, moved_to FROM (VALUES ('src/shop/models.py', 'Item', 'class', 'src/shop/item.py'), ('src/shop/models.py', 'LIMIT', 'const', 'src/shop/item.py')) t(file, name, kind, moved_to)")
def inventory_moved_exports(spark, sf_dir):
    """Exports of a file to be split that other files import by name."""
    found = _found(spark)
    mapped = found.where("section = 'decl' and file = 'src/shop/models.py'").select(F.col("file").alias("target"), F.col("name").alias("symbol"), "kind", (F.col("exported") == "yes").alias("exported"), F.lit("src/shop/item.py").alias("destination"))
    out = audit.compat_exports(mapped, inventory.import_edges(found))
    return out.select(F.col("target").alias("file"), F.col("symbol").alias("name"), "kind", F.col("destination").alias("moved_to"))



def _written(spark: SparkSession, files: dict[str, list[str]], label: str) -> str:
    """A folder in the shared place with the files of a sample store."""
    root = shared_path(spark, label)
    for name, lines in files.items():
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/{name}")
        out = path.getFileSystem(spark._jsc.hadoopConfiguration()).create(path, True)
        out.write("\n".join(lines).encode())
        out.close()
    return root


def _sessions(found: DataFrame) -> DataFrame:
    return found.select("tool", "id", "title", "cwd", *micros("first_at", "last_at"), "message_count")


def _said(messages: DataFrame) -> DataFrame:
    return stores.ordered(messages).select("tool", "session_id", "n", "line_no", "id", "role", "content", *micros("ts"))


def _threads(spark: SparkSession):
    import sqlite3

    root = _written(spark, STORE3, "store3")
    folder = root.removeprefix("file://")
    with sqlite3.connect(f"{folder}/state_2.sqlite") as db:
        db.execute("CREATE TABLE threads (id TEXT, rollout_path TEXT, title TEXT, first_user_message TEXT, cwd TEXT, created_at INT, updated_at INT)")
        db.executemany("INSERT INTO threads VALUES (?,?,?,?,?,?,?)", [(i, p and f"{folder}/{p}", *rest) for i, p, *rest in THREADS])
    newest = sqlite.newest_state(["state_2.sqlite", "state.sqlite"])
    return stores.thread_store(sqlite.read_table(spark, f"{folder}/{newest}"), stores.transcript_files(spark, [root]))


@query("SELECT * FROM (VALUES ('store1', 's1', 'shop', '/work/shop', 1704103200000000, 1704103500000000, 2)) t(tool, id, title, cwd, first_at, last_at, message_count)")
def readers_normalize(spark, sf_dir):
    """Sessions of a sample store of the first kind."""
    return _sessions(project_store(spark, _written(spark, STORE1, "store1"))[0])


@query("SELECT * FROM (VALUES ('store1', 's1', 1, 5, 'u1', 'user', 'hello there', 1704103200000000), ('store1', 's1', 2, 6, 'a1', 'assistant', 'one' || chr(10) || chr(10) || 'two', 1704103260000000), ('store1', 's2', 1, 1, 'b1', 'assistant', 'no time', 0)) t(tool, session_id, n, line_no, id, role, content, ts)")
def readers_messages(spark, sf_dir):
    """Messages of that store, with texts, ids, roles and times."""
    return _said(project_store(spark, _written(spark, STORE1, "store1"))[1])


@query("SELECT * FROM (VALUES ('store2', 'abc', 'shop', '/work/shop', 1704186000000000, 1704186060000000, 2), ('store2', 'd_e', 'me', '/home/me', 1704272400000000, 1704272400000000, 1)) t(tool, id, title, cwd, first_at, last_at, message_count)")
def session_store_sessions(spark, sf_dir):
    """Sessions of a sample store of the second kind, over two roots of which one isn't there."""
    root = _written(spark, STORE2, "store2")
    return _sessions(stores.session_store(spark, [root, f"{root}-absent"])[0])


@query("SELECT * FROM (VALUES ('store2', 'abc', 1, 2, 'abc/m1', 'user', 'hi', 1704186000000000), ('store2', 'abc', 2, 3, 'abc/m2', 'assistant', 'a' || chr(10) || chr(10) || 'b', 1704186060000000), ('store2', 'd_e', 1, 1, 'd_e/k', 'user', 'alone', 1704272400000000)) t(tool, session_id, n, line_no, id, role, content, ts)")
def session_store_messages(spark, sf_dir):
    """Messages of that store."""
    return _said(stores.session_store(spark, [_written(spark, STORE2, "store2")])[1])


@query("SELECT * FROM (VALUES ('store3', 't1', 'first question', '/w/p', 1704362400000000, 1704363000000000, 2)) t(tool, id, title, cwd, first_at, last_at, message_count)")
def thread_store_sessions(spark, sf_dir):
    """Sessions of a sample store of the third kind: a SQLite table joined with its files."""
    return _sessions(_threads(spark)[0])


@query("SELECT * FROM (VALUES ('store3', 't1', 1, 2, 'evt_2', 'user', 'start', 1704362400000000), ('store3', 't1', 2, 3, 'evt_3', 'assistant', 'done', 1704363000000000)) t(tool, session_id, n, line_no, id, role, content, ts)")
def thread_store_messages(spark, sf_dir):
    """Messages of that store."""
    return _said(_threads(spark)[1])


@query("""SELECT 'store3' AS tool, 't1' AS id, 'first question' AS title, 2 AS message_count, 'user: start | assistant: done' AS said, '2024-01-04T10:10:00.000Z' AS last_said""")
def session_json_documents(spark, sf_dir):
    """Sessions as nested documents, read back by their fields."""
    doc = stores.session_json(*_threads(spark))
    schema = "title string, messageCount long, messages array<struct<role string, content string, timestamp string>>"
    read = doc.select("tool", "id", F.from_json("json", schema).alias("d"))
    said = F.array_join(F.transform("d.messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])), " | ")
    return read.select("tool", "id", "d.title", F.col("d.messageCount").alias("message_count"), said.alias("said"), F.element_at("d.messages.timestamp", -1).alias("last_said"))


@query("SELECT 4 AS n_sessions, 8 AS n_messages")
def stores_union(spark, sf_dir):
    """What all stores have together."""
    found = [project_store(spark, _written(spark, STORE1, "store1")), stores.session_store(spark, [_written(spark, STORE2, "store2")]), _threads(spark)]
    n = lambda i: found[0][i].unionByName(found[1][i]).unionByName(found[2][i]).agg(F.count(F.lit(1)).alias("n"))
    return store.beside(n(0).select(F.col("n").alias("n_sessions")), n(1).select(F.col("n").alias("n_messages")))


# --- decisions by rule ------------------------------------------------------------------


@query(
    """WITH r AS (SELECT doc_id, count(*) AS refs FROM labels GROUP BY doc_id),
    m AS (SELECT md5(text) AS cluster_id, doc_id AS id, coalesce(refs, 0) AS refs, count(*) OVER (PARTITION BY text) AS n FROM documents LEFT JOIN r USING (doc_id) WHERE text IS NOT NULL),
    c AS (SELECT *, first_value(id) OVER (PARTITION BY cluster_id ORDER BY refs DESC, id) AS canonical_id FROM m WHERE n > 1)
    SELECT cluster_id, CASE WHEN id = canonical_id THEN 'update' ELSE 'remove' END AS action, id, CASE WHEN id <> canonical_id THEN canonical_id END AS replaced_by FROM c"""
)
def dedup_decisions(spark, sf_dir):
    """What becomes of each record of a cluster of copies."""
    docs = table(spark, sf_dir, "documents").where("text is not null").select(F.md5("text").alias("cluster_id"), F.col("doc_id").alias("id"), F.col("doc_id").alias("created"))
    several = docs.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    refs = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("id")).agg(F.count(F.lit(1)).alias("refs"))
    return curation.dedup_decisions(docs.join(several.select("cluster_id"), "cluster_id", "left_semi"), refs)


@query("SELECT count(*) AS n_clusters, 0::BIGINT AS n_broken FROM (SELECT text FROM documents WHERE text IS NOT NULL GROUP BY text HAVING count(*) > 1)")
def dedup_contract(spark, sf_dir):
    """Clusters whose decisions break the merge contract."""
    counts = materialize(curation.decision_counts(dedup_decisions(spark, sf_dir)), "dedup-counts")
    broken = judge.violations(counts, judge.merge_rules()).agg(F.count(F.lit(1)).alias("n_broken"))
    return store.beside(counts.agg(F.count(F.lit(1)).alias("n_clusters")), broken)


@query(f"SELECT row_number() OVER (ORDER BY similarity DESC, id_a, id_b) AS place, * FROM (SELECT a.vec_id AS id_a, b.vec_id AS id_b, {COSINE} AS similarity FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id WHERE {COSINE} >= 0.3) QUALIFY place <= 50")
def budgeted_comparisons(spark, sf_dir):
    """The pairs that one run may judge."""
    return curation.within_comparisons(vectors.similar_pairs(_vectors(spark, sf_dir), 0.3)).select("place", "id_a", "id_b", "similarity")


@query("SELECT item_id % 3 AS cluster_id, item_id AS phrase_id, row_number() OVER (PARTITION BY item_id % 3 ORDER BY length(text) DESC, item_id) AS place FROM benchmark QUALIFY place <= 6")
def cluster_search_budget(spark, sf_dir):
    """The six searches of each cluster."""
    p = table(spark, sf_dir, "benchmark").select((F.col("item_id") % 3).alias("cluster_id"), F.col("item_id").alias("phrase_id"), F.char_length("text").alias("priority"))
    return curation.within_searches(p).select("cluster_id", "phrase_id", "place")


ITEMS = r"(SELECT doc_id AS id, text, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents WHERE length(text) > 750)"
NAMED = r"(SELECT name, min(id) AS target_id FROM (SELECT doc_id AS id, array_to_string(regexp_extract_all(string_split(text, ' ')[1], '[^\x20\x09-\x0D]+')[1:5], ' ') AS name FROM documents) WHERE name <> '' GROUP BY name)"


def _items(spark, sf_dir):
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")


def _named(spark, sf_dir):
    first = F.get(F.split("text", " "), F.lit(0))
    name = F.array_join(F.slice(F.regexp_extract_all(first, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), F.lit(5)), " ")
    return _items(spark, sf_dir).select("id", name.alias("name")).where("name <> ''").groupBy("name").agg(F.min("id").alias("target_id"))


@query(
    rf"""WITH i AS {ITEMS},
    s AS (SELECT id, unnest(lines[2:]) AS content FROM i),
    w AS (SELECT *, regexp_extract_all(content, '[^\x20\x09-\x0D]+') AS w FROM s),
    p AS (SELECT id, content, array_to_string(w[1:5], ' ') AS name FROM w WHERE len(w) >= 2),
    h AS (SELECT p.*, n.target_id FROM p LEFT JOIN {NAMED} n USING (name))
    SELECT id, 'original' AS kind, id AS target_id, NULL AS name, md5(CASE WHEN id IN (SELECT id FROM p) THEN lines[1] ELSE text END) AS description_md5 FROM i
    UNION ALL SELECT id, CASE WHEN target_id <> id THEN 'existing' ELSE 'new' END, CASE WHEN target_id <> id THEN target_id END, name, md5(content) FROM h"""
)
def split_topics(spark, sf_dir):
    """Records over the line, split by their lines."""
    out = curation.split_topics(_items(spark, sf_dir), _named(spark, sf_dir))
    return out.withColumn("description_md5", F.md5("description")).drop("description")


@query("SELECT count(*) AS n_items, 0::BIGINT AS n_broken FROM documents WHERE length(text) > 750")
def split_contract(spark, sf_dir):
    """Splits that break their contract."""
    items = _items(spark, sf_dir)
    counts = materialize(curation.split_counts(curation.split_topics(items, _named(spark, sf_dir)), items), "split-counts")
    return store.beside(counts.agg(F.count(F.lit(1)).alias("n_items")), judge.violations(counts, judge.split_rules()).agg(F.count(F.lit(1)).alias("n_broken")))


SENTENCES = r"(SELECT doc_id AS id, text, list_filter(list_transform(regexp_split_to_array(text, '[.!?\n]+'), lambda s: regexp_replace(s, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g')), lambda s: s <> '') AS s FROM documents)"
FOREIGN = "[0-9#@]|https?://"


@query(
    rf"""WITH p AS {SENTENCES}, e AS (SELECT id, unnest(s) AS content, generate_subscripts(s, 1) - 1 AS n FROM p),
    w AS (SELECT *, regexp_extract_all(content, '[^\x20\x09-\x0D]+') AS w FROM e WHERE regexp_matches(content, '{FOREIGN}'))
    SELECT id, n::INTEGER AS n, array_to_string(w[1:8], ' ') AS phrase FROM w WHERE len(w) >= 3"""
)
def person_subjects(spark, sf_dir):
    """What doesn't belong in a relationship profile."""
    return curation.person_subjects(_items(spark, sf_dir)).select("id", "n", "phrase")


@query(
    rf"""WITH p AS {SENTENCES}, e AS (SELECT id, unnest(s) AS content FROM p),
    w AS (SELECT *, regexp_extract_all(content, '[^\x20\x09-\x0D]+') AS w FROM e WHERE regexp_matches(content, '{FOREIGN}')),
    q AS (SELECT id, content, array_to_string(w[1:8], ' ') AS name FROM w WHERE len(w) >= 3),
    h AS (SELECT q.*, n.target_id FROM q LEFT JOIN {NAMED} n USING (name))
    SELECT id, 'original' AS kind, id AS target_id, md5(CASE WHEN id IN (SELECT id FROM q) THEN array_to_string(list_filter(s, lambda x: NOT regexp_matches(x, '{FOREIGN}'))[1:4], '. ') ELSE text END) AS description_md5 FROM p
    UNION ALL SELECT id, CASE WHEN target_id <> id THEN 'existing' ELSE 'new' END, CASE WHEN target_id <> id THEN target_id END, md5(content) FROM h"""
)
def split_people(spark, sf_dir):
    """Descriptions of people, split from what else they hold."""
    out = curation.split_people(_items(spark, sf_dir), _named(spark, sf_dir))
    return out.select("id", "kind", "target_id", F.md5("description").alias("description_md5"))


PEOPLE = r"(SELECT session_id, name, least(count(*), 5)::INTEGER AS confidence FROM (SELECT doc_id % 50 AS session_id, unnest(regexp_extract_all(text, '\b[A-Z][a-z]+ [A-Z][a-z]+\b')) AS name FROM documents) WHERE name NOT IN ('The The') GROUP BY ALL)"


def _people(spark, sf_dir):
    said = table(spark, sf_dir, "documents").select((F.col("doc_id") % 50).alias("session_id"), "text")
    return curation.people(said, spark.createDataFrame([("The The",)], "name string"))


@query(PEOPLE[1:-1])
def person_scan(spark, sf_dir):
    """Names that come up, by session."""
    return _people(spark, sf_dir)


@query(
    f"""SELECT k.person_id, p.name, p.name || ' comes up in ' || p.n || ' sessions.' AS description, 0.0::DOUBLE AS sentiment, 'Unknown' AS relationship, 1 AS n_primary
    FROM (SELECT name, count(*) AS n FROM {PEOPLE} WHERE confidence >= 2 GROUP BY name) p LEFT JOIN (SELECT name, min(session_id) AS person_id FROM {PEOPLE} WHERE session_id < 25 GROUP BY name) k USING (name)"""
)
def person_update(spark, sf_dir):
    """Records of the people that come up."""
    found = materialize(_people(spark, sf_dir), "people")
    return curation.updated_people(found, found.where("session_id < 25").select("name", F.col("session_id").alias("person_id")), 2)


@query(
    rf"""WITH m AS (SELECT conv_id AS session_id, turn AS n, length(text) - length(replace(text, '!', '')) AS marks,
      regexp_replace(left(array_to_string(regexp_extract_all(text, '[^\x20\x09-\x0D]+')[1:8], ' '), 50), '[\x20\x09-\x0D]+$', '') AS name FROM conversations)
    SELECT session_id, n, name FROM m WHERE marks > 0 AND length(name) >= 5 QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY marks DESC, n, name) = 1"""
)
def event_scan(spark, sf_dir):
    """At most one event of each session."""
    return curation.events(messages(spark, sf_dir))


FOUND = r"""(SELECT name, arg_min(value, (session_id, n, value)) AS value, min(session_id) AS session_id, arg_min(n, (session_id, n, value)) AS n FROM (
      SELECT session_id, n, w[i] AS name, w[i + 1] AS value FROM (SELECT *, unnest(range(1, len(w))) AS i FROM (
        SELECT conv_id AS session_id, turn AS n, list_transform(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+'), lambda x: regexp_replace(x, '^[^0-9A-Za-z_]+|[^0-9A-Za-z_]+$', '', 'g')) AS w FROM conversations)))
    WHERE name IN (SELECT lower(event_type) FROM events UNION SELECT 'the' UNION SELECT 'is' UNION SELECT 'no such fact') AND value <> '' GROUP BY name)"""


def _missing(spark, sf_dir):
    names = table(spark, sf_dir, "events").select(F.lower("event_type").alias("name"))
    return names.unionByName(spark.createDataFrame([("the",), ("is",), ("no such fact",)], "name string")).distinct()


@query(FOUND[1:-1])
def facts_found(spark, sf_dir):
    """Missing facts where they are first said."""
    return curation.facts(messages(spark, sf_dir), _missing(spark, sf_dir))


@query(f"SELECT name FROM (SELECT lower(event_type) AS name FROM events UNION SELECT 'the' UNION SELECT 'is' UNION SELECT 'no such fact') WHERE name NOT IN (SELECT name FROM {FOUND})")
def facts_still_missing(spark, sf_dir):
    """The list without the facts that were found."""
    missing = materialize(_missing(spark, sf_dir), "missing-facts")
    return curation.still_missing(missing, curation.facts(messages(spark, sf_dir), missing))


@query(f"SELECT user_id AS id, epoch_us(TIMESTAMP '{AS_OF}' + INTERVAL 30 DAYS) AS expires_at FROM events GROUP BY user_id HAVING max(ts) < TIMESTAMP '{AS_OF}' - INTERVAL 1 DAY AND count(*) < 20")
def trivia_expiry(spark, sf_dir):
    """Stale trivia with the time at which it expires."""
    t = F.max("ts")
    items = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("id")).agg(t.alias("mentioned"), t.alias("retrieved"), t.alias("updated"), (F.count(F.lit(1)) < 20).alias("trivia"))
    as_of = F.lit(AS_OF).cast("timestamp")
    return hygiene.expiring(hygiene.stale(items, as_of, 1), "trivia", as_of).select("id", *micros("expires_at"))


@query(
    f"""WITH m AS {MUTATIONS} SELECT count(*) FILTER (WHERE op = 'merge') AS n_merge, count(*) AS used, count(*) FILTER (WHERE op = 'merge' AND target_id % 2 = 0) AS n_executed,
    count(*) FILTER (WHERE op = 'merge' AND target_id % 2 = 1) AS n_deferred, 0::BIGINT AS n_proposed, 'dedup: search; split: search; summarize: diary' AS skipped FROM m"""
)
def gardening_report_full(spark, sf_dir):
    """The report with its removals and skipped phases."""
    done = materialize(_mutations(spark, sf_dir), "report-mutations")
    removals = hygiene.routed(done.where("op = 'merge'").withColumn("certain", F.col("target_id") % 2 == 0), True)
    have = store.phases(spark.createDataFrame([("graph", "graph"), ("graph", "mutate")], "store string, capability string"))
    return hygiene.full_report(done, removals, have).select("n_merge", "used", "n_executed", "n_deferred", "n_proposed", "skipped")


@query(
    f"""WITH m AS {MUTATIONS}, o AS (SELECT 'The interval brought ' || count(*) || ' records.' AS a FROM orders),
    t AS (SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate DESC, 'order ' || o_orderkey LIMIT 4),
    l AS (SELECT string_agg(' New: order ' || o_orderkey || '.', '' ORDER BY o_orderdate DESC, 'order ' || o_orderkey) AS b FROM t),
    g AS (SELECT ' Garden health: merge ' || count(*) FILTER (WHERE op = 'merge') || ', decay ' || count(*) FILTER (WHERE op = 'decay') || ', split ' || count(*) FILTER (WHERE op = 'split') || ', invalidate 0, reconnect 0; resume at '
            || CASE WHEN count(*) >= 25 THEN arg_max(target_id, place)::VARCHAR ELSE 'clean' END || '.' AS c FROM m)
    SELECT k.store, k.kind, a || b || c AS text, k.tags FROM o, l, g, (VALUES ('a', 'diary', ''), ('b', 'memory', 'garden-summary')) k(store, kind, tags)"""
)
def diary_entry(spark, sf_dir):
    """The diary entry of a run, for a store with a diary and for one without."""
    notable = table(spark, sf_dir, "orders").select(F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderdate").alias("at"))
    have = spark.createDataFrame([("a", "diary"), ("b", "graph")], "store string, capability string")
    return store.diary_records(store.diary(hygiene.report(_mutations(spark, sf_dir)), notable), have).withColumn("tags", F.array_join("tags", ","))


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment AS description, 'Client' AS relationship FROM customer")
def judge_payload(spark, sf_dir):
    """What a judge is sent of people."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("description"), F.lit("Client").alias("relationship"), F.array(F.col("c_acctbal")).alias("embedding"))
    return judge.payload(c, "person")


@query(f"SELECT id, category FROM (SELECT id, len(s) AS n, coalesce([{_categories()}][id % 12 + 1], 'Other') AS category FROM {SENTENCES}) WHERE n > CASE category WHEN 'Event' THEN 4 WHEN 'Technical' THEN 8 ELSE 6 END")
def description_discipline(spark, sf_dir):
    """Descriptions with more sentences than their kind may have."""
    i = F.col("id")
    items = _items(spark, sf_dir).select("id", F.size(curation._sentences("text")).alias("n_sentences"), F.coalesce(F.get(F.array(*map(F.lit, CATEGORIES)), (i % 12).cast("int")), F.lit("Other")).alias("category"))
    return judge.violations(items.where("n_sentences >= 0"), judge.discipline_rules()).select("id", "category")


@query("SELECT * FROM (VALUES ('src/shop/models.py', 'decorator', 'Item', '@dataclass'), ('src/shop/models.py', 'dynamic', '', 'globals()'), ('src/core/mod.rs', 'attribute', 'Key', '#[derive(Debug)]'), ('web/card.tsx', 'hook', 'Card', 'useState: [n, setN]')) t(file, kind, owner, text)")
def inventory_signals(spark, sf_dir):
    """Signals of the sample files."""
    return _found(spark).where("section = 'signal'").select("file", "kind", "owner", "text")


@query(
    """SELECT * FROM (VALUES ('src/shop/models.py', 1, 'import json'), ('src/shop/models.py', 2, 'from dataclasses import dataclass'), ('src/shop/api.py', 1, 'from . import models'), ('src/shop/api.py', 2, 'from shop.models import Item, LIMIT'),
    ('tests/test_api.py', 1, 'import shop.api'), ('src/core/store.rs', 1, 'use crate::core::{limit, Key};'), ('lib/my_model.dart', 1, 'import ''model.dart'';'), ('lib/page.dart', 1, 'import ''package:shop/model.dart'';'),
    ('web/card.tsx', 1, 'import React, { useState } from ''react'';'), ('web/card.tsx', 2, 'import { price } from ''./util'';'), ('web/card.tsx', 3, 'import "./style";')) t(file, start, text)"""
)
def inventory_imports(spark, sf_dir):
    """Import statements of the sample files."""
    return _found(spark).where("section = 'import'").select("file", "start", "text")


@query(
    """SELECT 'web/card.tsx' AS file, concat_ws(chr(10), '# Inventory: web/card.tsx', '', 'Total lines: 9', '', '## Imports', '', '- `import React, { useState } from ''react'';`', '- `import { price } from ''./util'';`', '- `import "./style";`', '',
      '## Top-level declarations (in order)', '', '| Kind | Name | Lines | Exported |', '|---|---|---|---|', '| component | `Card` | 5-8 | yes |', '', '## Members and signals', '', '- Card hook `useState: [n, setN]`', '',
      '## Imported by (load-bearing exports — keep compatible)', '', '(no other source file imports this module)', '') AS markdown"""
)
def inventory_markdown(spark, sf_dir):
    """The inventory of one sample file as a document."""
    found = _found(spark)
    return inventory.markdown(found, inventory.import_edges(found)).where("file = 'web/card.tsx'")


@query("SELECT 2 AS version, 3::BIGINT AS n_rows, 2::BIGINT AS n_versions")
def snapshot_versions(spark, sf_dir):
    """A store after three snapshots of which two are kept."""
    path = shared_path(spark, "snapshots")
    for n in (1, 2, 3):
        last = store.write_version(spark.range(n), path)
    rows, newest = store.read_version(spark, path, "id long")
    kept = spark.read.option("basePath", path).parquet(path).select("version").distinct().agg(F.count(F.lit(1)).alias("n_versions"))
    return store.beside(rows.agg(F.lit(newest - 1).alias("version"), F.count(F.lit(1)).alias("n_rows")), kept)
