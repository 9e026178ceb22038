"""Two releases of the customer list: the previous one lacks a segment, the current one drops
overdrawn customers and renames a segment."""

from __future__ import annotations

from pyspark.sql import functions as F

from listwright.functions import vocab
from listwright.operators import release as R
from listwright.operators.rules import last_wins_dedupe
from listwright.operators.triples import Term, rows_to_triples
from listwright.plans.registry import query
from listwright.sources.releases import release_load, release_write
from listwright.sources.storage import dealt, scratch

NOW = "2026-01-01T00:00:00Z"
BEFORE = "2025-01-01T00:00:00Z"
ACTIVE = R.status_of("active")


def nodes(customer):
    return customer.select(
        F.concat(F.lit("customer:"), F.col("c_custkey")).alias("id"),
        F.col("c_name").alias("label"),
        F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").alias("nation"),
        F.col("c_acctbal").alias("balance"),
    )


def previous(t):
    return nodes(t.customer.where("c_mktsegment <> 'MACHINERY'")).select(
        "*", F.lit(BEFORE).alias("created"), F.lit(ACTIVE).alias("status")
    )


def current(t):
    renamed = F.when(F.col("segment") == "BUILDING", F.lit("CONSTRUCTION")).otherwise(F.col("segment"))
    return nodes(t.customer.where("c_acctbal >= 0")).withColumn("segment", renamed)


SQL = f"""
WITH prev AS (
  SELECT 'customer:' || c_custkey AS id, c_name AS label, c_mktsegment AS segment, c_nationkey AS nation, c_acctbal AS balance
  FROM customer WHERE c_mktsegment <> 'MACHINERY'),
curr AS (
  SELECT 'customer:' || c_custkey AS id, c_name AS label,
         CASE WHEN c_mktsegment = 'BUILDING' THEN 'CONSTRUCTION' ELSE c_mktsegment END AS segment, c_nationkey AS nation, c_acctbal AS balance
  FROM customer WHERE c_acctbal >= 0),
diff AS (
  SELECT coalesce(c.id, p.id) AS id,
         CASE WHEN p.id IS NULL THEN 'added' WHEN c.id IS NULL THEN 'deleted'
              WHEN p.label <> c.label OR p.segment <> c.segment OR p.nation <> c.nation OR p.balance <> c.balance THEN 'edited'
              ELSE 'unchanged' END AS change,
         c.label, c.segment, c.nation, c.balance
  FROM curr c FULL JOIN prev p ON c.id = p.id)
"""


def _diff(t):
    return R.diff_releases(previous(t), current(t))


def _flat(df):
    return df.withColumn("is_version_of", F.concat_ws("|", "is_version_of"))


@query("diff_releases", SQL + "SELECT id, change, label, segment FROM diff")
def diff_releases(spark, t):
    return _diff(t).select("id", "change", "label", "segment")


@query(
    "stamp_created",
    SQL + f"""SELECT id, change,
      CASE WHEN change = 'added' THEN '{NOW}' ELSE '{BEFORE}' END AS created,
      '{ACTIVE}' AS status FROM diff""",
)
def stamp_created(spark, t):
    return R.stamp_created(_diff(t), NOW).select("id", "change", "created", "status")


@query(
    "stamp_modified",
    SQL + f"""SELECT id, change, CASE WHEN change = 'edited' THEN '{NOW}' END AS modified,
      CASE WHEN change = 'edited' THEN id ELSE '' END AS is_version_of FROM diff""",
)
def stamp_modified(spark, t):
    return _flat(R.stamp_modified(_diff(t), NOW)).select("id", "change", "modified", "is_version_of")


@query(
    "tombstone_deleted",
    SQL + f"""SELECT id, '{R.WITHDRAWN}' AS status, '{NOW}' AS modified, label FROM diff WHERE change = 'deleted'""",
)
def tombstone_deleted(spark, t):
    return R.tombstone_deleted(_diff(t), NOW).where("change = 'deleted'").select("id", "status", "modified", "label")


@query(
    "apply_release",
    SQL + f"""SELECT id, change, label, segment, nation, balance,
      CASE change WHEN 'added' THEN '{NOW}' WHEN 'deleted' THEN NULL ELSE '{BEFORE}' END AS created,
      CASE WHEN change IN ('edited', 'deleted') THEN '{NOW}' END AS modified,
      CASE WHEN change = 'edited' THEN id ELSE '' END AS is_version_of,
      CASE WHEN change = 'deleted' THEN '{R.WITHDRAWN}' ELSE '{ACTIVE}' END AS status FROM diff""",
)
def apply_release(spark, t):
    return _flat(R.apply_release(previous(t), current(t), NOW))


@query("change_summary", SQL + "SELECT change, id FROM diff WHERE change <> 'unchanged' ORDER BY 1, 2")
def change_summary(spark, t):
    return R.change_summary(_diff(t))


@query("change_counts", SQL + "SELECT change, count(*) AS n FROM diff GROUP BY change")
def change_counts(spark, t):
    return R.change_counts(_diff(t))


@query(
    "init_versioning",
    f"""SELECT 'customer:' || c_custkey AS id,
      CASE WHEN c_mktsegment <> 'MACHINERY' THEN '{BEFORE}' ELSE '{NOW}' END AS created, '{ACTIVE}' AS status,
      (SELECT count(*) FROM customer WHERE c_mktsegment = 'MACHINERY') AS updated FROM customer""",
)
def init_versioning(spark, t):
    rows = nodes(t.customer).withColumn(
        "created", F.when(F.col("segment") != "MACHINERY", F.lit(BEFORE))
    ).withColumn("status", F.when(F.col("segment") != "MACHINERY", F.lit(ACTIVE)))
    filled, updated = R.init_versioning(rows, NOW)
    return filled.select("id", "created", "status", F.lit(updated).cast("bigint").alias("updated"))


@query("id_difference", SQL + "SELECT id FROM curr EXCEPT ALL SELECT id FROM prev")
def id_difference(spark, t):
    return R.id_difference(current(t), previous(t))


@query("id_intersection", SQL + "SELECT id FROM curr INTERSECT SELECT id FROM prev")
def id_intersection(spark, t):
    return R.id_intersection(current(t), previous(t))


@query("sort_ids", SQL + "SELECT id FROM curr UNION ALL SELECT id FROM prev ORDER BY 1")
def sort_ids(spark, t):
    return R.sort_ids(current(t).select("id").unionByName(previous(t).select("id")))


@query(
    "last_wins_dedupe",
    """SELECT user_id, event_id, event_type FROM (
         SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS r FROM events) WHERE r = 1""",
)
def last_wins(spark, t):
    rows = t.events.select("user_id", "event_type", "event_id", F.col("event_id").alias("pos"))
    return last_wins_dedupe(rows, ["user_id", "event_type"], "pos").select("user_id", "event_id", "event_type")


@query("release_load", SQL + "SELECT id, label, segment, '1.10' AS release FROM curr")
def load_release(spark, t):
    base = scratch(spark, "releases")
    for name, frame in (("1.9", previous(t)), ("1.10", current(t))):
        release_write(frame.select("id", "label", "segment"), base, name)
    return release_load(spark, base).select("id", "label", "segment", "release")



GRAPH = {"label": Term(vocab.PREF_LABEL, lang="nl"), "segment": Term("http://x.org/segment"), "nation": Term("http://x.org/nation")}
VERSION = {k: R.VERSION_TERMS[k] for k in ("created", "status")}

GRAPH_SQL = SQL + f""", stamped AS (SELECT id, change, CASE change WHEN 'added' THEN '{NOW}' WHEN 'deleted' THEN NULL ELSE '{BEFORE}' END AS created,
    CASE WHEN change IN ('edited', 'deleted') THEN '{NOW}' END AS modified, CASE WHEN change = 'edited' THEN id END AS link,
    CASE WHEN change = 'deleted' THEN '{R.WITHDRAWN}' ELSE '{ACTIVE}' END AS status FROM diff)
"""


def graph(rows, terms):
    """Dealt by node first: the task that reads a small file would sort all its triples, and both releases' triples
    then lie where their nodes are folded and compared."""
    return rows_to_triples(dealt(rows, "id"), terms, "id").drop("pos")


@query(
    "release_triples",
    GRAPH_SQL + f"""SELECT id AS subject, '{vocab.PREF_LABEL}' AS predicate, label AS object FROM curr
      UNION ALL SELECT id, 'http://x.org/segment', segment FROM curr UNION ALL SELECT id, 'http://x.org/nation', cast(nation AS VARCHAR) FROM curr
      UNION ALL SELECT id, '{vocab.CREATED}', created FROM stamped WHERE created IS NOT NULL
      UNION ALL SELECT id, '{vocab.MODIFIED}', modified FROM stamped WHERE modified IS NOT NULL
      UNION ALL SELECT id, '{vocab.IS_VERSION_OF}', link FROM stamped WHERE link IS NOT NULL
      UNION ALL SELECT id, '{vocab.STATUS}', status FROM stamped""",
)
def release_graph(spark, t):
    before = graph(previous(t), {**GRAPH, **VERSION})
    triples, _ = R.release_triples(before, graph(current(t), GRAPH), NOW)
    return triples.select("subject", "predicate", "object")


@query("release_triples_diff", SQL + "SELECT id, change FROM diff")
def release_graph_diff(spark, t):
    _, diff = R.release_triples(graph(previous(t), {**GRAPH, **VERSION}), graph(current(t), GRAPH), NOW)
    return diff
