"""Streams that are run over all that is there, against batch results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomgraph import streaming as S
from loomgraph.operators.storage import table_path
from loomgraph.plans.base import Graph, query
from loomgraph.plans.merge_queries import state_rank, transitions
from loomgraph.streaming.queue import Queue

_RANK = "CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'signup' THEN 3 ELSE 8 END"


@query(f"SELECT user_id, max({_RANK})::INTEGER AS state_rank, count(*) AS n_events FROM events GROUP BY user_id", plain=True)
def X01_H16_state_stream(g: Graph) -> DataFrame:
    """The state machine as a stream; its last updates are the batch result."""
    moves = transitions(S.read_table(g.spark, g.sf_dir, "events")).select("user_id", "state_rank", F.lit(False).alias("forced"))
    return S.merged(S.state_machine(moves), "user_id", "n_events", "states")


@query("SELECT user_id, count(*) AS n_events, min(event_id) AS first_event FROM events GROUP BY user_id", plain=True)
def X04_register_stream(g: Graph) -> DataFrame:
    """First event of each key and how often it was seen, as a streaming aggregate."""
    rows = S.read_table(g.spark, g.sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n_events"), F.min("event_id").alias("first_event"))
    return S.merged(rows, "user_id", "n_events", "register")


_MOVES = f"""moves AS (SELECT user_id, ts, {_RANK} AS state_rank, event_type = 'error' AND event_id % 7 = 0 AS forced FROM events),
last AS (SELECT user_id, max(ts) AS ts, max(state_rank) AS state_rank FROM (SELECT * FROM moves m WHERE forced AND ts = (SELECT max(ts) FROM moves x WHERE x.forced AND x.user_id = m.user_id)) GROUP BY user_id)"""


@query(f"""WITH {_MOVES} SELECT m.user_id AS key, greatest(coalesce(any_value(l.state_rank), -1), coalesce(max(m.state_rank) FILTER (WHERE l.ts IS NULL OR m.ts > l.ts), -1))::INTEGER AS state_rank, count(*) AS n_events
FROM moves m LEFT JOIN last l USING (user_id) GROUP BY m.user_id""", plain=True)
def X01_forced_state_stream(g: Graph) -> DataFrame:
    """Where each user stands when some moves are forced backwards, by a stream that takes moves in any order."""
    moves = S.read_table(g.spark, g.sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"), state_rank().alias("state_rank"), ((F.col("event_type") == "error") & (F.col("event_id") % 7 == 0)).alias("forced"))
    rows = S.collected(S.places(moves), "places")
    return rows.groupBy("key").agg(F.max_by(F.struct("state_rank", "n_events"), "n_events").alias("last")).select("key", "last.*")


@query("SELECT DISTINCT user_id, event_type FROM events", plain=True)
def X04_first_seen_stream(g: Graph) -> DataFrame:
    """Each pair of user and kind once, however often and late it comes again."""
    rows = S.read_table(g.spark, g.sf_dir, "events").select("user_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
    return S.collected(S.first_seen(rows, ["user_id", "event_type"], "ts", "3650 days"), "seen", "append").select("user_id", "event_type")


@query("SELECT paper_id, count(trait_id) AS n_evidence, coalesce(max(level_rank), 0) AS best FROM (SELECT * FROM paper WHERE state = 'DISCOVERED') LEFT JOIN evidence USING (paper_id) GROUP BY paper_id")
def X05_work_queue(g: Graph) -> DataFrame:
    """Papers that wait, taken from a queue with a commit for each file of papers, in two runs of which the first stops early."""
    evidence = g.evidence.select("paper_id", "trait_id", "level_rank")

    def work(papers: DataFrame) -> DataFrame:
        return papers.join(evidence, "paper_id", "left").groupBy("paper_id").agg(F.count("trait_id").alias("n_evidence"), F.coalesce(F.max("level_rank"), F.lit(0)).alias("best"))

    waiting = g.paper.where("state = 'DISCOVERED'").select("paper_id", "pub_year")
    queue = Queue(g.spark, table_path(g.spark, "queue"), "paper_id")
    queue.add(waiting, F.desc("pub_year"), F.asc("paper_id"), per_commit=max(1, -(-waiting.count() // 6)))
    queue.run(work, limit=2)
    queue.run(work)
    return queue.results().drop("batch")
