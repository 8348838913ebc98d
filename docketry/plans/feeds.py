"""Queries that fold event feeds. The events table stands for the feed of each user."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketry.session import read_table as t
from docketry.streaming import folds

STEP_OF = {"view": "mentions", "click": "embed", "signup": "search", "purchase": "context", "error": "nonsense"}


def _steps(s, b):
    step = F.element_at(F.create_map(*[F.lit(x) for kv in STEP_OF.items() for x in kv]), F.col("event_type"))
    state = F.when(F.col("value") < 10, "skipped").when(F.col("value") < 60, "active").otherwise("done")
    return t(s, b, "events").select("user_id", "event_id", step.alias("step"), state.alias("state"))


def _parts(s, b):
    """Each user's events as a feed of whole props; breaks fall inside the parts, so most lines span two. Some lines are `data:` lines."""
    cut_at = F.instr("props", ":")
    broken = F.concat(F.substring("props", F.lit(1), cut_at), F.when(F.col("event_id") % 3 == 0, F.lit("\r\ndata: ")).otherwise(F.lit("\n\n")), F.substring(F.col("props"), cut_at + 1, F.length("props")))
    return t(s, b, "events").filter("user_id IS NOT NULL").select(F.col("user_id").alias("feed"), F.col("event_id").alias("k"), broken.alias("part"))


QUERIES = {
    "progress_fold": lambda s, b: folds.latest(t(s, b, "events"), "user_id", ["ts", "event_id"], ["event_type", "event_id", "value"]),
    "progress_running": lambda s, b: folds.progress(t(s, b, "events"), "user_id", ["ts", "event_id"], "event_type", ("view", "click")),
    "steps_fold": lambda s, b: folds.step_states(_steps(s, b), "user_id", "step", "state", ["event_id"]),
    "windowed_counts": lambda s, b: folds.windowed_counts(t(s, b, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "6 hours", "1 hour", "event_type").select(F.col("start").cast("timestamp_ntz").alias("start"), "event_type", "n"),
    "line_framing": lambda s, b: folds.lines(_parts(s, b), "feed", "k", "part"),
    "sse_data": lambda s, b: folds.sse_data(folds.lines(_parts(s, b), "feed", "k", "part"), "feed"),
}

_STEP = "CASE event_type WHEN 'view' THEN 1 WHEN 'click' THEN 2 WHEN 'signup' THEN 3 WHEN 'purchase' THEN 4 END"

_LINES = r"""(WITH p AS (SELECT user_id AS feed, string_agg(props[1:strpos(props, ':')] || CASE WHEN event_id % 3 = 0 THEN chr(13) || chr(10) || 'data: ' ELSE chr(10) || chr(10) END || props[strpos(props, ':') + 1:], '' ORDER BY event_id) AS w FROM events WHERE user_id IS NOT NULL GROUP BY 1),
        l AS (SELECT feed, regexp_split_to_array(w, '\r?\n') AS ls FROM p), u AS (SELECT feed, unnest(range(len(ls))) AS place, unnest(ls) AS line FROM l) SELECT * FROM u WHERE line <> '')"""

SQL = {
    "progress_fold": "SELECT user_id, event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL) WHERE k = 1",
    "progress_running": "SELECT user_id, event_type, ts, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events WHERE user_id IS NOT NULL) WHERE k = 1 AND event_type IN ('view', 'click')",
    "steps_fold": f"""WITH e AS (SELECT user_id, {_STEP} AS step_no, arg_max(CASE WHEN value < 10 THEN 'skipped' WHEN value < 60 THEN 'active' ELSE 'done' END, event_id) AS own FROM events GROUP BY ALL HAVING step_no IS NOT NULL),
        f AS (SELECT user_id, max(step_no) AS far FROM e GROUP BY 1), g AS (SELECT user_id, far, unnest([1, 2, 3, 4, 5]) AS step_no FROM f)
        SELECT g.user_id, g.step_no, ['mentions', 'embed', 'search', 'context', 'answer'][g.step_no] AS step,
        CASE WHEN g.step_no < far THEN CASE WHEN own = 'skipped' THEN 'skipped' ELSE 'done' END WHEN g.step_no = far THEN own ELSE 'pending' END AS state FROM g LEFT JOIN e ON e.user_id = g.user_id AND e.step_no = g.step_no""",
    "windowed_counts": "SELECT time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01') AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "line_framing": f"SELECT * FROM {_LINES}",
    "sse_data": f"SELECT feed, place, ltrim(line[6:]) AS data FROM {_LINES} WHERE starts_with(line, 'data:') AND ltrim(line[6:]) <> '[DONE]'",
}
