"""Queries on event logs, conversations and work ledgers."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from traceloom.functions import ids, scoring
from traceloom.operators import alignment, history, joins, ledger, search, sequence
from traceloom.plans.registry import query, table
from traceloom.scratch import scratch_dir


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


@query(
    "range_block_join",
    """
    WITH b AS (SELECT user_id, ts AS start, lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stop, event_id AS block FROM events WHERE event_type = 'signup')
    SELECT e.event_id, e.user_id, b.block FROM events e JOIN b ON e.user_id = b.user_id AND e.ts >= b.start AND e.ts < b.stop WHERE e.event_type = 'click'
    """,
)
def range_block_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks within the block from one signup to the next."""
    e = events(spark, sf_dir)
    order = Window.partitionBy("user_id").orderBy("ts", "event_id")
    blocks = e.where("event_type = 'signup'").select("user_id", F.col("ts").alias("start"), F.lead("ts").over(order).alias("stop"), F.col("event_id").alias("block"))
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    return joins.in_blocks(clicks, blocks, ["user_id"], "ts", "start", "stop").select("event_id", "user_id", "block")


@query(
    "asof_carry",
    """
    SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS purchase FROM events QUALIFY event_type = 'error'
    """,
)
def asof_carry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last purchase before each error; it holds for all later errors too."""
    purchase = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    carried = joins.carry_forward(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], purchase, "purchase")
    return carried.where("event_type = 'error'").select("event_id", "purchase")


@query(
    "branch_to_abort",
    """
    SELECT event_id, coalesce(first_value(CASE WHEN event_type IN ('error', 'signup') THEN event_type END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id
        ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) = 'error', false) AS aborts FROM events QUALIFY event_type = 'view'
    """,
)
def branch_to_abort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether an error follows a view before the next signup does."""
    control = F.when(F.col("event_type").isin("error", "signup"), F.col("event_type"))
    ahead = joins.first_following(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], control, "control")
    return ahead.where("event_type = 'view'").select("event_id", F.coalesce(F.col("control") == "error", F.lit(False)).alias("aborts"))


@query(
    "superset_gate",
    """
    SELECT user_id, ts::DATE AS day, count(DISTINCT event_type) AS n_methods FROM events GROUP BY user_id, ts::DATE
    HAVING count(DISTINCT event_type) >= 2 AND list_has_all(list(DISTINCT event_type), ['purchase', 'error'])
    """,
)
def superset_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users' days with two kinds of events at least, among them all required ones."""
    found = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day")).agg(F.countDistinct("event_type").alias("n_methods"), F.collect_set("event_type").alias("have"))
    return found.where((F.col("n_methods") >= 2) & joins.contains_all(F.col("have"), ["purchase", "error"])).drop("have")


@query("upsert_latest", "SELECT user_id, event_type, event_id, value FROM events QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) = 1")
def upsert_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    newest = joins.latest(events(spark, sf_dir), ["user_id", "event_type"], [F.col("ts").desc(), F.col("event_id").desc()])
    return newest.select("user_id", "event_type", "event_id", "value")


@query(
    "dup_id_suffix",
    """
    SELECT o_orderkey, CASE WHEN n = 1 THEN o_custkey::VARCHAR ELSE o_custkey || '-' || n END AS item_id FROM (
        SELECT o_orderkey, o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders)
    """,
)
def dup_id_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.suffix_duplicates(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], "item_id").select("o_orderkey", "item_id")


@query(
    "stage_schedule",
    """
    WITH have AS (SELECT user_id, list(DISTINCT event_type) AS h FROM events GROUP BY user_id)
    SELECT user_id, CASE WHEN list_has_all(h, ['purchase', 'view', 'signup', 'error', 'click']) THEN 'Run' WHEN list_has_any(h, ['purchase', 'error']) THEN 'RunWithGaps'
        WHEN len(h) > 0 THEN 'Defer' ELSE 'Skip' END AS action, (5 - len(h))::BIGINT AS n_missing FROM have
    """,
)
def stage_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What to do with a stage, by the capabilities it wants and has."""
    have = events(spark, sf_dir).groupBy("user_id").agg(F.collect_set("event_type").alias("h"))
    wanted = ["purchase", "view", "signup", "error", "click"]
    rules = [
        (joins.contains_all(F.col("h"), wanted), "Run"),
        (F.arrays_overlap("h", F.array(F.lit("purchase"), F.lit("error"))), "RunWithGaps"),
        (F.size("h") > 0, "Defer"),
    ]
    return have.select("user_id", scoring.first_match(rules, "Skip").alias("action"), (5 - F.size("h")).cast("long").alias("n_missing"))


@query("work_claim_head", "SELECT user_id, arg_min(event_id, (ts, event_id)) AS claimed FROM events WHERE event_type NOT IN ('purchase', 'signup') GROUP BY user_id")
def work_claim_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The head of each queue: its first item that isn't finished."""
    return ledger.queue_head(events(spark, sf_dir), "user_id", ["ts", "event_id"], "event_id", F.col("event_type").isin("purchase", "signup"))


@query(
    "prefix_condition",
    """
    SELECT event_id, count(*) FILTER (event_type = 'error') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) = 0 AS may_run FROM events
    """,
)
def prefix_condition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An item may run if none before it has failed."""
    return ledger.may_run(events(spark, sf_dir), "user_id", ["ts", "event_id"], F.col("event_type") == "error").select("event_id", "may_run")


@query(
    "terminal_status",
    """
    SELECT user_id, CASE WHEN bool_or(event_type = 'error') OR bool_or(value IS NULL) THEN 'CompletedWithGaps' ELSE 'Completed' END AS status,
        count(*) FILTER (event_type = 'error') AS n_gaps FROM events GROUP BY user_id
    """,
)
def terminal_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.terminal_status(events(spark, sf_dir), "user_id", F.col("event_type") == "error", F.col("value").isNull())


_TURNS = "t AS (SELECT conv_id, turn, role, coalesce(text, '') AS text, ceil(strlen(coalesce(text, '')) / 4)::BIGINT AS tokens FROM conversations)"


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").withColumn("text", F.coalesce("text", F.lit("")))
    return rows.withColumn("tokens", ids.estimate_tokens(F.col("text")))


@query("token_estimate", f"WITH {_TURNS} SELECT conv_id, sum(tokens)::BIGINT AS tokens, count(*) AS n_turns FROM t GROUP BY conv_id")
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns(spark, sf_dir).groupBy("conv_id").agg(F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("n_turns"))


@query(
    "token_budget",
    f"""
    WITH {_TURNS}, s AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM t)
    SELECT conv_id, turn, least(tokens, 500 - spent)::BIGINT AS kept FROM s WHERE spent < 500
    """,
)
def token_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest turns within a budget."""
    return sequence.newest_within_budget(turns(spark, sf_dir), ["conv_id"], [F.col("turn").desc()], "tokens", 500).select("conv_id", "turn", "kept")


@query(
    "turn_truncate",
    """
    WITH c AS (SELECT conv_id, turn, role, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seen, sum((role = 'user')::INT) OVER (PARTITION BY conv_id) AS total FROM conversations)
    SELECT conv_id, turn, role, 'prefix' AS part FROM c WHERE seen < 2 UNION ALL SELECT conv_id, turn, role, 'suffix' FROM c WHERE seen > total - 1
    """,
)
def turn_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What precedes the second user turn, and what belongs to the last one."""
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role")
    user = F.col("role") == "user"
    prefix = sequence.before_nth(rows, ["conv_id"], ["turn"], user, 2).withColumn("part", F.lit("prefix"))
    return prefix.unionByName(sequence.last_n(rows, ["conv_id"], ["turn"], user, 1).withColumn("part", F.lit("suffix")))


@query(
    "drop_last_turns",
    """
    WITH c AS (SELECT conv_id, turn, sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn) AS seen, sum((role = 'user')::INT) OVER (PARTITION BY conv_id) AS total FROM conversations)
    SELECT conv_id, turn FROM c WHERE seen <= greatest(total - 1, 0)
    """,
)
def drop_last_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).select("conv_id", "turn", "role")
    return history.drop_last_turns(rows, "conv_id", "turn", F.col("role") == "user", 1).select("conv_id", "turn")


@query(
    "head_tail",
    """
    WITH c AS (SELECT conv_id, encode(string_agg(coalesce(text, ''), '' ORDER BY turn)) AS b FROM conversations GROUP BY conv_id), n AS (SELECT *, octet_length(b) AS size FROM c)
    SELECT conv_id, sha256(b[1:128]) AS head_sha256, sha256(b[greatest(129, size - 127):size]) AS tail_sha256, greatest(0, size - 256)::BIGINT AS omitted FROM n
    """,
)
def head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and last bytes of each conversation under a budget of 256."""
    cut = sequence.group_head_tail(turns(spark, sf_dir), "conv_id", "turn", "text", 256)
    return cut.select("conv_id", F.sha2("head", 256).alias("head_sha256"), F.sha2("tail", 256).alias("tail_sha256"), "omitted")


@query("latest_usage", "SELECT conv_id, max(turn) AS turn, arg_max(strlen(text), turn)::BIGINT AS bytes FROM conversations WHERE role = 'assistant' GROUP BY conv_id")
def latest_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = turns(spark, sf_dir).where("role = 'assistant'")
    return rows.groupBy("conv_id").agg(F.max("turn").alias("turn"), F.max_by(F.octet_length("text").cast("long"), "turn").alias("bytes"))


@query(
    "usage_after_last_model",
    f"""
    WITH {_TURNS}, m AS (SELECT conv_id, max(turn) FILTER (role = 'assistant') AS last FROM t GROUP BY conv_id)
    SELECT conv_id, coalesce(sum(tokens) FILTER (turn > last), 0)::BIGINT AS after_model, sum(tokens)::BIGINT AS total FROM t JOIN m USING (conv_id) GROUP BY conv_id
    """,
)
def usage_after_last_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.usage_after(turns(spark, sf_dir), "conv_id", "turn", F.col("role") == "assistant", "tokens")


@query(
    "rollback_turns",
    """
    WITH RECURSIVE o AS (SELECT user_id, event_id, event_type = 'error' AS undo, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'error')),
    r(user_id, n, kept) AS (SELECT user_id, 1::BIGINT, CASE WHEN undo THEN []::BIGINT[] ELSE [event_id] END FROM o WHERE n = 1
        UNION ALL SELECT o.user_id, o.n, CASE WHEN o.undo THEN r.kept[1:greatest(len(r.kept) - 1, 0)] ELSE list_append(r.kept, o.event_id) END FROM r JOIN o ON o.user_id = r.user_id AND o.n = r.n + 1)
    SELECT user_id, unnest(kept) AS event_id FROM (SELECT user_id, arg_max(kept, n) AS kept FROM r GROUP BY user_id)
    """,
)
def rollback_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks that no later error took back; an error takes the last one that is left."""
    rows = events(spark, sf_dir).where("event_type IN ('click', 'error')").select("user_id", "event_id", F.when(F.col("event_type") == "error", 1).alias("n"))
    return sequence.replay_rollbacks(rows, "user_id", "event_id", "n")


@query("page_cursor", "SELECT o_orderkey, o_orderdate FROM orders ORDER BY o_orderdate, o_orderkey LIMIT 100 OFFSET 200")
def page_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.page(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), ["o_orderdate", "o_orderkey"], 200)


@query("keyset_page", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 9000 ORDER BY o_orderkey DESC LIMIT 51")
def keyset_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.after_key(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", 9000, 51)


@query(
    "trace_metrics",
    """
    SELECT user_id, ts::DATE AS day, event_type, count(*) AS n, round(sum(value), 4) AS total, epoch_us(min(ts)) AS first_us,
        epoch_us(min(ts)) - min(epoch_us(min(ts))) OVER (PARTITION BY user_id, ts::DATE) AS since_first_us FROM events GROUP BY user_id, ts::DATE, event_type
    """,
)
def trace_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters by tags, and the time from a day's first event to the first of each kind."""
    found = events(spark, sf_dir).groupBy("user_id", F.to_date("ts").alias("day"), "event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"), F.unix_micros(F.min("ts").cast("timestamp")).alias("first_us")
    )
    return found.withColumn("since_first_us", F.col("first_us") - F.min("first_us").over(Window.partitionBy("user_id", "day")))


@query("watermark_advance", "SELECT event_type, greatest(max(event_id), 5000) AS watermark FROM events GROUP BY event_type")
def watermark_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A high-water mark that never goes back."""
    return events(spark, sf_dir).groupBy("event_type").agg(F.greatest(F.max("event_id"), F.lit(5000)).cast("long").alias("watermark"))


_GAP_HOURS = 6


@query(
    "debounce_sessions",
    f"""
    WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL {_GAP_HOURS} HOUR THEN 0 ELSE 1 END AS new FROM events),
    s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
    SELECT user_id, epoch_us(min(ts)) AS start_us, epoch_us(max(ts)) + {_GAP_HOURS} * 3600000000 AS end_us, count(*) AS n FROM s GROUP BY user_id, k
    """,
)
def debounce_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One build for each burst of a user's events."""
    window = F.session_window("ts", f"{_GAP_HOURS} hours").alias("w")
    found = events(spark, sf_dir).select("user_id", F.col("ts").cast("timestamp").alias("ts")).groupBy("user_id", window).agg(F.count(F.lit(1)).alias("n"))
    return found.select("user_id", F.unix_micros("w.start").alias("start_us"), F.unix_micros("w.end").alias("end_us"), "n")


@query("tumbling_events", "SELECT event_type, epoch_us(time_bucket(INTERVAL 1 DAY, ts)) AS start_us, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2")
def tumbling_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An extension: daily windows."""
    found = events(spark, sf_dir).select("event_type", "value", F.col("ts").cast("timestamp").alias("ts")).groupBy("event_type", F.window("ts", "1 day").alias("w"))
    found = found.agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return found.select("event_type", F.unix_micros("w.start").alias("start_us"), "n", "total")


@query(
    "bm25_topk",
    """
    WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
    len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id), a AS (SELECT count(*) AS docs, avg(n) AS mean FROM len), q AS (SELECT unnest(['license', 'token', 'apache']) AS term),
    df AS (SELECT term, count(*) AS df FROM tf SEMI JOIN q USING (term) GROUP BY term)
    SELECT doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
    FROM tf JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN a GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20
    """,
)
def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", ["license", "token", "apache"], 20)


@query(
    "bm25_queries",
    """
    WITH w AS (SELECT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM documents), tf AS (SELECT doc_id, term, count(*) AS tf FROM w WHERE term <> '' GROUP BY ALL),
    len AS (SELECT doc_id, sum(tf) AS n FROM tf GROUP BY doc_id), a AS (SELECT count(*) AS docs, avg(n) AS mean FROM len), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    q AS (SELECT DISTINCT item_id AS query, unnest(string_split_regex(lower(text), '[^a-z]+')) AS term FROM benchmark),
    s AS (SELECT query, doc_id, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))), 6) AS score
        FROM q JOIN tf USING (term) JOIN df USING (term) JOIN len USING (doc_id) CROSS JOIN a GROUP BY query, doc_id)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS place, doc_id, score FROM s QUALIFY place <= 10
    """,
)
def bm25_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents for each benchmark item's words, by an index of postings with block maxima."""
    index = search.write_index(table(spark, sf_dir, "documents"), "doc_id", "text", f"{scratch_dir(spark)}/index-{uuid.uuid4().hex}")
    words = F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: w != "")
    return search.ranked(index, table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), words.alias("terms")), 10)


@query(
    "fuzzy_queries",
    """
    WITH RECURSIVE q AS (SELECT DISTINCT unnest(string_split(p_name, ' ')) AS query FROM part),
    c AS (SELECT page_id, url, i, substr(lower(url), i, 1) AS c, CASE WHEN regexp_matches(substr(lower(url), i, 1), '[a-z0-9]')
        AND (i = 1 OR NOT regexp_matches(substr(lower(url), i - 1, 1), '[a-z0-9]')) THEN 8 ELSE 0 END AS bonus FROM (SELECT page_id, url, unnest(range(1, length(url) + 1)) AS i FROM pages)),
    m(query, page_id, j, i, score) AS (SELECT query, page_id, 1, i, 16 + bonus FROM q JOIN c ON c = substr(query, 1, 1)
        UNION ALL SELECT m.query, m.page_id, m.j + 1, c.i, max(m.score + 16 + c.bonus + CASE WHEN c.i = m.i + 1 THEN 4 ELSE -3 - (c.i - m.i - 2) END)
        FROM m JOIN c ON c.page_id = m.page_id AND c.i > m.i AND c.c = substr(m.query, m.j + 1, 1) GROUP BY m.query, m.page_id, m.j, c.i),
    s AS (SELECT query, page_id, max(score)::BIGINT AS score FROM m WHERE j = length(query) AND score >= 0 GROUP BY 1, 2)
    SELECT query, row_number() OVER (PARTITION BY query ORDER BY score DESC, url, page_id) AS place, page_id, url, score FROM s JOIN pages USING (page_id) QUALIFY place <= 50
    """,
)
def fuzzy_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best URLs for each word of the parts' names, by their best alignment, then by URL."""
    words = table(spark, sf_dir, "part").select(F.explode(F.split("p_name", " ")).alias("query")).distinct()
    return alignment.fuzzy_search(table(spark, sf_dir, "pages"), words, "page_id", "url").select("query", "place", "page_id", F.col("path").alias("url"), "score")


@query(
    "fuzzy_rank",
    """
    SELECT page_id, url, (100 - levenshtein(regexp_extract(url, '^https?://([^/?#]+)', 1), 'thth.example.net'))::BIGINT AS score FROM pages ORDER BY score DESC, url, page_id LIMIT 50
    """,
)
def fuzzy_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best by score, then by path."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    host = F.regexp_extract("url", "^https?://([^/?#]+)", 1)
    return pages.withColumn("score", (100 - F.levenshtein(host, F.lit("thth.example.net"))).cast("long")).orderBy(F.col("score").desc(), "url", "page_id").limit(50)


@query(
    "recent_list",
    "SELECT user_id, event_type, place FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS place FROM events GROUP BY user_id, event_type) WHERE place <= 3",
)
def recent_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most recently used kinds of each user, each once."""
    used = events(spark, sf_dir).groupBy("user_id", "event_type").agg(F.max("ts").alias("t"))
    order = Window.partitionBy("user_id").orderBy(F.col("t").desc(), "event_type")
    return used.withColumn("place", F.row_number().over(order)).where("place <= 3").select("user_id", "event_type", "place")


@query(
    "job_outcomes",
    """
    SELECT event_type AS status, count(*) AS n, round(sum(CASE WHEN value > 50 THEN value END), 4) AS tokens, count(*) FILTER (value > 50) AS reported FROM events GROUP BY 1
    """,
)
def job_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by outcome; null if no row reports any usage."""
    high = F.when(F.col("value") > 50, F.col("value"))
    return events(spark, sf_dir).groupBy(F.col("event_type").alias("status")).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(high), 4).alias("tokens"), F.count(high).alias("reported"))
