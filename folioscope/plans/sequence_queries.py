"""Queries over ordered rows: agent logs, episodes and conversations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scores import fixed
from ..operators import rewards as rw
from ..operators import sequences as op
from .registry import Tables, query

ORDER = ["turn"]


@query("action_frequencies", "SELECT role AS action, count(*) AS n, count(*) * 100.0 / sum(count(*)) OVER () AS pct FROM conversations GROUP BY role")
def action_frequencies(t: Tables) -> DataFrame:
    counts = t.conversations.groupBy(F.col("role").alias("action")).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))))


@query(
    "merge_consecutive",
    """WITH c AS (SELECT *, CASE WHEN lag(role) OVER w IS NOT DISTINCT FROM role OR row_number() OVER w = 1 THEN 0 ELSE 1 END AS new FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM c)
    SELECT conv_id, CAST(run AS BIGINT) AS run, role, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, count(*) AS n_rows FROM r GROUP BY conv_id, run, role""",
)
def merge_consecutive(t: Tables) -> DataFrame:
    return op.merge_runs(t.conversations, "conv_id", ORDER, "role", "text")


@query(
    "page_grouped_text",
    "SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn, text) AS text, count(*) AS n FROM conversations WHERE role <> 'system' AND trim(text) <> '' GROUP BY conv_id",
)
def page_grouped_text(t: Tables) -> DataFrame:
    rows = t.conversations.where((F.col("role") != "system") & (F.trim("text") != ""))
    parts = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("n"))


@query(
    "carry_forward",
    """WITH {CLAIMS} SELECT paper_id, claim_id, metric, coalesce(last_value(CASE WHEN metric = 'signup' THEN dataset END IGNORE NULLS) OVER (PARTITION BY paper_id ORDER BY ts, claim_id ROWS UNBOUNDED PRECEDING), -1) AS section FROM claims""",
)
def carry_forward(t: Tables) -> DataFrame:
    rows = op.carry_forward(t.claims, "paper_id", ["ts", "claim_id"], F.when(F.col("metric") == "signup", F.col("dataset")), "section")
    return rows.select("paper_id", "claim_id", "metric", F.coalesce("section", F.lit(-1)).alias("section"))


@query(
    "early_stop",
    """WITH c AS (SELECT conv_id, turn, sum(CASE WHEN length(text) < 200 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS 2 PRECEDING) AS run FROM conversations),
    s AS (SELECT conv_id, min(turn) AS stop FROM c WHERE run = 3 GROUP BY conv_id)
    SELECT conv_id, count(*) AS n_kept, max(turn) AS last_turn FROM c LEFT JOIN s USING (conv_id) WHERE stop IS NULL OR turn <= stop GROUP BY conv_id""",
)
def early_stop(t: Tables) -> DataFrame:
    rows = t.conversations.select("conv_id", "turn", (F.length("text") < 200).alias("neutral"))
    return op.stop_after_run(rows, "conv_id", ORDER, "neutral", 3).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_kept"), F.max("turn").alias("last_turn"))


@query(
    "sequence_score",
    """WITH f AS (SELECT conv_id, min(turn) FILTER (role = 'system') AS s, min(turn) FILTER (role = 'user') AS u, min(turn) FILTER (role = 'assistant') AS a FROM conversations GROUP BY conv_id)
    SELECT conv_id, (coalesce(CAST(s < u AS INT), 0) + coalesce(CAST(u < a AS INT), 0) + coalesce(CAST(s < a AS INT), 0)) / 3.0 AS score FROM f""",
)
def sequence_score(t: Tables) -> DataFrame:
    return op.precedence(t.conversations, "conv_id", "turn", "role", [("system", "user"), ("user", "assistant"), ("system", "assistant")])


@query(
    "bio_spans",
    """WITH g AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 'B-task' WHEN 'assistant' THEN 'I-task' ELSE 'O' END AS tag FROM conversations),
    s AS (SELECT *, row_number() OVER w AS place, CASE WHEN tag LIKE 'B-%' OR tag LIKE 'I-%' AND NOT coalesce(lag(tag) OVER w LIKE '%task', false) THEN 1 ELSE 0 END AS st FROM g WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
    n AS (SELECT *, sum(st) OVER (PARTITION BY conv_id ORDER BY turn) AS span FROM s)
    SELECT conv_id, CAST(span AS BIGINT) AS span, 'task' AS kind, CAST(min(place) AS INTEGER) AS "start", CAST(max(place) AS INTEGER) AS "end" FROM n WHERE tag <> 'O' GROUP BY conv_id, span""",
)
def bio_spans(t: Tables) -> DataFrame:
    tag = F.when(F.col("role") == "user", F.lit("B-task")).when(F.col("role") == "assistant", F.lit("I-task")).otherwise(F.lit("O"))
    return op.bio_spans(t.conversations.select("conv_id", "turn", tag.alias("tag")), "conv_id", ORDER, "tag")


_EPISODES = "e AS (SELECT o_custkey AS session_id, o_orderkey AS episode, o_orderdate AS happened, o_totalprice / 1000.0 AS reward FROM orders)"


def episodes(t: Tables) -> DataFrame:
    return t.orders.select(F.col("o_custkey").alias("session_id"), F.col("o_orderkey").alias("episode"), F.col("o_orderdate").alias("happened"), (F.col("o_totalprice") / 1000.0).alias("reward"), F.col("o_orderpriority").alias("arm"))


@query(
    "episode_stats",
    "WITH " + _EPISODES + """, r AS (SELECT *, row_number() OVER w AS n, row_number() OVER (PARTITION BY session_id ORDER BY happened DESC, episode DESC) AS back FROM e WINDOW w AS (PARTITION BY session_id ORDER BY happened, episode))
    SELECT session_id, count(*) AS n, floor(avg(reward) * 10000 + 0.5) / 10000 AS mean, min(reward) AS low, max(reward) AS high, max(reward) FILTER (n = 1) AS first, max(reward) FILTER (back = 1) AS last,
      floor((max(reward) FILTER (back = 1) - max(reward) FILTER (n = 1)) * 10000 + 0.5) / 10000 AS delta, floor(avg(reward) FILTER (back <= 3) * 10000 + 0.5) / 10000 AS mean_last3 FROM r GROUP BY session_id""",
)
def episode_stats(t: Tables) -> DataFrame:
    e = episodes(t)
    r = e.withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("happened", "episode"))).withColumn("back", F.row_number().over(Window.partitionBy("session_id").orderBy(F.col("happened").desc(), F.col("episode").desc())))
    first, last = F.max(F.when(F.col("n") == 1, F.col("reward"))), F.max(F.when(F.col("back") == 1, F.col("reward")))
    return r.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("n"), fixed(F.avg("reward")).alias("mean"), F.min("reward").alias("low"), F.max("reward").alias("high"), first.alias("first"), last.alias("last"),
        fixed(last - first).alias("delta"), fixed(F.avg(F.when(F.col("back") <= 3, F.col("reward")))).alias("mean_last3"),
    )


@query(
    "rolling_reward",
    "WITH " + _EPISODES + """, r AS (SELECT session_id, episode, avg(reward) OVER (PARTITION BY session_id ORDER BY happened, episode ROWS 4 PRECEDING) AS m, row_number() OVER (PARTITION BY session_id ORDER BY happened, episode) AS n FROM e)
    SELECT session_id, episode, floor(m * 10000 + 0.5) / 10000 AS rolling FROM r WHERE n >= 5""",
)
def rolling_reward(t: Tables) -> DataFrame:
    rows = op.rolling_mean(episodes(t), "session_id", ["happened", "episode"], "reward", 5, valid=True)
    return rows.select("session_id", "episode", fixed(F.col("rolling")).alias("rolling"))


@query(
    "arm_rewards",
    """SELECT o_custkey AS session_id, floor(avg(o_totalprice) FILTER (o_orderpriority = '1-URGENT') * 10000 + 0.5) / 10000 AS urgent, floor(avg(o_totalprice) FILTER (o_orderpriority = '2-HIGH') * 10000 + 0.5) / 10000 AS high,
    floor(avg(o_totalprice) FILTER (o_orderpriority = '5-LOW') * 10000 + 0.5) / 10000 AS low FROM orders GROUP BY 1""",
)
def arm_rewards(t: Tables) -> DataFrame:
    """Mean reward of each arm in a session; an arm that was not used has none."""
    mean = lambda arm: fixed(F.avg(F.when(F.col("o_orderpriority") == arm, F.col("o_totalprice"))))
    return t.orders.groupBy(F.col("o_custkey").alias("session_id")).agg(mean("1-URGENT").alias("urgent"), mean("2-HIGH").alias("high"), mean("5-LOW").alias("low"))


@query(
    "last_picks",
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
    SELECT o_custkey AS session_id, o_orderpriority AS arm, floor(o_totalprice / 5000.0 + 0.5) / 100 AS confidence, year(o_orderdate) AS year, o_orderstatus AS status FROM r WHERE n = 1""",
)
def last_picks(t: Tables) -> DataFrame:
    """The parts of the reward of the last pick of each session, as they stood then."""
    last = t.orders.groupBy(F.col("o_custkey").alias("session_id")).agg(F.max_by(F.struct("o_orderpriority", "o_totalprice", "o_orderdate", "o_orderstatus"), F.struct("o_orderdate", "o_orderkey")).alias("m"))
    return last.select("session_id", F.col("m.o_orderpriority").alias("arm"), fixed(F.col("m.o_totalprice") / 500000.0, 2).alias("confidence"), F.year("m.o_orderdate").cast("long").alias("year"), F.col("m.o_orderstatus").alias("status"))


@query(
    "gae_scan",
    "WITH RECURSIVE " + _EPISODES + """, n AS (SELECT session_id, reward, row_number() OVER (PARTITION BY session_id ORDER BY happened, episode) - 1 AS step, row_number() OVER (PARTITION BY session_id ORDER BY happened DESC, episode DESC) AS back FROM e),
    g AS (SELECT session_id, step, back, reward AS a FROM n WHERE back = 1 UNION ALL SELECT n.session_id, n.step, n.back, n.reward + 0.9 * g.a FROM g JOIN n ON n.session_id = g.session_id AND n.back = g.back + 1)
    SELECT session_id, CAST(step AS INTEGER) AS step, floor(a * 10000 + 0.5) / 10000 AS advantage FROM g""",
)
def gae_scan(t: Tables) -> DataFrame:
    out = op.generalized_advantage(episodes(t), "session_id", ["happened", "episode"], "reward", 0.9)
    return out.withColumn("advantage", fixed(F.col("advantage")))


@query(
    "advantage_normalised",
    "WITH " + _EPISODES + " SELECT session_id, episode, floor((reward - avg(reward) OVER (PARTITION BY session_id)) / (stddev_pop(reward) OVER (PARTITION BY session_id) + 1e-8) * 10000 + 0.5) / 10000 AS z FROM e",
)
def advantage_normalised(t: Tables) -> DataFrame:
    return op.normalise(episodes(t), "session_id", "reward", "z").select("session_id", "episode", fixed(F.col("z")).alias("z"))


_ACTIONS = {"view": "run_comparator", "signup": "run_critic", "purchase": "run_gap_detector", "error": "run_writer"}
_REVIEW = {"view": "## Methods", "signup": "## Results", "purchase": "## Gaps", "error": "## Contradictions"}
_IN_ORDER = "coalesce({0}comparator < {0}critic, false)::INT * {1} + coalesce({0}critic < {0}gap, false)::INT * {2} + coalesce({0}gap < {0}writer, false)::INT * {3}"


@query(
    "session_reward",
    f"""WITH {{CLAIMS}}, c AS (SELECT *, CASE claim_id % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'low' ELSE '0.7' END AS sev FROM claims WHERE paper_id IS NOT NULL),
    g AS (SELECT paper_id, dataset, count(DISTINCT paper_id) OVER (PARTITION BY dataset) = 1 AS novel FROM c WHERE metric = 'purchase' AND dataset IS NOT NULL), v AS (SELECT paper_id, avg(novel::INT) AS novelty FROM g GROUP BY paper_id),
    s AS (SELECT paper_id, count(*) FILTER (metric = 'error' AND sev IN ('HIGH', '0.7')) AS n_severe, avg(CASE sev WHEN 'HIGH' THEN 1.0 WHEN 'low' THEN 0.3 ELSE 0.7 END) FILTER (metric = 'signup') AS severity,
      min(claim_id) FILTER (metric = 'view') AS comparator, min(claim_id) FILTER (metric = 'signup') AS critic, min(claim_id) FILTER (metric = 'purchase') AS gap, min(claim_id) FILTER (metric = 'error') AS writer, count(DISTINCT metric) FILTER (metric IN ('view', 'signup', 'purchase', 'error')) AS found, count(*) // 15 AS calls FROM c GROUP BY paper_id)
    SELECT paper_id AS session_id, n_severe, {_IN_ORDER.format("", 1, 1, 1)} AS n_in_order, floor(least(greatest(0.25 * least(n_severe / 3.0, 1.0) + 0.2 * coalesce(severity * severity, 0) + 0.2 * coalesce(novelty, 0) + 0.15 * ({_IN_ORDER.format("", 1, 1, 1)}) / 3.0
      + 0.15 * found / 5.0 + 0.05 * greatest(1 - greatest(calls - 4, 0) / 4.0, 0), 0), 1)::DOUBLE * 1000000 + 0.5) / 1000000 AS reward FROM s LEFT JOIN v USING (paper_id)""",
)
def session_reward(t: Tables) -> DataFrame:
    """What each user's session was worth: its events are the agents' actions, contradictions, critiques and gaps."""
    c = t.claims.where("paper_id IS NOT NULL").withColumn("sev", F.when(F.col("claim_id") % 3 == 0, "HIGH").when(F.col("claim_id") % 3 == 1, "low").otherwise("0.7"))
    named = lambda names: F.create_map(*(F.lit(x) for kv in names.items() for x in kv))[F.col("metric")]
    order = rw.order_kept(c.select("paper_id", named(_ACTIONS).alias("action"), "claim_id"), "paper_id", "action", "claim_id")
    novel = rw.novel_gaps(c.where("metric = 'purchase' AND dataset IS NOT NULL").select("paper_id", "dataset"), "paper_id", "dataset")
    review = F.array_join(F.array_sort(F.collect_set(named(_REVIEW))), "\n")
    g = c.groupBy("paper_id").agg(
        F.count_if((F.col("metric") == "error") & rw.severe(F.col("sev"))).alias("n_severe"), F.avg(F.when(F.col("metric") == "signup", rw.severity_score(F.col("sev")))).alias("severity"),
        review.alias("review"), F.floor(F.count(F.lit(1)) / 15).alias("calls"),
    )
    rows = g.join(order, "paper_id").join(novel, "paper_id", "left")
    reward = rw.session_reward(F.col("n_severe"), F.col("severity"), F.col("gap_novelty"), F.col("n_in_order"), rw.review_completeness(F.col("review")), F.col("calls"))
    return rows.select(F.col("paper_id").alias("session_id"), "n_severe", "n_in_order", fixed(reward, 6).alias("reward"))


@query(
    "gap_rewards",
    """WITH g AS (SELECT l_orderkey AS gap_id, avg(l_tax) * 5 AS redundancy, count(DISTINCT l_partkey) AS n, count(DISTINCT l_suppkey) AS papers, count(DISTINCT l_partkey) FILTER (l_returnflag = 'R') AS conflicts, 1 - avg(l_discount) AS sure FROM lineitem GROUP BY 1)
    SELECT gap_id, floor(least(greatest(0.2 * (1 - redundancy) + 0.18 * least(n / 5.0, 1.0) + 0.18 * least(papers / 10.0, 1.0) + 0.14 * (1 - conflicts * 1.0 / greatest(n, 1)) + 0.18 * sure
      + 0.12 * least(CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 1.0 WHEN '2' THEN 0.5 WHEN '3' THEN 0.0 ELSE 0.5 END + CASE WHEN o_orderstatus = 'P' THEN 0.25 ELSE 0 END, 1.0), 0), 1)::DOUBLE * 1000000 + 0.5) / 1000000 AS reward FROM g JOIN orders ON o_orderkey = gap_id""",
)
def gap_rewards(t: Tables) -> DataFrame:
    """What choosing each gap would be worth; an order is a gap, its parts the entities, its suppliers the papers."""
    distinct = lambda c: F.size(F.collect_set(c)).cast("long")  # noqa: E731  an order's few lines, not a row for each count
    g = t.lineitem.repartition("l_orderkey").groupBy(F.col("l_orderkey").alias("gap_id")).agg(
        (F.avg("l_tax") * 5).alias("redundancy"), distinct("l_partkey").alias("n"), distinct("l_suppkey").alias("papers"), distinct(F.when(F.col("l_returnflag") == "R", F.col("l_partkey"))).alias("conflicts"), (1 - F.avg("l_discount")).alias("sure")
    )
    digit = F.substring("o_orderpriority", 1, 1)
    priority = F.when(digit == "1", "HIGH").when(digit == "2", "MEDIUM").when(digit == "3", "LOW")
    o = t.orders.select(F.col("o_orderkey").alias("gap_id"), priority.alias("priority"), F.when(F.col("o_orderstatus") == "P", "cross_paper").otherwise("limitation").alias("gap_type"))
    c = F.col
    reward = rw.gap_reward(c("redundancy"), c("n"), c("papers"), F.lit(10), c("conflicts"), c("sure"), c("priority"), c("gap_type"))
    return g.join(o, "gap_id").select("gap_id", fixed(reward, 6).alias("reward"))


@query(
    "terminal_rewards",
    f"""WITH s AS (SELECT o_custkey AS episode, count(*) AS papers, count(*) FILTER (o_orderstatus = 'F') AS f, count(*) FILTER (o_orderstatus = 'O') AS o, count(*) FILTER (o_orderstatus = 'P') AS p, bool_or(o_orderpriority LIKE '4%') AS wrote,
      count(*) FILTER (substr(o_orderpriority, 1, 1) < '5') - count(DISTINCT o_orderpriority) FILTER (substr(o_orderpriority, 1, 1) < '5') AS again, least(max(o_totalprice) / 500000.0, 1.0) AS context,
      min(o_orderkey) FILTER (o_orderpriority LIKE '1%') AS comparator, min(o_orderkey) FILTER (o_orderpriority LIKE '2%') AS critic, min(o_orderkey) FILTER (o_orderpriority LIKE '3%') AS gap, min(o_orderkey) FILTER (o_orderpriority LIKE '4%') AS writer FROM orders GROUP BY 1)
    SELECT episode, floor(least(greatest(0.22 * CASE WHEN papers >= 2 THEN least(f / greatest(papers * (papers - 1) / 2.0, 1), 1.0) ELSE 0.05 END + 0.18 * CASE WHEN o > 0 THEN pow(least(o / greatest(papers * 2.0, 1), 1.0), 0.65) ELSE 0 END + 0.18 * least(p / 8.0, 1.0)
      + 0.32 * CASE WHEN wrote THEN context ELSE 0 END + 0.1 * greatest(1 - again * 0.18, 0.25) + {_IN_ORDER.format("", 0.05, 0.04, 0.04)}, 0), 1)::DOUBLE * 1000000 + 0.5) / 1000000 AS reward FROM s""",
)
def terminal_rewards(t: Tables) -> DataFrame:
    """What each episode is worth at its end; a customer is an episode, the priority of an order says which agent ran."""
    agents = {"1": "run_comparator", "2": "run_critic", "3": "run_gap_detector", "4": "run_writer"}
    agent = F.create_map(*(F.lit(x) for kv in agents.items() for x in kv))[F.substring("o_orderpriority", 1, 1)]
    o = t.orders.select(F.col("o_custkey").alias("episode"), "o_orderkey", "o_orderstatus", agent.alias("agent"), (F.col("o_totalprice") / 500000.0).alias("context"))
    g = o.groupBy("episode").agg(
        F.count(F.lit(1)).alias("papers"), *(F.count_if(F.col("o_orderstatus") == s).alias(s.lower()) for s in "FOP"), F.coalesce(F.bool_or(F.col("agent") == "run_writer"), F.lit(False)).alias("wrote"),
        (F.count("agent") - F.count_distinct("agent")).alias("again"), F.least(F.max("context"), F.lit(1.0)).alias("context"),
    )
    c = F.col
    reward = rw.terminal_reward(c("papers"), c("f"), c("o"), c("p"), c("context"), c("wrote"), c("again"), c("bonus"))
    return g.join(rw.order_kept(o, "episode", "agent", "o_orderkey"), "episode").select("episode", fixed(reward, 6).alias("reward"))
