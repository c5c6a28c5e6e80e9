"""Queries over logs: volatility, escalation, transitions, shared deltas, caches, and document diffs.

Events stand in for snapshots: a user is a page, an event type is a state, its value the number of
warnings modulo 10. Order is (ts, event_id). Windows are partitioned by user; a user's events are the log of
one page, and aggregations are partial before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, WindowSpec
from pyspark.sql import functions as F

from heddle.operators import delivery
from heddle.sources.tables import table



def by_time() -> WindowSpec:
    return Window.partitionBy("user_id").orderBy("ts", "event_id")


def _log(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, event_id, ts, state, warnings, tens, changed, step): changed where the state differs from the last."""
    rows = table(spark, sf, "events").select(
        "user_id", "event_id", "ts", F.col("event_type").alias("state"), (F.floor("value") % 10).cast("long").alias("warnings"),
        F.floor(F.col("value") / 10).cast("long").alias("tens"),
    )
    last = F.lag("state").over(by_time())
    return rows.withColumn("changed", F.coalesce((last != F.col("state")).cast("int"), F.lit(0))).withColumn(
        "step", F.row_number().over(by_time()).cast("long")
    )


def event_volatility(spark: SparkSession, sf: str) -> DataFrame:
    """Changes per observation of each page observed more than once or changed."""
    found = _log(spark, sf).groupBy("user_id").agg(
        F.sum("changed").cast("long").alias("changes"), F.count("*").alias("observations")
    )
    return found.filter("observations > 1 OR changes > 0").withColumn(
        "volatility", F.round(F.col("changes") / F.col("observations"), 6)
    )


def escalation_steps(spark: SparkSession, sf: str) -> DataFrame:
    """Steps whose warnings exceed the previous step's; three or more make a finding."""
    rise = F.col("warnings") > F.coalesce(F.lag("warnings").over(by_time()), F.lit(0))
    found = _log(spark, sf).withColumn("rise", rise.cast("int")).groupBy("user_id").agg(
        F.sum("rise").cast("long").alias("rises"), F.count("*").alias("steps")
    )
    return found.filter("rises >= 3").withColumn("confidence", F.round(F.least(F.lit(1.0), F.col("rises") / F.col("steps")), 6))


def _patterns(spark: SparkSession, sf: str) -> DataFrame:
    """(user_id, kind, confidence): findings of four kinds with the weight of their kind.

    A snapshot has three parts (state, warnings, tens of the value); a step that changes most of them is structural.
    """
    escalating = escalation_steps(spark, sf).select("user_id", F.lit("escalating").alias("kind"), "confidence", F.lit(0.9).alias("w"))
    seen = _log(spark, sf).groupBy("user_id", "state").agg(
        F.count("*").alias("obs"), F.sum((F.col("warnings") >= 8).cast("int")).alias("warned"), F.sum("changed").alias("changes")
    )
    share = F.least(F.lit(0.9), F.col("warned") / F.col("obs"))
    gradual = seen.filter("obs > 2 AND warned > 0 AND warned < obs").select(
        "user_id", F.lit("gradual").alias("kind"), F.round(share, 6).alias("confidence"), F.lit(0.8).alias("w")
    )
    parts = ["state", "warnings", "tens"]
    moved = sum((F.lag(p).over(by_time()) != F.col(p)).cast("int") for p in parts)
    steps = _log(spark, sf).withColumn("moved", moved)
    structural = (
        steps.filter(F.col("moved") / len(parts) > 0.5)
        .select("user_id", F.lit("structural").alias("kind"), F.lit(0.5).alias("confidence"), F.lit(0.4).alias("w"))
        .distinct()
    )
    volatile = (
        seen.filter("obs >= 3 AND changes / obs > 0.7")
        .select("user_id", F.lit("volatile").alias("kind"), F.lit(0.6).alias("confidence"), F.lit(0.5).alias("w"))
        .distinct()
    )
    return escalating.unionAll(gradual.filter("confidence > 0.2")).unionAll(volatile).unionAll(structural)


def adversarial_patterns(spark: SparkSession, sf: str) -> DataFrame:
    found = _patterns(spark, sf).groupBy("user_id", "kind")
    return found.agg(F.count("*").alias("n"), F.round(F.max("confidence"), 6).alias("confidence"))


def risk_score(spark: SparkSession, sf: str) -> DataFrame:
    mean = F.round(F.least(F.lit(1.0), F.avg(F.col("w") * F.col("confidence"))), 4)
    return _patterns(spark, sf).groupBy("user_id").agg(mean.alias("risk"))


def predict_next(spark: SparkSession, sf: str) -> DataFrame:
    """Expected warnings: the mean of the last three, rounded up; 0 after a single snapshot. And the states likely to change."""
    late = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = _log(spark, sf).withColumn("back", F.row_number().over(late))
    seen = rows.groupBy("user_id", "state").agg(F.count("*").alias("obs"), F.sum("changed").alias("changes"))
    volatile = F.array_sort(F.collect_set(F.when((F.col("obs") >= 2) & (F.col("changes") / F.col("obs") > 0.5), F.col("state"))))
    likely = seen.groupBy("user_id").agg(F.array_join(volatile, ",").alias("likely_changed"))
    found = rows.groupBy("user_id").agg(
        F.when(F.count("*") >= 2, F.ceil(F.avg(F.when(F.col("back") <= 3, F.col("warnings"))))).otherwise(0).cast("long").alias("expected"),
        F.max(F.when(F.col("back") == 1, F.col("state"))).alias("last_state"),
        F.when(F.count("*") >= 3, 0.7).otherwise(0.3).alias("confidence"),
    )
    return found.join(likely, "user_id")


def _edges(spark: SparkSession, sf: str) -> DataFrame:
    """(a, b, obs, risk): observed transitions; a transition's risk is the share that ends with warnings."""
    rows = _log(spark, sf).select(
        F.col("state").alias("a"),
        F.lead("state").over(by_time()).alias("b"),
        F.lead("warnings").over(by_time()).alias("ahead"),
    )
    return rows.filter("b IS NOT NULL").groupBy("a", "b").agg(
        F.count("*").alias("obs"), F.avg((F.col("ahead") >= 8).cast("double")).alias("risk")
    )


def markov_edges(spark: SparkSession, sf: str) -> DataFrame:
    """Transition counts with the probability of each target from its state."""
    total = F.sum("obs").over(Window.partitionBy("a"))
    return _edges(spark, sf).select(
        "a", "b", "obs", F.round(F.col("obs") / total, 6).alias("probability"), F.round("risk", 6).alias("risk")
    )


def predict_outcome(spark: SparkSession, sf: str) -> DataFrame:
    """The likeliest next state of each state and the expected risk."""
    likely = Window.partitionBy("a").orderBy(F.desc("probability"), "b")
    rows = markov_edges(spark, sf).withColumn("_r", F.row_number().over(likely))
    return rows.groupBy("a").agg(
        F.max(F.when(F.col("_r") == 1, F.col("b"))).alias("next_state"),
        F.round(F.sum(F.col("probability") * F.col("risk")), 5).alias("expected_risk"),
    )


def safest_path(spark: SparkSession, sf: str) -> DataFrame:
    """The simple path of at most three steps from `view` to each state with the least risk minus probability.

    States are few (a closed set), so bounded paths are three joins of the small edge table.
    """
    edges = markov_edges(spark, sf).select("a", "b", (F.col("risk") - F.col("probability")).alias("cost"))
    step = edges.filter("a = 'view' AND b <> 'view'")
    paths = step.select(F.array("a", "b").alias("path"), F.col("b").alias("at"), "cost")
    found = paths
    for _ in range(2):
        paths = (
            paths.join(edges.withColumnRenamed("cost", "more"), F.col("at") == F.col("a"))
            .filter(~F.array_contains("path", F.col("b")))
            .select(F.array_append("path", F.col("b")).alias("path"), F.col("b").alias("at"), (F.col("cost") + F.col("more")).alias("cost"))
        )
        found = found.unionAll(paths)
    named = found.select("at", F.round("cost", 5).alias("cost"), F.array_join("path", ">").alias("path"))
    best = Window.partitionBy("at").orderBy("cost", "path")
    return named.withColumn("_r", F.row_number().over(best)).filter("_r = 1").select("at", "cost", "path")


def latest_delta_per_key(spark: SparkSession, sf: str) -> DataFrame:
    """The newest publication of each (user, type) with its version."""
    newest = F.struct("ts", "event_id", "value")
    found = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(newest).alias("m"), F.count("*").alias("version"))
    return found.select("user_id", "event_type", "version", F.col("m.event_id").alias("event_id"), F.col("m.value").alias("value"))


def deliveries(spark: SparkSession, sf: str) -> DataFrame:
    """What each consumer got of what others of its team published, once for each address: at which fetch, in which version."""
    return delivery.deliveries(delivery.team_events(table(spark, sf, "events")))


def undelivered_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """What each consumer has not had: later versions of what it got, and what waits for its next fetch."""
    return delivery.undelivered(delivery.team_events(table(spark, sf, "events")))


def collab_stats(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").groupBy("event_type")
    return rows.agg(
        F.count("*").alias("deltas"), F.count_distinct("user_id").alias("agents"), F.round(F.sum("value"), 2).alias("total")
    )


def lru_keep(spark: SparkSession, sf: str) -> DataFrame:
    """The three most recently used types of each user."""
    used = table(spark, sf, "events").groupBy("user_id", "event_type").agg(F.max(F.struct("ts", "event_id")).alias("m"))
    late = Window.partitionBy("user_id").orderBy(F.desc("m"), "event_type")
    return used.withColumn("rank", F.row_number().over(late).cast("long")).filter("rank <= 3").select("user_id", "event_type", "rank")


def ttl_valid(spark: SparkSession, sf: str) -> DataFrame:
    """Entries still valid at a given time (the clock is a parameter): a day for purchases, an hour for the rest."""
    now = F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")
    life = F.when(F.col("event_type") == "purchase", F.expr("INTERVAL 24 HOURS")).otherwise(F.expr("INTERVAL 1 HOUR"))
    rows = table(spark, sf, "events").filter((F.col("ts") <= now) & (F.col("ts") + life > now))
    return rows.select("event_id", "user_id", "event_type")


def ema_gain(spark: SparkSession, sf: str) -> DataFrame:
    """Exponential moving average (0.3) of all values of each user, in order.

    A value that stands ``back`` places before the last weighs 0.3 * 0.7 ** back, the first one 0.7 ** back: a plain sum.
    """
    late = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf, "events").select(
        "user_id", "value", F.row_number().over(by_time()).alias("step"), (F.row_number().over(late) - 1).alias("back")
    )
    weight = F.pow(F.lit(0.7), F.col("back")) * F.when(F.col("step") == 1, 1.0).otherwise(0.3)
    return rows.groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum(F.col("value") * weight), 6).alias("ema"))


def _values(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select("user_id", "value", F.row_number().over(by_time()).cast("long").alias("step"))


def low_gain_streak(spark: SparkSession, sf: str) -> DataFrame:
    """The longest run of consecutive values under 50 of each user (gaps and islands)."""
    ordered = Window.partitionBy("user_id").orderBy("step")
    rows = _values(spark, sf).withColumn("low", (F.col("value") < 50).cast("int"))
    island = rows.withColumn("g", F.sum(1 - F.col("low")).over(ordered)).filter("low = 1")
    runs = island.groupBy("user_id", "g").agg(F.count("*").alias("n"))
    return runs.groupBy("user_id").agg(F.max("n").alias("longest"))


def latency_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Median and 95th percentile (nearest index) of the latest 50 values of each user."""
    late = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    rows = table(spark, sf, "events").withColumn("_r", F.row_number().over(late)).filter("_r <= 50")
    vs = rows.groupBy("user_id").agg(F.array_sort(F.collect_list("value")).alias("vs"))
    at = lambda p: F.get("vs", F.round(F.lit(p) * (F.size("vs") - 1)).cast("int"))
    return vs.select("user_id", at(0.5).alias("p50"), at(0.95).alias("p95"))


# --- document versions ---------------------------------------------------------------------------


def _versions(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """An old and a new version of the documents, by a fixed rule: some go, some come, some change."""
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source", "n_chars")
    old = rows.filter("doc_id % 7 <> 0")
    new = rows.filter("doc_id % 5 <> 0").select(
        "doc_id",
        "lang",
        F.when(F.col("doc_id") % 3 == 0, F.concat("source", F.lit("-moved"))).otherwise(F.col("source")).alias("source"),
        F.when(F.col("doc_id") % 4 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).alias("n_chars"),
    )
    return old, new


def snapshot_diff_changes(spark: SparkSession, sf: str) -> DataFrame:
    """One row per added or removed document and per changed field: a full outer join on the key."""
    old, new = _versions(spark, sf)
    both = old.alias("o").join(new.alias("n"), "doc_id", "full_outer")
    gone, come = F.col("n.n_chars").isNull() & F.col("n.source").isNull(), F.col("o.n_chars").isNull() & F.col("o.source").isNull()
    fields = F.array(
        *[
            F.struct(F.lit(c).alias("field"), F.col(f"o.{c}").cast("string").alias("old"), F.col(f"n.{c}").cast("string").alias("new"))
            for c in ("lang", "source", "n_chars")
        ]
    )
    none = F.struct(F.lit(None).cast("string").alias("field"), F.lit(None).cast("string").alias("old"), F.lit(None).cast("string").alias("new"))
    changes = F.when(gone | come, F.array(none)).otherwise(F.filter(fields, lambda f: ~f["old"].eqNullSafe(f["new"])))
    kind = F.when(gone, "removed").when(come, "added").otherwise("modified")
    return both.select("doc_id", kind.alias("change"), F.explode(changes).alias("f")).select("doc_id", "change", "f.field", "f.old", "f.new")


def snapshot_diff_summary(spark: SparkSession, sf: str) -> DataFrame:
    old, new = _versions(spark, sf)
    counts = snapshot_diff_changes(spark, sf).select("doc_id", "change").distinct().groupBy("change").agg(F.count("*").alias("documents"))
    sizes = old.agg(F.count("*").alias("b")).crossJoin(new.agg(F.count("*").alias("a")))  # one row each
    saved = 1 - F.col("documents") / F.greatest("a", "b")
    return counts.crossJoin(F.broadcast(sizes)).select("change", "documents", F.round(F.greatest(F.lit(0.0), saved), 6).alias("savings"))


def content_hash_changed(spark: SparkSession, sf: str) -> DataFrame:
    """Languages whose content differs between versions: two order-free sums of 64-bit row hashes; one that came or went differs.

    Sums need no sorted list of a language's rows in one task; that both agree by chance has a probability of 2 ** -128.
    """
    old, new = _versions(spark, sf)
    row = F.concat_ws("|", "doc_id", "source", "n_chars")
    total = lambda h: F.sum(h.cast("decimal(38,0)"))
    digest = F.struct(total(F.xxhash64(row)), total(F.xxhash64(F.lit(7), row)))
    of = lambda df, h, n: df.groupBy("lang").agg(digest.alias(h), F.count("*").alias(n))
    both = of(old, "h", "n").alias("o").join(of(new, "h2", "n2").alias("m"), F.col("o.lang").eqNullSafe(F.col("m.lang")), "full")
    count = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select(F.coalesce("o.lang", "m.lang").alias("lang"), (~F.col("h").eqNullSafe(F.col("h2"))).alias("changed"), count("n"), count("n2"))


LOG = """
WITH log AS (SELECT user_id, event_id, ts, event_type AS state, (floor(value)::BIGINT % 10) AS warnings,
  coalesce((lag(event_type) OVER w <> event_type)::INT, 0) AS changed, row_number() OVER w AS step,
  coalesce(((floor(value)::BIGINT % 10) > coalesce(lag(floor(value)::BIGINT % 10) OVER w, 0))::INT, 0) AS rise,
  lead(event_type) OVER w AS b, lead(floor(value)::BIGINT % 10) OVER w AS ahead,
  row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS back, value
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
esc AS (SELECT user_id, sum(rise)::BIGINT AS rises, count(*) AS steps, round(least(1.0, sum(rise) / count(*)), 6)::DOUBLE AS confidence
  FROM log GROUP BY user_id HAVING sum(rise) >= 3),
seen AS (SELECT user_id, state, count(*) AS obs, count(*) FILTER (WHERE warnings >= 8) AS warned, sum(changed) AS changes
  FROM log GROUP BY ALL),
moves AS (SELECT user_id, (lag(event_type) OVER w <> event_type)::INT + ((lag(floor(value)::BIGINT % 10) OVER w) <> floor(value)::BIGINT % 10)::INT
    + (lag(floor(value / 10)::BIGINT) OVER w <> floor(value / 10)::BIGINT)::INT AS moved
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
patterns AS (SELECT user_id, 'escalating' AS kind, confidence, 0.9::DOUBLE AS w FROM esc
  UNION ALL SELECT user_id, 'gradual', round(least(0.9, warned / obs), 6)::DOUBLE, 0.8 FROM seen
    WHERE obs > 2 AND warned > 0 AND warned < obs AND round(least(0.9, warned / obs), 6) > 0.2
  UNION ALL SELECT DISTINCT user_id, 'volatile', 0.6::DOUBLE, 0.5 FROM seen WHERE obs >= 3 AND changes / obs > 0.7
  UNION ALL SELECT DISTINCT user_id, 'structural', 0.5::DOUBLE, 0.4 FROM moves WHERE moved / 3 > 0.5),
raw_edges AS (SELECT state AS a, b, count(*) AS obs, avg((ahead >= 8)::INT) AS risk FROM log WHERE b IS NOT NULL GROUP BY ALL),
edges AS (SELECT a, b, obs, round(obs / sum(obs) OVER (PARTITION BY a), 6)::DOUBLE AS probability, round(risk, 6) AS risk FROM raw_edges)
"""
DIFF = """
WITH o AS (SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id % 7 <> 0),
n AS (SELECT doc_id, lang, CASE WHEN doc_id % 3 = 0 THEN source || '-moved' ELSE source END AS source,
  CASE WHEN doc_id % 4 = 0 THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents WHERE doc_id % 5 <> 0),
pairs AS (SELECT o.*, n.lang AS lang2, n.source AS source2, n.n_chars AS n2 FROM o JOIN n USING (doc_id)),
changes AS (
  SELECT doc_id, 'removed' AS change, NULL AS field, NULL AS old, NULL AS new FROM o WHERE doc_id NOT IN (SELECT doc_id FROM n)
  UNION ALL SELECT doc_id, 'added', NULL, NULL, NULL FROM n WHERE doc_id NOT IN (SELECT doc_id FROM o)
  UNION ALL SELECT doc_id, 'modified', 'lang', lang, lang2 FROM pairs WHERE lang IS DISTINCT FROM lang2
  UNION ALL SELECT doc_id, 'modified', 'source', source, source2 FROM pairs WHERE source IS DISTINCT FROM source2
  UNION ALL SELECT doc_id, 'modified', 'n_chars', n_chars::VARCHAR, n2::VARCHAR FROM pairs WHERE n_chars IS DISTINCT FROM n2)
"""

QUERIES = {
    f.__name__: f
    for f in (
        event_volatility, escalation_steps, adversarial_patterns, risk_score, predict_next, markov_edges, predict_outcome,
        safest_path, latest_delta_per_key, deliveries, undelivered_deltas, collab_stats, lru_keep, ttl_valid, ema_gain, low_gain_streak,
        latency_percentiles, snapshot_diff_changes, snapshot_diff_summary, content_hash_changed,
    )
}
DELIVERY = f"""
WITH e AS (SELECT user_id // {delivery.TEAM} AS team, user_id, event_type, ts, event_id FROM events WHERE user_id IS NOT NULL AND ts IS NOT NULL AND event_type IS NOT NULL),
pubs AS (SELECT team, user_id AS publisher, event_type AS topic, ts, event_id FROM e WHERE event_type <> 'view'),
born AS (SELECT * FROM pubs QUALIFY row_number() OVER (PARTITION BY publisher, topic ORDER BY ts, event_id) = 1),
asked AS (SELECT team, user_id AS consumer, ts, event_id FROM e WHERE event_type = 'view'),
got AS (SELECT c.consumer, b.publisher, b.topic, a.ts, a.event_id AS fetch_id
  FROM born b JOIN (SELECT DISTINCT team, consumer FROM asked) c ON b.team = c.team AND b.publisher <> c.consumer
  LEFT JOIN asked a ON a.consumer = c.consumer AND (a.ts > b.ts OR (a.ts = b.ts AND a.event_id > b.event_id))
  QUALIFY row_number() OVER (PARTITION BY c.consumer, b.publisher, b.topic ORDER BY a.ts, a.event_id) = 1)
"""
ORACLE = {
    "event_volatility": LOG
    + """SELECT user_id, sum(changed)::BIGINT AS changes, count(*) AS observations,
  round(sum(changed) / count(*), 6) AS volatility FROM log GROUP BY user_id HAVING count(*) > 1 OR sum(changed) > 0""",
    "escalation_steps": LOG + "SELECT * FROM esc",
    "adversarial_patterns": LOG
    + "SELECT user_id, kind, count(*) AS n, round(max(confidence), 6) AS confidence FROM patterns GROUP BY ALL",
    "risk_score": LOG + "SELECT user_id, round(least(1.0, avg(w * confidence)), 4) AS risk FROM patterns GROUP BY user_id",
    "predict_next": LOG
    + """SELECT user_id, CASE WHEN count(*) >= 2 THEN ceil(avg(warnings) FILTER (WHERE back <= 3))::BIGINT ELSE 0 END AS expected,
  max(state) FILTER (WHERE back = 1) AS last_state, (CASE WHEN count(*) >= 3 THEN 0.7 ELSE 0.3 END)::DOUBLE AS confidence,
  any_value(likely) AS likely_changed
FROM log JOIN (SELECT user_id, coalesce(string_agg(state, ',' ORDER BY state) FILTER (WHERE obs >= 2 AND changes / obs > 0.5), '') AS likely
  FROM seen GROUP BY user_id) USING (user_id) GROUP BY user_id""",
    "markov_edges": LOG + "SELECT * FROM edges",
    "predict_outcome": LOG
    + """SELECT a, first(b ORDER BY probability DESC, b) AS next_state, round(sum(probability * risk), 5) AS expected_risk
FROM edges GROUP BY a""",
    "safest_path": LOG
    + """, one AS (SELECT ['view', b] AS path, b AS dest, risk - probability AS cost FROM edges WHERE a = 'view' AND b <> 'view'),
two AS (SELECT list_append(path, e.b) AS path, e.b AS dest, cost + (risk - probability) AS cost FROM one JOIN edges e ON dest = a WHERE NOT list_contains(path, e.b)),
three AS (SELECT list_append(path, e.b) AS path, e.b AS dest, cost + (risk - probability) AS cost FROM two JOIN edges e ON dest = a WHERE NOT list_contains(path, e.b)),
allp AS (SELECT dest, round(cost, 5) AS cost, array_to_string(path, '>') AS path FROM (FROM one UNION ALL FROM two UNION ALL FROM three))
SELECT dest AS "at", cost, path FROM allp QUALIFY row_number() OVER (PARTITION BY dest ORDER BY cost, path) = 1""",
    "latest_delta_per_key": """SELECT user_id, event_type, count(*) AS version, first(event_id ORDER BY ts DESC, event_id DESC) AS event_id,
  first(value ORDER BY ts DESC, event_id DESC) AS value FROM events GROUP BY ALL""",
    "deliveries": DELIVERY
    + """SELECT g.consumer, g.publisher, g.topic, g.fetch_id, count(*) AS version FROM got g JOIN pubs x ON x.publisher = g.publisher AND x.topic = g.topic
  AND (x.ts < g.ts OR (x.ts = g.ts AND x.event_id < g.fetch_id)) WHERE g.fetch_id IS NOT NULL GROUP BY ALL""",
    "undelivered_deltas": DELIVERY
    + """SELECT g.consumer, g.publisher, g.topic, count(*) FILTER (WHERE x.ts < g.ts OR (x.ts = g.ts AND x.event_id < g.fetch_id)) AS had, count(*) AS version
FROM got g JOIN pubs x ON x.publisher = g.publisher AND x.topic = g.topic GROUP BY ALL HAVING had < version""",
    "collab_stats": "SELECT event_type, count(*) AS deltas, count(DISTINCT user_id) AS agents, round(sum(value), 2) AS total FROM events GROUP BY ALL",
    "lru_keep": """SELECT * FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY max(ts) DESC, event_type) AS rank
  FROM events GROUP BY user_id, event_type) WHERE rank <= 3""",
    "ttl_valid": """SELECT event_id, user_id, event_type FROM events WHERE ts <= TIMESTAMP '2024-01-15'
  AND ts + CASE WHEN event_type = 'purchase' THEN INTERVAL 24 HOUR ELSE INTERVAL 1 HOUR END > TIMESTAMP '2024-01-15'""",
    "ema_gain": LOG
    + """, v AS (SELECT user_id, list(value ORDER BY step) AS vs FROM log GROUP BY user_id)
SELECT user_id, len(vs) AS n, round(list_reduce(vs, lambda acc, x: acc * 0.7::DOUBLE + x * 0.3::DOUBLE), 6) AS ema FROM v""",
    "low_gain_streak": LOG
    + """, g AS (SELECT user_id, value < 50 AS low, sum((value >= 50)::INT) OVER (PARTITION BY user_id ORDER BY step) AS g FROM log)
SELECT user_id, max(n) AS longest FROM (SELECT user_id, g, count(*) AS n FROM g WHERE low GROUP BY ALL) GROUP BY user_id""",
    "latency_percentiles": LOG
    + """, v AS (SELECT user_id, list_sort(list(value)) AS vs FROM log WHERE back <= 50 GROUP BY user_id)
SELECT user_id, vs[round(0.5 * (len(vs) - 1))::INT + 1] AS p50, vs[round(0.95 * (len(vs) - 1))::INT + 1] AS p95 FROM v""",
    "snapshot_diff_changes": DIFF + "SELECT * FROM changes",
    "snapshot_diff_summary": DIFF
    + """SELECT change, count(DISTINCT doc_id) AS documents, round(greatest(0.0, 1 - count(DISTINCT doc_id) /
  greatest((SELECT count(*) FROM o), (SELECT count(*) FROM n))), 6)::DOUBLE AS savings FROM changes GROUP BY change""",
    "content_hash_changed": DIFF
    + """, a AS (SELECT lang, list_sort(list(concat_ws('|', doc_id, source, n_chars))) AS h, count(*) AS n FROM o GROUP BY lang),
b AS (SELECT lang, list_sort(list(concat_ws('|', doc_id, source, n_chars))) AS h, count(*) AS n2 FROM n GROUP BY lang)
SELECT coalesce(a.lang, b.lang) AS lang, a.h IS DISTINCT FROM b.h AS changed, coalesce(n, 0) AS n, coalesce(n2, 0) AS n2
FROM a FULL JOIN b ON a.lang IS NOT DISTINCT FROM b.lang""",
}
