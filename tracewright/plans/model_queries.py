"""Registered queries on model fitting, search and study statistics, and sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import frames, numeric
from ..operators import fitting, models, selection, study
from ..operators.ordered import entries_at, numbered
from ..operators.traces import iats
from ..sources import artifacts, capture_splits, headers, inspection, pcapng
from ..sources.shared import new_folder
from .trace_queries import SNAP, TRACE, nine, pair, read, trace

Q1, Q2, ALPHA, SUPPORT, SCALE = 1 / 3, 2 / 3, 0.5, 1000, 1.25
FAMILIES = ("markov_renewal", "mmpp", "poisson_empirical")
ELITES = 3


# Fitting


def stated(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = trace(spark, sf_dir)
    return fitting.states(t, fitting.type7_thresholds(t, Q1, Q2))


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = stated(spark, sf_dir)
    return fitting.transition_counts(fitting.transitions(s), s)


def mark_counts(spark, sf_dir):
    return fitting.marks(trace(spark, sf_dir)).select("trace_id", F.col("direction").cast("int").alias("direction"), "frame_length", "count", "first_seq")


def mark_distribution(spark, sf_dir):
    found = fitting.mark_distribution(trace(spark, sf_dir))
    return found.select("trace_id", F.size("marks").alias("entries"), F.aggregate("marks", F.lit(0).cast("bigint"), lambda a, m: a + m["count"]).alias("total"), F.col("marks")[0]["frame_length"].alias("first_length"))


def type7_thresholds(spark, sf_dir):
    return fitting.type7_thresholds(trace(spark, sf_dir), Q1, Q2).select("trace_id", nine("t1"), nine("t2"))


def markov_states(spark, sf_dir):
    return stated(spark, sf_dir).select("trace_id", "seq", "code", "state")


def transition_counts(spark, sf_dir):
    return counts(spark, sf_dir).select("trace_id", "source", "destination", "n")


def transition_rows(spark, sf_dir):
    return fitting.transition_rows(counts(spark, sf_dir), ALPHA).select("trace_id", "source", "destination", nine("p"))


def stationary_law(spark, sf_dir):
    return fitting.stationary(fitting.transition_rows(counts(spark, sf_dir), ALPHA)).select("trace_id", "state", nine("p"))


def timing_tiers(spark, sf_dir):
    return fitting.timing_tiers(counts(spark, sf_dir), SUPPORT).select("trace_id", "source", "destination", "tier")


def tier_usage(spark, sf_dir):
    return fitting.tier_usage(fitting.timing_tiers(counts(spark, sf_dir), SUPPORT))


def iat_samples(spark, sf_dir):
    found = fitting.iat_samples(fitting.transitions(stated(spark, sf_dir)), ["source", "destination"])
    total = F.aggregate("iats", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return found.select("trace_id", "source", "destination", F.size("iats").alias("n"), F.col("iats")[0].alias("first_iat"), total.alias("total_iat"))


#: Entries of a payload's arrays in the queries; small, so that small tables have several.
PAYLOAD = 64


def iat_payloads(spark, sf_dir):
    """Inter-arrival samples of all three levels (edge, source, trace) as ordered chunks of bounded arrays."""
    steps = fitting.transitions(stated(spark, sf_dir)).persist()
    out = None
    for level, by in (("edge", ["source", "destination"]), ("source", ["source"]), ("global", [])):
        chunks = fitting.iat_chunks(steps, by, PAYLOAD)
        named = [F.col(c).cast("int").alias(c) if c in by else F.lit(-1).alias(c) for c in ("source", "destination")]
        first, last = F.col("entries")[0], F.element_at("entries", -1)
        total = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, x: a + x["iat"])
        rows = chunks.select(F.lit(level).alias("level"), "trace_id", *named, "chunk", "first_rank", F.size("entries").alias("n"), first["iat"].alias("first_iat"), last["seq"].alias("last_seq"), total.alias("total_iat"))
        out = rows if out is None else out.unionByName(rows)
    return out


def mark_payloads(spark, sf_dir):
    chunks = fitting.mark_chunks(trace(spark, sf_dir), PAYLOAD)
    total = F.aggregate("entries", F.lit(0).cast("bigint"), lambda a, x: a + x["count"])
    return chunks.select("trace_id", "chunk", "first_rank", F.size("entries").alias("n"), F.col("entries")[0]["first_seq"].alias("first_seq"), F.element_at("entries", -1)["frame_length"].alias("last_length"), total.alias("total"))


def sampled_iats(spark, sf_dir):
    """Every hundredth rank of each edge's sample, looked up in the chunks."""
    chunks = fitting.iat_chunks(fitting.transitions(stated(spark, sf_dir)), ["source", "destination"], PAYLOAD).persist()
    by = ["trace_id", "source", "destination"]
    sizes = chunks.groupBy(*by).agg(F.max(F.col("first_rank") + F.size("entries") - 1).alias("n"))
    wanted = sizes.select(*by, F.explode(F.sequence(F.lit(1).cast("bigint"), "n", F.lit(100).cast("bigint"))).alias("rank"))
    return entries_at(chunks, wanted, by, PAYLOAD).select(*by, "rank", F.col("entry.iat").alias("iat"))


def poisson_rate(spark, sf_dir):
    return fitting.poisson_rates(trace(spark, sf_dir), SCALE).select("trace_id", nine("base_rate"), nine("rate"))


def flow_check(spark, sf_dir):
    s = stated(spark, sf_dir)
    c = fitting.transition_counts(fitting.transitions(s), s)
    return fitting.flow_consistent(fitting.flow(c, s)).join(fitting.connected(c), "trace_id")


def short_transitions(spark, sf_dir):
    """Transitions between return flags over the lines of each order: many short sequences."""
    rows = read(spark, sf_dir, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    steps = rows.select(F.col("l_returnflag").alias("source"), F.lead("l_returnflag").over(w).alias("destination")).where("destination is not null")
    return steps.groupBy("source", "destination").agg(F.count("*").alias("n"))


CODED = f"""{TRACE},
th AS (SELECT trace_id, quantile_cont(CAST(frame_length AS DOUBLE), {Q1!r}) AS t1, quantile_cont(CAST(frame_length AS DOUBLE), {Q2!r}) AS t2 FROM trace GROUP BY 1),
cd AS (SELECT trace.*, direction * 3 + CASE WHEN frame_length <= t1 THEN 0 WHEN frame_length <= t2 THEN 1 ELSE 2 END AS code FROM trace JOIN th USING (trace_id)),
od AS (SELECT trace_id, code, CAST(rank() OVER (PARTITION BY trace_id ORDER BY min(seq)) - 1 AS INTEGER) AS state FROM cd GROUP BY 1, 2),
st AS (SELECT cd.*, state FROM cd JOIN od USING (trace_id, code)),
steps AS (SELECT * FROM (SELECT trace_id, seq, state AS source, lead(state) OVER w AS destination, lead(ts_us) OVER w - ts_us AS iat FROM st WINDOW w AS (PARTITION BY trace_id ORDER BY seq)) WHERE destination IS NOT NULL),
grid AS (SELECT a.trace_id, a.state AS source, b.state AS destination FROM od a JOIN od b USING (trace_id)),
tc AS (SELECT trace_id, source, destination, count(steps.seq) AS n FROM grid LEFT JOIN steps USING (trace_id, source, destination) GROUP BY ALL),
tr AS (SELECT *, sum(n) OVER (PARTITION BY trace_id, source) AS total, count(*) OVER (PARTITION BY trace_id, source) AS k FROM tc),
tiers AS (SELECT *, CASE WHEN n >= {SUPPORT} THEN 'transition' WHEN total > 0 THEN 'source' ELSE 'global' END AS tier FROM tr)"""

FIT_SQL = {
    "mark_counts": f'WITH {TRACE} SELECT trace_id, direction, frame_length, count(*) AS "count", min(seq) AS first_seq FROM trace GROUP BY 1, 2, 3',
    "mark_distribution": f"WITH {TRACE}, m AS (SELECT trace_id, frame_length, count(*) AS c, min(seq) AS f FROM trace GROUP BY 1, 2, direction) SELECT trace_id, CAST(count(*) AS INTEGER) AS entries, CAST(sum(c) AS BIGINT) AS total, arg_min(frame_length, f) AS first_length FROM m GROUP BY 1",
    "type7_thresholds": f"WITH {CODED} SELECT trace_id, round(t1, 9) AS t1, round(t2, 9) AS t2 FROM th",
    "markov_states": f"WITH {CODED} SELECT trace_id, seq, code, state FROM st",
    "transition_counts": f"WITH {CODED} SELECT * FROM tc",
    "transition_rows": f"WITH {CODED} SELECT trace_id, source, destination, round((n + {ALPHA}::DOUBLE) / (total + {ALPHA}::DOUBLE * k), 9) AS p FROM tr",
    "stationary_law": f"WITH {CODED}, q0 AS MATERIALIZED (SELECT trace_id, source, destination, (n + {ALPHA}::DOUBLE) / (total + {ALPHA}::DOUBLE * k) / 2 + CASE WHEN source = destination THEN 0.5 ELSE 0 END AS p FROM tr), "
    + ", ".join(f"q{i + 1} AS MATERIALIZED (SELECT a.trace_id, a.source, b.destination, sum(a.p * b.p) AS p FROM q{i} a JOIN q{i} b ON a.trace_id = b.trace_id AND a.destination = b.source GROUP BY ALL)" for i in range(12))
    + " SELECT trace_id, destination AS state, round(avg(p), 9) AS p FROM q12 GROUP BY 1, 2",
    "timing_tiers": f"WITH {CODED} SELECT trace_id, source, destination, tier FROM tiers",
    "tier_usage": f"WITH {CODED} SELECT trace_id, " + ", ".join(f"CAST(coalesce(sum(n) FILTER (tier = '{t}'), 0) AS BIGINT) AS {t}_count" for t in ("transition", "source", "global")) + " FROM tiers GROUP BY 1",
    "iat_samples": f"WITH {CODED} SELECT trace_id, source, destination, CAST(count(*) AS INTEGER) AS n, arg_min(iat, seq) AS first_iat, CAST(sum(iat) AS BIGINT) AS total_iat FROM steps GROUP BY 1, 2, 3",
    "iat_payloads": f"""WITH {CODED}, l AS (SELECT 'edge' AS level, trace_id, source, destination, seq, iat FROM steps UNION ALL SELECT 'source', trace_id, source, -1, seq, iat FROM steps UNION ALL SELECT 'global', trace_id, -1, -1, seq, iat FROM steps),
        r AS (SELECT *, row_number() OVER (PARTITION BY level, trace_id, source, destination ORDER BY seq) AS rank FROM l)
        SELECT level, trace_id, source, destination, (rank - 1) // {PAYLOAD} AS chunk, min(rank) AS first_rank, CAST(count(*) AS INTEGER) AS n, arg_min(iat, rank) AS first_iat, max(seq) AS last_seq, CAST(sum(iat) AS BIGINT) AS total_iat FROM r GROUP BY 1, 2, 3, 4, 5""",
    "mark_payloads": f"""WITH {TRACE}, m AS (SELECT trace_id, frame_length, count(*) AS c, min(seq) AS f FROM trace GROUP BY 1, 2, direction), r AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY f) AS rank FROM m)
        SELECT trace_id, (rank - 1) // {PAYLOAD} AS chunk, min(rank) AS first_rank, CAST(count(*) AS INTEGER) AS n, min(f) AS first_seq, arg_max(frame_length, rank) AS last_length, CAST(sum(c) AS BIGINT) AS total FROM r GROUP BY 1, 2""",
    "sampled_iats": f"WITH {CODED}, r AS (SELECT *, row_number() OVER (PARTITION BY trace_id, source, destination ORDER BY seq) AS rank FROM steps) SELECT trace_id, source, destination, rank, iat FROM r WHERE rank % 100 = 1",
    "poisson_rate": f"WITH {TRACE}, p AS (SELECT trace_id, (count(*) - 1) / (max(ts_us) / 1e6) AS b FROM trace GROUP BY 1) SELECT trace_id, round(b, 9) AS base_rate, round(b * {SCALE}, 9) AS rate FROM p",
    "flow_check": f"""WITH RECURSIVE {CODED}, e AS (SELECT trace_id, source AS a, destination AS b FROM tc UNION SELECT trace_id, destination, source FROM tc),
        reached(trace_id, state) AS (SELECT trace_id, min(state) FROM st GROUP BY 1 UNION SELECT e.trace_id, e.b FROM reached r JOIN e ON e.trace_id = r.trace_id AND e.a = r.state), f AS (SELECT p.trace_id, p.state, packets, (SELECT sum(n) FROM tc WHERE tc.trace_id = p.trace_id AND source = p.state) AS o, (SELECT sum(n) FROM tc WHERE tc.trace_id = p.trace_id AND destination = p.state) AS i
        FROM (SELECT trace_id, state, count(*) AS packets FROM st GROUP BY 1, 2) p) SELECT trace_id, bool_and(packets - o IN (0, 1) AND packets - i IN (0, 1)) AND sum(packets - o) = 1 AND sum(packets - i) = 1 AS consistent,
        (SELECT count(*) FROM reached r WHERE r.trace_id = f.trace_id) = count(*) AS connected FROM f GROUP BY 1""",
    "short_transitions": """WITH s AS (SELECT l_returnflag AS source, lead(l_returnflag) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS destination FROM lineitem)
        SELECT source, destination, count(*) AS n FROM s WHERE destination IS NOT NULL GROUP BY 1, 2""",
}

# Search


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of evaluated candidates, made from orders."""
    o, family = read(spark, sf_dir, "orders"), F.pmod(F.col("o_custkey"), F.lit(3)).cast("int")
    valid = F.col("o_orderstatus") != "P"
    return o.select(
        F.pmod(F.col("o_orderkey"), F.lit(10)).cast("int").alias("generation"), F.pmod(F.col("o_orderkey"), F.lit(10)).cast("int").alias("birth_generation"),
        F.floor(F.col("o_orderkey") / 10).cast("bigint").alias("birth_index"), F.element_at(F.array(*map(F.lit, FAMILIES)), family + 1).alias("family"),
        F.pmod(family + 1, F.lit(3)).alias("priority"), F.when(valid, "valid").otherwise("invalid").alias("status"),
        F.when(valid, F.floor(F.col("o_totalprice") / 10) / 100000.0).otherwise(0.0).alias("fitness"),
        F.pmod(F.col("o_custkey"), F.lit(50)).cast("int").alias("genes"), F.col("o_orderpriority").alias("workload"), F.pmod(F.col("o_custkey"), F.lit(5)).cast("int").alias("repeat"),
    )


IDS = ("generation", "birth_generation", "birth_index", "family")


def candidate_rank(spark, sf_dir):
    return selection.ranked(candidates(spark, sf_dir)).select(*IDS, "rank")


def global_elites(spark, sf_dir):
    return selection.elites(candidates(spark, sf_dir), ELITES).select(*IDS, "rank")


def family_champions(spark, sf_dir):
    return selection.champions(candidates(spark, sf_dir)).select(*IDS)


def retained_population(spark, sf_dir):
    return selection.retained(candidates(spark, sf_dir), ELITES).select(*IDS, "slot")


def generation_history(spark, sf_dir):
    return selection.history(candidates(spark, sf_dir)).withColumn("mean_fitness", F.round("mean_fitness", 9))


def stagnation(spark, sf_dir):
    overall = candidates(spark, sf_dir).groupBy("generation").agg(F.max("fitness").alias("best_fitness"))
    return selection.stagnation(overall, 0.001).select("generation", "retained_best", "streak")


def history_faults(spark, sf_dir):
    rows = selection.history(candidates(spark, sf_dir))
    broken = rows.withColumn("candidate_count", F.col("candidate_count") + ((F.col("scope") == "overall") & (F.col("generation") % 4 == 1)).cast("int"))
    return selection.history_faults(broken)


PRIORITY = {"markov_renewal": 1, "mmpp": 2, "poisson_empirical": 0}


def history_progress(spark, sf_dir):
    """Winners, retained winners and states of each workload's run."""
    by_run = candidates(spark, sf_dir).groupBy("workload", "generation", "family").agg(
        F.max("fitness").alias("best_fitness"), F.max_by(F.struct("birth_generation", "birth_index"), F.struct("fitness", -F.col("birth_generation"), -F.col("birth_index"))).alias("best")
    )
    rows = by_run.select("workload", "generation", "family", F.lit("family").alias("scope"), "best_fitness", F.col("best.birth_generation").alias("best_birth_generation"), F.col("best.birth_index").alias("best_birth_index"))
    return selection.progress(rows, PRIORITY, 0.001, 3, 9, ["workload"])


def duplicate_candidates(spark, sf_dir):
    c = candidates(spark, sf_dir)
    before = c.withColumn("generation", F.col("generation") + 1)
    return selection.duplicates(c, before, ("generation",)).select("birth_generation", "birth_index", "family", "genes")


def candidate_trials(spark, sf_dir):
    c = selection.trials(candidates(spark, sf_dir), [17, 19, 23])
    score = F.when(F.col("status") == "valid", F.col("fitness") * (F.lit(1.0) - F.col("seed") / 100.0))
    return selection.fitness(c.withColumn("aggregate_score", score)).withColumn("fitness", F.round("fitness", 9))


def gene_coordinates(spark, sf_dir):
    c = candidates(spark, sf_dir).where("fitness > 0")
    x, lo, hi = F.col("fitness") + 0.5, F.lit(0.25), F.lit(8.0)
    z = numeric.encode_gene("log", x, lo, hi)
    moved = numeric.reflect(z + 0.9)
    return c.select("birth_generation", "birth_index", F.round(z, 9).alias("z"), F.round(moved, 9).alias("moved"), F.round(numeric.decode_gene("linear", moved, lo, hi), 9).alias("linear"), numeric.decode_gene("integer", F.round(moved, 6), F.lit(1), F.lit(100)).cast("bigint").alias("whole"))


def regime_probabilities(spark, sf_dir):
    p = read(spark, sf_dir, "part")
    q01, q10, a, b = (F.col("p_size") + i + 0.5 for i in (0, 1, 2, 7))
    return p.select("p_partkey", F.round(numeric.stationary_probability(q01, q10), 9).alias("pi0"), F.round(numeric.arrival_epoch_probability(q01, q10, a, b), 9).alias("a0"))


def family_quotas(spark, sf_dir):
    return spark.range(20, 30).select(F.col("id").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("place")).select("size", "place", numeric.quotas(F.col("size"), 3, F.col("place")).cast("bigint").alias("slots"))


CAND = """c AS (SELECT CAST(o_orderkey % 10 AS INTEGER) AS generation, CAST(o_orderkey % 10 AS INTEGER) AS birth_generation, o_orderkey // 10 AS birth_index,
  CASE o_custkey % 3 WHEN 0 THEN 'markov_renewal' WHEN 1 THEN 'mmpp' ELSE 'poisson_empirical' END AS family, (o_custkey % 3 + 1) % 3 AS priority,
  CASE WHEN o_orderstatus <> 'P' THEN 'valid' ELSE 'invalid' END AS status, CASE WHEN o_orderstatus <> 'P' THEN floor(o_totalprice / 10) / 100000.0::DOUBLE ELSE 0.0 END AS fitness,
  CAST(o_custkey % 50 AS INTEGER) AS genes, o_orderpriority AS workload, CAST(o_custkey % 5 AS INTEGER) AS repeat FROM orders),
rk AS (SELECT *, row_number() OVER (PARTITION BY generation ORDER BY fitness DESC, priority, birth_generation, birth_index) AS "rank",
  row_number() OVER (PARTITION BY generation, family ORDER BY fitness DESC, priority, birth_generation, birth_index) AS fr FROM c)"""
ID = ", ".join(IDS)

SEARCH_SQL = {
    "candidate_rank": f'WITH {CAND} SELECT {ID}, CAST("rank" AS INTEGER) AS "rank" FROM rk',
    "global_elites": f'WITH {CAND} SELECT {ID}, CAST("rank" AS INTEGER) AS "rank" FROM rk WHERE "rank" <= {ELITES}',
    "family_champions": f"WITH {CAND} SELECT {ID} FROM rk WHERE fr = 1",
    "retained_population": f'WITH {CAND} SELECT {ID}, CAST("rank" AS INTEGER) AS slot FROM rk WHERE "rank" <= {ELITES} UNION ALL SELECT {ID}, CAST({ELITES} + row_number() OVER (PARTITION BY generation ORDER BY priority) AS INTEGER) FROM rk WHERE fr = 1 AND "rank" > {ELITES}',
    "generation_history": f"""WITH {CAND} SELECT generation, CASE WHEN grouping(family) = 1 THEN 'overall' ELSE 'family' END AS scope, family, count(*) AS candidate_count, count(*) FILTER (status = 'valid') AS valid_count,
        max(fitness) AS best_fitness, round(avg(fitness), 9) AS mean_fitness, arg_min(birth_generation, "rank") AS best_birth_generation, arg_min(birth_index, "rank") AS best_birth_index FROM rk GROUP BY GROUPING SETS ((generation, family), (generation))""",
    "stagnation": f"""WITH {CAND}, o AS (SELECT generation, max(fitness) AS b FROM c GROUP BY 1), p AS (SELECT *, max(b) OVER (ORDER BY generation ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM o),
        g AS (SELECT generation, greatest(b, before) AS retained_best, CASE WHEN coalesce(b - before > 0.001, true) THEN generation END AS hit FROM p)
        SELECT generation, retained_best, generation - max(hit) OVER (ORDER BY generation) AS streak FROM g""",
    "history_faults": f"WITH {CAND} SELECT DISTINCT generation FROM c WHERE generation % 4 = 1",
    "history_progress": f"""WITH {CAND}, o AS (SELECT *, row_number() OVER (PARTITION BY workload, generation ORDER BY fitness DESC, priority, birth_generation, birth_index) AS r FROM c), w AS (SELECT * FROM o WHERE r = 1),
        h AS (SELECT w.workload, w.generation, p.family, p.fitness, p.birth_generation, p.birth_index, row_number() OVER (PARTITION BY w.workload, w.generation ORDER BY p.fitness DESC, p.priority, p.birth_generation, p.birth_index) AS r
          FROM w JOIN w p ON p.workload = w.workload AND p.generation <= w.generation),
        k AS (SELECT * FROM h WHERE r = 1),
        g AS (SELECT w.workload, w.generation, CASE WHEN coalesce(w.fitness - lag(k.fitness) OVER (PARTITION BY w.workload ORDER BY w.generation) > 0.001, true) THEN w.generation END AS hit FROM w JOIN k USING (workload, generation)),
        s AS (SELECT workload, generation, generation - max(hit) OVER (PARTITION BY workload ORDER BY generation) AS streak FROM g)
        SELECT workload, generation, w.family AS now_family, w.fitness AS now_fitness, w.birth_generation AS now_birth_generation, w.birth_index AS now_birth_index, k.family AS kept_family, k.fitness AS kept_fitness,
        k.birth_generation AS kept_birth_generation, k.birth_index AS kept_birth_index, streak, CASE WHEN generation = 9 THEN 'hard_limit' WHEN streak >= 3 THEN 'early_stop' ELSE 'running' END AS state
        FROM w JOIN k USING (workload, generation) JOIN s USING (workload, generation)""",
    "duplicate_candidates": f"WITH {CAND} SELECT birth_generation, birth_index, family, genes FROM c WHERE (generation, family, genes) IN (SELECT (generation + 1, family, genes) FROM c)",
    "candidate_trials": f"""WITH {CAND}, t AS (SELECT *, CASE WHEN status = 'valid' THEN fitness * (1 - seed / 100.0::DOUBLE) END AS s FROM c, (VALUES (17), (19), (23)) AS v(seed))
        SELECT birth_generation, birth_index, family, CASE WHEN count(s) = 3 THEN round(avg(s), 9) ELSE 0 END AS fitness, CASE WHEN count(s) = 3 THEN 'valid' ELSE 'invalid' END AS status FROM t GROUP BY 1, 2, 3""",
    "gene_coordinates": f"""WITH {CAND}, z AS (SELECT birth_generation, birth_index, (ln(fitness + 0.5) - ln(0.25)) / (ln(8.0) - ln(0.25)) AS z FROM c WHERE fitness > 0),
        m AS (SELECT *, CASE WHEN (z + 0.9) % 2 <= 1 THEN (z + 0.9) % 2 ELSE 2 - (z + 0.9) % 2 END AS m FROM z)
        SELECT birth_generation, birth_index, round(z, 9) AS z, round(m, 9) AS moved, round(0.25 + m * 7.75, 9) AS linear, CAST(1 + floor(round(m, 6) * 99 + 0.5) AS BIGINT) AS whole FROM m""",
    "regime_probabilities": """WITH q AS (SELECT p_partkey, p_size + 0.5::DOUBLE AS a, p_size + 1.5::DOUBLE AS b, p_size + 2.5::DOUBLE AS x, p_size + 7.5::DOUBLE AS y FROM part)
        SELECT p_partkey, round(b / (a + b), 9) AS pi0, round(b * x / (b * x + a * y), 9) AS a0 FROM q""",
    "family_quotas": "SELECT size, CAST(place AS INTEGER) AS place, size // 3 + CASE WHEN place < size % 3 THEN 1 ELSE 0 END AS slots FROM (SELECT unnest(range(20, 30)) AS size), (SELECT unnest(range(3)) AS place)",
}

# Study


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Component scores by workload and repeat, made from orders."""
    parts = [F.pmod(F.col("o_orderkey") * k, F.lit(997)) / 1000.0 for k in (1, 3, 5, 7)]
    return read(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("workload"), "o_orderkey", *(p.alias(m) for p, m in zip(parts, study.METHODS, strict=True)))


EVEN = dict.fromkeys(study.METHODS, 0.25)
ONLY_SIZES = dict.fromkeys(study.METHODS, 0.0) | {"frame_size_ks": 1.0}


def sample_record(spark, sf_dir):
    return study.sample_record(iats(trace(spark, sf_dir)), ["trace_id"], "iat_us", 0.9)


def descriptive_stats(spark, sf_dir):
    found = study.descriptive_statistics(read(spark, sf_dir, "orders"), ["o_orderpriority"], "o_totalprice")
    return found.select("o_orderpriority", "count", "minimum", "maximum", F.round("mean", 4).alias("mean"), F.round("range", 4).alias("range"), F.round("sample_stdev", 2).alias("sample_stdev"))


def direction_values(spark, sf_dir):
    return study.direction_values(trace(spark, sf_dir))


def natural_variation(spark, sf_dir):
    base = read(spark, sf_dir, "customer").groupBy(F.col("c_mktsegment").alias("workload"), F.pmod(F.col("c_custkey"), F.lit(3)).cast("int").alias("repeat")).agg(F.count("*").alias("n"))
    pairs = study.repeat_pairs(base.select("workload", "repeat"))
    a = base.select("workload", F.col("repeat").alias("reference"), F.col("n").alias("a"))
    b = base.select("workload", F.col("repeat").alias("generated"), F.col("n").alias("b"))
    scored = pairs.join(a, ["workload", "reference"]).join(b, ["workload", "generated"]).withColumn("score", F.col("a") / (F.col("a") + F.abs(F.col("a") - F.col("b")) * 2 + 1))
    return study.natural_variation(scored).select("workload", "pairs", nine("mean"), nine("minimum"), nine("maximum"))


def controlled_reweighting(spark, sf_dir):
    found = study.controlled_reweighting(runs(spark, sf_dir), {"even": EVEN, "sizes": ONLY_SIZES})
    return found.groupBy("workload", "weighting").agg(F.count("*").alias("n"), F.round(F.avg("aggregate"), 9).alias("aggregate"))


def score_means(spark, sf_dir):
    rows = runs(spark, sf_dir).withColumn("aggregate_score", study.weighted(EVEN))
    return study.score_means(rows, ["workload"]).select("workload", *(nine(m) for m in (*study.METHODS, "aggregate_score")))


def score_delta(spark, sf_dir):
    a = runs(spark, sf_dir)
    b = a.withColumn("iat_ks", F.col("iat_ks") / 2)
    return study.score_delta(a, b, ["workload", "o_orderkey"]).select("workload", "o_orderkey", *(nine(m) for m in study.METHODS))


def training_selection(spark, sf_dir):
    best = candidates(spark, sf_dir).groupBy("workload", "repeat").agg(F.max("fitness").alias("fitness"))
    return study.training_selection(best)


def workload_summary(spark, sf_dir):
    top = study.family_champions(candidates(spark, sf_dir), ["workload", "repeat"])
    found = study.workload_summary(top, list(FAMILIES))
    found = found.join(study.winner_variance(found, list(FAMILIES)), "workload")
    return found.select("workload", *(nine(f"{f}_mean") for f in FAMILIES), *(F.col(f"{f}_wins").cast("bigint").alias(f"{f}_wins") for f in FAMILIES), nine("win_variance"))


def invalid_report(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("failure_kind", F.lit("fit")).withColumn("detail", F.lit(""))
    return study.invalid_report(c, ["workload", "repeat"]).select("workload", "repeat", "failures", F.size("diagnostics").cast("bigint").alias("listed"))


def invalid_payloads(spark, sf_dir):
    c = candidates(spark, sf_dir).withColumn("failure_kind", F.lit("fit")).withColumn("detail", F.lit(""))
    chunks = study.invalid_chunks(c, ["workload"], PAYLOAD)
    last = F.element_at("entries", -1)
    return chunks.select("workload", "chunk", "first_rank", F.size("entries").alias("n"), F.col("entries")[0]["birth_index"].alias("first_birth"), last["birth_index"].alias("last_birth"), last["family"].alias("last_family"))


def bootstrap_ci(spark, sf_dir):
    return study.bootstrap(read(spark, sf_dir, "customer"), ["c_mktsegment"], "c_acctbal")


def lag_one_covariance(spark, sf_dir):
    return study.lag_one_covariance(iats(trace(spark, sf_dir)), ["trace_id"], "iat").select("trace_id", F.round("covariance", 3).alias("covariance"))


PARTS = ", ".join(f"(o_orderkey * {k} % 997) / 1000.0::DOUBLE AS {m}" for k, m in zip((1, 3, 5, 7), study.METHODS, strict=True))
RUNS = f"r AS (SELECT o_orderpriority AS workload, o_orderkey, {PARTS} FROM orders)"
SUM = " + ".join(f"0.25 * {m}" for m in study.METHODS)

STUDY_SQL = {
    "sample_record": f"""WITH {TRACE}, g AS (SELECT trace_id, ts_us - lag(ts_us) OVER (PARTITION BY trace_id ORDER BY seq) AS x FROM trace) SELECT trace_id, count(x) AS "count", min(x) AS minimum, median(x) AS median,
        CAST(quantile_disc(x, 0.9) AS DOUBLE) AS "quantile", max(x) AS maximum, count(*) FILTER (x = 0) AS zero_count FROM g WHERE x IS NOT NULL GROUP BY 1""",
    "lag_one_covariance": f"""WITH {TRACE}, g AS (SELECT trace_id, seq, (ts_us - lag(ts_us) OVER (PARTITION BY trace_id ORDER BY seq)) / 1e6 AS x FROM trace),
        h AS (SELECT trace_id, x - avg(x) OVER (PARTITION BY trace_id) AS x, seq FROM g WHERE x IS NOT NULL), k AS (SELECT *, lag(x) OVER (PARTITION BY trace_id ORDER BY seq) AS y FROM h)
        SELECT trace_id, round(avg(x * y), 3) AS covariance FROM k WHERE y IS NOT NULL GROUP BY 1""",
    "descriptive_stats": """SELECT o_orderpriority, count(*) AS "count", min(o_totalprice) AS minimum, max(o_totalprice) AS maximum, round(avg(o_totalprice), 4) AS mean, round(max(o_totalprice) - min(o_totalprice), 4) AS "range", round(stddev_samp(o_totalprice), 2) AS sample_stdev FROM orders GROUP BY 1""",
    "direction_values": f"WITH {TRACE} SELECT trace_id, "
    + ", ".join(f"count(*) FILTER (direction = {d}) AS {n}_packets, CAST(coalesce(sum(frame_length) FILTER (direction = {d}), 0) AS BIGINT) AS {n}_bytes" for d, n in enumerate(("outbound", "inbound")))
    + " FROM trace GROUP BY 1",
    "natural_variation": """WITH b AS (SELECT c_mktsegment AS workload, c_custkey % 3 AS r, CAST(count(*) AS DOUBLE) AS n FROM customer GROUP BY 1, 2),
        s AS (SELECT x.workload, (x.n / (x.n + abs(x.n - y.n) * 2 + 1) + y.n / (y.n + abs(x.n - y.n) * 2 + 1)) / 2 AS v FROM b x JOIN b y ON x.workload = y.workload AND x.r < y.r)
        SELECT workload, count(*) AS pairs, round(avg(v), 9) AS mean, round(min(v), 9) AS minimum, round(max(v), 9) AS maximum FROM s GROUP BY 1""",
    "controlled_reweighting": f"WITH {RUNS}, w AS (SELECT workload, 'even' AS weighting, {SUM} AS a FROM r UNION ALL SELECT workload, 'sizes', frame_size_ks FROM r) SELECT workload, weighting, count(*) AS n, round(avg(a), 9) AS aggregate FROM w GROUP BY 1, 2",
    "score_means": f"WITH {RUNS} SELECT workload, " + ", ".join(f"round(avg({m}), 9) AS {m}" for m in study.METHODS) + f", round(avg({SUM}), 9) AS aggregate_score FROM r GROUP BY 1",
    "score_delta": f"WITH {RUNS} SELECT workload, o_orderkey, " + ", ".join(f"round({'iat_ks / 2 - iat_ks' if m == 'iat_ks' else '0.0::DOUBLE'}, 9) AS {m}" for m in study.METHODS) + " FROM r",
    "training_selection": f"WITH {CAND}, b AS (SELECT workload, repeat, max(fitness) AS fitness FROM c GROUP BY 1, 2) SELECT * FROM b QUALIFY row_number() OVER (PARTITION BY workload ORDER BY fitness DESC, repeat) = 1",
    "workload_summary": f"""WITH {CAND}, f AS (SELECT * FROM c WHERE status = 'valid' QUALIFY row_number() OVER (PARTITION BY workload, repeat, family ORDER BY fitness DESC, birth_generation, birth_index) = 1),
        w AS (SELECT *, CASE WHEN row_number() OVER (PARTITION BY workload, repeat ORDER BY fitness DESC, family) = 1 THEN 1 ELSE 0 END AS win FROM f),
        n AS (SELECT workload, var_samp(wins) AS v FROM (SELECT workload, family, sum(win) AS wins FROM w GROUP BY 1, 2) GROUP BY 1)
        SELECT workload, """
    + ", ".join(f"round(avg(fitness) FILTER (family = '{f}'), 9) AS {f}_mean, CAST(coalesce(sum(win) FILTER (family = '{f}'), 0) AS BIGINT) AS {f}_wins" for f in FAMILIES)
    + ", round(max(v), 9) AS win_variance FROM w JOIN n USING (workload) GROUP BY 1",
    "invalid_payloads": f"""WITH {CAND}, r AS (SELECT *, row_number() OVER (PARTITION BY workload ORDER BY birth_generation, birth_index) AS rank FROM c WHERE status = 'invalid')
        SELECT workload, (rank - 1) // {PAYLOAD} AS chunk, min(rank) AS first_rank, CAST(count(*) AS INTEGER) AS n, arg_min(birth_index, rank) AS first_birth, arg_max(birth_index, rank) AS last_birth, arg_max(family, rank) AS last_family FROM r GROUP BY 1, 2""",
    "invalid_report": f"WITH {CAND} SELECT workload, repeat, count(*) AS failures, count(*) AS listed FROM c WHERE status = 'invalid' GROUP BY 1, 2",
}

# Sources and frames

MAC = "02:42:ac:11:00:02"
#: Packets of one capture.
CAPTURE = 2000


def dimension_counts(spark, sf_dir):
    rows = trace(spark, sf_dir).select("trace_id", F.when(F.col("direction") == 0, "outbound").otherwise("inbound").alias("direction"), F.when(F.col("frame_length") < 500, "tcp").when(F.col("frame_length") < 1000, "udp").alias("protocol"))
    return inspection.dimension_counts(rows, ("direction", "protocol"))


def frame_headers(spark, sf_dir):
    """Frames built from a trace and decoded again."""
    t = trace(spark, sf_dir)
    f = t.select("trace_id", frames.build_frame(F.col("direction"), F.col("frame_length"), F.lit(MAC)).alias("frame"))
    found = f.select("trace_id", frames.direction(F.col("frame"), F.lit(MAC)).alias("direction"), frames.mac_text(F.substring("frame", 7, 6)).alias("source_mac"), frames.uint(F.col("frame"), 12, 2).alias("ethertype"), F.octet_length("frame").alias("n"))
    return found.groupBy("trace_id", "source_mac", "ethertype", F.col("direction").cast("int").alias("direction")).agg(F.count("*").alias("packets"), F.sum("n").alias("bytes"))


def lineage_mismatch(spark, sf_dir):
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("name"), F.col("p_size").cast("bigint").alias("size"), F.sha2(F.col("p_name").cast("binary"), 256).alias("sha256"))
    key = F.col("name").cast("bigint")
    actual = p.where(key % 11 != 3).withColumn("size", F.when(key % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return artifacts.lineage(p.where(key % 13 != 5), actual)


def content_identity(spark, sf_dir):
    d = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    return artifacts.content_identities(d)


def transfer_headers(spark, sf_dir):
    k = F.col("o_orderkey")
    hop = F.when(k % 3 == 0, F.lit("HTTP/1.1 302 Found\r\nLocation: /x\r\n\r\n")).otherwise("")
    last = F.concat(F.lit("HTTP/1.1 "), F.when(k % 7 == 0, "200").otherwise("206"), F.lit(" x\r\nContent-Range: bytes 0-"), (k % 50).cast("string"), F.lit("/1000\r\ncontent-length:  "), (k % 50 + 1 + (k % 5 == 0).cast("int")).cast("string"), F.lit("\r\n\r\n"))
    o = read(spark, sf_dir, "orders").select(k.alias("transfer_id"), F.concat(hop, last).cast("binary").alias("content"), F.lit(0).cast("bigint").alias("range_start"), (k % 50).alias("range_end"), F.lit(1000).cast("bigint").alias("object_size"))
    return headers.transfers(o.select("transfer_id", "content"), o.drop("content")).select("transfer_id", "status", "content_length", "problem")


def url_validation(spark, sf_dir):
    p = read(spark, sf_dir, "pages").select("page_id", F.col("url"))
    return p.select("page_id", headers.valid_url(F.coalesce("url", F.lit(""))).alias("valid"))


def pcapng_scan(spark, sf_dir):
    """Traces written as captures of bounded pieces and read back: times are whole microseconds, the rest unchanged."""
    piece = F.floor((F.col("seq") - 1) / CAPTURE)
    t = trace(spark, sf_dir).withColumn("trace_id", F.concat_ws("/", "trace_id", piece))
    made = pcapng.captures(t, MAC, 1e9).withColumnRenamed("trace_id", "path")
    p = pcapng.packets_of(made)
    name, seq = F.substring_index("trace_id", "/", 1), F.substring_index("trace_id", "/", -1).cast("bigint") * CAPTURE + F.col("seq")
    return p.select(name.alias("trace_id"), seq.alias("seq"), F.rint(F.col("ts") * 1e6).cast("bigint").alias("ts_us"), frames.direction(F.col("frame"), F.lit(MAC)).cast("int").alias("direction"), F.octet_length("frame").cast("bigint").alias("frame_length"))


def capture_files(spark, sf_dir):
    """Each trace written as one capture file, rendered in parallel chunks, and read back by byte ranges."""
    place = new_folder(spark, "captures")
    capture_splits.write_captures(trace(spark, sf_dir), place, MAC, 1e9)
    p = capture_splits.read_trace(spark, place, MAC)
    name = F.regexp_extract("trace_id", "trace_id=([a-z]+)/", 1)
    return p.select(name.alias("trace_id"), "seq", F.rint(F.col("ts") * 1e6).cast("bigint").alias("ts_us"), F.col("direction").cast("int").alias("direction"), "frame_length")


def network_frames(spark, sf_dir):
    """One frame per event with real headers, by event: IPv4 with TCP, UDP or ICMP, IPv6 with TCP or UDP, ARP, and an IPv4 header that claims too much."""
    kind, user, extra = F.col("event_id") % 7, F.col("user_id") % 65536, F.col("event_id") % 20
    number = lambda c, digits: F.lpad(F.hex(c.cast("bigint")), digits, "0")
    four = F.concat(F.lit("0A00"), number(user, 4))
    dst4 = F.when(kind == 1, F.concat(F.lit("C0A801"), number(user % 250, 2))).otherwise(F.lit("C0A80001"))
    src6, dst6 = F.concat(F.lit("20010DB8" + "0" * 20), number(user, 4)), F.concat(F.lit("FE80" + "0" * 12 + "0001" + "0" * 8), number(user, 4))
    body = F.repeat(F.lit("00"), extra.cast("int"))
    protocol = F.when(kind == 0, "06").when(kind == 1, "11").otherwise("01")
    total = number(F.when(kind == 6, 2000).otherwise(20 + extra), 4)
    v4 = F.concat(F.lit("4500"), total, F.lit("0000000040"), protocol, F.lit("0000"), four, dst4, body)
    v6 = F.concat(F.lit("60000000"), number(extra, 4), F.when(kind == 3, "06").otherwise("11"), F.lit("40"), src6, dst6, body)
    arp = F.concat(F.lit("0001080006040001"), F.lit("00" * 6), four, F.lit("00" * 6), F.lit("0A000001"))
    mac, peer = MAC.replace(":", "").upper(), frames.PEER.replace(":", "").upper()
    ends = F.when(user % 2 == 0, peer + mac).otherwise(mac + peer)
    digits = F.when(kind.isin(3, 4), F.concat(F.lit("86DD"), v6)).when(kind == 5, F.concat(F.lit("0806"), arp)).otherwise(F.concat(F.lit("0800"), v4))
    rows = read(spark, sf_dir, "events").select("event_id", F.concat(F.lit("kind "), F.col("event_type")).alias("trace_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), F.unhex(F.concat(ends, digits)).alias("frame"))
    return numbered(rows, "trace_id", "event_id").select("trace_id", "seq", (F.col("us") / 1e6).alias("ts"), "frame")


def capture_inspection(spark, sf_dir):
    """All seven dimensions of captures: frames are written as capture files, read back by byte ranges, and their headers decoded."""
    place = new_folder(spark, "inspected")
    capture_splits.write_packets(network_frames(spark, sf_dir), place)
    found = inspection.inspect(capture_splits.read_packets(spark, place), MAC)
    return found.withColumn("trace_id", F.regexp_extract("trace_id", "trace_id=kind%20([a-z_]+)/", 1))


SOURCE_SQL = {
    "dimension_counts": f"""WITH {TRACE}, d AS (SELECT trace_id, 'direction' AS dimension, CASE WHEN direction = 0 THEN 'outbound' ELSE 'inbound' END AS key FROM trace
        UNION ALL SELECT trace_id, 'protocol', CASE WHEN frame_length < 500 THEN 'tcp' WHEN frame_length < 1000 THEN 'udp' END FROM trace),
        z AS (SELECT DISTINCT trace_id, dimension, key FROM trace, (VALUES ('direction', 'outbound'), ('direction', 'inbound'), ('protocol', 'tcp'), ('protocol', 'udp'), ('protocol', 'other')) AS v(dimension, key))
        SELECT z.trace_id, z.dimension, z.key, count(d.key) AS "count" FROM z LEFT JOIN d USING (trace_id, dimension, key) GROUP BY 1, 2, 3""",
    "frame_headers": f"WITH {TRACE} SELECT trace_id, CASE WHEN direction = 0 THEN '{MAC}' ELSE '{frames.PEER}' END AS source_mac, CAST(2048 AS BIGINT) AS ethertype, direction, count(*) AS packets, CAST(sum(frame_length) AS BIGINT) AS bytes FROM trace GROUP BY 1, 2, 3, 4",
    "lineage_mismatch": """WITH p AS (SELECT p_partkey AS k FROM part) SELECT CAST(k AS VARCHAR) AS name, CASE WHEN k % 11 = 3 THEN 'missing' WHEN k % 13 = 5 THEN 'foreign' ELSE 'changed' END AS problem
        FROM p WHERE (k % 11 = 3 AND k % 13 <> 5) OR (k % 13 = 5 AND k % 11 <> 3) OR (k % 11 <> 3 AND k % 13 <> 5 AND k % 7 = 0)""",
    "content_identity": "SELECT CAST(doc_id AS VARCHAR) AS path, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS size, sha256(coalesce(text, '')) AS sha256 FROM documents",
    "transfer_headers": """SELECT o_orderkey AS transfer_id, CASE WHEN o_orderkey % 7 = 0 THEN 200 ELSE 206 END AS status, o_orderkey % 50 + 1 + CASE WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS content_length,
        CASE WHEN o_orderkey % 7 = 0 THEN 'status' WHEN o_orderkey % 5 = 0 THEN 'length' END AS problem FROM orders""",
    "url_validation": r"""WITH u AS (SELECT page_id, coalesce(url, '') AS u, regexp_extract(regexp_extract(coalesce(url, ''), '^(?i:https?)://([^/?#]*)', 1), '([^@]*)$', 1) AS e FROM pages),
        p AS (SELECT *, regexp_replace(regexp_extract(e, '^([^:\[\]]*)(:[0-9]*)?$', 1), '\.$', '') AS h, regexp_extract(e, '^[^:\[\]]*:0*([0-9]*)$', 1) AS port FROM u)
        SELECT page_id, NOT regexp_matches(u, '\s') AND length(h) BETWEEN 1 AND 253 AND coalesce(try_cast(nullif(port, '') AS BIGINT), 0) <= 65535
          AND list_bool_and(list_transform(string_split(h, '.'), lambda l: regexp_full_match(l, '[A-Za-z0-9]([A-Za-z0-9-]{0,61}[A-Za-z0-9])?')))
          AND NOT (len(string_split(h, '.')) = 4 AND list_bool_and(list_transform(string_split(h, '.'), lambda l: regexp_full_match(l, '25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9]')))) AS valid FROM p""",
    "capture_inspection": f"""WITH e AS (SELECT event_type AS trace_id, event_id % 7 AS k, user_id % 65536 AS u FROM events),
        p AS (SELECT trace_id, CASE WHEN u % 2 = 0 THEN 'outbound' ELSE 'inbound' END AS direction, CASE WHEN u % 2 = 0 THEN '{MAC}' ELSE '{frames.PEER}' END AS source_mac,
          CASE WHEN u % 2 = 0 THEN '{frames.PEER}' ELSE '{MAC}' END AS destination_mac, CASE WHEN k IN (3, 4) THEN '34525' WHEN k = 5 THEN '2054' ELSE '2048' END AS ethertype,
          CASE WHEN k IN (3, 4) THEN '2001:db8::' || CASE WHEN u > 0 THEN printf('%x', u) ELSE '' END WHEN k < 6 THEN '10.0.' || (u // 256) || '.' || (u % 256) END AS source_address,
          CASE WHEN k IN (3, 4) THEN 'fe80::1:0:0:' || printf('%x', u) WHEN k = 5 THEN '10.0.0.1' WHEN k = 1 THEN '192.168.1.' || (u % 250) WHEN k < 6 THEN '192.168.0.1' END AS destination_address,
          CASE WHEN k IN (0, 3) THEN 'tcp' WHEN k IN (1, 4) THEN 'udp' ELSE 'other' END AS protocol FROM e),
        d AS (UNPIVOT p ON direction, source_mac, destination_mac, ethertype, source_address, destination_address, protocol INTO NAME dimension VALUE key),
        z AS (SELECT DISTINCT trace_id, dimension, key FROM p, (VALUES ('direction', 'outbound'), ('direction', 'inbound'), ('protocol', 'tcp'), ('protocol', 'udp'), ('protocol', 'other')) AS v(dimension, key))
        SELECT trace_id, dimension, key, CAST(sum(n) AS BIGINT) AS "count" FROM (SELECT trace_id, dimension, key, 1 AS n FROM d UNION ALL SELECT trace_id, dimension, key, 0 FROM z) GROUP BY ALL""",
    "capture_files": f"WITH {TRACE}, q AS (SELECT *, (ts_us / 1e6) * 1e6 AS x FROM trace) SELECT trace_id, seq, CAST(floor({SNAP.format(q='x')}) AS BIGINT) AS ts_us, direction, frame_length FROM q",
    "pcapng_scan": f"WITH {TRACE}, q AS (SELECT *, (ts_us / 1e6) * 1e6 AS x FROM trace) SELECT trace_id, seq, CAST(floor({SNAP.format(q='x')}) AS BIGINT) AS ts_us, direction, frame_length FROM q",
}

# Generation: no SQL, random streams


def _limits(events: int) -> models.Limits:
    """Limits that leave room for a trace of several times the reference's events."""
    return models.Limits(max_packets=max(20_000, 8 * events), max_output_bytes=max(40_000_000, 8 * 1514 * events), max_wall_seconds=max(30.0, events / 2_000))


def _generate(spark: SparkSession, sf_dir: str, family: str, genes: tuple) -> DataFrame:
    """Traces of one model under eight seeds, over the window of the whole reference that it is fitted on."""
    reference, _, w = pair(spark, sf_dir)
    n = reference.count()
    if family == "markov_renewal":
        # its payload is the reference's own intervals and lengths, so it is fitted where it generates
        made = models.generate_fitted(models.stored(reference), family, genes, [(f"{family}-{i}", i + 17) for i in range(8)], w, _limits(n))
    else:
        entries = fitting.mark_distribution(reference).first()["marks"]
        marks = models.Marks(tuple((m["direction"], m["frame_length"], m["count"]) for m in entries))
        base = (n - 1) / w
        model = models.Poisson(base, base * genes[0], marks) if family == "poisson_empirical" else models.Mmpp(*genes, marks)
        requests = spark.range(8).select(F.concat(F.lit(f"{family}-"), "id").alias("comparison"), F.lit("m").alias("model"), (F.col("id") + 17).alias("seed"))
        made = models.generate(requests, {"m": model}, w, _limits(n))
    return made.groupBy("comparison").agg(F.count("*").alias("events"), F.sum("frame_length").alias("bytes"), F.max("ts").alias("last_ts"))


def poisson_generate(spark, sf_dir):
    return _generate(spark, sf_dir, "poisson_empirical", (1.0,))


def mmpp_generate(spark, sf_dir):
    return _generate(spark, sf_dir, "mmpp", (0.0002, 0.0004, 0.001, 0.01))


def markov_generate(spark, sf_dir):
    return _generate(spark, sf_dir, "markov_renewal", (1 / 3, 2 / 3, 0.5, 4, 1.0))


def genetic_search(spark, sf_dir):
    """A small search over all families on the whole reference, one job per generation."""
    from ..operators.similarity import Settings
    from .genetic import Engine, Operators, Search

    reference, _, w = pair(spark, sf_dir)
    t = models.stored(reference)
    base = (len(t) - 1) / w
    bounds = {"poisson_empirical": {"c_lambda": (0.5, 1.5)}, "markov_renewal": {"q1": (0.15, 0.45), "q2": (0.55, 0.9), "alpha": (0.05, 1.5), "r": (1, 4), "c_t": (0.5, 1.5)}, "mmpp": {"q01": (base / 50, base / 5), "q10": (base / 50, base / 5), "lambda0": (base / 4, base), "lambda1": (base, base * 4)}}
    search = Search(bounds, dict.fromkeys(bounds, Operators(0.5, 0.3, 0.1)), 9, 3, 2, 2, (17, 19), 73, 97, limits=_limits(len(t)))
    engine = Engine(search, t, w, Settings(lags=(1, 4), lag_weights=(0.5, 0.5), widths=(w / 64, w / 8), scale_weights=(0.5, 0.5)))
    return spark.createDataFrame([tuple(r[c] for c in artifacts.HISTORY_COLUMNS) for r in engine.run(spark).history], artifacts.HISTORY)


QUERIES = {
    f.__name__: f
    for f in (
        mark_counts, mark_distribution, type7_thresholds, markov_states, transition_counts, transition_rows, stationary_law, timing_tiers, tier_usage, iat_samples, iat_payloads, mark_payloads, sampled_iats, poisson_rate, flow_check, short_transitions,
        candidate_rank, global_elites, family_champions, retained_population, generation_history, stagnation, history_faults, history_progress, duplicate_candidates, candidate_trials, gene_coordinates, regime_probabilities, family_quotas,
        sample_record, descriptive_stats, direction_values, natural_variation, controlled_reweighting, score_means, score_delta, training_selection, workload_summary, invalid_report, invalid_payloads, bootstrap_ci, lag_one_covariance,
        dimension_counts, frame_headers, lineage_mismatch, content_identity, transfer_headers, url_validation, pcapng_scan, capture_files, capture_inspection, poisson_generate, mmpp_generate, markov_generate, genetic_search,
    )
}
SQL = FIT_SQL | SEARCH_SQL | STUDY_SQL | SOURCE_SQL
