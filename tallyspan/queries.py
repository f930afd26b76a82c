"""Registered queries of the library's own operators over the fixture views, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspan.functions.literals import spelling
from tallyspan.operators import chain as C
from tallyspan.operators import checks, intervals, ledger, selection
from tallyspan.operators import mixture as M
from tallyspan.plans import fit as P
from tallyspan.plans.scratch import store
from tallyspan.sources import fixtures as X

PURITY, CP = X.PURITY, 0.4
GRID = [round(k / 10, 1) for k in range(1, 10)]
CENTERS, WEIGHTS = [0.8, 0.5, 0.2], [0.2, 0.5, 0.3]
BINS, TAKE = 10, 1000

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None, base: str = "", recursive: bool = False):
    """Registers a function under its name, with SQL that may use the views snv, cna, led and ret."""

    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = f"WITH {'RECURSIVE ' if recursive else ''}{X.SQL}{', ' + base if base else ''} {sql}"
        return f

    return keep


def _ledger(spark, sf_dir):
    return ledger.ledger(X.points(spark, sf_dir), X.segments(spark, sf_dir))


def _or_none(name):
    """-1 for null, so that tables of whole numbers compare as such."""
    return F.coalesce(F.col(name), F.lit(-1).cast("long")).alias(name)


def _retained(spark, sf_dir):
    return ledger.retained(_ledger(spark, sf_dir))


# SQL of the likelihood: one row per observation and multiplicity, m
_POST = f"""
obs AS (SELECT *, {2 * (1 - PURITY)!r} + {PURITY!r} * total_cn AS den, lgamma(depth + 1) - lgamma(alt_count + 1) - lgamma(depth - alt_count + 1) - ln(major_cn) AS const FROM ret)"""


def _kernel_sql(cp: str, source: str = "obs", keys: str = "original_row") -> str:
    p = f"least(1.0, {cp} * m / den)"
    return f"""
ker AS (
  SELECT {keys}, m, const + CASE WHEN alt_count = 0 THEN 0 WHEN {p} <= 0 THEN '-inf'::DOUBLE ELSE alt_count * ln(greatest({p}, 1e-300)) END
         + CASE WHEN depth = alt_count THEN 0 WHEN {p} >= 1 THEN '-inf'::DOUBLE ELSE (depth - alt_count) * ln(greatest(1 - {p}, 1e-300)) END AS v
  FROM (SELECT *, unnest(range(1, major_cn + 1)) AS m FROM {source})),
top AS (SELECT {keys}, max(v) AS t FROM ker GROUP BY ALL),
ll AS (SELECT {keys}, t + ln(sum(exp(v - t))) AS loglik FROM ker JOIN top USING ({keys}) WHERE t > '-inf'::DOUBLE GROUP BY {keys}, t)"""


@query("SELECT reason, count(*) AS n, sum(alt_count)::BIGINT AS sum_alt, coalesce(sum(total_cn), 0)::BIGINT AS sum_total_cn FROM led GROUP BY reason")
def ledger_reason_counts(spark, sf_dir):
    return ledger.reason_counts(_ledger(spark, sf_dir))


@query("SELECT original_row, coalesce(segment_id, -1) AS segment_id FROM led")
def interval_join_bucketed(spark, sf_dir):
    return intervals.joined(X.points(spark, sf_dir), X.segments(spark, sf_dir)).select("original_row", _or_none("segment_id"))


@query("SELECT original_row, coalesce(segment_id, -1) AS segment_id FROM led")
def interval_join_ordered(spark, sf_dir):
    return intervals.joined_in_order(X.points(spark, sf_dir), X.segments(spark, sf_dir)).select("original_row", _or_none("segment_id"))


@query("SELECT segment_id, before FROM (SELECT *, max(e_pos) OVER (PARTITION BY c_chrom ORDER BY s_pos, e_pos, segment_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM wide) WHERE s_pos <= before",
       "wide AS (SELECT segment_id, c_chrom, s_pos, e_pos + CASE WHEN segment_id % 7 = 0 THEN 700 ELSE 0 END AS e_pos FROM cna)")
def overlap_violations(spark, sf_dir):
    wide = X.segments(spark, sf_dir).withColumn("e_pos", F.col("e_pos") + F.when(F.col("segment_id") % 7 == 0, 700).otherwise(0))
    return intervals.overlaps(wide).select("segment_id", "before")


@query("SELECT original_row, mutation_id, chrom, pos, alt_count, ref_count, coalesce(segment_id, -1) AS segment_id, reason, CASE WHEN reason = 'retained' THEN 'retained' ELSE 'excluded' END AS status FROM led")
def ledger_full(spark, sf_dir):
    return _ledger(spark, sf_dir).select("original_row", "mutation_id", "chrom", "pos", "alt_count", "ref_count", _or_none("segment_id"), "reason", "status")


@query("SELECT original_row, mutation_id, chrom, pos, alt_count, ref_count, depth, major_cn, minor_cn, total_cn, segment_id AS matched_segment_id FROM ret")
def retained_full(spark, sf_dir):
    return _retained(spark, sf_dir)


@query("""SELECT pos, CASE WHEN length(sci) < length(f) THEN sci ELSE f END AS position_text FROM (
  SELECT pos, f, d[1:1] || CASE WHEN length(d) > 1 THEN '.' || d[2:] ELSE '' END || 'e+' || lpad((length(f) - 1)::VARCHAR, 2, '0') AS sci
  FROM (SELECT pos * 100 AS pos, (pos * 100)::VARCHAR AS f, rtrim((pos * 100)::VARCHAR, '0') AS d FROM snv))""")
def coordinate_spelling(spark, sf_dir):
    return X.points(spark, sf_dir).select((F.col("pos") * 100).alias("pos")).withColumn("position_text", spelling(F.col("pos")))


@query("""SELECT count(*) AS n_rows, count(*) FILTER (reason = 'retained') AS n_retained, count(*) FILTER (reason <> 'retained') AS n_excluded, count(segment_id) AS n_covered,
  max(major_cn) FILTER (reason = 'retained')::BIGINT AS max_major_cn, (sum(major_cn) FILTER (reason = 'retained'))::BIGINT AS sum_major_cn FROM led""")
def validation_summary(spark, sf_dir):
    return ledger.summary(_ledger(spark, sf_dir))


@query("SELECT chrom, locus, count(*) AS n FROM (SELECT chrom, pos // 1000 AS locus FROM snv) GROUP BY ALL HAVING count(*) > 1")
def duplicate_loci(spark, sf_dir):
    return checks.repeated(X.points(spark, sf_dir).select("chrom", F.expr("pos div 1000").alias("locus")), "chrom", "locus")


@query("SELECT alt_count, depth, major_cn, total_cn, count(*) AS freq FROM ret GROUP BY ALL")
def observation_frequency(spark, sf_dir):
    return M.observations(_retained(spark, sf_dir))


@query("SELECT original_row, round(loglik, 4) AS loglik FROM ll", _POST + "," + _kernel_sql(str(CP)))
def row_loglik(spark, sf_dir):
    return M.row_loglik(_retained(spark, sf_dir), PURITY, CP).select("original_row", F.round("loglik", 4).alias("loglik"))


_GRID_OBS = f"{_POST}, grid AS (SELECT unnest({GRID}::DOUBLE[]) AS cp), og AS (SELECT obs.*, cp FROM obs, grid)," + _kernel_sql("cp", "og", "original_row, cp")


@query("SELECT cp, round(sum(loglik), 2) AS loglik FROM ll GROUP BY cp", _GRID_OBS)
def grid_loglik(spark, sf_dir):
    return M.grid_loglik(M.observations(_retained(spark, sf_dir)), PURITY, GRID).select("cp", F.round("loglik", 2).alias("loglik"))


@query("SELECT chrom, arg_max(cp, (loglik, -cp)) AS cp FROM (SELECT chrom, cp, sum(loglik) AS loglik FROM ll JOIN ret USING (original_row) GROUP BY chrom, cp) GROUP BY chrom", _GRID_OBS)
def best_grid_center(spark, sf_dir):
    obs = _retained(spark, sf_dir).groupBy("chrom", *M.KEY).agg(F.count("*").alias("freq"))
    return M.best_on_grid(M.grid_loglik(obs, PURITY, GRID, ("chrom",)), ("chrom",)).select("chrom", "cp")


@query("SELECT cp FROM (SELECT cp, s, lag(s) OVER (ORDER BY cp) AS a, lead(s) OVER (ORDER BY cp) AS b FROM (SELECT cp, sum(loglik) AS s FROM ll GROUP BY cp)) WHERE (a IS NULL OR s > a) AND (b IS NULL OR s >= b)", _GRID_OBS)
def local_maxima_grid(spark, sf_dir):
    return M.local_maxima(M.grid_loglik(M.observations(_retained(spark, sf_dir)), PURITY, GRID)).select("cp")


@query("""SELECT original_row, arg_max(m, (round(p, 9), -m))::BIGINT AS multiplicity, round(sum(m * p), 4) AS expected_multiplicity, round(max(p), 4) AS multiplicity_probability
  FROM (SELECT original_row, m, exp(v - loglik) AS p FROM ker JOIN ll USING (original_row)) GROUP BY original_row""", _POST + "," + _kernel_sql(str(CP)))
def multiplicity_calls(spark, sf_dir):
    c = M.calls(_retained(spark, sf_dir), PURITY, F.lit(CP))
    return c.select("original_row", "multiplicity", F.round("expected_multiplicity", 4).alias("expected_multiplicity"), F.round("multiplicity_probability", 4).alias("multiplicity_probability"))


_MIX = f"""{_POST}, comp AS (SELECT unnest(range(0, {len(CENTERS)})) AS k, unnest({CENTERS}::DOUBLE[]) AS c, unnest({WEIGHTS}::DOUBLE[]) AS w),
og AS (SELECT obs.*, k, c FROM obs, comp),""" + _kernel_sql("c", "og", "original_row, k") + f""",
term AS (SELECT original_row, k, ln(w) + loglik AS t FROM ll JOIN comp USING (k)),
mix AS (SELECT original_row, m + ln(sum(exp(t - m))) AS mix FROM term JOIN (SELECT original_row, max(t) AS m FROM term GROUP BY 1) USING (original_row) GROUP BY original_row, m),
mem AS (SELECT original_row, k, exp(t - mix) AS share FROM term JOIN mix USING (original_row)),
best AS (SELECT original_row, arg_max(k, (round(share, 12), -k))::BIGINT AS best FROM mem GROUP BY 1),
lab AS (SELECT original_row, CASE WHEN alt_count * 3 >= depth * 2 THEN 0 WHEN alt_count * 3 >= depth THEN 1 ELSE 2 END AS label FROM ret)"""


def _members(spark, sf_dir):
    obs = M.observations(_retained(spark, sf_dir))
    label = F.when(F.col("alt_count") * 3 >= F.col("depth") * 2, 0).when(F.col("alt_count") * 3 >= F.col("depth"), 1).otherwise(2)
    return M.memberships(obs, PURITY, CENTERS, WEIGHTS).withColumn("label", label)


@query("SELECT round(sum(mix), 2) AS loglik, count(*) AS n FROM mix", _MIX)
def mixture_loglik(spark, sf_dir):
    return M.mixture_loglik(M.observations(_retained(spark, sf_dir)), PURITY, CENTERS, WEIGHTS).select(F.round("loglik", 2).alias("loglik"), "n")


@query("SELECT alt_count, depth, major_cn, total_cn, round(max(share) FILTER (k = 0), 5) AS share0, round(max(share) FILTER (k = 1), 5) AS share1, round(max(share) FILTER (k = 2), 5) AS share2 FROM mem JOIN ret USING (original_row) GROUP BY ALL", _MIX)
def mixture_membership(spark, sf_dir):
    return _members(spark, sf_dir).select(*M.KEY, *[F.round(F.col("member")[k], 5).alias(f"share{k}") for k in range(len(CENTERS))])


@query(f"""SELECT k::BIGINT AS cluster_index, c AS cellular_prevalence, round(c / {PURITY}, 6) AS cancer_cell_fraction, w AS mixture_weight, round(sum(share), 3) AS expected_n,
  count(*) FILTER (best = k) AS map_n, round(w * count(*), 3) AS fitted_n FROM mem JOIN best USING (original_row) JOIN comp USING (k) GROUP BY k, c, w""", _MIX)
def posterior_clusters(spark, sf_dir):
    c = M.posterior_clusters(_members(spark, sf_dir), CENTERS, WEIGHTS, PURITY)
    return c.select("cluster_index", "cellular_prevalence", F.round("cancer_cell_fraction", 6).alias("cancer_cell_fraction"), "mixture_weight", F.round("expected_n", 3).alias("expected_n"), "map_n", F.round("fitted_n", 3).alias("fitted_n"))


@query("""SELECT a.k::BIGINT AS chain_cluster_index, b.k::BIGINT AS posterior_cluster_index, round(coalesce(s, 0.0), 3) AS expected_n FROM comp a, comp b
  LEFT JOIN (SELECT label, k, sum(share) AS s FROM mem JOIN lab USING (original_row) GROUP BY ALL) f ON f.label = a.k AND f.k = b.k""", _MIX)
def posterior_flow(spark, sf_dir):
    return M.flow(_members(spark, sf_dir), F.col("label"), len(CENTERS)).withColumn("expected_n", F.round("expected_n", 3))


@query(f"""SELECT count(*) AS n, round(avg(h), 6) AS mean_entropy, round(avg(top), 6) AS mean_max_share, round(avg((best <> label)::INT), 6) AS map_disagreement, round(avg(ccf), 6) AS mean_ccf
  FROM (SELECT original_row, -sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END) AS h, max(share) AS top, sum(share * c / {PURITY}) AS ccf FROM mem JOIN comp USING (k) GROUP BY 1)
  JOIN best USING (original_row) JOIN lab USING (original_row)""", _MIX)
def posterior_summary(spark, sf_dir):
    s = M.summary(_members(spark, sf_dir), F.col("label"), CENTERS, PURITY)
    return s.select("n", *[F.round(c, 6).alias(c) for c in s.columns if c != "n"])


@query(f"""SELECT k::BIGINT AS cluster_index, round(coalesce(sum(e) OVER (ORDER BY c ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0) / sum(e) OVER (), 6) AS mass_below
  FROM (SELECT k, c, sum(share) AS e FROM mem JOIN comp USING (k) GROUP BY ALL)""", _MIX)
def ccf_cumulative_mass(spark, sf_dir):
    return M.cumulative_mass(M.posterior_clusters(_members(spark, sf_dir), CENTERS, WEIGHTS, PURITY)).select("cluster_index", F.round("mass_below", 6).alias("mass_below"))


@query("SELECT center, round(sum(weight), 9) AS weight FROM (SELECT (o_custkey % 12)::DOUBLE / 12 AS center, (o_orderkey % 5)::DOUBLE / 1000 AS weight FROM orders) WHERE weight > 0 GROUP BY center")
def component_reduction(spark, sf_dir):
    parts = spark.read.parquet(f"{sf_dir}/orders.parquet").select(((F.col("o_custkey") % 12).cast("double") / 12).alias("center"), ((F.col("o_orderkey") % 5).cast("double") / 1000).alias("weight"))
    return M.reduced(parts).withColumn("weight", F.round("weight", 9))


_CHAIN = """
text AS (SELECT *, pos::VARCHAR AS f, rtrim(pos::VARCHAR, '0') AS d FROM ret),
spelt AS (SELECT *, d[1:1] || CASE WHEN length(d) > 1 THEN '.' || d[2:] ELSE '' END || 'e+' || lpad((length(f) - 1)::VARCHAR, 2, '0') AS sci FROM text),
chain AS (SELECT original_row, alt_count, depth, alt_count::DOUBLE / depth AS pilot, row_number() OVER (ORDER BY alt_count::DOUBLE / depth, chrom::VARCHAR, CASE WHEN length(sci) < length(f) THEN sci ELSE f END) - 1 AS rank FROM spelt),
steps AS (SELECT rank, lead(pilot) OVER (ORDER BY rank) - pilot AS step FROM chain),
jump AS (SELECT rank, step, row_number() OVER (ORDER BY abs(step) DESC, rank) AS place FROM steps WHERE step <> 0 QUALIFY place <= 5),
blocks AS (SELECT c.*, (SELECT count(*) FROM jump j WHERE j.rank < c.rank) AS block FROM chain c)"""


def _chain(spark, sf_dir):
    return C.chain(_retained(spark, sf_dir), F.col("alt_count").cast("double") / F.col("depth"))


@query("SELECT original_row, rank FROM chain", _CHAIN)
def chain_rank(spark, sf_dir):
    return _chain(spark, sf_dir).select("original_row", "rank")


@query("SELECT rank, round(step, 9) AS step, place FROM jump", _CHAIN)
def chain_jumps_topk(spark, sf_dir):
    return C.jumps(_chain(spark, sf_dir), "pilot", 6).select("rank", F.round("step", 9).alias("step"), "place")


def _blocks(spark, sf_dir):
    ranks = store(_chain(spark, sf_dir).select("original_row", "rank", "pilot", "alt_count", "depth"), "chain")
    cuts = [r["rank"] + 1 for r in C.jumps(ranks, "pilot", 6).collect()]  # five
    return C.labelled(ranks, cuts)


@query("SELECT original_row, block FROM blocks", _CHAIN)
def chain_blocks(spark, sf_dir):
    return _blocks(spark, sf_dir).select("original_row", "block")


@query("SELECT block, count(*) AS n, min(rank) AS first_rank, round(max(pilot) - min(pilot), 9) AS spread, round(avg(pilot), 9) AS mean FROM blocks GROUP BY block", _CHAIN)
def block_stats(spark, sf_dir):
    return C.block_stats(_blocks(spark, sf_dir), "pilot").select("block", "n", "first_rank", F.round("spread", 9).alias("spread"), F.round("mean", 9).alias("mean"))


@query("SELECT round(max(s), 3) AS score FROM (SELECT sum(v0) OVER w + coalesce(sum(v1) OVER r, 0) AS s FROM z WINDOW w AS (ORDER BY rank), r AS (ORDER BY rank ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) UNION ALL SELECT sum(v1) FROM z)",
       _CHAIN + ", z AS (SELECT rank, -depth * (pilot - 0.1) * (pilot - 0.1) AS v0, -depth * (pilot - 0.3) * (pilot - 0.3) AS v1 FROM chain)")
def chain_dp_score(spark, sf_dir):
    ranks = store(_chain(spark, sf_dir).select("rank", "pilot", "depth"), "chain")
    square = lambda c: -F.col("depth") * (F.col("pilot") - c) * (F.col("pilot") - c)
    total, _ = C.best_blocks(ranks, [square(0.1), square(0.3)])
    return spark.createDataFrame([(total,)], "score double").select(F.round("score", 3).alias("score"))


_QUOTA = f"""
bins AS (SELECT greatest(ceil(alt_count::DOUBLE / depth * {BINS})::BIGINT, 1) AS bin, count(*) AS n FROM ret GROUP BY 1),
base AS (SELECT bin, n, (n * {TAKE})::DOUBLE / (sum(n) OVER ())::DOUBLE AS quota FROM bins),
quota AS (SELECT bin, n, least(n, floor(quota)::BIGINT + CASE WHEN row_number() OVER (ORDER BY quota - floor(quota) DESC, bin) <= {TAKE} - sum(floor(quota)) OVER () THEN 1 ELSE 0 END) AS take FROM base)"""


@query("SELECT bin, n, take FROM quota", _QUOTA)
def vaf_strata_quota(spark, sf_dir):
    return selection.quotas(_retained(spark, sf_dir), F.col("alt_count") / F.col("depth"), BINS, TAKE)


@query("""SELECT original_row, bin FROM (SELECT original_row, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('11:' || original_row), original_row) AS place
  FROM (SELECT original_row, greatest(ceil(alt_count / depth * 10), 1)::BIGINT AS bin FROM ret)) JOIN quota USING (bin) WHERE place <= take""", _QUOTA)
def vaf_strata_sample(spark, sf_dir):
    return selection.sampled(_retained(spark, sf_dir), F.col("alt_count") / F.col("depth"), BINS, TAKE, 11).select("original_row", "bin")


@query("""SELECT block, (high + after) // 2 + 1 AS cut FROM (SELECT block, max(rank) AS high, lead(min(rank)) OVER (ORDER BY block) AS after FROM blocks
  JOIN (SELECT original_row, bin, row_number() OVER (PARTITION BY bin ORDER BY md5('11:' || original_row), original_row) AS place FROM (SELECT original_row, greatest(ceil(alt_count / depth * 10), 1)::BIGINT AS bin FROM ret)) USING (original_row)
  JOIN quota USING (bin) WHERE place <= take GROUP BY block) WHERE after IS NOT NULL""", _CHAIN + "," + _QUOTA)
def subsample_boundaries(spark, sf_dir):
    drawn = selection.sampled(_retained(spark, sf_dir), F.col("alt_count") / F.col("depth"), BINS, TAKE, 11).select("original_row")
    return selection.boundaries(_blocks(spark, sf_dir).join(drawn, "original_row"))


_PARENTS = """
parents AS (SELECT c_nationkey::BIGINT AS requested_k, c_mktsegment AS replicate, list_sort(list_distinct(list(c_custkey % 9 + 1))) AS cuts FROM customer GROUP BY ALL)"""


def _parents(spark, sf_dir):
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    return c.groupBy(F.col("c_nationkey").cast("long").alias("requested_k"), F.col("c_mktsegment").alias("replicate")).agg(F.array_sort(F.collect_set(F.col("c_custkey") % 9 + 1)).alias("cuts"))


_BANK = _PARENTS + """,
masks AS (SELECT *, unnest(range(0, (1 << len(cuts))::BIGINT)) AS mask FROM parents),
picked AS (SELECT *, list_filter(cuts, lambda c, i: (mask >> (i - 1)) % 2 = 1) AS sub FROM masks),
ways AS (SELECT sub, requested_k AS budget, 'native' AS kind, requested_k AS k, replicate AS r FROM picked WHERE len(sub) = len(cuts)
  UNION ALL SELECT sub, len(sub) + 1, CASE WHEN len(sub) = len(cuts) THEN 'capacity_reuse' ELSE 'adjacent_coarsening' END, requested_k, replicate FROM picked),
bank AS (SELECT budget, array_to_string(sub, ',') AS cuts, min({'d': kind <> 'native', 'k': k, 'r': r, 'kind': kind}) AS o FROM ways WHERE budget IN (2, 3, 4) GROUP BY budget, array_to_string(sub, ','))"""


@query("SELECT budget, cuts, o.k AS parent_k, o.r AS parent_rep, o.kind AS kind FROM bank", _BANK)
def coarsening_bank(spark, sf_dir):
    return selection.coarsenings(_parents(spark, sf_dir), [2, 3, 4]).withColumn("cuts", F.array_join("cuts", ","))


_CAND = """
cand AS (SELECT o_orderkey AS candidate_id, o_custkey % 10 + 1 AS budget, (o_custkey % 10 + 1) // 2 + 1 AS q, (round(o_totalprice / 1000))::DOUBLE AS bic,
         CASE WHEN o_orderstatus = 'F' THEN 'native' ELSE 'derived' END AS kind, o_orderkey % 10 AS parent_k, o_orderkey % 3 AS parent_rep FROM orders),
won AS (SELECT budget, min({'bic': bic, 'q': q, 'd': kind <> 'native', 'k': parent_k, 'r': parent_rep, 'id': candidate_id}) AS w FROM cand GROUP BY budget)"""


def _candidates(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    budget = F.col("o_custkey") % 10 + 1
    kind = F.when(F.col("o_orderstatus") == "F", "native").otherwise("derived")
    return o.select(F.col("o_orderkey").alias("candidate_id"), budget.alias("budget"), F.expr("(o_custkey % 10 + 1) div 2 + 1").alias("q"), F.round(F.col("o_totalprice") / 1000).alias("bic"), kind.alias("kind"), (F.col("o_orderkey") % 10).alias("parent_k"), (F.col("o_orderkey") % 3).alias("parent_rep"))


@query("SELECT budget, w.id AS candidate_id, w.bic AS bic, w.q AS q FROM won", _CAND)
def candidate_winners(spark, sf_dir):
    return selection.winners(_candidates(spark, sf_dir))


@query("""SELECT candidate_id, budget, candidate_id IN (SELECT w.id FROM won) AS is_budget_winner, candidate_id = (SELECT min({'b': w.bic, 'q': w.q, 'g': budget, 'i': w.id}).i FROM won) AS is_winner FROM cand""", _CAND)
def candidate_flags(spark, sf_dir):
    c = _candidates(spark, sf_dir)
    return selection.flagged(c, selection.winners(c)).select("candidate_id", "budget", "is_budget_winner", "is_winner")


@query("""SELECT c.requested_k, count(*) AS within FROM parents c JOIN parents p ON len(list_filter(c.cuts, lambda x: NOT list_contains(p.cuts, x))) = 0 AND len(c.cuts) < len(p.cuts) GROUP BY ALL""", _PARENTS)
def containment_counts(spark, sf_dir):
    """Parents by how many others hold all their cuts: at most 25 x 5 rows on either side, by construction."""
    p = store(_parents(spark, sf_dir), "parents")
    big = F.broadcast(p.select(F.col("cuts").alias("big")))
    return p.join(big, selection.contained(F.col("cuts"), F.col("big")) & (F.size("cuts") < F.size("big"))).groupBy("requested_k").agg(F.count("*").alias("within"))


@query("SELECT c_custkey, true AS seen FROM customer SEMI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT c_custkey, false FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def candidate_semi_anti(spark, sf_dir):
    c, o = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey"), spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").alias("c_custkey"))
    return c.join(o, "c_custkey", "left_semi").withColumn("seen", F.lit(True)).unionByName(c.join(o, "c_custkey", "left_anti").withColumn("seen", F.lit(False)))


@query("SELECT count(*) FILTER (original_row % 101 = 0) AS only_left, count(*) FILTER (original_row % 101 = 0) AS only_right FROM led")
def join_replay_diff(spark, sf_dir):
    """Both joins compared row by row, after some rows of one were given another segment."""
    p, s = X.points(spark, sf_dir), X.segments(spark, sf_dir)
    cols = ("original_row", "segment_id", "major_cn", "total_cn")
    other = intervals.joined_in_order(p, s).select(*cols).withColumn("segment_id", F.when(F.col("original_row") % 101 == 0, -7).otherwise(F.col("segment_id")))
    return checks.differences(intervals.joined(p, s).select(*cols), other)


@query()
def pilot_cp(spark, sf_dir):
    """Distinct observations with the pooled pilot fraction."""
    return P.pilot(M.observations(_retained(spark, sf_dir)), PURITY).select(*M.KEY, "freq", F.round("pilot", 6).alias("pilot"))


def _published(spark, sf_dir):
    rows = store(_retained(spark, sf_dir), "retained")
    chain, found, _ = P.fits(rows, PURITY)
    return P.tables(rows, chain, P.best(found), PURITY)


@query()
def fit_clusters(spark, sf_dir):
    return _published(spark, sf_dir)["clusters"]


@query("SELECT unnest(['size', 'range', 'fraction', 'multiplicity', 'expected']) AS rule, 0::BIGINT AS n")
def cluster_table_checks(spark, sf_dir):
    """Broken rules of freshly fitted tables: all 0."""
    t = _published(spark, sf_dir)
    return checks.cluster_rules(store(t["clusters"], "clusters"), store(t["mutations"], "mutations"), PURITY)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
