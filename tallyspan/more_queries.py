"""Registered queries of the record and replay operators, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyspan import queries as Q
from tallyspan.operators import checks
from tallyspan.operators import mixture as M
from tallyspan.operators import records as R
from tallyspan.operators import replay as V
from tallyspan.operators import selection
from tallyspan.plans.scratch import store

CP, PURITY, CENTERS, WEIGHTS = Q.CP, Q.PURITY, Q.CENTERS, Q.WEIGHTS
_KER = Q._POST + "," + Q._kernel_sql(str(CP))
_rounded = lambda df, digits, *names: df.withColumns({n: F.round(n, digits) for n in names})


def _label():
    alt, depth = F.col("alt_count"), F.col("depth")
    return F.when(alt * 3 >= depth * 2, 0).when(alt * 3 >= depth, 1).otherwise(2)


@Q.query("SELECT k AS cluster_index, count(original_row) AS n FROM (SELECT unnest(range(0, 5)) AS k) LEFT JOIN lab ON label = k GROUP BY k", Q._MIX)
def cluster_sizes(spark, sf_dir):
    return V.sizes(Q._retained(spark, sf_dir), _label(), 5)


def _gradient_sql(cp: float, purity: float) -> str:
    return f"""
go AS (SELECT original_row, major_cn, total_cn, alt_count AS a, depth - alt_count AS r, {2 * (1 - purity)!r} + {purity!r} * total_cn AS den, lgamma(depth + 1) - lgamma(alt_count + 1) - lgamma(depth - alt_count + 1) - ln(major_cn) AS const FROM ret),
gs AS (SELECT *, m / den AS s, {cp!r} * (m / den) >= 1 AS one FROM (SELECT *, unnest(range(1, major_cn + 1)) AS m FROM go)),
gv AS (SELECT *, const + CASE WHEN a = 0 THEN 0 ELSE a * ln(least(1.0, {cp!r} * s)) END + CASE WHEN r = 0 THEN 0 WHEN one THEN '-inf'::DOUBLE ELSE r * ln(greatest(1 - {cp!r} * s, 1e-300)) END AS v FROM gs),
gt AS (SELECT original_row, max(v) AS t FROM gv GROUP BY 1),
gl AS (SELECT original_row, t + ln(sum(exp(v - t))) AS ll FROM gv JOIN gt USING (original_row) WHERE t > '-inf'::DOUBLE GROUP BY original_row, t),
grad AS (SELECT go.original_row, go.major_cn, go.total_cn, CASE WHEN any_value(ll) IS NULL THEN 0 ELSE sum(exp(v - ll) * (go.a / {cp!r} - CASE WHEN one THEN 0 ELSE go.r * s / greatest(1 - {cp!r} * s, 1e-300) END)) - CASE WHEN any_value(go.r) = 1 THEN exp(any_value(go.const) - any_value(ll)) * sum(CASE WHEN one THEN s ELSE 0 END) ELSE 0 END END AS g,
  CASE WHEN any_value(ll) IS NULL THEN 1 / ({purity!r} * {purity!r}) WHEN any_value(go.r) = 1 AND bool_or(one) THEN 'inf'::DOUBLE ELSE greatest(1e-8 / ({purity!r} * {purity!r}), sum(exp(v - ll) * (go.a / ({cp!r} * {cp!r}) + CASE WHEN one THEN 0 ELSE go.r * s * s / pow(greatest(1 - {cp!r} * s, 1e-300), 2) END))
    + CASE WHEN any_value(go.r) = 2 THEN 2 * exp(any_value(go.const) - any_value(ll)) * sum(CASE WHEN one THEN s * s ELSE 0 END) ELSE 0 END) END AS h
  FROM go JOIN gv USING (original_row) LEFT JOIN gl USING (original_row) GROUP BY go.original_row, go.major_cn, go.total_cn)"""


def _gradient_means(spark, sf_dir, cp, purity, size):
    rows = store(Q._retained(spark, sf_dir), "retained")
    each = V.gradients(rows, purity, cp).join(rows.select("original_row", "major_cn", "total_cn"), "original_row")
    finite = F.when(F.col("curvature") < float("inf"), F.col("curvature"))
    return each.groupBy("major_cn", "total_cn").agg(F.count("*").alias("n"), F.count_if(finite.isNull()).alias("n_infinite"), F.round(F.avg(size(F.col("gradient"))), 4).alias("gradient"), F.round(F.avg(size(finite)), 3).alias("curvature"))


@Q.query("SELECT major_cn, total_cn, count(*) AS n, count(*) FILTER (h = 'inf'::DOUBLE) AS n_infinite, round(avg(g), 4) AS gradient, round(avg(h) FILTER (h < 'inf'::DOUBLE), 3) AS curvature FROM grad GROUP BY major_cn, total_cn", _gradient_sql(CP, PURITY))
def row_gradient(spark, sf_dir):
    """Means by copy number of what V.gradients gives for each row."""
    return _gradient_means(spark, sf_dir, CP, PURITY, lambda c: c)


@Q.query("SELECT major_cn, total_cn, count(*) AS n, count(*) FILTER (h = 'inf'::DOUBLE) AS n_infinite, round(avg(sign(g) * ln(1 + abs(g))), 4) AS gradient, round(avg(ln(1 + abs(h))) FILTER (h < 'inf'::DOUBLE), 3) AS curvature FROM grad GROUP BY major_cn, total_cn", _gradient_sql(1.0, 1.0))
def row_gradient_limits(spark, sf_dir):
    """The same at a fraction and a purity of 1, where copies without a normal one have a chance of 1; sizes by their logarithms."""
    return _gradient_means(spark, sf_dir, 1.0, 1.0, lambda c: F.signum(c) * F.log1p(F.abs(c)))


@Q.query("SELECT count(*) AS n_rows, count(*) FILTER (original_row % 101 = 0 AND 0.002 > 2e-7 + 2e-9 * abs(loglik)) AS n_bad FROM ll", _KER)
def likelihood_replay(spark, sf_dir):
    """Both ways to the log likelihood, and on how many rows they differ: on those where one was changed."""
    rows = store(Q._retained(spark, sf_dir), "retained")
    told = M.row_loglik(rows, PURITY, CP).withColumn("loglik", F.col("loglik") + F.when(F.col("original_row") % 101 == 0, 0.002).otherwise(0.0))
    both = told.join(V.pmf_loglik(rows, PURITY, CP).withColumnRenamed("loglik", "again"), "original_row")
    return both.agg(F.count("*").alias("n_rows"), F.count_if(F.abs(F.col("loglik") - F.col("again")) > 2e-7 + 2e-9 * F.abs("again")).alias("n_bad"))


@Q.query("""SELECT accepted, count(*) AS n FROM (SELECT p.original_row, max(p) FILTER (m = 1 + original_row % major_cn) >= max(p) - 1e-9 AS accepted
  FROM (SELECT original_row, m, exp(v - loglik) AS p FROM ker JOIN ll USING (original_row)) p JOIN ret USING (original_row) GROUP BY 1) GROUP BY 1""", _KER)
def multiplicity_accepted(spark, sf_dir):
    rows = V.accepted(Q._retained(spark, sf_dir), PURITY, CP, F.col("original_row") % F.col("major_cn") + 1)
    return rows.groupBy("accepted").agg(F.count("*").alias("n"))


@Q.query(f"""SELECT n, round(loglik, 2) AS loglik, round(-2 * loglik + {2 * len(CENTERS) - 1} * ln(n), 2) AS bic, round(greatest(0, score - n), 3) AS weight_gap FROM
  (SELECT count(*) AS n, sum(mix) AS loglik FROM mix), (SELECT max(s) AS score FROM (SELECT k, sum(share / w) AS s FROM mem JOIN comp USING (k) GROUP BY k))""", Q._MIX)
def fit_arithmetic(spark, sf_dir):
    return _rounded(_rounded(V.fit_arithmetic(Q._members(spark, sf_dir), WEIGHTS), 2, "loglik", "bic"), 3, "weight_gap")


@Q.query(f"""SELECT original_row, label::BIGINT AS label, best AS map_index, round(max(share) FILTER (k = label), 5) AS label_share, round(max(share), 5) AS max_share,
  round(-sum(CASE WHEN share > 0 THEN share * ln(share) ELSE 0 END), 5) AS entropy, round(sum(share * c / {PURITY}), 5) AS expected_ccf, round(sum(share * e), 4) AS expected_multiplicity
  FROM mem JOIN comp USING (k) JOIN best USING (original_row) JOIN lab USING (original_row)
  JOIN (SELECT original_row, k, sum(m * exp(v - loglik)) AS e FROM ker JOIN ll USING (original_row, k) GROUP BY 1, 2) USING (original_row, k) GROUP BY ALL""", Q._MIX)  # fmt: skip
def posterior_mutations(spark, sf_dir):
    out = V.posterior_mutations(Q._retained(spark, sf_dir), _label(), CENTERS, WEIGHTS, PURITY)
    return _rounded(_rounded(out, 5, "label_share", "max_share", "entropy", "expected_ccf"), 4, "expected_multiplicity")


@Q.query("""SELECT any_value(t) AS n, round(sum(abs(e - coalesce(c, 0))) / 2 / any_value(t), 6) AS total_variation, round(abs(sum(e) - any_value(t)), 3) + 0.0::DOUBLE AS count_gap FROM
  (SELECT k, sum(share) AS e FROM mem GROUP BY k) LEFT JOIN (SELECT label AS k, count(*) AS c FROM lab GROUP BY 1) USING (k), (SELECT count(*) AS t FROM ret)""", Q._MIX)
def allocation_distance(spark, sf_dir):
    return _rounded(_rounded(V.allocation_distance(Q._members(spark, sf_dir), F.col("label"), len(CENTERS)), 6, "total_variation"), 3, "count_gap")


@Q.query("SELECT k::BIGINT AS component, round(sum(share), 3) AS size, round(sum(share * alt_count), 2) AS alt, round(sum(share * (depth - alt_count)), 2) AS rest FROM mem JOIN ret USING (original_row) GROUP BY k", Q._MIX)
def sufficient_statistics(spark, sf_dir):
    return _rounded(_rounded(V.sufficient(Q._members(spark, sf_dir), len(CENTERS)), 3, "size"), 2, "alt", "rest")


_PARTS = "parts AS (SELECT center, sum(weight) AS weight FROM (SELECT (o_custkey % 12)::DOUBLE / 12 AS center, (o_orderkey % 5)::DOUBLE / 1000 AS weight FROM orders) WHERE weight > 0 GROUP BY center)"


def _parts(spark, sf_dir):
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    return M.reduced(o.select(((F.col("o_custkey") % 12).cast("double") / 12).alias("center"), ((F.col("o_orderkey") % 5).cast("double") / 1000).alias("weight")))


@Q.query("""SELECT place, round((center * weight + c * w) / (weight + w), 6) AS center, round(weight + w, 6) AS weight FROM
  (SELECT row_number() OVER o AS place, center, weight, lead(center) OVER o AS c, lead(weight) OVER o AS w FROM parts WINDOW o AS (ORDER BY center DESC)) WHERE c IS NOT NULL""", _PARTS)
def adjacent_merges(spark, sf_dir):
    return _rounded(V.adjacent_merges(_parts(spark, sf_dir)), 6, "center", "weight")


@Q.query("SELECT c_custkey % 24 AS proposed, count(*) AS n, coalesce(any_value(i), -1)::BIGINT AS final_index FROM customer LEFT JOIN (SELECT s_nationkey::BIGINT AS k, min(s_suppkey)::BIGINT AS i FROM supplier GROUP BY 1) ON c_custkey % 24 = k GROUP BY 1")
def component_mapping(spark, sf_dir):
    proposed = spark.read.parquet(f"{sf_dir}/customer.parquet").groupBy((F.col("c_custkey") % 24).alias("proposed")).agg(F.count("*").alias("n"))
    final = spark.read.parquet(f"{sf_dir}/supplier.parquet").groupBy(F.col("s_nationkey").cast("long").alias("proposed")).agg(F.min("s_suppkey").alias("final_index"))
    return R.mapped(proposed, final, "proposed")


@Q.query("SELECT rank FROM chain, (SELECT count(*) AS n FROM chain) WHERE rank IN (SELECT k * (n - 1) // 99 FROM (SELECT unnest(range(0, 100)) AS k))", Q._CHAIN)
def even_ranks(spark, sf_dir):
    return V.even_ranks(store(Q._chain(spark, sf_dir).select("rank"), "chain"), 100).select("rank")


@Q.query("SELECT min(rank) AS first_rank, count(*) AS n FROM (SELECT rank, rank - row_number() OVER (ORDER BY rank) AS run FROM chain WHERE alt_count % 3 > 0) GROUP BY run", Q._CHAIN)
def finite_runs(spark, sf_dir):
    return V.runs(store(Q._chain(spark, sf_dir).select("rank", "alt_count"), "chain"), F.col("alt_count") % 3 > 0)


@Q.query("SELECT planted, count(*) AS n, min(r) = 0 AND max(r) = count(*) - 1 AND count(DISTINCT r) = count(*) AS valid FROM (SELECT planted, CASE WHEN planted = 'twice' AND rank = 7 THEN 8 ELSE rank END AS r FROM chain, (SELECT unnest(['no', 'twice', 'gap']) AS planted) WHERE planted <> 'gap' OR rank <> 9) GROUP BY planted", Q._CHAIN)
def order_check(spark, sf_dir):
    """The chain's order as it is, with a rank that occurs twice, and with one that lacks."""
    ranks = store(Q._chain(spark, sf_dir).select("rank"), "chain")
    wrong = {"no": ranks, "twice": ranks.withColumn("rank", F.when(F.col("rank") == 7, 8).otherwise(F.col("rank"))), "gap": ranks.where("rank <> 9")}
    out = [V.order_check(df).withColumn("planted", F.lit(name)) for name, df in wrong.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@Q.query("SELECT CASE WHEN x < 0 THEN 'under' ELSE 'over' END AS fault, count(*) AS n FROM (SELECT (o_custkey % 100 - 3) / 90.0 AS x FROM orders) WHERE x < 0 OR x > 0.9 GROUP BY 1")
def fraction_faults(spark, sf_dir):
    return V.domain_faults(spark.read.parquet(f"{sf_dir}/orders.parquet"), (F.col("o_custkey") % 100 - 3) / 90.0, PURITY)


@Q.query("SELECT budget, min(candidate_id) AS first_id, arg_min(bic, candidate_id) AS bic, count(*) AS n FROM cand WHERE kind = 'derived' AND parent_k IN (1, 2, 3) GROUP BY budget", Q._CAND)
def candidate_firsts(spark, sf_dir):
    some = R.where_all(Q._candidates(spark, sf_dir), ("kind", "parent_k", "budget"), kind="derived", parent_k=[1, 2, 3])
    return R.firsts(some, "budget", "bic")


@Q.query("SELECT budget, w.i AS candidate_id, w.b AS bic FROM (SELECT budget, min({'b': bic, 'q': q, 'i': candidate_id}) AS w FROM cand WHERE parent_rep > 0 AND bic > 50 GROUP BY budget)", Q._CAND)
def eligible_winners(spark, sf_dir):
    return R.best_eligible(Q._candidates(spark, sf_dir), (F.col("parent_rep") > 0) & (F.col("bic") > 50), "budget")


@Q.query("""SELECT candidate_id, coalesce(a.i, -1) AS ancestor_id FROM (SELECT candidate_id, kind, min(CASE WHEN kind = 'native' THEN {'b': bic, 'i': candidate_id} END)
  OVER (PARTITION BY budget, parent_k, parent_rep ORDER BY candidate_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS a FROM cand) WHERE kind <> 'native'""", Q._CAND)
def earlier_ancestors(spark, sf_dir):
    return R.earlier_ancestor(Q._candidates(spark, sf_dir), ("budget", "parent_k", "parent_rep"))


@Q.query("""SELECT CASE WHEN p IS NULL THEN 'root' WHEN b.bic IS NULL THEN 'missing' WHEN a.bic <= b.bic THEN 'falling' ELSE 'rising' END AS state, count(*) AS n
  FROM (SELECT *, CASE WHEN candidate_id % 50 > 0 THEN candidate_id - 1 - candidate_id % 7 END AS p FROM cand) a LEFT JOIN cand b ON a.p = b.candidate_id GROUP BY 1""", Q._CAND)
def visit_links(spark, sf_dir):
    i = F.col("candidate_id")
    return R.link_states(Q._candidates(spark, sf_dir), F.when(i % 50 > 0, i - 1 - i % 7))


_WALK = Q._CAND + """,
link AS (SELECT candidate_id AS id, bic, CASE WHEN candidate_id % 400 = 7 THEN candidate_id + 1 WHEN candidate_id % 50 = 49 THEN -candidate_id WHEN candidate_id % 50 > 0 THEN candidate_id - 1 - candidate_id % 2 * (candidate_id % 7) END AS p FROM cand),
walk AS (SELECT id, id AS root, 0::BIGINT AS depth, 0::BIGINT AS falls, NULL::BIGINT AS near, bic, p IS NOT NULL AS missing FROM link WHERE p IS NULL OR p NOT IN (SELECT id FROM link)
  UNION ALL SELECT l.id, root, depth + 1, falls + (l.bic < w.bic)::BIGINT, CASE WHEN l.bic < w.bic THEN 1 ELSE near + 1 END, l.bic, missing FROM link l JOIN walk w ON l.p = w.id)"""


@Q.query("SELECT l.id AS candidate_id, CASE WHEN root IS NULL THEN 'cycle' WHEN missing THEN 'missing' ELSE 'path' END AS state, coalesce(root, -1) AS root, coalesce(depth, -1) AS depth, coalesce(falls, -1) AS falls, coalesce(near, -1) AS nearest_fall FROM link l LEFT JOIN walk USING (id)", _WALK, recursive=True)
def refinement_paths(spark, sf_dir):
    """Root, depth and falls of every record along its predecessors, some of which do not exist or run in a circle."""
    i = F.col("candidate_id")
    before = F.when(i % 400 == 7, i + 1).when(i % 50 == 49, -i).when(i % 50 > 0, i - 1 - i % 2 * (i % 7))
    out = R.paths(Q._candidates(spark, sf_dir), before, F.col("bic"))
    return out.select("candidate_id", "state", *[F.coalesce(c, F.lit(-1).cast("long")).alias(c) for c in ("root", "depth", "falls", "nearest_fall")])


@Q.query("SELECT count(*) FILTER (candidate_id % 97 = 0) AS unmatched, count(*) FILTER (parent_k = 3 AND candidate_id % 97 > 0) AS different FROM cand", Q._CAND)
def finalists_reconciled(spark, sf_dir):
    """Records against a copy that lacks some, and in which those of one parent were changed."""
    c = Q._candidates(spark, sf_dir)
    changed = c.withColumn("bic", F.when(F.col("parent_k") == 3, F.col("bic") + 1).otherwise(F.col("bic")))
    return R.disagreements(c, changed.where(F.col("candidate_id") % 97 > 0), ("candidate_id",), ("budget", "bic", "kind"))


_STARTS = """
st AS (SELECT o_orderkey AS candidate_id, CASE WHEN o_orderstatus = 'F' THEN 'native' ELSE 'adjacent_coarsening' END AS kind, o_custkey % 3 AS replicate, round(o_totalprice / 1000)::DOUBLE AS bic, -(o_custkey % 50)::DOUBLE AS cond,
  list_sort(list_transform(range(1, 2 + o_custkey % 3), lambda i: (o_orderkey * i % 4)::DOUBLE / 8)) AS same FROM orders WHERE o_orderkey % 4 <> 3),
s0 AS (SELECT len(same) AS q, min({'x': bic, 'b': bic, 'r': replicate, 'i': candidate_id, 's': same}) AS w FROM st GROUP BY 1),
s1 AS (SELECT len(same) AS q, min({'x': bic, 'b': bic, 'r': replicate, 'i': candidate_id, 's': same}) AS w FROM st WHERE kind = 'native' AND same NOT IN (SELECT w.s FROM s0) GROUP BY 1),
s2 AS (SELECT len(same) AS q, min({'x': -cond, 'b': bic, 'r': replicate, 'i': candidate_id, 's': same}) AS w FROM st WHERE same NOT IN (SELECT w.s FROM s0 UNION ALL SELECT w.s FROM s1) GROUP BY 1)"""


@Q.query("SELECT row_number() OVER (ORDER BY q, k) - 1 AS start_id, q, role, w.i AS candidate_id FROM (SELECT q, 0 AS k, 'best_bic' AS role, w FROM s0 UNION ALL SELECT q, 1, 'native', w FROM s1 UNION ALL SELECT q, 2, 'best_conditional', w FROM s2)", _STARTS)
def starting_bank(spark, sf_dir):
    o, i = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    centers = F.transform(F.sequence(F.lit(1).cast("long"), 1 + F.col("o_custkey") % 3), lambda k: (i * k % 4).cast("double") / 8)
    kind = F.when(F.col("o_orderstatus") == "F", "native").otherwise("adjacent_coarsening")
    rows = o.select(i.alias("candidate_id"), kind.alias("kind"), (F.col("o_custkey") % 3).alias("replicate"), (i % 4 != 3).alias("eligible"), F.round(F.col("o_totalprice") / 1000).alias("bic"), (-(F.col("o_custkey") % 50)).cast("double").alias("conditional"), centers.alias("centers"))
    return R.starting_bank(rows)


@Q.query("""SELECT (SELECT count(*) FROM grid ANTI JOIN parents USING (requested_k, replicate)) AS missing, (SELECT count(*) FROM parents ANTI JOIN grid USING (requested_k, replicate)) AS extra, (SELECT count(*) FROM parents) AS attempts""",
         Q._PARENTS + ", grid AS (SELECT k AS requested_k, r AS replicate FROM (SELECT unnest(range(1, 30)) AS k), (SELECT unnest(['BUILDING', 'MACHINERY', 'NONE']) AS r))")
def attempt_grid(spark, sf_dir):
    expected = spark.range(1, 30).select(F.col("id").alias("requested_k"), F.explode(F.array(*map(F.lit, ("BUILDING", "MACHINERY", "NONE")))).alias("replicate"))
    return R.grid_gaps(Q._parents(spark, sf_dir), expected)


@Q.query("SELECT cut, count(*) AS n FROM (SELECT unnest(cuts) AS cut FROM parents) GROUP BY cut", Q._PARENTS)
def boundary_union(spark, sf_dir):
    return Q._parents(spark, sf_dir).select(F.explode("cuts").alias("cut")).groupBy("cut").agg(F.count("*").alias("n"))


@Q.query("SELECT requested_k, replicate, array_to_string(list_filter(cuts, lambda c: c IN (2, 4, 6, 8)), ',') AS shared, sha256(array_to_string(cuts, ',')) AS digest, false AS unsorted, len(list_filter(cuts, lambda c: c > 7)) > 0 AS outside FROM parents", Q._PARENTS)
def cut_records(spark, sf_dir):
    """Cuts shared with a mask, their digest, and faults of those outside 1..7."""
    rows = R.cut_faults(Q._parents(spark, sf_dir), 1, 7)
    shared = F.array_join(F.array_intersect("cuts", F.array(*[F.lit(c).cast("long") for c in (2, 4, 6, 8)])), ",")
    return rows.select("requested_k", "replicate", shared.alias("shared"), R.digest(F.col("cuts")).alias("digest"), "unsorted", "outside")


@Q.query("SELECT (x / 20)::DOUBLE AS cp FROM (SELECT unnest(range(0, 19)) AS x) UNION SELECT (o_custkey % 7)::DOUBLE / 7 AS cp FROM orders WHERE o_custkey % 7 < 6")
def refit_grid(spark, sf_dir):
    """A uniform grid and the modes of components, sorted apart and each once."""
    modes = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey") % 7).toDF("k").where("k < 6").select((F.col("k").cast("double") / 7).alias("cp"))
    return selection.united(spark.range(19).select((F.col("id") / 20).alias("cp")), modes)


@Q.query("""SELECT rule, n FROM (SELECT 'missing' AS rule, count(*) AS n FROM ret WHERE original_row % 11 = 0 UNION ALL SELECT 'unknown', count(*) FROM ret WHERE original_row % 19 = 0
  UNION ALL SELECT 'repeated', count(*) FROM ret WHERE original_row % 13 = 0 AND original_row % 11 > 0 UNION ALL SELECT 'cluster', coalesce(sum(times), 0)::BIGINT FROM mut WHERE original_row % 17 = 0
  UNION ALL SELECT 'call', coalesce(sum(times), 0)::BIGINT FROM mut JOIN (SELECT p.original_row FROM (SELECT original_row, k, m, exp(v - loglik) AS p FROM ker JOIN ll USING (original_row, k)) p
    JOIN lab ON lab.original_row = p.original_row AND label = k JOIN ret ON ret.original_row = p.original_row GROUP BY 1 HAVING max(p) FILTER (m = 1 + p.original_row % major_cn) < max(p) - 1e-9) USING (original_row) WHERE original_row % 17 > 0)""",
         Q._MIX + ", mut AS (SELECT original_row, CASE WHEN original_row % 13 = 0 THEN 2 ELSE 1 END AS times FROM ret WHERE original_row % 11 > 0)")
def row_faults(spark, sf_dir):
    """Mutations with planted faults: rows left out, made up, doubled, of a cluster that does not exist, and multiplicities by turns."""
    kept = store(Q._retained(spark, sf_dir), "retained")
    i = F.col("original_row")
    rows = kept.select(i, F.when(i % 17 == 0, 7).otherwise(_label()).alias("cluster_index"), (i % F.col("major_cn") + 1).alias("multiplicity"))
    sound = rows.where(i % 11 > 0)
    made_up = rows.where(i % 19 == 0).withColumn("original_row", -i - 1)
    clusters = spark.createDataFrame(list(enumerate(CENTERS)), "cluster_index long, cellular_prevalence double")
    return checks.row_rules(sound.unionByName(sound.where(i % 13 == 0)).unionByName(made_up), clusters, kept, PURITY)


@Q.query("""SELECT 'number' AS rule, count(*) FILTER (i <> place) AS n FROM x UNION ALL SELECT 'order', count(*) FILTER (c > b) FROM x UNION ALL SELECT 'proportion', count(*) FILTER (abs(p * t - s) > 1e-6) FROM x""",
    """x AS (SELECT i, c, s, p, row_number() OVER (ORDER BY i) - 1 AS place, lag(c) OVER (ORDER BY i) AS b, sum(s) OVER () AS t FROM
  (SELECT n_nationkey + CASE WHEN n_nationkey > 20 THEN 1 ELSE 0 END AS i, 1 - (n_nationkey * 7 % 25) / 25.0 AS c, count(*) AS s, CASE WHEN n_nationkey % 3 = 0 THEN 0.5 ELSE count(*)::DOUBLE / (SELECT count(*) FROM customer) END AS p
   FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY n_nationkey))""")  # fmt: skip
def cluster_order_faults(spark, sf_dir):
    """Customers by nation as clusters whose numbers skip one, whose fractions rise at times, and every third of whose shares is wrong."""
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_nationkey").cast("long")
    total = customer.agg(F.count("*").alias("total"))
    sizes = customer.groupBy(k.alias("k")).agg(F.count("*").alias("num_SNV")).crossJoin(total)  # one row
    k = F.col("k")
    return checks.order_rules(sizes.select(F.when(k > 20, k + 1).otherwise(k).alias("cluster_index"), (1 - k * 7 % 25 / 25.0).alias("cellular_prevalence"), "num_SNV", F.when(k % 3 == 0, 0.5).otherwise(F.col("num_SNV") / F.col("total")).alias("assignment_proportion")))
