"""Whole runs: text tables in, published tables out."""

from __future__ import annotations

import json
import math
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame, SparkSession

from tallyspan.operators import checks, ledger
from tallyspan.plans import fit as P
from tallyspan.plans.scratch import store
from tallyspan.sources import text_tables as T

POINT_COLUMNS = ["chromosome_index", "position", "ref_count", "alt_count"]
SEGMENT_COLUMNS = ["chromosome_index", "start_position", "end_position", "major_cn", "minor_cn", "total_cn"]


@dataclass(frozen=True)
class FitConfig:
    """How to fit: up to max_clusters, or exactly `clusters`. With subsample_size, the partitions come from that many rows, drawn anew for each of `replicates` with seed + replicate, in proportion from
    windows over the share of alternate reads; all rows score them. Names go into the published record. device: Spark runs the numpy kernels on the executors' CPUs, so "cuda" is refused."""

    max_clusters: int = P.MOST_CLUSTERS
    clusters: int | None = None
    sample_id: str = "sample"
    assembly: str = "unspecified"
    device: str = "auto"
    subsample_size: int | None = None
    replicates: int = 1
    seed: int = 0
    window_size: float = 0.05
    overlap: float = 0.0

    def __post_init__(self) -> None:
        for name in ("max_clusters", "clusters"):
            value = getattr(self, name)
            if value is None and name == "clusters":
                continue
            if type(value) is not int or not 1 <= value <= P.MOST_CLUSTERS:
                raise ValueError(f"{name} must be a whole number from 1 to {P.MOST_CLUSTERS}")
        for name, forbidden in (("sample_id", "/\\\t\r\n"), ("assembly", "\t\r\n")):
            value = getattr(self, name)
            if not isinstance(value, str) or not value.strip() or set(value) & set(forbidden):
                raise ValueError(f"{name} must be a name without separators")
        if self.device not in ("auto", "cpu"):
            raise ValueError("device must be auto or cpu")
        for name in ("subsample_size", "replicates"):
            value = getattr(self, name)
            if not (value is None and name == "subsample_size") and (type(value) is not int or value < 1):
                raise ValueError(f"{name} must be a positive whole number")
        if self.subsample_size is None and self.replicates > 1:
            raise ValueError("replicates need a subsample_size")
        if type(self.seed) is not int or not 0 <= self.seed < 2**32 - self.replicates:
            raise ValueError("seed must be a whole number from 0 to 2^32 - 1 - replicates")
        for name in ("window_size", "overlap"):
            value = getattr(self, name)
            if isinstance(value, bool) or not isinstance(value, (int, float)) or not math.isfinite(value):
                raise ValueError(f"{name} must be a finite number")
        if not 0 <= self.overlap < self.window_size <= 1:
            raise ValueError("overlap must be at least 0 and under window_size, which is 1 at most")

    @classmethod
    def from_dict(cls, value: dict) -> FitConfig:
        """The configuration that a published record tells: all fields and no others."""
        if not isinstance(value, dict) or value.keys() != {f.name for f in fields(cls)}:
            raise ValueError("a recorded configuration has exactly the fields of FitConfig")
        return cls(**value)

    def capacities(self, n: int) -> list[int]:
        """The numbers of clusters to fit to n rows. ValueError if these, or the sample, are too few for one of them."""
        if self.clusters and self.clusters > n:
            raise ValueError(f"{n} rows cannot make {self.clusters} clusters")
        wanted = [self.clusters] if self.clusters else list(range(1, min(n, self.max_clusters) + 1))
        if not wanted or (self.subsample_size is not None and self.subsample_size < wanted[-1]):
            raise ValueError("too few rows, or too small a sample, for the clusters asked for")
        return wanted

    def sampling(self) -> dict | None:
        """What fits() asks for to work on samples."""
        if self.subsample_size is None:
            return None
        return {"size": self.subsample_size, "replicates": self.replicates, "seed": self.seed, "window": float(self.window_size), "overlap": float(self.overlap)}


def _read(spark: SparkSession, points: str, segments: str, purity: str) -> tuple[DataFrame, float]:
    p, s = ledger.points_of(T.read_table(spark, points, POINT_COLUMNS)), ledger.segments_of(T.read_table(spark, segments, SEGMENT_COLUMNS))
    p, s = store(p, "points"), store(s, "segments")
    ledger.checked(p, s)
    return store(ledger.ledger(p, s), "ledger"), T.read_scalar(spark, purity)


def validate_inputs(spark: SparkSession, points: str, segments: str, purity: str) -> dict:
    """Counts of rows, retained and excluded by reason. Inputs that break a rule raise ValueError."""
    rows, value = _read(spark, points, segments, purity)
    reasons = {r["reason"]: r["n"] for r in ledger.reason_counts(rows).collect()}
    return ledger.summary(rows).first().asDict() | {"purity": value, "reasons": reasons}


def fit(spark: SparkSession, points: str, segments: str, purity: str, output: str, most: int = P.MOST_CLUSTERS, config: FitConfig | None = None) -> dict:
    """Fits what config asks for (without one 1..most clusters) and publishes the best by BIC under output, which must not exist:
    mutations, clusters, the ledger, all fits, all candidates, and the posterior tables."""
    config = config or FitConfig(max_clusters=most)
    rows, value = _read(spark, points, segments, purity)
    kept = store(ledger.retained(rows), "retained")
    if kept.isEmpty():
        raise ValueError("no observation is retained")
    config.capacities(kept.count())
    chain, found, candidates = P.fits(kept, value, config.max_clusters, config.clusters, config.sampling())
    best = P.best(found)
    P.exactly(chain, best, value)
    tables = P.tables(kept, chain, best, value) | P.posterior_tables(kept, chain, best, value)
    tables = {k: store(t, k) for k, t in tables.items()} | {"fits": P.fit_table(spark, found), "candidates": candidates}
    if broken := {r["rule"]: r["n"] for r in P.faults(kept, tables, value).collect() if r["n"]}:
        raise RuntimeError(f"the fitted tables break rules: {broken}")
    about = {"purity": value, "clusters": best.k, "bic": best.bic, "loglik": best.loglik, "n": best.n, "bic_by_k": {str(f.requested): f.bic for f in found}, "sample_id": config.sample_id, "assembly": config.assembly, "config": asdict(config), "settled": best.settled, "weight_gap": best.gap}
    T.publish(tables | {"ledger": rows}, output, about)
    return about


TABLES = ("mutations", "clusters", "ledger", "fits", "candidates", "posterior_clusters", "posterior_flow", "posterior_summary", "posterior_mutations")


def load_result(spark: SparkSession, output: str) -> dict[str, DataFrame]:
    """The published tables."""
    return {name: spark.read.parquet(f"{output}/{name}") for name in TABLES}


def verify(spark: SparkSession, output: str) -> dict[str, int]:
    """Broken rules of a published run by name, counted on its tables as they are: all 0 if it is sound."""
    found = load_result(spark, output)
    about = json.loads(spark.read.text(f"{output}/about").first()["value"])
    return {r["rule"]: r["n"] for r in P.faults(ledger.retained(found["ledger"]), found, about["purity"]).collect()}
