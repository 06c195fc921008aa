"""Building well-covered graphs: coverage, branches and chains, well-formedness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwork.operators import digraph


def least_multiplicity(coverage: int) -> int:
    """Half of the coverage, rounded up: how often an edge must occur."""
    return -(-coverage // 2)


def repeat_multiplicity(coverage: int) -> int:
    """Twice that: from here on an edge counts as walked twice."""
    return 2 * least_multiplicity(coverage)


def covered(edges: DataFrame, coverage: int | None) -> DataFrame:
    """Edges that occur often enough; None keeps all. Both ends see one multiplicity, so this is the vertex filter too."""
    return edges if coverage is None else edges.filter(F.col("multiplicity") >= least_multiplicity(coverage))


def partition_kinds(edges: DataFrame) -> DataFrame:
    """Vertices with kind `branch` or `chain`, for a sink that is partitioned by kind."""
    return digraph.flags(edges).withColumn("kind", F.when(F.col("is_branch"), "branch").otherwise("chain"))


def well_formed(edges: DataFrame) -> DataFrame:
    """Per group: n_sources, n_sinks and status: ok for exactly one of each, else what there is too much or too little of."""
    found = digraph.sources_and_sinks(edges)
    status = F.when((F.col("n_sources") == 1) & (F.col("n_sinks") == 1), "ok").when(F.col("n_sources") > 1, "multi_source").when(F.col("n_sinks") > 1, "multi_sink").otherwise("no_end")
    return found.drop("last_source", "last_sink").withColumn("status", status)
