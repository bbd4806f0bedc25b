"""One entity per record over all duplicate rules: connected components of records and the clusters they share."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import dedupe
from .keyed import attach_by_key, key_stats, with_key_stats

c = F.col


def rule_keys() -> dict[str, Column]:
    """Cluster key of every duplicate rule on records, by the type of its clusters."""
    return {dedupe.EXACT_ID: dedupe.id_key(), dedupe.SERIAL: dedupe.serial_key(), dedupe.COMPOSITE: dedupe.composite_key()}


def links(records: DataFrame, keys: Mapping[str, Column] | None = None, member: str = "record_id") -> DataFrame:
    """(member, cluster): one row per record and rule that gives it a key; keys of different rules never meet."""
    keys = rule_keys() if keys is None else keys
    each = F.array(*[F.when(k.isNotNull(), F.concat(F.lit(f"{rule}|"), k.cast("string"))) for rule, k in keys.items()])
    return records.select(c(member).alias("member"), F.explode(F.array_compact(each)).alias("cluster"))


def components(edges: DataFrame, most_rounds: int = 64) -> DataFrame:
    """(member, entity): members joined through any chain of clusters have the smallest of them as entity.

    Stars are contracted: in every round each cluster takes the node of lowest rank among its own, each node the lowest
    its clusters took, and becomes it; clusters with one node left are done. Ranks are drawn anew by hash in every
    round, so the nodes of a chain fall by a share in each, whatever their order: about log(n) rounds. A
    cluster of any size is a partial aggregate, and its rows are salted where they are joined. Null members and
    clusters link nothing. Every round is written, so a lost executor repeats one at most.
    """
    edges = edges.where(c("member").isNotNull() & c("cluster").isNotNull())
    open_edges = cut_lineage(edges.select(c("member").alias("node"), F.xxhash64("cluster").alias("hub"), "cluster").distinct(), "edges")
    where = cut_lineage(open_edges.select(c("node").alias("member")).distinct().withColumn("node", c("member")), "nodes")
    for number in range(most_rounds):
        open_edges = _shared(open_edges)
        ranked = open_edges.withColumn("best", F.struct(F.xxhash64("node", F.lit(number)).alias("rank"), c("node").alias("to")))
        lowest = key_stats(ranked, ["hub", "cluster"], {"lowest": F.min("best")})
        offered = attach_by_key(ranked.select("node", "hub", "cluster"), lowest, ["hub", "cluster"], ["lowest"], ["node"])
        moves = cut_lineage(offered.groupBy("node").agg(F.min("lowest")["to"].alias("to")).where(c("to") != c("node")), "moves")
        if moves.isEmpty():
            break
        # Two steps at once: any node of the same component will do, and fewer rounds are left.
        onward = moves.select(c("node").alias("to"), c("to").alias("next"))
        moves = moves.join(onward, "to", "left").select("node", F.coalesce("next", "to").alias("to"))
        open_edges = cut_lineage(_moved(open_edges, moves).distinct(), "edges")
        where = cut_lineage(_moved(where, moves), "nodes")
    else:
        raise RuntimeError(f"not contracted after {most_rounds} rounds")
    named = with_key_stats(where, ["node"], {"entity": F.min("member")}, ["member"])
    return named.select("member", "entity")


def _shared(edges: DataFrame) -> DataFrame:
    """Edges of clusters that still hold several nodes."""
    several = {"several": F.min("node") != F.max("node")}
    return with_key_stats(edges, ["hub", "cluster"], several, ["node"]).where("several").select(*edges.columns)


def _moved(df: DataFrame, moves: DataFrame) -> DataFrame:
    # Many members may be at one node by now.
    per_node = key_stats(df, ["node"], {}).join(moves, "node")
    moved = attach_by_key(df, per_node, ["node"], ["to"], [x for x in df.columns if x != "node"])
    return moved.select(*[F.coalesce("to", "node").alias("node") if x == "node" else c(x) for x in df.columns])


def entities(records: DataFrame, keys: Mapping[str, Column] | None = None, member: str = "record_id") -> DataFrame:
    """(member, entity, n_members) for every record; one without a shared key is an entity of its own."""
    found = components(links(records, keys, member)).select(c("member").alias(member), "entity")
    every = records.select(member).where(c(member).isNotNull()).distinct().join(found, member, "left")
    whole = every.withColumn("entity", F.coalesce("entity", c(member)))
    sized = with_key_stats(whole, ["entity"], {"n_members": F.count(F.lit(1))}, [member])
    return sized.select(member, "entity", "n_members")
