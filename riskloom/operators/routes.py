"""From a subject to the entities that a feature is about: choice of a route, its hops, and what their number says."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MAX_DEPTH = 3


def shortest(edges: list[tuple[int, str, str, str]], start: str, end: str) -> list[int] | None:
    """Edge ids of the shortest route between two types; edges: (id, name, from, to). Ties go to the lower id; at most MAX_DEPTH hops."""
    seen, queue = {start}, deque([(start, [])])
    while queue:
        node, path = queue.popleft()
        if node == end:
            return path
        if len(path) < MAX_DEPTH:
            for i, _, source, target in sorted(edges):
                if source == node and target not in seen:
                    seen.add(target)
                    queue.append((target, [*path, i]))
    return None


def named(edges: list[tuple[int, str, str, str]], start: str, names: list[str]) -> list[int]:
    """Edge ids of a route that is spelled out; an unknown edge is an error."""
    out = []
    for name in names:
        hit = next((e for e in sorted(edges) if e[1] == name and e[2] == start), None)
        if hit is None:
            raise ValueError(f"no edge {name} at {start}")
        out.append(hit[0])
        start = hit[3]
    return out


def plan(edges: list[tuple[int, str, str, str]], path: str, subject: str, trigger: str | None, entity: str) -> tuple[str, list[int]]:
    """(root, route) of a path: self, trigger, subject.<edge>..., or auto: from the subject, else from the trigger."""
    if path == "self":
        if subject != entity:
            raise ValueError(f"self is a {subject}, not a {entity}")
        return "subject", []
    if path.startswith("subject."):
        return "subject", named(edges, subject, path.split(".")[1:])
    for root, kind in (("subject", subject), ("trigger", trigger)):
        if kind is not None and (path == "auto" or path == root):
            route = shortest(edges, kind, entity)
            if route is not None:
                return root, route
    raise ValueError(f"no route by {path} to {entity}")


def follow(roots: DataFrame, hops: list[DataFrame]) -> DataFrame:
    """(subject, entity) after hops (from_id, to_id) from roots (subject, entity): equi-joins, each pair once."""
    out = roots
    for hop in hops:
        out = out.join(hop.select(F.col("from_id").alias("entity"), F.col("to_id").alias("next")).distinct(), "entity").select("subject", F.col("next").alias("entity")).distinct()
    return out


def verdict(subjects: DataFrame, reached: DataFrame, policy: str) -> DataFrame:
    """(subject, n, state): no_entities without any, unresolvable where the policies `one` and `error` meet several, else resolved."""
    n = reached.groupBy("subject").agg(F.count("*").alias("n"))
    x = subjects.select("subject").join(n, "subject", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return x.withColumn("state", F.when(F.col("n") == 0, "no_entities").when(F.lit(policy).isin("one", "error") & (F.col("n") > 1), "unresolvable").otherwise("resolved"))
