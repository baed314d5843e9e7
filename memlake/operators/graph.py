"""Graph of rooms that wings share, breadth-first walks, explicit tunnels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import preview, tunnel_id
from ..session import shared_folder
from .collection import top


def nodes(drawers: DataFrame) -> DataFrame:
    """A row per room: its wings, halls, count and last five dates. Rooms without a name, general ones and rows without a wing don't count.

    Wings and halls are categories; of the dates, which are not, only five a room are ever gathered.
    """
    rows = drawers.where("room is not null and room not in ('', 'general') and wing is not null and wing <> ''")
    dates = top(rows.where("occurred_at is not null").select("room", "occurred_at").distinct(), 5, [F.col("occurred_at").desc()], ["room"])
    dates = dates.groupBy("room").agg(F.array_sort(F.collect_list("occurred_at")).alias("dates"))
    found = rows.groupBy("room").agg(F.array_sort(F.collect_set("wing")).alias("wings"), F.array_sort(F.collect_set("hall")).alias("halls"), F.count("*").alias("n"))
    return found.join(dates, "room", "left").withColumn("dates", F.coalesce("dates", F.array().cast("array<string>")))


def edges(of: DataFrame) -> DataFrame:
    """Every pair of a room's wings by every hall; a room without halls has none."""
    e = of.select("room", "halls", "n", F.explode("wings").alias("wing_a"), "wings").select("*", F.explode("wings").alias("wing_b"))
    return e.where("wing_a < wing_b").select("room", "wing_a", "wing_b", F.explode("halls").alias("hall"), "n")


def tunnels(of: DataFrame, wing_a: str | None = None, wing_b: str | None = None, limit: int = 50) -> DataFrame:
    rows = of.where(F.size("wings") >= 2)
    for w in (wing_a, wing_b):
        rows = rows if w is None else rows.where(F.array_contains("wings", w))
    return rows.orderBy(F.col("n").desc(), "room").limit(limit)


def stats(of: DataFrame) -> DataFrame:
    pairs = F.size("wings") * (F.size("wings") - 1) / 2 * F.size("halls")
    return of.agg(F.count("*").alias("rooms"), F.count_if(F.size("wings") >= 2).alias("tunnel_rooms"), F.sum(pairs).cast("long").alias("edges"))


def rooms_per_wing(of: DataFrame) -> DataFrame:
    return of.select(F.explode("wings").alias("wing")).groupBy("wing").agg(F.count("*").alias("rooms"))


def top_tunnels(of: DataFrame, limit: int = 10) -> DataFrame:
    """The rooms of most wings, two at least; equal ones by name."""
    return of.where(F.size("wings") >= 2).orderBy(F.size("wings").desc(), "room").limit(limit)


def traverse(of: DataFrame, start: str, max_hops: int = 2, limit: int = 50) -> DataFrame:
    """Rooms within hops of shared wings, and the wings that each shares with the room that discovers it (connected_via).

    A room is reached through the wings of the last hop's rooms. Of several rooms that reach it, the one discovers it
    whose path of names from the start is first in the alphabet. Each hop's rooms are written, so that the plan doesn't
    grow with the hops.
    """
    shared_folder(of.sparkSession)
    pairs = of.select("room", "wings", F.explode("wings").alias("wing"))
    none = F.array().cast("array<string>")
    seen = frontier = of.where(F.col("room") == start).select("room", F.lit(0).alias("hop"), none.alias("connected_via"), F.col("room").alias("__path"), F.col("wings").alias("__w"))
    for hop in range(1, max_hops + 1):
        reached = frontier.select(F.explode("__w").alias("wing"), F.struct(F.col("__path").alias("p"), F.col("__w").alias("w")).alias("by")).groupBy("wing").agg(F.min("by").alias("by"))
        found = pairs.join(reached, "wing").groupBy("room", "wings").agg(F.min("by").alias("by")).join(seen, "room", "left_anti")
        path = F.concat_ws("\0", "by.p", "room")
        frontier = found.select("room", F.lit(hop).alias("hop"), F.array_intersect("wings", "by.w").alias("connected_via"), path.alias("__path"), F.col("wings").alias("__w")).checkpoint()
        seen = seen.unionByName(frontier)
    return of.join(seen.drop("__path", "__w"), "room").orderBy("hop", F.col("n").desc(), "room").limit(limit)


def fuzzy_rooms(of: DataFrame, query: str, limit: int = 5) -> DataFrame:
    """Rooms that hold the query (1.0) or one of its words (0.5)."""
    low = F.lower("room")
    some = [F.contains(low, F.lit(w)) for w in query.lower().split("-") if w]
    score = F.when(F.contains(low, F.lit(query.lower())), 1.0)
    for c in some:
        score = score.when(c, 0.5)
    return of.withColumn("score", score.otherwise(0.0)).where("score > 0").orderBy(F.col("score").desc(), "room").limit(limit)


def with_tunnel_ids(links: DataFrame) -> DataFrame:
    return links.withColumn("tunnel_id", tunnel_id(F.col("wing_a"), F.col("room_a"), F.col("wing_b"), F.col("room_b")))


def merge_tunnels(old: DataFrame, new: DataFrame) -> DataFrame:
    """Either direction of a link is one tunnel: the first creation time stays, a later one is its update time."""
    both = with_tunnel_ids(old.unionByName(new))
    return both.groupBy("tunnel_id").agg(F.min("created_at").alias("created_at"), F.max_by("label", F.struct("created_at", "label")).alias("label"), F.when(F.count("*") > 1, F.max("created_at")).alias("updated_at"))


def list_tunnels(links: DataFrame, wing: str | None = None) -> DataFrame:
    """Explicit tunnels with either end in the wing; all without one."""
    return links if wing is None else links.where((F.col("wing_a") == wing) | (F.col("wing_b") == wing))


def delete_tunnels(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The tunnels that stay when those with these ids (tunnel_id) go; ids that are unknown change nothing."""
    return with_tunnel_ids(links).join(ids.select("tunnel_id"), "tunnel_id", "left_anti")


def follow(links: DataFrame, wing: str, room: str, drawers: DataFrame) -> DataFrame:
    """Where explicit tunnels lead from a room, in both directions, with a preview of the drawer at the far end."""
    there = links.where((F.col("wing_a") == wing) & (F.col("room_a") == room)).select(F.lit("outgoing").alias("direction"), F.col("wing_b").alias("wing"), F.col("room_b").alias("room"), F.col("drawer_b").alias("drawer"))
    back = links.where((F.col("wing_b") == wing) & (F.col("room_b") == room)).select(F.lit("incoming").alias("direction"), F.col("wing_a").alias("wing"), F.col("room_a").alias("room"), F.col("drawer_a").alias("drawer"))
    d = drawers.select(F.col("id").alias("drawer"), preview(F.col("document"), 300).alias("preview"))
    return there.unionByName(back).join(d, "drawer", "left")
