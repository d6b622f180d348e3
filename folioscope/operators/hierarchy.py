"""Parent-child links to full hierarchies: tops, depths, paths, descendants and loops.

Links are a DataFrame (part, parent, child): `part` names the graph (several graphs are closed in the same jobs),
parent and child are ids of `members` (part, id).

Frontiers go down from the tops. A round joins all pairs (top, record) found so far with the links, keeps the pairs that
are new, and joins the links with themselves, so that the next round's links span twice as many levels: after k rounds
all records less than 2^k levels below a top are found. A frontier of one level a round gives the same pairs, but needs
as many dependent joins as the deepest tree has levels (hundreds here). Repeated pairs are dropped, which ends walks
round loops; records from which and to which the links of ever more levels still lead are on loops or between loops.

Defined results of odd input: null ids and links with an end that is no member are dropped; repeated links and members
count once; a record without links is its own top at depth 0; an empty table gives an empty result; a record that only
hangs below a loop has no top and, not being on the loop, no row in `loops`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.plans.session import Rounds, cut


def _ids(members: DataFrame) -> DataFrame:
    return members.select("part", "id").where("id is not null").distinct()


def clean_links(members: DataFrame, links: DataFrame) -> DataFrame:
    """Distinct links whose both ends are members."""
    return _within(links.select("part", "parent", "child").distinct(), _ids(members))


def _within(links: DataFrame, ids: DataFrame) -> DataFrame:
    """The links whose both ends are among ids."""
    for end in ("parent", "child"):
        links = links.join(ids.select("part", F.col("id").alias(end)), ["part", end], "left_semi")
    return links.select("part", "parent", "child")


def tops(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id) of the members without a parent, not even themselves."""
    return _ids(members).join(edges.select("part", F.col("child").alias("id")).distinct(), ["part", "id"], "left_anti")


def _doubled(links: DataFrame) -> DataFrame:
    """Links of twice as many levels."""
    lower = links.select("part", F.col("parent").alias("_via"), F.col("child").alias("_below"))
    return links.withColumnRenamed("child", "_via").join(lower, ["part", "_via"]).select("part", "parent", F.col("_below").alias("child")).distinct()


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def _descend(rounds: Rounds, starts: DataFrame, edges: DataFrame) -> tuple[list[DataFrame], DataFrame, int]:
    """Pairs (part, top, id, depth) with the fewest steps from each start to each record below it, the links of the last round and their levels.

    A round that finds no pair is the last: the records on a shortest way down are one level apart, so there is none beyond.
    """
    found = [rounds.write(starts.select("part", F.col("id").alias("top"), "id", F.lit(0).alias("depth")))]
    links, levels = edges, 1
    while True:
        so_far = _union(found)
        step = links.select("part", F.col("parent").alias("id"), F.col("child").alias("_to"))
        met = so_far.join(step, ["part", "id"]).groupBy("part", "top", F.col("_to").alias("id")).agg((F.min("depth") + levels).cast("int").alias("depth"))
        met = rounds.write(met)
        # Only pairs met again are looked up among those found; as tables, few of them are known to be few and no large one moves.
        again = so_far.join(met.select("part", "top", "id"), ["part", "top", "id"], "left_semi").select("part", "top", "id")
        new = rounds.write(met.join(again, ["part", "top", "id"], "left_anti").select("part", "top", "id", "depth"))
        if new.isEmpty():
            return found, links, levels
        found.append(new)
        links, levels = rounds.write(_doubled(links)), levels * 2


def hierarchy(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, top, depth): the tops of each record with the fewest steps from each. edges: from clean_links."""
    return reached(tops(members, edges), edges)


def reached(starts: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, id, top, depth) of each start (part, id) and each record reached from it."""
    rounds = Rounds(edges.sparkSession)
    found, _, _ = _descend(rounds, starts, rounds.write(edges))
    out = cut(_union(found).select("part", "id", "top", "depth"))
    rounds.close()
    return out


def descendants(members: DataFrame, edges: DataFrame) -> DataFrame:
    """(part, ancestor, descendant, steps): all pairs with the fewest steps, each record among its own at 0."""
    return reached(_ids(members), edges).select("part", F.col("top").alias("ancestor"), F.col("id").alias("descendant"), F.col("depth").alias("steps"))


def hierarchy_and_loops(members: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """hierarchy() and loops() of the same links; the rounds of the first serve the second."""
    rounds = Rounds(edges.sparkSession)
    edges = rounds.write(edges)
    found, links, _ = _descend(rounds, tops(members, edges), edges)
    done, rings = cut(_union(found).select("part", "id", "top", "depth")), cut(_loops(rounds, edges, links))
    rounds.close()
    return done, rings


def loops(edges: DataFrame) -> DataFrame:
    """(part, id, loop): each record on a loop with the smallest id of those that it reaches and that reach it."""
    rounds = Rounds(edges.sparkSession)
    edges = rounds.write(edges)
    out = cut(_loops(rounds, edges, edges))
    rounds.close()
    return out


def _endless(rounds: Rounds, links: DataFrame) -> DataFrame:
    """(part, id) with endless walks both ways. links: of any number of levels.

    If no record leaves when the levels double, none leaves later: a longest finite walk of more levels has a record
    on it whose own longest walk is between the two numbers of levels.
    """
    before = None
    while True:
        now = tuple(links.agg(F.count_distinct("part", "parent"), F.count_distinct("part", "child")).first())
        if not now[0] or now == before:
            heads, tails = (links.select("part", F.col(end).alias("id")).distinct() for end in ("parent", "child"))
            return heads.join(tails, ["part", "id"], "left_semi")
        before = now
        links = rounds.write(_doubled(links))


def _loops(rounds: Rounds, edges: DataFrame, links: DataFrame) -> DataFrame:
    """loops() of edges, links being those of more levels.

    Among the records with endless walks both ways, colours (the smallest id from which a record is reached) split them
    into classes, and the records of a class that reach its colour form one loop with it. These are taken off, and the
    rest is done again until no link is left.
    """
    found = [edges.select("part", F.col("parent").alias("id"), F.col("parent").alias("loop")).limit(0)]
    while True:
        core = rounds.write(_endless(rounds, links))
        near = rounds.write(_within(edges, core))
        if near.isEmpty():
            return _union(found)
        colour = _least_reached(rounds, core, near, "child", "parent")
        ends = [colour.select("part", F.col("id").alias(end), F.col("least").alias(f"_{end}")) for end in ("parent", "child")]
        inside = rounds.write(near.join(ends[0], ["part", "parent"]).join(ends[1], ["part", "child"]).where("_parent = _child").select("part", "parent", "child"))
        down = _least_reached(rounds, core, inside, "parent", "child")
        ring = rounds.write(down.join(colour.select("part", "id", F.col("least").alias("_colour")), ["part", "id"]).where("least = _colour").select("part", "id", F.col("least").alias("loop")))
        # A class of one record is a loop only if the record links to itself, as all links inside it then do.
        found.append(rounds.write(ring.join(inside.select("part", F.col("parent").alias("id")).distinct(), ["part", "id"], "left_semi")))
        edges = links = rounds.write(_within(near, core.join(ring, ["part", "id"], "left_anti")))


def _least_reached(rounds: Rounds, ids: DataFrame, edges: DataFrame, source: str, target: str) -> DataFrame:
    """(part, id, least): the smallest id that each record reaches along source -> target, itself included.

    The levels of the links double. A round that lowers no id is the last, by the argument of _descend for the ways to the least ids.
    """
    least = rounds.write(ids.select("part", "id", F.col("id").alias("least")))
    links, before = edges, None
    while True:
        now = least.agg(F.sum(F.col("least").cast("decimal(38,0)"))).first()[0]
        if now == before:
            return least
        before = now
        seen = links.select("part", F.col(source).alias("_id"), F.col(target).alias("id")).join(least, ["part", "id"]).select("part", F.col("_id").alias("id"), "least")
        least = rounds.write(least.unionByName(seen).groupBy("part", "id").agg(F.min("least").alias("least")))
        links = rounds.write(_doubled(links))


def paths(done: DataFrame, edges: DataFrame) -> DataFrame:
    """done, from hierarchy(), with the path (ids from the top to the record): at each step up the smallest parent on a shortest way.

    Each record first knows the step above it; joining what is unfinished with itself doubles the known part.
    """
    rounds = Rounds(done.sparkSession)
    above = done.select("part", "top", F.col("id").alias("parent"), (F.col("depth") + 1).alias("depth"))
    up = done.where("depth > 0").join(edges.select("part", "parent", F.col("child").alias("id")), ["part", "id"]).join(above, ["part", "top", "parent", "depth"])
    up = up.groupBy("part", "id", "top", "depth").agg(F.min("parent").alias("up"))
    whole = [rounds.write(done.where("depth = 0").select("part", "id", "top", "depth", F.lit(None).cast("bigint").alias("up"), F.array("id").alias("path")))]
    open_ = rounds.write(up.withColumn("path", F.array("id")))
    while not open_.isEmpty():
        higher = _union([*whole, open_]).select("part", "top", F.col("id").alias("up"), F.col("up").alias("_up"), F.col("path").alias("_path"))
        longer = open_.join(higher, ["part", "top", "up"]).select("part", "id", "top", "depth", F.col("_up").alias("up"), F.concat("_path", "path").alias("path"))
        longer = rounds.write(longer)
        whole.append(longer.where("up is null"))
        open_ = longer.where("up is not null")
    out = cut(_union(whole).select("part", "id", "top", "depth", "path"))
    rounds.close()
    return out
