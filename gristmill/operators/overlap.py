"""Components of sets at a Jaccard similarity: stars over buckets, then exactly what the stars leave open.

A rep names a set. Reps that share a bucket are candidates.

1. A bucket gives one star, from its hub to its other reps. The hub is the rep
   that meets most others over all its buckets, so in a group of near copies,
   which may be unlike each other, it is the text they all stem from or come
   closest to. Stars with the same hub are one.
2. Full sets are compared along the stars, and components made of the links.
3. Two reps x, y of a hub c in different components are still open. Let D(x) be
   the symmetric difference of x and c. The size of the intersection of x and y
   is |c| - |c \\ x| - |c \\ y| + |D(x) & D(y)|, so a similarity is a least size of
   D(x) & D(y), and as x or y is not linked to c, that size is 1 or more. Copies
   with changes of their own share little of their differences, however many
   they are, where their full sets share most.
4. So open pairs are found by a prefix filter over the differences: with the
   elements of all differences from a hub in one order, rarest first, two that
   share k elements share one that has k - 1 or more after it in both.

Every pair of reps that shares a bucket is thus linked, or in one component, or
shown to be unlike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gristmill.operators.graph import components
from gristmill.operators.hot import PARTS, join_by_share
from gristmill.storage import durable

#: Reps of a hub that meet one copy of its set; a larger star gets more copies.
FAN = 256
#: Of the elements that two similar sets share, one in so many must be met in their heads.
MET = 16
SAMPLED = 64
#: Rows that a task sorts by key, about 50 MB.
ROWS_A_TASK = 1_000_000


def stars(buckets: DataFrame) -> DataFrame:
    """``hub, rep``: the stars of the buckets ``key, rep``, without repeats."""
    buckets = durable(buckets.select("key", "rep"), "buckets")
    held = durable(buckets.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "held")
    members = durable(join_by_share(buckets, held, ["key"]), "members")
    met = members.groupBy("rep").agg(F.sum("n").alias("met"))
    first = durable(members.join(met, "rep").groupBy("key").agg(F.min(F.struct((-F.col("met")).alias("met"), "rep")).alias("first"), F.count("*").alias("n")).select("key", "n", F.col("first.rep").alias("hub")), "hubs")
    return join_by_share(members.drop("n"), first, ["key"]).where("rep <> hub").select("hub", "rep").distinct()


def similar_components(star: DataFrame, sets: DataFrame, percent: int, node: Callable[[Column], Column] = lambda rep: rep, known: DataFrame | None = None) -> DataFrame:
    """``node, comp`` of the links at percent among reps that share a bucket, and of the links ``known`` (``u, v``).

    star: what ``stars`` gives, written; sets: ``rep, shingles``, written, distinct within a row. A rep
    is of any type that has an order; ``node`` gives the number of its node.
    """
    missing, n = F.size(F.array_except("hub_set", "rep_set")), F.size("rep_set")
    scored = _meet(star, sets).select("hub", "rep", F.size("hub_set").alias("size"), n.alias("n"), (n - F.size("hub_set") + 2 * missing).alias("d"), (percent * n + (100 + percent) * missing).cast("long").alias("away"))
    scored = durable(scored.withColumn("linked", F.expr("away <= 100L * size")), "scored")
    links = scored.where("linked").select(node(F.col("hub")).alias("u"), node(F.col("rep")).alias("v"))
    links = links if known is None else links.union(known.select("u", "v"))
    comps = components(links)
    pairs = durable(open_pairs(scored, comps, sets, percent, node), "pairs")
    more = durable(confirmed(pairs, sets, percent).select(node(F.col("u")).alias("u"), node(F.col("v")).alias("v")), "links")
    return comps if more.isEmpty() else components(links.union(more))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs ``u, v`` whose full sets have 100 * intersection >= percent * union."""
    both = _meet(pairs.select(F.col("u").alias("hub"), F.col("v").alias("rep")), sets)
    a, b = F.size("hub_set"), F.size("rep_set")
    return both.where((100 + percent) * F.size(F.array_intersect("hub_set", "rep_set")).cast("long") >= percent * (a + b)).select(F.col("hub").alias("u"), F.col("rep").alias("v"))


def open_pairs(scored: DataFrame, comps: DataFrame, sets: DataFrame, percent: int, node: Callable[[Column], Column]) -> DataFrame:
    """``u, v``: the reps of a hub that are in different components and may be similar yet.

    ``away`` is percent * |x| + (100 + percent) * |c \\ x|: x is linked to c if
    that is at most 100 * |c|, and x and y are similar if and only if D(x) & D(y)
    has at least (away(x) + away(y) - (100 + percent) * |c|) / (100 + percent)
    elements.
    """
    placed = scored.join(comps.select(F.col("node").alias("_node"), "comp"), node(F.col("rep")) == F.col("_node"), "left").withColumn("comp", F.coalesce("comp", node(F.col("rep")))).drop("_node")
    placed = durable(placed, "placed")
    out_least = F.min(F.when(~F.col("linked"), F.col("away"))).alias("out_least")
    hubs = placed.groupBy("hub").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), out_least, F.min("away").alias("least"), F.count("*").alias("reps"))
    hubs = durable(hubs.where("low < high").drop("low", "high"), "hubs")
    # The fewest shared elements that a partner could ask for: one that is not linked to the hub, or any.
    need = lambda least: F.expr(f"cast(ceil((away + {least} - {100 + percent}L * size) / {100 + percent}) as int)")
    wide = join_by_share(placed, hubs, ["hub"], "reps").withColumn("need_out", need("out_least")).withColumn("need", F.when(F.col("linked"), F.col("need_out")).otherwise(need("least")))
    wide = durable(wide.where("need <= d").drop("least", "out_least", "reps"), "open")
    differ = F.concat(F.array_except("hub_set", "rep_set"), F.array_except("rep_set", "hub_set"))
    apart = durable(_meet(wide.select("hub", "rep"), sets).select("hub", "rep", F.explode(differ).alias("key")), "differences")
    often = durable(apart.groupBy("hub", "key").agg(F.count("*").alias("often")).where("often > 1"), "often")
    common = join_by_share(apart, often, ["hub", "key"], "often").groupBy("hub", "rep").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("common"))
    # What only one rep has comes first in the order, so ``left`` is right though it is not listed.
    places = wide.join(common, ["hub", "rep"]).select("*", F.posexplode("common").alias("at", "found")).withColumn("left", F.size("common") - F.col("at"))
    keys = durable(places.where("left >= need").select("hub", F.col("found.key").alias("key"), "rep", "comp", "size", "n", "away", "left", "linked", (F.col("left") >= F.col("need_out")).alias("early")), "keys")
    side = lambda t, s, *own: t.select("hub", "key", *own, *[F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp", "n", "away", "left")])
    out = keys.where("not linked")
    fit = F.expr(
        f"comp_u <> comp_v AND 100L * least(n_u, n_v) >= {percent} * greatest(n_u, n_v)"
        f" AND {100 + percent}L * (least(left_u, left_v) + size) >= away_u + away_v"
    )
    early = out.where("early")
    unlinked = side(early, "u", "size").join(side(early, "v"), ["hub", "key"]).where(F.expr("rep_u < rep_v") & fit)
    mixed = side(out, "u", "size").join(side(keys.where("linked"), "v"), ["hub", "key"]).where(fit)
    return unlinked.select("rep_u", "rep_v").union(mixed.select("rep_u", "rep_v")).select(F.least("rep_u", "rep_v").alias("u"), F.greatest("rep_u", "rep_v").alias("v")).distinct()


def _shared_least(percent: int, n: str) -> str:
    """SQL: the elements that a set of n has at least in common with one at the percentage."""
    return f"(({percent} * {n} + 99) div 100)"


def _met_least(percent: int, n: str) -> str:
    return f"({_shared_least(percent, n)} div {MET} + 1)"


def head_size(percent: int, n: str = "n") -> str:
    """SQL: how many of the least elements of a set of n ``promising`` asks for."""
    return f"cast({n} - {_shared_least(percent, n)} + {_met_least(percent, n)} as int)"


def promising(heads: DataFrame, percent: int) -> DataFrame:
    """``rep``: all that can have a partner at the percentage, and few others, of the written ``rep, n, head`` (``head`` of a set of n).

    Let x share with y all but n(x) - s(x) of its elements or more than that. The
    j-th least of the elements they share is then among the j + n(x) - s(x) least
    of x, so the first k(x) of them are in the head of x, which has n(x) - s(x) +
    k(x), and the first min(k(x), k(y)) in both heads. As y has s(x) elements at
    least and k never falls with n, x has k(s(x)) elements in its head that another
    head has too. Passages that unlike texts share seldom give it so many. Heads
    may hold any function of the elements: equal ones stay equal.
    """
    met = repeated(heads.select("rep", F.explode("head").alias("key"))).groupBy("rep").agg(F.count("*").alias("met"))
    return heads.select("rep", "n").join(met, "rep").where(f"met >= {_met_least(percent, _shared_least(percent, 'n'))}").select("rep").distinct()


def repeated(each: DataFrame) -> DataFrame:
    """The rows of a written table's ``rep, key, ...`` whose key another row has too, with ``often``: how many have it.

    Rows are shuffled once, by key. Keys that hold more than one in PARTS of all
    rows, by the rows of one rep in SAMPLED, stay where they lie, by a broadcast of
    fewer than PARTS, and get the same ``often``, more than any other has.
    """
    sample = durable(each.where(F.pmod(F.xxhash64("rep"), F.lit(SAMPLED)) == 0).groupBy("key").agg(F.count("*").alias("n")), "sample")
    seen = sample.agg(F.sum("n")).first()[0] or 0
    least, tasks = max(1, seen // PARTS), 1 + seen * SAMPLED // ROWS_A_TASK
    hot = sample.where(F.col("n") > least).select("key")
    often = lambda rows: rows.repartition(tasks, "key").withColumn("often", F.count("*").over(Window.partitionBy("key"))).where("often > 1")
    if hot.isEmpty():
        return often(each)
    cold = often(each.join(F.broadcast(hot), "key", "left_anti"))
    return cold.unionByName(each.join(F.broadcast(hot), "key").withColumn("often", F.lit(2**62)))


def prefix_keys(sets: DataFrame, percent: int) -> DataFrame:
    """``key, rep``: of each set, the elements of its prefix that another set has too.

    With all elements in one order, rarest first, two sets at the percentage
    share an element among the first n - ceil(percent * n / 100) + 1 of each.
    Elements that only one set has take places of the prefix but make no key.
    """
    each = sets.select("rep", F.size("shingles").alias("n"), F.explode("shingles").alias("key"))
    ranked = repeated(each).groupBy("rep", "n").agg(F.sort_array(F.collect_list(F.struct("often", "key"))).alias("common"))
    places = F.expr(f"n - {_shared_least(percent, 'n')} + 1 - (n - size(common))").cast("int")
    return ranked.where(places > 0).select("rep", F.explode(F.slice("common", F.lit(1), places)).alias("c")).select("c.key", "rep")


def _meet(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The written pairs ``hub, rep`` with ``hub_set`` and ``rep_set``; the reps of a large star are dealt over copies of the hub's set."""
    fans = durable(pairs.groupBy("hub").agg(F.count("*").alias("n"), F.expr(f"cast(1 + count(*) div {FAN} as int)").alias("fan")), "fans")
    dealt = join_by_share(pairs, fans, ["hub"]).select("hub", "rep", F.pmod(F.xxhash64("rep"), F.col("fan")).cast("int").alias("slot"))
    with_rep = dealt.join(sets.select("rep", F.col("shingles").alias("rep_set")), "rep")
    hubs = fans.join(sets.select(F.col("rep").alias("hub"), F.col("shingles").alias("hub_set")), "hub").withColumn("slot", F.explode(F.sequence(F.lit(0), F.col("fan") - 1))).drop("fan", "n")
    return with_rep.join(hubs, ["hub", "slot"]).drop("slot")
