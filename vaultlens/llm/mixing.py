"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

The documents of a source queue up in a fixed pseudo-random order, up to
``max_repeats`` times over.  Each gets a virtual finish time: the words of its
source up to its end, passes before included, divided by the source's weight.
The queues are served in order of virtual finish until the budget is spent, so
each source that lasts gets words in proportion to its weight, and what a
source that runs out leaves goes to the others by weight.

As in a network, what is queued are packets: a document of more than ``packet``
words is several in a row, each with its own finish time, so a very long one
neither holds up its source nor overshoots its target.  A source's share is
exact to one packet.  The last packet before the budget is taken in part.

The cut is found by ranges of virtual time: words are added up in equal ranges,
a running total over the ranges shows in which one the budget is spent, and
that one is cut into ranges again until what it holds is few enough to be
sorted and summed packet by packet.  No task ever holds more than ``RANGES`` sums
or ``FEW`` packets.  Times are integers, words times the least common multiple of the
weights, so that nothing depends on rounding.  Ties go by source.

Cumulative sums within a source are taken in two levels, over hash ranges of a
source and within each range, so that a source with a third of all rows is
spread over ``16 ** digits`` groups.

Defined cases: null text has size 0; null source is a source of its own,
last in order; a null doc_id is ordered by the empty string's digest; repeated
rows each count; an empty table gives an empty result; columns other than
doc_id, text and source are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vaultlens.llm.common import anonymous, picked, stored

WORD = r"[^\x20\x09-\x0D]+"
PACKET = 256
#: Ranges of virtual time whose sums are compared at once.
RANGES = 10_000
#: Packets that are sorted and summed one by one.
FEW = 10_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def keyed(source: str | Column) -> Column:
    """The source as a key that is never null; null is apart from every text."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit(""))


def source_targets(sized: DataFrame, share: float = 1.0, max_repeats: int = 3, cycle: int = 3) -> DataFrame:
    """source, source_size, weight, target: the budget shared by weight under the caps.

    In ascending order of size by weight, the level that the sources from each
    on would share rises as long as the one before is capped and falls after
    the first that isn't, so its maximum is the level that holds.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    per = per.withColumn("weight", (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % cycle + 1)
    ahead = Window.orderBy(F.col("source_size") / F.col("weight"), F.asc_nulls_last("source")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    cap = F.col("source_size") * max_repeats
    level = (F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum(cap).over(ahead), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0))
    )
    per = per.withColumn("level", level).withColumn("cap", cap)
    per = per.withColumn("cut", F.max("level").over(everything))
    target = F.least(F.col("cap").cast("double"), F.col("cut") * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def queue(docs: DataFrame, targets: DataFrame, digits: int, also: list[str]) -> DataFrame:
    """docs (doc_id, source, size, place) with their sources' columns and start, the words of their source before them."""
    rows = docs.withColumn("bucket", F.substring("place", 1, digits)).withColumn("source_key", keyed("source"))
    ranges = rows.groupBy("source_key", "bucket").agg(F.sum("size").alias("words"))
    before = Window.partitionBy("source_key").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.withColumn("range_start", F.coalesce(F.sum("words").over(before), F.lit(0))).drop("words")
    ranges = ranges.join(targets.withColumn("source_key", keyed("source")).drop("source"), "source_key")
    within = Window.partitionBy("source_key", "bucket").orderBy("place", "doc_id", "size", *also).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start_in_range", F.coalesce(F.sum("size").over(within), F.lit(0)))
    rows = rows.join(ranges, ["source_key", "bucket"])
    return rows.withColumn("start", F.col("range_start") + F.col("start_in_range")).drop("place", "bucket", "range_start", "start_in_range")


def packets(queued: DataFrame, max_repeats: int, packet: int, unit: int) -> DataFrame:
    """finish, source, words of every packet of every pass."""
    rows = queued.where("size > 0").select("source", "source_size", "weight", "start", "size", F.explode(F.sequence(F.lit(1), F.ceil(F.col("size") / packet).cast("int"))).alias("k"))
    rows = rows.select("*", F.least(F.col("size"), F.col("k").cast("long") * packet).alias("to"), F.explode(F.array(*map(F.lit, range(max_repeats)))).alias("turn"))
    end = F.col("turn") * F.col("source_size") + F.col("start") + F.col("to")
    return rows.select((end * (F.lit(unit) / F.col("weight")).cast("long")).alias("finish"), "source", (F.col("to") - (F.col("k") - 1).cast("long") * packet).alias("words"))


def find_cut(queued: DataFrame, budget: int, latest: int, max_repeats: int, packet: int, unit: int) -> tuple[int, str | None, int] | None:
    """(finish, source, words left for it) of the packet at which the budget is spent; None if it never is."""
    every = packets(queued, max_repeats, packet, unit)
    low, high, spent = 0, latest + 1, 0  # packets that finish before low have spent words in all
    while high - low > 1:
        width = -(-(high - low) // RANGES)
        part = every.where((F.col("finish") >= low) & (F.col("finish") < high))
        sums = part.groupBy(F.expr(f"(finish - {low}L) div {width}L").alias("range")).agg(F.sum("words").alias("words"), F.count("*").alias("n"))
        running = F.sum("words").over(Window.orderBy("range"))
        found = sums.select("range", "words", "n", running.alias("until")).where(F.col("until") >= budget - spent).orderBy("range").first()
        if found is None:
            return None
        low, high, spent = low + found.range * width, min(high, low + (found.range + 1) * width), spent + found.until - found.words
        if found.n <= FEW:
            break
    order = Window.orderBy("finish", F.asc_nulls_last("source"))
    last = every.where((F.col("finish") >= low) & (F.col("finish") < high)).withColumn("until", F.sum("words").over(order))
    found = last.where(F.col("until") >= budget - spent).orderBy("finish", F.asc_nulls_last("source")).first()
    return found.finish, found.source, budget - spent - (found.until - found.words)


def plan_mix(docs: DataFrame, share: float = 1.0, max_repeats: int = 3, cycle: int = 3, digits: int = 3, seed: str = "mix", packet: int = PACKET, also: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, virtual_start, virtual_finish, and the columns ``also``, for every row of docs.

    In order of the first pass's virtual finish.  taken counts the words served
    in all passes.
    """
    sized = picked(docs, "doc_id", "source", "text", *also).select("doc_id", "source", *also, word_count(F.col("text")).alias("size"))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = stored(sized.withColumn("place", order), "mix-sizes")
    targets = stored(source_targets(sized, share, max_repeats, cycle), "mix-targets")
    queued = stored(queue(sized, targets, digits, list(also)), "mix-queue")
    unit = math.lcm(*range(1, cycle + 1))
    total = targets.agg(F.sum("source_size").alias("words"), F.max(F.col("source_size") * max_repeats * (F.lit(unit) / F.col("weight")).cast("long")).alias("latest")).first()
    cut = find_cut(queued, math.floor((total.words or 0) * share), total.latest or 0, max_repeats, packet, unit) if total.words else None

    def served(turn: int) -> Column:
        """Words of a row that are taken in a pass."""
        if cut is None:
            return F.col("size")
        finish, source, left = cut
        start = F.lit(turn) * F.col("source_size") + F.col("start")
        end, same = F.expr(f"({finish}L * weight) div {unit}L"), F.col("source").eqNullSafe(F.lit(source))
        before = F.col("source").isNotNull() if source is None else F.coalesce(F.col("source") < F.lit(source), F.lit(False))
        exact = end * F.lit(unit) == F.lit(finish) * F.col("weight")
        end = F.when(exact & ~before, end - 1).otherwise(end)  # where a source has come to by whole packets that go first
        whole = F.when(end >= start + F.col("size"), F.col("size")).when(end <= start, F.lit(0)).otherwise(F.floor((end - start) / packet) * packet)
        in_part = same & (F.lit(finish) * F.col("weight") > start * unit) & (F.lit(finish) * F.col("weight") <= (start + F.col("size")) * unit)
        return whole + F.when(in_part, F.lit(left)).otherwise(F.lit(0))

    taken = sum((served(turn) for turn in range(max_repeats)), F.lit(0))
    rows = queued.select(
        "doc_id", "source", "size", "source_size", "target", taken.cast("long").alias("taken"),
        (F.col("start") / F.col("weight")).alias("virtual_start"), ((F.col("start") + F.col("size")) / F.col("weight")).alias("virtual_finish"), *also,
    )
    return rows.orderBy("virtual_finish", "doc_id")


def schedule(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: the rows of docs, each as often as it is taken, a part of half or more as a whole.

    Rows are matched to the plan by doc_id, source and text.  Rows that are
    alike in all three share what the plan takes of them: the first of them, by
    their other columns, get one copy more than the last where it doesn't divide.
    """
    own, (i, t, s) = anonymous(docs, "doc_id", "text", "source")
    own = own.withColumns({"mix_digest": F.unhex(F.md5(F.coalesce(t, F.lit("")))), "mix_source": keyed(F.col(s).cast("string")), "mix_null": F.col(t).isNull()})
    plan = plan_mix(own.select(F.col(i).alias("doc_id"), F.col(s).alias("source"), F.col(t).alias("text"), "mix_digest", "mix_null"), also=("mix_digest", "mix_null"), **options)
    copies = F.floor(F.sum("taken") / F.greatest(F.sum("size") / F.count("*"), F.lit(1)) + 0.5).cast("long")
    plan = plan.groupBy(F.col("doc_id").alias("mix_id"), keyed(F.col("source").cast("string")).alias("mix_source"), "mix_digest", "mix_null").agg(copies.alias("mix_copies"), F.count("*").alias("mix_rows"))
    plan = stored(plan.where("mix_copies > 0"), "mix-copies")
    rows = own.join(plan, own[i].eqNullSafe(plan["mix_id"]) & (own["mix_source"] == plan["mix_source"]) & (own["mix_digest"] == plan["mix_digest"]) & (own["mix_null"] == plan["mix_null"]))
    columns = [own[f"c{k}"] for k in range(len(docs.columns))]
    once = rows.where("mix_rows = 1").select(*columns, "mix_copies")
    if not plan.where("mix_rows > 1").isEmpty():
        alike = rows.where("mix_rows > 1").select(*columns, "mix_id", own["mix_source"], own["mix_digest"], own["mix_null"], "mix_copies", "mix_rows")
        rank = F.row_number().over(Window.partitionBy("mix_id", "mix_source", "mix_digest", "mix_null").orderBy(F.to_json(F.struct(*columns))))
        share = F.floor(F.col("mix_copies") / F.col("mix_rows")) + (rank <= F.col("mix_copies") % F.col("mix_rows")).cast("long")
        once = once.unionByName(alike.withColumn("mix_copies", share).where("mix_copies > 0").select(*once.columns))
    out = once.withColumn("mix_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix_copies")))).drop("mix_copies", "mix_copy")
    return out.toDF(*docs.columns)
