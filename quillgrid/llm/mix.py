"""Mixing sources to target weights by a low-discrepancy schedule.

Each source asks for a number of equal-token blocks.  Slot k of the schedule takes the k-th van der
Corput point; the source whose stretch of the cumulative block counts holds the point owns the slot.
The rank of a slot among its source's slots follows from k alone (digits of k), so the schedule needs no
sort.  A source's documents, in shuffled order and repeated as often as its target asks, are cut into
blocks, and block r goes to the source's slot of rank r.

Edge cases: null text has size 0; null sources are one source, last in order; a null doc_id is a document
like any other; repeated rows are separate documents; an empty table gives an empty mix; only the named
columns are read, so extra columns never clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillgrid import ship
from quillgrid.llm.common import ROW, n_words, packed, settled, small, unpacked
from quillgrid.plans.session import accumulated

#: Rows of a shuffled source that one task sums up, on average.
STRIPE_ROWS = 1_000


def targets(sizes: DataFrame, weights: list[float], share: float, most: float) -> DataFrame:
    """source, place, rows, source_size, target of each source of (source, size, n).

    Sources are ordered by code point, null last, and take the weights in turn.  They share share x all
    sizes by weight; none gets above most x its size, and what it would get above goes to the others.
    The level at which sources fill up follows from running sums over the sources by size / weight, so
    no rounds are needed, and no task sees all sources."""
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.sum("n").alias("rows"))
    named = [F.col("source").isNull(), F.col("source")]
    per = accumulated(per, named, place=F.lit(1).cast("long"))
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    per = settled(per.withColumns({"weight": w, "cap": F.col("source_size") * float(most)}))
    size, weight = per.agg(F.sum("source_size"), F.sum("weight")).first()
    per = accumulated(per, [F.col("cap") / F.col("weight"), F.col("place")], spent=F.col("cap"), above=F.col("weight"))
    # a source is full if the level at which it and all after it share the rest reaches its cap; past the first that is not, levels only sink
    level = (F.lit(float(size or 0) * float(share)) - F.col("spent")) / F.greatest(F.lit(float(weight or 0)) - F.col("above"), F.col("weight"))
    per = settled(per.withColumn("level", level).withColumn("full", F.col("level") * F.col("weight") >= F.col("cap")))
    top = per.agg(F.max(F.when(~F.col("full"), F.col("level")))).first()[0]
    target = F.when(F.col("full"), F.col("cap")).otherwise(F.least(F.lit(top).cast("double") * F.col("weight"), F.col("cap")))
    return per.select("source", "place", "rows", "source_size", target.alias("target"))


def below(k: Column, x: Column, bits: int) -> Column:
    """How many of the points 0 .. k-1 of the van der Corput sequence, times 2^bits, are below x.  For each digit 1 of k, the points that share the digits above it are an arithmetic progression."""
    total = F.lit(0).cast("long")
    for i in range(bits + 1):
        digit = F.shiftright(k, i).bitwiseAND(F.lit(1))
        head = F.shiftright(k, i + 1) * 2  # the digits above i, then 0
        step = F.lit(1 << (bits - i)).cast("long")
        first = reversed_bits(head, bits - i) if i < bits else F.lit(0).cast("long")
        count = F.greatest(F.lit(0).cast("long"), F.least(F.lit(1 << i).cast("long"), F.floor((x - first + step - 1) / step).cast("long")))
        total = total + F.when(digit == 1, count).otherwise(F.lit(0))
    return total


def reversed_bits(k: Column, bits: int) -> Column:
    """The lowest bits of k in reverse order."""
    if not bits:
        return F.lit(0).cast("long")
    return F.conv(F.reverse(F.lpad(F.bin(k.bitwiseAND(F.lit((1 << bits) - 1))), bits, "0")), 2, 10).cast("long")


def slots(shares: DataFrame, total: int) -> DataFrame:
    """slot, place, rank: the schedule for shares (place, first, count), where count blocks from first on are the place's part of all total blocks."""
    spark = shares.sparkSession
    bits = max(1, (max(total, 2) - 1).bit_length())
    line = spark.range(1 << bits).select(F.col("id").alias("slot"), reversed_bits(F.col("id"), bits).alias("point"))
    # 4096 equal stretches of the line: a stretch names the few sources that it meets, so the join is by key
    width = max(1, (1 << bits) >> 12)
    shares = shares.filter("count > 0").select("place", "first", "count")
    stretches = shares.withColumn("stretch", F.explode(F.sequence(F.floor(F.col("first") / width), F.floor((F.col("first") + F.col("count") - 1) / width))))
    met = line.withColumn("stretch", F.floor(F.col("point") / width)).join(stretches, "stretch")
    met = met.filter((F.col("point") >= F.col("first")) & (F.col("point") < F.col("first") + F.col("count")))
    rank = below(F.col("slot"), F.col("first") + F.col("count"), bits) - below(F.col("slot"), F.col("first"), bits)
    return met.select("slot", "place", rank.alias("rank"))


def place_of(seed: str) -> Column:
    """Where a document (doc_id, text) stands in its source's shuffled order."""
    return F.xxhash64(F.lit(seed), "doc_id", F.coalesce("text", F.lit("")))


def mixed(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, block: int = 4096, seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """(documents, pieces) of the mix of docs (doc_id, text, source).

    documents: doc_id, size, place (of its source), source_size, target, row (its key), shuffle and at (where it begins in its source's order), one row per row of docs.
    pieces: row, slot, pass, start, stop: words [start, stop) of the document's pass-th use, in order of slot.
    A source's last block ends at its target, so it takes its target to the word; a document is used at most most times."""
    ship(docs.sparkSession)
    base = docs.select("doc_id", "source", n_words(F.coalesce("text", F.lit(""))).alias("size"), place_of(seed).alias("shuffle"))
    base = settled(base.withColumn("row", F.monotonically_increasing_id()))
    aim = settled(targets(base.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")), weights, share, most))
    # blocks that each source asks for, and its stretch of the line
    asked = F.ceil(F.floor(F.col("target")) / block).cast("long")
    aim = settled(accumulated(aim.withColumn("count", asked), [F.col("place")], first=F.col("count"), offset=F.col("source_size")))
    total = aim.agg(F.sum("count")).first()[0] or 0
    schedule = slots(aim, total)

    # where each document starts in its source's shuffled stream: sums within stripes of the order, then over the stripes
    n_stripes = F.greatest(F.lit(1), F.ceil(F.col("rows") / STRIPE_ROWS)).cast("long")
    by_source = base.join(small(aim.select(F.col("source").alias("s"), "place", "source_size", "target", "offset", n_stripes.alias("stripes"))), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    stripe = F.floor((F.col("shuffle").bitwiseAND(F.lit((1 << 48) - 1)) * F.col("stripes")) / float(1 << 48)).cast("long")
    striped = by_source.withColumn("stripe", stripe)
    sums = accumulated(striped.groupBy("place", "stripe").agg(F.sum("size").alias("part")), [F.col("place"), F.col("stripe")], ahead=F.col("part"))
    sums = settled(sums).select(F.col("place").alias("p"), F.col("stripe").alias("t"), "ahead")
    within = Window.partitionBy("place", "stripe").orderBy(F.col("shuffle").bitwiseAND(F.lit((1 << 48) - 1)), "shuffle", "doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = striped.withColumn("inside", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(sums, (F.col("place") == F.col("p")) & (F.col("stripe") == F.col("t"))).withColumn("at", F.col("ahead") - F.col("offset") + F.col("inside"))
    documents = settled(placed.select("row", "doc_id", "shuffle", "size", "place", "source_size", "target", "at"))

    # each use of a document, cut by blocks
    uses = documents.filter("size > 0").withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(int(most) - 1)))).withColumn("at", F.col("at") + F.col("pass") * F.col("source_size"))
    uses = uses.withColumn("end", F.least(F.col("at") + F.col("size"), F.floor("target"))).filter("at < end")
    cut = uses.withColumn("rank", F.explode(F.sequence(F.floor(F.col("at") / block), F.floor((F.col("end") - 1) / block))))
    cut = cut.select(
        "row",
        "place",
        "rank",
        "pass",
        (F.greatest(F.col("at"), F.col("rank") * block) - F.col("at")).alias("start"),
        (F.least(F.col("end"), (F.col("rank") + 1) * block) - F.col("at")).alias("stop"),
    )
    pieces = cut.join(schedule, ["place", "rank"]).select("row", "slot", "pass", "start", "stop")
    return documents, pieces


def taken(documents: DataFrame, pieces: DataFrame) -> DataFrame:
    """documents with taken, the words that the mix takes of each, repeats counted, and first_slot, where in the mix it first stands."""
    sums = pieces.groupBy("row").agg(F.sum(F.col("stop") - F.col("start")).alias("taken"), F.min("slot").alias("first_slot"))
    return documents.join(sums, "row", "left").withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))


def whole(documents: DataFrame, pieces: DataFrame, rounds: int = 2) -> DataFrame:
    """row, slot: uses of whole documents only, with the first slot of each.

    The one use of a source that its target cuts is left out, and the documents after it in the order move up; so many
    times.  What is lacking then is filled, as many times, by the longest document that fits and is not yet used in the
    last pass."""
    of = documents.select("row", "shuffle", "size", "place", "at")
    uses = settled(pieces.groupBy("row", "pass").agg(F.min("slot").alias("slot"), F.sum(F.col("stop") - F.col("start")).alias("words")).join(of, "row"))
    full = uses.filter("words = size")
    # of each source: the pass that its target ends in, where the documents that may move up begin, and the words that are lacking
    open_ = settled(uses.filter("words < size").select("place", F.col("pass").alias("last"), F.col("slot").alias("there"), (F.col("at") + F.col("size")).alias("from"), F.col("words").alias("gap")))
    used = full.groupBy("row").agg(F.count("*").alias("times"))
    left = of.join(small(open_.select("place", "last")), "place").join(used, "row", "left").filter("size > 0 AND coalesce(times, 0) <= last").select("row", "shuffle", "size", "place", "at")
    out = full.select("row", "slot")
    for k in range(2 * rounds):
        fits = left.join(small(open_), "place")
        if k < rounds:
            fits = fits.filter("at >= from").withColumn("inside", F.expr("at - from + size <= gap"))
            after = fits.groupBy("place").agg(F.coalesce(F.sum(F.when(F.col("inside"), F.col("size"))), F.lit(0)).alias("taken"), F.min(F.when(~F.col("inside"), F.col("at") + F.col("size"))).alias("next"))
            chosen = fits.filter("inside").select("row", "there")
            changed = open_.join(after, "place", "left").select("place", "last", "there", F.coalesce("next", F.lit((1 << 62))).alias("from"), (F.col("gap") - F.coalesce("taken", F.lit(0))).alias("gap"))
        else:
            best = settled(fits.filter("size <= gap").groupBy("place").agg(F.max(F.struct("size", "shuffle", "row")).alias("best")))
            chosen = open_.join(best, "place").select(F.col("best.row").alias("row"), "there")
            changed = open_.join(best, "place").select("place", "last", "there", "from", (F.col("gap") - F.col("best.size")).alias("gap"))
        chosen = settled(chosen)
        out = out.union(chosen.select("row", F.col("there").alias("slot")))
        left = left.join(chosen.select("row"), "row", "left_anti")
        open_ = settled(changed.filter("gap > 0"))
    return out


def repeated(docs: DataFrame, weights: list[float], share: float = 1.5, most: int = 2, block: int = 4096, seed: str = "mix") -> DataFrame:
    """The mix as whole documents, in order of slots: each row of docs as often as whole() uses it.

    Rows equal in doc_id and text share their uses evenly, rounded; wordless ones are never used."""
    documents, pieces = mixed(docs, weights, share, most, block, seed)
    pieces = settled(pieces)
    uses = whole(documents, pieces).groupBy("row").agg(F.sort_array(F.collect_list("slot")).alias("slots"))
    uses = documents.join(uses, "row", "left").groupBy(F.col("doc_id").alias("__id"), F.col("shuffle").alias("__place")).agg(F.count("*").alias("__n"), F.sort_array(F.flatten(F.collect_list("slots"))).alias("__slots"))
    each = F.round(F.size("__slots") / F.col("__n")).cast("int")
    uses = uses.select("__id", "__place", F.slice("__slots", F.lit(1), each).alias("__slots")).filter("size(__slots) > 0")
    rows = docs.select(packed(docs), F.col("doc_id").alias("__of"), place_of(seed).alias("__at"))
    rows = rows.join(uses, F.col("__of").eqNullSafe(F.col("__id")) & (F.col("__at") == F.col("__place"))).select(ROW, F.explode("__slots").alias("__slot"))
    # equal stretches of slots, one after the other, as slots are even: no sample of the rows is needed to cut them
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    end = (pieces.agg(F.max("slot")).first()[0] or 0) + 1
    rows = rows.repartitionById(n, F.floor(F.col("__slot") * n / end).cast("int")).sortWithinPartitions("__slot", F.xxhash64(f"{ROW}.doc_id"))
    return unpacked(rows.select(ROW))
