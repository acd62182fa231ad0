"""Mixing sources to target weights by Pfair scheduling, with DataFrame operations only.

Each source's documents, in an order fixed by a hash of doc_id, form blocks of ``block`` documents; a slot of the
mix takes one block.  A target weight is an exact fraction q / S, with whole numbers q for each source and their sum
S: given weights are read as decimals and brought to a common denominator, otherwise q is the whole part of
n ** (1 / temperature), at least 1.  Block k of a source is released at slot floor(k S / q) and due by slot
ceil((k + 1) S / q); at each slot the released block with the earliest deadline goes next.  Such windows can all be
met on one sequence, so after any number of slots every source is less than one block off its target weight.  After
S slots all sources are exactly on target, so the schedule of one period of S slots is all that is computed.

A period has at most ``period`` slots (four for each source, if that is more).  Fractions that need a longer one are
rounded to multiples of 1 / period first, by largest remainders and at least one; the guarantee then holds for the
rounded weights, which are less than 1 / period off.

The schedule is a small table, whatever the input; every document finds its slot from its rank in its source: rank
by (source, first digits of the hash) and an offset for each such group.  There are as many digits as keep a group near
``GROUP`` documents, so that no source is ranked in one task; what is ranked are ids and hashes, to which the rows are
joined afterwards.

All documents keep their row.  When a source has run out, its later slots stay empty and the others go on at their
own rates; ``in_mix`` marks the documents before the first such slot, to which the guarantee applies.

Defined cases: a null source is a source of its own; a null text is like any; rows with a null doc_id are ordered by
a hash of their columns; rows that repeat a doc_id have adjacent ranks, ordered by that hash; weights for sources
without documents are left out; sources without a weight, or with one of 0 or less, have no slot (mix_slot is null,
in_mix false), and if no source has one, none has a slot; more than ``MAX_SOURCES`` sources raise; other columns are
carried along, those named like an added one are replaced; an empty table gives no rows.
"""

from __future__ import annotations

from fractions import Fraction
from math import gcd, lcm

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestrand.llm.scratch import table, without

ADDED = ("mix_block", "mix_slot", "mix_place", "in_mix")
#: What is broadcast has a row for each source and each slot of a period.
MAX_SOURCES = 1 << 14
#: Documents of a group that is ranked in one task, at most about.
GROUP = 1 << 22
_KEY = 1 << 20
_CHUNK = 256


def whole_weights(weights: dict[str, float]) -> dict[str, int]:
    """Whole numbers in the ratio of the given weights; those of 0 or less are left out."""
    exact = {s: Fraction(str(w)) for s, w in weights.items() if w > 0}
    if not exact:
        return {}
    unit = lcm(*[f.denominator for f in exact.values()])
    whole = {s: int(f * unit) for s, f in exact.items()}
    down, total = gcd(*whole.values()), sum(whole.values())
    # Far beyond any period: near enough in 40 bits, as the quotas are rounded anyhow.
    return {s: w // down if total // down < 1 << 40 else max(1, (w << 40) // total) for s, w in whole.items()}


def quotas(counts: DataFrame, weights: dict[str, float] | None, temperature: float, period: int) -> DataFrame:
    """(src, n, i, q, total): q slots in a period of ``total`` for each source that has a weight."""
    if weights is not None:
        given = [F.lit(x) for kv in whole_weights(weights).items() for x in kv]
        q = F.element_at(F.create_map(*given), F.col("src")) if given else F.lit(None)
    else:
        q = F.greatest(F.floor(F.sqrt("n") if temperature == 2 else F.pow(F.col("n").cast("double"), F.lit(1.0 / temperature))), F.lit(1))
    all_ = Window.partitionBy(F.lit(1))
    rows = counts.withColumn("a", q.cast("long")).where("a > 0").withColumn("i", F.row_number().over(all_.orderBy("src")) - 1)
    rows = rows.withColumn("many", F.count("*").over(all_)).withColumn("s", F.sum("a").over(all_))
    # Largest remainders; each source has one slot beforehand.
    most = F.greatest(F.lit(period), F.col("many") * 4)
    rows = rows.withColumn("most", most).withColumn("exact", F.col("a") / F.col("s") * (F.col("most") - F.col("many"))).withColumn("base", F.floor("exact"))
    left = F.col("most") - F.col("many") - F.sum("base").over(all_)
    place = F.row_number().over(all_.orderBy((F.col("exact") - F.col("base")).desc(), "i"))
    rounded = F.col("base") + 1 + F.when(place <= left, 1).otherwise(0)
    fits = F.col("s") <= F.col("most")
    return rows.select("src", "n", "i", F.when(fits, F.col("a")).otherwise(rounded).cast("long").alias("q"), F.when(fits, F.col("s")).otherwise(F.col("most")).cast("long").alias("total"))


def schedule(quota: DataFrame) -> DataFrame:
    """(i, k, s): slot s of the k-th block of source i in a period, by earliest deadline first.

    A fold over the slots, whose state is each source's next block.  The slots are folded in chunks, so that what is
    appended to stays short.
    """
    one = quota.groupBy("total").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "q"))), lambda x: x["q"]).alias("q"))
    total = F.col("total")

    def block(i: Column, k: Column, q: Column) -> Column:
        """Its release, and its deadline with the source's number as the tie-break."""
        due = F.call_function("div", (k + 1) * total + q - 1, q)
        return F.struct(F.call_function("div", k * total, q).alias("release"), (due * _KEY + i).alias("key"), k.alias("k"))

    def slot(acc: Column, t: Column) -> Column:
        pick = F.array_min(F.transform(acc["next"], lambda b: F.when(b["release"] <= t, b["key"]))) % _KEY
        after = F.transform(acc["next"], lambda b, j: F.when(j == pick, block(pick, b["k"] + 1, F.get("q", pick.cast("int")))).otherwise(b))
        chosen = F.struct(pick.cast("int").alias("i"), F.get(acc["next"], pick.cast("int"))["k"].alias("k"), t.alias("s"))
        return F.struct(after.alias("next"), F.array_append(acc["out"], chosen).alias("out"))

    empty = F.array().cast("array<struct<i:int,k:bigint,s:bigint>>")

    def chunk(acc: Column, c: Column) -> Column:
        slots = F.sequence(c * _CHUNK, F.least(total, (c + 1) * _CHUNK) - 1)
        done = F.aggregate(slots, F.struct(acc["next"].alias("next"), empty.alias("out")), slot)
        return F.struct(done["next"].alias("next"), F.array_append(acc["out"], done["out"]).alias("out"))

    start = F.struct(F.transform(F.col("q"), lambda q, i: block(i.cast("long"), F.lit(0).cast("long"), q)).alias("next"), F.array().cast("array<array<struct<i:int,k:bigint,s:bigint>>>").alias("out"))
    chunks = F.sequence(F.lit(0).cast("long"), F.call_function("div", total - 1, F.lit(_CHUNK).cast("long")))
    return one.select(F.explode(F.flatten(F.aggregate(chunks, start, chunk, lambda acc: acc["out"]))).alias("x")).select("x.*")


def _tie(docs: DataFrame) -> Column:
    """A hash of a row's columns; those that can't be hashed are taken as JSON."""
    hashed = lambda f: "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    return F.xxhash64(*[docs[f"`{f.name}`"] if hashed(f) else F.to_json(docs[f"`{f.name}`"]) for f in docs.schema.fields])


def mix(docs: DataFrame, weights: dict[str, float] | None = None, temperature: float = 2.0, block: int = 64, period: int = 1 << 16) -> DataFrame:
    """``docs`` with mix_block (in its source), mix_slot, mix_place (in the block) and in_mix; order by slot and place."""
    docs = without(docs, *ADDED)
    names = docs.columns
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in names]).alias("_row"), F.col("source").alias("src"), _tie(docs).alias("t"), F.col("doc_id").alias("d"))
    many, digits = docs.count(), 2
    while many >> 4 * digits > GROUP:
        digits += 1
    # Equal rows are one key with their number.
    keys = rows.groupBy("src", "d", "t").agg(F.count("*").alias("m")).withColumn("h", F.md5(F.coalesce(F.col("d"), F.col("t")).cast("string")))
    keys = table(keys.withColumn("g", F.substring("h", 1, digits)), "mix_keys")
    groups = table(keys.groupBy("src", "g").agg(F.sum("m").alias("n")), "mix_groups")
    before = Window.partitionBy("src").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    offsets = groups.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).select("src", "g", "before")
    counts = groups.groupBy("src").agg(F.sum("n").alias("n"))
    if (many := counts.count()) > MAX_SOURCES:
        raise ValueError(f"{many} sources; at most {MAX_SOURCES} can be mixed")
    plan = table(quotas(counts, weights, temperature, period), "mix_quotas")
    slots = table(schedule(plan), "mix_schedule")
    # The first slot whose source has no block left, and the period's length: two numbers.
    ends = plan.withColumn("blocks", F.ceil(F.col("n") / F.lit(block))).join(slots, (plan["i"] == slots["i"]) & (F.col("blocks") % F.col("q") == F.col("k")))
    end, total = ends.agg(F.min(F.expr("(blocks div q) * total + s")), F.max("total")).first()
    named = lambda df: df.select(F.col("src").alias("src2"), *[c for c in df.columns if c != "src"])
    earlier = Window.partitionBy("src", "g").orderBy("h", "d", "t").rowsBetween(Window.unboundedPreceding, -1)
    ranked = keys.withColumn("r", F.coalesce(F.sum("m").over(earlier), F.lit(0)))
    o = named(offsets).withColumnRenamed("g", "g2")
    ranked = ranked.join(o, F.col("src").eqNullSafe(F.col("src2")) & (F.col("g") == F.col("g2"))).withColumn("r", F.col("r") + F.col("before"))
    # Written, so that the join has exchanges on both sides and the rows of a frequent key can be split.
    ranked = table(ranked.select("src", "d", "t", "m", "r"), "mix_ranks")
    same = lambda a, b: a["t"].eqNullSafe(b["t"]) & a["d"].eqNullSafe(b["d"]) & a["src"].eqNullSafe(b["src"])
    once, often = ranked.where("m = 1"), ranked.where("m > 1")
    placed = rows.join(once, same(rows, once)).select("_row", once["src"], once["r"])
    if not often.isEmpty():
        # Equal rows are told apart by their number alone, so one of them stands for all.
        one = rows.join(often, same(rows, often)).groupBy(often["src"], often["d"], often["t"], often["m"], often["r"]).agg(F.first("_row").alias("_row"))
        placed = placed.unionByName(one.select("_row", "src", F.explode(F.sequence(F.col("r"), F.col("r") + F.col("m") - 1)).alias("r")))
    ranked = placed.withColumn("b", F.expr(f"r div {block}"))
    # A row for each source, and one for each slot of a period: bounded by MAX_SOURCES and the period.
    ranked = ranked.join(F.broadcast(named(plan.select("src", "i", "q"))), F.col("src").eqNullSafe(F.col("src2")), "left")
    ranked = ranked.withColumn("k", F.col("b") % F.col("q")).join(F.broadcast(slots), ["i", "k"], "left")
    slot = F.expr(f"(b div q) * {total or 0}L + s")
    return ranked.select(
        "_row.*",
        F.col("b").cast("long").alias("mix_block"),
        slot.cast("long").alias("mix_slot"),
        (F.col("r") % block).cast("long").alias("mix_place"),
        F.coalesce(slot < F.lit(end).cast("long"), F.lit(False)).alias("in_mix"),
    )
