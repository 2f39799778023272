"""Mixing collections to target weights by dependent rounding of copy counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rastermill.llm.frames import WORD
from rastermill.plans.ordered import global_row_number, running_sum
from rastermill.session import pin

FAN = 64  # rows that one node of the reduction tree combines
LARGE = 256  # largest rows of a collection, which are rounded against all of its other rows together
RESERVE = 64  # of the others, rows evenly over the sizes that wait for the root of the tree
TRIES = 16  # roundings of such a last list, of which the one that ends nearest the target is taken


def word_count(text: str | Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def collection_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3) -> DataFrame:
    """``target`` per row of ``sizes(collection, source_size)``: shares by weight, none above ``most`` times its size.

    Collections in code point order, null last, take the weights in turn. The
    excess over a limit is shared again by weight; the level of that filling is
    the largest quotient of what is left over the weights that are left, along
    the order in which collections reach their limit.
    """
    ranked = global_row_number(sizes, [F.col("collection").asc_nulls_last()], "_rank")
    turn = F.element_at(F.array(*(F.lit(w) for w in weights)), (F.pmod(F.col("_rank") - 1, F.lit(len(weights))) + 1).cast("int"))
    limited = ranked.withColumn("_weight", turn.cast("bigint")).withColumn("_limit", F.col("source_size") * most)
    order = [(F.col("_limit") / F.col("_weight")).asc(), F.col("_rank").asc()]
    filled = running_sum(running_sum(limited, order, "_limit", "_limits"), order, "_weight", "_weights")
    filled = pin(filled)
    total, weight = filled.agg(F.sum("source_size"), F.sum("_weight")).first()
    left = F.lit(total or 0) - (F.col("_limits") - F.col("_limit"))
    level = filled.agg(F.max(left / (F.lit(weight or 0) - (F.col("_weights") - F.col("_weight"))))).first()[0]
    target = F.least(F.col("_limit").cast("double"), F.lit(float(level or 0)) * F.col("_weight"))
    return filled.select("collection", "source_size", target.alias("target"))


def mix_collections(
    items: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = 3, id: str = "id", collection: str = "collection",
    size: str = "size", seed: int = 17,
) -> DataFrame:
    """How often a mix takes each catalogue item, so that collections come near their share of all ``size``.

    Returns ``id, collection, size, source_size, target, copies, taken`` with
    ``taken = copies * size``, one row per item. An item of a collection is due
    ``target / source_size`` copies: the whole part is taken, the fraction is
    rounded by pivotal sampling. Two items of a collection exchange mass
    (fraction times size) at random, the expected mass of each unchanged, until
    one of them is taken whole or not at all; the other goes on. The largest items
    of a collection come first: each meets all smaller ones as one, whose mass is
    what these then share. The others are rounded side by side, in groups
    of neighbours by size, and what each group leaves over climbs a reduction
    tree; an even share of them, large to small, waits for its root. Both lists,
    of the largest and at the root, are rounded a fixed number of times with other
    random numbers; the rounding that ends nearest the target stays, and its last
    item, the only one still open, goes to the nearer side. No task sees more
    than such a list or a group at once.

    Random numbers are hashes of the ids, so reruns agree. A null collection is
    a collection of its own, the last in order; a null size counts as 0 and takes
    nothing; null ids and repeated rows are rounded like any other row. Other
    columns are ignored, whatever their names. An empty table gives an empty result.
    """
    rows = items.select(
        F.col(id).alias("id"), F.col(collection).cast("string").alias("collection"), F.coalesce(F.col(size), F.lit(0)).cast("bigint").alias("size")
    )
    rows = pin(rows)
    filled = F.count(F.when(F.col("size") > 0, 1)).alias("_rows")
    sizes = pin(rows.groupBy("collection").agg(F.sum("size").alias("source_size"), filled))
    targets = collection_targets(sizes.select("collection", "source_size"), weights, most)
    due = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    plan = targets.withColumn("_due", due).withColumnRenamed("collection", "_c")
    counts = sizes.select(F.col("collection").alias("_d"), "_rows")
    plan = plan.join(counts, F.col("_c").eqNullSafe(F.col("_d"))).drop("_d")
    plan = plan.withColumn("_rows", F.when(F.col("_due") > F.floor("_due"), F.col("_rows")).otherwise(0))
    plan = pin(running_sum(plan, [F.col("_c").asc_nulls_last()], "_rows", "_end").withColumn("_begin", F.col("_end") - F.col("_rows")).drop("_end"))
    planned = rows.join(plan, F.col("collection").eqNullSafe(F.col("_c"))).drop("_c")
    planned = planned.withColumn("copies", F.floor("_due").cast("int")).withColumn("_open", (F.col("_due") > F.floor("_due")) & (F.col("size") > 0))
    whole = planned.filter(~F.col("_open"))
    # rows alike in everything are told apart by their place, so that no group holds more than its share of them
    open_rows = planned.filter("_open").withColumn("_hash", F.xxhash64(F.lit(seed), "id", "size")).withColumn("_place", F.monotonically_increasing_id())
    order = [F.col("collection").asc_nulls_last(), F.col("size").desc(), F.col("_hash").asc(), F.col("_place").asc()]
    ranked = global_row_number(open_rows, order, "_nth").withColumn("_rank", F.col("_nth") - 1 - F.col("_begin"))
    part = F.col("_due") - F.floor("_due")
    keys = ["collection", "source_size", "target", "copies"]
    ranked = pin(ranked.select(*keys, "size", "_hash", "id", "_rank", "_rows", part.alias("_part")))

    def row(part: Column, real: bool = True) -> Column:
        return F.struct(F.lit(real).alias("real"), "size", F.col("_hash").alias("hash"), "id", (part * F.col("size")).alias("mass")).alias("_row")

    heads = ranked.filter(F.col("_rank") < LARGE).select(*keys, row(F.col("_part")))
    others = ranked.filter(F.col("_rank") >= LARGE)
    kind = ranked.schema["id"].dataType
    one = others.groupBy(*keys).agg(F.sum("size").alias("size"), F.first("_part").alias("_part"))  # all rows of a collection have one part
    one = one.withColumn("_hash", F.xxhash64(F.lit(seed), "collection")).withColumn("id", F.lit(None).cast(kind))
    ends = pin(_ends(heads.unionByName(one.select(*keys, row(F.col("_part"), False))), keys, seed - 1))
    shares = ends.filter("NOT row.real").select(F.col("collection").alias("_c"), F.col("part").alias("_share"))
    # one row per collection on the right; it has at most as many rows as the plan
    others = others.join(shares, F.col("collection").eqNullSafe(F.col("_c"))).drop("_c")
    decided = (F.col("_share") <= 0) | (F.col("_share") >= 1)
    settled = [
        ends.filter("row.real").select(*keys, "row.size", "row.id", "up"),
        others.filter(decided).select(*keys, "size", "id", F.col("_share").cast("int").alias("up")),
    ]
    rank = F.col("_rank") - LARGE
    stride = F.ceil((F.col("_rows") - LARGE) / F.lit(RESERVE)).cast("bigint")
    others = others.filter(~decided).select(*keys, rank.alias("_rank"), (F.pmod(rank, stride) == stride - 1).alias("_waits"), row(F.col("_share")))
    waiting = others.filter("_waits").select(*keys, "_row")
    level = others.filter("NOT _waits").select(*keys, F.floor(F.col("_rank") / FAN).alias("_group"), "_row")

    most_rows = (plan.agg(F.max("_rows")).first()[0] or 0) - LARGE
    most_groups = -(-most_rows // FAN) if most_rows > RESERVE else 0  # else all rows wait for the root
    step = 0
    while most_groups:
        rounded = level.groupBy(*keys, "_group").agg(F.collect_list("_row").alias("_rows")).select(
            *keys, "_group", _exchange(F.sort_array("_rows", asc=False), F.lit(seed + step)).alias("_r")
        )
        rounded = pin(rounded)
        settled.append(rounded.select(*keys, F.explode("_r.settled").alias("_s")).select(*keys, "_s.row.size", "_s.row.id", "_s.up"))
        level = rounded.select(*keys, F.floor(F.col("_group") / FAN).alias("_group"), F.col("_r.left").alias("_row"))
        if most_groups == 1:
            break
        most_groups, step = -(-most_groups // FAN), step + 1
    if most_rows > 0:
        roots = _ends(waiting.unionByName(level.select(*keys, "_row")), keys, seed - 1 - TRIES)
        settled.append(roots.select(*keys, "row.size", "row.id", "up"))
    out = whole.select(*keys, "size", "id", F.lit(0).alias("up"))
    for part in settled:
        out = out.unionByName(part)
    copies = F.col("copies") + F.col("up")
    return out.select(
        F.col("id").alias(id), F.col("collection").alias(collection), F.col("size").alias(size), "source_size", "target",
        copies.alias("copies"), (copies * F.col("size")).cast("bigint").alias("taken"),
    )


def _ends(rows: DataFrame, keys: list[str], seed: int) -> DataFrame:
    """``keys, row, up, part``: rows of short lists rounded, of ``TRIES`` roundings by the one that ends nearest.

    A row that is not ``real`` stands for all further rows and comes last; its ``part`` is what they share.
    """
    lists = rows.groupBy(*keys).agg(F.sort_array(F.collect_list("_row"), asc=False).alias("_rows"))
    best = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(TRIES - 1)), lambda k: _against_others(F.col("_rows"), F.lit(seed) - k, k)))
    return lists.select(*keys, best["done"].alias("_done")).select(*keys, F.explode("_done").alias("_s")).select(*keys, "_s.row", "_s.up", "_s.part")


def _against_others(rows: Column, seed: Column, k: Column) -> Column:
    """Let every row of a list meet all smaller ones as one: ``(off, k, done)``, ``done`` with ``row, up, part``.

    Others that give mass give in proportion to their own, others that take it
    take in proportion to their room, so what they hold now is ``a`` times their
    first mass and ``b`` times their size. Once the others are all taken whole or
    not at all, the row they met is the one left open.
    """

    def meet(state: Column, r: Column) -> Column:
        size, others = r["size"].cast("double"), state["size"] - r["size"]
        first = F.struct(
            (state["a"] * r["mass"] + state["b"] * size).alias("own"), others.alias("size"), (state["mass"] - r["mass"]).alias("mass"),
            (state["a"] * (state["mass"] - r["mass"]) + state["b"] * others).alias("held"), _uniform(seed, r["hash"], F.lit(0)).alias("u"),
        )

        def drawn(d: Column) -> Column:
            # what the row can gain from the others, and they from it
            gain = F.greatest(F.least(size - d["own"], d["held"]), F.lit(0.0))
            loss = F.greatest(F.least(d["own"], d["size"] - d["held"]), F.lit(0.0))
            up = d["u"] * (gain + loss) < loss
            last = d["size"] <= 0
            own = F.when(last, d["own"]).when(up, d["own"] + gain).otherwise(d["own"] - loss)
            ended = F.when(up, size - d["own"] <= d["held"]).otherwise(d["own"] <= d["size"] - d["held"])
            part = F.when(~last & ended, F.when(up, 1.0).otherwise(0.0)).otherwise(F.least(F.greatest(own / size, F.lit(0.0)), F.lit(1.0)))
            # the others hold c times their mass, or leave c times their room
            c = F.when(last | (gain + loss <= 0), 1.0).when(up, (d["held"] - gain) / d["held"]).otherwise((d["size"] - d["held"] - loss) / (d["size"] - d["held"]))
            return F.struct(d["size"].alias("size"), d["mass"].alias("mass"), up.alias("up"), part.alias("part"), c.alias("c"))

        def after(e: Column) -> Column:
            done = F.struct(r.alias("row"), (e["part"] * 2 >= 1).cast("int").alias("up"), e["part"].alias("part"))
            off = F.when(r["real"], F.least(e["part"], 1 - e["part"]) * size).otherwise(0.0)
            return F.struct(
                e["size"].alias("size"), e["mass"].alias("mass"), (state["a"] * e["c"]).alias("a"),
                F.when(e["up"], state["b"] * e["c"]).otherwise(state["b"] * e["c"] + 1 - e["c"]).alias("b"),
                (state["off"] + off).alias("off"), F.concat(state["done"], F.array(done)).alias("done"),
            )

        return F.transform(F.transform(F.array(first), drawn), after)[0]

    none = F.filter(F.transform(rows, lambda r: F.struct(r.alias("row"), F.lit(0).alias("up"), F.lit(0.0).alias("part"))), lambda _: F.lit(False))
    total = lambda name: F.aggregate(rows, F.lit(0.0), lambda t, r: t + r[name])
    start = F.struct(
        total("size").alias("size"), total("mass").alias("mass"), F.lit(1.0).alias("a"), F.lit(0.0).alias("b"), F.lit(0.0).alias("off"), none.alias("done")
    )
    return F.aggregate(rows, start, meet, lambda e: F.struct(e["off"].alias("off"), k.alias("k"), e["done"].alias("done")))


def _uniform(*parts: Column) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*parts), 11) / F.lit(float(1 << 53))


def _exchange(rows: Column, seed: Column) -> Column:
    """Let the rows of an array exchange mass one after the other: ``settled`` rows with 0 or 1, and the one ``left``."""

    def meet(state: Column, b: Column) -> Column:
        a = state["left"]
        drawn = F.struct(
            F.least(a["size"] - a["mass"], b["mass"]).alias("gain"),
            F.least(a["mass"], b["size"] - b["mass"]).alias("loss"),
            _uniform(seed, a["hash"], b["hash"]).alias("u"),
        )

        def ended(d: Column) -> Column:
            up = d["u"] * (d["gain"] + d["loss"]) < d["loss"]
            first = F.when(up, a["size"] - a["mass"] <= b["mass"]).otherwise(a["mass"] <= b["size"] - b["mass"])
            return F.struct(up.alias("up"), first.alias("first"), F.when(up, d["gain"]).otherwise(-d["loss"]).alias("moved"))

        def after(e: Column) -> Column:
            # the first row went up to 1 or down to 0, or else the second did the opposite
            done = F.struct(
                F.when(e["first"], a).otherwise(b).alias("row"),
                F.when(e["first"] == e["up"], 1).otherwise(0).alias("up"),
            )
            left = F.when(e["first"], b.withField("mass", b["mass"] - e["moved"])).otherwise(a.withField("mass", a["mass"] + e["moved"]))
            return F.struct(F.concat(state["settled"], F.array(done)).alias("settled"), left.alias("left"))

        return F.transform(F.transform(F.array(drawn), ended), after)[0]

    none = F.filter(F.transform(rows, lambda r: F.struct(r.alias("row"), F.lit(0).alias("up"))), lambda _: F.lit(False))
    start = F.struct(none.alias("settled"), rows[0].alias("left"))
    return F.aggregate(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), start, meet)
