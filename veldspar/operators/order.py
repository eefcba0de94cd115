"""Order-dependent work without one task for a whole group: steps followed by doubling, and row numbers.

Groups (documents, files) may hold any share of all rows. So nothing here is windowed or folded over a
group: steps are followed by joins that double their length, and rows are numbered within ranges of a
global order, whose counts alone are summed up.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veldspar.scratch import Scratch


def orbit(nodes: DataFrame, key: list[str], scratch: Scratch, name: str = "orbit") -> DataFrame:
    """Distinct ``key`` and ``at`` of the nodes that are reached from the starts.

    ``nodes`` has ``key``, ``at``, ``to`` (the node that follows, larger than ``at``; null at an end) and
    ``start``; (key, at) is unique. A path is followed by pointer doubling: after k rounds a node points
    2 ** k steps ahead, and all nodes within so many steps of a start are reached. A round is two joins of equal
    keys, whatever the length of a path; there are about log2 of the longest. Starts with nothing to
    follow take no part in a round.
    """
    alone = nodes.where("start and to is null").select(*key, "at")
    now = nodes.where("to is not null or not start").select(*key, "at", "to", F.col("start").alias("reached"))
    rounds, going = 0, not now.where("to is not null").isEmpty()
    while going:
        further = now.select(*key, F.col("at").alias("to"), F.col("to").alias("far"))
        ahead = now.join(further, [*key, "to"], "left")
        hit = now.where("reached and to is not null").select(*key, F.col("to").alias("at"), F.lit(None).cast(nodes.schema["at"].dataType).alias("to"), F.lit(True).alias("reached"))
        both = ahead.select(*key, "at", F.col("far").alias("to"), "reached").unionByName(hit)
        now = scratch.save(both.groupBy(*key, "at").agg(F.max("to").alias("to"), F.max("reached").alias("reached")), f"{name}{rounds}")
        scratch.drop(f"{name}{rounds - 1}")
        going, rounds = not now.where("to is not null").isEmpty(), rounds + 1
    return now.where("reached").select(*key, "at").unionByName(alone)


def numbered(rows: DataFrame, key: list[str], order: list[Column], scratch: Scratch, name: str = "nth", table: str = "numbered", falling: tuple[int, ...] = ()) -> DataFrame:
    """Rows with their number within ``key`` along rising ``order``, from 1.

    Rows are dealt by ranges of (key, order) and stored; rows are numbered within each range, and what
    the ranges before hold of a key is a running sum over one row a key and range. A key that holds a
    third of all rows spans many ranges, if ``order`` tells its rows apart. Without keys all
    rows are one group. The columns of ``order`` at the places ``falling`` fall.
    """
    ends = {f"_o{k}": c for k, c in enumerate(order)}
    along = [F.desc(c) if k in falling else F.asc(c) for k, c in enumerate(ends)]
    dealt = rows.withColumns(ends).repartitionByRange(*key, *along).withColumn("_part", F.spark_partition_id())
    dealt = scratch.save(dealt, table)
    counts = dealt.groupBy("_part", *key).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*key).orderBy("_part")) - F.col("_n")  # a row a range
    counts = counts.select("_part", *(F.col(k).alias(f"_k{i}") for i, k in enumerate(key)), before.alias("_before"))
    same = F.col("_part") == counts["_part"]
    inside = F.row_number().over(Window.partitionBy("_part", *key).orderBy(*along))
    inner = dealt.withColumn("_inside", inside).withColumnRenamed("_part", "_p")
    same = inner["_p"] == counts["_part"]
    for i, k in enumerate(key):
        same = same & inner[k].eqNullSafe(counts[f"_k{i}"])
    out = inner.join(counts, same).withColumn(name, F.col("_before") + F.col("_inside"))
    return out.select(*rows.columns, name)


def running(rows: DataFrame, key: list[str], place: str, value: Column, fold: Callable[[Column], Column], name: str, span: int = 1 << 14) -> DataFrame:
    """Rows with the fold (F.sum or F.max) of ``value`` over the places of ``key`` before theirs, null where there is none.

    ``place`` is a whole number, unique within ``key``. What is ordered as a whole is a row a ``span`` of places. ``rows``
    are read twice, so they should be stored; null keys drop out.
    """
    rows = rows.withColumns({"_span": F.floor(F.col(place) / span), "_value": value})
    earlier = lambda by: by.rowsBetween(Window.unboundedPreceding, -1)
    spans = rows.groupBy(*key, "_span").agg(fold(F.col("_value")).alias("_value"))
    spans = spans.select(*key, "_span", fold(F.col("_value")).over(earlier(Window.partitionBy(*key).orderBy("_span"))).alias("_far"))
    near = fold(F.col("_value")).over(earlier(Window.partitionBy(*key, "_span").orderBy(place)))
    pair = F.array_compact(F.array("_far", "_near"))
    both = F.try_element_at(F.sort_array(pair), F.lit(-1)) if fold is F.max else F.when(F.size(pair) > 0, F.aggregate(pair, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return rows.withColumn("_near", near).join(spans, [*key, "_span"]).withColumn(name, both).drop("_span", "_value", "_far", "_near")


def entered(maps: DataFrame, key: list[str], scratch: Scratch, fan: int = 256, name: str = "scan") -> DataFrame:
    """The way (key, place, way) by which each place is entered, where place 0 is entered by way 0.

    ``maps`` has ``key``, ``place`` (0, 1, 2, ... without a gap) and ``out``: of each way in, the way out,
    which is the next place's way in. Maps compose associatively, so ``fan`` places at a time become
    one, up to a single one a key, and the ways go back down: about log(places) / log(fan) levels each way.
    """
    maps = scratch.save(maps.select(*key, "place", "out"), f"{name}-0")
    most = maps.agg(F.max("place")).first()[0]
    levels = []
    while most is not None:
        item = F.struct("place", "out")
        groups = maps.groupBy(*key, F.floor(F.col("place") / fan).cast("bigint").alias("up")).agg(F.array_sort(F.collect_list(item)).alias("items"))  # ``fan`` maps at most
        levels.append(groups)
        if most < fan:
            break
        same = F.sequence(F.lit(0), F.size(F.get("items", F.lit(0))["out"]) - 1)
        whole = F.aggregate("items", same, lambda way, x: F.transform(way, lambda w: F.get(x["out"], w)))
        maps = scratch.save(groups.select(*key, F.col("up").alias("place"), whole.alias("out")), f"{name}-{len(levels)}")
        most //= fan
    if not levels:
        return maps.select(*key, "place", F.lit(0).alias("way"))
    start = F.lit(0)
    down = levels.pop().withColumn("way", start)
    while True:
        step = lambda ways, x: F.concat(ways, F.array(F.get(x["out"], F.element_at(ways, -1))))
        ways = F.aggregate("items", F.array("way"), step)
        down = down.select(*key, F.inline(F.arrays_zip(F.transform("items", lambda x: x["place"]).alias("place"), F.slice(ways, 1, F.size("items")).alias("way"))))
        if not levels:
            return down
        down = levels.pop().join(down.withColumnRenamed("place", "up"), [*key, "up"])
