"""What comes before a row in its group, for groups of any size: rows are dealt to ranges, and ranges hand on what they hold.

A window over a group sorts it in one task. Here rows go to ranges of (group, order); within a range a window or a fold
sees a bounded part, and one row for each range that a group reaches carries the rest.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.operators import nearest, tables
from ridgeline.storage import written

# What a stored candidate's status becomes, and what is answered. Anything else is refused and changes nothing.
STATUS = ("none", "active", "deleted", "resetting")
TRANSITIONS = {
    ("none", "submit"): ("active", "created"),
    ("active", "submit"): ("active", "deduplicated"),
    ("deleted", "submit"): ("active", "restored"),
    ("active", "delete"): ("deleted", "deleted"),
    ("active", "reset"): ("resetting", "resetting"),
    ("deleted", "reset"): ("resetting", "resetting"),
    ("resetting", "purge"): ("none", "purged"),
}
REFUSED = "refused"
#: Boxes of a page that one task sorts.
PAGE = 65_536


def step(status: str, action: str | None) -> tuple[str, str]:
    """The status after an action, and the answer to it."""
    return TRANSITIONS.get((status, action), (status, REFUSED))


def _same(by: list[str]) -> Column:
    out = F.col("_part") == F.col("_of_part")
    for c in by:
        out = out & F.col(c).eqNullSafe(F.col(f"_of_{c}"))
    return out


def running(rows: DataFrame, by: list[str], order: list[str | Column], value: str, how: str, name: str) -> DataFrame:
    """rows with the max or sum of a value over the rows before each in its group; null where there is none. The order must be a key."""
    if how not in ("max", "sum"):
        raise ValueError("how must be max or sum")
    fold = {"max": F.max, "sum": F.sum}[how]
    placed = written(rows.repartitionByRange(*by, *order).withColumn("_part", F.spark_partition_id()))
    before = Window.partitionBy(*by).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    carried = placed.groupBy(*by, "_part").agg(fold(value).alias("_v")).withColumn("_carried", fold("_v").over(before)).drop("_v").toDF(*[f"_of_{c}" for c in by], "_of_part", "_carried")
    within = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = placed.withColumn("_own", fold(value).over(within)).join(carried, _same(by))
    both = F.greatest("_own", "_carried") if how == "max" else F.when(F.col("_own").isNotNull() | F.col("_carried").isNotNull(), F.coalesce("_own", F.lit(0)) + F.coalesce("_carried", F.lit(0)))
    return out.withColumn(name, both).select(*rows.columns, name)


def lifecycle(rows: DataFrame, who: str, order: list[str], action: str) -> DataFrame:
    """rows with `before`, `after` and `answer`: what each action finds and makes of the status of its key, in order.

    A range's actions are a map from each status to another; maps of earlier ranges are applied to `none`, so every range
    starts with the right status. `order` must be a key; `who` must not be null.
    """
    columns = rows.columns
    placed = written(rows.withColumn("_who", F.col(who).cast("long")).where("_who IS NOT NULL").repartitionByRange("_who", *order).withColumn("_part", F.spark_partition_id().cast("long")))

    def summary(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, ends, out = None, (), []
        for key, batch in nearest.runs(batches, 2):
            if key != now:
                if now is not None:
                    out.append((*now, ends))
                now, ends = key, STATUS
            for a in batch.column(2).to_pylist():
                ends = tuple(step(s, a)[0] for s in ends)
        if now is not None:
            out.append((*now, ends))
        kinds = (pa.int64(), pa.int64(), pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds], names=["_of_who", "_of_part", "ends"])

    def sorted_(t: DataFrame) -> DataFrame:
        return t.repartition("_who", "_part").sortWithinPartitions("_who", "_part", *order)

    maps = sorted_(placed).select("_who", "_part", action).mapInArrow(summary, "_of_who long, _of_part long, ends array<string>")
    earlier = F.collect_list("ends").over(Window.partitionBy("_of_who").orderBy("_of_part").rowsBetween(Window.unboundedPreceding, -1))
    place = F.array(*map(F.lit, STATUS))
    start = F.aggregate(earlier, F.lit(STATUS[0]), lambda s, m: F.element_at(m, F.array_position(place, s).cast("int")))
    begun = maps.select("_of_who", "_of_part", start.alias("_start"))
    joined = placed.join(begun, (F.col("_who") == F.col("_of_who")) & (F.col("_part") == F.col("_of_part"))).drop("_of_who", "_of_part")
    ahead = ["_who", "_part", "_start", *columns]

    def answers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, status = None, None
        for key, batch in nearest.runs(batches, 2):
            if key != now:
                now, status = key, batch.column(2)[0].as_py()
            found = []
            for a in batch.column(ahead.index(action)).to_pylist():
                after, answer = step(status, a)
                found.append((status, after, answer))
                status = after
            yield pa.RecordBatch.from_arrays([*batch.columns[3:], *(pa.array(c, pa.string()) for c in zip(*found))], names=[*columns, "before", "after", "answer"])

    schema = rows.select("*", *[F.lit("").alias(c) for c in ("before", "after", "answer")]).schema
    return sorted_(joined).select(ahead).mapInArrow(answers, schema)


def reading_order(boxes: DataFrame, page: str, key: str) -> DataFrame:
    """boxes (left, top, right, bottom) with `row`, `place` (both from 1, on the page) and `on_page`, the number of its boxes.

    A sweep from the top: a row goes on while a box begins above the lowest bottom so far, so boxes that overlap through
    others are one row. Within a row, order is by left, top and key, from left to right. Pages of up to PAGE boxes are
    windows, dealt out once; larger ones go over ranges.
    """
    large = written(boxes.groupBy(page).agg(F.count("*").alias("_n")).where(F.col("_n") > PAGE).select(F.col(page).alias("_large")))
    if large.isEmpty():
        return _read(boxes, page, key)
    same = F.col(page).eqNullSafe(F.col("_large"))
    return _read(boxes.join(large, same, "left_anti"), page, key).unionByName(_read_ranges(boxes.join(large, same, "left_semi"), page, key))


def _read(boxes: DataFrame, page: str, key: str) -> DataFrame:
    whole = Window.partitionBy(page)
    swept = whole.orderBy("top", "bottom", key)
    lowest = F.max("bottom").over(swept.rowsBetween(Window.unboundedPreceding, -1))
    starts = boxes.withColumn("_starts", F.coalesce(F.col("top") >= lowest, F.lit(True)).cast("long"))
    rows = starts.withColumn("row", F.sum("_starts").over(swept.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.select(*boxes.columns, "row", F.row_number().over(whole.orderBy("row", "left", "top", key)).cast("long").alias("place"), F.count("*").over(whole).alias("on_page"))


def _read_ranges(boxes: DataFrame, page: str, key: str) -> DataFrame:
    swept = running(boxes, [page], ["top", "bottom", key], "bottom", "max", "_lowest")
    starts = swept.withColumn("_starts", F.coalesce(F.col("top") >= F.col("_lowest"), F.lit(True)).cast("long"))
    rows = running(starts, [page], ["top", "bottom", key], "_starts", "sum", "_rows").withColumn("row", F.coalesce("_rows", F.lit(0)) + F.col("_starts")).select(*boxes.columns, "row")
    out = tables.numbered(rows, [page], ["row", "left", "top", key], "place")
    return out.select(*boxes.columns, "row", "place", F.col("place_of").alias("on_page"))
