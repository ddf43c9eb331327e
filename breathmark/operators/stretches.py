"""Long sequences in stretches: rows that a neighbouring stretch sees too, and what is carried from one stretch to the next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Positions in one stretch of a sequence of samples.
STRETCH = 8192


def dealt(rows: DataFrame, at: str, size: int = STRETCH, before: int = 0, after: int = 0) -> DataFrame:
    """``rows`` with ``stretch``, once in their own (``own``) and again in each that sees ``before`` positions more at its start or ``after`` at its end.

    Positions are whole numbers from 0 on.
    """
    k, span = F.col(at), F.lit(size)
    first, home, last = F.floor((k - after) / span), F.floor(k / span), F.floor((k + before) / span)
    seen = F.when(first == last, F.array(home)).otherwise(F.sequence(F.greatest(first, F.lit(0)), last))
    return rows.withColumn("stretch", F.explode(seen)).withColumn("own", F.col("stretch") == home)


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """``rows`` dealt by ``keys`` to as many tasks as the session has shuffle partitions, however few bytes they are: for little data that is much work."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def carried(rows: DataFrame, key: Sequence[str], block: str, order: Sequence[str], **wanted: tuple[str, Column]) -> DataFrame:
    """``rows`` with columns that look along the whole of their ``key``, though each task only sees blocks of it.

    ``block`` rises with ``order`` within a key. ``wanted``: name = (what, column), with what being ``sum``: of all rows before; ``max``: the greatest of all rows before;
    ``last``: the last one before that isn't null; ``prev`` and ``next``: of the row before or after; ``all_sum`` and ``all_max``: of the whole key. Without such rows sums are 0, others null.

    Two levels: windows within blocks, and one row a block whose running values are joined back to the block's rows. Rows are dealt by key and block, once;
    only the rows of blocks meet by key alone. Keys and blocks are never null.
    """
    rows = rows.withColumns({f"_{name}": column for name, (_, column) in wanted.items()}).repartition(*key, block)
    place = F.struct(*order)
    local = Window.partitionBy(*key, block).orderBy(*order)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    chain = Window.partitionBy(*key).orderBy(block)
    blocks_before, whole = chain.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(*key)

    inside: dict[str, Column] = {"_row": F.row_number().over(local)}
    summed, passed, out = [], [], {}
    for name, (what, _) in wanted.items():
        own, far, near = F.col(f"_{name}"), F.col(f"_c_{name}"), F.col(f"_l_{name}")
        if what in ("sum", "all_sum"):
            summed.append(F.sum(own).alias(f"_s_{name}"))
            passed.append(F.coalesce(F.sum(f"_s_{name}").over(blocks_before if what == "sum" else whole), F.lit(0)))
        elif what in ("max", "all_max"):
            summed.append(F.max(own).alias(f"_s_{name}"))
            passed.append(F.max(f"_s_{name}").over(blocks_before if what == "max" else whole))
        elif what == "last":
            summed.append(F.max_by(own, F.when(own.isNotNull(), place)).alias(f"_s_{name}"))
            passed.append(F.last(f"_s_{name}", ignorenulls=True).over(blocks_before))
        else:
            summed.append((F.max_by if what == "prev" else F.min_by)(own, place).alias(f"_s_{name}"))
            passed.append((F.lag if what == "prev" else F.lead)(f"_s_{name}").over(chain))
        passed[-1] = passed[-1].alias(f"_c_{name}")
        if what == "sum":
            inside[f"_l_{name}"], out[name] = F.sum(own).over(before), F.coalesce(near, F.lit(0)) + far
        elif what == "max":
            inside[f"_l_{name}"], out[name] = F.max(own).over(before), F.greatest(near, far)
        elif what == "last":
            inside[f"_l_{name}"], out[name] = F.last(own, ignorenulls=True).over(before), F.coalesce(near, far)
        elif what == "prev":
            inside[f"_l_{name}"], out[name] = F.lag(own).over(local), F.when(F.col("_row") == 1, far).otherwise(near)
        elif what == "next":
            inside[f"_l_{name}"], out[name] = F.lead(own).over(local), F.when(F.col("_row") == F.col("_rows"), far).otherwise(near)
        else:
            out[name] = far
    inside["_rows"] = F.count(F.lit(1)).over(Window.partitionBy(*key, block))
    summary = rows.groupBy(*key, block).agg(*summed).select(*key, block, *passed)
    joined = rows.withColumns(inside).join(summary, [*key, block])
    names = [c for c in joined.columns if not c.startswith("_")]
    return joined.select(*[c for c in names if c not in out], *[c.alias(name) for name, c in out.items()])


def numbered_groups(rows: DataFrame, key: Sequence[str], block: str, order: Sequence[str], first: Column) -> DataFrame:
    """``rows`` with ``group``: how many rows of the key up to and with each have ``first``."""
    flag = F.coalesce(first.cast("long"), F.lit(0))
    return carried(rows.withColumn("_first", flag).withColumnRenamed("_first", "first_of"), key, block, order, group=("sum", F.col("first_of"))).withColumn(
        "group", F.col("group") + F.col("first_of")
    ).drop("first_of")


def value_bin(x: Column, digits: int = 12) -> Column:
    """A whole number that never falls as ``x`` rises: the binary exponent and the next ``digits`` binary digits, by sign."""
    size, steps = F.abs(x), F.lit(float(1 << digits))
    exponent = F.floor(F.log2(size)).cast("double")
    fine = (exponent + 1200.0) * steps + F.floor(size / F.pow(F.lit(2.0), exponent) * steps) - steps
    bounded = F.when(size == 0, 0.0).when(size == float("inf"), 4e9).otherwise(fine)
    return (F.signum(x) * bounded).cast("long")


def medians(rows: DataFrame, key: Sequence[str], value: str, **more: Column) -> DataFrame:
    """The exact ``median`` of the numbers of each key, nulls left out, and other aggregates ``more`` (greatest values) of these rows.

    Equal values are counted by tasks first. The distinct ones are dealt by value ranges, and the counts of ranges say in which of them the middle lies,
    so that no task sorts a whole key, however long it is.
    """
    x = F.col(value)
    counted = rows.where(x.isNotNull() & ~F.isnan(x)).groupBy(*key, x.alias("x")).agg(F.count(F.lit(1)).alias("c"), *[F.max(c).alias(n) for n, c in more.items()])
    counted = counted.withColumn("bin", value_bin(F.col("x")))  # of distinct values only
    found = carried(
        counted, key, "bin", ["x"], below=("sum", F.col("c")), total=("all_sum", F.col("c")), **{f"all_{n}": ("all_max", F.col(n)) for n in more}
    )
    low, high = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    middle = found.where(((F.col("below") <= low) & (low < F.col("below") + F.col("c"))) | ((F.col("below") <= high) & (high < F.col("below") + F.col("c"))))
    return middle.groupBy(*key).agg((F.lit(0.5) * F.min("x") + F.lit(0.5) * F.max("x")).alias("median"), *[F.max(f"all_{n}").alias(n) for n in more])
