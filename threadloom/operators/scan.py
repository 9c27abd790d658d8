"""Order-dependent building blocks that stay parallel inside one very large key.

A plain window over ``PARTITION BY conversation`` puts a whole conversation into one task.  Here an
order column is cut into blocks, the work happens per (key, block), and only one row per block takes
part in the step that crosses block borders.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import durable

BLOCK_ROWS = 65_536


def with_position(
    df: DataFrame,
    keys: list[str],
    order: str,
    position: str = "pos",
    neighbours: dict[str, tuple[str, int]] | None = None,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Add the 0-based rank of each row among the rows of its key, by a unique non-negative integer.

    ``neighbours`` adds columns holding another column of the previous (-1) or next (+1) row:
    ``{"parent_id": ("node_id", -1)}``.
    """
    neighbours = neighbours or {}
    block = F.floor(F.col(order) / F.lit(block_rows)).cast("bigint")
    df = df.withColumn("_block", block)
    in_block = Window.partitionBy(*keys, "_block").orderBy(order)
    border = {
        name: (F.max_by if step < 0 else F.min_by)(F.col(source), F.col(order)).alias(name)
        for name, (source, step) in neighbours.items()
    }
    across = Window.partitionBy(*keys).orderBy("_block")
    before = across.rowsBetween(Window.unboundedPreceding, -1)
    blocks = df.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_rows"), *border.values())
    blocks = blocks.select(
        *keys,
        "_block",
        F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        *[
            (F.lag(name) if step < 0 else F.lead(name)).over(across).alias(f"_edge_{name}")
            for name, (_, step) in neighbours.items()
        ],
    )
    local = df.withColumns(
        {
            "_rank": F.row_number().over(in_block) - 1,
            **{
                f"_near_{name}": (F.lag(source) if step < 0 else F.lead(source)).over(in_block)
                for name, (source, step) in neighbours.items()
            },
        }
    )
    joined = local.join(blocks, [*keys, "_block"])
    return joined.withColumns(
        {
            position: (F.col("_offset") + F.col("_rank")).cast("bigint"),
            **{
                name: F.coalesce(F.col(f"_near_{name}"), F.col(f"_edge_{name}"))
                for name in neighbours
            },
        }
    ).drop(
        "_block", "_rank", "_offset", *[f"{p}_{n}" for n in neighbours for p in ("_near", "_edge")]
    )


def follow_pointers(edges: DataFrame, starts: DataFrame, keys: list[str]) -> DataFrame:
    """Every node reached from each start by following ``next``, with its distance.

    ``edges(*keys, node, next)`` has one row per node; ``starts(*keys, start)``.  Jumps double in
    length each round, so a chain of n nodes takes about log2(n) joins, all on (key, node).  Chains
    that run into a cycle stop at the first node seen twice.  Each round is written to the
    checkpoint folder, so a lost executor repeats one round at most.
    """
    reach = durable(starts.select(*keys, "start", F.col("start").alias("node"), F.lit(0).cast("bigint").alias("dist")))
    jump = durable(edges.filter(F.col("next").isNotNull()).select(*keys, "node", "next"))
    known, hop = reach.count(), 1
    while True:
        step = reach.join(jump, [*keys, "node"]).select(
            *keys, "start", F.col("next").alias("node"), (F.col("dist") + hop).alias("dist")
        )
        reach = durable(
            reach.unionByName(step).groupBy(*keys, "start", "node").agg(F.min("dist").alias("dist"))
        )
        total = reach.count()
        if total == known:
            return reach
        known, hop = total, hop * 2
        left, right = jump.alias("a"), jump.alias("b")
        same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
        jump = durable(
            left.join(right, reduce(Column.__and__, same, F.col("a.next") == F.col("b.node"))).select(
                *[F.col(f"a.{k}").alias(k) for k in keys], F.col("a.node"), F.col("b.next")
            )
        )


def split_by_size(df: DataFrame, keys: list[str], bound: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of keys with at most ``bound`` rows, and the rest (None when there is no such key)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    big = sizes.filter(F.col("_n") > bound).select(*keys)
    if big.isEmpty():
        return df, None
    return df.join(big, keys, "left_anti"), df.join(big, keys, "left_semi")
