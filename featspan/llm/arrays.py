"""Running folds over arrays and cuts of long texts, in time that grows with their length.

A fold that appends to an array copies it at every step. Here an array is cut into blocks, the
state at the start of each block comes from one pass without output, and a block's output is put
together apart from the others'.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

BLOCK = 128
PIECE = 1024


def running(
    items: Column,
    zero: Column,
    step: Callable[[Column, Column], Column],
    emit: Callable[[Column, Column], Column],
    state: str,
    out: str,
) -> Column:
    """``emit(state, item)`` of every item, with the state that ``step`` has made of the items before it.

    ``state`` and ``out`` are the types of the state and of an emitted value.
    """
    zero = zero.cast(state)

    def blocks_of(xs: Column) -> Column:
        last = F.greatest(F.ceil(F.size(xs) / BLOCK).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(xs, i * BLOCK + 1, BLOCK))

    def begun(blocks: Column) -> Column:
        return F.aggregate(
            blocks,
            F.struct(zero.alias("at"), F.array().cast(f"array<{state}>").alias("starts")),
            lambda a, block: F.struct(
                F.aggregate(block, a["at"], lambda s, x: step(s, x).cast(state)).alias("at"),
                F.concat(a["starts"], F.array(a["at"])).alias("starts"),
            ),
            lambda a: a["starts"],
        )

    def told(block: Column, at: Column) -> Column:
        return F.aggregate(
            block,
            F.struct(at.alias("at"), F.array().cast(f"array<{out}>").alias("out")),
            lambda a, x: F.struct(step(a["at"], x).cast(state).alias("at"), F.concat(a["out"], F.array(emit(a["at"], x).cast(out))).alias("out")),
            lambda a: a["out"],
        )

    return let(items, lambda xs: let(blocks_of(xs), lambda blocks: F.flatten(F.zip_with(blocks, begun(blocks), told))))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often and deep in lambdas it is used."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pieces_of(text: Column) -> Column:
    """The text in pieces of ``PIECE`` code points."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))


def cut(pieces: Column, start: Column, end: Column) -> Column:
    """Code points from ``start`` up to ``end`` of a text in pieces; only the pieces they lie in are looked at."""
    first, last = F.floor(start / PIECE).cast("int"), F.floor((end - 1) / PIECE).cast("int")
    at = (start % PIECE + 1).cast("int")
    head, tail = F.get(pieces, first), F.get(pieces, last)
    inner = F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    several = F.concat(F.substring(head, at, F.lit(PIECE)), inner, F.substring(tail, F.lit(1), (end - last * PIECE).cast("int")))
    return F.when(end <= start, F.lit("")).when(first == last, F.substring(head, at, (end - start).cast("int"))).otherwise(several)
