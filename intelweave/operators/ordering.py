"""First-wins, top-k and ordered-distinct building blocks.

The surviving row is always picked by an explicit order.  Picks are partial
aggregates (one candidate per key leaves a map task), so a key that holds a
large share of all rows costs no more shuffle than any other.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import BY, ORDER


def order_key(order=ORDER) -> Column:
    return F.struct(*[F.col(c) if isinstance(c, str) else c for c in order])


def present(df: DataFrame, name: str) -> Column:
    """Whether a field carries something: not NULL, '', 0 or an empty list."""
    kind = df.schema[name].dataType
    c = F.col(name)
    if isinstance(kind, T.StringType):
        return c.isNotNull() & (c != "")
    if isinstance(kind, (T.ArrayType, T.MapType)):
        return c.isNotNull() & (F.size(c) > 0)
    if isinstance(kind, T.NumericType):
        return c.isNotNull() & (c != 0)
    return c.isNotNull()


def first_present(df: DataFrame, name: str, order=ORDER) -> Column:
    """Aggregate: first value in order that carries something."""
    return F.min_by(F.col(name), F.when(present(df, name), order_key(order)))


def first_value_in_order(name: str, flag: Column, order=ORDER) -> Column:
    """Aggregate: value of the first row whose flag holds, empty or not."""
    return F.min_by(F.col(name), F.when(flag, order_key(order)))


def _pick(df: DataFrame, keys, order, pick) -> DataFrame:
    named = {f"_k{i}": k for i, k in enumerate(keys)}
    cols = df.columns
    keyed = df.withColumns({n: F.col(k) if isinstance(k, str) else k for n, k in named.items()})
    rows = keyed.groupBy(*named).agg(
        pick(F.struct(*[F.col(f"`{c}`") for c in cols]), order_key(order)).alias("_row")
    )
    return rows.select("_row.*")


def keep_first(df: DataFrame, keys, order=ORDER) -> DataFrame:
    """The first row of every key; keys are column names or expressions."""
    return _pick(df, keys, order, F.min_by)


def latest_by(df: DataFrame, keys, order) -> DataFrame:
    """The last row of every key."""
    return _pick(df, keys, order, F.max_by)


def top_n(df: DataFrame, n: int | None, by=BY, order=ORDER, rank: str | None = None) -> DataFrame:
    """First n rows of every group (``None``: all).  Order entries may be sort expressions.

    With n, Spark cuts every map task to n rows per group before the shuffle.
    """
    if n is None and rank is None:
        return df
    w = Window.partitionBy(*by).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w))
    if n is not None:
        out = out.filter(F.col("_rank") <= n)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")


def distinct_values(
    df: DataFrame, value: Column, by=BY, order=ORDER, fold: bool = True, name: str = "value"
) -> DataFrame:
    """Ordered distinct values, one row each: (by..., name, first_at).

    ``fold`` compares case-insensitively and keeps the first spelling.
    """
    rows = df.select(*by, value.alias(name), order_key(order).alias("first_at"))
    trimmed = F.trim(F.col(name))
    key = F.lower(trimmed) if fold else F.col(name)
    rows = rows.filter(F.col(name).isNotNull() & (trimmed != ""))
    return keep_first(rows, [*by, key], ["first_at"])


def gathered(value: Column, order: Column) -> Column:
    """Aggregate: values as an ordered array.  Only for groups of known small size."""
    pairs = F.array_sort(F.collect_list(F.struct(order.alias("o"), value.alias("v"))))
    return F.transform(pairs, lambda p: p["v"])


def ranked_sources(df: DataFrame, sources, source: str = "source_id", rank: str = "source_rank") -> DataFrame:
    """Keep the requested sources; their place in the list becomes the rank."""
    pairs = [F.lit(x) for i, s in enumerate(sources) for x in (s, i)]
    return df.filter(F.col(source).isin(*sources)).withColumn(rank, F.create_map(*pairs)[F.col(source)])


def positions(df: DataFrame, array: str, item: str = "item", pos: str = "pos") -> DataFrame:
    """Explode an array keeping the place of each entry."""
    rest = [c for c in df.columns if c != array]
    return df.select(*rest, F.posexplode(array).alias(pos, item))


def order_text(df: DataFrame, name: str) -> Column:
    """A text that sorts like a column: whole numbers as 16 hexadecimal digits, struct fields one after the other."""

    def text_of(c: Column, kind) -> list[Column]:
        if isinstance(kind, T.StructType):
            return [x for f in kind for x in text_of(c[f.name], f.dataType)]
        if isinstance(kind, T.IntegralType):
            # the sign bit is turned, so that negative numbers sort before the others
            return [F.coalesce(F.lpad(F.hex(c.cast("long").bitwiseXOR(F.lit(-(2**63)))), 16, "0"), F.lit(""))]
        return [F.coalesce(c.cast("string"), F.lit(""))]

    return F.concat_ws("\u0001", *text_of(F.col(name), df.schema[name].dataType))
