"""Helpers that the operators of this package share: tables, shared folders, Arrow columns."""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that ``spark.checkpoint.dir`` names; its absence is an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return folder.rstrip("/")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts the lineage."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


#: what the tasks of one stage share in a Python worker, by name
_SHARED: dict[str, dict] = {}
_STAGE = None


def shared_in_stage(name: str) -> dict:
    """A dict that lives in a worker while it works on one stage."""
    return _SHARED.setdefault(name, {})


def enter_stage() -> None:
    global _STAGE
    context = TaskContext.get()
    stage = context.stageId() if context else None
    if stage != _STAGE:
        _SHARED.clear()
        _STAGE = stage


def task(run, rows: int | None = None):
    """``run`` over record batches, ready for mapInArrow.

    Workers are used again by later stages: what earlier ones kept goes first,
    and unused Arrow memory is given back at the end.  With ``rows``, batches of
    long texts are passed on in slices of as many rows.
    """

    def sliced(batches):
        for batch in batches:
            for a in range(0, batch.num_rows, rows):
                yield batch.slice(a, rows)

    def start(batches):
        enter_stage()
        try:
            yield from run(sliced(batches) if rows else batches)
        finally:
            pa.default_memory_pool().release_unused()

    return start


def arrow_schema(ddl: str) -> pa.Schema:
    """Arrow types of the few column types used here, from a DDL string."""
    plain = {
        "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
        "string": pa.string(), "binary": pa.binary(), "float": pa.float32(),
    }

    def kind(s: str):
        s = s.strip()
        return pa.list_(kind(s[6:-1])) if s.startswith("array<") else plain[s]

    return pa.schema([(n, kind(t)) for n, t in (x.strip().split(" ", 1) for x in ddl.split(", "))])


def as_batch(columns: dict, schema: pa.Schema) -> pa.RecordBatch:
    arrays = [
        c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=f.type)
        for f, c in ((f, columns[f.name]) for f in schema)
    ]
    arrays = [a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a for a in arrays]
    return pa.RecordBatch.from_arrays([a.cast(f.type) for a, f in zip(arrays, schema)], schema=schema)


def list_array(values: np.ndarray, lengths: np.ndarray) -> pa.ListArray:
    """A list column from flat values and the length of each list."""
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def flat_list(column) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and lengths of a list column (no null lists)."""
    lengths = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), lengths


def spans_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lists laid end to end: the list of each value, and its place in that list."""
    owner = np.repeat(np.arange(len(lengths)), lengths)
    starts = np.cumsum(lengths) - lengths
    return owner, np.arange(int(lengths.sum())) - np.repeat(starts, lengths)


def grouped(batches, key: str):
    """Record batches of sorted input, cut so that no value of ``key`` is in two of them."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key)
        last = keys[-1]
        if held and held[0].column(key)[0].equals(last) and keys[0].equals(last):
            held.append(batch)  # still the same key from end to end
            continue
        import pyarrow.compute as pc

        same = pc.equal(keys, last).to_numpy(zero_copy_only=False)
        cut = batch.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
            held = []
        elif held and not held[-1].column(key)[0].equals(last):
            yield pa.Table.from_batches(held).combine_chunks()
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def codes_of(words: list[str]) -> tuple[np.ndarray, pa.Array]:
    """A number for each word, and the distinct words (a hash table of C strings would stop at NUL)."""
    coded = pa.array(words, pa.large_string()).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), coded.dictionary


def bounded_sample(rows: DataFrame, key, n: int) -> DataFrame:
    """The ``n`` rows with the smallest hash of ``key`` (fewer if there are fewer).

    Rows whose hash is beyond what n rows can be expected to need are left out
    first, so that tasks send a few times n rows in all, however many they are.
    """
    total = rows.count()
    share = min(1.0, 4 * (n + 100) / max(total, 1))
    low = F.col("__h") <= int((share - 0.5) * 2**64) if share < 1 else F.lit(True)
    return rows.withColumn("__h", F.xxhash64(key)).filter(low).orderBy("__h", *rows.columns).limit(n).drop("__h")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores added until no column has it (names are compared without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name
