"""Tables that several sections of one run read, written once.

A report, a profile or a layer has a dozen sections that start from the same
joined and merged tables.  Left to one lazy plan, each section would scan and
join its inputs again.  A ``RunBase`` writes such a table on the first ask,
under a folder that the caller names on shared storage, and every section reads
the files: a lost executor costs a reread, not a recomputation.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from threading import Lock

from pyspark.sql import DataFrame, SparkSession

_FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_freeing: Counter[int] = Counter()
_was: dict[int, str] = {}
_lock = Lock()


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what is written inside go when the write ends.

    Spark keeps them until the driver happens to collect its garbage, so a run
    that writes one table after the other would hold the shuffles of all.  A
    written table is read from its files, never from the shuffle behind it.
    """
    with _lock:
        _freeing[id(spark)] += 1
        if _freeing[id(spark)] == 1:
            _was[id(spark)] = spark.conf.get(_FREE, "false")
            spark.conf.set(_FREE, "true")
    try:
        yield
    finally:
        with _lock:
            _freeing[id(spark)] -= 1
            if not _freeing[id(spark)]:
                spark.conf.set(_FREE, _was.pop(id(spark)))


class RunBase:
    """Written tables of one run under ``path``; ``close`` or leaving the ``with`` block removes them.

    A table is dealt out by a hash of ``by`` before it is written, its own key
    for instance, so that sections read it with as many tasks as its size asks
    for, however few splits its input had.  Tables may be asked for by several
    threads at once: one writes, the others wait.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._written: dict[str, DataFrame] = {}
        self._locks: defaultdict[str, Lock] = defaultdict(Lock)

    def once(self, name: str, build: Callable[[], DataFrame], by=()) -> DataFrame:
        """The table of this name, built and written on the first ask."""
        with self._locks[name]:
            if name not in self._written:
                df = build()
                with freed_shuffles(self.spark):
                    (df.repartition(*by) if by else df).write.parquet(f"{self.path}/{name}", compression="zstd")
                self._written[name] = self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")
        return self._written[name]

    def drop(self, *names: str) -> None:
        """Remove tables that nothing reads any more; asked for again, they are written again."""
        files, _ = self._folder()
        for name in names:
            with self._locks[name]:
                if self._written.pop(name, None) is not None:
                    files.delete(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}"), True)

    @staticmethod
    def together(*asks: Callable[[], object]) -> None:
        """Ask for several tables at once, so that jobs which do not wait for each other share the cluster."""
        with ThreadPoolExecutor(len(asks)) as threads:
            for done in [threads.submit(ask) for ask in asks]:
                done.result()

    def _folder(self):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def close_with_session(self) -> RunBase:
        """Remove the folder when the driver ends, for results that are read after this object is gone."""
        files, path = self._folder()
        files.mkdirs(path)
        files.deleteOnExit(path)
        return self

    def close(self) -> None:
        files, path = self._folder()
        files.delete(path, True)
        self._written.clear()

    def __enter__(self) -> RunBase:
        return self

    def __exit__(self, *_) -> None:
        self.close()
