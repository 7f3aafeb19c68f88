"""Helpers shared by the training-data operators: table access, scratch tables, word patterns."""

from __future__ import annotations

import atexit
import ctypes
import gc
import re
import shutil
import sys
import tempfile
import types
import uuid
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Runs of the white space that separates words (space, tab to carriage return).
SPACES = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: For str.translate: lower-cases A-Z and leaves every other character alone.
ASCII_LOWER = {ord(a): b for a, b in zip(UPPER, LOWER)}
#: What may be broadcast: tables that, by a count of their rows, aren't larger.
BROADCAST_BYTES = 8 << 20
_own_root: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def fenced(value: Column) -> Column:
    """`value`, kept from being copied into filters above: there, lambdas would evaluate it for each element."""
    return F.when(F.monotonically_increasing_id() >= 0, value)


def let_sql(value: str, name: str, body: str) -> str:
    """SQL: `body` with `name` bound to `value`, evaluated once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def scan_sql(items: str, state: str, step: str, emits: str, block: int = 128) -> str:
    """SQL: what `step` emits over the array `items`, in order, with a state carried along.

    state: SQL of the first state; step: SQL of a struct of the next state n and an array e of what is emitted, for the state
    s and the item x; emits: the type of an item of e. Outputs are gathered block by block: appending to one array would copy
    it each time, which is quadratic in a long one, as is slice() inside of lambdas.
    """
    none = f"cast(array() as array<{emits}>)"
    inner = f"aggregate(_q, named_struct('s', _b.s, 'o', {none}), (_a, x) -> {let_sql('_a.s', 's', let_sql(step, '_r', "named_struct('s', _r.n, 'o', concat(_a.o, _r.e))"))})"
    outer = f"(_b, _k) -> {let_sql(f'CASE WHEN size(_v) > 0 THEN transform(sequence(_k * {block}, least((_k + 1) * {block}, size(_v)) - 1), _i -> _v[_i]) ELSE _v END', '_q', let_sql(inner, '_w', "named_struct('s', _w.s, 'o', concat(_b.o, array(_w.o)))"))}"
    return let_sql(items, "_v", f"aggregate(sequence(0, (size(_v) - 1) div {block}), named_struct('s', {state}, 'o', cast(array() as array<array<{emits}>>)), {outer}, _b -> flatten(_b.o))")


def double_array(spark: SparkSession, values: list[float]) -> Column:
    """One array literal; an array of literals would be rebuilt, or folded again, wherever it is used."""
    out = spark.sparkContext._gateway.new_array(spark._jvm.double, len(values))
    for i, x in enumerate(values):
        out[i] = float(x)
    return Column(spark._jvm.org.apache.spark.sql.functions.lit(out))


def scratch_root(spark: SparkSession) -> str:
    """The folder that the cluster shares. Where the session names none: a temporary one if all runs in this process (as in
    tests), else one below the warehouse, which executors share too."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_citeweave"
    if not _own_root:
        _own_root.append(tempfile.mkdtemp(prefix="citeweave-"))
        atexit.register(shutil.rmtree, _own_root[0], ignore_errors=True)
    return f"file://{_own_root[0]}"


@contextmanager
def _settings(spark: SparkSession, own: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def _statement(spark: SparkSession):
    """Settings of the statements inside: shuffle files go as soon as each has ended, and Arrow batches are short, as a
    row may hold a long text or a whole set."""
    return _settings(spark, {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "512"})


@contextmanager
def long_sql(spark: SparkSession):
    """Settings while long SQL expressions are parsed: what the parser has learnt from them goes after each, and its garbage at
    the end. Else the driver holds it for good, tens of MB for deeply nested ones, and its heap grows by a multiple of that."""
    with _settings(spark, {"spark.sql.parser.manageParserCaches": "true", "spark.sql.parser.parserDfaCacheFlushThreshold": "1000"}):
        yield
    forget(spark)


class Scratch:
    """Tables written to the shared folder: they cut the lineage and outlive lost executors.

    Tables that a returned DataFrame still reads stay for as long as the folder does; the others are
    dropped as soon as nothing needs them.
    """

    def __init__(self, spark: SparkSession, tag: str):
        self.spark, self.base = spark, f"{scratch_root(spark)}/citeweave-{tag}-{uuid.uuid4().hex}"
        self.held: set[str] = set()

    def save(self, df: DataFrame, name: str, codec: str = "zstd") -> DataFrame:
        path = f"{self.base}/{name}"
        self.held.add(name)
        with _statement(self.spark):
            df.write.option("compression", codec).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *names: str) -> None:
        jvm, sc = self.spark._jvm, self.spark.sparkContext
        for name in names:
            self.held.discard(name)
            path = jvm.org.apache.hadoop.fs.Path(f"{self.base}/{name}")
            path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


    def names(self, *starts: str) -> set[str]:
        """The tables held whose names start so."""
        return {n for n in self.held if n.startswith(starts)}


def forget(spark: SparkSession) -> None:
    """Has the driver drop what it holds for finished steps (plans, broadcasts, shuffles), which stays else until it happens
    to collect its garbage."""
    gc.collect()
    spark._jvm.System.gc()


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """`df` to be broadcast if its rows, counted, take BROADCAST_BYTES at most; else as it is, to be joined by shuffle."""
    most = BROADCAST_BYTES // row_bytes
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """Names like the wanted ones that no column of `df` has, whatever its case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def memo(name: str) -> dict:
    """What this worker process keeps between tasks under `name`, as long as these are tasks of the same kind (see trimmed)."""
    return sys.modules.setdefault(f"_citeweave_{name}", types.ModuleType(f"_citeweave_{name}")).__dict__


def trimmed(function, keeps: str = ""):
    """`function` of Arrow batches, before which the worker forgets what others keep (all but the memo that this one
    `keeps`), and after which it hands memory that it has freed back to the machine."""

    def run(batches):
        for name in [n for n in sys.modules if n.startswith("_citeweave_") and n != f"_citeweave_{keeps}"]:
            del sys.modules[name]
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()
            try:
                ctypes.CDLL(None).malloc_trim(0)
            except (AttributeError, OSError):  # not glibc
                pass

    return run


def text_chunks(batches, limit: int = 4 << 20, key: int = 0, text: int = 1):
    """(keys, texts) of about `limit` characters from Arrow batches; a longer text comes alone. Null texts are ""."""
    keys, texts, size = [], [], 0
    for batch in batches:
        for k, t in zip(batch.column(key).to_pylist(), batch.column(text)):
            t = t.as_py() or ""
            if texts and size + len(t) > limit:
                yield keys, texts
                keys, texts, size = [], [], 0
            keys.append(k)
            texts.append(t)
            size += len(t)
    if texts:
        yield keys, texts
