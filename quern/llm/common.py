"""What the operators share: tables, written intermediate results, identifiers."""

from __future__ import annotations

import ctypes
import operator
import tempfile
import uuid
from collections.abc import Callable
from contextlib import contextmanager
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_OWN_DIRS: dict[str, str] = {}
#: Paths of intermediate tables that are still there, in the order they were made.
_MADE: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir); where it is unset and all runs on this machine, as in tests, one of its own. On a cluster without that setting it raises."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        app = spark.sparkContext.applicationId
        base = _OWN_DIRS.setdefault(app, "file://" + tempfile.mkdtemp(prefix="quern-"))
    return base.rstrip("/")


def new_path(spark: SparkSession, tag: str) -> str:
    """A fresh path in the shared folder; it is removed when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/quern-{spark.sparkContext.applicationId}/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    _MADE.append(path)
    return path


def give_back() -> None:
    """Return freed memory to the system when a Python task ends: workers live on, and what their allocators keep adds up over a job's stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


@contextmanager
def short_batches(spark: SparkSession, rows: int = 1000, size: str = "4m"):
    """Arrow batches of few rows while what stands below runs, since texts may be long; the session's own settings come back afterwards."""
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {k: spark.conf.get(k, None) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def save(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` once as Parquet to the shared folder and read it back: lineage ends here and lost executors cost only their tasks."""
    spark = df.sparkSession
    path = new_path(spark, tag)
    with short_batches(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._quern_path = path
    return out


def save_counted(df: DataFrame, tag: str) -> tuple[DataFrame, int]:
    """save(), and the number of rows, counted while they are written."""
    rows = Observation()
    out = save(df.observe(rows, F.count(F.lit(1)).alias("n")), tag)
    return out, rows.get.get("n", 0)


def _remove(spark: SparkSession, path: str) -> None:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    if path in _MADE:
        _MADE.remove(path)


def drop_saved(*frames: DataFrame | None) -> None:
    """Remove tables of save() that nothing reads any more."""
    for df in frames:
        path = getattr(df, "_quern_path", None)
        if path:
            _remove(df.sparkSession, path)


def save_alone(make: Callable[[], DataFrame], tag: str) -> DataFrame:
    """save() what ``make`` returns, then remove all intermediate tables that it has left: for the steps of a long job."""
    before = set(_MADE)
    out = save(make(), tag)
    for path in [p for p in _MADE if p not in before and p != out._quern_path]:
        _remove(out.sparkSession, path)
    return out


#: A key counts as hot from 1 / HOT_SHARE of all rows on: there are HOT_SHARE such keys at most, whatever the table.
HOT_SHARE = 1000


def join_hot(rows: DataFrame, one_each: DataFrame, key: str, size: str, total: int, how: str = "inner") -> DataFrame:
    """``rows`` joined with ``one_each`` (one row for each key) on ``key``, however many rows share a key.

    ``size`` is a column of ``one_each``: how many of the ``total`` rows have this key, at least. Keys with at least
    1 / HOT_SHARE of all rows, of which there are HOT_SHARE at most, are broadcast, so that their rows stay where they
    are; the others go by exchange, and none of them fills a task. ``how``: inner or left; rows with a null key match
    nothing and take no part in the exchange.
    """
    hot = one_each.where((F.col(size) * HOT_SHARE >= total) & F.col(key).isNotNull())
    cold = one_each.where(F.col(size) * HOT_SHARE < total)
    keyed = rows.where(F.col(key).isNotNull())
    out = keyed.join(F.broadcast(hot), key).unionByName(keyed.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key, how))
    return out.unionByName(rows.where(F.col(key).isNull()), allowMissingColumns=True) if how == "left" else out


def sha256_hex(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` computed once for each row, however often ``then`` uses it."""
    return F.element_at(F.transform(F.array(value), then), 1)


SPAN = "array<struct<start:int,end:int,text:string>>"


def find_spans(text: Column, pattern: str, gate: Column | None = None, block: int = 256) -> Column:
    """Leftmost non-overlapping matches of a Java pattern as an array of (start, end, text), in code points, end exclusive.

    Matches and the pieces between them come from two scans that find the same matches; positions are their running
    lengths, added up in blocks so that many matches in a text cost little more than one pass. ``gate`` is a cheap
    test that holds for all texts with a match. ``pattern`` must not match the empty string.
    """
    def placed(parts: Column) -> Column:
        lens = lambda: F.transform(parts["found"], lambda m, i: F.struct(F.length(F.get(parts["between"], i)).alias("gap"), F.length(m).alias("len"), m.alias("text")))
        return let(F.struct(lens().alias("x"), F.sequence(F.lit(0), F.floor((F.size(parts["found"]) - 1) / block).cast("int")).alias("b")), from_lengths)

    def from_lengths(s: Column) -> Column:
        part = lambda b: F.slice(s["x"], b * block + 1, F.lit(block))
        totals = F.transform(s["b"], lambda b: F.aggregate(part(b), F.lit(0), lambda a, x: a + x["gap"] + x["len"]))
        return let(totals, lambda t: F.flatten(F.transform(s["b"], lambda b: F.aggregate(part(b), F.struct(F.aggregate(F.slice(t, F.lit(1), b), F.lit(0), lambda a, x: a + x).alias("pos"), F.array().cast(SPAN).alias("out")), step)["out"])))

    def step(acc: Column, x: Column) -> Column:
        start = acc["pos"] + x["gap"]
        return F.struct((start + x["len"]).alias("pos"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), (start + x["len"]).alias("end"), x["text"].alias("text")))).alias("out"))

    hit = F.coalesce(text.rlike(pattern) if gate is None else gate & text.rlike(pattern), F.lit(False))
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"), F.split(text, pattern, -1).alias("between"))
    return F.when(hit, let(both, placed)).otherwise(F.array().cast(SPAN))


#: Characters of a block of text_blocks().
TEXT_BLOCK = 4096


def text_blocks(text: Column) -> Column:
    """A text in blocks of TEXT_BLOCK code points, out of which piece() cuts without walking the whole text each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0))


def piece(blocks: Column, start: Column, end: Column) -> Column:
    """Code points ``start`` to ``end`` of the text that ``blocks`` hold."""
    first, last = F.floor(start / TEXT_BLOCK).cast("int"), F.floor(end / TEXT_BLOCK).cast("int")
    return F.substring(F.array_join(F.slice(blocks, first + 1, last - first + 1), ""), start - first * TEXT_BLOCK + 1, end - start)


def joined(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def meets(span: Column, spans: Column) -> Column:
    """Whether ``span`` overlaps one of ``spans``, which are sorted by start and don't overlap each other: a binary search for the last that starts before its end."""
    def halve(acc: Column, _: Column) -> Column:
        mid = F.floor((acc["lo"] + acc["hi"]) / 2).cast("int")
        before = (acc["lo"] < acc["hi"]) & (F.get(spans, mid)["start"] < span["end"])
        return F.named_struct(F.lit("lo"), F.when(before, mid + 1).otherwise(acc["lo"]), F.lit("hi"), F.when(before | (acc["lo"] >= acc["hi"]), acc["hi"]).otherwise(mid))

    zero = F.named_struct(F.lit("lo"), F.lit(0), F.lit("hi"), F.size(spans))
    steps = F.sequence(F.lit(0), F.ceil(F.log2(F.size(spans) + 1.0)).cast("int"))
    last = F.aggregate(steps, zero, halve, lambda acc: acc["lo"]) - 1
    return (F.size(spans) > 0) & F.coalesce(F.when(last >= 0, F.get(spans, F.greatest(last, F.lit(0)))["end"] > span["start"]), F.lit(False))


def apart(spans: Column, *others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others`` (each an array as meets() takes it)."""
    return F.filter(spans, lambda s: ~reduce(operator.or_, [meets(s, other) for other in others]))


#: Bits of the id filter below: its table has at most MARK_BITS / 32768 rows of 4 KB, 8 MB in all, whatever it is made from.
MARK_BITS = 1 << 26


def probably_in(rows: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """Rows of ``rows`` whose id may be in ``ids`` (one column of longs): all that are, and some that aren't.

    A bitmap of hashed ids, built by aggregates that combine map-side and of fixed size, is broadcast, so that most
    other rows go before an exchange of wide rows. It never takes the place of the join.
    """
    place = lambda c: F.pmod(F.xxhash64(c), F.lit(MARK_BITS)).cast("long")
    marks = ids.select(place(F.col(ids.columns[0])).alias("p")).groupBy(F.bitmap_bucket_number("p").alias("__bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("__bits"))
    at = F.bitmap_bit_position(place(F.col(id_col)))
    byte = F.conv(F.hex(F.substring("__bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(at, F.lit(8)))), F.lit(2)) == 1
    return rows.withColumn("__own", F.bitmap_bucket_number(place(F.col(id_col)))).join(F.broadcast(marks), F.col("__own") == F.col("__bucket")).where(marked).select(*rows.columns)
