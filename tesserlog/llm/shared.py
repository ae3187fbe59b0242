"""Scratch tables in the shared folder and distributed connected components.

Every intermediate table is a written Parquet table below ``spark.checkpoint.dir``,
which driver and executors share, so a lost executor costs a re-read and never a
recomputation of the whole lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserlog.sources.scratch import scratch_path, shared_dir, written

__all__ = ["bounded_batches", "connected_components", "drop_scratch", "free_name", "id_sieve", "scratch_path", "shared_dir", "sift", "written"]


def drop_scratch(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for root in {f.rsplit("/part-", 1)[0] for f in df.inputFiles()}:
            if "/tesserlog/" in root:
                path = jvm.org.apache.hadoop.fs.Path(root)
                path.getFileSystem(conf).delete(path, True)


#: Bytes of an Arrow batch between Spark and Python; the last row may go beyond.
BATCH_BYTES = 8 << 20


def bounded_batches(df: DataFrame) -> DataFrame:
    """``df``; the session's Arrow batches are bounded by bytes, so that whole texts, which rows do not bound, go through Python in little memory."""
    spark, key = df.sparkSession, "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key)) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))
    return df


def free_name(df: DataFrame, wish: str) -> str:
    """``wish``, or with underscores behind it, so that it clashes with no column of ``df`` (Spark ignores case)."""
    taken = {c.lower() for c in df.columns}
    while wish.lower() in taken:
        wish += "_"
    return wish


#: Bits of a sieve. Its rows are at most a 32nd of them, a size that allows a broadcast whatever the number of ids.
SIEVE = 1 << 23


def id_sieve(ids: DataFrame, id_col: str = "id") -> DataFrame:
    """A bitmap of hashed ids, (word, bits): ``sift`` finds by it every row whose id is among ``ids``, and some others."""
    h = F.pmod(F.xxhash64(F.col(id_col).cast("long")), F.lit(SIEVE))
    each = ids.where(F.col(id_col).isNotNull()).select(h.alias("h"))
    return each.groupBy(F.expr("h div 32").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 32 as int))")).alias("bits"))


def sift(rows: DataFrame, sieve: DataFrame, id_col: str = "id", inside: bool = True) -> DataFrame:
    """The rows whose id may be in the sieve, or else all others with an id. No row is shuffled."""
    word, bits = free_name(rows, "sieve_word"), free_name(rows, "sieve_bits")
    h = f"pmod(xxhash64(cast(`{id_col}` as long)), {SIEVE})"
    bitmap = F.broadcast(sieve.select(F.col("word").alias(word), F.col("bits").alias(bits)))
    met = rows.where(F.col(id_col).isNotNull()).join(bitmap, F.expr(f"{h} div 32") == F.col(word), "inner" if inside else "left")
    hit = F.expr(f"(`{bits}` & shiftleft(1L, cast({h} % 32 as int))) != 0")
    return met.where(hit if inside else ~F.coalesce(hit, F.lit(False))).select(*[rows[c] for c in rows.columns])


def connected_components(edges: DataFrame, tag: str) -> DataFrame:
    """Label every node of ``edges(u, v)`` with the least node of its component.

    Alternating large-star / small-star rounds (Kiveris et al., 2014): the edge set
    only ever shrinks towards one star per component. Hub nodes meet in aggregates that
    combine map-side, whose results are written, so that both sides of the joins that
    follow are plain exchanges and adaptive execution can split a hub's partition. Each
    round is a written table. Returns (node, comp) for nodes with at least one edge to another node.
    """
    e = written(
        edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), f"{tag}-e"
    )
    state = None
    while True:
        seen = e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        now = (seen["n"], seen["s"])
        if now == state or now[0] == 0:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = written(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), f"{tag}-m")
        large = written(both.join(first, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{tag}-l")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), f"{tag}-m")
        small = (
            large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v")))
        )
        last, e = e, written(small.distinct(), f"{tag}-e")
        drop_scratch(last, first, large, least)
