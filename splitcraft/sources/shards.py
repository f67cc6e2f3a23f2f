"""Line order, round-robin shards, shard merging, first-wins dedup of raw
pair files, and per-stage row counts.

``row_index`` gives every row its 0-based position in a total order
without a single-partition window: range-partition and sort by the order,
take the per-partition position from ``monotonically_increasing_id`` (its
low 33 bits), and add the partition's offset from a per-partition count
(one small aggregate, one row per partition).

``read_numbered`` gives the lines of files their numbers as they are scanned:
Spark tells for each row the file and the split of it (``_metadata``), the rows of a split
are numbered in a row, and a count per split gives the lines in front of it.
No line is sorted or shuffled, however the splits are packed into tasks.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..session import materialize

_LOW33 = (1 << 33) - 1


def row_index(df: DataFrame, order_cols: list[str], out_col: str = "row_idx",
              partitions: int | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (must be a total
    order, e.g. ending in a unique id)."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    srt = df.repartitionByRange(n, *order_cols).sortWithinPartitions(*order_cols)
    # written once: the counts and the rows below must see the same range
    # bounds and ids, also when a lost executor forces a recomputation
    mid = materialize(srt.withColumn("_mid", F.monotonically_increasing_id()))
    mid = mid.withColumn("_pid", F.shiftright(F.col("_mid"), 33)).withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW33)))
    counts = mid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = counts.withColumn("_off", F.sum("_n").over(Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)))
    offs = offs.select("_pid", F.coalesce("_off", F.lit(0)).alias("_off"))
    return (mid.join(F.broadcast(offs), "_pid")   # one row per partition
               .withColumn(out_col, F.col("_off") + F.col("_loc"))
               .drop("_mid", "_pid", "_loc", "_off"))


def read_numbered(read, path, out_col: str = "line_no") -> DataFrame:
    """``read(path)`` (a file scan, nothing done to it yet) with the 0-based
    number of each line over all files: files of a folder by name, several paths
    in the order given, a file by the places of its splits."""
    paths = [path] if isinstance(path, str) else list(path)
    rows = None
    for i, p in enumerate(paths):
        scan = read(p)
        part = scan.select(*[F.col(f"`{c}`") for c in scan.columns], F.lit(i).alias("_ord"), F.col("_metadata.file_path").alias("_file"),
                           F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_mid"))
        rows = part if rows is None else rows.unionByName(part, allowMissingColumns=True)
    split = ["_ord", "_file", "_block"]
    counts = rows.groupBy(*split).agg(F.min("_mid").alias("_first"), F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(*split).rowsBetween(Window.unboundedPreceding, -1)
    shifts = counts.select(*split, (F.coalesce(F.sum("_n").over(before), F.lit(0)) - F.col("_first")).alias("_shift"))
    return (rows.join(F.broadcast(shifts), split)   # one row per split of the input
                .withColumn(out_col, F.col("_mid") + F.col("_shift")).drop(*split, "_mid", "_shift"))


def shard_round_robin(df: DataFrame, order_cols: list[str], num_shards: int, shard_col: str = "shard") -> DataFrame:
    """Line i (in ``order_cols`` order) goes to shard i mod n; also keeps the
    line's position inside its shard (``shard_pos``)."""
    idx = row_index(df, order_cols, "_i")
    return (idx.withColumn(shard_col, F.pmod(F.col("_i"), F.lit(num_shards)).cast("int"))
               .withColumn("shard_pos", F.floor(F.col("_i") / num_shards).cast("long"))
               .drop("_i"))


def shard_path(path: str, k: int) -> str:
    """Name of shard k (0-based): ``<path>_part<k+1>`` (a trailing separator stays)."""
    if path.endswith("/"):
        return path[:-1] + f"_part{k + 1}/"
    return path + f"_part{k + 1}"


def write_shard_files(lines: DataFrame, order_cols: list[str], line_col: str, path: str, num_shards: int) -> list[str]:
    """Deal the text lines of ``line_col`` round-robin, in ``order_cols`` order, to
    ``num_shards`` named shards (``shard_path``) and return their paths.

    All shards are written in one pass: rows are dealt by ranges of (shard,
    place) and sorted, so the files of a shard hold its lines in the order of
    their names, however many tasks write it.  The finished folders then get
    their names, one rename a shard.  A line must hold no line break (as JSON lines
    don't); a null one is an empty line.  An existing shard is not overwritten."""
    spark = lines.sparkSession
    fs_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    names = [shard_path(path, k) for k in range(num_shards)]
    work = fs_path(path.rstrip("/") + "_writing")
    fs = work.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for name in [*names, work.toString()]:
        if fs.exists(fs_path(name)):
            raise FileExistsError(name)
    rows = lines.select(*[F.col(f"`{c}`") for c in order_cols], F.coalesce(F.col(line_col), F.lit("")).alias("_line"))
    sharded = shard_round_robin(rows, order_cols, num_shards).select(F.col("_line").alias("value"), "shard", "shard_pos")
    n = int(spark.conf.get("spark.sql.shuffle.partitions", "200"))
    (sharded.repartitionByRange(n, "shard", "shard_pos").sortWithinPartitions("shard", "shard_pos").drop("shard_pos")
     .write.partitionBy("shard").text(work.toString()))
    for k, name in enumerate(names):
        part = fs_path(work, f"shard={k}")
        # fewer lines than shards: the others are empty
        done = fs.rename(part, fs_path(name)) if fs.exists(part) else fs.mkdirs(fs_path(name))
        if not done:
            raise OSError(f"{part.toString()} can't be renamed to {name}")
    fs.delete(work, True)
    return names


def read_shard_files(spark: SparkSession, path: str, num_shards: int, group: int = 1) -> DataFrame:
    """``value, shard, shard_pos, merged_pos`` of the shards of ``path``: the lines
    with their places in their shards (``read_numbered``), interleaved ``group`` lines at a time."""
    rows = None
    for k in range(num_shards):
        part = read_numbered(spark.read.text, shard_path(path, k), "shard_pos").withColumn("shard", F.lit(k))
        rows = part if rows is None else rows.unionByName(part)
    return merge_shards(rows, group).select("value", "shard", "shard_pos", "merged_pos")


def write_shards(sharded: DataFrame, path: str, shard_col: str = "shard", fmt: str = "parquet") -> None:
    """One folder per shard in a single pass (``partitionBy``)."""
    sharded.write.mode("overwrite").partitionBy(shard_col).format(fmt).save(path)


def merge_shards(sharded: DataFrame, group: int, shard_col: str = "shard", pos_col: str = "shard_pos",
                 out_col: str = "merged_pos") -> DataFrame:
    """Interleave shards ``group`` lines at a time, skipping exhausted shards
    (a short last group is accepted): order by (pos div group, shard, pos)."""
    keyed = sharded.withColumn("_blk", F.floor(F.col(pos_col) / group))
    return row_index(keyed, ["_blk", shard_col, pos_col], out_col).drop("_blk")


def first_wins(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Keep, per key, the row that comes first in ``order_cols`` order.
    A min-by aggregate (partial aggregation before the shuffle), so a key
    holding a third of all rows never lands whole in one task."""
    others = [c for c in df.columns if c not in key_cols]
    best = df.groupBy(*key_cols).agg(F.min(F.struct(*[F.col(c) for c in order_cols],
                                                    *[F.col(c).alias(f"_v_{c}") for c in others])).alias("_b"))
    return best.select(*key_cols, *[F.col(f"_b._v_{c}").alias(c) for c in others])


def read_raw_pairs(spark: SparkSession, path, remove_index: bool = True, drop_dups: bool = True) -> DataFrame | None:
    """Raw pair file: split each line on tab (no quoting).  Width != 2 with
    ``remove_index``: keep fields 1, 2 as (c0, c1), dedup key c0; width 2:
    (c0, c1), dedup key c1; otherwise all fields, key c1.  First line wins,
    over all files and splits (``read_numbered``).  Empty file -> None."""
    raw = read_numbered(spark.read.text, path)
    parts = raw.select("line_no", F.split("value", "\t", -1).alias("f"))
    width = parts.agg(F.max(F.size("f"))).first()[0]
    if width is None:
        return None
    if width != 2 and remove_index:
        df = parts.select("line_no", F.get("f", 1).alias("c0"), F.get("f", 2).alias("c1"))
        key = "c0"
    else:
        df = parts.select("line_no", *[F.get("f", i).alias(f"c{i}") for i in range(width)])
        key = "c1"
    if drop_dups:
        df = first_wins(df, [key], ["line_no"])
    return df


def stage_counts(stages: dict[str, DataFrame]) -> DataFrame:
    """(stage, rows) for named frames, as one union + group-by."""
    out = None
    for name, d in stages.items():
        part = d.select(F.lit(name).alias("stage"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("stage").agg(F.count(F.lit(1)).alias("rows"))
