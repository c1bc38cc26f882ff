"""Reports over stored captures and scans (Parquet or JSON Lines tables)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def save(df: DataFrame, path: str, partition_by: str | None = None, mode: str = "append") -> None:
    """Append a table; ``mode='overwrite'`` replaces only the partitions that the rows are in."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(partition_by).option("partitionOverwriteMode", "dynamic")
    writer.parquet(path)


def append_records(df: DataFrame, kind: str, ts_us: str, path: str) -> None:
    """Rows as JSON lines of type, time and data."""
    data = F.struct(*[F.col(c) for c in df.columns])
    df.select(F.lit(kind).alias("type"), F.col(ts_us).alias("ts"), data.alias("data")).write.mode("append").json(path)


#: Where a line lies: its file, the split of it, and its turn within the split.
PLACE = ("_file", "_split", "_turn")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``value`` of each line of text files and its place.

    A split is read by one task from its first line to its last, so the turn grows along it;
    sorting by place gives the lines as they stand in the file, files by name.  No pass counts
    lines, and numbers need not be gapless for that.
    """
    return spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_split"), F.monotonically_increasing_id().alias("_turn"))


def _edge(rows: DataFrame, first: int | None = None, last: int | None = None) -> DataFrame:
    """The first or last so many lines by place, in the order of the file; all without a number (or with 0)."""
    ordered = [F.asc(c) for c in PLACE]
    if last:
        rows = rows.orderBy(*[F.desc(c) for c in PLACE]).limit(last).orderBy(*ordered)
    elif first:
        rows = rows.orderBy(*ordered).limit(first)
    return rows.drop(*PLACE)


def records(spark: SparkSession, path: str, kind: str | None = None, last: int | None = None) -> DataFrame:
    """type, ts and data of JSON lines; lines that do not parse are passed over; ``last`` keeps those that stand last."""
    parsed = lines(spark, path).select(F.from_json("value", "type string, ts long").alias("r"), F.get_json_object("value", "$.data").alias("data"), F.try_parse_json("value").isNotNull().alias("whole"), *PLACE)
    rows = parsed.where("whole").select("r.type", "r.ts", "data", *PLACE)
    return _edge(rows if not kind else rows.where(F.col("type") == kind), last=last)


def search_lines(spark: SparkSession, path: str, part: str, limit: int = 100) -> DataFrame:
    """``value`` of the first JSON lines that contain the text, in either case; an empty text is in none."""
    found = lines(spark, path).where(F.contains(F.lower("value"), F.lit(part.lower())) & F.lit(part != ""))
    return _edge(found.where(F.try_parse_json("value").isNotNull()), first=limit)


def recent(df: DataFrame, by: str, limit: int, tie: str) -> DataFrame:
    return df.orderBy(F.desc(by), tie).limit(limit)


def search(hosts: DataFrame, columns: list[str], part: str, order: str) -> DataFrame:
    """Rows with the text in any of the columns, in either case."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(part.lower())), F.lit(False)) for c in columns])
    return hosts.where(hit).orderBy(order)


def counts(tables: dict[str, DataFrame]) -> DataFrame:
    """name and number of rows of each table."""
    each = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("name"), "rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, each)


def detail(hosts: DataFrame, ports: DataFrame) -> DataFrame:
    """Hosts with counts of their ports: an equi-join on scan and address."""
    counted = ports.groupBy("scan_id", "address").agg(F.count_if(F.col("state") == "open").alias("open"), F.count(F.lit(1)).alias("ports"))
    return hosts.join(counted, ["scan_id", "address"]).select("address", "ttl", "open", "ports")


def latest(df: DataFrame, key: str, by: str) -> DataFrame:
    """One row for each key, the one with the largest ``by``."""
    row = F.struct(*[F.col(c) for c in df.columns])
    return df.groupBy(key).agg(F.max_by(row, F.col(by)).alias("_row")).select("_row.*")


def flow_report(flows: DataFrame, capture_id: str | None = None, limit: int = 200) -> DataFrame:
    """Stored flows of one or all captures, those with most bytes first."""
    rows = flows if capture_id is None else flows.where(F.col("capture_id") == capture_id)
    return rows.orderBy(F.desc("bytes"), *[c for c in rows.columns if c != "bytes"]).limit(limit)


def packet_report(packets: DataFrame, capture_id: str | None = None, limit: int = 500) -> DataFrame:
    """Stored packets of one or all captures, the highest numbers first; the choice of a capture precedes the limit."""
    rows = packets if capture_id is None else packets.where(F.col("capture_id") == capture_id)
    return rows.orderBy(F.desc("number"), *[c for c in rows.columns if c != "number"]).limit(limit)


#: Flows of a capture that are stored.
STORED_FLOWS = 5000


def stored_flows(flows: DataFrame, capture_id: str) -> DataFrame:
    """The rows that storing a capture keeps of its flows: the most recent ones."""
    key = ("a_ip", "a_port", "b_ip", "b_port", "proto")
    return flows.orderBy(F.desc("last_us"), *key).limit(STORED_FLOWS).withColumn("capture_id", F.lit(capture_id))


def save_capture(summary: DataFrame, flows: DataFrame, capture_id: str, path: str) -> None:
    """A capture's summary and flows in partitions of its id; saving it again replaces them."""
    save(summary.withColumn("capture_id", F.lit(capture_id)), f"{path}/captures", "capture_id", "overwrite")
    save(stored_flows(flows, capture_id), f"{path}/flows", "capture_id", "overwrite")
