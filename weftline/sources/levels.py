"""Tables as levels in buckets: a pass writes what it adds and the keys that it takes away, reading merges.

A table lies in folders, one for each pass that wrote to it, and in each of them
in buckets by the hash of its key. A row of a level is there unless a later
level takes its key away. So a pass writes in proportion to what it changes, and
a reader of few keys opens only their buckets. Levels are merged once there are
many: small ones among themselves, and all with the first once they have grown
to a good part of it, so that a row is written again only a logarithm of times.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, StringType

BUCKET = "in_bucket"
BUCKETS = 64
#: Levels of a table before they are merged, and the part of the first level's bytes from which on all are.
MOST_LEVELS = 6
GROWN = 0.25


@dataclass
class Level:
    """Rows of one pass."""

    number: int
    folder: str
    size: int


@dataclass
class Gone:
    """Values of ``column`` whose rows of earlier levels are gone."""

    number: int
    folder: str
    column: str


@dataclass
class Stored:
    """Where a table is: its key (None: it is kept whole), schema, levels and what they take away."""

    key: str | None
    schema: str
    rows: list[Level] = field(default_factory=list)
    gone: list[Gone] = field(default_factory=list)

    @classmethod
    def of(cls, told: dict) -> Stored:
        return cls(told["key"], told["schema"], [Level(**x) for x in told["rows"]], [Gone(**x) for x in told["gone"]])

    def told(self) -> dict:
        return asdict(self)

    def type(self) -> StructType:
        return StructType.fromJson(json.loads(self.schema))

    def folders(self) -> set[str]:
        return {x.folder for x in (*self.rows, *self.gone)}


def bucket(key: Column) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


def aligned(rows: DataFrame, schema: StructType) -> DataFrame:
    """``rows`` with the schema's columns, null where they lack one."""
    have = set(rows.columns)
    return rows.select(*((F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))


def _size(spark: SparkSession, folder: str) -> int:
    """Bytes of data files under a folder."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(path, True)
    total = 0
    while files.hasNext():
        file = files.next()
        if file.getPath().getName().endswith(".parquet"):
            total += file.getLen()
    return total


def write_rows(rows: DataFrame, key: str | None, folder: str) -> int:
    """Write rows in buckets of their key; bytes written, 0 if there were no rows."""
    if key is None:
        rows.write.parquet(folder)
    else:
        # few files: a bucket's rows come together, and adaptive execution splits a bucket that is too large
        dealt = rows.withColumn(BUCKET, bucket(F.col(key)))
        dealt.hint("rebalance", F.col(BUCKET)).write.partitionBy(BUCKET).parquet(folder)
    return _size(rows.sparkSession, folder)


def read(spark: SparkSession, root: str, table: Stored, keys: list[str] | None = None, levels: list[Level] | None = None) -> DataFrame:
    """The rows that are there; with ``keys`` those of these keys alone, from their buckets alone."""
    schema = table.type()
    stored = StructType([*schema.fields, StructField(BUCKET, StringType())]) if table.key else schema
    frames = []
    for level in table.rows if levels is None else levels:
        rows = spark.read.schema(stored).parquet(f"{root}/{level.folder}")
        if keys is not None and table.key:
            rows = rows.where(F.col(BUCKET).cast("int").isin([bucket(F.lit(k)) for k in keys])).where(F.col(table.key).isin(keys))
        frames.append(rows.drop(BUCKET).withColumn("_level", F.lit(level.number)))
    if not frames:
        return spark.createDataFrame([], schema)
    rows = frames[0]
    for more in frames[1:]:
        rows = rows.unionByName(more)
    first = min(level.number for level in table.rows)
    for column in sorted({g.column for g in table.gone}):
        lost = None
        for g in table.gone:
            if g.column == column and g.number > first:
                one = spark.read.schema("_key string").parquet(f"{root}/{g.folder}").withColumn("_gone", F.lit(g.number))
                lost = one if lost is None else lost.unionByName(one)
        if lost is None:
            continue
        if keys is not None and column == table.key:
            lost = lost.where(F.col("_key").isin(keys))
        lost = lost.groupBy("_key").agg(F.max("_gone").alias("_gone"))
        rows = rows.join(lost, F.col(column) == F.col("_key"), "left").where("_gone is null or _level >= _gone").drop("_key", "_gone")
    return rows.select(schema.fieldNames())


def merged(spark: SparkSession, root: str, table: Stored, number: int, folder: str) -> Stored:
    """The table in fewer levels: all in one if the later ones have grown, else these among themselves."""
    base, *later = sorted(table.rows, key=lambda level: level.number)
    if not later or sum(level.size for level in later) >= GROWN * base.size:
        size = write_rows(read(spark, root, table), table.key, f"{root}/{folder}/rows")
        return Stored(table.key, table.schema, [Level(number, f"{folder}/rows", size)], [])
    rows = read(spark, root, table, levels=later)
    size = write_rows(rows, table.key, f"{root}/{folder}/rows")
    gone = []
    for i, column in enumerate(sorted({g.column for g in table.gone})):
        # what is left of later levels stands above all that any of them takes away
        lost = [spark.read.schema("_key string").parquet(f"{root}/{g.folder}") for g in table.gone if g.column == column]
        every = lost[0]
        for more in lost[1:]:
            every = every.unionByName(more)
        every.distinct().write.parquet(f"{root}/{folder}/gone-{i}")
        gone.append(Gone(number, f"{folder}/gone-{i}", column))
    return Stored(table.key, table.schema, [base, *([Level(number, f"{folder}/rows", size)] if size else [])], gone)
