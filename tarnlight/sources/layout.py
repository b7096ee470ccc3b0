"""Tables clustered on several columns, read by file statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits that each column gives to a row's place: a column is cut into that power of two of ranges of about equal weight.
BITS = 8


def interleaved(ranks: list[Column], bits: int = BITS) -> Column:
    """The Z-order of ranks: their bits in turn, the first column's highest first."""
    n = len(ranks)
    parts = [F.shiftleft(F.shiftright(rank, bit).bitwiseAND(F.lit(1)).cast("long"), bit * n + n - 1 - i) for bit in range(bits) for i, rank in enumerate(ranks)]
    place = parts[0]
    for part in parts[1:]:
        place = place.bitwiseOR(part)
    return place


@dataclass
class ClusteredTable:
    """A folder of Parquet files whose rows are near each other in several columns, with the least and largest value of each file."""

    spark: SparkSession
    folder: str
    columns: list[str]

    @classmethod
    def write(cls, frame: DataFrame, folder: str, columns: list[str], files: int) -> ClusteredTable:
        """Write frame in about `files` files, clustered on at most 7 columns of numbers, dates, times or strings, over what is there.

        Every column's ranks come from approximate quantiles (255 at most a column, taken over all rows); rows are dealt by ranges of the interleaved ranks and sorted by them, so a file covers a small range of each column. Equal
        rows of one place, however many, are in one task only if they are equal in all columns: the ranges are of place and then of a hash of the row. Nulls rank lowest.
        """
        if not 1 <= len(columns) <= 7:
            raise ValueError("one to seven columns")
        spark = frame.sparkSession
        cuts = [i / (1 << BITS) for i in range(1, 1 << BITS)]
        numbered = [F.unix_micros(F.col(c).cast("timestamp")) if frame.schema[c].dataType.typeName() in ("timestamp", "timestamp_ntz", "date") else F.col(c) for c in columns]
        numbers = [c for c in columns if frame.schema[c].dataType.typeName() != "string"]
        found = frame.agg(*[F.percentile_approx(numbered[columns.index(c)], cuts, 10_000).alias(c) for c in numbers]).first().asDict() if numbers else {}
        for c in columns:
            if c not in numbers:  # strings have no quantiles: those of a sample of bounded size, in order
                some = sorted(r[0] for r in frame.select(c).filter(F.col(c).isNotNull()).orderBy(F.xxhash64(c, F.rand(7))).limit(20_000).collect())
                found[c] = [some[int(q * len(some))] for q in cuts] if some else None
        ranks = []
        for c, number in zip(columns, numbered, strict=True):
            bounds = sorted(set(found[c] or []))
            ranks.append(_rank(number, bounds))
        place = interleaved(ranks)
        frame.withColumn("_place", place).repartitionByRange(files, F.col("_place"), F.xxhash64(*frame.columns)).sortWithinPartitions("_place").drop("_place").write.mode("overwrite").parquet(f"{folder}/rows")
        written = spark.read.schema(frame.schema).parquet(f"{folder}/rows")
        ends = [f(c).alias(f"{name}_{c}") for c in columns for name, f in (("low", F.min), ("high", F.max))]
        written.groupBy(F.input_file_name().alias("file")).agg(F.count("*").alias("n_rows"), *ends).coalesce(1).write.mode("overwrite").parquet(f"{folder}/files")
        return cls(spark, folder, list(columns))

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> ClusteredTable:
        names = spark.read.parquet(f"{folder}/files").columns
        return cls(spark, folder, [c.removeprefix("low_") for c in names if c.startswith("low_")])

    def read(self, ranges: dict[str, tuple]) -> DataFrame:
        """The rows whose columns lie within the ranges (lowest and highest value, either None for open); only files that may have some are read. A null lies in no range."""
        stats = self.spark.read.parquet(f"{self.folder}/files")
        inside, may = F.lit(True), F.lit(True)
        for c, (low, high) in ranges.items():
            if c not in self.columns:
                raise ValueError(f"{c} is not one of {self.columns}")
            inside, may = inside & F.col(c).isNotNull(), may & F.col(f"low_{c}").isNotNull()
            if low is not None:
                inside, may = inside & (F.col(c) >= F.lit(low)), may & (F.col(f"high_{c}") >= F.lit(low))
            if high is not None:
                inside, may = inside & (F.col(c) <= F.lit(high)), may & (F.col(f"low_{c}") <= F.lit(high))
        files = [r.file for r in stats.filter(may).select("file").collect()]  # names of the files that are read
        schema = self.spark.read.parquet(f"{self.folder}/rows").schema
        return self.spark.read.schema(schema).parquet(*files).filter(inside) if files else self.spark.createDataFrame([], schema)


def _rank(value: Column, bounds: list) -> Column:
    """How many bounds are at or below the value; 0 for a null."""
    if not bounds:
        return F.lit(0)
    return F.coalesce(F.size(F.filter(F.array(*map(F.lit, bounds)), lambda bound: bound <= value)), F.lit(0))
