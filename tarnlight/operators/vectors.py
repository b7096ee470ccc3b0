"""Nearest vectors by an inverted-file index."""

from __future__ import annotations

import math
import statistics
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlight.operators import top_per_group
from tarnlight.scratch import Scratch

#: Rows of a cell and queries that one block compares; their products are 32 MB.
BLOCK_ROWS = 4096
BLOCK_QUERIES = 1024
#: Rows and queries of a group when all are compared, at most about.
PART_ROWS = 16_384
PART_QUERIES = 16_384
#: Digits after the point that scores are rounded to before they are ordered, so that ties do not depend on the order of sums.
DIGITS = 6


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 12, seed: int = 7) -> np.ndarray:
    """Centres of k-means cells of a sample (Lloyd's rounds from rows drawn at random); no more cells than distinct rows."""
    rows = np.unique(sample, axis=0)
    rng = np.random.default_rng(seed)
    centres = rows[rng.permutation(len(rows))[:cells]].astype(np.float64)
    for _ in range(rounds):
        near = np.argmin((centres**2).sum(1) - 2 * sample @ centres.T, axis=1)
        counts = np.bincount(near, minlength=len(centres))
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        filled = counts > 0
        centres[filled] = sums[filled] / counts[filled, None]
    return centres


def nearest(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, vec_id, product: the vector of rows(vec_id, embedding) with the largest dot product with each of queries(query_id, query) by comparing all, the lower id on ties; never the query's own id.

    Rows and queries are dealt to parts of bounded size, and each part of rows meets each part of queries in a group of its own, which hands on one row a query. So no pair of
    vectors is ever a row: what is shuffled is each row once for every part of queries, each query once for every part of rows, and a result for each of the latter. Products are compared after
    rounding to 6 digits. A null id, or a vector that is null, empty or has a null or NaN, is near nothing; vectors of different lengths don't meet. Repeated query ids are one query, which finds its best.
    """
    spark = rows.sparkSession
    sound = "{0} is not null and size({1}) > 0 and not exists({1}, x -> x is null or isnan(x))"
    some = queries.filter(sound.format("query_id", "query")).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"), F.size("query").alias("width"))
    all_rows = rows.filter(sound.format("vec_id", "embedding")).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"), F.size("embedding").alias("width"))
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    row_parts = max(least, -(-all_rows.count() // PART_ROWS))
    query_parts = max(1, -(-some.count() // PART_QUERIES))
    dealt = all_rows.withColumn("row_part", F.pmod(F.xxhash64("vec_id"), F.lit(row_parts)).cast("int")).withColumn("query_part", F.explode(F.sequence(F.lit(0), F.lit(query_parts - 1))))
    asked = some.withColumn("query_part", F.pmod(F.xxhash64("query_id"), F.lit(query_parts)).cast("int")).withColumn("row_part", F.explode(F.sequence(F.lit(0), F.lit(row_parts - 1))))
    key = ["width", "row_part", "query_part"]
    digits, block_rows, block_queries = DIGITS, BLOCK_ROWS, BLOCK_QUERIES

    def compare(rows: pa.Table, some: pa.Table) -> pa.Table:
        import numpy as np
        import pyarrow as pa

        schema = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("product", pa.float64())])
        if not len(rows) or not len(some):
            return schema.empty_table()
        ids, own = rows["vec_id"].to_numpy(), some["query_id"].to_numpy()
        by_id = np.argsort(ids, kind="stable")  # the first of the largest is then the lowest id
        ids = ids[by_id]
        x = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)[by_id]
        q = some["query"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
        best, at = np.full(len(q), -np.inf), np.full(len(q), -1)
        for low in range(0, len(q), block_queries):
            here = slice(low, low + block_queries)
            for first in range(0, len(x), block_rows):
                product = np.round(q[here] @ x[first : first + block_rows].T, digits) + 0.0
                product[own[here, None] == ids[None, first : first + block_rows]] = -np.inf
                top = product.argmax(axis=1)
                most = product[np.arange(len(top)), top]
                better = most > best[here]
                best[here][better], at[here][better] = most[better], top[better] + first
        met = at >= 0
        return pa.table([pa.array(own[met]), pa.array(ids[at[met]]), pa.array(best[met])], schema=schema)

    found = dealt.groupBy(*key).cogroup(asked.groupBy(*key)).applyInArrow(compare, "query_id long, vec_id long, product double")
    best = found.groupBy("query_id").agg(F.max("product").alias("most"), F.min_by("vec_id", F.struct(-F.col("product"), F.col("vec_id"))).alias("vec_id"))
    return best.select("query_id", "vec_id", F.col("most").alias("product"))


@dataclass
class VectorIndex:
    """Vectors in cells: a table of rows by cell in a folder, and each cell's centre, radius and number of rows.

    Vectors that are equal are one row with their number and their `copies` lowest ids, which is all that a search for fewer neighbours can
    return. Rows are written by ranges of cell and id, so a large cell is in several files, and a search for few cells skips row groups by their statistics.
    """

    spark: SparkSession
    folder: str
    centres: np.ndarray
    radii: np.ndarray
    sizes: np.ndarray
    copies: int

    @classmethod
    def build(cls, vectors: DataFrame, folder: str, cells: int | None = None, copies: int = 16, sample_rows: int = 20_000, seed: int = 7) -> VectorIndex:
        """Index vectors(vec_id, embedding) into the folder.

        Cells are fitted on at most sample_rows rows, those with the lowest hashes of their ids; every row is then put into
        its nearest cell. cells is twice the root of the number of rows by default, 4096 at most. A null embedding, or one with a null
        or NaN in it or of another length than most of the sample's, is near nothing and left out. No rows give an index without cells.
        """
        spark = vectors.sparkSession
        good = vectors.filter("vec_id is not null and size(embedding) > 0 and not exists(embedding, x -> x is null or isnan(x))").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
        first = top_per_group(good.withColumn("mark", F.xxhash64("embedding")), ["mark", "embedding"], [F.col("vec_id")], copies)
        rows = first.groupBy("mark", "embedding").agg(F.min("vec_id").alias("first_id"), F.array_sort(F.collect_list("vec_id")).alias("ids")).drop("mark")
        scratch = Scratch(spark, "vector-index")
        rows = scratch.write(rows, "distinct")
        sample = [r.embedding for r in rows.orderBy(F.xxhash64("first_id"), "first_id").limit(sample_rows).select("embedding").collect()]
        width = statistics.mode(map(len, sample)) if sample else 0
        sample = np.array([x for x in sample if len(x) == width], np.float64).reshape(-1, width or 1)
        rows = rows.filter(F.size("embedding") == width)
        wanted = cells or min(4096, max(1, 2 * math.isqrt(rows.count())))
        centres = fit_cells(sample, wanted, seed=seed) if len(sample) else np.zeros((0, 0))
        known = spark.sparkContext.broadcast(centres)

        def assign(batches):
            import numpy as np
            import pyarrow as pa

            own = known.value
            for batch in batches:
                if not batch.num_rows:
                    continue
                at = batch.schema.get_field_index("embedding")
                x = batch.column(at).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                near = np.argmin((own**2).sum(1) - 2 * x @ own.T, axis=1)
                far = np.sqrt(((x - own[near]) ** 2).sum(1))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(near.astype(np.int32)), pa.array(far)], [*batch.schema.names, "cell", "distance"])

        placed = rows.mapInArrow(assign, "embedding array<double>, first_id long, ids array<long>, cell int, distance double")
        placed = scratch.write(placed, "placed")
        placed.repartitionByRange("cell", "first_id").sortWithinPartitions("cell", "first_id").write.mode("overwrite").parquet(f"{folder}/rows")
        stats = {r.cell: (r.radius, r.n) for r in placed.groupBy("cell").agg(F.max("distance").alias("radius"), F.count("*").alias("n")).collect()}  # a row for each cell
        about = [(i, c.tolist(), float(stats.get(i, (0.0, 0))[0]), int(stats.get(i, (0.0, 0))[1]), copies) for i, c in enumerate(centres)]
        spark.createDataFrame(about, "cell int, centre array<double>, radius double, n long, copies int").coalesce(1).write.mode("overwrite").parquet(f"{folder}/cells")
        known.unpersist()
        return cls.open(spark, folder)

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> VectorIndex:
        about = spark.read.parquet(f"{folder}/cells").orderBy("cell").collect()  # a row for each cell
        return cls(spark, folder, np.array([r.centre for r in about], np.float64), np.array([r.radius for r in about]), np.array([r.n for r in about], np.int64), about[0].copies if about else 1)

    def search(self, queries: DataFrame, k: int = 1, probes: int | None = None, exact: bool = False) -> DataFrame:
        """query_id, vec_id, product, place: the k vectors with the largest dot products with each of queries(query_id, query), the lower id on ties; never the query's own id.

        The `probes` cells whose centres have the largest products with the query are looked into (half of the cells by default, which finds nine of ten neighbours even of vectors without any clusters; with clusters a few cells do). With exact,
        so are then all further cells that may hold a better vector: no product is larger than the centre's plus the query's length times the cell's
        radius. Queries and rows meet by cell, in blocks of bounded size, and each block hands on at most k + 1 rows a query; so no pair is
        shuffled, and a hot cell is many blocks. Products are compared after rounding to 6 digits. A query that is null, of another
        length, or has a null or NaN finds nothing; queries with one id should be one row.
        """
        if len(self.centres) and k >= self.copies:
            raise ValueError(f"the index keeps {self.copies} ids of equal vectors; k must be less")
        cells = len(self.centres)
        schema = "query_id long, vec_id long, product double, place int"
        if not cells:
            return self.spark.createDataFrame([], schema)
        good = "query_id is not null and query is not null and not exists(query, x -> x is null or isnan(x))"
        own = queries.filter(good).filter(F.size("query") == self.centres.shape[1]).select(F.col("query_id").cast("long").alias("query_id"), F.col("query").cast("array<double>").alias("query"))
        scratch = Scratch(self.spark, "vector-search")
        own = scratch.write(own, "queries")
        probes = min(cells, probes or math.ceil(cells / 2))
        looked = scratch.write(self._probed(own.withColumn("least", F.lit(None).cast("double")), probes), "probes")
        found = scratch.write(self._compared(looked, k, scratch, "first"), "found")
        if exact and probes < cells:
            # the k-th best product so far; with fewer than k found, any cell may help
            best = top_per_group(found.withColumn("vec_id", F.explode("ids")).filter("vec_id != query_id"), ["query_id"], [F.col("product").desc(), F.col("vec_id")], k)
            least = best.filter(F.col("place") == k).select("query_id", F.col("product").alias("least"))
            rest = self._probed(own.join(least, "query_id", "left").withColumn("least", F.coalesce("least", F.lit(float("-inf")))), probes)
            looked = scratch.write(rest, "more-probes")
            found = found.unionByName(scratch.write(self._compared(looked, k, scratch, "more"), "more"))
        best = top_per_group(found.withColumn("vec_id", F.explode("ids")).filter("vec_id != query_id"), ["query_id"], [F.col("product").desc(), F.col("vec_id")], k)
        return best.select("query_id", "vec_id", "product", "place")

    def _probed(self, queries: DataFrame, probes: int) -> DataFrame:
        """query_id, query, cell: without `least` the nearest cells, with it all others that may hold a product of at least that."""
        known = self.spark.sparkContext.broadcast((self.centres, self.radii, self.sizes))

        def probe(batches):
            import numpy as np
            import pyarrow as pa

            centres, radii, sizes = known.value
            for batch in batches:
                n = batch.num_rows
                if not n:
                    continue
                ids, flat, least = (batch.column(batch.schema.get_field_index(c)) for c in ("query_id", "query", "least"))
                x = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                near = x @ centres.T
                near[:, sizes == 0] = -np.inf
                first = np.zeros(near.shape, bool)
                np.put_along_axis(first, np.argsort(-near, axis=1, kind="stable")[:, :probes], True, axis=1)
                if least.null_count == n:
                    wanted = first
                else:
                    most = near + np.sqrt((x**2).sum(1))[:, None] * radii[None, :]
                    wanted = ~first & (most + 1e-6 >= least.to_numpy(zero_copy_only=False)[:, None])
                at, cell = np.nonzero(wanted & (sizes > 0)[None, :])
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(at)), flat.take(pa.array(at)), pa.array(cell.astype(np.int32))], ["query_id", "query", "cell"])

        return queries.mapInArrow(probe, "query_id long, query array<double>, cell int")

    def _compared(self, looked: DataFrame, k: int, scratch: Scratch, name: str) -> DataFrame:
        """query_id, first_id, ids, product: the best k + 1 rows of each block for each of looked(query_id, query, cell)."""
        asked = np.zeros(len(self.centres), np.int64)
        for r in looked.groupBy("cell").agg(F.count("*").alias("n")).collect():  # a row for each cell
            asked[r.cell] = r.n
        plan = [(i, int(-(-self.sizes[i] // BLOCK_ROWS)), int(-(-asked[i] // BLOCK_QUERIES))) for i in range(len(asked)) if asked[i]]
        blocks = F.broadcast(self.spark.createDataFrame(plan, "cell int, row_parts int, query_parts int"))  # as many rows as cells at most
        some = looked.join(blocks, "cell").withColumn("query_part", F.pmod(F.xxhash64("query_id"), "query_parts")).withColumn("row_part", F.explode(F.expr("sequence(0, row_parts - 1)")))
        rows = self.spark.read.parquet(f"{self.folder}/rows").join(blocks, "cell").withColumn("row_part", F.pmod(F.xxhash64("first_id"), "row_parts").cast("int"))
        rows = rows.withColumn("query_part", F.explode(F.expr("sequence(0L, query_parts - 1L)")))
        key = ["cell", "row_part", "query_part"]
        digits = DIGITS

        def compare(rows: pa.Table, some: pa.Table) -> pa.Table:
            import numpy as np
            import pyarrow as pa

            schema = pa.schema([("query_id", pa.int64()), ("first_id", pa.int64()), ("ids", pa.list_(pa.int64())), ("product", pa.float64())])
            if not len(rows) or not len(some):
                return schema.empty_table()
            x = rows["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1)
            q = some["query"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(some), -1)
            product = np.round(q @ x.T, digits) + 0.0
            take = min(k + 1, len(rows))
            bound = np.partition(product, len(rows) - take, axis=1)[:, len(rows) - take]
            at, row = np.nonzero(product >= bound[:, None])
            first = rows["first_id"].to_numpy()
            order = np.lexsort((first[row], -product[at, row], at))
            at, row = at[order], row[order]
            starts = np.searchsorted(at, at)  # where the query's rows begin
            kept = np.arange(len(at)) - starts < take
            at, row = at[kept], row[kept]
            picked = rows.take(pa.array(row))
            return pa.table([some["query_id"].take(pa.array(at)), picked["first_id"], picked["ids"], pa.array(product[at, row])], schema=schema)

        return rows.select(*key, "first_id", "ids", "embedding").groupBy(*key).cogroup(some.select(*key, "query_id", "query").groupBy(*key)).applyInArrow(compare, "query_id long, first_id long, ids array<long>, product double")
