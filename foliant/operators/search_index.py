"""A trigram index for searches by terms: bitmaps of rows by bucket, intersected, and the rows that are left compared exactly.

Volumes are dealt into buckets of at most ROWS rows, a folder each. For each field and trigram of it (in lower case) and each bucket the index has a bitmap of the rows
that have it. A term of three characters or more is in a field only if all its trigrams are, so the bitmaps of a search's trigrams are intersected in Spark,
and only buckets where a row is left are read. Shorter terms narrow nothing. What is read goes through field_search, so results are those of a whole scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..shared import saved
from .search import field_search, grams_of, search_fields

#: Rows of a bucket, about half of the places of a bitmap; folders that trigrams are dealt into.
ROWS, SHARDS = 1 << 14, 64
_PLACES = 1 << 15


class SearchIndex:
    """Volumes and their index under a folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def build(self, volumes: DataFrame, rows: int = ROWS) -> None:
        """Writes the volumes and their index. Buckets are even, whatever ids repeat."""
        numbered = saved(volumes.withColumn("__n", F.monotonically_increasing_id()), "volumes")
        buckets = numbered.count() // rows + 1
        dealt = numbered.withColumn("bucket", F.pmod(F.xxhash64("__n"), F.lit(buckets)).cast("int"))
        dealt = saved(dealt.withColumn("__at", F.row_number().over(Window.partitionBy("bucket").orderBy("__n")) - 1), "buckets")
        if dealt.where(F.col("__at") >= _PLACES).limit(1).count():
            raise ValueError("a bucket has too many rows for a bitmap; build with fewer rows")
        dealt.drop("__n", "__at").repartition(F.col("bucket")).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/volumes")
        fields = F.array(*[F.struct(F.lit(name).alias("field"), grams_of(text).alias("grams")) for name, text in search_fields().items()])
        found = dealt.select("bucket", "__at", F.explode(fields).alias("f")).select("bucket", "__at", "f.field", F.explode("f.grams").alias("gram"))
        maps = found.groupBy("field", "gram", "bucket").agg(F.bitmap_construct_agg("__at").alias("map"))
        shard = F.pmod(F.xxhash64("gram"), F.lit(SHARDS)).cast("int")
        maps.withColumn("shard", shard).repartition(F.col("shard")).sortWithinPartitions("shard", "field", "gram").write.mode("overwrite").partitionBy("shard").parquet(f"{self.folder}/grams")

    def buckets(self, **fields: str | None) -> list[int] | None:
        """Buckets in which some row has all trigrams of the given fields' terms; None if there are no trigrams to look for. There are as many as volumes / ROWS."""
        terms = [(name, term) for name, query in fields.items() if query for term in query.lower().split()]
        asked = self.spark.createDataFrame([(n, t) for n, t in terms if len(t) >= 3], "field string, term string")
        asked = asked.select("field", F.explode(grams_of(F.col("term"))).alias("gram")).distinct().withColumn("shard", F.pmod(F.xxhash64("gram"), F.lit(SHARDS)).cast("int"))
        wanted = [tuple(r) for r in asked.collect()]  # of one search
        if not wanted:
            return None
        maps = self.spark.read.parquet(f"{self.folder}/grams").where(F.col("shard").isin(sorted({s for *_, s in wanted})) & F.col("gram").isin(sorted({g for _, g, _ in wanted})))
        both = maps.join(F.broadcast(asked.drop("shard")), ["field", "gram"], "left_semi").groupBy("bucket").agg(F.count("*").alias("n"), F.bitmap_and_agg("map").alias("map"))
        return sorted(r["bucket"] for r in both.where((F.col("n") == len(wanted)) & (F.bitmap_count("map") > 0)).select("bucket").collect())

    def search(self, text: str | None = None, intitle: str | None = None, inauthor: str | None = None, subject: str | None = None, limit: bool = True) -> DataFrame:
        """The rows of field_search over all volumes."""
        found = self.buckets(text=text, intitle=intitle, inauthor=inauthor, subject=subject)
        volumes = self.spark.read.parquet(f"{self.folder}/volumes")
        return field_search(volumes if found is None else volumes.where(F.col("bucket").isin(found)), text, intitle, inauthor, subject, limit=limit).drop("bucket")
