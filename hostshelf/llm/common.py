"""Helpers shared by the operators: input frames, staged tables, label components."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hostshelf.session import checkpoint_dir

#: White space as the contracts define it, for Java and DuckDB patterns.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """`doc_id`, `text` (null text becomes empty) and nothing else, so that extra columns cannot clash."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(F.col("text"), F.lit("")).alias("text"))


def keyed(docs: DataFrame) -> DataFrame:
    """`id_and_text` plus `text_key`: rows are told apart by (doc_id, text_key).

    Repeated rows (same id, same text) share the key and get the same result;
    rows with one id and different texts stay apart.
    """
    return id_and_text(docs).withColumn("text_key", F.xxhash64("text"))


def rows_of(docs: DataFrame, whole: str | None = None) -> DataFrame:
    """doc_id, text, text_key, ord: `ord` is doc_id with null as the smallest value, so that keys are never null.

    With `whole`, a column of that name holds the row as it came.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias(whole or "_"))
    text = F.coalesce(F.col(f"{whole or '_'}.text"), F.lit(""))
    doc_id = F.col(f"{whole or '_'}.doc_id").cast("long")
    return rows.select(*[whole] * bool(whole), doc_id.alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("text_key"),
                       F.coalesce(doc_id, F.lit(-(1 << 63))).alias("ord"))


def only(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """The rows of `docs` whose (ord, text_key) is in `kept`, with their own columns; of rows with one key, one."""
    return (rows_of(docs, "_row").select("_row", "ord", "text_key").join(kept.select("ord", "text_key"), ["ord", "text_key"])
            .dropDuplicates(["ord", "text_key"]).select("_row.*"))


def let(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body` as often as needed."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def staged(df: DataFrame, name: str, by: str | None = None, codec: str = "snappy", **options) -> DataFrame:
    """Write `df` as Parquet into the shared checkpoint folder and read it back; `by` is a column of few values, a folder each; `options` are the writer's.

    Cuts the lineage with a copy that survives the loss of executors; the shuffle
    files behind it go as soon as it is written, not when the driver next collects its garbage.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/llm-{uuid.uuid4().hex}/{name}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        (df.write.partitionBy(by) if by else df.write).option("compression", codec).options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(_nullable(df.schema)).parquet(path)


def discard(table: DataFrame) -> None:
    """Remove the folder of a `staged` table that nothing reads any more."""
    spark = table.sparkSession
    for place in {name.rsplit("/llm-", 1)[0] + "/llm-" + name.rsplit("/llm-", 1)[1].split("/")[0] for name in table.inputFiles()}:
        folder = spark._jvm.org.apache.hadoop.fs.Path(place)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def _nullable(schema: T.StructType) -> T.StructType:
    return T.StructType([T.StructField(f.name, f.dataType, True) for f in schema])


def split_join(rows: DataFrame, grouped: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join of `rows` with a table aggregated by `keys` (the first one a long), fit for hot keys.

    Joined on the complement of the first key: the aggregate's own partitioning
    then does not serve the join, both sides get an exchange, and adaptive
    execution can split a hot key's rows (it leaves a join alone whose other
    side is an aggregate without an exchange of its own).
    """
    first, *others = keys
    mark = F.bitwise_not(F.col(first)).alias("_not_key")
    return (rows.select("*", mark).join(grouped.select("*", mark).drop(first), ["_not_key", *others])
            .select(*rows.columns, *[c for c in grouped.columns if c not in keys]))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected `edges` (a, b) but the roots: root is the component's smallest node.

    Alternates large-star and small-star steps (Kiveris et al., 2014). Every
    step is a grouped minimum (combined before the shuffle) and a `split_join`,
    so a star of any size is fine; each round is staged in the shared folder.
    Self loops are ignored.
    """
    e = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")
    before = None
    for _ in range(max_rounds):
        both = e.union(e.select("v", "u"))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = (split_join(both.where("v > u"), low, ["u"]).select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .where("u <> v").distinct())
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, low, ["u"])
        e = staged(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                   .union(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return e.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now
    raise RuntimeError("components: not settled")
