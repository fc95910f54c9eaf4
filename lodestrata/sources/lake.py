"""The Parquet lake: partition planning by measured size, writes, manifests and round-trip checks."""

from __future__ import annotations

import tempfile

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: How source types are stored; anything else is refused.
TYPE_MAP = {
    "bool": "boolean", "int2": "int", "int4": "int", "int8": "bigint", "oid": "bigint", "float4": "float", "float8": "double",
    "numeric": "double", "money": "double", "text": "string", "varchar": "string", "char": "string", "uuid": "string", "citext": "string",
    "json": "string", "jsonb": "string", "date": "string", "time": "string", "interval": "string", "timestamp": "timestamp_ntz",
    "timestamptz": "timestamp", "bytea": "binary", "vector": "array<float>",
}


def lake_type(source_type: str) -> str:
    if source_type not in TYPE_MAP:
        raise ValueError(f"no lake type for {source_type!r}: types are refused, not guessed")
    return TYPE_MAP[source_type]


def coerced(c: Column, source_type: str) -> Column:
    """A text column as a lake type: null for what doesn't parse, for empty text and for non-finite numbers."""
    kind = lake_type(source_type)
    if kind == "boolean":
        return F.when(c.isNotNull(), F.lower(c).isin("t", "true"))
    value = F.nullif(F.trim(c), F.lit("")).try_cast(kind) if kind != "string" else c
    if kind in ("double", "float"):
        return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
    return value


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or a new local one where that is unset on one machine."""
    found = spark.conf.get("spark.checkpoint.dir", None) or None
    if not found:
        master = spark.conf.get("spark.master", "local")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lodestrata-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def version(spark: SparkSession, path: str) -> str:
    """A name of what lies below path now: it changes with the files' names, sizes and times. Contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    stamp = F.xxhash64("path", "length", F.unix_micros("modificationTime"))
    held = files.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(stamp), F.lit(0)).alias("stamp")).first()
    return f"{held.n}-{held.stamp & (2**64 - 1):016x}"


def written_or_none(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame | None:
    """The table at path, or None where nothing whole has been written."""
    try:
        return (spark.read.schema(schema) if schema else spark.read).parquet(path)
    except AnalysisException as e:
        if e.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def partition_plan(df: DataFrame, keys: list[str], row_bytes: Column) -> DataFrame:
    """Per candidate depth of partition keys: partitions, rows and bytes of the largest, and the median rows."""
    rows = []
    for depth in range(1, len(keys) + 1):
        by = keys[:depth]
        sizes = df.groupBy(*by).agg(F.count("*").alias("n"), F.sum(row_bytes).alias("bytes"))
        rows.append(
            sizes.agg(
                F.lit(depth).alias("depth"),
                F.count("*").alias("partitions"),
                F.max("n").alias("most_rows"),
                F.max("bytes").cast("long").alias("most_bytes"),
                F.median("n").alias("median_rows"),
            )
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def write_partitioned(df: DataFrame, path: str, keys: list[str], rows_per_file: int = 1_000_000) -> None:
    """One shuffle by the keys, so each partition is written by few tasks, a large one by several; files roll at a row bound."""
    dealt = df.hint("rebalance", *keys) if keys else df
    writer = dealt.write.option("compression", "zstd").option("maxRecordsPerFile", rows_per_file)
    (writer.partitionBy(*keys) if keys else writer).parquet(path)


def planned_layout(df: DataFrame, keys: list[str], row_bytes: Column, most_partitions: int, file_bytes: int) -> tuple[list[str], int]:
    """The keys to partition by, and the rows of a file: as deep as there are few enough partitions whose median fills a tenth of a file, and files of about file_bytes."""
    measured = partition_plan(df, keys, row_bytes).orderBy("depth").collect()  # a row for each depth
    whole = df.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_bytes), F.lit(0)).alias("b")).first()
    average = max(1.0, float(whole.b) / max(1, whole.n))
    fit = [r.depth for r in measured if r.partitions <= most_partitions and (r.median_rows or 0) * average >= file_bytes / 10]
    return keys[: max(fit, default=0)], max(1, int(file_bytes / average))


def write_planned(df: DataFrame, path: str, keys: list[str], row_bytes: Column, most_partitions: int, file_bytes: int) -> list[str]:
    """Writes df as its measured sizes ask, and returns the keys that it is partitioned by."""
    chosen, rows = planned_layout(df, keys, row_bytes, most_partitions, file_bytes)
    write_partitioned(df, path, chosen, rows)
    return chosen


def export_checked(df: DataFrame, path: str, keys: list[str]) -> DataFrame:
    """Writes df by partition and returns keys, rows and held (rows read back) of each. A partition that isn't whole is an error.

    The written table is read with df's schema, so keys that look like numbers stay what they are. Empty text as a key comes back as null.
    """
    write_partitioned(df, path, keys)
    back = df.sparkSession.read.schema(df.schema).parquet(path).groupBy(*keys).agg(F.count("*").alias("held"))
    given = df.groupBy(*keys).agg(F.count("*").alias("rows")).withColumnsRenamed({k: f"__{k}" for k in keys})
    match = [F.col(k).eqNullSafe(F.nullif(F.col(f"__{k}"), F.lit("")) if dict(df.dtypes)[k] == "string" else F.col(f"__{k}")) for k in keys]
    both = back.join(given, match, "full").select(*keys, "rows", "held")
    broken = F.raise_error(F.concat_ws(" ", F.lit("partition not whole:"), *[F.col(k).cast("string") for k in keys]))
    return both.withColumn("rows", F.when(F.col("rows").eqNullSafe(F.col("held")), F.col("rows")).otherwise(broken.cast("bigint")))


def write_grouped_json(df: DataFrame, path: str, key: str) -> None:
    """Gzipped JSON lines, a folder for each value of the key; null fields are written, so that rows keep their shape."""
    df.hint("rebalance", key).write.partitionBy(key).options(compression="gzip", ignoreNullFields=False).json(path)


def read_grouped_json(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(path)


def domain_of(name: Column, domains: dict[str, list[str]]) -> Column:
    """The domain whose list has the name. A name on no list is refused, not guessed."""
    listed = {n: d for d, names in domains.items() for n in names}
    known = F.create_map(*[F.lit(x) for pair in listed.items() for x in pair])
    return F.coalesce(F.try_element_at(known, name), F.raise_error(F.concat(F.lit("no domain for "), F.coalesce(name, F.lit("null")))))


def manifest(df: DataFrame, table: str, partition: str) -> DataFrame:
    """Rows, distinct values and bounds of the partition column, and the columns of a table."""
    columns = ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in df.schema)
    return df.agg(
        F.lit(table).alias("table_name"),
        F.count("*").alias("rows"),
        F.countDistinct(partition).alias("partitions"),
        F.min(partition).cast("string").alias("first_partition"),
        F.max(partition).cast("string").alias("last_partition"),
    ).withColumn("columns", F.lit(columns))


def manifest_rows(df: DataFrame, table: str, domain: Column, partition: str | None, omit: list[str]) -> DataFrame:
    """table_name, domain, partition (null for an unpartitioned table), rows, columns and omitted columns of each partition of a table."""
    columns = [f"{f.name}:{f.dataType.simpleString()}" for f in df.schema if f.name not in omit]
    value = F.col(partition).cast("string") if partition else F.lit(None).cast("string")
    counted = df.groupBy(value.alias("partition")).agg(F.count("*").alias("rows")) if partition else df.agg(F.count("*").alias("rows")).select(value.alias("partition"), "rows")
    names = lambda items: F.array(*map(F.lit, items)).cast("array<string>")
    return counted.select(F.lit(table).alias("table_name"), domain.alias("domain"), "partition", "rows", names(columns).alias("columns"), names(omit).alias("omitted"))


def same(a: Column, b: Column, kind: T.DataType) -> Column:
    """Equality as a stored type allows: floats within their precision, all else null-safe."""
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        within = 1e-9 if isinstance(kind, T.DoubleType) else 1e-5
        close = F.abs(a - b) <= F.greatest(F.abs(a), F.abs(b), F.lit(1.0)) * within
        return (a.isNull() & b.isNull()) | F.coalesce(close, F.lit(False))
    return a.eqNullSafe(b)


def round_trip(original: DataFrame, written: DataFrame, key: str, sample: int) -> DataFrame:
    """column, checked and agreeing of a sample of keys, the ones with the smallest hashes."""
    keys = original.select(key).distinct().orderBy(F.md5(F.col(key).cast("string"))).limit(sample)
    other = written.select(key, *[F.col(c).alias(f"__{c}") for c in written.columns if c != key], F.lit(True).alias("__held"))
    both = original.join(F.broadcast(keys), key, "left_semi").join(other, key, "left")
    fields = [f for f in original.schema if f.name != key]
    agree = [F.count_if(same(F.col(f.name), F.col(f"__{f.name}"), f.dataType) & F.col("__held").isNotNull()).alias(f.name) for f in fields]
    row = both.agg(F.count("*").alias("checked"), *agree)
    pairs = F.array(*[F.struct(F.lit(f.name).alias("column_name"), F.col(f.name).alias("agreeing")) for f in fields])
    return row.select("checked", F.explode(pairs).alias("p")).select("p.column_name", "checked", "p.agreeing")


def read_delimited(spark: SparkSession, path: str, schema: str, sep: str = "|", encoding: str = "ISO-8859-1") -> DataFrame:
    """Headerless delimited text whose column order is the contract; empty fields are null."""
    return spark.read.schema(schema).option("sep", sep).option("encoding", encoding).option("emptyValue", None).csv(path)


def read_quoted_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """RFC 4180: quoted commas, doubled quotes, line ends inside quotes."""
    return spark.read.schema(schema).options(multiLine=True, quote='"', escape='"', header=True).csv(path)
