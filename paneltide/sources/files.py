"""Files: per-asset panels, manifests, ledgers, result tables and step logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Vendor column names and the names used here.
COLUMN_NAMES = {
    "Open": "open",
    "High": "high",
    "Low": "low",
    "Close": "close",
    "Adj Close": "adj_close",
    "Volume": "volume",
}
KNOWN_COLUMNS = ("open", "high", "low", "close", "adj_close", "volume")

# Long sector names and their short codes.
SECTOR_CODES = {
    "Technology": "IT",
    "Information Technology": "IT",
    "Communication Services": "COMM",
    "Consumer Cyclical": "COND",
    "Consumer Discretionary": "COND",
    "Consumer Defensive": "COST",
    "Consumer Staples": "COST",
    "Financial Services": "FIN",
    "Financials": "FIN",
    "Healthcare": "HC",
    "Health Care": "HC",
    "Energy": "ENRG",
    "Industrials": "IND",
    "Utilities": "UTIL",
    "Basic Materials": "MAT",
    "Materials": "MAT",
    "Real Estate": "REAL",
}

def sector_code(name: Column) -> Column:
    """Short code of a long sector name; unknown names give their first four letters."""
    pairs = [F.lit(x) for kv in SECTOR_CODES.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), F.upper(F.substring(name, 1, 4)))


def sector_dim(assets: DataFrame, mapping: DataFrame) -> DataFrame:
    """(asset, sector, known): ``UNK`` where the map has no entry."""
    return assets.join(mapping, "asset", "left").select(
        "asset", F.coalesce("sector", F.lit("UNK")).alias("sector"), F.col("sector").isNotNull().alias("known")
    )


def normalize_columns(raw: DataFrame) -> DataFrame:
    """Vendor names to ours; other columns are dropped and ``close`` is required."""
    out = raw.withColumnsRenamed({k: v for k, v in COLUMN_NAMES.items() if k in raw.columns})
    if "close" not in out.columns:
        raise ValueError(f"no close column in {raw.columns}")
    keys = [c for c in ("asset", "sector", "dt") if c in out.columns]
    return out.select(*keys, *[c for c in KNOWN_COLUMNS if c in out.columns])


FILE_STEM = r"([^/]+)\.parquet$"


def load_panel(spark: SparkSession, folder: str, pattern: str | None = None) -> DataFrame:
    """A panel as one table, with its asset.

    By default the folder has one directory per asset, as ``write_panel`` leaves
    it; a filter on the asset then opens its directory only. With a ``pattern``
    (``FILE_STEM`` for flat folders) all parquet files below the folder are read
    and the asset is taken from their path. An empty folder is an error of the
    reader.
    """
    if pattern is None:
        return spark.read.parquet(folder).withColumn("asset", F.col("asset").cast("string"))
    files = spark.read.option("recursiveFileLookup", "true").parquet(folder)
    return files.withColumn("asset", F.regexp_extract(F.col("_metadata.file_path"), pattern, 1))


def write_panel(panel: DataFrame, folder: str) -> None:
    """One directory per asset; an asset's rows are bounded by the calendar."""
    panel.repartition("asset").write.mode("overwrite").partitionBy("asset").parquet(folder)


def file_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """(file_path, sha256, bytes) of each parquet file, read as bytes.

    Panel files are small (one asset's calendar); the reader refuses files
    above its limit rather than cutting them.
    """
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", "*.parquet")
        .load(folder)
    )
    return files.select(
        F.regexp_replace("path", "^file:/+", "/").alias("file_path"),
        F.sha2("content", 256).alias("sha256"),
        F.col("length").alias("bytes"),
    )


def build_manifest(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(asset, rows, start, end, file_path, sha256, bytes) per file."""
    rows = (
        load_panel(spark, folder, pattern)
        .groupBy(F.regexp_replace(F.col("_metadata.file_path"), "^file:/+", "/").alias("file_path"), "asset")
        .agg(F.count("*").alias("rows"), F.min("dt").alias("start"), F.max("dt").alias("end"))
    )
    return rows.join(file_hashes(spark, folder), "file_path").select(
        "asset", "rows", "start", "end", "file_path", "sha256", "bytes"
    )


def write_manifest(entries: DataFrame, folder: str) -> None:
    entries.write.mode("overwrite").json(folder)


def verify_manifest(stored: DataFrame, actual: DataFrame) -> DataFrame:
    """(file_path, status): ok, changed, missing or unlisted."""
    s = stored.select("file_path", F.col("sha256").alias("_want"))
    a = actual.select("file_path", F.col("sha256").alias("_have"))
    status = (
        F.when(F.col("_have").isNull(), "missing")
        .when(F.col("_want").isNull(), "unlisted")
        .when(F.col("_want") == F.col("_have"), "ok")
        .otherwise("changed")
    )
    return s.join(a, "file_path", "full").select("file_path", status.alias("status"))


def table_fingerprint(df: DataFrame, columns: list[Column]) -> DataFrame:
    """(rows, fingerprint): sums of row hashes, so the row order does not matter."""
    digest = F.md5(F.concat_ws("|", *[F.coalesce(c.cast("string"), F.lit("~")) for c in columns]))

    def word(at):
        return F.conv(F.substring(digest, at, 8), 16, 10).cast("decimal(20,0)")

    total = F.concat_ws("-", *[F.sum(word(at)).cast("string") for at in (1, 9)])
    return df.agg(F.count("*").alias("rows"), total.alias("fingerprint"))


def read_ledger(spark: SparkSession, path: str, numbers: list[str], keys: list[str], sentinel: float = -1.0) -> DataFrame:
    """Typed rows of a CSV ledger: unparsable numbers and the sentinel become NULL."""
    schema = ", ".join(f"`{c}` string" for c in [*keys, *numbers])
    raw = spark.read.option("header", "true").schema(schema).csv(path)
    values = {n: F.col(n).try_cast("double") for n in numbers}
    return raw.select(
        *keys, *[F.when(v.isNotNull() & ~F.isnan(v) & (v != sentinel), v).alias(n) for n, v in values.items()]
    )


def write_table(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Result tables as CSV with a header, or parquet."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"unknown format {fmt!r}")
    writer = df.write.mode("overwrite")
    writer.option("header", "true").csv(path) if fmt == "csv" else writer.parquet(path)


def step_log_sink(steps: DataFrame, path: str, by: str = "run") -> None:
    """The per-step log as parquet, one directory per run kind."""
    steps.write.mode("overwrite").partitionBy(by).parquet(path)


def artifact_inventory(spark: SparkSession, folder: str, expected: list[str]) -> DataFrame:
    """(artifact, available, files, bytes) for a list of expected subfolders or files."""
    listing = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        # the content column is not read
        .select(F.regexp_replace("path", "^file:/+", "/").alias("path"), "length")
    )
    root = folder.replace("file:", "").rstrip("/")
    found = (
        listing.withColumn("artifact", F.split(F.substring("path", len(root) + 2, 1 << 20), "/")[0])
        .groupBy("artifact")
        .agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    )
    want = spark.createDataFrame([(e,) for e in expected], "artifact string")
    return want.join(found, "artifact", "left").select(
        "artifact", F.col("files").isNotNull().alias("available"), F.coalesce("files", F.lit(0)).alias("files"), "bytes"
    )
