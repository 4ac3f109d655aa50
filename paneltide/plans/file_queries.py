"""Queries that write files derived from the given tables and read them back."""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, functions as F

from paneltide.functions.columns import tidy
from paneltide.plans import stages as st
from paneltide.plans.registry import query
from paneltide.plans.panel_queries import BAR_SQL, _bars_out
from paneltide.plans.sqltext import part
from paneltide.session import shared_folder
from paneltide.sources import files as FI
from paneltide.sources import tables as T


def _place(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid4().hex}"


ASSET_DIR = r"asset=([^/]+)/"


def _written_panel(spark: SparkSession, folder: str) -> str:
    place = _place(spark, "panel")
    FI.write_panel(st.weekly_bars(spark, folder), place)
    return place


@query("load_panel", "bars", f"SELECT asset, sector, dt, {BAR_SQL} FROM bars")
def load_panel(spark: SparkSession, folder: str) -> DataFrame:
    return _bars_out(FI.load_panel(spark, _written_panel(spark, folder)))


@query("normalize_columns", "bars", f"SELECT asset, sector, dt, {BAR_SQL} FROM bars")
def normalize_columns(spark: SparkSession, folder: str) -> DataFrame:
    vendor = st.weekly_bars(spark, folder).withColumnsRenamed({v: k for k, v in FI.COLUMN_NAMES.items()})
    return _bars_out(FI.normalize_columns(vendor.withColumn("Dividends", F.lit(0.0))))


MANIFEST_SQL = """
SELECT asset, count(*) AS rows, min(dt) AS start, max(dt) AS "end", 64 AS hash_length FROM bars GROUP BY asset"""


@query("build_manifest", "bars", MANIFEST_SQL)
def build_manifest(spark: SparkSession, folder: str) -> DataFrame:
    m = FI.build_manifest(spark, _written_panel(spark, folder), ASSET_DIR)
    return m.select("asset", "rows", "start", "end", F.length("sha256").alias("hash_length"))


@query("verify_manifest", "bars", """
SELECT status, count(*) AS n FROM (SELECT CASE WHEN asset = 'NATION_3' THEN 'changed' ELSE 'ok' END AS status FROM bars GROUP BY asset) GROUP BY status""")
def verify_manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The stored manifest has a wrong hash for one asset."""
    place = _written_panel(spark, folder)
    where = _place(spark, "manifest")
    made = FI.build_manifest(spark, place, ASSET_DIR)
    FI.write_manifest(
        made.withColumn("sha256", F.when(F.col("asset") == "NATION_3", F.sha2("sha256", 256)).otherwise(F.col("sha256"))), where
    )
    stored = spark.read.schema(made.schema).json(where)
    return FI.verify_manifest(stored, FI.file_hashes(spark, place)).groupBy("status").agg(F.count("*").alias("n"))


_text = "concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_linenumber AS VARCHAR), l_returnflag, strftime(l_shipdate, '%Y-%m-%d'))"


@query("table_fingerprint", "", f"""
SELECT count(*) AS rows, CAST(sum(CAST('0x' || substr(md5({_text}), 1, 8) AS BIGINT)) AS VARCHAR) || '-' || CAST(sum(CAST('0x' || substr(md5({_text}), 9, 8) AS BIGINT)) AS VARCHAR) AS fingerprint FROM lineitem""")
def table_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    cols = [F.col("l_orderkey"), F.col("l_linenumber"), F.col("l_returnflag"), F.date_format("l_shipdate", "yyyy-MM-dd")]
    return FI.table_fingerprint(T.table(spark, folder, "lineitem"), cols)


def _ledger_text(spark: SparkSession, folder: str) -> DataFrame:
    """The arms ledger as its CSV stores it: -1 for "not reached", text for "no value"."""
    w = T.arms_wide(spark, folder)
    few = F.col("n_events") < 45
    return w.select(
        "arm",
        "seed",
        F.when(few, F.lit("-1.0")).otherwise(F.col("n_events").cast("string")).alias("n_events"),
        F.when(F.col("max_value") > 150, F.lit("n/a")).otherwise(F.col("max_value").cast("string")).alias("max_value"),
    )


@query("read_ledger", "wide", """
SELECT arm, CAST(seed AS VARCHAR) AS seed, CASE WHEN n_events >= 45 THEN n_events END AS n_events, CASE WHEN max_value <= 150 THEN round(max_value, 6) + 0.0 END AS max_value FROM wide""")
def read_ledger(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "ledger")
    FI.write_table(_ledger_text(spark, folder), place)
    rows = FI.read_ledger(spark, place, ["n_events", "max_value"], ["arm", "seed"])
    return rows.select("arm", "seed", "n_events", tidy("max_value").alias("max_value"))


@query("write_table", "wide", "SELECT arm, seed, round(mean_value, 6) + 0.0 AS mean_value, n_events FROM wide")
def write_table(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "table")
    FI.write_table(T.arms_wide(spark, folder).select("arm", "seed", "mean_value", "n_events"), place, "parquet")
    rows = spark.read.parquet(place)
    return rows.select("arm", "seed", tidy("mean_value").alias("mean_value"), "n_events")


@query("step_log_sink", "steps", "SELECT run, count(*) AS n, round(sum(reward), 6) + 0.0 AS total FROM steps GROUP BY run")
def step_log_sink(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "steps")
    FI.step_log_sink(st.strategy_steps(st.feature_rows(spark, folder)), place)
    return spark.read.parquet(place).groupBy("run").agg(F.count("*").alias("n"), tidy(F.sum("reward")).alias("total"))


@query("artifact_inventory", "", """
SELECT artifact, artifact <> 'figures' AS available FROM (VALUES ('ledger'), ('arms'), ('figures')) v(artifact)""")
def artifact_inventory(spark: SparkSession, folder: str) -> DataFrame:
    place = _place(spark, "artifacts")
    wide = T.arms_wide(spark, folder)
    FI.write_table(_ledger_text(spark, folder), f"{place}/ledger")
    FI.write_table(wide, f"{place}/arms", "parquet")
    return FI.artifact_inventory(spark, place, ["ledger", "arms", "figures"]).select("artifact", "available")


@query("sector_code", "", """
SELECT c_mktsegment AS name, upper(substr(c_mktsegment, 1, 4)) AS code, count(*) AS n FROM customer GROUP BY c_mktsegment
UNION ALL SELECT 'Financials', 'FIN', count(*) FROM customer""")
def sector_code(spark: SparkSession, folder: str) -> DataFrame:
    names = F.explode(F.array("c_mktsegment", F.lit("Financials")))
    return (
        T.table(spark, folder, "customer")
        .select(names.alias("name"))
        .groupBy("name", FI.sector_code(F.col("name")).alias("code"))
        .agg(F.count("*").alias("n"))
    )


@query("sector_dim", "", """
SELECT n_name AS asset, coalesce(r_name, 'UNK') AS sector, r_name IS NOT NULL AS known FROM nation LEFT JOIN region ON n_regionkey = r_regionkey AND r_name <> 'ASIA'""")
def sector_dim(spark: SparkSession, folder: str) -> DataFrame:
    nation, region = T.table(spark, folder, "nation"), T.table(spark, folder, "region")
    known = nation.join(region.where(F.col("r_name") != "ASIA"), F.col("n_regionkey") == F.col("r_regionkey")).select(
        F.col("n_name").alias("asset"), F.col("r_name").alias("sector")
    )
    return FI.sector_dim(nation.select(F.col("n_name").alias("asset")), known)
