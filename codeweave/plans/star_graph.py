"""An evidence graph derived from the star schema by selects alone: relationships at any scale."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def star_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relationships in one workspace: customers' calls match orders' handlers, which call parts' services, which read
    suppliers' tables."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    c = F.col

    def rows(df: DataFrame, source_kind: str, source: Column, kind: str, target_kind: str, target: Column, metadata: Column | None = None) -> DataFrame:
        note = (F.lit(None) if metadata is None else metadata).cast("string")
        return df.select(F.lit("ws0").alias("workspace_id"), F.lit(source_kind).alias("source_kind"), source.alias("source_identifier"), F.lit(kind).alias("relationship_kind"), F.lit(target_kind).alias("target_kind"), target.alias("target_identifier"), note.alias("metadata"))

    orders, lines, part = read("orders"), read("lineitem"), read("part")
    placed = read("customer").join(orders, c("c_custkey") == c("o_custkey"))
    act = lambda key: _text("api/O", c(key), ".cs::Act")
    note = _text("frontendApi=GET /o/", c("o_orderkey"), ";backendApi=GET /o/", c("o_orderkey"), ";match=exact;controller=O")
    service = lambda key, tail: _text("svc/Part", c(key), ".cs::", tail)
    cloud = F.concat(F.lit("Service "), c("o_orderpriority"))
    supplied = lines.select("l_partkey", "l_suppkey").distinct()
    out = rows(placed, "symbol", _text("web/n", c("c_nationkey"), "/c", c("c_custkey"), ".ts::load"), "matches_backend_handler", "symbol", act("o_orderkey"), note)
    out = out.unionByName(rows(lines, "symbol", act("l_orderkey"), "calls_method", "method", _text("IPart", c("l_partkey"), ".Load")))
    out = out.unionByName(rows(part, "service", _text("IPart", c("p_partkey")), "implemented_by", "class", _text("Part", c("p_partkey"))))
    out = out.unionByName(rows(part, "symbol", service("p_partkey", _text("Part", c("p_partkey"))), "contains_symbol", "method", service("p_partkey", "Load")))
    out = out.unionByName(rows(supplied, "symbol", service("l_partkey", "Load"), "reads_table", "database-table", _text("dbo.Supp", c("l_suppkey"))))
    return out.unionByName(rows(orders, "file", _text("api/O", c("o_orderkey"), ".cs::azure-service-reference"), "uses_azure_service", "azure-service", cloud))
