"""Writers of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from spindle.operators.etl import n_triples, turtle_blocks


def write_n_triples(triples: DataFrame, path: str) -> None:
    n_triples(triples).write.mode("overwrite").text(path)


def write_turtle(triples: DataFrame, path: str) -> None:
    turtle_blocks(triples).select("block").write.mode("overwrite").text(path)


def write_table(rows: DataFrame, path: str, sep: str = ",") -> None:
    """Delimited text with a header; arrays are joined with ", ", quotes doubled."""
    flat = [F.array_join(f.name, ", ").alias(f.name) if isinstance(f.dataType, ArrayType) else F.col(f"`{f.name}`") for f in rows.schema.fields]
    rows.select(*flat).write.mode("overwrite").option("header", True).option("sep", sep).option("quote", '"').option("escape", '"').csv(path)


def gene_table(rows: DataFrame, places: int = 4):
    """``gene, log2fc, padj`` as report text: so many decimals, p in scientific notation, NA where null."""
    p = F.coalesce(F.format_string("%.2e", "padj"), F.lit("NA"))
    return rows.select("gene", F.format_string(f"%.{places}f", "log2fc").alias("log2fc"), F.when(F.col("padj").isNull(), "NA").otherwise(p).alias("padj"))


def with_provenance(rows: DataFrame, **facts: str) -> DataFrame:
    """Each row as a JSON document with the facts beside it."""
    return rows.select(F.to_json(F.struct(F.struct("*").alias("result"), F.struct(*(F.lit(v).alias(k) for k, v in sorted(facts.items()))).alias("provenance"))).alias("value"))
