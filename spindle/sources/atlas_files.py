"""Readers of expression-atlas archive files.

All files of a kind are read in one scan; the experiment's accession and the
contrast come from the file name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ACCESSION = r"(E-[A-Z]+-[0-9]+)"


def _named(rows: DataFrame) -> DataFrame:
    """Add ``file``: the name of the file, or of the folder of parts that a distributed writer left under that name."""
    # by cutting: a pattern that is tried from every character of a path costs more than the rest of a line
    path = F.col("_metadata.file_path")
    own, folder = F.substring_index(path, "/", -1), F.substring_index(F.substring_index(path, "/", -2), "/", 1)
    name = F.when(own.startswith("part-") & (folder != ""), folder).otherwise(own)
    return rows.withColumn("file", F.regexp_replace(name, "^[a-z_]+=", ""))


def discover(spark: SparkSession, path: str) -> DataFrame:
    """``file, experiment, contrast, kind, source``: the archive's files under ``path``, without undecorated ones.

    Only names are read. ``kind`` is analytics, gsea, idf, sdrf or
    configuration, ``source`` the annotation that a gene-set file enriches.
    """
    files = _named(spark.read.format("binaryFile").load(path)).select("file").distinct().where(~F.col("file").contains(".undecorated"))
    kinds = {"analytics": "-analytics.tsv", "gsea": ".gsea.tsv", "idf": ".idf.txt", "sdrf": ".condensed-sdrf.tsv", "configuration": "-configuration.xml"}
    kind = F.coalesce(*(F.when(F.col("file").endswith(end), k) for k, end in kinds.items()))
    return files.select("file", accession().alias("experiment"), contrast_of().alias("contrast"), kind.alias("kind"), source_of().alias("source")).where("kind is not null")


def accession(file: str = "file"):
    """The accession in a file name, null where there is none."""
    return F.nullif(F.regexp_extract(file, ACCESSION, 1), F.lit(""))


def contrast_of(file: str = "file"):
    """The contrast (g1_g2) in a file name, null where there is none."""
    return F.nullif(F.regexp_extract(file, r"\.(g[0-9]+_g[0-9]+)\.", 1), F.lit(""))


def source_of(file: str = "file"):
    """What a gene-set file enriches: go, reactome or interpro; null where its name does not say."""
    return F.nullif(F.regexp_extract(file, r"\.(go|reactome|interpro)\.", 1), F.lit(""))


def idf(spark: SparkSession, path: str) -> DataFrame:
    """``experiment, key, values``: lines of key and values; a repeated key gathers its values in file order; empty values go."""
    lines = _named(spark.read.format("text").load(path)).withColumn("line", F.monotonically_increasing_id())
    parts = F.split("value", "\t")
    rows = lines.select(accession().alias("experiment"), "line", F.trim(parts[0]).alias("key"), F.filter(F.slice(parts, F.lit(2), F.size(parts)), lambda v: F.trim(v) != "").alias("values"))
    rows = rows.where((F.col("key") != "") & (F.size("values") > 0))
    gathered = F.sort_array(F.collect_list(F.struct("line", "values")))
    return rows.groupBy("experiment", "key").agg(F.flatten(F.transform(gathered, lambda x: x["values"])).alias("values"))


SDRF = "accession string, array string, sample string, kind string, name string, value string, iri string"


def condensed_sdrf(spark: SparkSession, path: str) -> DataFrame:
    """The seven columns of headerless condensed SDRF files, long; empty cells are null, short lines are filled with null."""
    return spark.read.schema(SDRF).option("sep", "\t").option("nullValue", "").option("mode", "PERMISSIVE").option("quote", "").csv(path)


def characteristics(sdrf: DataFrame, skip: tuple[str, ...] = ("individual", "age", "organism")) -> DataFrame:
    """``accession, sample, name, iri, value``: one row for each value; space-separated IRIs are told apart, values without one get an IRI of their text."""
    rows = sdrf.where(~F.lower("name").isin(*skip)).where("value is not null")
    own = F.concat(F.lit("https://data.example.org/value/"), F.regexp_replace(F.replace("value", F.lit(" "), F.lit("_")), "'", ""))
    iris = F.when(F.col("iri").isNull(), F.array(own)).otherwise(F.filter(F.split("iri", " "), lambda x: x != ""))
    return rows.select("accession", "sample", "name", F.explode(iris).alias("iri"), "value").distinct()


CONFIGURATION = (
    "array_design string, "
    "assay_groups struct<assay_group: array<struct<_id: string, _label: string, assay: array<string>>>>, "
    "contrasts struct<contrast: array<struct<_id: string, name: string, reference_assay_group: string, test_assay_group: string>>>"
)


def configuration(spark: SparkSession, path: str) -> DataFrame:
    """``experiment, array_design, assay_groups, contrasts``: one row for each analytics element of configuration XML files."""
    rows = spark.read.schema(CONFIGURATION).option("rowTag", "analytics").format("xml").load(path)
    return _named(rows).select(accession().alias("experiment"), F.trim("array_design").alias("array_design"), F.col("assay_groups.assay_group").alias("assay_groups"), F.col("contrasts.contrast").alias("contrasts"))


def assay_groups(config: DataFrame) -> DataFrame:
    """``experiment, array_design, group_id, label, sample``."""
    groups = config.select("experiment", "array_design", F.explode("assay_groups").alias("g"))
    return groups.select("experiment", "array_design", F.col("g._id").alias("group_id"), F.col("g._label").alias("label"), F.explode("g.assay").alias("sample"))


def contrasts(config: DataFrame) -> DataFrame:
    """``experiment, array_design, contrast, name, reference_group, test_group``."""
    rows = config.select("experiment", "array_design", F.explode("contrasts").alias("c"))
    return rows.select("experiment", "array_design", F.col("c._id").alias("contrast"), F.col("c.name").alias("name"), F.col("c.reference_assay_group").alias("reference_group"), F.col("c.test_assay_group").alias("test_group"))


def contrast_factors(contrast_rows: DataFrame, groups: DataFrame, sdrf: DataFrame) -> DataFrame:
    """``experiment, contrast, side, name, value``: factors of the samples of both groups of a contrast."""
    side = F.explode(F.array(F.struct(F.lit("reference").alias("side"), F.col("reference_group").alias("group_id")), F.struct(F.lit("test").alias("side"), F.col("test_group").alias("group_id"))))
    # an experiment names a contrast once for each array design, and its groups hold the samples of all designs
    ends = contrast_rows.select("experiment", "contrast", side.alias("x")).select("experiment", "contrast", "x.side", "x.group_id").distinct()
    samples = ends.join(groups.select("experiment", "group_id", "sample"), ["experiment", "group_id"])
    factors = sdrf.where("kind = 'factor'").select(F.col("accession").alias("experiment"), "sample", "name", "value")
    return samples.join(factors, ["experiment", "sample"]).select("experiment", "contrast", "side", "name", "value").distinct()


def analytics(spark: SparkSession, path: str) -> DataFrame:
    """``experiment, gene_id, gene_name, design_element, contrast, p_value, t_statistic, log2fc``: analytics tables, unpivoted.

    The contrasts' columns differ between files: each line is read as an array
    and its cells are found by their place in its file's header, so that the
    numbers of a row come from one line, also where a gene has several design
    elements. Rows without a number for a contrast are left out.
    """
    lines = _named(spark.read.format("text").load(path)).where("file not like '%.undecorated%'")
    is_header = F.substring_index("value", "\t", 1) == "Gene ID"
    # one row for each file: where its contrasts' numbers are, 0 for none
    headers = lines.where(is_header).groupBy("file").agg(F.first(F.split("value", "\t")).alias("names"))
    own = F.array_distinct(F.filter(F.transform("names", lambda n: F.regexp_extract(n, r"^(.+)\.(p-value|log2foldchange)$", 1)), lambda c: c != ""))
    place = lambda name: F.array_position("names", name).cast("int")
    parts = {"p_value": ".p-value", "t_statistic": ".t-statistic", "log2fc": ".log2foldchange"}
    places = F.transform(own, lambda c: F.struct(c.alias("contrast"), *(place(F.concat(c, F.lit(end))).alias(name) for name, end in parts.items())))
    headers = headers.select("file", accession().alias("experiment"), place(F.lit("Design Element")).alias("element"), places.alias("own"))
    body = lines.where(~is_header).join(F.broadcast(headers), "file").select("experiment", F.split("value", "\t").alias("cells"), "element", F.explode("own").alias("at"))
    cell = lambda i: F.try_element_at("cells", F.nullif(i, F.lit(0)))
    # most cells are NA, and a cast that fails raises and catches an exception
    number = lambda c: F.when(~c.isin("NA", ""), c).try_cast("double")
    long = body.select(
        "experiment", F.col("cells")[0].alias("gene_id"), F.col("cells")[1].alias("gene_name"), cell(F.col("element")).alias("design_element"), "at.contrast",
        *(number(cell(F.col(f"at.{name}"))).alias(name) for name in parts),
    )
    return long.where("p_value is not null or log2fc is not null")


def enrichment(spark: SparkSession, path: str) -> DataFrame:
    """``experiment, contrast, source, term_id, term_name, size, significant, other, p_value, p_adj, effect``: gene-set files.

    In these files the column Term holds the id and Accession the name.
    """
    lines = _named(spark.read.option("sep", "\t").option("header", True).csv(path))
    # The headers of the format; files may lack some of them
    names = {
        "size": ("Genes (tot)", "int"), "significant": ("Significant..in.gene.set.", "int"), "other": ("Non.significant..in.gene.set.", "int"),
        "p_value": ("Stat (non-dir.) p", "double"), "p_adj": ("p adj (non-dir.)", "double"), "effect": ("effect.size", "double"),
    }
    numbers = [(F.col(f"`{h}`").try_cast(kind) if h in lines.columns else F.lit(None).cast(kind)).alias(name) for name, (h, kind) in names.items()]
    return lines.select(accession().alias("experiment"), contrast_of().alias("contrast"), source_of().alias("source"), F.col("Term").alias("term_id"), F.col("Accession").alias("term_name"), *numbers)


def gene_ids(spark: SparkSession, path: str, key: str = "symbol", value: str = "ensembl_gene_id") -> DataFrame:
    """``key, value`` of a tab-separated table with a header; rows without a key or value go, the least value of a key stays."""
    rows = spark.read.option("sep", "\t").option("header", True).csv(path)
    return rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value")).where("key is not null and value is not null").groupBy("key").agg(F.min("value").alias("value"))


def orthologs(spark: SparkSession, path: str) -> DataFrame:
    """``gene, other``: pairs of genes; lines that begin with ``#`` and short lines are skipped."""
    rows = spark.read.schema("gene string, other string").option("sep", "\t").option("comment", "#").csv(path)
    return rows.where("gene is not null and other is not null").distinct()


def top_per_contrast(rows: DataFrame, by: list[str], order: str, tie: str, most: int) -> DataFrame:
    """The ``most`` rows of least ``order`` in each group; null goes last."""
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.asc_nulls_last(order), tie))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")
