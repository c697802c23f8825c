"""Queries over expression associations: coverage, agreement, discordance, rankings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.plans.registry import query
from spindle.sources.views import associations, sql

JOINED = lambda c: F.array_join(F.sort_array(F.collect_set(c)), " | ")


@query("C09_genes_agreement", sql("assoc", """ SELECT gene, symbol, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction, count(DISTINCT experiment) AS experiments,
  string_agg(DISTINCT experiment, ' | ' ORDER BY experiment) AS experiment_ids FROM assoc WHERE log2fc <> 0 GROUP BY ALL HAVING count(DISTINCT experiment) >= 10 ORDER BY experiments DESC, gene, direction LIMIT 200"""))
def c09(spark, d):
    rows = associations(spark, d).where("log2fc <> 0")
    rows = rows.withColumn("direction", F.when(F.col("log2fc") > 0, "up").otherwise("down"))
    out = rows.groupBy("gene", "symbol", "direction").agg(F.countDistinct("experiment").alias("experiments"), JOINED("experiment").alias("experiment_ids"))
    return out.where("experiments >= 10").orderBy(F.desc("experiments"), "gene", "direction").limit(200)


@query("C04_experiment_coverage", sql("assoc", " SELECT experiment, count(DISTINCT contrast) AS contrasts, min(label) AS sample_label FROM assoc WHERE taxon IN (1, 2) OR contains(lower(label), 'promo') GROUP BY experiment ORDER BY contrasts DESC, experiment LIMIT 500"))
def c04(spark, d):
    rows = associations(spark, d)
    rows = rows.where(F.col("taxon").isin(1, 2) | F.lower("label").contains("promo"))
    return rows.groupBy("experiment").agg(F.countDistinct("contrast").alias("contrasts"), F.min("label").alias("sample_label")).orderBy(F.desc("contrasts"), "experiment").limit(500)


@query("C05_coverage_of_experiments", sql("assoc", " SELECT experiment, count(DISTINCT contrast) AS contrasts, min(label) AS sample_label FROM assoc WHERE experiment IN ('E-GEOD-3', 'E-GEOD-17') GROUP BY experiment"))
def c05(spark, d):
    rows = associations(spark, d).where(F.col("experiment").isin("E-GEOD-3", "E-GEOD-17"))
    return rows.groupBy("experiment").agg(F.countDistinct("contrast").alias("contrasts"), F.min("label").alias("sample_label"))


@query("C06_genes_in_experiment", sql("assoc", " SELECT gene, symbol, contrast, log2fc, adj_p, label FROM assoc WHERE experiment = 'E-GEOD-5' AND abs(log2fc) >= 0.01 AND adj_p <= 0.02"))
def c06(spark, d):
    rows = associations(spark, d).where((F.col("experiment") == "E-GEOD-5") & (F.abs("log2fc") >= 0.01) & (F.col("adj_p") <= 0.02))
    return rows.select("gene", "symbol", "contrast", "log2fc", "adj_p", "label")


@query("C07_experiments_for_gene", sql("assoc", " SELECT DISTINCT experiment, contrast, log2fc, adj_p, label, array_design FROM assoc WHERE lower(symbol) = 'gene77' ORDER BY log2fc DESC, contrast, adj_p LIMIT 100"))
def c07(spark, d):
    rows = associations(spark, d).where(F.lower("symbol") == "gene77")
    return rows.select("experiment", "contrast", "log2fc", "adj_p", "label", "array_design").distinct().orderBy(F.desc("log2fc"), "contrast", "adj_p").limit(100)


@query("C08_gene_cross_dataset_summary", sql("assoc", " SELECT symbol, experiment, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction, count(*) AS n, max(abs(log2fc)) AS largest FROM assoc WHERE symbol IN ('GENE5', 'GENE6', 'GENE150') GROUP BY ALL"))
def c08(spark, d):
    rows = associations(spark, d).where(F.col("symbol").isin("GENE5", "GENE6", "GENE150"))
    rows = rows.withColumn("direction", F.when(F.col("log2fc") > 0, "up").otherwise("down"))
    return rows.groupBy("symbol", "experiment", "direction").agg(F.count("*").alias("n"), F.max(F.abs("log2fc")).alias("largest"))


@query("C10_genes_discordance", sql("assoc", """, a AS (SELECT gene, symbol, experiment, contrast, log2fc, adj_p FROM assoc)
  SELECT u.gene, u.symbol, u.experiment AS experiment_up, w.experiment AS experiment_down, u.log2fc AS log2fc_up, w.log2fc AS log2fc_down, u.adj_p AS adj_p_up, w.adj_p AS adj_p_down
  FROM a u JOIN a w ON u.gene = w.gene WHERE u.log2fc > 0 AND w.log2fc < 0 ORDER BY u.log2fc - w.log2fc DESC, u.gene, experiment_up, experiment_down, adj_p_up, adj_p_down LIMIT 200"""))
def c10(spark, d):
    rows = associations(spark, d)
    # a pair of the i-th and the j-th row of a gene has i j - 1 better pairs in that gene alone
    side = lambda name, fold: rows.where(f"log2fc {'>' if name == 'up' else '<'} 0").withColumn(f"i_{name}", F.row_number().over(Window.partitionBy("gene").orderBy(fold, "experiment", "adj_p"))).where(f"i_{name} <= 200").select("gene", "symbol", *(F.col(c).alias(f"{c}_{name}") for c in ("experiment", "log2fc", "adj_p")), f"i_{name}")
    out = side("up", F.desc("log2fc")).join(side("down", F.asc("log2fc")).drop("symbol"), "gene").where("i_up * i_down <= 200").drop("i_up", "i_down")
    order = [F.desc(F.col("log2fc_up") - F.col("log2fc_down")), "gene", "experiment_up", "experiment_down", "adj_p_up", "adj_p_down"]
    return out.orderBy(*order).limit(200)


@query("G32_discordant_genes", sql("assoc", " SELECT gene, count(*) FILTER (WHERE log2fc > 0) AS ups, count(*) FILTER (WHERE log2fc < 0) AS downs FROM assoc GROUP BY gene HAVING bool_or(log2fc > 0.02) AND bool_or(log2fc < -0.02)"))
def g32(spark, d):
    out = associations(spark, d).groupBy("gene").agg(
        F.count_if(F.col("log2fc") > 0).alias("ups"), F.count_if(F.col("log2fc") < 0).alias("downs"), F.bool_or(F.col("log2fc") > 0.02).alias("up"), F.bool_or(F.col("log2fc") < -0.02).alias("down")
    )
    return out.where("up and down").drop("up", "down")


@query("J07_shared_genes_of_two_studies", sql("assoc", " SELECT DISTINCT a.gene FROM assoc a JOIN assoc b ON a.gene = b.gene WHERE a.experiment = 'E-GEOD-1' AND b.experiment = 'E-GEOD-2' AND a.log2fc > 0 AND b.log2fc > 0"))
def j07(spark, d):
    rows = associations(spark, d).where("log2fc > 0")
    pick = lambda e: rows.where(F.col("experiment") == e).select("gene").distinct()
    return pick("E-GEOD-1").intersect(pick("E-GEOD-2"))


@query("J05_contrasts_first", sql("assoc", ", c AS (SELECT DISTINCT contrast FROM assoc WHERE contains(lower(label), 'sm') AND array_design = 'Brand#12') SELECT assoc.gene, count(*) AS n, min(adj_p) AS least FROM assoc SEMI JOIN c ON assoc.contrast = c.contrast GROUP BY gene"))
def j05(spark, d):
    rows = associations(spark, d)
    contrasts = rows.where(F.lower("label").contains("sm") & (F.col("array_design") == "Brand#12")).select("contrast").distinct()
    return rows.join(contrasts, "contrast", "left_semi").groupBy("gene").agg(F.count("*").alias("n"), F.min("adj_p").alias("least"))


@query("W01_top_genes_per_experiment", sql("assoc", " SELECT experiment, gene, best, rk FROM (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY best DESC, gene) AS rk FROM (SELECT experiment, gene, max(abs(log2fc)) AS best FROM assoc GROUP BY ALL)) WHERE rk <= 20"))
def w01(spark, d):
    best = associations(spark, d).groupBy("experiment", "gene").agg(F.max(F.abs("log2fc")).alias("best"))
    rank = F.row_number().over(Window.partitionBy("experiment").orderBy(F.desc("best"), "gene"))
    return best.withColumn("rk", rank.cast("long")).where("rk <= 20")


W03_SCORES = {"effect": "abs(lfc)", "pvalue": "-log10(greatest(p, 1e-10))", "combined": "abs(lfc) * -log10(greatest(p, 1e-10))", "volcano": "sqrt(lfc * lfc + log10(greatest(p, 1e-10)) * log10(greatest(p, 1e-10)))"}


@query("W03_ranked_genes", sql("assoc", ", g AS (SELECT gene, round(avg(log2fc), 10) AS lfc, min(adj_p)::DOUBLE AS p FROM assoc GROUP BY gene), s AS (" + " UNION ALL ".join(f"SELECT '{name}' AS method, gene, round({score}, 6) + 0.0 AS score FROM g" for name, score in W03_SCORES.items()) + "), r AS (SELECT *, row_number() OVER (PARTITION BY method ORDER BY score DESC, gene) AS i FROM s) SELECT method, gene, score FROM r WHERE i <= 50"))
def w03(spark, d):
    """The 50 best genes by each of four scores; each list is limited before it is sorted as a whole."""
    g = associations(spark, d).groupBy("gene").agg(F.round(F.avg("log2fc"), 10).alias("lfc"), F.min("adj_p").cast("double").alias("p"))
    tops = [g.select(F.lit(name).alias("method"), "gene", (F.round(F.expr(score), 6) + 0.0).alias("score")).orderBy(F.desc("score"), "gene").limit(50) for name, score in W03_SCORES.items()]
    return tops[0].unionByName(tops[1]).unionByName(tops[2]).unionByName(tops[3])


@query("W04_top_up_and_down", sql("assoc", """, g AS (SELECT gene, max(log2fc) AS up, min(log2fc) AS down FROM assoc GROUP BY gene)
  SELECT * FROM (SELECT 'up' AS direction, gene, up AS log2fc FROM g WHERE up > 0 ORDER BY up DESC, gene LIMIT 25) UNION ALL SELECT * FROM (SELECT 'down', gene, down FROM g WHERE down < 0 ORDER BY down, gene LIMIT 25)"""))
def w04(spark, d):
    g = associations(spark, d).groupBy("gene").agg(F.max("log2fc").alias("up"), F.min("log2fc").alias("down"))
    up = g.where("up > 0").select(F.lit("up").alias("direction"), "gene", F.col("up").alias("log2fc")).orderBy(F.desc("log2fc"), "gene").limit(25)
    down = g.where("down < 0").select(F.lit("down").alias("direction"), "gene", F.col("down").alias("log2fc")).orderBy("log2fc", "gene").limit(25)
    return up.unionByName(down)


@query("W05_first_association_per_gene", sql("assoc", " SELECT gene, contrast, log2fc, adj_p FROM (SELECT gene, contrast, log2fc, adj_p, row_number() OVER (PARTITION BY gene ORDER BY adj_p, log2fc DESC, contrast) AS i FROM assoc) WHERE i = 1"))
def w05(spark, d):
    first = F.min_by(F.struct("contrast", "log2fc", "adj_p"), F.struct("adj_p", -F.col("log2fc"), "contrast"))
    return associations(spark, d).groupBy("gene").agg(first.alias("x")).select("gene", "x.*")


@query("W14_page_of_rows", sql("assoc", " SELECT gene, symbol, n FROM (SELECT gene, symbol, count(*) AS n FROM assoc GROUP BY ALL) ORDER BY n DESC, gene LIMIT 20 OFFSET 40"))
def w14(spark, d):
    return associations(spark, d).groupBy("gene", "symbol").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "gene").offset(40).limit(20)


@query("X05_benjamini_hochberg", sql("assoc", """, g AS (SELECT experiment, gene, min(adj_p) + 0.0001::DOUBLE * (gene % 97) AS p FROM assoc GROUP BY experiment, gene), r AS (SELECT *, row_number() OVER (PARTITION BY experiment ORDER BY p, gene) AS i, count(*) OVER (PARTITION BY experiment) AS n FROM g)
  SELECT experiment, gene, round(least(1.0, min(p * n / i) OVER (PARTITION BY experiment ORDER BY p DESC, gene DESC ROWS UNBOUNDED PRECEDING)), 10) AS padj FROM r"""))
def x05(spark, d):
    from spindle.operators.statistics import benjamini_hochberg

    g = associations(spark, d).groupBy("experiment", "gene").agg((F.min("adj_p") + F.lit(0.0001) * (F.col("gene") % 97)).alias("p"))
    return benjamini_hochberg(g, "p", ["experiment"]).select("experiment", "gene", F.round("padj", 10).alias("padj"))


@query("X06_significant_genes", sql("assoc", " SELECT contrast, gene, log2fc, adj_p, CASE WHEN log2fc > 0 THEN 'up' ELSE 'down' END AS direction FROM assoc WHERE adj_p < 0.02 AND abs(log2fc) >= 0.05"))
def x06(spark, d):
    rows = associations(spark, d).where((F.col("adj_p") < 0.02) & (F.abs("log2fc") >= 0.05))
    return rows.select("contrast", "gene", "log2fc", "adj_p", F.when(F.col("log2fc") > 0, "up").otherwise("down").alias("direction"))


@query("X08_fisher_combination", sql("assoc", """, s AS (SELECT gene, experiment, min(adj_p) + 0.001::DOUBLE * (gene % 13) + 0.01::DOUBLE AS p FROM assoc GROUP BY gene, experiment), g AS (SELECT gene, count(*) AS k, -2 * sum(ln(p)) AS x FROM s GROUP BY gene HAVING count(*) >= 2)
  SELECT gene, k AS n_studies, round(x, 6) AS x, round(least(1.0, list_sum(list_transform(range(k), lambda i: exp(i * ln(x / 2) - x / 2 - lgamma(i + 1.0))))), 8) AS pvalue FROM g"""))
def x08(spark, d):
    from spindle.operators.statistics import fisher

    rows = associations(spark, d).groupBy("gene", F.col("experiment").alias("study"))
    out = fisher(rows.agg((F.min("adj_p") + F.lit(0.001) * (F.col("gene") % 13) + 0.01).alias("p")))
    return out.select("gene", "n_studies", F.round("x", 6).alias("x"), F.round("pvalue", 8).alias("pvalue"))


@query("X07_stouffer_combination")
def x07(spark, d):
    from spindle.operators.statistics import stouffer

    rows = associations(spark, d).groupBy("gene", F.col("experiment").alias("study"))
    return stouffer(rows.agg((F.min("adj_p") + 0.001).alias("p"), F.avg("log2fc").alias("log2fc"), F.count("*").alias("n")))


@query("X13_volcano_points", sql("assoc", " SELECT gene, round(avg(log2fc), 12) + 0.0 AS x, round(-log10(greatest(min(adj_p), 1e-300)), 6) + 0.0 AS y FROM assoc WHERE adj_p > 0 GROUP BY gene"))
def x13(spark, d):
    g = associations(spark, d).where("adj_p > 0").groupBy("gene").agg(F.avg("log2fc").alias("lfc"), F.min("adj_p").alias("p"))
    return g.select("gene", (F.round("lfc", 12) + 0.0).alias("x"), (F.round(-F.log10(F.greatest("p", F.lit(1e-300))), 6) + 0.0).alias("y"))


@query("A01_opposing_expression", sql("assoc", """, drug AS (SELECT gene, symbol, log2fc, contrast FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY log2fc DESC, contrast, adj_p) AS i FROM assoc WHERE taxon = 0 AND log2fc > 0.01 AND adj_p <= 0.05) WHERE i = 1),
  dis AS (SELECT gene, label, min(log2fc) AS log2fc FROM assoc WHERE taxon = 3 AND log2fc < -0.01 AND adj_p <= 0.05 AND NOT regexp_matches(lower(label), 'promo|small') GROUP BY ALL)
  SELECT drug.gene, symbol, drug.log2fc AS drug_log2fc, dis.label AS disease, dis.log2fc AS disease_log2fc FROM drug JOIN dis ON drug.gene = dis.gene"""))
def a01(spark, d):
    rows = associations(spark, d).where("adj_p <= 0.05")
    first = F.max_by(F.struct("symbol", "log2fc"), F.struct("log2fc"))
    drug = rows.where("taxon = 0 and log2fc > 0.01").groupBy("gene").agg(first.alias("x")).select("gene", "x.symbol", F.col("x.log2fc").alias("drug_log2fc"))
    control = F.col("label").rlike("(?i)promo|small")
    disease = rows.where("taxon = 3 and log2fc < -0.01").where(~control).groupBy("gene", F.col("label").alias("disease")).agg(F.min("log2fc").alias("disease_log2fc"))
    return drug.join(disease, "gene").select("gene", "symbol", "drug_log2fc", "disease", "disease_log2fc")


@query("J21_shared_annotation_neighbours", sql("assoc", """, m AS (SELECT DISTINCT gene, label FROM assoc), s AS (SELECT a.gene, b.gene AS other, count(DISTINCT a.label) AS shared FROM m a JOIN m b ON a.label = b.label AND a.gene <> b.gene GROUP BY ALL)
  SELECT gene, other, shared FROM (SELECT *, row_number() OVER (PARTITION BY gene ORDER BY shared DESC, other) AS i FROM s) WHERE i <= 50"""))
def j21(spark, d):
    # genes with the same labels share as many with any other gene, so sets of labels are compared, and each set
    # stands for its 51 smallest genes: one more than asked for, as a gene is not its own neighbour
    genes = associations(spark, d).groupBy("gene").agg(F.sort_array(F.collect_set("label")).alias("labels"))
    sets = genes.select("labels").distinct().withColumn("label", F.explode("labels"))
    shared = sets.join(sets.withColumnRenamed("labels", "other_labels"), "label").groupBy("labels", "other_labels").agg(F.count("*").alias("shared"))
    first = lambda df, key, *order: df.withColumn("i", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
    members = first(genes, "labels", "gene").where("i <= 51").select(F.col("labels").alias("other_labels"), F.col("gene").alias("other"))
    near = first(shared.join(members, "other_labels"), "labels", F.desc("shared"), "other").where("i <= 51").select("labels", "other", "shared")
    lists = near.groupBy("labels").agg(F.sort_array(F.collect_list(F.struct((-F.col("shared")).alias("less"), "other"))).alias("near"))
    # a gene takes the first 50 of its set's list without itself
    own = genes.join(lists, "labels").withColumn("near", F.expr("slice(filter(near, x -> x.other <> gene), 1, 50)"))
    return own.select("gene", F.explode("near").alias("x")).select("gene", "x.other", (-F.col("x.less")).alias("shared"))


@query("G31_genes_per_contrast", sql("assoc", " SELECT contrast, count(DISTINCT gene) AS genes, count(*) AS n FROM assoc GROUP BY contrast"))
def g31(spark, d):
    return associations(spark, d).groupBy("contrast").agg(F.countDistinct("gene").alias("genes"), F.count("*").alias("n"))


@query("G29_path_type_totals", sql("assoc", " SELECT experiment, label, count(*) AS n, count(DISTINCT gene) AS genes FROM assoc GROUP BY ROLLUP (experiment, label)"))
def g29(spark, d):
    rows = associations(spark, d)
    return rows.rollup("experiment", "label").agg(F.count("*").alias("n"), F.countDistinct("gene").alias("genes"))


@query("G29_pivot", sql("assoc", " SELECT label, count(*) FILTER (WHERE taxon = 0) AS t0, count(*) FILTER (WHERE taxon = 1) AS t1, count(*) FILTER (WHERE taxon = 2) AS t2, count(*) FILTER (WHERE taxon = 3) AS t3, count(*) FILTER (WHERE taxon = 4) AS t4 FROM assoc GROUP BY label"))
def g29_pivot(spark, d):
    rows = associations(spark, d).groupBy("label").pivot("taxon", [0, 1, 2, 3, 4]).count()
    return rows.select("label", *(F.coalesce(str(i), F.lit(0)).alias(f"t{i}") for i in range(5)))


@query("U01_union_of_directions", sql("assoc", " SELECT DISTINCT gene, 'strong' AS kind FROM assoc WHERE abs(log2fc) > 0.1 UNION SELECT DISTINCT gene, 'sure' FROM assoc WHERE adj_p = 0"))
def u01(spark, d):
    rows = associations(spark, d)
    strong = rows.where(F.abs("log2fc") > 0.1).select("gene", F.lit("strong").alias("kind"))
    return strong.unionByName(rows.where("adj_p = 0").select("gene", F.lit("sure").alias("kind"))).distinct()


@query("U05_difference", sql("assoc", " SELECT DISTINCT gene FROM assoc WHERE taxon = 1 AND log2fc > 0.05 EXCEPT SELECT gene FROM assoc WHERE taxon = 2 AND log2fc > 0.05"))
def u05(spark, d):
    rows = associations(spark, d).where("log2fc > 0.05")
    return rows.where("taxon = 1").select("gene").distinct().join(rows.where("taxon = 2").select("gene"), "gene", "left_anti")


@query("E11_reified_associations", sql("assoc", """, a AS (SELECT DISTINCT contrast, gene, log2fc, adj_p FROM assoc), h AS (SELECT substr(md5(contrast || ' up ' || gene || ' ' || adj_p::VARCHAR), 1, 12) AS id, contrast, gene FROM a WHERE log2fc > 0)
  SELECT count(*) AS n, count(DISTINCT contrast) AS contrasts FROM (SELECT contrast, gene, 'subject' AS p FROM h UNION ALL SELECT contrast, gene, 'object' FROM h UNION ALL SELECT contrast, gene, 'log2fc' FROM h UNION ALL SELECT contrast, gene, 'adj_p' FROM h)"""))
def e11(spark, d):
    from spindle.operators.etl import reified

    rows = associations(spark, d).where("log2fc > 0")
    facts = reified(rows, "contrast", "gene", ["log2fc", "adj_p"])
    return facts.agg(F.count("*").alias("n"), F.countDistinct(F.when(F.col("p") == "subject", F.col("o"))).alias("contrasts"))


@query("E11_reified_triples", sql("assoc", " SELECT contrast, gene::VARCHAR AS gene, log2fc::DOUBLE AS log2fc, adj_p::DOUBLE AS adj_p, 4::BIGINT AS facts, 1::BIGINT AS nodes FROM (SELECT DISTINCT contrast, gene, log2fc, adj_p FROM assoc)"))
def e11_triples(spark, d):
    """Each association's node with all that its triples say, and how many nodes say the same."""
    from spindle.operators.etl import reified

    rows = associations(spark, d)
    of = lambda p: F.max(F.when(F.col("p") == p, F.col("o")))
    nodes = reified(rows, "contrast", "gene", ["log2fc", "adj_p"]).groupBy("s").agg(of("subject").alias("contrast"), of("object").alias("gene"), of("log2fc").cast("double").alias("log2fc"), of("adj_p").cast("double").alias("adj_p"), F.count("*").alias("facts"))
    return nodes.groupBy("contrast", "gene", "log2fc", "adj_p", "facts").agg(F.count("*").alias("nodes"))
