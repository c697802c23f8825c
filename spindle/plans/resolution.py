"""Queries that resolve names, and that describe graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from spindle.operators import resolution as r
from spindle.operators.graph import closure, match, optional
from spindle.plans.catalogue import IS_DATASET, has
from spindle.plans.registry import query
from spindle.sources.views import AGENT, MONDO, RDF_TYPE, SCHEMA, associations, hierarchy, read, sql, triples


def _terms(spark, d):
    return read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("label"), "p_brand", "p_type")


#: Scores of a phrase as ``label_score`` gives them.
def _score(column: str, phrase: str) -> str:
    return f"CASE WHEN lower({column}) = '{phrase}' THEN 4 WHEN starts_with(lower({column}), '{phrase}') THEN 3 WHEN contains(lower({column}), '{phrase}') THEN 2 END"


@query("A09_drug_search", "WITH m AS (SELECT p_partkey AS id, 4 AS score, p_name AS label, 'label' AS how FROM part WHERE lower(p_name) = 'red' UNION ALL SELECT p_partkey, CASE WHEN lower(p_brand) = 'red' THEN 3 ELSE 2 END, p_brand, 'alias' FROM part WHERE contains(lower(p_brand), 'red') UNION ALL SELECT p_partkey, CASE WHEN lower(p_name) = 'red' THEN 3 ELSE 2 END, p_name, 'alias' FROM part WHERE contains(lower(p_name), 'red') UNION ALL SELECT p_partkey + 1, 3, 'Red', 'brand' FROM part WHERE p_partkey % 97 = 5), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label, how) AS i FROM m) SELECT id, score, label, how FROM b WHERE i = 1 ORDER BY score DESC, id LIMIT 10")
def a09(spark, d):
    t = _terms(spark, d)
    aliases = t.select("id", F.col("p_brand").alias("alias")).unionByName(t.select("id", F.col("label").alias("alias")))
    brands = t.where("id % 97 = 5").select(F.lit("Red").alias("brand"), (F.col("id") + 1).alias("ingredient"))
    return r.drugs(t.select("id", "label"), aliases, brands, "red", most=10)


@query("A10_ancestor_restriction", sql("hier", f""", up AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT start, parent FROM up JOIN hier ON node = child), top AS (SELECT p_partkey AS id, p_name AS label, {_score('p_name', 'red')} AS score FROM part WHERE contains(lower(p_name), 'red') ORDER BY score DESC, id LIMIT 10),
  ok AS (SELECT id FROM top WHERE id IN (SELECT start FROM up WHERE node = 1)), ko AS (SELECT id FROM top WHERE id IN (SELECT start FROM up WHERE node = -1))
  SELECT 'below 1' AS kind, id, label, score FROM top WHERE id IN (SELECT id FROM ok) OR (SELECT count(*) FROM ok) = 0 UNION ALL SELECT 'below -1', id, label, score FROM top WHERE id IN (SELECT id FROM ko) OR (SELECT count(*) FROM ko) = 0""", recursive=True))
def a10(spark, d):
    """The ten best terms, those of them below a root; without any, all ten stay."""
    t = _terms(spark, d).withColumn("score", r.label_score("label", "red")).where("score is not null").orderBy(F.desc("score"), "id").limit(10).select("id", "label", "score")
    above = closure(hierarchy(spark, d), t.select(F.col("id").alias("node")))
    below = lambda root: r.within(t, above.where(F.col("node") == root).select(F.col("start").alias("id"))).withColumn("kind", F.lit(f"below {root}"))
    return below(1).unionByName(below(-1)).select("kind", "id", "label", "score")


@query("A11_label_and_synonym_search", "SELECT p_partkey AS id, 'label' AS how, p_name AS text FROM part WHERE contains(lower(p_name), 'ring') UNION SELECT p_partkey, 'synonym', p_type || ' ring' FROM part WHERE p_type = 'PROMO'")
def a11(spark, d):
    t = _terms(spark, d)
    synonyms = t.where("p_type = 'PROMO' or p_type = 'SMALL'").select("id", F.when(F.col("p_type") == "PROMO", F.concat("p_type", F.lit(" ring"))).otherwise(F.col("p_type")).alias("text"))
    both = t.select("id", F.lit("label").alias("how"), F.col("label").alias("text")).unionByName(synonyms.select("id", F.lit("synonym").alias("how"), "text"))
    return both.where(F.lower("text").contains("ring")).distinct()


@query("A12_introspection", sql("cat", f" SELECT '{SCHEMA}Dataset' AS class, p AS predicate, n FROM (SELECT '{RDF_TYPE}' AS p, count(*) AS n FROM cat UNION ALL SELECT '{SCHEMA}healthCondition', count(*) FROM cat UNION ALL SELECT '{SCHEMA}dateModified', count(modified) FROM cat UNION ALL SELECT '{SCHEMA}name', count(*) FROM cat)"))
def a12(spark, d):
    """Predicates of the subjects of each class."""
    t = triples(spark, d)
    some = t.where(F.col("p").isin(RDF_TYPE, *(SCHEMA + x for x in ("healthCondition", "dateModified", "name"))))
    classes = t.where(F.col("p") == RDF_TYPE).select("s", F.col("o").alias("class"))
    return some.join(classes, "s").groupBy("class", F.col("p").alias("predicate")).agg(F.count("*").alias("n"))


@query("A13_graph_selection", sql("cat", " SELECT resource, true AS has_dates, count(*) FILTER (WHERE o_orderkey % 3 = 0) > 0 AS has_doi FROM cat WHERE modified IS NOT NULL OR o_orderkey % 3 = 0 GROUP BY resource HAVING count(modified) > 0"))
def a13(spark, d):
    """Graphs (resources) that use a property with a given part in its name."""
    t = triples(spark, d).where(F.col("p").isin(SCHEMA + "dateModified", SCHEMA + "sameAs"))
    rows = t.groupBy(F.regexp_extract("s", "/dataset/([^/]+)/", 1).alias("resource")).agg(F.bool_or(F.lower("p").contains("date")).alias("has_dates"), F.bool_or(F.lower("p").contains("same")).alias("has_doi"))
    return rows.where("has_dates")


@query("A14_cross_layer", sql("assoc", ", g AS (SELECT DISTINCT label, gene FROM assoc WHERE log2fc > 0.1), s AS (SELECT label, experiment, count(DISTINCT g.gene) AS genes FROM g JOIN (SELECT DISTINCT gene, experiment FROM assoc WHERE adj_p < 0.01) e ON g.gene = e.gene GROUP BY ALL) SELECT label, min(experiment) AS first_study, count(*) AS studies, max(genes) AS genes FROM s GROUP BY label"))
def a14(spark, d):
    """From a term to its genes, to studies with data on them, to the first such study."""
    rows = associations(spark, d)
    genes = rows.where("log2fc > 0.1").select("label", "gene").distinct()
    data = rows.where("adj_p < 0.01").select("gene", "experiment").distinct()
    found = genes.join(data, "gene").groupBy("label", "experiment").agg(F.count("*").alias("genes"))
    return found.groupBy("label").agg(F.min("experiment").alias("first_study"), F.count("*").alias("studies"), F.max("genes").alias("genes"))


@query("B21_disease_resolution", f"WITH q AS (SELECT unnest(['red ring', 'red', 'no such ring']) AS phrase), t AS (SELECT p_partkey AS id, lower(p_name) AS label FROM part WHERE p_partkey % 2 = 0), m AS (SELECT phrase, id, CASE WHEN label = phrase THEN 1.0 WHEN starts_with(label, phrase) THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence FROM q JOIN t ON contains(label, phrase)) SELECT phrase, id, confidence FROM m UNION ALL SELECT phrase, p_partkey, 0.3::DOUBLE FROM q JOIN part ON p_partkey % 2 = 1 AND contains(lower(p_name), split_part(phrase, ' ', -1)) WHERE phrase NOT IN (SELECT phrase FROM m)")
def b21(spark, d):
    t = _terms(spark, d).select("id", "label")
    out = None
    for phrase in ("red ring", "red", "no such ring"):
        own = r.resolved(t.where("id % 2 = 0"), t.where("id % 2 = 1"), phrase).select(F.lit(phrase).alias("phrase"), "id", "confidence")
        out = own if out is None else out.unionByName(own)
    return out


@query("B21_expansion_with_root", sql("hier", ", up AS (SELECT p_partkey AS start, p_partkey AS node FROM part UNION SELECT start, parent FROM up JOIN hier ON node = child) SELECT DISTINCT start AS id FROM up WHERE node = 7 UNION SELECT 7::BIGINT", recursive=True))
def b21b(spark, d):
    """A term with everything below it, walked downwards; the term itself is always among them."""
    down = hierarchy(spark, d).select(F.col("parent").alias("child"), F.col("child").alias("parent"))
    root = spark.createDataFrame([(7,)], "node long")
    return closure(down, root).select(F.col("node").alias("id"))


@query("B24_labels_with_fallback", sql("cat", f" SELECT DISTINCT dataset, '{SCHEMA}funding' AS p, grant_iri AS o, grant_name AS label FROM cat WHERE o_orderkey IN (1, 3, 5) UNION SELECT DISTINCT dataset, '{SCHEMA}measurementTechnique', '{AGENT}technique' || (o_orderkey % 7), 'technique' || (o_orderkey % 7) FROM cat WHERE o_orderkey IN (1, 3, 5)"))
def b24(spark, d):
    """Ends of edges with their names; an end whose name is not asked for shows the last part of its IRI."""
    t = triples(spark, d)
    rows = t.where(F.col("p").isin(SCHEMA + "funding", SCHEMA + "measurementTechnique") & F.col("s").rlike("/(1|3|5)$"))
    names = t.where((F.col("p") == SCHEMA + "name") & F.col("s").contains("/grant/")).groupBy(F.col("s").alias("o")).agg(F.min("o").alias("name"))
    return rows.join(names, "o", "left").select(F.col("s").alias("dataset"), "p", "o", F.coalesce("name", r.last_part("o")).alias("label"))


@query("B25_disease_labels", sql("cat", f", q AS (SELECT unnest(['{MONDO}0000003', '{MONDO}0000017', '{MONDO}9999999']) AS condition) SELECT q.condition, min(condition_name) AS label FROM q LEFT JOIN cat ON q.condition = cat.condition GROUP BY q.condition"))
def b25(spark, d):
    asked = spark.createDataFrame([(MONDO + x,) for x in ("0000003", "0000017", "9999999")], "condition string")
    names = triples(spark, d).where((F.col("p") == SCHEMA + "name") & F.col("s").startswith(MONDO)).groupBy(F.col("s").alias("condition")).agg(F.min("o").alias("label"))
    return asked.join(names, "condition", "left")


@query("B27_catalogue_profile", sql("cat", f" SELECT 'healthCondition' AS property, count(*) AS n, count(DISTINCT condition) AS targets, min(condition) AS example FROM cat UNION ALL SELECT 'species', count(*), count(DISTINCT taxon), min(taxon) FROM cat UNION ALL SELECT 'infectiousAgent', count(*), count(DISTINCT agent), min(agent) FROM cat"))
def b27(spark, d):
    some = {SCHEMA + x: x for x in ("healthCondition", "species", "infectiousAgent")}
    t = triples(spark, d).where(F.col("p").isin(*some))
    return t.groupBy(r.last_part("p").alias("property")).agg(F.count("*").alias("n"), F.countDistinct("o").alias("targets"), F.min("o").alias("example"))


PHRASES = ["red", "blue bolt", "ring"]


@query("B29_best_score_per_term", "WITH q AS (SELECT unnest(['red', 'blue bolt', 'ring']) AS phrase), m AS (SELECT p_partkey AS id, phrase, CASE WHEN lower(p_name) = phrase THEN 4 WHEN starts_with(lower(p_name), phrase) THEN 3 ELSE 2 END AS score FROM part JOIN q ON contains(lower(p_name), phrase)), b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, phrase) AS i FROM m) SELECT id, score, phrase AS label, CASE WHEN id % 3 = 0 THEN 'MONDO' WHEN id % 3 = 1 THEN 'UBERON' ELSE 'NCBITaxon' END AS how FROM b WHERE i = 1")
def b29(spark, d):
    """Several phrases over terms of three vocabularies: the best score of each term."""
    kind = F.element_at(F.array(F.lit("MONDO"), F.lit("UBERON"), F.lit("NCBITaxon")), (F.col("id") % 3 + 1).cast("int"))
    t = _terms(spark, d)
    return r.best_by_id(*(t.select("id", r.label_score("label", p).alias("score"), F.lit(p).alias("label"), kind.alias("how")) for p in PHRASES))


B30_SCORED = "q AS (SELECT unnest(['red', 'blue bolt', 'ring']) AS phrase), s AS (SELECT phrase, p_partkey AS id, p_partkey % 5 = 0 AS obsolete, CASE WHEN lower(p_name) = phrase THEN 4 WHEN starts_with(lower(p_name), phrase) THEN 3 ELSE 2 END AS score FROM part JOIN q ON contains(lower(p_name), phrase))"


def _phrase_scores(spark, d):
    t = _terms(spark, d)
    parts = [t.select(F.lit(p).alias("phrase"), "id", (F.col("id") % 5 == 0).alias("obsolete"), r.label_score("label", p).alias("score")).where("score is not null") for p in PHRASES]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("B30_tiered_selection", f"WITH {B30_SCORED}, b AS (SELECT *, max(score) OVER (PARTITION BY phrase) AS best FROM s), r AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY obsolete, id) AS i FROM b WHERE score = best) SELECT phrase, id, score, obsolete FROM r WHERE i <= 3")
def b30(spark, d):
    return r.tiers(_phrase_scores(spark, d), "phrase").select("phrase", "id", "score", "obsolete")


@query("B30_rescored_by_synonym", f"WITH {B30_SCORED}, k AS (SELECT *, row_number() OVER (PARTITION BY phrase ORDER BY score DESC, id) AS i FROM s) SELECT phrase, id, CASE WHEN id % 4 = 1 AND phrase = 'ring' AND i <= 5 AND score < 3 THEN 3 ELSE score END AS score FROM k")
def b30b(spark, d):
    synonyms = _terms(spark, d).where("id % 4 = 1").select("id", F.lit("RING").alias("synonym"))
    return r.rescored(_phrase_scores(spark, d), synonyms, "phrase").select("phrase", "id", "score")


@query("B30_synonyms_per_term", "SELECT p_name AS label, count(DISTINCT p_brand) AS n, min(p_brand) AS first FROM part GROUP BY p_name")
def b30c(spark, d):
    grouped = _terms(spark, d).groupBy("label").agg(F.sort_array(F.collect_set("p_brand")).alias("synonyms"))
    return grouped.select("label", F.size("synonyms").cast("long").alias("n"), F.col("synonyms")[0].alias("first"))


@query("B31_name_to_symbol", "WITH g AS (SELECT 'GENE' || p_partkey AS symbol, p_partkey % 3 = 0 AS approved, lower(p_name) AS name FROM part) SELECT name, symbol, approved FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY approved DESC, symbol) AS i FROM g) WHERE i = 1")
def b31(spark, d):
    t = _terms(spark, d)
    genes = t.select(F.concat(F.lit("GENE"), "id").alias("symbol"), (F.col("id") % 3 == 0).alias("approved"), F.col("label").alias("name"))
    return r.symbols(genes, t.select(F.upper("label").alias("name")))


@query("B31_name_or_symbol", "SELECT x, regexp_matches(x, '^[A-Z][A-Z0-9-]{1,11}$') AS is_symbol, count(*) AS n FROM (SELECT p_type AS x FROM part UNION ALL SELECT p_name FROM part UNION ALL SELECT p_brand FROM part) GROUP BY ALL")
def b31b(spark, d):
    t = _terms(spark, d)
    x = t.select(F.explode(F.array("p_type", "label", "p_brand")).alias("x"))
    return x.groupBy("x").agg(F.count("*").alias("n")).select("x", r.looks_like_symbol("x").alias("is_symbol"), "n")


@query("B32_keyword_filter", "SELECT p_partkey AS id, p_name AS label FROM part WHERE lower(p_name) = 'red ring' AND NOT regexp_matches(lower(p_brand), '#1|#2$')")
def b32(spark, d):
    t = _terms(spark, d).where(F.lower("label") == "red ring")
    return t.where(~F.col("p_brand").rlike("(?i)#1|#2$")).select("id", "label")


@query("B38_predicates_of_classes", sql("cat", " SELECT 'schema:' || p AS name, kind FROM (VALUES ('healthCondition', 'health'), ('species', 'organism'), ('infectiousAgent', 'health'), ('funding', 'other'), ('url', 'other')) t(p, kind) WHERE (SELECT count(*) FROM cat) > 0"))
def b38(spark, d):
    some = [SCHEMA + x for x in ("healthCondition", "species", "infectiousAgent", "funding", "url")]
    used = triples(spark, d).where(F.col("p").isin(*some)).select("p").distinct()
    kind = F.when(F.lower("p").rlike("condition|agent"), "health").when(F.lower("p").contains("species"), "organism").otherwise("other")
    return used.select(F.regexp_replace("p", "^http://schema\\.org/", "schema:").alias("name"), kind.alias("kind"))


@query("B39_readable_profile", sql("cat", ", s AS (SELECT resource, name, row_number() OVER (PARTITION BY resource ORDER BY dataset) AS i FROM cat) SELECT resource, string_agg(DISTINCT condition_name, '; ' ORDER BY condition_name) AS conditions, string_agg(DISTINCT taxon_name, '; ' ORDER BY taxon_name) AS species, (SELECT string_agg(name, '; ' ORDER BY i) FROM s WHERE s.resource = cat.resource AND i <= 20) AS samples FROM cat GROUP BY resource"))
def b39(spark, d):
    from pyspark.sql import Window

    t = triples(spark, d)
    resource = F.regexp_extract("dataset", "/dataset/([^/]+)/", 1).alias("resource")
    rows = match(t, [IS_DATASET, has("?dataset", "healthCondition", "?c"), has("?c", "name", "?condition"), has("?dataset", "species", "?t"), has("?t", "name", "?species")])
    joined = lambda c: F.array_join(F.sort_array(F.collect_set(c)), "; ")
    profile = rows.groupBy(resource).agg(joined("condition").alias("conditions"), joined("species").alias("species"))
    named = optional(match(t, [IS_DATASET]), t, [has("?dataset", "name", "?name")]).withColumn("resource", resource)
    first = named.withColumn("i", F.row_number().over(Window.partitionBy("resource").orderBy("dataset"))).where("i <= 20")
    samples = first.groupBy("resource").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "name"))), lambda x: x["name"]), "; ").alias("samples"))
    return profile.join(samples, "resource")


@query("B44_second_target", sql("cat", f" SELECT DISTINCT condition, CASE WHEN c_nationkey % 4 = 0 THEN 'http://www.ebi.ac.uk/efo/EFO_' || c_nationkey WHEN c_nationkey % 2 = 0 THEN 'http://purl.obolibrary.org/obo/DOID_' || c_nationkey END AS iri FROM cat WHERE c_nationkey % 2 = 0"))
def b44(spark, d):
    """Cross-references by a mapping table: the preferred vocabulary, else the other."""
    from spindle.operators.etl import curie_to_iri

    conditions = match(triples(spark, d), [has("?dataset", "healthCondition", "?condition")]).select("condition").distinct()
    n = read(spark, d, "nation").select(F.concat(F.lit(MONDO), F.lpad(F.col("n_nationkey").cast("string"), 7, "0")).alias("condition"), F.col("n_nationkey").alias("k"))
    xrefs = n.where("k % 4 = 0").select("condition", F.lit(0).alias("rank"), F.concat(F.lit("EFO:"), "k").alias("curie")).unionByName(n.where("k % 2 = 0").select("condition", F.lit(1).alias("rank"), F.concat(F.lit("DOID:"), "k").alias("curie")))
    best = xrefs.groupBy("condition").agg(F.min(F.struct("rank", "curie")).alias("x"))
    prefixes = {"EFO": "http://www.ebi.ac.uk/efo/EFO_", "DOID": "http://purl.obolibrary.org/obo/DOID_"}
    return conditions.join(best, "condition").select("condition", curie_to_iri(F.col("x.curie"), prefixes).alias("iri"))


@query("K04_gene_table", sql("assoc", ", g AS (SELECT gene, avg(log2fc) AS l, min(adj_p)::DOUBLE AS p FROM assoc GROUP BY gene) SELECT gene, printf('%.2f', round(l, 2)) AS log2fc, CASE WHEN p = 0 THEN 'NA' ELSE printf('%.2e', p) END AS padj FROM g WHERE abs(l * 100 - floor(l * 100) - 0.5) > 0.01"))
def k04(spark, d):
    from spindle.operators.statistics import decimal_mean
    from spindle.sources.sinks import gene_table

    g = associations(spark, d).groupBy("gene").agg(decimal_mean("log2fc").alias("log2fc"), F.min("adj_p").cast("double").alias("padj"))
    # values at the border of two roundings are left to neither side
    g = g.where(F.abs(F.col("log2fc") * 100 - F.floor(F.col("log2fc") * 100) - 0.5) > 0.01)
    # a small negative mean keeps its sign: -0.00
    return gene_table(g.withColumn("padj", F.nullif("padj", F.lit(0.0))), places=2)


@query("K05_result_with_provenance", "SELECT n_nationkey AS id, 'rank' AS method, n_name AS name FROM nation")
def k05(spark, d):
    from spindle.sources.sinks import with_provenance

    rows = with_provenance(read(spark, d, "nation").select("n_nationkey", "n_name"), method="rank", version="1")
    get = lambda path: F.get_json_object("value", path)
    return rows.select(get("$.result.n_nationkey").cast("int").alias("id"), get("$.provenance.method").alias("method"), get("$.result.n_name").alias("name"))
