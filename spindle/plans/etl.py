"""Queries over records, identifiers, hierarchies and serialised graphs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from spindle.operators.etl import clean_iri, curie_to_iri, literal_type, n_triples, parse_n_triples, slug, turtle_blocks
from spindle.operators.ranking import facets, label_rank, scored_terms
from spindle.operators.segments import prefix_segments
from spindle.plans.registry import query
from spindle.sources.views import SCHEMA, read, sql, triples


@query("E02_entity_iri", "SELECT s_suppkey AS id, CASE WHEN s_suppkey % 4 = 0 THEN 'https://ror.org/' || s_suppkey WHEN s_suppkey % 4 = 1 THEN 'https://doi.org/10.1/' || s_suppkey ELSE 'https://data.example.org/org/' || lower(replace(s_name, '#', '_')) END AS iri FROM supplier")
def e02(spark, d):
    s = read(spark, d, "supplier")
    ror = F.when(F.col("s_suppkey") % 4 == 0, F.concat(F.lit("https://ror.org/"), "s_suppkey"))
    doi = F.when(F.col("s_suppkey") % 4 == 1, F.concat(F.lit("https://doi.org/10.1/"), "s_suppkey"))
    return s.select(F.col("s_suppkey").alias("id"), F.coalesce(ror, doi, F.concat(F.lit("https://data.example.org/org/"), slug("s_name"))).alias("iri"))


@query("E07_multi_value_split", "WITH u AS (SELECT p_partkey, unnest(string_split(p_name || ' ' || p_type, ' ')) AS v FROM part) SELECT DISTINCT p_partkey AS id, 'https://data.example.org/value/' || lower(v) AS iri FROM u WHERE v <> ''")
def e07(spark, d):
    p = read(spark, d, "part").select(F.col("p_partkey").alias("id"), F.explode(F.split(F.concat_ws(" ", "p_name", "p_type"), " ")).alias("v"))
    return p.where("v <> ''").select("id", F.concat(F.lit("https://data.example.org/value/"), F.lower("v")).alias("iri")).distinct()


@query("E08_skip_list", "SELECT p_type AS kind, count(*) AS n FROM part WHERE p_type NOT IN ('PROMO', 'SMALL') GROUP BY p_type")
def e08(spark, d):
    return read(spark, d, "part").where(~F.col("p_type").isin("PROMO", "SMALL")).groupBy(F.col("p_type").alias("kind")).agg(F.count("*").alias("n"))


@query("B01_clean_iri", "WITH p AS (SELECT page_id, trim(url) || CASE page_id % 4 WHEN 1 THEN ' \"x' WHEN 2 THEN '<b>' WHEN 3 THEN '[1]' ELSE '' END AS u FROM pages) SELECT page_id, CASE WHEN regexp_matches(u, '^https?://[^/?#]') THEN CASE page_id % 4 WHEN 0 THEN u ELSE rtrim(u[:-4]) END END AS iri FROM p")
def b01(spark, d):
    tail = F.element_at(F.array(F.lit(""), F.lit(' "x'), F.lit("<b>"), F.lit("[1]")), (F.col("page_id") % 4 + 1).cast("int"))
    return read(spark, d, "pages").select("page_id", clean_iri(F.concat(F.trim("url"), tail)).alias("iri"))


@query("B02_literal_types", "WITH v AS (SELECT unnest([o_orderkey::VARCHAR, strftime(o_orderdate, '%Y-%m-%d'), strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S'), o_orderstatus, 'true', '1.5e3', '12.25']) AS x, unnest(['integer', 'date', 'dateTime', 'string', 'boolean', 'double', 'double']) AS kind FROM orders) SELECT kind, count(*) AS n FROM v GROUP BY kind")
def b02(spark, d):
    o = read(spark, d, "orders")
    values = F.array(F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"), "o_orderstatus", F.lit("true"), F.lit("1.5e3"), F.lit("12.25"))
    return o.select(F.explode(values).alias("x")).groupBy(literal_type("x").alias("kind")).agg(F.count("*").alias("n"))


@query("B06_curie_to_iri", "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN 'http://purl.obolibrary.org/obo/MONDO_' || n_nationkey WHEN 1 THEN 'http://www.ebi.ac.uk/efo/EFO_' || n_nationkey END AS iri FROM nation")
def b06(spark, d):
    curie = F.concat(F.element_at(F.array(F.lit("MONDO:"), F.lit("EFO_"), F.lit("XX:")), (F.col("n_nationkey") % 3 + 1).cast("int")), F.col("n_nationkey").cast("string"))
    prefixes = {"MONDO": "http://purl.obolibrary.org/obo/MONDO_", "EFO": "http://www.ebi.ac.uk/efo/EFO_"}
    return read(spark, d, "nation").select(F.col("n_nationkey").alias("id"), curie_to_iri(curie, prefixes).alias("iri"))


@query("B03_slugs", "SELECT DISTINCT o_orderpriority AS label, lower(regexp_replace(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS slug FROM orders")
def b03(spark, d):
    return read(spark, d, "orders").select(F.col("o_orderpriority").alias("label"), slug("o_orderpriority").alias("slug")).distinct()


@query("K01_n_triples", sql("cat", f" SELECT DISTINCT '<' || dataset || '> <{SCHEMA}healthCondition> <' || condition || '> .' AS line FROM cat UNION SELECT DISTINCT '<' || dataset || '> <{SCHEMA}name> \"' || name || '\" .' FROM cat"))
def k01(spark, d):
    return n_triples(triples(spark, d).where(F.col("p").isin(SCHEMA + "healthCondition", SCHEMA + "name") & F.col("s").contains("/dataset/")))


@query("S18_n_triples_round_trip", "SELECT count(DISTINCT doc_id) AS n, 0::BIGINT AS lost FROM documents WHERE text IS NOT NULL")
def s18(spark, d):
    """Texts with quotes, tabs and line breaks survive writing and parsing."""
    docs = read(spark, d, "documents").where("text is not null")
    t = docs.select(F.concat(F.lit("https://data.example.org/doc/"), "doc_id").alias("s"), F.lit(SCHEMA + "text").alias("p"), F.col("text").alias("o"), F.lit(False).alias("iri"))
    back = parse_n_triples(n_triples(t))
    joined = t.join(back.select("s", F.col("o").alias("back")), "s", "left")
    return joined.agg(F.countDistinct("s").alias("n"), F.count_if(~F.col("o").eqNullSafe(F.col("back"))).alias("lost"))


@query("K02_turtle_blocks", sql("cat", f" SELECT DISTINCT taxon AS s, '<' || taxon || '> <{SCHEMA}name> \"' || taxon_name || '\" .' AS block FROM cat"))
def k02(spark, d):
    names = triples(spark, d).where((F.col("p") == SCHEMA + "name") & F.col("s").contains("/taxonomy/"))
    return turtle_blocks(names)


@query("K03_csv_lines", "SELECT n_nationkey || ',\"' || replace(n_name || ', \"' || n_regionkey || '\"', '\"', '\"\"') || '\"' AS line FROM nation")
def k03(spark, d):
    n = read(spark, d, "nation")
    cell = F.concat("n_name", F.lit(', "'), "n_regionkey", F.lit('"'))
    return n.select(F.to_csv(F.struct("n_nationkey", cell.alias("cell")), {"quote": '"', "escape": '"'}).alias("line"))


@query("S01_json_fields", "SELECT event_type, count(*) AS n, count(json_extract_string(props, '$.k')) AS with_k, sum(json_extract_string(props, '$.k')::BIGINT)::BIGINT AS total FROM events GROUP BY event_type")
def s01(spark, d):
    k = F.get_json_object("props", "$.k")
    return read(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count(k).alias("with_k"), F.sum(k.cast("long")).alias("total"))


@query("G11_key_set", "SELECT DISTINCT unnest(json_keys(props)) AS key FROM events")
def g11(spark, d):
    return read(spark, d, "events").select(F.explode(F.json_object_keys("props")).alias("key")).distinct()


@query("S13_prefix_segments", """WITH b AS (SELECT min(c_name) AS lo, max(c_name) AS hi FROM customer), s AS (SELECT max(i) AS shared FROM b, range(0, 25) r(i) WHERE left(lo, i) = left(hi, i)),
  p AS (SELECT left(c_name, i) AS prefix, count(*) AS n FROM customer, s, range(1, 25) r(i) WHERE i > shared AND length(c_name) >= i GROUP BY 1)
  SELECT DISTINCT first.prefix, first.n, true AS complete FROM customer, LATERAL (SELECT prefix, n FROM p WHERE starts_with(c_name, prefix) AND n <= 60 ORDER BY length(prefix) LIMIT 1) first""")
def s13(spark, d):
    """Prefixes of customer names such that each covers at most 60 rows where one more character can tell them apart."""
    return prefix_segments(read(spark, d, "customer").select(F.col("c_name").alias("key")), 60)


@query("S14_dedup_by_identifier", "SELECT key, min(event_id) AS first_id, count(*) AS n FROM (SELECT event_id, coalesce(nullif(CASE WHEN user_id % 5 = 0 THEN '' ELSE user_id::VARCHAR END, ''), 'e' || event_id) AS key FROM events) GROUP BY key")
def s14(spark, d):
    identifier = F.when(F.col("user_id") % 5 == 0, "").otherwise(F.col("user_id").cast("string"))
    key = F.coalesce(F.nullif(identifier, F.lit("")), F.concat(F.lit("e"), "event_id"))
    return read(spark, d, "events").groupBy(key.alias("key")).agg(F.min("event_id").alias("first_id"), F.count("*").alias("n"))


@query("P27_extract_from_iri", "SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, regexp_extract(url, '([0-9]+)', 1) AS number FROM pages")
def p27(spark, d):
    return read(spark, d, "pages").select("page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), F.regexp_extract("url", "([0-9]+)", 1).alias("number"))


@query("J18_bridge_by_extracted_ids", "WITH x AS (SELECT page_id, unnest(regexp_extract_all(html, '[0-9]{2,4}')) AS m FROM pages), k AS (SELECT DISTINCT page_id, m::BIGINT AS id FROM x) SELECT page_id, min(doc_id) AS first_doc, count(*) AS n, count(toxic) AS labelled FROM k JOIN documents ON id = doc_id LEFT JOIN labels USING (doc_id) GROUP BY page_id")
def j18(spark, d):
    pages = read(spark, d, "pages").select("page_id", F.explode(F.array_distinct(F.regexp_extract_all("html", F.lit("[0-9]{2,4}"), 0))).alias("m"))
    ids = pages.select("page_id", F.col("m").cast("long").alias("doc_id")).distinct()
    docs = read(spark, d, "documents").select("doc_id")
    labels = read(spark, d, "labels").select("doc_id", "toxic")
    rows = ids.join(docs, "doc_id").join(labels, "doc_id", "left")
    return rows.groupBy("page_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n"), F.count("toxic").alias("labelled"))


@query("W06_term_match_ranking", "WITH n AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 7 WHEN 1 THEN ', ' || p_size WHEN 2 THEN ' type 2' ELSE '' END AS label, CASE WHEN p_partkey % 4 <> 0 THEN p_retailprice END AS relevance, p_size < 5 AS obsolete FROM part), t AS (SELECT *, CASE WHEN lower(label) = 'red ring' THEN 4 WHEN starts_with(lower(label), 'red') THEN 3 WHEN contains(lower(label), 'ring') THEN 2 ELSE 0 END AS score FROM n) SELECT id, label, score::BIGINT AS score FROM t WHERE score > 0 ORDER BY score DESC, (lower(label) = 'red ring') DESC, regexp_matches(lower(label), ',\\s*[0-9]+\\s*$|\\btype\\s+[0-9]+\\b'), coalesce(relevance, 0) DESC, obsolete, abs(length(label) - 8), length(label) DESC, id LIMIT 40")
def w06(spark, d):
    p = read(spark, d, "part")
    label = F.concat("p_name", F.when(F.col("p_partkey") % 7 == 1, F.concat(F.lit(", "), "p_size")).when(F.col("p_partkey") % 7 == 2, " type 2").otherwise(""))
    terms = p.select(F.col("p_partkey").alias("id"), label.alias("label"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_retailprice")).alias("relevance"), (F.col("p_size") < 5).alias("obsolete"))
    return scored_terms(terms, "red ring", 40).select("id", "label", "score")


@query("W07_exact_prefix_contains", "WITH t AS (SELECT DISTINCT p_name AS label, CASE WHEN lower(p_name) = 'blue bolt' THEN 0 WHEN starts_with(lower(p_name), 'blue') THEN 1 WHEN contains(lower(p_name), 'bolt') THEN 2 END AS rank FROM part) SELECT label, rank::BIGINT AS rank FROM t WHERE rank IS NOT NULL")
def w07(spark, d):
    rank = label_rank("label", "blue bolt", ["blue"], ["bolt"])
    return read(spark, d, "part").select(F.col("p_name").alias("label")).distinct().withColumn("rank", rank.cast("long")).where("rank is not null")


@query("W16_examples_per_predicate", sql("cat", f", t AS (SELECT DISTINCT 'healthCondition' AS p, condition AS o FROM cat UNION SELECT 'species', taxon FROM cat UNION SELECT 'infectiousAgent', agent FROM cat) SELECT p, string_agg(o, ' ' ORDER BY o) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY p ORDER BY o) AS i FROM t) WHERE i <= 3 GROUP BY p"))
def w16(spark, d):
    some = ["healthCondition", "species", "infectiousAgent"]
    t = triples(spark, d).where(F.col("p").isin(*(SCHEMA + x for x in some))).select(F.regexp_extract("p", "[^/#]+$", 0).alias("p"), "o").distinct()
    ranked = t.withColumn("i", F.row_number().over(Window.partitionBy("p").orderBy("o"))).where("i <= 3")
    return ranked.groupBy("p").agg(F.array_join(F.sort_array(F.collect_list("o")), " ").alias("examples"))


@query("G30_rows_grouped_by_dataset", "SELECT source, min(doc_id) AS first_id, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS langs, count(*) AS n FROM documents GROUP BY source")
def g30(spark, d):
    docs = read(spark, d, "documents").select("source", "doc_id", "lang")
    return docs.groupBy("source").agg(F.min("doc_id").alias("first_id"), F.array_join(F.sort_array(F.collect_set("lang")), ", ").alias("langs"), F.count("*").alias("n"))


@query("A08_bridge_flag", "WITH o AS (SELECT c_nationkey, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_nationkey), s AS (SELECT DISTINCT s_nationkey FROM supplier WHERE s_acctbal > 9000) SELECT n_name AS name, coalesce(orders, 0)::BIGINT AS orders, s_nationkey IS NOT NULL AS covered FROM nation LEFT JOIN o ON n_nationkey = c_nationkey LEFT JOIN s ON n_nationkey = s_nationkey")
def a08(spark, d):
    orders = read(spark, d, "orders").select("o_custkey").join(read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey"))
    counted = orders.groupBy(F.col("c_nationkey").alias("n_nationkey")).agg(F.count("*").alias("orders"))
    covered = read(spark, d, "supplier").where("s_acctbal > 9000").select(F.col("s_nationkey").alias("n_nationkey")).distinct().withColumn("covered", F.lit(True))
    rows = read(spark, d, "nation").join(counted, "n_nationkey", "left").join(covered, "n_nationkey", "left")
    return rows.select(F.col("n_name").alias("name"), F.coalesce("orders", F.lit(0)).alias("orders"), F.coalesce("covered", F.lit(False)).alias("covered"))


@query("B43_completeness", "SELECT c_nationkey AS resource, count(*) AS total, count(*) FILTER (WHERE c_custkey <= 700) AS fetched, count(*) FILTER (WHERE c_custkey > 700) AS remaining FROM customer GROUP BY c_nationkey")
def b43(spark, d):
    done = F.count_if(F.col("c_custkey") <= 700)
    return read(spark, d, "customer").groupBy(F.col("c_nationkey").alias("resource")).agg(F.count("*").alias("total"), done.alias("fetched"), (F.count("*") - done).alias("remaining"))


@query("B19_facets", "SELECT lang, source, count(*) AS n FROM documents WHERE lang IN ('de', 'fr') GROUP BY lang, source ORDER BY n DESC, lang, source LIMIT 15")
def b19(spark, d):
    return read(spark, d, "documents").where(F.col("lang").isin("de", "fr")).groupBy("lang", "source").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang", "source").limit(15)


@query("B19_facets_by_field", """WITH f AS (SELECT 'lang' AS field, lang AS value FROM documents WHERE source IN ('web', 'news', 'forum') UNION ALL SELECT 'source', source FROM documents WHERE lang IN ('de', 'fr') UNION ALL SELECT 'size', (n_chars // 1000)::VARCHAR FROM documents WHERE lang IN ('de', 'fr') AND source IN ('web', 'news', 'forum'))
  SELECT * FROM (SELECT field, value, n, row_number() OVER (PARTITION BY field ORDER BY n DESC, value)::INTEGER AS rank FROM (SELECT field, value, count(*) AS n FROM f WHERE value IS NOT NULL GROUP BY field, value)) WHERE rank <= 15""")
def b19_by_field(spark, d):
    """Facets of two fields under each other's filter, and of one that has none."""
    docs = read(spark, d, "documents").withColumn("size", F.floor(F.col("n_chars") / 1000))
    return facets(docs, ["lang", "source", "size"], 15, {"lang": ["de", "fr"], "source": ["web", "news", "forum"]})


@query("U06_ordered_union", "WITH e AS (SELECT user_id, event_type, min(event_id) AS first_id FROM events GROUP BY ALL) SELECT user_id, string_agg(event_type, '>' ORDER BY first_id) AS kinds FROM e GROUP BY user_id")
def u06(spark, d):
    e = read(spark, d, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("first_id"))
    order = F.sort_array(F.collect_list(F.struct("first_id", "event_type")))
    return e.groupBy("user_id").agg(F.array_join(F.transform(order, lambda x: x["event_type"]), ">").alias("kinds"))


@query("U02_concat_and_dedup", "SELECT count(*) AS n, count(DISTINCT id) AS ids FROM (SELECT DISTINCT id, kind FROM (SELECT s_nationkey AS id, 'supplier' AS kind FROM supplier UNION ALL SELECT c_nationkey, 'customer' FROM customer))")
def u02(spark, d):
    a = read(spark, d, "supplier").select(F.col("s_nationkey").alias("id"), F.lit("supplier").alias("kind"))
    b = read(spark, d, "customer").select(F.col("c_nationkey").alias("id"), F.lit("customer").alias("kind"))
    return a.unionByName(b).distinct().agg(F.count("*").alias("n"), F.countDistinct("id").alias("ids"))
