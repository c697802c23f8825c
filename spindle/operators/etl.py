"""From records to triples and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def slug(text: Column | str, default: str = "resource") -> Column:
    """Letters and digits of any script, lower case, joined by single underscores; ``default`` where none is left."""
    cut = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", "_")
    return F.coalesce(F.nullif(F.regexp_replace(cut, "^_+|_+$", ""), F.lit("")), F.lit(default))


# The printable characters that RFC 3987 keeps out of IRIs (section 2.2), and the brackets, which only stand around IP addresses.
NOT_IN_IRIS = "<>\"{}|\\^`[]"


def clean_iri(text: Column | str) -> Column:
    """An http(s) IRI with a host, up to the first white space or character that IRIs cannot hold; null otherwise."""
    barred = "".join("\\" + c for c in NOT_IN_IRIS)
    return F.nullif(F.regexp_extract(F.trim(text), f"^https?://[^/?#\\s{barred}][^\\s{barred}]*", 0), F.lit(""))


def literal_type(text: Column | str) -> Column:
    """dateTime, date, boolean, integer, double or string, by the look of a literal."""
    t = F.col(text) if isinstance(text, str) else text
    moment = t.contains("T") & t.contains(":") & F.try_to_timestamp(F.regexp_replace(t, "Z$", "+00:00")).isNotNull()
    return (
        F.when(t.isin("true", "false"), "boolean")
        .when(t.rlike("^[+-]?[0-9]+$"), "integer")
        .when(t.rlike(r"^[+-]?([0-9]+\.[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), "double")
        .when(t.rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & F.try_to_date(t, "yyyy-MM-dd").isNotNull(), "date")
        .when(moment, "dateTime")
        .otherwise("string")
    )


def curie_to_iri(curie: Column | str, prefixes: dict[str, str]) -> Column:
    """``PREFIX:local`` or ``PREFIX_local`` as an IRI of the prefix; IRIs stay; unknown prefixes give null."""
    c = F.col(curie) if isinstance(curie, str) else curie
    out = F.when(c.rlike("^https?://"), c)
    for prefix, base in prefixes.items():
        out = out.when(c.rlike(f"^{prefix}[:_]"), F.concat(F.lit(base), F.regexp_replace(c, f"^{prefix}[:_]", "")))
    return out


def reified(rows: DataFrame, subject: str, obj: str, metrics: list[str]) -> DataFrame:
    """``s, p, o``: a node for each association with its ends and metrics; its id is a hash of all of them.

    Associations are made distinct before they become facts, as facts are several times as many and each as long.
    """
    rows = rows.select(subject, obj, *metrics).distinct()
    node = F.substring(F.md5(F.to_json(F.struct(subject, obj, *metrics)).cast("binary")), 1, 16)
    facts = [("subject", F.col(subject).cast("string")), ("object", F.col(obj).cast("string")), *((m, F.col(m).cast("string")) for m in metrics)]
    cells = F.array(*(F.struct(F.lit(p).alias("p"), o.alias("o")) for p, o in facts))
    return rows.select(node.alias("s"), F.inline(cells)).where("o is not null")


def n_triples(triples: DataFrame) -> DataFrame:
    """``line``: each distinct triple (s, p, o, iri) in N-Triples, with the escapes that literals need."""
    text = F.col("o")
    for raw, escaped in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    obj = F.when(F.col("iri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.concat(F.lit('"'), text, F.lit('"')))
    return triples.select("s", "p", "o", "iri").distinct().select(F.concat(F.lit("<"), "s", F.lit("> <"), "p", F.lit("> "), obj, F.lit(" .")).alias("line"))


def parse_n_triples(lines: DataFrame, column: str = "line") -> DataFrame:
    """``s, p, o, iri`` of N-Triples lines; blank lines, comments and lines of another form go."""
    # a quote inside a literal is escaped, so the last one closes it
    pattern = r'(?s)^<([^>]*)> <([^>]*)> (?:<([^>]*)>|"(.*)"(?:@[A-Za-z0-9-]+|\^\^<[^>]*>)?) \.\s*$'
    t = F.trim(column)
    part = lambda i: F.regexp_extract(t, pattern, i)
    iri = F.regexp_extract(t, r"^<[^>]*> <[^>]*> (<)", 1) == "<"
    text = part(4)
    # a mark that text cannot hold keeps escaped backslashes apart while the others are undone
    for escaped, raw in (("\\\\", "\x00"), ('\\"', '"'), ("\\n", "\n"), ("\\r", "\r"), ("\\t", "\t"), ("\x00", "\\")):
        text = F.replace(text, F.lit(escaped), F.lit(raw))
    rows = lines.where(t.rlike(pattern))
    return rows.select(part(1).alias("s"), part(2).alias("p"), F.when(iri, part(3)).otherwise(text).alias("o"), iri.alias("iri"))


def turtle_blocks(triples: DataFrame) -> DataFrame:
    """``s, block``: all predicates of a subject as one Turtle block, predicates and objects sorted."""
    obj = F.when(F.col("iri"), F.concat(F.lit("<"), "o", F.lit(">"))).otherwise(F.to_json(F.struct(F.col("o").alias("v"))).substr(F.lit(6), F.length(F.to_json(F.struct(F.col("o").alias("v")))) - 6))
    one = triples.select("s", F.concat(F.lit("<"), "p", F.lit("> "), obj).alias("po")).distinct()
    return one.groupBy("s").agg(F.concat(F.lit("<"), F.first("s"), F.lit("> "), F.array_join(F.sort_array(F.collect_list("po")), " ; "), F.lit(" .")).alias("block"))
