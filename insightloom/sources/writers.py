"""Sinks: tables, text formats and result reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx

# Resource base and vocabulary of the triple sink.
BASE = "http://purl.org/pdpk/resource/"
PREFIXES = (("rdf", "http://www.w3.org/1999/02/22-rdf-syntax-ns#"), ("xsd", "http://www.w3.org/2001/XMLSchema#"), ("dcterms", "http://purl.org/dc/terms/"), ("void", "http://rdfs.org/ns/void#"))


def write_documents(docs: DataFrame, path: str, mode: str = "error") -> None:
    docs.select(F.to_json(F.struct("*")).alias("value")).write.mode(mode).text(path)


def write_graph(vertices: DataFrame, edges: DataFrame, path: str, mode: str = "ignore") -> None:
    """Parquet, partitioned by encoding; by default an existing graph stays."""
    vertices.write.mode(mode).partitionBy("kg_type").parquet(f"{path}/vertices")
    edges.write.mode(mode).partitionBy("kg_type").parquet(f"{path}/edges")


def write_embedding_tsv(emb: DataFrame, path: str, names: DataFrame | None = None, mode: str = "error") -> None:
    vec = F.array_join(F.transform("vec", lambda x: x.cast("string")), "\t")
    emb.select(F.concat_ws("\t", F.col("vid").cast("string"), vec).alias("value")).write.mode(mode).text(path)
    if names is not None:
        names.select("vid", "name", "type").write.mode(mode).csv(f"{path}-names", sep="\t")


def embedding_with_iri(emb: DataFrame, names: DataFrame, base: str = BASE) -> DataFrame:
    return emb.join(names.select("vid", "name"), "vid").select(tx.iri(base, "name").alias("iri"), "vec")


def write_embedding_csv(emb: DataFrame, path: str, mode: str = "error") -> None:
    emb.select("iri", F.array_join(F.transform("vec", lambda x: x.cast("string")), " ").alias("vec")).write.mode(mode).csv(path, header=True)


def _iri(name) -> Column:
    return F.concat(F.lit("<"), tx.iri(BASE, name), F.lit(">"))


def statements(triples: DataFrame, literals: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """(s, p, o): the same statements as ``relation_lines``, as terms."""
    out = triples.select(_iri("h").alias("s"), _iri("r").alias("p"), _iri("t").alias("o"))
    if literals is not None:
        out = out.union(literals.select(_iri("h"), _iri("r"), F.concat(F.lit('"'), F.col("value").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#float>'))))
    if vertices is not None:
        out = out.union(vertices.select(_iri("name"), F.lit("<http://www.w3.org/1999/02/22-rdf-syntax-ns#type>"), F.concat(F.lit('"'), F.col("type"), F.lit('"'))))
    return out.distinct()


def nt_lines(triples: DataFrame) -> DataFrame:
    """(value): one ``<h> <r> <t> .`` line a triple."""
    return triples.select(F.concat(_iri("h"), F.lit(" "), _iri("r"), F.lit(" "), _iri("t"), F.lit(" .")).alias("value"))


def relation_lines(triples: DataFrame, literals: DataFrame | None = None, vertices: DataFrame | None = None) -> DataFrame:
    """Distinct statements: entity triples, float literals, vertex types."""
    out = nt_lines(triples)
    if literals is not None:
        out = out.union(literals.select(F.concat(_iri("h"), F.lit(" "), _iri("r"), F.lit(' "'), F.col("value").cast("string"), F.lit('"^^<http://www.w3.org/2001/XMLSchema#float> .')).alias("value")))
    if vertices is not None:
        out = out.union(vertices.select(F.concat(_iri("name"), F.lit(' <http://www.w3.org/1999/02/22-rdf-syntax-ns#type> "'), F.col("type"), F.lit('" .')).alias("value")))
    return out.distinct()


def dataset_description(triples: DataFrame, title: str, licence: str, created: str) -> DataFrame:
    """Lines that describe the data set: triples, entities, title, licence, date."""
    ents = triples.select(F.col("h").alias("e")).union(triples.select("t")).distinct().agg(F.count("*").alias("entities"))
    n = triples.agg(F.count("*").alias("triples")).crossJoin(ents)
    say = lambda p, c: F.concat(F.lit(f"<{BASE}dataset> <{p}> \""), c, F.lit('" .'))
    void, dc = "http://rdfs.org/ns/void#", "http://purl.org/dc/terms/"
    lines = F.array(say(f"{void}triples", F.col("triples").cast("string")), say(f"{void}entities", F.col("entities").cast("string")), say(f"{dc}title", F.lit(title)), say(f"{dc}license", F.lit(licence)), say(f"{dc}created", F.lit(created)))
    return n.select(F.explode(lines).alias("value"))


def write_lines(lines: DataFrame, path: str, one_file: bool = False, mode: str = "error") -> None:
    (lines.coalesce(1) if one_file else lines).write.mode(mode).text(path)


def write_rules(rules: DataFrame, path: str, fmt: str = "text", version: str = "v3", mode: str = "error") -> None:
    """Sorted sentences (text), or a survey sheet with metadata (csv)."""
    sentence = tx.rule_text() if version == "v3" else tx.rule_text_old()
    if fmt == "text":
        rules.select(sentence.alias("value")).where("value is not null").orderBy("value").write.mode(mode).text(path)
    elif fmt == "csv":
        sheet = rules.orderBy("condition", "parameter", "cond_lo").select(sentence.alias("Rule Candidate"), F.lit(None).cast("string").alias("Rule Corrected"))
        sheet.write.mode(mode).csv(f"{path}/survey", header=True)
        rules.agg(F.lit(version).alias("Version"), F.current_date().cast("string").alias("Date"), F.lit("").alias("Additional Data")).write.mode(mode).csv(f"{path}/metadata", header=True)
    else:
        raise ValueError(f"unknown rule format {fmt}")


def write_table(table: DataFrame, path: str, mode: str = "error") -> None:
    """A result table as ``;``-separated text."""
    table.write.mode(mode).csv(path, header=True, sep=";")


def latex_lines(table: DataFrame) -> DataFrame:
    """(value): the body of a LaTeX table, one line a row."""
    return table.select(F.concat(F.concat_ws(" & ", *(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("-")) for c in table.columns)), F.lit(" \\\\")).alias("value"))
