"""Graph encodings of parameter-quality relations, and their triples.

relations: parameter, quality, mean, bins ARRAY<STRUCT<lo, hi, value>>, action.
Edges come out as (src, rel, dst, literal_included), vertices as (name, type,
literal_value, corresponding_parameter).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import PqFunction, let
from .storage import sample_of

# Edge labels, vertex kinds and encoding names.
IMPLIES, QUANTIFIED_BY, IMPLIED_PARAMETER, STARTS_AT, ENDS_AT = "implies", "quantified by", "implied parameter", "starts at", "ends at"
QUALITY, PARAMETER, VALUE, CONDITION, CONCLUSION, RELATION, PART = "qual_influence", "parameter", "value", "quantified_condition", "quantified_conclusion", "pq-relation", "my-ny-relation"
ENCODINGS = (
    "basic", "unquantified", "quantified_parameters_without_shortcut", "quantified_parameters_with_shortcut", "quantified_parameters_with_literal", "quantified_parameters_w3", "quantified_parameters_w3_with_literal",
    "quantified_conditions_without_shortcut", "quantified_conditions_with_shortcut", "quantified_conditions_with_literal", "quantified_conditions_w3", "quantified_conditions_w3_with_literal",
)


@dataclass(frozen=True)
class Encoding:
    name: str

    def __post_init__(self):
        if self.name not in ENCODINGS:
            raise ValueError(f"unknown encoding {self.name}")

    @property
    def shortcut(self) -> bool:
        return self.name.endswith(("with_shortcut", "with_literal")) and "w3" not in self.name

    @property
    def conditions(self) -> bool:
        return self.name.startswith("quantified_conditions")

    @property
    def ternary(self) -> bool:
        return "w3" in self.name


def action_label(action) -> Column:
    """Relation label of a rule's action; anything not directed implies."""
    a = F.col(action)
    return F.when(a.isin("increase incrementally", "decrease incrementally"), a).otherwise(F.lit(IMPLIES))


def _number(c: Column) -> Column:
    return F.round(c, 6).cast("string")


def _edge(src: Column, rel, dst: Column, literal: str = "None") -> Column:
    return F.struct(src.alias("src"), (F.lit(rel) if isinstance(rel, str) else rel).alias("rel"), dst.alias("dst"), F.lit(literal).alias("literal_included"))


def _vertex(name: Column, kind: str, literal: Column | None = None, parameter: Column | None = None) -> Column:
    null = F.lit(None).cast("string")
    return F.struct(name.alias("name"), F.lit(kind).alias("type"), (null if literal is None else literal).alias("literal_value"), (null if parameter is None else parameter).alias("corresponding_parameter"))


def _parts(e: Encoding) -> tuple[list[Column], list[Column], list[Column], list[Column]]:
    """(edges, vertices) of a relation and (edges, vertices) of each of its bins
    (column b, position i)."""
    q, p, m = F.col("quality"), F.col("parameter"), _number(F.col("mean"))
    rel = F.concat_ws("-", p, q, F.lit("relation"))
    vertices = [_vertex(q, QUALITY), _vertex(p, PARAMETER)]
    if e.name in ("basic", "unquantified"):
        return [_edge(q, m if e.name == "basic" else action_label("action"), p)], vertices, [], []
    if not e.conditions:
        vertices.append(_vertex(m, VALUE, m, None if e.ternary else p))
        if e.ternary:
            return [_edge(q, IMPLIES, rel), _edge(rel, IMPLIED_PARAMETER, p), _edge(rel, QUANTIFIED_BY, m, "To")], [*vertices, _vertex(rel, RELATION)], [], []
        edges = [_edge(q, IMPLIES, m, "To"), _edge(p, QUANTIFIED_BY, m, "To")]
        return edges + [_edge(q, action_label("action"), p)] * e.shortcut, vertices, [], []
    lo, hi = F.least("b.lo", "b.hi"), F.greatest("b.lo", "b.hi")
    tag = F.concat_ws("-", p, q, F.col("i").cast("string"))
    mu, value, start, end = (F.concat(F.lit(f"{x}-"), tag) for x in ("my", "value", "start", "end"))
    each_v = [_vertex(mu, CONDITION), _vertex(value, CONCLUSION, _number(F.col("b.value")), p if e.ternary else None), _vertex(start, VALUE, _number(lo)), _vertex(end, VALUE, _number(hi))]
    if e.ternary:
        both = F.concat(F.lit("my"), F.col("i").cast("string"), F.lit("-ny"), F.col("i").cast("string"), F.lit("-"), tag)
        each = [_edge(rel, QUANTIFIED_BY, both), _edge(both, STARTS_AT, start, "To"), _edge(both, ENDS_AT, end, "To"), _edge(both, QUANTIFIED_BY, value, "To")]
        return [_edge(q, IMPLIES, rel), _edge(rel, IMPLIED_PARAMETER, p)], [*vertices, _vertex(rel, RELATION)], each, [*each_v, _vertex(both, PART)]
    each = [_edge(mu, IMPLIES, value, "To"), _edge(p, QUANTIFIED_BY, value, "To"), _edge(mu, STARTS_AT, start, "To"), _edge(mu, ENDS_AT, end, "To"), _edge(q, QUANTIFIED_BY, mu)]
    return [_edge(q, action_label("action"), p)] * e.shortcut, vertices, each, each_v


def _rows(relations: DataFrame, whole: list[Column], each: list[Column]) -> DataFrame:
    out = None
    if whole:
        out = relations.select(F.explode(F.array(*whole)).alias("x")).select("x.*")
    if each:
        bins = relations.select("*", F.posexplode("bins").alias("i", "b"))
        if "first" in relations.columns:  # several relations of one parameter and quality
            bins = bins.withColumn("i", F.col("i") + F.col("first"))
        bins = bins.select(F.explode(F.array(*each)).alias("x")).select("x.*")
        out = bins if out is None else out.unionByName(bins)
    return out


def encode(relations: DataFrame, name: str, share: float = 1.0, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(vertices, edges) of an encoding.  ``share`` below 1 keeps that part of
    the relations, chosen by a seeded hash."""
    e = Encoding(name)
    if share < 1.0:
        relations = sample_relations(relations, share, seed)
    we, wv, be, bv = _parts(e)
    return _rows(relations, wv, bv).distinct(), _rows(relations, we, be)


def sample_relations(relations: DataFrame, share: float, seed: int = 0) -> DataFrame:
    """int(n * share) relations, those that come first in seeded hash order."""
    return sample_of(relations, int(relations.count() * share), ["parameter", "quality"], seed)


def triples(vertices: DataFrame, edges: DataFrame, literals: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(entity triples h, r, t; literal triples h, r, value).

    ``literals`` None: every edge by names.  ``To``: edges marked To carry the
    target's literal value; ``From``: edges marked From the target's as well,
    keyed by the source's name.
    """
    empty = edges.select(F.col("src").alias("h"), F.col("rel").alias("r"), F.lit(None).cast("double").alias("value")).limit(0)
    if literals is None:
        return edges.select(F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t")), empty
    entity = edges.where(F.col("literal_included") == "None").select(F.col("src").alias("h"), F.col("rel").alias("r"), F.col("dst").alias("t"))
    value = vertices.select(F.col("name").alias("dst"), F.col("literal_value").try_cast("double").alias("value")).dropDuplicates(["dst"])
    return entity, edges.where(F.col("literal_included") == literals).join(value, "dst", "left").select(F.col("src").alias("h"), F.col("rel").alias("r"), "value")


def split_triples(t: DataFrame, test_share: float = 0.2, seed: int = 0) -> DataFrame:
    """Adds split: by a seeded hash; the first triple of every entity and
    relation stays in training, so that all of them are seen there."""
    key = F.xxhash64(F.lit(seed), "h", "r", "t")
    rows = t.withColumn("k", key)
    first = None
    for c in ("h", "r", "t"):
        one = rows.groupBy(c).agg(F.min("k").alias("k")).select("k")
        first = one if first is None else first.union(one)
    rows = rows.join(first.distinct().withColumn("must", F.lit(True)), "k", "left")
    test = F.col("must").isNull() & (F.pmod("k", F.lit(1_000_000)) < int(test_share * 1_000_000))
    return rows.select("h", "r", "t", F.when(test, "test").otherwise("train").alias("split"))


def relations_from_rules(rules: DataFrame) -> DataFrame:
    """Every rule is a relation with one bin, its condition's range; mean and
    bin hold the rule's mean value.  ``first`` numbers the rules of a parameter
    and quality, in the order of their ranges, so that their bins keep apart."""
    one = F.struct(F.col("cond_lo").alias("lo"), F.col("cond_hi").alias("hi"), F.col("mean_value").alias("value"))
    place = F.row_number().over(Window.partitionBy("parameter", "condition").orderBy("cond_lo", "cond_hi", "action", "mean_value")) - 1
    return rules.select("parameter", F.col("condition").alias("quality"), F.col("mean_value").alias("mean"), F.array(one).alias("bins"), "action", place.alias("first"))


def _mean(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / F.size(xs)


def mean_change(f: PqFunction) -> Column:
    """Mean change of the parameter on the way from the highest rating down to
    the lowest, in unit steps; each step starts from the parameter before it."""
    top, n = f.rating.hi, int(f.rating.hi - f.rating.lo)

    def way(start: Column) -> Column:
        end = F.aggregate(F.sequence(F.lit(1), F.lit(n)), start, lambda last, i: f.inverse(F.lit(float(top)) - i, last))
        return (end - start) / n

    return let(f.inverse(F.lit(float(top))), way)


def sampled_bins(f: PqFunction, n: int = 3) -> Column:
    """Bins of a function: the parameters that its ratings lead to, cut into n
    equal ranges; ``lo`` and ``hi`` are the ratings at a range's ends, ``value``
    the mean parameter of the ratings from one to the other in unit steps."""
    at = F.transform(F.sequence(F.lit(0), F.lit(int(f.rating.hi - f.rating.lo))), lambda i: f.inverse(i + F.lit(float(f.rating.lo))))

    def padded(ends: Column) -> Column:
        half = F.when(ends["low"] == ends["high"], 0.5).otherwise(0.0)
        return F.struct((ends["low"] - half).alias("low"), ((ends["high"] - ends["low"] + 2 * half) / n).alias("width"))

    def mean_between(a: Column, b: Column) -> Column:
        steps = F.sequence(F.lit(0), F.floor(F.abs(b - a)).cast("int"))
        return let(F.transform(steps, lambda k: f.inverse(a + k * F.signum(b - a))), _mean)

    def bins(edge: Column) -> Column:
        ratings = lambda i: F.struct(f(edge["low"] + i * edge["width"]).alias("lo"), f(edge["low"] + (i + 1) * edge["width"]).alias("hi"))
        ends = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), ratings)
        return F.transform(ends, lambda e: F.struct(e["lo"].alias("lo"), e["hi"].alias("hi"), mean_between(e["lo"], e["hi"]).alias("value")))

    ends = let(at, lambda xs: F.struct(F.array_min(xs).alias("low"), F.array_max(xs).alias("high")))
    return let(let(ends, padded), bins)
