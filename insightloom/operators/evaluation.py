"""Evaluation of graph embeddings: membership, neighbours, link ranks, bias."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numeric import DISTANCES
from . import rules
from .storage import materialise

# Thresholds of the three bias types, dominance share.
BIAS_THRESHOLDS = (0.75, 0.5, 1.0)
DOMINANCE = 0.5

# ------------------------------------------------------------ subgraph embeddings


def subgraph_embedding(edges: DataFrame, members: DataFrame, emb: DataFrame, distance: str | Callable[[Column, Column], Column] = "jaccard", use_head: bool = False, normalise: str | None = "nodes") -> DataFrame:
    """(q, vec): sum over a quality's induced edges of distance(head, tail) *
    tail [+ the quality's own vector], divided by the number of nodes (less one
    without head), or scaled to length one, or left as it is.

    edges(q, src, dst), members(q, v), emb(name, vec).
    """
    dist = DISTANCES[distance] if isinstance(distance, str) else distance
    h, t = emb.toDF("src", "hv"), emb.toDF("dst", "tv")
    part = edges.join(h, "src").join(t, "dst").select("q", dist("hv", "tv").alias("d"), "tv").select("q", F.transform("tv", lambda x: x * F.col("d")).alias("vec"))
    if use_head:
        part = part.unionByName(emb.select(F.col("name").alias("q"), "vec").join(members.select("q").distinct(), "q"))
    each = part.select("q", F.posexplode("vec").alias("i", "x")).groupBy("q", "i").agg(F.sum("x").alias("x"))
    vec = each.groupBy("q").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).select("q", F.transform("v", lambda e: e["x"]).alias("vec"))
    if normalise == "nodes":
        n = members.groupBy("q").agg((F.countDistinct("v") - (0 if use_head else 1)).alias("n"))
        return vec.join(n, "q").select("q", F.transform("vec", lambda x: F.try_divide(x, F.col("n"))).alias("vec"))
    if normalise == "unit":
        size = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
        return vec.withColumn("s", size).select("q", F.transform("vec", lambda x: F.try_divide(x, F.col("s"))).alias("vec"))
    return vec


def membership(qualities: DataFrame, parameters: DataFrame, hit: DataFrame) -> DataFrame:
    """(q, parameter, member): the full 0/1 matrix.  The vertex lists are the
    graph's, not the data's; their product is the matrix asked for."""
    return qualities.select("q").crossJoin(parameters.select("parameter")).join(hit.withColumn("member", F.lit(1)), ["q", "parameter"], "left").select("q", "parameter", F.coalesce("member", F.lit(0)).alias("member"))


def equal_memberships(hit: DataFrame, qualities: DataFrame, n_parameters: Column | int) -> DataFrame:
    """(a, b, shared): parameters on which two qualities agree, both in or both
    out: n - |A| - |B| + 2 |A and B|, so only parameters hit are joined."""
    size = qualities.select("q").join(hit.groupBy("q").agg(F.countDistinct("parameter").alias("n")), "q", "left").na.fill(0, ["n"])
    both = hit.toDF(*("a" if c == "q" else c for c in hit.columns)).join(hit.toDF(*("b" if c == "q" else c for c in hit.columns)), "parameter").where("a <> b").groupBy("a", "b").agg(F.count("*").alias("c"))
    pairs = size.toDF("a", "na").join(size.toDF("b", "nb"), F.col("a") != F.col("b"))  # the pairs of vertices asked for
    n = F.lit(n_parameters) if isinstance(n_parameters, int) else n_parameters
    return pairs.join(both, ["a", "b"], "left").select("a", "b", (n - F.col("na") - F.col("nb") + 2 * F.coalesce("c", F.lit(0))).alias("shared"))


def vector_distances(vectors: DataFrame, distance: str = "euclidean") -> DataFrame:
    """(a, b, distance) of all pairs of a set of subgraph vectors."""
    l, r = vectors.toDF("a", "va"), vectors.toDF("b", "vb")
    return l.join(r, F.col("a") != F.col("b")).select("a", "b", DISTANCES[distance]("va", "vb").alias("distance"))


def top_k(pairs: DataFrame, score: str, k: int, descending: bool = False) -> DataFrame:
    """(a, neighbours): the k best b of each a, best first, ties by name."""
    order = F.col(score).desc() if descending else F.col(score).asc()
    w = Window.partitionBy("a").orderBy(order, "b")
    return pairs.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).groupBy("a").agg(F.array_sort(F.collect_list(F.struct("r", "b"))).alias("n")).select("a", F.transform("n", lambda e: e["b"]).alias("neighbours"))


def common_neighbours(a: DataFrame, b: DataFrame) -> DataFrame:
    """(a, unordered, ordered): shared neighbours, and those at equal places."""
    j = a.toDF("a", "x").join(b.toDF("a", "y"), "a")
    same = F.aggregate(F.zip_with("x", "y", lambda p, q: F.coalesce((p == q).cast("int"), F.lit(0))), F.lit(0), lambda s, v: s + v)
    return j.select("a", F.size(F.array_intersect("x", "y")).alias("unordered"), same.alias("ordered"))


def matches_at_k(shared: DataFrame, distances: DataFrame, k: int, leave_out: tuple = ("overall_ok",)) -> DataFrame:
    """One row: mean and sample deviation over qualities of the overlap of the k
    nearest by shared parameters and the k nearest by vector."""
    keep = ~F.col("a").isin(*leave_out) & ~F.col("b").isin(*leave_out)
    m = common_neighbours(top_k(shared.where(keep), "shared", k, True), top_k(distances.where(keep), "distance", k))
    return m.agg(F.lit(k).alias("k"), F.avg("unordered").alias("matches_mean"), F.stddev("unordered").alias("matches_std"))


# ------------------------------------------------------------ link prediction


def link_ranks(test: DataFrame, known: DataFrame, entities: DataFrame, score: Callable[[DataFrame], DataFrame], side: str = "tail") -> DataFrame:
    """(h, r, t, side, rank, candidates): realistic rank of each test triple
    among all entities in the open place, known triples left out.

    ``score`` adds a column ``score`` to a table of triples.  Test triples are
    the stated queries; each meets every entity once.  The product of queries
    and entities is counted as it is; what the known triples among it add to
    the counts is taken off again, so it is never joined with them.
    """
    fixed, open_ = (["h", "r"], "t") if side == "tail" else (["r", "t"], "h")
    ents = entities.select(F.col("e").alias(open_)).distinct()
    queries = test.select("h", "r", "t").distinct().join(ents, open_, "left_semi").select("h", "r", "t")
    truth = score(queries).select("h", "r", "t", F.col("score").alias("truth"))

    def counts(rivals: DataFrame, tag: str) -> DataFrame:
        other = score(rivals).select(*fixed, F.col(open_).alias("rival"), F.col("score").alias("other"))
        j = truth.join(other, fixed).where(F.col("rival") != F.col(open_))
        return j.groupBy("h", "r", "t").agg(F.count_if(F.col("other") > F.col("truth")).alias(f"better{tag}"), F.count_if(F.col("other") == F.col("truth")).alias(f"equal{tag}"), F.count("other").alias(f"n{tag}"))

    places = queries.select(*fixed).distinct()
    every = counts(places.crossJoin(ents).select("h", "r", "t"), "")
    held = known.select("h", "r", "t").union(queries).distinct().join(places, fixed, "left_semi").join(ents, open_, "left_semi").select("h", "r", "t")
    out = truth.join(every, ["h", "r", "t"], "left").join(counts(held, "_k"), ["h", "r", "t"], "left").na.fill(0, ["better", "equal", "n", "better_k", "equal_k", "n_k"])
    rank = F.col("better") - F.col("better_k") + 1 + (F.col("equal") - F.col("equal_k")) / 2
    return out.select("h", "r", "t", rank.alias("rank"), (F.col("n") - F.col("n_k") + 1).alias("candidates"), F.lit(side).alias("side"))


def _sides(method: str, side: str):
    """How a method scores candidates in the open place: from the vectors of
    the fixed place and the relation a vector q, and whether the score is q . e
    or -|q - e|."""

    def halves(x):
        k = x.shape[1] // 2
        return x[:, :k], x[:, k:]

    def translated(fixed, rel):
        return fixed + rel if side == "tail" else fixed - rel

    def complex_(fixed, rel):
        (a, b), (c, d) = halves(fixed), halves(rel)
        if side == "tail":
            return np.hstack([a * c - b * d, b * c + a * d])
        return np.hstack([a * c + b * d, b * c - a * d])

    def turned(fixed, rel):
        a, b = halves(fixed)
        c, s = np.cos(rel), np.sin(rel) * (1 if side == "tail" else -1)
        return np.hstack([a * c - b * s, a * s + b * c])

    return {"TransE": (translated, False), "DistMult": (lambda f, r: f * r, True), "ComplEx": (complex_, True), "RotatE": (turned, False)}[method]


def _scores_of(q: np.ndarray, e: np.ndarray, product: bool) -> np.ndarray:
    """Scores of every q (lines) with every e: added up dimension by dimension,
    so that equal vectors have equal scores in blocks of any size."""
    out = np.zeros((len(q), len(e)))
    for k in range(q.shape[1]):
        out += q[:, k, None] * e[None, :, k] if product else -np.square(q[:, k, None] - e[None, :, k])
    return out


def _beaten(q: np.ndarray, e: np.ndarray, truth: np.ndarray, product: bool, most: int = 1 << 16) -> tuple[np.ndarray, np.ndarray]:
    """(better, equal): how many e score above, and like, the truth of each q.

    One matrix product decides all but those that its rounding can't tell from
    the truth; these are added up as in ``_scores_of``, so the counts are those
    of its scores."""
    with np.errstate(invalid="ignore", over="ignore"):
        dot, nq, ne = q @ e.T, np.square(q).sum(axis=1), np.square(e).sum(axis=1)
        s = dot if product else 2 * dot - nq[:, None] - ne[None, :]
        size = np.sqrt(nq)[:, None] * np.sqrt(ne)[None, :] if product else 2 * (nq[:, None] + ne[None, :])
        slack = 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * size
        s -= truth[:, None]
        above = s > slack
        i, j = np.nonzero(~(above | (s < -slack)))
    better, equal = above.sum(axis=1), np.zeros(len(q), dtype=np.int64)
    for at in range(0, len(i), most):
        x, y = i[at : at + most], j[at : at + most]
        exact = np.zeros(len(x))
        for k in range(q.shape[1]):
            exact += q[x, k] * e[y, k] if product else -np.square(q[x, k] - e[y, k])
        better += np.bincount(x[exact > truth[x]], minlength=len(q))
        equal += np.bincount(x[exact == truth[x]], minlength=len(q))
    return better, equal


def _vector_blocks(df: DataFrame, key: str, size: int, parts: int) -> DataFrame:
    """(part, names, blob): vectors of df (key, vec) in blocks of at most ``size``."""

    def run(batches):
        for b in batches:
            for i in range(0, b.num_rows, size):
                c = b.slice(i, size)
                yield pa.RecordBatch.from_arrays([pa.array([c.column(key).to_pylist()], pa.list_(pa.string())), pa.array([np.array(c.column("vec").to_pylist(), dtype=np.float64).tobytes()], pa.binary())], names=["names", "blob"])

    blocks = df.select(F.col(key).cast("string").alias(key), F.col("vec").cast("array<double>").alias("vec")).repartition(parts).mapInArrow(run, "names array<string>, blob binary")
    return blocks.withColumn("part", F.pmod(F.hash("blob"), F.lit(parts)))


def link_ranks_by_vectors(test: DataFrame, known: DataFrame, entities: DataFrame, relations: DataFrame, method: str = "TransE", sides: tuple = ("tail", "head"), block: int = 512) -> DataFrame:
    """(h, r, t, side, rank, candidates): realistic rank of each test triple
    among all entities in the open place, known triples left out.

    Test triples, the stated queries, travel in packs to blocks of entity
    vectors; a pair of pack and block leaves three counts a query behind (better,
    equal, all), never a row a candidate.  What known triples add to the counts
    is scored by itself and taken off.  entities(e, vec), relations(r, vec);
    triples whose entity or relation has no vector are no queries.  Null vectors
    and nulls in triples count as missing."""
    ents = entities.where("e is not null and vec is not null").dropDuplicates(["e"])
    rels = relations.where("r is not null and vec is not null").dropDuplicates(["r"])
    parts = int(test.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    blocks = _vector_blocks(ents, "e", block, parts)
    out = None
    for side in sides:
        fixed, open_ = ("h", "t") if side == "tail" else ("t", "h")
        q = test.select("h", "r", "t").distinct().join(ents.select(F.col("e").alias("h"), F.col("vec").alias("hv")), "h").join(ents.select(F.col("e").alias("t"), F.col("vec").alias("tv")), "t").join(rels.withColumnRenamed("vec", "rv"), "r")
        packed = q.select("h", "r", "t", *(F.col(c).cast("array<double>").alias(c) for c in ("hv", "rv", "tv"))).mapInArrow(_pack_queries(method, side, block), "names array<struct<h:string,r:string,t:string>>, truth binary, q binary")
        sent = packed.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
        each = sent.join(blocks.select("part", F.col("names").alias("e_names"), "blob"), "part").mapInArrow(_count_ranks(method, side, open_), "h string, r string, t string, truth double, better long, equal long, n long")
        every = each.groupBy("h", "r", "t").agg(F.max("truth").alias("truth"), *(F.sum(c).alias(c) for c in ("better", "equal", "n")))
        others = known.select("h", "r", "t").union(test.select("h", "r", "t")).distinct()
        rival = others.select(F.col(fixed).cast("string").alias(fixed), F.col("r").cast("string").alias("r"), F.col(open_).cast("string").alias("rival"))
        pairs = every.select("h", "r", "t", "truth").join(rival, [fixed, "r"]).where(F.col("rival") != F.col(open_))
        lookup = lambda name, col: ents.select(F.col("e").cast("string").alias(name), F.col("vec").cast("array<double>").alias(col))
        scored = pairs.join(lookup(fixed, "fv"), fixed).join(lookup("rival", "ov"), "rival").join(rels.select(F.col("r").cast("string").alias("r"), F.col("vec").cast("array<double>").alias("rv")), "r").mapInArrow(_score_pairs(method, side), "h string, r string, t string, truth double, score double")
        held = scored.groupBy("h", "r", "t").agg(F.count_if(F.col("score") > F.col("truth")).alias("better_k"), F.count_if(F.col("score") == F.col("truth")).alias("equal_k"), F.count("*").alias("n_k"))
        one = every.join(held, ["h", "r", "t"], "left").na.fill(0, ["better_k", "equal_k", "n_k"])
        rank = F.col("better") - F.col("better_k") + 1 + (F.col("equal") - F.col("equal_k")) / 2
        one = one.select("h", "r", "t", F.lit(side).alias("side"), rank.alias("rank"), (F.col("n") - F.col("n_k") + 1).alias("candidates"))
        out = one if out is None else out.unionByName(one)
    return out


def _rows_of(column) -> np.ndarray:
    return np.array(column.to_pylist(), dtype=np.float64)


def _pack_queries(method: str, side: str, size: int):
    make, product = _sides(method, side)

    def run(batches):
        for whole in batches:
            for i in range(0, whole.num_rows, size):
                b = whole.slice(i, size)
                h, r, t = (_rows_of(b.column(c)) for c in ("hv", "rv", "tv"))
                q = make(h if side == "tail" else t, r)
                answer = t if side == "tail" else h
                truth = np.array([_scores_of(q[j : j + 1], answer[j : j + 1], product)[0, 0] for j in range(len(q))])
                names = [dict(zip(("h", "r", "t"), map(str, x), strict=True)) for x in zip(*(b.column(c).to_pylist() for c in ("h", "r", "t")), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([names], pa.list_(pa.struct([("h", pa.string()), ("r", pa.string()), ("t", pa.string())]))), pa.array([truth.tobytes()], pa.binary()), pa.array([q.tobytes()], pa.binary())], names=["names", "truth", "q"])

    return run


def _count_ranks(method: str, side: str, open_: str, most: int = 128):
    """Counts of packs with blocks, added up per pack; at most ``most`` packs
    wait for more of their blocks."""
    _, product = _sides(method, side)

    def told(held):
        for names, truth, counts in held.values():
            yield pa.RecordBatch.from_arrays([*(pa.array([x[c] for x in names], pa.string()) for c in ("h", "r", "t")), pa.array(truth), *(pa.array(x) for x in counts)], names=["h", "r", "t", "truth", "better", "equal", "n"])

    def run(batches):
        held: dict = {}
        for b in batches:
            for names, truth, q, e_names, blob in zip(*(b.column(c) for c in ("names", "truth", "q", "e_names", "blob")), strict=True):
                names, e_names, truth = names.values, e_names.values, np.frombuffer(truth.as_py())
                q, e = (np.frombuffer(x.as_py()).reshape(n, -1) for x, n in ((q, len(names)), (blob, len(e_names))))
                better, equal = _beaten(q, e, truth, product)
                # the answer itself is no rival
                here = pc.is_in(names.field(open_), value_set=e_names).to_numpy(zero_copy_only=False).astype(np.int64)
                counts = np.stack([better, equal - here, len(e_names) - here])
                key = tuple(names[0].as_py().values())  # a query is in one pack
                if key in held:
                    held[key][2] += counts
                    continue
                if len(held) == most:
                    yield from told(held)
                    held.clear()
                held[key] = [names.to_pylist(), truth, counts]
        yield from told(held)

    return run


def _score_pairs(method: str, side: str):
    make, product = _sides(method, side)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q, o = make(_rows_of(b.column("fv")), _rows_of(b.column("rv"))), _rows_of(b.column("ov"))
            s = np.zeros(len(q))
            for k in range(q.shape[1]):
                s += q[:, k] * o[:, k] if product else -np.square(q[:, k] - o[:, k])
            yield pa.RecordBatch.from_arrays([b.column(c) for c in ("h", "r", "t", "truth")] + [pa.array(s)], names=["h", "r", "t", "truth", "score"])

    return run


def link_metrics(ranks: DataFrame, ks: tuple = (1, 5, 10)) -> DataFrame:
    """(side, amri, hits_at_k ...): adjusted mean rank index and hits."""
    mr, expected = F.avg("rank"), F.avg((F.col("candidates") + 1) / 2)
    return ranks.groupBy("side").agg((1 - F.try_divide(mr - 1, expected - 1)).alias("amri"), *(F.avg((F.col("rank") <= k).cast("double")).alias(f"hits_at_{k}") for k in ks))


def translation_score(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """-|h + r - t|; entities(e, vec), relations(r, vec)."""
    j = triples.join(entities.toDF("h", "hv"), "h").join(relations.toDF("r", "rv"), "r").join(entities.toDF("t", "tv"), "t")
    d = F.zip_with(F.zip_with("hv", "rv", lambda a, b: a + b), "tv", lambda a, b: (a - b) * (a - b))
    return j.select("h", "r", "t", (-F.sqrt(F.aggregate(d, F.lit(0.0), lambda a, x: a + x))).alias("score"))


def product_score(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """sum h * r * t."""
    j = triples.join(entities.toDF("h", "hv"), "h").join(relations.toDF("r", "rv"), "r").join(entities.toDF("t", "tv"), "t")
    d = F.zip_with(F.zip_with("hv", "rv", lambda a, b: a * b), "tv", lambda a, b: a * b)
    return j.select("h", "r", "t", F.aggregate(d, F.lit(0.0), lambda a, x: a + x).alias("score"))


def _with_vectors(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    return triples.join(entities.toDF("h", "hv"), "h").join(relations.toDF("r", "rv"), "r").join(entities.toDF("t", "tv"), "t")


def _sum_over(n: Column, term: Callable[[Column], Column]) -> Column:
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0.0), lambda a, i: a + term(i))


def complex_score(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """Real part of sum h * r * conj(t); vectors hold real, then imaginary parts."""
    k = (F.size("hv") / 2).cast("int")

    def term(i):
        a, b, c, d, e, f = (F.get(v, j) for v in ("hv", "rv", "tv") for j in (i, i + k))
        return a * c * e + b * c * f + a * d * f - b * d * e

    return _with_vectors(triples, entities, relations).select("h", "r", "t", _sum_over(k, term).alias("score"))


def rotation_score(triples: DataFrame, entities: DataFrame, relations: DataFrame) -> DataFrame:
    """-|h turned by r - t|; relations hold angles."""
    k = F.size("rv")

    def term(i):
        a, b, e, f = (F.get(v, j) for v in ("hv", "tv") for j in (i, i + k))
        c, s = F.cos(F.get("rv", i)), F.sin(F.get("rv", i))
        return F.pow(a * c - b * s - e, 2) + F.pow(a * s + b * c - f, 2)

    return _with_vectors(triples, entities, relations).select("h", "r", "t", (-F.sqrt(_sum_over(k, term))).alias("score"))


SCORES = {"TransE": translation_score, "DistMult": product_score, "ComplEx": complex_score, "RotatE": rotation_score}


def link_prediction(trained: DataFrame, method: str, train: DataFrame, test: DataFrame) -> DataFrame:
    """(side, amri, hits_at_k ...) of test triples by the vectors of ``trained``
    (role, name, vec), for open tails and open heads."""
    vectors = {role: trained.where(F.col("role") == role).select("name", "vec") for role in ("entity", "relation")}
    known = train.select("h", "r", "t").union(test.select("h", "r", "t")).distinct()
    return link_metrics(link_ranks_by_vectors(test, known, vectors["entity"].toDF("e", "vec"), vectors["relation"].toDF("r", "vec"), method))


# ------------------------------------------------------------ bias of a split


def bias_type1(train: DataFrame, test: DataFrame) -> DataFrame:
    """(h, r, t, head_bias, tail_bias): share of the relation's training triples
    with the same head, and with the same tail; NULL for unseen relations."""
    n = train.groupBy("r").agg(F.count("*").alias("n"))
    nh, nt = train.groupBy("r", "h").agg(F.count("*").alias("nh")), train.groupBy("r", "t").agg(F.count("*").alias("nt"))
    j = test.select("h", "r", "t").join(n, "r", "left").join(nh, ["r", "h"], "left").join(nt, ["r", "t"], "left")
    share = lambda c: F.when(F.col("n").isNotNull(), F.coalesce(F.col(c), F.lit(0)) / F.col("n"))
    return j.select("h", "r", "t", share("nh").alias("head_bias"), share("nt").alias("tail_bias"))


def multiplicities(triples: DataFrame) -> DataFrame:
    """(r, m_tail, m_head): most tails of a head, most heads of a tail."""
    tails = triples.groupBy("r", "h").agg(F.countDistinct("t").alias("n")).groupBy("r").agg(F.max("n").alias("m_tail"))
    heads = triples.groupBy("r", "t").agg(F.countDistinct("h").alias("n")).groupBy("r").agg(F.max("n").alias("m_head"))
    return tails.join(heads, "r")


def bias_type2(train: DataFrame, test: DataFrame) -> DataFrame:
    """(h, r, t, head_bias, tail_bias): share of the relation's tails linked to
    the head (heads linked to the tail) in training, where a head has several
    tails (a tail several heads) in all data; 0 where it doesn't."""
    cols = ("h", "r", "t")
    m = multiplicities(train.select(*cols).union(test.select(*cols)))
    of_h, of_t = train.groupBy("r", "h").agg(F.countDistinct("t").alias("a")), train.groupBy("r", "t").agg(F.countDistinct("h").alias("b"))
    of_r = train.groupBy("r").agg(F.countDistinct("t").alias("nt"), F.countDistinct("h").alias("nh"))
    j = test.select(*cols).join(m, "r").join(of_r, "r", "left").join(of_h, ["r", "h"], "left").join(of_t, ["r", "t"], "left")
    share = lambda part, whole, many: F.when(F.col(whole).isNull(), None).when(F.col(many) > 1, F.coalesce(F.col(part), F.lit(0)) / F.col(whole)).otherwise(0.0)
    return j.select(*cols, share("a", "nt", "m_tail").alias("head_bias"), share("b", "nh", "m_head").alias("tail_bias"))


def dominating(train: DataFrame) -> DataFrame:
    """(r, s): relations s whose pairs are mostly pairs of r as well."""
    pairs = train.select("r", "h", "t").distinct()
    size = pairs.groupBy(F.col("r").alias("s")).agg(F.count("*").alias("n"))
    both = pairs.join(pairs.withColumnRenamed("r", "s"), ["h", "t"]).where("r <> s").groupBy("r", "s").agg(F.count("*").alias("c"))
    return both.join(size, "s").where(F.col("c") / F.col("n") > DOMINANCE).select("r", "s")


def bias_type3(train: DataFrame, test: DataFrame) -> DataFrame:
    """(h, r, t, bias): 1 if a dominating relation holds for the pair in
    training, else 0; NULL for unseen relations."""
    pairs = train.select(F.col("r").alias("s"), "h", "t").distinct()
    hit = test.select("h", "r", "t").distinct().join(dominating(train), "r").join(pairs, ["s", "h", "t"], "left_semi").select("h", "r", "t").distinct().withColumn("x", F.lit(1))
    seen = train.select("r").distinct().withColumn("seen", F.lit(True))
    return test.select("h", "r", "t").join(hit, ["h", "r", "t"], "left").join(seen, "r", "left").select("h", "r", "t", F.when(F.col("seen"), F.coalesce("x", F.lit(0))).alias("bias"))


def keep_unbiased(biases: list[str], thresholds: tuple = BIAS_THRESHOLDS) -> Column:
    """Whether a triple stays: the first missing bias keeps it, else each must
    be below its threshold, in the given order."""
    out = F.lit(True)
    for b, t in reversed(list(zip(biases, thresholds, strict=False))):
        out = F.when(F.col(b).isNull(), True).when(F.col(b) >= t, False).otherwise(out)
    return out


def bias_counts(facts: DataFrame, thresholds: tuple = BIAS_THRESHOLDS) -> DataFrame:
    """(kg_type, train, test, <kind>_<side> ...): how many distinct test triples
    of each encoding stay without those of a bias kind (b1, b2, b3) and without
    any (all).  facts(kg_type, h, r, t, split).

    All encodings go through each analysis at once: names carry their encoding,
    so nothing of one meets another."""
    tag = lambda c: F.concat(F.col("kg_type"), F.lit("|"), F.col(c)).alias(c)
    d = materialise(facts.select("kg_type", "h", "r", "t", "split").where("h is not null and r is not null and t is not null").distinct(), "facts")
    named = d.select(tag("h"), tag("r"), tag("t"), "split")
    train, test = named.where("split = 'train'").drop("split"), named.where("split = 'test'").drop("split")
    b = [bias_type1(train, test).toDF("h", "r", "t", "b1_head", "b1_tail"), bias_type2(train, test).toDF("h", "r", "t", "b2_head", "b2_tail"), bias_type3(train, test).select("h", "r", "t", F.col("bias").alias("b3_head"), F.col("bias").alias("b3_tail"))]
    each = b[0].join(b[1], ["h", "r", "t"]).join(b[2], ["h", "r", "t"]).withColumn("kg_type", F.substring_index("r", "|", 1))
    kept = {f"{k}_{side}": keep_unbiased([f"{n}_{side}" for n in kinds], limits) for k, kinds, limits in (("b1", ["b1"], thresholds[:1]), ("b2", ["b2"], thresholds[1:2]), ("b3", ["b3"], thresholds[2:]), ("all", ["b1", "b2", "b3"], thresholds)) for side in ("head", "tail")}
    sizes = d.groupBy("kg_type").agg(F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))
    return sizes.join(each.groupBy("kg_type").agg(*(F.count_if(c).alias(n) for n, c in kept.items())), "kg_type", "left").na.fill(0, list(kept))


def count_text(kept, whole) -> Column:
    """A count with the share that went, like "90 (-0.1%)"."""
    change = F.round(1 - F.col(kept) / F.col(whole), 2) * -1
    return F.when(F.col(whole) > 0, F.concat(F.col(kept).cast("string"), F.lit(" ("), (change + 0.0).cast("string"), F.lit("%)")))


# ------------------------------------------------------------ result tables

#: Encodings that the tables of matches leave out.
WITHOUT_MATCHES = ("quantified_conditions_with_literal", "quantified_conditions_with_shortcut", "quantified_conditions_without_shortcut")


def matches_table(results: DataFrame, k: int, methods: list[str], with_std: bool = True) -> DataFrame:
    """The table of one k: a row for each encoding, use of the head and
    distance, a column for each method; means over iterations to two places,
    with their sample deviation.  results(kg_type, use_head, distance, method,
    k, iteration, value); missing values don't count."""
    rows = ["kg_type", "use_head", "distance"]
    d = results.where((F.col("k") == k) & F.col("value").isNotNull() & ~F.isnan("value") & ~F.col("kg_type").isin(*WITHOUT_MATCHES))
    g = d.groupBy(*rows, "method").agg(F.avg("value").alias("m"), F.stddev("value").alias("s"))
    text = F.format_string("%.2f ± %.2f", "m", F.coalesce("s", F.lit(0.0))) if with_std else F.format_string("%.2f", "m")
    return g.select(*rows, "method", text.alias("text")).groupBy(*rows).pivot("method", methods).agg(F.first("text"))


def link_table(results: DataFrame, side: str, metrics: list[str]) -> DataFrame:
    """Link prediction of one side: a row for each encoding and method, a column
    for each metric, means over iterations.  results(kg_type, method, side,
    metric, iteration, value)."""
    d = results.where((F.col("side") == side) & F.col("value").isNotNull() & ~F.isnan("value"))
    return d.groupBy("kg_type", "method").pivot("metric", metrics).agg(F.avg("value"))


def rule_table(sets: dict[str, DataFrame], truth: DataFrame, levels: tuple = ("high", "mid", "low")) -> DataFrame:
    """Metrics of several extraction methods against one set of rules, a row for
    each method and level."""
    out = None
    for name, pred in sets.items():
        for level in levels:
            one = rules.evaluate(truth, pred, level).select(F.lit(name).alias("extraction"), F.lit(level).alias("level"), "*")
            out = one if out is None else out.unionByName(one)
    return out


def over_iterations(metrics: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation and ``m±s`` text over iterations."""
    g = metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), F.stddev(value).alias("std"))
    return g.withColumn("text", F.format_string("%.2f±%.2f", "mean", F.coalesce("std", F.lit(0.0))))


def result_table(metrics: DataFrame, rows: list[str], column: str, names: list[str] | None = None, value: str = "value") -> DataFrame:
    p = metrics.groupBy(*rows).pivot(column, names) if names else metrics.groupBy(*rows).pivot(column)
    return p.agg(F.first(value))


def mask_literal_mismatch(metrics: DataFrame, literal_methods: list[str], value: str = "value") -> DataFrame:
    """NULL where a literal encoding meets a method that reads no literals."""
    bad = F.col("kg_type").contains("literal") & ~F.col("method").isin(*literal_methods)
    return metrics.withColumn(value, F.when(~bad, F.col(value)))
