"""Graph embeddings trained with numpy, one group per worker."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TrainSettings:
    """Fixed values of the standard configuration; epochs by method below."""

    dim: int = 46
    test_share: float = 0.2
    lr: float = 4e-4
    weight_decay: float = 1e-5
    negatives: int = 1
    batch: int = 256
    margin: float = 1.0
    seed: int = 0


# Epochs of the standard configuration.
EPOCHS = {"TransE": 400, "ComplEx": 1000, "ComplExLiteral": 650, "RotatE": 700, "DistMult": 800, "DistMultLiteralGated": 200, "BoxE": 1500, "rdf2vec": 1000}
LITERAL = {"DistMultLiteral": "DistMult", "DistMultLiteralGated": "DistMult", "ComplExLiteral": "ComplEx"}
METHODS = ("TransE", "TransH", "TorusE", "DistMult", "ComplEx", "RotatE", "HolE", "SimplE", "Rescal", "TuckER", "BoxE", *LITERAL, "random")
#: Vectors of an entity and of a relation, in dimensions; 1 where not named.
WIDTH = {"ComplEx": (2, 2), "RotatE": (2, 1), "SimplE": (2, 2), "BoxE": (2, 4)}


def _turned(a: np.ndarray, b: np.ndarray, correlate: bool) -> np.ndarray:
    """Circular correlation or convolution of the rows of a and b."""
    x = np.fft.rfft(a, axis=1)
    return np.fft.irfft((np.conj(x) if correlate else x) * np.fft.rfft(b, axis=1), n=a.shape[1], axis=1)


def _box(x: np.ndarray, c: np.ndarray, w: np.ndarray) -> tuple:
    """Distance of points to boxes of width w around c, with the gradients by x
    and w: small inside, steep outside, continuous at the border."""
    off, one = x - c, w + 1
    far, inside = np.abs(off), np.abs(off) <= w / 2
    k = 0.5 * w * (one - 1 / one)
    dk = 0.5 * (one - 1 / one) + 0.5 * w * (1 + 1 / one**2)
    d = np.where(inside, far / one, far * one - k)
    return d, np.sign(off) * np.where(inside, 1 / one, one), np.where(inside, -far / one**2, far - dk)


class Model:
    """Entity and relation matrices with a score and its gradient.  ``extra``
    holds what else a method learns: a matrix with a row for each relation, or
    arrays that all triples share."""

    def __init__(self, method: str, n_ent: int, n_rel: int, s: TrainSettings, literals: np.ndarray | None = None):
        if method not in METHODS:
            raise ValueError(f"unknown method {method}")
        rng = np.random.default_rng(s.seed)
        self.method, self.base, d = method, LITERAL.get(method, method), s.dim
        we, wr = WIDTH.get(self.base, (1, 1))
        bound = 1.0 if method == "random" else 6 / np.sqrt(d)
        self.ent = rng.uniform(-bound, bound, (n_ent, we * d))
        self.rel = rng.uniform(-np.pi, np.pi, (n_rel, d)) if method == "RotatE" else rng.uniform(-bound, bound, (n_rel, d * d if method == "Rescal" else wr * d))
        self.literals = np.zeros((n_ent, 0)) if literals is None else literals
        self.extra: dict = {}
        m = self.literals.shape[1]
        near = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[-1]), shape)
        if method == "TransH":
            self.extra["normal"] = rng.normal(size=(n_rel, d))
        elif method == "TuckER":
            self.extra["core"] = rng.uniform(-1, 1, (d, d, d)) / d
        elif method == "DistMultLiteralGated":
            self.extra = {"gate_e": near(d, d), "gate_l": near(d, max(m, 1))[:, :m], "gate_b": np.zeros(d), "mix": near(d, d + m)}
        elif method in LITERAL:
            self.extra = {f"mix{i}": np.hstack((np.eye(d), near(d, max(m, 1))[:, :m])) for i in range(we)}

    def _with_literals(self, at: np.ndarray) -> tuple:
        """Vectors of entities mixed with their numbers, and what leads a
        gradient back to the vectors and the mixing matrices."""
        e, lit, p = self.ent[at], self.literals[at], self.extra
        d = p["mix"].shape[0] if "mix" in p else p["mix0"].shape[0]
        if "mix" not in p:
            parts = [np.hstack((e[:, i * d : (i + 1) * d], lit)) for i in range(len(p))]

            def back(g):
                gs = [g[:, i * d : (i + 1) * d] for i in range(len(p))]
                return np.hstack([(x @ p[f"mix{i}"])[:, :d] for i, x in enumerate(gs)]), {f"mix{i}": x.T @ parts[i] for i, x in enumerate(gs)}

            return np.hstack([x @ p[f"mix{i}"].T for i, x in enumerate(parts)]), back
        both = np.hstack((e, lit))
        z = 1 / (1 + np.exp(-(e @ p["gate_e"].T + lit @ p["gate_l"].T + p["gate_b"])))
        t = np.tanh(both @ p["mix"].T)

        def back(g):
            gz, gt = g * (t - e) * z * (1 - z), g * z * (1 - t * t)
            return g * (1 - z) + gz @ p["gate_e"] + (gt @ p["mix"])[:, :d], {"gate_e": gz.T @ e, "gate_l": gz.T @ lit, "gate_b": gz.sum(0), "mix": gt.T @ both}

        return z * t + (1 - z) * e, back

    def score(self, h, r, t):
        """Higher is more likely; also the gradients for h, r and t."""
        return self.score_all(h, r, t)[:4]

    def score_all(self, h, r, t, weight: np.ndarray | None = None):
        """``score`` with the gradients of ``extra`` (shared arrays: summed over
        the triples with the weights)."""
        if self.method not in LITERAL:
            return self._score(self.ent[h], self.rel[r], self.ent[t], r, weight)
        (H, back_h), (T, back_t) = self._with_literals(h), self._with_literals(t)
        s, gh, gr, gt, _ = self._score(H, self.rel[r], T, r, weight)
        w = 1.0 if weight is None else weight[:, None]
        extra = {}
        for back, g in ((back_h, gh), (back_t, gt)):
            for k, v in back(g * w)[1].items():
                extra[k] = extra.get(k, 0) + v
        return s, back_h(gh)[0], gr, back_t(gt)[0], extra

    def _score(self, H, R, T, r, weight):
        if self.base in ("TransE", "random"):
            d = H + R - T
            n = np.sqrt((d * d).sum(1) + 1e-12)
            g = -d / n[:, None]
            return -n, g, g, -g, {}
        if self.base == "TorusE":
            d = H + R - T
            d = d - np.round(d)
            return -(d * d).sum(1), -2 * d, -2 * d, 2 * d, {}
        if self.base == "TransH":
            w = self.extra["normal"][r]
            size = np.sqrt((w * w).sum(1, keepdims=True) + 1e-12)
            u, x = w / size, H - T
            along = (u * x).sum(1, keepdims=True)
            d = x - along * u + R
            n = np.sqrt((d * d).sum(1, keepdims=True) + 1e-12)
            g = -d / n
            flat = g - (u * g).sum(1, keepdims=True) * u
            gu = -(along * g + (g * u).sum(1, keepdims=True) * x)
            return -n[:, 0], flat, g, -flat, {"normal": (gu - (gu * u).sum(1, keepdims=True) * u) / size}
        if self.base == "DistMult":
            return (H * R * T).sum(1), R * T, H * T, H * R, {}
        if self.base == "HolE":
            met = _turned(H, T, True)
            return (R * met).sum(1), _turned(R, T, True), met, _turned(R, H, False), {}
        if self.base == "Rescal":
            k = H.shape[1]
            m = R.reshape(-1, k, k)
            to, of = np.einsum("nij,nj->ni", m, T), np.einsum("nij,ni->nj", m, H)
            return (H * to).sum(1), to, (H[:, :, None] * T[:, None, :]).reshape(len(H), -1), of, {}
        if self.base == "TuckER":
            core = self.extra["core"]
            ct = np.einsum("ijk,nk->nij", core, T)
            g_h, g_r = np.einsum("nij,nj->ni", ct, R), np.einsum("nij,ni->nj", ct, H)
            g_t = np.einsum("ijk,ni,nj->nk", core, H, R, optimize=True)
            w = np.ones(len(H)) if weight is None else weight
            return (H * g_h).sum(1), g_h, g_r, g_t, {"core": np.einsum("n,ni,nj,nk->ijk", w, H, R, T, optimize=True)}
        if self.base == "BoxE":
            k = H.shape[1] // 2
            out, parts, gR = 0.0, [], []
            for x, i in ((H[:, :k] + T[:, k:], 0), (T[:, :k] + H[:, k:], 2)):
                c, w = R[:, i * k : (i + 1) * k], R[:, (i + 1) * k : (i + 2) * k]
                d, dx, dw = _box(x, c, np.abs(w))
                n = np.sqrt((d * d).sum(1, keepdims=True) + 1e-12)
                out = out - n[:, 0]
                parts.append(-d / n * dx)
                gR += [d / n * dx, -d / n * dw * np.sign(w)]
            return out, np.hstack(parts), np.hstack(gR), np.hstack(parts[::-1]), {}
        k = H.shape[1] // 2
        a, b, e, f = H[:, :k], H[:, k:], T[:, :k], T[:, k:]
        if self.base == "SimplE":
            c, d = R[:, :k], R[:, k:]
            return 0.5 * (a * c * f + e * d * b).sum(1), 0.5 * np.hstack([c * f, e * d]), 0.5 * np.hstack([a * f, e * b]), 0.5 * np.hstack([d * b, a * c]), {}
        if self.base == "ComplEx":
            c, d = R[:, :k], R[:, k:]
            s = (a * c * e + b * c * f + a * d * f - b * d * e).sum(1)
            return s, np.hstack([c * e + d * f, c * f - d * e]), np.hstack([a * e + b * f, a * f - b * e]), np.hstack([a * c - b * d, b * c + a * d]), {}
        cos, sin = np.cos(R), np.sin(R)
        x, y = a * cos - b * sin - e, a * sin + b * cos - f
        n = np.sqrt((x * x + y * y).sum(1) + 1e-12)[:, None]
        gx, gy = -x / n, -y / n
        return -n[:, 0], np.hstack([gx * cos + gy * sin, -gx * sin + gy * cos]), gx * (-a * sin - b * cos) + gy * (a * cos - b * sin), np.hstack([-gx, -gy]), {}


def train_model(h: np.ndarray, r: np.ndarray, t: np.ndarray, n_ent: int, n_rel: int, method: str, epochs: int, s: TrainSettings = TrainSettings(), literals: np.ndarray | None = None) -> Model:
    """Margin training with corrupted heads or tails (by the relation's tails
    per head and heads per tail) and Adam."""
    m = Model(method, n_ent, n_rel, s, literals)
    if method == "random" or not len(h):
        return m
    rng = np.random.default_rng(s.seed + 1)
    frame = pd.DataFrame({"h": h, "r": r, "t": t})
    tph = frame.groupby(["r", "h"]).t.nunique().groupby("r").mean().reindex(range(n_rel)).fillna(1).to_numpy()
    hpt = frame.groupby(["r", "t"]).h.nunique().groupby("r").mean().reindex(range(n_rel)).fillna(1).to_numpy()
    p_head = tph / (tph + hpt)
    learned = {"ent": m.ent, "rel": m.rel, **m.extra}
    state = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in learned.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(h))
        for i in range(0, len(order), s.batch):
            x = np.repeat(order[i : i + s.batch], s.negatives)
            H, R, T = h[x], r[x], t[x]
            swap = rng.random(len(x)) < p_head[R]
            other = rng.integers(0, n_ent, len(x))
            nH, nT = np.where(swap, other, H), np.where(swap, T, other)
            margin = s.margin - m.score(H, R, T)[0] + m.score(nH, R, nT)[0]
            on = (margin > 0).astype(float)
            _, gh, gr, gt, gx = m.score_all(H, R, T, on)
            _, nh, nr, nt, nx = m.score_all(nH, R, nT, on)
            total = {k: np.zeros_like(v) for k, v in learned.items()}
            for at, g, sign in ((H, gh, -1), (T, gt, -1), (nH, nh, 1), (nT, nt, 1)):
                np.add.at(total["ent"], at, sign * on[:, None] * g)
            np.add.at(total["rel"], R, on[:, None] * (nr - gr))
            for k in gx:
                if k == "normal":
                    np.add.at(total[k], R, on[:, None] * (nx[k] - gx[k]))
                else:
                    total[k] += nx[k] - gx[k]
            step += 1
            for key, w in learned.items():
                m1, m2 = state[key]
                g = total[key] / len(x) + s.weight_decay * w
                m1 += 0.1 * (g - m1)
                m2 += 0.001 * (g * g - m2)
                w -= s.lr * (m1 / (1 - 0.9**step)) / (np.sqrt(m2 / (1 - 0.999**step)) + 1e-8)
    return m


def literal_matrix(pdf: pd.DataFrame, entities: list) -> np.ndarray:
    """(entities x literal relations): mean numbers, scaled to 0..1 a column,
    0 where an entity has none.  pdf: h, r, value."""
    wide = pdf.dropna(subset=["value"]).pivot_table(index="h", columns="r", values="value", aggfunc="mean").reindex(entities)
    span = (wide.max() - wide.min()).replace(0, 1)
    return ((wide - wide.min()) / span).fillna(0.0).to_numpy().reshape(len(entities), -1)


def train(triples: DataFrame, method: str, epochs: int | None = None, settings: TrainSettings = TrainSettings(), group: str = "kg_type", literals: DataFrame | None = None) -> DataFrame:
    """(group, role entity|relation, name, vec), one model per graph.  Graphs
    are the unit of work; they train side by side on the cluster.

    literals(group, h, r, value): numbers of entities, for the literal methods.
    """
    n_epochs = EPOCHS.get(method, 400) if epochs is None else epochs

    def one(pdf: pd.DataFrame, numbers: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pd.DataFrame({group: [], "role": [], "name": [], "vec": []})
        pdf = pdf.sort_values(["h", "r", "t"])
        ents = sorted({*pdf.h, *pdf.t})
        rels = sorted(set(pdf.r))
        e, l = {x: i for i, x in enumerate(ents)}, {x: i for i, x in enumerate(rels)}
        known = literal_matrix(numbers, ents) if method in LITERAL else None
        m = train_model(pdf.h.map(e).to_numpy(), pdf.r.map(l).to_numpy(), pdf.t.map(e).to_numpy(), len(ents), len(rels), method, n_epochs, settings, known)
        return pd.DataFrame({group: pdf[group].iloc[0], "role": ["entity"] * len(ents) + ["relation"] * len(rels), "name": ents + rels, "vec": [*m.ent.tolist(), *m.rel.tolist()]})

    schema = f"{group} string, role string, name string, vec array<double>"
    t = triples.select(group, "h", "r", "t").groupBy(group)
    if literals is None:
        return t.applyInPandas(lambda pdf: one(pdf, pd.DataFrame({"h": [], "r": [], "value": []})), schema)
    return t.cogroup(literals.select(group, "h", "r", "value").groupBy(group)).applyInPandas(one, schema)


def random_embeddings(names: DataFrame, dim: int = 46, seed: int = 0) -> DataFrame:
    """(name, vec): uniform in -1..1, a fixed function of name and seed."""
    unit = lambda i: F.pmod(F.xxhash64(F.lit(seed), F.col("name"), i), F.lit(1 << 30)).cast("double") / (1 << 29) - 1
    return names.select("name", F.transform(F.sequence(F.lit(1), F.lit(dim)), unit).alias("vec"))


def walks(edges: DataFrame, depth: int = 4, per_node: int = 10, seed: int = 0, group: str | None = None) -> DataFrame:
    """([group,] start, walk ARRAY<STRING>): random walks along src -rel-> dst,
    for word2vec-style embeddings; choices are seeded hashes."""
    by = [group] if group else []
    out = edges.select(*by, F.col("src").alias("at"), "rel", "dst")
    w = edges.select(*by, F.col("src").alias("start")).distinct().select(*by, "start", F.explode(F.sequence(F.lit(1), F.lit(per_node))).alias("k")).select(*by, "start", "k", F.col("start").alias("at"), F.array("start").alias("walk"))
    for step in range(depth):
        pick = F.xxhash64(F.lit(seed + step), "start", "k", "rel", "dst")
        nxt = w.join(out, [*by, "at"]).groupBy(*by, "start", "k", "walk").agg(F.min_by(F.struct("rel", "dst"), pick).alias("n"))
        moved = nxt.select(*by, "start", "k", F.col("n.dst").alias("at"), F.concat("walk", F.array("n.rel", "n.dst")).alias("walk"))
        stopped = w.join(out.select(*by, "at").distinct(), [*by, "at"], "left_anti").select(*by, "start", "k", "at", "walk")
        w = moved.unionByName(stopped)
    return w.select(*by, "start", "walk")


def train_words(sentences: list, dim: int, epochs: int, seed: int = 0, window: int = 5, negatives: int = 5, lr: float = 0.025) -> tuple[list, np.ndarray]:
    """Skip-gram with negative samples over token lists: (tokens, vectors)."""
    rng = np.random.default_rng(seed)
    names = sorted({w for s in sentences for w in s})
    at = {w: i for i, w in enumerate(names)}
    pairs = [(at[s[i]], at[s[j]]) for s in sentences for i in range(len(s)) for j in range(max(0, i - window), min(len(s), i + window + 1)) if i != j]
    inner, outer = (rng.random((len(names), dim)) - 0.5) / dim, np.zeros((len(names), dim))
    if not pairs:
        return names, inner
    pairs = np.array(pairs)
    often = np.bincount(pairs[:, 1], minlength=len(names)) ** 0.75
    for epoch in range(epochs):
        rate = lr * max(1 - epoch / epochs, 1e-2)
        for part in np.array_split(rng.permutation(len(pairs)), max(1, len(pairs) // 256)):
            c, o = pairs[part, 0], pairs[part, 1]
            o = np.column_stack((o, rng.choice(len(names), (len(c), negatives), p=often / often.sum())))
            x, y = inner[c], outer[o]
            p = 1 / (1 + np.exp(-np.clip(np.einsum("nd,nkd->nk", x, y), -30, 30)))
            p[:, 0] -= 1
            np.add.at(outer, o, -rate * p[:, :, None] * x[:, None, :])
            np.add.at(inner, c, -rate * np.einsum("nk,nkd->nd", p, y))
    return names, inner


def rdf2vec(edges: DataFrame, dim: int = 46, epochs: int = 10, depth: int = 4, per_node: int = 10, seed: int = 0, group: str = "kg_type") -> DataFrame:
    """(group, name, vec): word vectors over random walks, one model per graph."""
    schema = f"{group} string, name string, vec array<double>"

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        names, vec = train_words(sorted(list(w) for w in pdf["walk"]), dim, epochs, seed)
        return pd.DataFrame({group: pdf[group].iloc[0], "name": names, "vec": vec.tolist()})

    return walks(edges, depth, per_node, seed, group).groupBy(group).applyInPandas(one, schema)
