"""The hybrid logit V = Xβ + NN(Q) and its special cases,
trained data-parallel on Spark.

One epoch = one Spark job (``many``). The current weights (and Adam moments) travel
to the tasks (a few thousand doubles); each partition runs mini-batch Adam over
its own rows in a seeded order (with inverted dropout) and returns its weights,
moments and row count as partial sums; the driver averages them by rows (local SGD
with model averaging); L-BFGS steps on the whole table may follow. Scoring is a
``mapInPandas`` forward pass. numpy only.

* wide = [] gives the dense net (G5/G6); deep = [] gives the MNL trained by
  Adam (G3); deep = wide gives the same-input variant (G7, β not identified).
* ``init_beta`` / ``train_beta=False`` give start values / frozen β (G12).
* ``history`` holds (epoch, loss, accuracy) rows (G13).
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from .mnl import softmax_rows
from .sums import cached_design, design_matrix, label_index, partition_sums


@dataclass
class HybridSpec:
    wide: list[str]
    deep: list[str]
    hidden: int = 16
    layers: int = 1
    classes: list = field(default_factory=lambda: [1, 2, 3])
    dropout: float = 0.2

    def shapes(self) -> list[tuple[str, tuple]]:
        k = len(self.classes)
        s = []
        if self.wide is not None:
            s.append(("beta", (k - 1, len(self.wide) + 1)))
        if self.deep:
            s.append(("w1", (len(self.deep), self.hidden)))
            s.append(("b1", (self.hidden,)))
            for i in range(self.layers - 1):
                s.append((f"wh{i}", (self.hidden, self.hidden)))
                s.append((f"bh{i}", (self.hidden,)))
            s.append(("w2", (self.hidden, k)))
            s.append(("b2", (k,)))
        return s

    def size(self) -> int:
        return int(sum(np.prod(sh) for _, sh in self.shapes()))

    def draws(self) -> int:
        """Random numbers that dropout takes for a row."""
        return self.hidden * self.layers if self.deep and self.dropout > 0 else 0

    def masks(self, flat: np.ndarray, n: int) -> np.ndarray:
        """The dropout factors of n rows, by layer."""
        return flat.reshape(self.layers, n, self.hidden)

    def forward(self, w, x, q, rng=None, masks=None):
        return forward(self, w, x, q, rng, masks)

    def backward(self, w, cache, du, train_beta=True, out=None):
        return backward(self, w, cache, du, train_beta, out)


@dataclass
class AltNetSpec:
    """One network shared by all alternatives, applied to each alternative's
    own design column (the reference's alternative-specific layout: base
    alternative all zero; the others carry their intercept and each variable
    in their own rows), with an output unit per alternative; ``linear`` adds
    the shared-β utility of the same design."""
    wide: list[str]
    hidden: int = 16
    classes: list = field(default_factory=lambda: [1, 2, 3])
    dropout: float = 0.2
    linear: bool = False
    deep: list = field(default_factory=list)
    layers: int = 1

    @property
    def d(self) -> int:
        return (len(self.wide) + 1) * (len(self.classes) - 1)

    def shapes(self):
        k = len(self.classes)
        s = [("w1", (self.d, self.hidden)), ("b1", (self.hidden,)), ("w2", (k, self.hidden)), ("b2", (k,))]
        if self.linear:
            s.append(("lin", (self.d,)))
        return s

    def size(self) -> int:
        return int(sum(np.prod(sh) for _, sh in self.shapes()))

    def design(self, x: np.ndarray) -> np.ndarray:
        n, k = x.shape[0], len(self.classes)
        z = np.zeros((n, k, self.d))
        for j in range(1, k):
            z[:, j, j - 1::k - 1] = x
        return z

    def draws(self) -> int:
        return self.hidden * len(self.classes) if self.dropout > 0 else 0

    def masks(self, flat: np.ndarray, n: int) -> np.ndarray:
        return flat.reshape(n, len(self.classes), self.hidden).transpose(1, 0, 2)

    def _by_class(self, v: np.ndarray) -> np.ndarray:
        """Rows of ``design``'s columns as (alternative, variable, ...): the others are zero there."""
        return v.reshape(len(self.wide) + 1, len(self.classes) - 1, -1).transpose(1, 0, 2)

    def forward(self, w, x, q, rng=None, masks=None):
        # design(x) @ w1 without the zeros of the design; arrays are (alternative, row, unit)
        k = len(self.classes)
        pre = np.empty((k, len(x), self.hidden))
        pre[0] = w["b1"]
        np.matmul(x, self._by_class(w["w1"]), out=pre[1:])
        pre[1:] += w["b1"]
        h = np.maximum(pre, 0.0)
        if rng is not None and masks is None and self.dropout > 0:
            masks = self.masks(dropout_factors(self, rng, len(x)), len(x))
        if masks is not None:
            h *= masks
        u = np.matmul(h, w["w2"][:, :, None])[:, :, 0].T + w["b2"]
        if self.linear:
            u[:, 1:] += x @ w["lin"].reshape(-1, k - 1)
        return u, {"x": x, "pre": pre, "mask": masks, "h": h}

    def backward(self, w, cache, du, train_beta=True, out=None):
        x, pre, m, h = cache["x"], cache["pre"], cache["mask"], cache["h"]
        g = out if out is not None else unpack(self, np.empty(self.size()))
        by_class = np.ascontiguousarray(du.T)
        np.matmul(by_class[:, None, :], h, out=g["w2"][:, None, :])
        np.add.reduce(du, axis=0, out=g["b2"])
        dpre = by_class[:, :, None] * w["w2"][:, None, :]
        if m is not None:
            dpre *= m
        dpre *= pre > 0
        self._by_class(g["w1"])[...] = np.matmul(x.T, dpre[1:])
        np.add.reduce(dpre.reshape(-1, self.hidden), axis=0, out=g["b1"])
        if self.linear:
            g["lin"][:] = (x.T @ du[:, 1:]).ravel() if train_beta else 0.0
        return g


def unpack(spec: HybridSpec, flat: np.ndarray) -> dict[str, np.ndarray]:
    out, i = {}, 0
    for name, sh in spec.shapes():
        n = int(np.prod(sh))
        out[name] = flat[i:i + n].reshape(sh)
        i += n
    return out


def init_params(spec: HybridSpec, seed: int, init_beta: np.ndarray | None = None) -> np.ndarray:
    rng = np.random.default_rng(seed)
    parts = []
    for name, sh in spec.shapes():
        if name == "beta":
            parts.append(np.zeros(sh) if init_beta is None else np.asarray(init_beta, float).reshape(sh))
        elif name.startswith("w"):
            fan_in, fan_out = sh
            lim = np.sqrt(6.0 / (fan_in + fan_out))     # Glorot uniform
            parts.append(rng.uniform(-lim, lim, sh))
        else:
            parts.append(np.zeros(sh))
    return np.concatenate([p.ravel() for p in parts])


def dropout_factors(spec, rng: np.random.Generator, n: int) -> np.ndarray:
    """0 or 1 / (1 - dropout), ``spec.draws()`` for each of n rows."""
    return (rng.random(n * spec.draws()) >= spec.dropout) / (1.0 - spec.dropout)


def _layers(spec: HybridSpec) -> list[tuple[str, str]]:
    return [("w1", "b1")] + [(f"wh{i}", f"bh{i}") for i in range(spec.layers - 1)]


def forward(spec: HybridSpec, w: dict, x: np.ndarray, q: np.ndarray, rng=None, masks=None):
    """Utilities and the cache for backprop. rng (or its dropout factors by layer) given -> training."""
    cache = {"x": x, "q": q, "acts": [], "masks": masks}
    if rng is not None and masks is None and spec.draws():
        masks = cache["masks"] = spec.masks(dropout_factors(spec, rng, len(x)), len(x))
    if spec.deep:
        h = q
        for i, (wn, bn) in enumerate(_layers(spec)):
            pre = h @ w[wn]
            pre += w[bn]
            cache["acts"].append((h, pre))
            h = np.maximum(pre, 0.0)
            if masks is not None:
                h *= masks[i]
        cache["last"] = h
        u = h @ w["w2"]
        u += w["b2"]
    else:
        u = np.zeros((x.shape[0], len(spec.classes)))
    if "beta" in w:
        u[:, 1:] += x @ w["beta"].T
    return u, cache


def backward(spec: HybridSpec, w: dict, cache: dict, du: np.ndarray, train_beta: bool = True, out: dict | None = None) -> dict:
    """Gradients by block, written to the arrays of ``out`` where given."""
    g = out if out is not None else unpack(spec, np.empty(spec.size()))
    if "beta" in w:
        if train_beta:
            np.matmul(du[:, 1:].T, cache["x"], out=g["beta"])
        else:
            g["beta"][...] = 0.0
    if spec.deep:
        np.matmul(cache["last"].T, du, out=g["w2"])
        np.add.reduce(du, axis=0, out=g["b2"])
        dh = du @ w["w2"].T
        layers = _layers(spec)
        for li in range(len(layers) - 1, -1, -1):
            wn, bn = layers[li]
            h_in, pre = cache["acts"][li]
            if cache["masks"] is not None:
                dh *= cache["masks"][li]
            dh *= pre > 0
            np.matmul(h_in.T, dh, out=g[wn])
            np.add.reduce(dh, axis=0, out=g[bn])
            if li:
                dh = dh @ w[wn].T
    return g


def flat_grad(spec: HybridSpec, g: dict) -> np.ndarray:
    return np.concatenate([g[name].ravel() for name, _ in spec.shapes()])


@dataclass
class HybridResult:
    spec: HybridSpec
    params: np.ndarray
    history: list
    n: int

    def weights(self) -> dict:
        return unpack(self.spec, self.params)

    def n_params(self) -> int:
        return int(np.count_nonzero(self.params))


def _loss_accuracy(data: DataFrame, spec: HybridSpec, params: np.ndarray, label: str) -> tuple[float, float]:
    wide, deep, classes = spec.wide or [], list(spec.deep or []), spec.classes

    def fn(pdf):
        q = pdf[deep].to_numpy(dtype="float64") if deep else np.zeros((len(pdf), 0))
        u, _ = spec.forward(unpack(spec, params), design_matrix(pdf, wide), q)
        pr, yi = softmax_rows(u), label_index(pdf, label, classes)
        return np.array([-np.log(np.clip(pr[np.arange(len(pdf)), yi], 1e-300, None)).sum(),
                         (pr.argmax(1) == yi).sum(), len(pdf)], dtype="float64")
    loss, correct, n = partition_sums(data, fn, 3)
    return (float(loss / n), float(correct / n)) if n else (float("nan"), float("nan"))


def fit_hybrid(df: DataFrame, spec: HybridSpec, label: str = "y", key: str = "loan_id", epochs: int = 50,
               batch_size: int = 32, lr: float = 1e-3, seed: int = 10, shards: int | None = None,
               init_beta: np.ndarray | None = None, train_beta: bool = True,
               validation: DataFrame | None = None, polish_steps: int = 0) -> HybridResult:
    """One network: per-shard Adam epochs + row-weighted averaging, then at most
    ``polish_steps`` full-gradient L-BFGS steps (see ``many``).

    The shard count is a parameter of the model like the batch size, by default a
    rule of the row count (``many.shards_for``): the weights do not depend on the
    cluster. History rows are (epoch, loss, accuracy), followed by the loss and
    accuracy on ``validation`` where given (forward pass without dropout)."""
    from .many import Model, design, fit_many
    cols = list(dict.fromkeys((spec.wide or []) + list(spec.deep or [])))
    d = design(df, cols, label, key, shards=shards)
    held = None if validation is None else cached_design(validation, cols, label)
    after = None if held is None else lambda params: [_loss_accuracy(held, spec, params[0], label)]
    model = Model(spec, seed=seed, init_beta=init_beta, train_beta=train_beta)
    result = fit_many(d, [model], epochs, batch_size, lr, polish_steps, after_epoch=after)[0]
    d.release()
    if held is not None:
        held.unpersist()
    return result


def score_hybrid(df: DataFrame, result: HybridResult, keep: list[str], prefix: str = "prob_c",
                 utilities: bool = False) -> DataFrame:
    """Forward pass (no dropout) -> prob_c1..K and pred (first maximum) [or u_c1..K]."""
    spec, params = result.spec, result.params
    wide, deep, classes = spec.wide or [], spec.deep, spec.classes
    names = [f"{'u_c' if utilities else prefix}{k}" for k in classes]
    schema = ", ".join([f"`{c}` {t}" for c, t in _types(df, keep)] + [f"{n} double" for n in names] +
                       ([] if utilities else ["pred int"]))

    def fn(it):
        w = unpack(spec, params)
        for pdf in it:
            x = design_matrix(pdf, wide)
            q = pdf[deep].to_numpy(dtype="float64") if deep else np.zeros((len(pdf), 0))
            u, _ = spec.forward(w, x, q)
            out = pdf[keep].copy()
            vals = u if utilities else softmax_rows(u)
            for i, n in enumerate(names):
                out[n] = vals[:, i]
            if not utilities:
                out["pred"] = (vals.argmax(1) + min(classes)).astype("int32")
            yield out
    cols = list(dict.fromkeys(keep + wide + deep))
    return df.select(*cols).mapInPandas(fn, schema)


def _types(df: DataFrame, cols: list[str]):
    tmap = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return [(c, tmap[c]) for c in cols]


def network_offsets(df: DataFrame, result: HybridResult, keep: list[str]) -> DataFrame:
    """Network part of the utilities per row (for β's information matrix given the net)."""
    spec = result.spec
    zero_beta = HybridResult(HybridSpec(None, spec.deep, spec.hidden, spec.layers, spec.classes, spec.dropout),
                             _drop_beta(spec, result.params), result.history, result.n)
    return score_hybrid(df, zero_beta, keep, utilities=True)


def _drop_beta(spec: HybridSpec, params: np.ndarray) -> np.ndarray:
    shapes = spec.shapes()
    if shapes and shapes[0][0] == "beta":
        return params[int(np.prod(shapes[0][1])):]
    return params


def beta_of(result: HybridResult) -> np.ndarray | None:
    w = result.weights()
    return w.get("beta")


def hybrid_beta_information(df: DataFrame, result: HybridResult, label: str = "y") -> np.ndarray:
    """J2 for the hybrid: information of β with the network held fixed (as the
    reference does): Σ Xᵀ(diag p − ppᵀ)X where p includes the network term."""
    from .mnl import mnl_batch_stats
    spec = result.spec
    wide, deep, classes = spec.wide or [], spec.deep, spec.classes
    w = result.weights()
    beta = w["beta"]
    d = beta.size

    def fn(pdf):
        x = design_matrix(pdf, wide)
        q = pdf[deep].to_numpy(dtype="float64") if deep else np.zeros((len(pdf), 0))
        wn = dict(w)
        wn.pop("beta")
        u, _ = forward(HybridSpec(None, deep, spec.hidden, spec.layers, classes, spec.dropout), wn,
                       np.zeros((len(pdf), 0)), q)
        return mnl_batch_stats(x, label_index(pdf, label, classes), beta, offset=u)
    cols = list(dict.fromkeys([label] + wide + deep))
    v = partition_sums(df.select(*cols).dropna(), fn, 1 + d + d * d + 1)
    return v[1 + d:1 + d + d * d].reshape(d, d)


_SAVED = ("kind string, wide array<string>, deep array<string>, hidden int, layers int, classes array<int>, dropout double, "
          "linear boolean, n long, params array<double>, history array<array<double>>")


def save_network(spark: SparkSession, result: HybridResult, path: str) -> None:
    """A fitted network (column roles, sizes, weights, history) as a Parquet table of one row."""
    s = result.spec
    alt = isinstance(s, AltNetSpec)
    row = ("alternatives" if alt else "hybrid", s.wide, list(s.deep or []), s.hidden, s.layers, [int(c) for c in s.classes],
           float(s.dropout), s.linear if alt else None, result.n, [float(x) for x in result.params],
           [[float(x) for x in h] for h in result.history])
    spark.createDataFrame([row], _SAVED).coalesce(1).write.mode("overwrite").parquet(path)


def load_network(spark: SparkSession, path: str) -> HybridResult:
    r = spark.read.schema(_SAVED).parquet(path).first()
    if r["kind"] == "alternatives":
        spec = AltNetSpec(list(r["wide"]), r["hidden"], list(r["classes"]), r["dropout"], r["linear"])
    else:
        spec = HybridSpec(None if r["wide"] is None else list(r["wide"]), list(r["deep"]), r["hidden"], r["layers"],
                          list(r["classes"]), r["dropout"])
    return HybridResult(spec, np.array(r["params"], dtype="float64"), [tuple(h) for h in r["history"]], r["n"])
