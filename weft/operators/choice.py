"""Choice and rate models of event histories (survey section 2.13, L07), fitted by Newton's method on Spark.

The choice model says to whom the next event of a type goes, given who sends it; the rate model says who sends it. Both are
conditional logits: an event's likelihood is exp(b x) of the one that was chosen over the sum of exp(b x) over all that could
be. That sum is never spelt out for each event. It starts from the standing of all alternatives before the first event, and
each event changes the statistics of few: the sum at an event is the start plus the running sum of what the changes before it
added and took away, and so are the moments that the gradient and the Hessian need. Rows are therefore as many as events and
changes, not events times nodes. They are written once by group and bucket of positions; a step of Newton's method is one job over
them that shuffles totals of buckets only. The driver sees a few totals for each type.

Rows are tagged by the model (an event type) and the group whose alternatives they change: the sender for choices, one
group for rates. Positions are dense, so buckets of positions bound every window however large a group is.

Transitivity makes each event change as many alternatives as its ends have partners. Where the events of a type join few nodes
these rows would be many times the events, so the choice model is replayed there instead (fit_choice()): a block of positions starts
from the counts of all pairs, and each event's alternatives are weighed as they stand, while the counts are kept up to date.
"""

from __future__ import annotations

import sys
from collections.abc import Callable
from itertools import combinations_with_replacement

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weft.operators.closure import bucketed, staged
from weft.operators.rank import running_sums
from weft.operators.replay import growth

#: _weighed() travels with its code: the executors' Python workers need not find this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

STEPS = 50
#: Positions in a bucket: the most events that a window of one group holds.
BUCKET = 100_000
#: Rows of a file of the table that each step of Newton's method reads.
FILE = 250_000
#: The most nodes that events of a type may join to be replayed.
DENSE = 1_000
#: Positions of a replayed block, its rows in a file, and alternatives that are weighed at a time.
BLOCK, REPLAYED_FILE, CELLS = 200_000, 50_000, 32_768
#: The statistics of each specification, the full one first; the first that can be fitted is taken.
CHOICE = (
    ("inertia", "reciprocity", "transitivity", "same"), ("inertia", "reciprocity", "same"), ("inertia", "same"), ("inertia",),
)
UNKNOWN = "unk"
MOVING = ("inertia", "reciprocity", "transitivity")


def rates(scores: list[str]) -> tuple[tuple[str, ...], ...]:
    """The specifications of the rate model: with the nodes' scores, without them, then one degree alone."""
    full = (("in_degree", "out_degree", *scores),) if scores else ()
    return (*full, ("in_degree", "out_degree"), ("out_degree",), ("in_degree",))


def _events(e: DataFrame) -> DataFrame:
    return e.where("src <> dst").select("type", "src", "dst", "pos")


def _kinds(nodes: DataFrame) -> DataFrame:
    return nodes.select("label", F.coalesce("kind", F.lit(UNKNOWN)).alias("kind"))


def _between(e: DataFrame, known: DataFrame) -> DataFrame:
    """Events of two different nodes that are known (label)."""
    return _events(e).join(known.select(F.col("label").alias("src")), "src", "left_semi").join(known.select(F.col("label").alias("dst")), "dst", "left_semi")


def _new_and_old(deltas: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """deltas (keys, pos, d_<name>) with n_<name> and o_<name>: each statistic after and before the change."""
    x = running_sums(staged(deltas), keys, "pos", {f"n_{n}": F.col(f"d_{n}") for n in names})
    return x.select("*", *[(F.col(f"n_{n}") - F.col(f"d_{n}")).alias(f"o_{n}") for n in names])


def _tables(rows: DataFrame, chosen: Column, names: list[str]) -> DataFrame:
    """Changes, and beside them a row for each event with the statistics of what was chosen, before the event."""
    values = lambda new, old: [F.col(f"{s}_{n}").cast("double").alias(f"{t}_{n}") for t, s in (("n", new), ("o", old)) for n in names]
    bucket = F.floor(F.col("pos") / BUCKET).alias("bucket")
    changes = rows.select("model", "grp", bucket, "pos", F.lit(False).alias("asks"), *values("n", "o"))
    asks = rows.where(chosen).select("model", "grp", bucket, "pos", F.lit(True).alias("asks"), *values("o", "o"))
    whole = staged(changes.unionByName(asks))
    files = max(whole.sparkSession.sparkContext.defaultParallelism, whole.count() // FILE)
    return bucketed(whole, ["model", "grp", "bucket"], files)


def choice_tables(e: DataFrame, nodes: DataFrame, transitive: bool = False) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and start of the choice model. e: events with pos (replay.positions); nodes: label, kind, one row for each.

    Alternatives are all nodes but the sender; events of a node with itself and events whose ends are no nodes are left out.
    A null kind is a kind of its own. Without `transitive` the statistic is left out, as in the second specification: the ways
    through a node are as many as its events times its receivers, and each changes an alternative. fit_choice() has it always.
    """
    kinds = _kinds(nodes)
    end = lambda c: kinds.select(F.col("label").alias(c), F.col("kind").alias(f"{c}_kind"))
    ev = staged(_between(e, kinds))
    zero = lambda n: F.lit(0).cast("long").alias(n)
    one = lambda n: F.lit(1).cast("long").alias(n)
    parts = [
        ev.select("type", "src", "dst", "pos", one("d_inertia"), zero("d_reciprocity"), zero("d_transitivity")),
        ev.select("type", F.col("dst").alias("src"), F.col("src").alias("dst"), "pos", zero("d_inertia"), one("d_reciprocity"), zero("d_transitivity")),
    ]
    if transitive:
        p = staged(ev.select("type", "src", "dst").distinct())
        ways = p.select("type", F.col("src").alias("i"), F.col("dst").alias("k")).join(p.select("type", F.col("src").alias("k"), F.col("dst").alias("j")), ["type", "k"]).where("i <> j")
        parts.append(growth(ev, staged(ways)).select("type", "src", "dst", "pos", zero("d_inertia"), zero("d_reciprocity"), F.col("g").alias("d_transitivity")))
    deltas = parts[0]
    for p in parts[1:]:
        deltas = deltas.unionByName(p)
    moving = list(MOVING)
    deltas = deltas.groupBy("type", "src", "dst", "pos").agg(*[F.sum(f"d_{n}").alias(f"d_{n}") for n in moving])
    same = (F.col("src_kind") == F.col("dst_kind")).cast("double")
    x = _new_and_old(deltas, ["type", "src", "dst"], moving).join(end("src"), "src").join(end("dst"), "dst")
    x = x.select(F.col("type").alias("model"), F.col("src").cast("string").alias("grp"), "pos", "d_inertia", *[f"{t}_{n}" for t in "no" for n in moving], same.alias("n_same"), same.alias("o_same"))
    names = [*moving, "same"] if transitive else ["inertia", "reciprocity", "same"]
    size = kinds.groupBy("kind").agg(F.count("*").alias("alike"))
    total = size.agg(F.sum("alike").alias("total"))
    senders = ev.select(F.col("type").alias("model"), "src").distinct().join(kinds.select(F.col("label").alias("src"), "kind"), "src").join(size, "kind").join(F.broadcast(total))
    start = senders.select("model", F.col("src").cast("string").alias("grp"), F.inline(F.array(F.struct(F.lit(1.0).alias("x_same"), (F.col("alike") - 1).alias("w")), F.struct(F.lit(0.0).alias("x_same"), (F.col("total") - F.col("alike")).alias("w")))))
    start = start.where("w > 0").select("model", "grp", "w", *[(F.col("x_same") if n == "same" else F.lit(0.0)).alias(f"x_{n}") for n in names])
    return _tables(x, F.col("d_inertia") > 0, names), staged(start), names


def rate_tables(e: DataFrame, nodes: DataFrame, scores: list[str]) -> tuple[DataFrame, DataFrame, list[str]]:
    """Rows and start of the rate model. Alternatives are all nodes; nodes: label and scores, of which a null is 0."""
    known = nodes.select("label", *[F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(f"s_{c}") for c in scores])
    ev = staged(_between(e, known))
    half = lambda c, out: ev.select("type", F.col(c).alias("label"), "pos", F.lit(1 - out).cast("long").alias("d_in_degree"), F.lit(out).cast("long").alias("d_out_degree"))
    degrees = ["in_degree", "out_degree"]
    x = _new_and_old(half("src", 1).unionByName(half("dst", 0)), ["type", "label"], degrees).join(known, "label")
    fixed = [F.col(f"s_{c}").alias(f"{t}_{c}") for t in "no" for c in scores]
    x = x.select(F.col("type").alias("model"), F.lit("").alias("grp"), "pos", "d_out_degree", *[f"{t}_{n}" for t in "no" for n in degrees], *fixed)
    names = [*degrees, *scores]
    # Nodes with equal scores are one row; every type starts from the same nodes.
    alike = known.groupBy(*[f"s_{c}" for c in scores]).agg(F.count("*").alias("w"))
    types = [r[0] for r in ev.select("type").distinct().collect()]
    models = F.explode(F.array(*map(F.lit, types))) if types else F.explode(F.array().cast("array<string>"))
    start = alike.select(models.alias("model"), F.lit("").alias("grp"), "w", *[F.lit(0.0).alias(f"x_{n}") for n in degrees], *[F.col(f"s_{c}").alias(f"x_{c}") for c in scores])
    return _tables(x, F.col("d_out_degree") > 0, names), staged(start), names


def _moments(prefix: str, names: list[str], weight: Column) -> dict[str, Column]:
    """The sums that a logit needs of an alternative: exp(b x), and it times each x and each product of two."""
    x = {n: F.col(f"{prefix}_{n}") for n in names}
    e = weight * F.exp(sum((F.col(f"b_{n}") * x[n] for n in names), F.lit(0.0)))
    out = {"m": e} | {f"m_{n}": e * x[n] for n in names}
    return out | {f"m_{a}_{b}": e * x[a] * x[b] for a, b in combinations_with_replacement(names, 2)}


def totals(rows: DataFrame, start: DataFrame, names: list[str], betas: dict) -> dict:
    """model -> (log likelihood, gradient, Hessian of its negative, events) at betas (model -> array), in one job."""
    spark = rows.sparkSession
    b = F.broadcast(spark.createDataFrame([(m, *map(float, v)) for m, v in betas.items()], _beta_schema(rows, names)))
    r = rows.join(b, "model")
    new, old = _moments("n", names, F.lit(1.0)), _moments("o", names, F.lit(1.0))
    r = r.select("model", "grp", "bucket", "pos", "asks", *[f"o_{n}" for n in names], *[f"b_{n}" for n in names], *[F.when(F.col("asks"), 0.0).otherwise(new[k] - old[k]).alias(k) for k in new])
    keys = list(new)
    group, in_bucket = ["model", "grp"], ["model", "grp", "bucket"]
    first = start.join(b, "model").groupBy(*group).agg(*[F.sum(c).alias(k) for k, c in _moments("x", names, F.col("w")).items()])
    blocks = r.groupBy(*in_bucket).agg(*[F.sum(k).alias(k) for k in keys])
    up = Window.partitionBy(*group, F.lit(0)).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(*in_bucket, *[F.coalesce(F.sum(k).over(up), F.lit(0.0)).alias(f"c_{k}") for k in keys])
    before = before.join(first, group).select(*in_bucket, *[(F.col(f"c_{k}") + F.col(k)).alias(f"c_{k}") for k in keys])
    # An event's own change comes after it: asks sort before changes of the same position.
    here = Window.partitionBy(*in_bucket).orderBy("pos", F.col("asks").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = r.select(*in_bucket, "asks", *[f"o_{n}" for n in names], *[f"b_{n}" for n in names], *[F.sum(k).over(here).alias(f"h_{k}") for k in keys]).where("asks").join(before, in_bucket)
    s = lambda *n: F.col("_".join(["h_m", *n])) + F.col("_".join(["c_m", *n]))
    value = sum((F.col(f"b_{n}") * F.col(f"o_{n}") for n in names), F.lit(0.0)) - F.log(s())
    parts = [F.sum(value).alias("value"), F.count("*").alias("events")]
    parts += [F.sum(F.col(f"o_{n}") - s(n) / s()).alias(f"g_{n}") for n in names]
    parts += [F.sum(s(a, c) / s() - s(a) * s(c) / (s() * s())).alias(f"H_{a}_{c}") for a, c in combinations_with_replacement(names, 2)]
    out = {}
    for t in at.groupBy("model").agg(*parts).collect():
        h = np.zeros((len(names), len(names)))
        for i, j in combinations_with_replacement(range(len(names)), 2):
            h[i, j] = h[j, i] = _number(t[f"H_{names[i]}_{names[j]}"])
        out[t["model"]] = (_number(t["value"]), np.array([_number(t[f"g_{n}"]) for n in names]), h, t["events"])
    return out


def _beta_schema(rows: DataFrame, names: list[str]):
    return ", ".join([f"model {rows.schema['model'].dataType.simpleString()}", *[f"b_{n} double" for n in names]])


def _number(v) -> float:
    return float("nan") if v is None else float(v)


class Replay:
    """The choice model with all its statistics, event by event, for events that join at most `DENSE` nodes of each type.

    rows: model, block, pos, s, d, n (the ends by their numbers in the type): at pos -1 how many events of a pair came before the block, then
    the block's events. A step of Newton's method reads them in blocks, without a shuffle. seats: model -> for each number the
    place of its kind, and how many nodes of that kind no event of the type joins; the rest of all nodes, which differ by their kinds
    only, count as two alternatives with their numbers as weights.
    """

    names = [*MOVING, "same"]

    def __init__(self, rows: DataFrame, seats: dict):
        self.rows, self.seats = rows, seats
        self.models = list(seats)

    def totals(self, betas: dict) -> dict:
        """As totals()."""
        seats, k = self.seats, len(self.names)

        def block(rows):
            import pyarrow as pa

            model = rows.column("model")[0].as_py()
            found = _weighed(rows, seats[model], betas[model]) if model in betas else None
            sums = np.zeros((0, 2 + k + k * k)) if found is None else np.concatenate([[found[0], found[3]], found[1], found[2].ravel()])[None]
            at = [rows.column(c).slice(0, len(sums)) for c in ("model", "block")]
            return pa.table([*at, pa.array(list(sums), pa.list_(pa.float64()))], ["model", "block", "sums"])

        found = self.rows.groupBy("model", "block").applyInArrow(block, f"model {self.rows.schema['model'].dataType.simpleString()}, block long, sums array<double>").collect()
        out = {}
        for r in sorted(found, key=lambda r: r["block"]):
            out[r["model"]] = out.get(r["model"], 0.0) + np.array(r["sums"], dtype=float)
        return {m: (v[0], v[2 : 2 + k], v[2 + k :].reshape(k, k), int(v[1])) for m, v in out.items()}


def _weighed(rows, seats: tuple, beta: np.ndarray) -> tuple:
    """Log likelihood, gradient, Hessian of its negative and events of one type's block."""
    rows = rows.sort_by("pos")
    pos, s, d, n = (rows.column(c).to_numpy() for c in ("pos", "s", "d", "n"))
    kind, others, rest = seats
    size, before = len(kind), int((pos < 0).sum())
    same = np.zeros((size, size + 2))  # behind the numbered nodes stand all others of the sender's kind, then all of other kinds
    same[:, :size] = kind[:, None] == kind[None, :]
    same[:, size] = 1.0
    weight = np.ones((size, size + 2))
    weight[:, size], weight[:, size + 1] = others, rest - others
    np.fill_diagonal(weight, 0.0)
    out = np.zeros((size, size))
    out[s[:before], d[:before]] = n[:before]
    into, ways = out.T.copy(), out @ out
    s, d = s[before:].tolist(), d[before:].tolist()
    value, grad, hess, many = 0.0, np.zeros(4), np.zeros((4, 4)), max(1, CELLS // (size + 2))
    with np.errstate(all="ignore"):
        weight = np.log(weight)
        x = np.zeros((4, many, size + 2))
        for lo in range(0, len(s), many):
            a, b = s[lo : lo + many], d[lo : lo + many]
            for c, (i, j) in enumerate(zip(a, b)):
                x[0, c, :size], x[1, c, :size], x[2, c, :size] = out[i], into[i], ways[i]
                ways[i] += out[j]
                ways[:, j] += into[i]
                out[i, j] += 1
                into[j, i] += 1
            m = len(a)
            here, y = np.arange(m), x[:, :m]
            y[3] = same[a]
            u = weight[a]
            for t in range(4):
                if beta[t]:
                    u += beta[t] * y[t]
            top = u.max(1, keepdims=True)
            chosen = u[here, b]
            p = np.exp(u - top)
            total = p.sum(1, keepdims=True)
            value += float((chosen - (top + np.log(total))[:, 0]).sum())
            p /= total
            far = []
            for t in range(4):
                mean = (p * y[t]).sum(1)
                grad[t] += (y[t, here, b] - mean).sum()
                far.append(y[t] - mean[:, None])
            for t in range(4):
                w = p * far[t]
                for v in range(t, 4):
                    hess[t, v] += np.vdot(w, far[v])
        hess = np.triu(hess) + np.triu(hess, 1).T
    return value, grad, hess, len(s)


def choice_replay(e: DataFrame, nodes: DataFrame) -> Replay | None:
    """What choice_tables() reads, for Replay; None where the events of a type join more than `DENSE` nodes."""
    kinds = _kinds(nodes)
    ev = staged(_between(e, kinds).withColumnRenamed("type", "model"))
    ends = staged(ev.select("model", F.explode(F.array("src", "dst")).alias("label")).distinct())
    if ends.groupBy("model").count().where(F.col("count") > DENSE).limit(1).count():
        return None
    ids = staged(ends.withColumn("i", (F.row_number().over(Window.partitionBy("model").orderBy("label")) - 1).cast("long")))
    size = staged(kinds.groupBy("kind").agg(F.count("*").alias("alike")))
    total = size.agg(F.sum("alike")).first()[0]
    seats: dict = {}
    for r in sorted(ids.join(kinds, "label").join(size, "kind").select("model", "i", "kind", "alike").collect(), key=lambda r: r.i):
        seats.setdefault(r.model, []).append((r.kind, r.alike))
    for model, them in seats.items():
        place = {k: at for at, k in enumerate(dict(them))}
        kind = np.array([place[k] for k, _ in them])
        seats[model] = (kind, np.array([alike for _, alike in them]) - np.bincount(kind)[kind], total - len(them))
    x = ev
    for end, to in (("src", "s"), ("dst", "d")):
        x = x.join(ids.select("model", F.col("label").alias(end), F.col("i").alias(to)), ["model", end])
    x = staged(x.select("model", F.floor(F.col("pos") / BLOCK).alias("block"), F.col("pos").cast("long").alias("pos"), "s", "d"))
    pair = ["model", "s", "d"]
    counts = staged(x.groupBy(*pair, "block").agg(F.count("*").alias("n")))
    grid = counts.select(*pair).distinct().join(counts.select("model", "block").distinct(), "model")
    up = Window.partitionBy(*pair).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    start = grid.join(counts, [*pair, "block"], "left").withColumn("n", F.sum("n").over(up)).where("n > 0")
    columns = ["model", "block", "pos", "s", "d", "n"]
    whole = start.withColumn("pos", F.lit(-1).cast("long")).select(*columns).unionByName(x.withColumn("n", F.lit(1).cast("long")).select(*columns))
    files = max(ev.sparkSession.sparkContext.defaultParallelism, x.count() // REPLAYED_FILE)
    return Replay(bucketed(whole, ["model", "block"], files), seats)


class _Fit:
    """The driver's side of one model: which specification, where Newton's method stands, and where it tries next."""

    def __init__(self, names: list[str], specs: list[tuple[str, ...]]):
        self.names, self.specs, self.at, self.done = names, specs, -1, False
        self.next_spec()

    def next_spec(self) -> None:
        self.at += 1
        self.best, self.steps, self.beta, self.try_ = None, 0, np.zeros(len(self.names)), np.zeros(len(self.names))
        self.free = [self.names.index(n) for n in self.specs[self.at]] if self.at < len(self.specs) else []
        self.done = self.at >= len(self.specs)

    def take(self, value: float, grad: np.ndarray, hess: np.ndarray) -> None:
        self.steps += 1
        g, h = grad[self.free], hess[np.ix_(self.free, self.free)]
        fine = np.isfinite(value) and np.isfinite(g).all() and np.isfinite(h).all()
        if self.steps > STEPS or (self.best is None and not fine):
            return self.next_spec()
        if self.best is not None and (not fine or value < self.best - 1e-10 * abs(self.best)):
            self.try_ = (self.beta + self.try_) / 2  # too far
            return None
        self.beta, self.best = self.try_, value
        scale = np.sqrt(np.diag(h)) if (np.diag(h) > 0).all() else None
        if scale is None or np.linalg.eigvalsh(h / np.outer(scale, scale))[0] < 1e-9:
            return self.next_spec()  # statistics that do not vary or say the same
        step = np.linalg.solve(h, g)
        self.try_ = self.beta.copy()
        self.try_[self.free] += step
        if np.abs(step).max() <= 1e-9 * (1 + np.abs(self.beta).max()):
            self.done = True
        return None


def fit(tables: tuple[DataFrame, DataFrame, list[str]], specs: tuple[tuple[str, ...], ...]) -> DataFrame:
    """model, spec, events, log_likelihood, term, beta: the terms of the first specification that can be fitted, for each event
    type. A specification cannot be fitted if its statistics do not vary, say the same, or have no finite maximum within
    STEPS steps; a type for which none can has one row without terms.

    All types take a step together. The driver solves one small system for each type; types are a fixed vocabulary.
    """
    rows, start, names = tables
    models = [r[0] for r in rows.select("model").distinct().collect()]
    return _fitted(rows, models, names, specs, lambda betas: totals(rows, start, names, betas))


def fit_choice(e: DataFrame, nodes: DataFrame, specs: tuple[tuple[str, ...], ...] = CHOICE) -> DataFrame:
    """fit() of the choice model with all its statistics. e, nodes: as for choice_tables()."""
    r = choice_replay(e, nodes)
    return fit(choice_tables(e, nodes, transitive=True), specs) if r is None else _fitted(r.rows, r.models, r.names, specs, r.totals)


def _fitted(rows: DataFrame, models: list, names: list[str], specs: tuple[tuple[str, ...], ...], step: Callable[[dict], dict]) -> DataFrame:
    specs = [s for s in specs if set(s) <= set(names)]
    spark: SparkSession = rows.sparkSession
    fits = {m: _Fit(names, specs) for m in models}
    seen: dict = {}
    while True:
        open_ = {m: f.try_ for m, f in fits.items() if not f.done}
        if not open_:
            break
        for m, (value, grad, hess, n) in step(open_).items():
            seen[m] = n
            fits[m].take(value, grad, hess)
    out = []
    for m, f in fits.items():
        if f.at >= len(specs):
            out.append((m, None, seen.get(m, 0), None, None, None))
        for i in f.free:
            out.append((m, " + ".join(specs[f.at]), seen[m], float(f.best), names[i], float(f.beta[i])))
    kind = rows.schema["model"].dataType.simpleString()
    return spark.createDataFrame(out, f"model {kind}, spec string, events long, log_likelihood double, term string, beta double")
