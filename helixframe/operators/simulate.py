"""Simulators as Arrow UDFs over distinct parameter rows.

Each function takes a table of parameters, solves every distinct row once and
joins the results back, so repeated edits cost nothing. Solvers are vectorised
over a batch of rows."""

from __future__ import annotations

import heapq
import random
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def rates(state: np.ndarray, signal: np.ndarray, ratio: np.ndarray, spec: dict) -> np.ndarray:
    """Time derivatives of a thermodynamic gene circuit, batch x genes: a gene's
    promoter is bound with weight (basal + input * signal + binding * ratio) over
    one plus that weight plus what represses it; cooperative repressors count by
    powers."""
    drive = spec["basal"] + spec["input"] * signal[:, None] + spec["binding"] * ratio[:, None] * signal[:, None]
    against = np.ones_like(state)
    for j in range(state.shape[1]):
        against = against * (1 + spec["repression"][:, j] * state[:, j : j + 1]) ** spec["cooperativity"][:, j]
    bound = drive / (drive + against)
    return spec["production"] * bound - spec["decay"] * state


def circuit_arrays(spec: dict) -> dict:
    return {k: np.asarray(v, float) for k, v in spec.items() if k != "genes"}


def rk4_step(state: np.ndarray, f, h) -> np.ndarray:
    a = f(state)
    b = f(state + h / 2 * a)
    c = f(state + h / 2 * b)
    d = f(state + h * c)
    return np.clip(state + h / 6 * (a + 2 * b + 2 * c + d), 0, 1)


def rk4(state: np.ndarray, f, hours: float, steps: int) -> np.ndarray:
    for _ in range(steps):
        state = rk4_step(state, f, hours / steps)
    return state


def adaptive_rk4(state: np.ndarray, f, hours: float, tolerance: float = 1e-8, by_row: bool = False) -> np.ndarray:
    """Step doubling: a step is taken where one full and two half steps agree.
    Each row has steps of its own, so its result doesn't depend on the rows that
    it shares a batch with. ``by_row``: f(state, rows) gives those rows' rates."""
    rows = np.arange(len(state))
    state = state.astype(float).copy()
    t, h = np.zeros(len(state)), np.full(len(state), min(0.1, hours))
    while len(rows := np.flatnonzero(t < hours - 1e-12)):
        step = np.minimum(h[rows], hours - t[rows])[:, None]
        g = (lambda s, rows=rows: f(s, rows)) if by_row else f
        one, two = rk4_step(state[rows], g, step), rk4_step(rk4_step(state[rows], g, step / 2), g, step / 2)
        error = np.abs(one - two).max(1, initial=0) / 15
        good = (error <= tolerance) | (step[:, 0] < 1e-6)
        state[rows[good]] = two[good]
        t[rows[good]] += step[good, 0]
        h[rows] = step[:, 0] * np.clip(0.9 * (tolerance / np.maximum(error, 1e-16)) ** 0.2, 0.2, 4.0)
    return state


def _steady(batches: Iterator[pa.RecordBatch], spec: dict, hours: float, genes: list[str]) -> Iterator[pa.RecordBatch]:
    arrays = circuit_arrays(spec)
    for b in batches:
        ratio, signal = (b.column(c).to_numpy(zero_copy_only=False) for c in ("ratio", "signal"))
        start = np.zeros((len(ratio), len(genes)))
        out = adaptive_rk4(start, lambda s, k: rates(s, signal[k], ratio[k], arrays), hours, by_row=True) if len(ratio) else start
        yield pa.RecordBatch.from_arrays([b.column("ratio"), b.column("signal"), pa.array(list(out), pa.list_(pa.float64()))], ["ratio", "signal", "state"])


def steady_states(df: DataFrame, spec: dict, hours: float = 48.0, places: int = 8) -> DataFrame:
    """df (ratio, signal) with state, the genes' levels after hours. Ratios that
    agree to ``places`` are solved once."""
    genes = spec["genes"]
    keyed = df.withColumn("ratio", F.round("ratio", places))
    keys = keyed.select(F.col("ratio").cast("double"), F.col("signal").cast("double")).distinct()
    solved = keys.mapInArrow(partial(_steady, spec=spec, hours=hours, genes=genes), "ratio double, signal double, state array<double>")
    return keyed.join(solved, ["ratio", "signal"])


def spikes(cells: list[int], contacts: list[tuple[int, int]], stimuli: list[tuple[float, int, float]], tau: float = 10.0, threshold: float = 1.0, weight: float = 0.6, delay: float = 1.5, refractory: float = 3.0, until: float = 200.0) -> list[tuple[float, int]]:
    """Leaky integrate-and-fire by events: jumps at one time and cell act as
    one; spikes reach contacts after a delay; refractory cells ignore jumps."""
    queue = [(t, c, j) for t, c, j in stimuli]
    heapq.heapify(queue)
    level, seen, quiet = dict.fromkeys(cells, 0.0), dict.fromkeys(cells, 0.0), dict.fromkeys(cells, -1.0)
    targets: dict[int, list[int]] = {}
    for a, b in contacts:
        targets.setdefault(a, []).append(b)
    out = []
    while queue and queue[0][0] <= until:
        t, c, jump = heapq.heappop(queue)
        while queue and queue[0][:2] == (t, c):
            jump += heapq.heappop(queue)[2]
        if t < quiet[c]:
            continue
        level[c] = level[c] * np.exp(-(t - seen[c]) / tau) + jump
        seen[c] = t
        if level[c] >= threshold:
            out.append((t, c))
            level[c], quiet[c] = 0.0, t + refractory
            for other in targets.get(c, ()):
                heapq.heappush(queue, (t + delay, other, weight))
    return out


def network_spikes(stimuli: DataFrame, contacts: DataFrame, **options) -> DataFrame:
    """(network, time, cell): spikes of every network by itself, on the cluster.
    stimuli: network, time, cell, jump; contacts: network, source, target."""
    both = stimuli.select("network", F.lit(0).alias("kind"), F.col("time").cast("double").alias("time"), F.col("cell").cast("long").alias("a"), F.lit(0).cast("long").alias("b"), F.col("jump").cast("double").alias("jump")).unionByName(
        contacts.select("network", F.lit(1).alias("kind"), F.lit(0.0).alias("time"), F.col("source").cast("long").alias("a"), F.col("target").cast("long").alias("b"), F.lit(0.0).alias("jump"))
    )

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by([("kind", "ascending"), ("time", "ascending"), ("a", "ascending"), ("b", "ascending")]).to_pylist()
        pairs = [(r["a"], r["b"]) for r in rows if r["kind"]]
        jumps = [(r["time"], r["a"], r["jump"]) for r in rows if not r["kind"]]
        cells = sorted({c for p in pairs for c in p} | {c for _, c, _ in jumps})
        out = spikes(cells, pairs, jumps, **options)
        return pa.table({"network": pa.array([rows[0]["network"]] * len(out), t.schema.field("network").type), "time": pa.array([float(x) for x, _ in out], pa.float64()), "cell": pa.array([c for _, c in out], pa.int64())})

    return both.groupBy("network").applyInArrow(run, f"network {stimuli.schema['network'].dataType.simpleString()}, time double, cell long")


def trace_faults(events: DataFrame, trace: str) -> DataFrame:
    """(trace, fault) of every construction trace, each on its own task: events
    with seq, event, step, cell and target."""

    def run(t: pa.Table) -> pa.Table:
        rows = t.sort_by("seq").to_pylist()
        out = validate_trace(rows)
        return pa.table({"trace": pa.array([rows[0][trace]] * len(out), t.schema.field(trace).type), "fault": pa.array(out, pa.string())})

    return events.groupBy(trace).applyInArrow(run, f"trace {events.schema[trace].dataType.simpleString()}, fault string")


def _shuffle(x: list, bits) -> None:
    """random.shuffle with a generator's bits, without a call for each place."""
    for n in range(len(x), 1, -1):
        k = n.bit_length()
        j = bits(k)
        while j >= n:
            j = bits(k)
        x[n - 1], x[j] = x[j], x[n - 1]


def dinucleotide_shuffle(s: str, seed: int | str) -> str:
    """A random string with the same dinucleotide counts, first and last letter;
    all such strings are equally likely.

    It is a random Eulerian walk. The last ways out of the letters are a tree that
    leads to the last letter, drawn by loop-erased random walks: each starts at a
    letter that isn't in the tree yet and forgets the circles it makes, so the
    draw ends, with however many letters, and is exact. The other ways out come in
    random order before."""
    if len(s) < 3:
        return s
    g = random.Random(seed)
    follow: dict[str, list[str]] = {}
    for a, b in zip(s, s[1:], strict=False):
        follow.setdefault(a, []).append(b)
    last: dict[str, int] = {}
    tree = {s[-1]}
    for letter in sorted(follow):
        x = letter
        while x not in tree:
            last[x] = g.randrange(len(follow[x]))
            x = follow[x][last[x]]
        x = letter
        while x not in tree:
            tree.add(x)
            x = follow[x][last[x]]
    ways = {}
    for a in sorted(follow):
        rest = list(follow[a])
        end = [rest.pop(last[a])] if a in last else []
        _shuffle(rest, g.getrandbits)
        ways[a] = iter(rest + end)
    out = [s[0]]
    for _ in range(len(s) - 1):
        out.append(next(ways[out[-1]]))
    return "".join(out)


def decoys(df: DataFrame, id_: str, sequence: str, draws: int, seed: str) -> DataFrame:
    """(id, draw, decoy): each sequence shuffled ``draws`` times; a draw's seed is
    a hash of seed, id and number, so it doesn't depend on where it is drawn."""
    each = df.select(id_, sequence, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    own = F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(seed), F.col(id_).cast("string"), F.col("draw").cast("string")), 256), 1, 15), 16, 10).cast("long")
    return each.select(id_, "draw", dinucleotide_shuffle_udf(sequence, own).alias("decoy"))


@F.pandas_udf(T.StringType())
def dinucleotide_shuffle_udf(s, seed):
    import pandas as pd

    return pd.Series([None if x is None else dinucleotide_shuffle(x, int(k)) for x, k in zip(s, seed, strict=True)])


def motif_sums(sequences: list[str], weights: np.ndarray, background: float = 1.0) -> np.ndarray:
    """ln(sum over windows and strands of exp(score) + background), vectorised
    over sequences of one length; weights are 4 x width in the order ACGT."""
    if not sequences:
        return np.zeros(0)
    width = weights.shape[1]
    code = np.frombuffer("".join(sequences).encode(), np.uint8).reshape(len(sequences), -1)
    table = np.full(256, -1)
    table[[65, 67, 71, 84]] = range(4)
    code = table[code]
    total = np.full(len(sequences), float(background))
    if code.shape[1] >= width:
        views = np.lib.stride_tricks.sliding_window_view(code, width, axis=1)
        ok = (views >= 0).all(2)
        for w in (weights, weights[::-1, ::-1]):
            score = w[np.maximum(views, 0), np.arange(width)].sum(2)
            total += np.where(ok, np.exp(score), 0).sum(1)
    return np.log(total)


def _motif(batches: Iterator[pa.RecordBatch], weights: list[list[float]], background: float) -> Iterator[pa.RecordBatch]:
    w = np.array(weights)
    for b in batches:
        texts = b.column("sequence").to_pylist()
        out = np.zeros(len(texts))
        for n in {len(t) for t in texts}:
            k = [i for i, t in enumerate(texts) if len(t) == n]
            out[k] = motif_sums([texts[i] for i in k], w, background)
        yield pa.RecordBatch.from_arrays([b.column("sequence"), pa.array(out)], ["sequence", "log_z"])


def motif_log_z(df: DataFrame, sequence: str, weights: list[list[float]], background: float = 1.0) -> DataFrame:
    """df with log_z of a motif; each distinct sequence is scored once."""
    keys = df.select(F.col(sequence).alias("sequence")).filter("sequence is not null").distinct()
    scored = keys.mapInArrow(partial(_motif, weights=weights, background=background), "sequence string, log_z double")
    return df.join(scored.withColumnRenamed("sequence", sequence), sequence, "left")


def validate_trace(events: list[dict]) -> list[str]:
    """Faults of one construction trace, by step: steps don't go back, cells are
    created once before use, segments and synapses name living cells."""
    faults, step, cells = [], -1, set()
    for e in events:
        if e["step"] < step:
            faults.append(f"step {e['step']} after {step}")
        step = max(step, e["step"])
        kind, cell = e["event"], e.get("cell")
        if kind == "cell":
            if cell in cells:
                faults.append(f"cell {cell} again")
            cells.add(cell)
        elif kind in ("segment", "synapse", "move") and cell not in cells:
            faults.append(f"{kind} of unknown cell {cell}")
        if kind == "synapse" and e.get("target") not in cells:
            faults.append(f"synapse to unknown cell {e.get('target')}")
    return faults
