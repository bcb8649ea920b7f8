"""Kernels over signals: spectra, bands, hum, loudness, filters and repairs. Numpy inside Arrow batches, one clip at a time.

A clip is a row (keys, samples ARRAY<FLOAT>, or packed where it says so); clips are bounded by their length, and nothing is gathered across them.
Coefficients are the published audio-equaliser formulas and the loudness standard's two filters.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def packed(x: np.ndarray) -> bytes:
    """A clip's samples as the bytes of 32-bit floats: between two passes of Python an array is taken apart to objects, bytes are copied."""
    return np.asarray(x, "<f4").tobytes()


def unpacked(x: np.ndarray | bytes) -> np.ndarray:
    """Samples as doubles, packed or not."""
    return np.asarray(np.frombuffer(x, "<f4") if isinstance(x, bytes | bytearray | memoryview) else x, float)


def response(b: np.ndarray, a: np.ndarray, n: int) -> np.ndarray:
    """Frequency response of b/a at the bins of a real transform of n."""
    z = np.exp(-2j * np.pi * np.arange(n // 2 + 1) / n)
    return np.polyval(b[::-1], z) / np.polyval(a[::-1], z)


@lru_cache(maxsize=8)
def _response(sections: tuple, n: int) -> np.ndarray:
    """Response of sections in a row, kept for the clips of like length that follow."""
    h = np.ones(n // 2 + 1, complex)
    for b, a in sections:
        h = h * response(np.array(b), np.array(a), n)
    return h


def apply_filter(x: np.ndarray, *sections: tuple) -> np.ndarray:
    """Recursive sections over a whole signal, by their response over twice its length (their tail dies out there)."""
    n = 1 << int(np.ceil(np.log2(max(2 * len(x), len(x) + 65536))))
    h = _response(tuple(tuple(tuple(map(float, c)) for c in s) for s in sections), n)
    return np.fft.irfft(np.fft.rfft(x, n) * h, n)[: len(x)]


#: Samples that a filter takes in one step, and steps whose states are found side by side.
STEP, GROUP = 64, 32


class Cascade:
    """Second-order sections in a row as one linear system, and STEP samples of it as one product of matrices."""

    def __init__(self, sections: tuple[tuple, ...]):
        self.sections = [(np.pad(np.asarray(b, float), (0, 3 - len(b))) / a[0], np.pad(np.asarray(a, float), (0, 3 - len(a))) / a[0]) for b, a in sections]
        self.settles = all(abs(a[2]) < 1 and abs(a[1]) < 1 + a[2] for _, a in self.sections)
        n = self.order = 2 * len(self.sections)
        # state after, and output of, one sample for each unit state and a unit input
        rows = [self._one(state, x) for state, x in [*((row, 0.0) for row in np.eye(n)), (np.zeros(n), 1.0)]]
        self.a = np.array([r[0] for r in rows[:n]]).T
        b, c, d = rows[n][0], np.array([r[1] for r in rows[:n]]), rows[n][1]
        a_step = np.linalg.matrix_power(self.a, STEP)
        self.steps = np.array([np.linalg.matrix_power(a_step, k) for k in range(GROUP + 1)])  # of the state so many steps before
        seen, pushed = [c], [b]
        for _ in range(STEP - 1):
            seen.append(seen[-1] @ self.a)
            pushed.append(self.a @ pushed[-1])
        self.seen = np.array(seen)  # of the state in each output
        self.pushed = np.array(pushed[::-1])  # of each input in the state after
        hit = np.array([d, *[s @ b for s in seen[:-1]]])
        self.hit = np.array([np.concatenate([np.zeros(k), hit[: STEP - k]]) for k in range(STEP)])  # of each input in each output

    def _one(self, state: np.ndarray, x: float) -> tuple[np.ndarray, float]:
        after = np.empty(len(state))
        for k, (b, a) in enumerate(self.sections):
            one, two = state[2 * k : 2 * k + 2]
            y = b[0] * x + one
            after[2 * k : 2 * k + 2] = b[1] * x - a[1] * y + two, b[2] * x - a[2] * y
            x = y
        return after, x

    @lru_cache(maxsize=64)  # noqa: B019  a cascade lives as long as its batch
    def power(self, n: int) -> np.ndarray:
        return np.linalg.matrix_power(self.a, n)

    def _states(self, fresh: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The state before each step, from what each step adds, and the state after the last: groups of steps side by side from zero,
        then what the groups before leave."""
        n = len(fresh)
        held = np.zeros((-(-n // GROUP), GROUP, self.order))
        held.reshape(-1, self.order)[:n] = fresh
        own, now = np.empty_like(held), np.zeros((len(held), self.order))
        for k in range(GROUP):
            own[:, k] = now
            now = now @ self.steps[1].T + held[:, k]
        led = np.empty_like(now)
        for k in range(len(led)):
            led[k] = state
            state = self.steps[GROUP] @ state + now[k]
        own += np.einsum("gj,kij->gki", led, self.steps[:GROUP], optimize=True)
        states = own.reshape(-1, self.order)[:n]
        return states, self.steps[1] @ states[-1] + fresh[-1]

    def run(self, x: np.ndarray, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Outputs of a block that begins in a state, and the state after it."""
        x, state = np.asarray(x, float), np.asarray(state, float)
        whole = len(x) // STEP * STEP
        out = np.empty(len(x))
        if whole:
            parts = x[:whole].reshape(-1, STEP)
            states, state = self._states(parts @ self.pushed, state)
            out[:whole] = (parts @ self.hit + states @ self.seen.T).reshape(-1)
        if n := len(x) - whole:
            rest = x[whole:]
            out[whole:] = rest @ self.hit[:n, :n] + self.seen[:n] @ state
            state = np.linalg.matrix_power(self.a, n) @ state + rest @ self.pushed[STEP - n :]
        return out, state


@lru_cache(maxsize=32)
def _cascade(sections: tuple) -> Cascade:
    """Sections in a row, kept for the clips that follow."""
    with np.errstate(over="ignore", invalid="ignore"):  # powers of those that do not settle
        return Cascade(sections)


def recursed(x: np.ndarray, *sections: tuple) -> np.ndarray:
    """Recursive sections over a whole signal that begins at rest, by steps. Those that grow without end (a corner above half the rate)
    are left to their response."""
    own = _cascade(tuple(tuple(tuple(map(float, c)) for c in s) for s in sections))
    return own.run(x, np.zeros(own.order))[0] if own.settles else apply_filter(x, *sections)


def _rounds(held: np.ndarray, first: float, lead: np.ndarray, began: np.ndarray, rise: float, fall: float, near: float) -> tuple[np.ndarray, np.ndarray]:
    """States after each sample of stretches (columns of ``held``, a signal's in a row, its first marked by lead), and what they begin with:
    Newton's rule from ``began`` on, until no beginning moves by more than a share ``near`` of it."""
    size, n = held.shape
    out, both = np.empty_like(held), np.maximum if rise >= fall else np.minimum
    by_rise, by_fall, d = np.empty(n), np.empty(n), np.empty(n)
    for _ in range(n + 1):  # each round settles one more stretch of each signal at least
        state = began
        for v, to in zip(held, out):
            np.subtract(v, state, out=d)
            np.multiply(d, rise, out=by_rise)
            np.multiply(d, fall, out=by_fall)
            state = np.add(state, both(by_rise, by_fall, out=by_rise), out=to)
        above = np.count_nonzero(held[1:] > out[:-1], axis=0) + (held[0] > began)
        slope = (1 - rise) ** above * (1 - fall) ** (size - above)
        now, better = first, []
        for leads, start, end, s in zip(lead.tolist(), began.tolist(), state.tolist(), slope.tolist()):
            now = first if leads else now
            better.append(now)
            now = end + s * (now - start)
        was, began = began, np.array(better)
        if ((np.abs(began - was) <= near * np.abs(began) + 1e-300) | (began == was) | (np.isnan(began) & np.isnan(was))).all():
            break
    return out, began


def followed(signals: list[np.ndarray], rise: float, fall: float, first: float) -> list[np.ndarray]:
    """One-pole smoothing of each signal from ``first`` on: rises and falls by its own share (0..1) of the distance, sample by sample.

    All signals' stretches are followed side by side. A stretch's end is an increasing function of the state it begins with and piecewise
    linear, so the states at the stretches' borders are bettered by Newton's rule until they are those of the sequence. The first
    guess is what one sample in eight makes of them.
    """
    size = int(min(512, max(16, sum(map(len, signals)) ** 0.5))) // 8 * 8
    ends = np.cumsum([0, *(-(-len(x) // size) for x in signals)])
    held = np.zeros((ends[-1], size))
    for x, a, b in zip(signals, ends, ends[1:]):
        held[a:b].reshape(-1)[: len(x)] = x
    held = np.ascontiguousarray(held.T)
    lead = np.isin(np.arange(ends[-1]), ends)
    _, began = _rounds(held[::8], first, lead, np.full(ends[-1], float(first)), 1 - (1 - rise) ** 8, 1 - (1 - fall) ** 8, 1e-3)
    out = _rounds(held, first, lead, began, rise, fall, 1e-13)[0].T
    return [out[a:b].reshape(-1)[: len(x)] for x, a, b in zip(signals, ends, ends[1:])]


def _rbj(f0: float, rate: float, q: float):
    w = 2 * np.pi * f0 / rate
    return np.cos(w), np.sin(w) / (2 * q), w


def lowpass(f0: float, rate: float, q: float = 0.7071):
    c, al, _ = _rbj(f0, rate, q)
    return np.array([(1 - c) / 2, 1 - c, (1 - c) / 2]) / (1 + al), np.array([1 + al, -2 * c, 1 - al]) / (1 + al)


def highpass(f0: float, rate: float, q: float = 0.7071):
    c, al, _ = _rbj(f0, rate, q)
    return np.array([(1 + c) / 2, -(1 + c), (1 + c) / 2]) / (1 + al), np.array([1 + al, -2 * c, 1 - al]) / (1 + al)


def notch(f0: float, rate: float, q: float = 20.0):
    c, al, _ = _rbj(f0, rate, q)
    return np.array([1, -2 * c, 1]) / (1 + al), np.array([1 + al, -2 * c, 1 - al]) / (1 + al)


def peaking(f0: float, rate: float, q: float, gain: float):
    c, al, _ = _rbj(f0, rate, q)
    g = 10 ** (gain / 40)
    return np.array([1 + al * g, -2 * c, 1 - al * g]) / (1 + al / g), np.array([1 + al / g, -2 * c, 1 - al / g]) / (1 + al / g)


def highshelf(f0: float, rate: float, gain: float, q: float = 0.7071):
    c, al, _ = _rbj(f0, rate, q)
    g = 10 ** (gain / 40)
    r = 2 * np.sqrt(g) * al
    a0 = (g + 1) - (g - 1) * c + r
    return np.array([g * ((g + 1) + (g - 1) * c + r), -2 * g * ((g - 1) + (g + 1) * c), g * ((g + 1) + (g - 1) * c - r)]) / a0, np.array([a0, 2 * ((g - 1) - (g + 1) * c), (g + 1) - (g - 1) * c - r]) / a0


def dc_block(rate: float, f0: float = 20.0):
    k = np.exp(-2 * np.pi * f0 / rate)
    return np.array([1.0, -1.0]), np.array([1.0, -k])


#: The loudness standard's pre-filter and its high-pass at 48 kHz.
K_WEIGHTING = (
    ((1.53512485958697, -2.69169618940638, 1.19839281085285), (1.0, -1.69065929318241, 0.73248077421585)),
    ((1.0, -2.0, 1.0), (1.0, -1.99004745483398, 0.99007225036621)),
)


def loudness(x: np.ndarray, rate: int = 48_000) -> float | None:
    """Integrated loudness of a mono signal at 48 kHz: 400 ms blocks by 100 ms, gated at -70 and ten below the rest; null if too short."""
    size, hop = int(0.4 * rate), int(0.1 * rate)
    if len(x) < size:
        return None
    p = np.cumsum(np.concatenate([[0.0], recursed(x, *K_WEIGHTING) ** 2]))
    starts = np.arange(0, len(x) - size + 1, hop)
    power = (p[starts + size] - p[starts]) / size
    level = -0.691 + 10 * np.log10(power + 1e-30)
    kept = power[level > -70]
    if not len(kept):
        return None
    kept = power[(level > -70) & (level > -0.691 + 10 * np.log10(kept.mean()) - 10)]
    return float(-0.691 + 10 * np.log10(kept.mean()))


def band_db(x: np.ndarray, rate: float, low: float, high: float) -> float:
    """Level of a band of the whole signal; minus infinity for fewer than 64 samples."""
    if len(x) < 64:
        return float("-inf")
    p, f = np.abs(np.fft.rfft(x)) ** 2 / len(x) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    return float(10 * np.log10(p[(f >= low) & (f < high)].sum() + 1e-30))


def flatness_db(x: np.ndarray, rate: float, low: float, high: float) -> float:
    p, f = np.abs(np.fft.rfft(x)) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    p = p[(f >= low) & (f < high)] + 1e-30
    return float(10 * np.log10(np.exp(np.log(p).mean()) / p.mean()))


def hum_db(x: np.ndarray, rate: float) -> dict[str, float]:
    """Strongest level within 2 Hz of 50, 100 and 150 Hz."""
    p, f = np.abs(np.fft.rfft(x)) ** 2 / len(x) ** 2, np.fft.rfftfreq(len(x), 1 / rate)
    return {f"h{k}": float(10 * np.log10(p[np.abs(f - k) <= 2].max(initial=0.0) + 1e-30)) for k in (50, 100, 150)}


def declip(x: np.ndarray, share: float = 1e-6) -> np.ndarray:
    """Flat stretches at the signal's ceiling (two samples or more) replaced by a cubic through two samples on each side."""
    x = np.array(x, float)
    top = np.abs(x).max(initial=0.0)
    flat = np.abs(np.abs(x) - top) <= share
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flat.astype(np.int8), [0]])))
    for a, b in zip(edge[::2], edge[1::2]):
        around = np.array([a - 2, a - 1, b, b + 1])
        if b - a >= 2 and around[0] >= 0 and around[-1] < len(x):
            x[a:b] = np.polyval(np.polyfit(around - a, x[around], 3), np.arange(b - a))
    return x


def gain_region(x: np.ndarray, start: int, end: int, db: float, fade: int) -> np.ndarray:
    """A region turned up or down, with linear fades inside it; outside nothing changes."""
    g = 10 ** (db / 20)
    n = end - start
    ramp = np.minimum(1.0, np.minimum(np.arange(1, n + 1), np.arange(n, 0, -1)) / max(1, fade))
    out = np.array(x, float)
    out[start:end] *= 1 + (g - 1) * ramp
    return out


def mix_at(x: np.ndarray, element: np.ndarray, at: int, gain_db: float = 0.0, duck_db: float = 0.0) -> np.ndarray:
    """A short signal laid over a long one, which is ducked there; outside the region bit for bit as it was."""
    out, end = np.array(x, float), min(len(x), at + len(element))
    out[at:end] = np.clip(out[at:end] * 10 ** (duck_db / 20) + element[: end - at] * 10 ** (gain_db / 20), -1, 1)
    return out


def measure(clips: DataFrame, keys: list[str], rate: int = 48_000) -> DataFrame:
    """Loudness, true-peak-like and band figures of each clip."""
    names = ["lufs", "rms_db", "clip_ratio", "low_db", "mid_db", "high_db", "flatness_db", "h50", "h100", "h150"]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for batch in batches:
            rows = []
            for *key, samples in batch[[*keys, "samples"]].itertuples(index=False):
                x = np.asarray(samples, float)
                hum = hum_db(x, rate) if len(x) else {f"h{k}": None for k in (50, 100, 150)}
                rows.append((*key, loudness(x, rate), 20 * np.log10(np.sqrt((x**2).mean()) + 1e-12) if len(x) else None, float((np.abs(x) >= 0.999).mean()) if len(x) else None, band_db(x, rate, 20, 250), band_db(x, rate, 250, 4000), band_db(x, rate, 4000, 16000), flatness_db(x, rate, 100, 10000) if len(x) else None, *hum.values()))
            yield pd.DataFrame(rows, columns=[*keys, *names])

    schema = clips.select(*keys).schema
    for n in names:
        schema = schema.add(n, "double")
    return clips.select(*keys, "samples").mapInPandas(run, schema)


def transform(clips: DataFrame, kernel: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Clips with their samples run through a kernel."""
    from pyspark.sql.types import ArrayType, FloatType

    fn = F.pandas_udf(lambda s: s.map(lambda x: kernel(np.asarray(x, float)).astype(np.float32)), ArrayType(FloatType()))
    return clips.withColumn("samples", fn("samples"))


def spectrum(frames: DataFrame, keys: list[str], at: str, value: str, size: int, bins: list[int]) -> DataFrame:
    """Power of single bins of frames of ``size`` places, from sums of sines: built-in functions only, for a few bins."""
    angle = lambda k: F.lit(2 * np.pi * k / size) * (F.col(at) % size)
    sums = [F.sum(F.col(value) * fn(angle(k))).alias(f"{n}{k}") for k in bins for n, fn in (("c", F.cos), ("s", F.sin))]
    held = frames.withColumn("frame", F.floor(F.col(at) / size).cast("long")).groupBy(*keys, "frame").agg(F.count("*").alias("__n"), *sums).filter(F.col("__n") == size)
    return held.select(*keys, "frame", *[((F.col(f"c{k}") ** 2 + F.col(f"s{k}") ** 2) / size**2).alias(f"p{k}") for k in bins])
