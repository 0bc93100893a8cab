"""Numpy kernels used inside tasks. Each sees one block, pair or small group."""
from __future__ import annotations

import itertools

import numpy as np
import pandas as pd

NC, NS = 12, 8


#: Windows sorted at once, which bounds what a task holds beside its rows.
_WINDOWS = 2048


def sliding_lower_medians(v: np.ndarray, r: int, first: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lower medians of the r rows before each row, and of the r rows from it on, clipped at the ends of its group.

    v has one row per cell; rows first .. stop - 1 are the group of a row. A whole
    window lies before one row and after another, so it is sorted once. A row
    without any neighbour on a side gives NaN there.
    """
    n = len(v)
    at = np.arange(n)
    before, after = np.full(v.shape, np.nan), np.full(v.shape, np.nan)
    whole = np.flatnonzero(at + r <= stop)
    for k in range(0, len(whole), _WINDOWS):
        start = whole[k : k + _WINDOWS]
        m = np.sort(np.lib.stride_tricks.sliding_window_view(v, r, axis=0)[start], axis=2)[:, :, (r - 1) // 2]
        after[start] = m
        on = start + r < stop[start]
        before[start[on] + r] = m[on]
    for count in range(1, r):  # windows that an end clips to `count` rows
        for out, rows, low in ((before, np.flatnonzero(at - first == count), -count), (after, np.flatnonzero(stop - at == count), 0)):
            for k in range(0, len(rows), _WINDOWS):
                own = rows[k : k + _WINDOWS]
                out[own] = np.sort(v[own[:, None] + np.arange(low, low + count)], axis=1)[:, (count - 1) // 2]
    return before, after


def cosine_distance(a: np.ndarray, b: np.ndarray, floor: float) -> np.ndarray:
    """Row-wise 1 - cosine with the cosine clipped to [floor, 1]; 0 for two empty rows, 1 for one."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    ea, eb = na <= 1e-12, nb <= 1e-12
    with np.errstate(invalid="ignore", divide="ignore"):
        c = np.clip((a * b).sum(1) / (na * nb), floor, 1.0)
    d = (1 - c) if floor == 0 else (1 - c) / 2
    return np.where(ea & eb, 0.0, np.where(ea | eb, 1.0, d))


def novelty_of_blocks(v: np.ndarray, r: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Weighted change of medians at every boundary of dense blocks of cells; rows first .. stop - 1 are the block of a row."""
    a, b = sliding_lower_medians(v, r, first, stop)
    dc = cosine_distance(a[:, :NC], b[:, :NC], 0.0)
    ds = cosine_distance(a[:, NC:NC + NS], b[:, NC:NC + NS], -1.0)
    act, flux = NC + NS, NC + NS + 1
    da = np.abs(a[:, act] - b[:, act])
    df = np.abs(a[:, flux] - b[:, flux]) / (np.abs(a[:, flux]) + np.abs(b[:, flux]) + 1e-12)
    return 0.5 * dc + 0.3 * ds + 0.1 * da + 0.1 * df


BAND = 4            # warping band in bins
MIN_VALID, MAX_GAP = 24, 4


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All pairwise row cosines; 0 where a row is empty."""
    na, nb = np.sqrt((a * a).sum(1)), np.sqrt((b * b).sum(1))
    with np.errstate(invalid="ignore", divide="ignore"):
        c = (a @ b.T) / np.outer(na, nb)
    return np.where(np.outer(na > 1e-12, nb > 1e-12), c, 0.0)


def warp_cost(local: np.ndarray, at: np.ndarray) -> float:
    """Mean local cost along the cheapest monotone path inside the band; NaN without a path.

    Ties prefer the diagonal, then a step in the first sequence.
    """
    n = len(at)
    cost, length = np.full((n + 1, n + 1), np.inf), np.zeros((n + 1, n + 1), dtype=int)
    cost[0, 0] = 0.0
    for i in range(n):
        for j in range(max(0, i - BAND), min(n, i + BAND + 1)):
            if abs(at[i] - at[j]) > BAND:
                continue
            best, steps = cost[i, j], length[i, j]
            for c, s in ((cost[i, j + 1], length[i, j + 1]), (cost[i + 1, j], length[i + 1, j])):
                if c < best - 1e-12:
                    best, steps = c, s
            if np.isfinite(best):
                cost[i + 1, j + 1], length[i + 1, j + 1] = best + local[i, j], steps + 1
    return cost[n, n] / length[n, n] if length[n, n] else float("nan")


def compare_bins(a: np.ndarray, b: np.ndarray, ratio: float, low: float = 0.75, high: float = 1.33) -> tuple:
    """Scores of two 32 x 21 bin tables: (harmonic, timbre, alignment, combined, rotation, valid, reason)."""
    reject = lambda why, n=0, r=0: (0.0, 0.0, 0.0, 0.0, r, n, why)
    if not low <= ratio <= high:
        return reject("duration_ratio")
    a, b = a.reshape(-1, NC + NS + 1), b.reshape(-1, NC + NS + 1)
    ca, cb, sa, sb, aa, ab = a[:, :NC], b[:, :NC], a[:, NC:NC + NS], b[:, NC:NC + NS], a[:, -1], b[:, -1]
    ok = np.ones(len(a), dtype=bool)
    for m in (ca, cb, sa, sb):
        ok &= np.sqrt((m * m).sum(1)) > 1e-12
    at = np.flatnonzero(ok)
    n = len(at)
    if n < MIN_VALID:
        return reject("insufficient_valid_bins", n)
    gaps = np.diff(np.concatenate([[-1], at, [len(a)]])) - 1
    if gaps.max() > MAX_GAP:
        return reject("invalid_bin_run", n)
    rot = np.stack([np.diag(_cosines(ca[at], np.roll(cb[at], -r, axis=1))) for r in range(NC)])
    means = np.clip(rot, 0, 1).mean(1)
    best = 0
    for r in range(1, NC):
        if means[r] > means[best] + 1e-12:
            best = r
    if best and ((rot[best] >= rot.max(0) - 1e-12).sum() * 5 < n * 4):
        return reject("ambiguous", n, best)
    rho = n / len(a)
    harmonic = rho * float(np.clip(means[best] - (0.05 if best else 0.0), 0, 1))
    ss = np.clip(_cosines(sa[at], sb[at]), -1, 1)
    act = np.abs(aa[at][:, None] - ab[at][None, :])
    timbre = rho * float((0.8 * (1 + np.diag(ss)) / 2 + 0.2 * (1 - np.diag(act))).mean())
    local = 0.5 * (1 - np.clip(_cosines(ca[at], np.roll(cb[at], -best, axis=1)), 0, 1)) + 0.3 * (1 - (1 + ss) / 2) + 0.2 * act
    path = warp_cost(local, at)
    if not np.isfinite(path):
        return reject("non_finite", n, best)
    alignment = rho * float(np.clip(1 - path, 0, 1))
    return harmonic, timbre, alignment, min(harmonic, timbre + 0.05, alignment + 0.03), best, n, "none"


def complete_linkage(n: int, ok: np.ndarray, score: np.ndarray) -> list[list[int]]:
    """Agglomerate while every cross pair of two clusters is allowed; best cohesion first.

    Equal cohesion prefers the larger, then the lexicographically first merger.
    """
    groups = [[i] for i in range(n)]
    inner = [1.0] * n
    while True:
        best = None
        for i in range(len(groups)):
            for j in range(i + 1, len(groups)):
                block = np.ix_(groups[i], groups[j])
                if not ok[block].all():
                    continue
                cohesion = min(float(score[block].min()), inner[i], inner[j])
                merged = sorted(groups[i] + groups[j])
                rank = (-round(cohesion, 12), -len(merged), merged)
                if best is None or rank < best[0]:
                    best = (rank, i, j, cohesion)
        if best is None:
            return groups
        _, i, j, cohesion = best
        groups[i], inner[i] = sorted(groups[i] + groups[j]), cohesion
        del groups[j], inner[j]


# --- ordered folds --------------------------------------------------------------------

TINY = 36.8  # exp(-36.8) is below double rounding


def warmup(slowest_seconds: float, rate: float) -> int:
    """Cells after which a follower has forgotten any start value to double precision."""
    return int(np.ceil(TINY * max(slowest_seconds, 1e-9) * rate)) + 1


def follow_down(x: np.ndarray, attack: float, release: float, start: float = 1.0) -> np.ndarray:
    """One-pole follower of a gain: `attack` while falling, `release` while rising."""
    out, env = np.empty(len(x)), start
    for i, t in enumerate(x):
        env = t + (attack if t < env else release) * (env - t)
        out[i] = env
    return out


def follow_size(x: np.ndarray, attack: float, release: float) -> np.ndarray:
    """Followers of every column of x that engage while the magnitude grows and relax
    otherwise; each starts on its first value."""
    out, g = np.empty_like(x), x[0]
    for i, d in enumerate(x):
        g = d + np.where(np.abs(d) > np.abs(g), attack, release) * (g - d)
        out[i] = g
    return out


def sustain_peak(frames: np.ndarray, a: np.ndarray, attack: float, release: float) -> float:
    """Largest value of an attack/release envelope of sparse magnitudes; silence between them decays in closed form."""
    env, best, last = 0.0, 0.0, None
    for f, v in zip(frames, a):
        if last is not None and f > last + 1:
            env *= release ** (f - last - 1)
        env = v + (attack if v > env else release) * (env - v)
        best = max(best, env)
        last = f
    return best


def _trailing_mean(x: np.ndarray, n: int) -> np.ndarray:
    """Mean of each value and the n - 1 before it; unity stands before the first."""
    sums = np.cumsum(np.concatenate([np.zeros(1), np.ones(n - 1), x]))
    return (sums[n:] - sums[:-n]) / n


def limiter_envelope(peaks: np.ndarray, threshold: float, attack: int, release: float) -> np.ndarray:
    """Look-ahead limiter gain of each cell.

    Works on the reduction (1 - gain) each cell needs: it holds for `attack` cells
    before the peak, decays by the release after it, is smoothed by two means that
    together span the attack, and never falls short of the cell's own need.
    """
    n, reach = len(peaks), max(1, attack)
    with np.errstate(divide="ignore"):
        reduction = np.maximum(0.0, 1 - threshold / np.maximum(peaks, threshold)) if threshold > 0 else (peaks > 0).astype(float)
    ahead = np.pad(reduction, reach)
    held = pd.Series(ahead[::-1]).rolling(reach + 1, min_periods=1).max().to_numpy()[::-1][: n + reach]
    keep = np.exp(-1.0 / max(1.0, release))
    decayed = np.fromiter(itertools.accumulate(held, lambda past, now: max(now, keep * past + (1 - keep) * now), initial=0.0), float, len(held) + 1)[1:]
    short = reach // 2 + 1
    smooth = _trailing_mean(_trailing_mean(1 - decayed, short), reach + 2 - short)[reach:]
    return np.clip(np.minimum(smooth, 1 - reduction), 0.0, 1.0)


def largest_scale(energy: np.ndarray, extra: np.ndarray, limit: float) -> float:
    """Largest k in [0, 1] with sum(energy * (1 + k * extra)^2) at most the limit (0 if none is)."""
    linear, square = 2 * float(energy @ extra), float(energy @ extra**2)
    room = limit - float(energy.sum())
    if linear + square <= max(room, 0.0):
        return 1.0
    if room <= 0:
        return 0.0
    return min(1.0, 2 * room / (linear + np.sqrt(linear**2 + 4 * square * room)))


def bound_energy(gains: np.ndarray, energy: np.ndarray, frames: np.ndarray, width: int, target: float, starts: np.ndarray) -> np.ndarray:
    """Gains at cell edges, moved towards unity until no window of `width` cells holds more than the target power.

    `gains` has one more point than there are cells; `starts` are the windows in
    the order of their visit. A cell counts with the larger gain of its two edges.
    """
    over = gains - 1.0
    for cells in (slice(int(s), int(s) + width) for s in starts):
        edges = slice(cells.start, cells.stop + 1)
        extra = np.lib.stride_tricks.sliding_window_view(over[edges], 2).max(axis=1)
        over[edges] *= largest_scale(energy[cells], extra, target * float(frames[cells].sum()))
    return over + 1.0


# --- ramps ----------------------------------------------------------------------------

def _clip_db(x: np.ndarray) -> np.ndarray:
    return np.clip(x, -6.0, 3.0)


def _reserve(weighted: np.ndarray, q: np.ndarray, seconds: float) -> np.ndarray:
    """Transition time wanted at each edge of a component."""
    w, v = np.concatenate([[0.0], weighted, [0.0]]), np.concatenate([[0.0], np.abs(q), [0.0]])
    return np.where(w[:-1] == w[1:], 0.0, np.maximum(seconds, 0.75 * (v[:-1] + v[1:])))


def _fits(length: np.ndarray, reserve: np.ndarray, rate: int) -> bool:
    half = reserve / 2
    half[0], half[-1] = reserve[0], reserve[-1]
    return bool(np.all(rate * (half[:-1] + half[1:]) <= length))


def ramp_component(start: np.ndarray, end: np.ndarray, weighted: np.ndarray, rate: int, leveling: float, speed: float) -> tuple[list[tuple], float]:
    """Gain pieces (start, end, from dB, to dB, shape) and capacity of one run of free segments.

    The common amount is the largest share, up to the control, whose transitions
    fit into the segments.
    """
    seconds, length = 4 * 0.1875**speed, (end - start).astype(float)

    def fits(k: float) -> bool:
        return _fits(length, _reserve(weighted, _clip_db(k * weighted), seconds), rate)

    cap = 0.0
    if fits(0.0):
        if fits(1.0):
            cap = 1.0
        else:
            lo, hi = 0.0, 1.0
            for _ in range(60):
                mid = lo + (hi - lo) / 2
                lo, hi = (mid, hi) if fits(mid) else (lo, mid)
            cap = lo
    q = _clip_db(min(leveling, cap) * weighted)
    if not np.any(q):
        return [], cap
    r = _reserve(weighted, q, seconds) * rate
    n = len(q)
    edge_from = np.concatenate([[start[0]], end[:-1] - r[1:-1] / 2, [end[-1] - r[-1]]])
    edge_to = np.concatenate([[start[0] + r[0]], end[:-1] + r[1:-1] / 2, [end[-1]]])
    level = np.concatenate([[0.0], q, [0.0]])
    pieces: list[tuple] = []
    for i in range(n + 1):
        if edge_to[i] > edge_from[i] and (level[i] or level[i + 1]):
            pieces.append((edge_from[i], edge_to[i], level[i], level[i + 1], "HOLD" if level[i] == level[i + 1] else "SMOOTHSTEP"))
        if i < n and edge_from[i + 1] > edge_to[i] and level[i + 1]:
            pieces.append((edge_to[i], edge_from[i + 1], level[i + 1], level[i + 1], "HOLD"))
    return pieces, cap


# --- PCM ------------------------------------------------------------------------------

# The two weighting biquads at 48 kHz as b0, b1, b2, a1, a2.
SHELF_48K = (1.53512485958697, -2.69169618940638, 1.19839281085285, -1.69065929318241, 0.73248077421585)
HIGHPASS_48K = (1.0, -2.0, 1.0, -1.99004745483398, 0.99007225036621)


def rewarp(q: tuple[float, ...], rate: float) -> np.ndarray:
    """The same analogue biquad at another rate (inverse then forward bilinear transform)."""
    if rate == 48000:
        return np.array(q)
    k = rate / 48000.0
    # z^-1 at 48 kHz in terms of z^-1 at the new rate: ((1 - k) + (1 + k) z) / ((1 + k) + (1 - k) z).
    num, den = np.array([1 - k, 1 + k]), np.array([1 + k, 1 - k])
    powers = [np.convolve(den, den), np.convolve(num, den), np.convolve(num, num)]
    b = sum(c * p for c, p in zip(q[:3], powers))
    a = sum(c * p for c, p in zip((1.0, q[3], q[4]), powers))
    return np.concatenate([b / a[0], a[1:] / a[0]])


def weighting(rate: float) -> tuple[np.ndarray, np.ndarray]:
    s, h = rewarp(SHELF_48K, rate), rewarp(HIGHPASS_48K, rate)
    h[1], h[2] = -2 * h[0], h[0]  # keep the exact double zero at DC
    return s, h


def weigh(x: np.ndarray, rate: float, state: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Both biquads over every row of x at once; returns the output and the four end states per row."""
    s, h = weighting(rate)
    z = np.zeros((4, len(x))) if state is None else state.T.copy()
    y = np.empty_like(x)
    for i in range(x.shape[1]):
        v = x[:, i]
        u = s[0] * v + z[0]
        z[0] = s[1] * v - s[3] * u + z[1]
        z[1] = s[2] * v - s[4] * u
        w = h[0] * u + z[2]
        z[2] = h[1] * u - h[3] * w + z[3]
        z[3] = h[2] * u - h[4] * w
        y[:, i] = w
    return y, z.T


def transition(rate: float, n: int) -> np.ndarray:
    """How n silent frames carry the four states forward (columns are unit states)."""
    _, end = weigh(np.zeros((4, n)), rate, np.eye(4))
    return end.T


#: Samples a row, on average, up to which their echoes are added up instead of filtering every frame.
FEW = 4


def echoes(rate: float, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """What weigh() makes over `width` frames of a unit sample at each of them, of the four unit states, and the end states of those samples."""
    one = np.zeros((1, width))
    one[0, 0] = 1.0
    heard = np.concatenate([np.zeros(width - 1), weigh(one, rate)[0][0]])
    echo = np.lib.stride_tricks.sliding_window_view(heard, width)[::-1]
    rest, step = np.empty((width, 4)), transition(rate, 1)
    rest[-1] = weigh(np.ones((1, 1)), rate)[1][0]
    for p in range(width - 2, -1, -1):
        rest[p] = step @ rest[p + 1]
    return echo, weigh(np.zeros((4, width)), rate, np.eye(4))[0], rest


def weigh_sparse(count: np.ndarray, pos: np.ndarray, x: np.ndarray, state: np.ndarray, rate: float, echo: np.ndarray, ringing: np.ndarray) -> np.ndarray:
    """Outputs of weigh() for rows of `count` samples x at pos, from these states; the rest as echoes() gives it."""
    if len(pos) > FEW * len(count):
        v = np.zeros((len(count), echo.shape[1]))
        v[np.repeat(np.arange(len(count)), count), pos] = x
        return weigh(v, rate, state)[0]
    y, some = state @ ringing, count > 0
    if len(pos):
        y[some] += np.add.reduceat(x[:, None] * echo[pos], (np.cumsum(count) - count)[some], axis=0)
    return y


def hann(n: int) -> np.ndarray:
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(n) / (n - 1))
