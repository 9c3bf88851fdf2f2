"""Linear-chain conditional random fields in numpy: training, forward-backward and Viterbi over many chains at once.

A chain is a row of a matrix of emissions [chains, places, labels]; lengths tell how much of each row counts. All chains of
a batch advance together, one place a step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def forward_backward(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Posteriors [chains, places, labels], expected transitions [labels, labels] and the sum of log normalisers. Emissions
    and transitions are scores; places beyond a chain's length get 0."""
    n, width, k = emissions.shape
    top = emissions.max(axis=2, keepdims=True)
    e = np.exp(emissions - top)
    step = np.exp(transitions)
    alpha = np.zeros_like(e)
    scale = np.ones((n, width), dtype=e.dtype)
    order = np.argsort(-lengths, kind="stable")
    e, ordered = e[order], lengths[order]
    at_least = [int(np.searchsorted(-ordered, -t, side="left")) for t in range(width + 1)]  # chains longer than t
    for t in range(width):
        m = at_least[t]
        if not m:
            break
        a = e[:m, t] if t == 0 else (alpha[:m, t - 1] @ step) * e[:m, t]
        s = a.sum(axis=1)
        alpha[:m, t], scale[:m, t] = a / s[:, None], s
    post = np.zeros_like(e)
    beta = np.ones((n, k), dtype=e.dtype)
    expected = np.zeros((k, k))
    for t in range(width - 1, -1, -1):
        m, after = at_least[t], at_least[t + 1] if t + 1 <= width else 0
        if not m:
            continue
        if t + 1 < width and after:
            right = e[:after, t + 1] * beta[:after] / scale[:after, t + 1][:, None]
            expected += (alpha[:after, t].T @ right) * step
            beta[:after] = right @ step.T
        post[:m, t] = alpha[:m, t] * beta[:m]
    out = np.empty_like(post)
    out[order] = post
    inside = np.arange(width)[None, :] < lengths[:, None]
    total = np.log(scale).sum() + top[:, :, 0][inside].sum()
    return out, expected, float(total)


def chain_posteriors(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = 64) -> np.ndarray:
    """Posteriors [places, labels] of chains of any length, laid end to end: the same as forward_backward's, but all blocks of all
    chains advance together.

    A block's product of transition matrices carries messages over it, so a first pass gives what reaches each block from either
    side, and the second runs within the blocks."""
    k = emissions.shape[1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros((0, k), dtype=emissions.dtype)
    counts = -(-lengths // block)
    chain = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts  # each chain's first block
    turn = np.arange(len(chain)) - first[chain]
    start = (np.cumsum(lengths) - lengths)[chain] + turn * block
    size = np.minimum(block, lengths[chain] - turn * block)
    inside = np.arange(block)[None, :] < size[:, None]
    places = np.where(inside, start[:, None] + np.arange(block)[None, :], 0)
    e = np.exp(emissions - emissions.max(axis=1, keepdims=True))[places]
    step = np.exp(transitions).astype(e.dtype)
    begins = turn == 0

    def ahead(now: np.ndarray, j: int) -> np.ndarray:
        """Row vectors ``now`` [blocks, any, labels] moved over place j of each block; a chain's first place has no transition."""
        moved = (now.reshape(-1, k) @ step).reshape(now.shape)
        if j == 0:
            moved[begins] = now[begins]
        moved *= e[:, j, None, :]
        moved /= moved.sum(axis=(1, 2), keepdims=True)
        return np.where(inside[:, j, None, None], moved, now)

    left = np.ones((len(chain), k), dtype=e.dtype)
    right = np.ones((len(chain), k), dtype=e.dtype)
    if counts.max() > 1:
        several = np.flatnonzero(counts[chain] > 1)
        keep = e, inside, begins
        e, inside, begins = e[several], inside[several], begins[several]
        over = np.broadcast_to(np.eye(k, dtype=e.dtype), (len(several), k, k)).copy()
        for j in range(block):
            over = ahead(over, j)
        e, inside, begins = keep
        at = np.full(len(chain), -1)
        at[several] = np.arange(len(several))
        for d in range(1, int(counts.max())):
            b = first[counts > d] + d
            left[b] = (left[b - 1][:, None, :] @ over[at[b - 1]])[:, 0]
            left[b] /= left[b].sum(axis=1, keepdims=True)
            b = (first + counts - 1 - d)[counts > d]
            right[b] = (over[at[b + 1]] @ right[b + 1][:, :, None])[:, :, 0]
            right[b] /= right[b].sum(axis=1, keepdims=True)
    alpha = np.empty_like(e)
    now = left[:, None, :]
    for j in range(block):
        now = ahead(now, j)
        alpha[:, j] = now[:, 0]
    out = np.empty((len(emissions), k), dtype=e.dtype)
    now = right
    for j in range(block - 1, -1, -1):
        live = inside[:, j]
        mass = alpha[:, j] * now
        out[places[live, j]] = (mass / mass.sum(axis=1, keepdims=True))[live]
        back = (now * e[:, j]) @ step.T
        now = np.where(live[:, None], back / back.sum(axis=1, keepdims=True), now)
    return out


def viterbi(emissions: np.ndarray, transitions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The best labels [chains, places]; -1 beyond a chain's length. Ties go to the smaller label."""
    n, width, k = emissions.shape
    best = emissions[:, 0].copy()
    back = np.zeros((n, width, k), dtype=np.int8)
    for t in range(1, width):
        live = t < lengths
        ways = best[:, :, None] + transitions[None]
        back[:, t] = np.where(live[:, None], ways.argmax(axis=1), np.arange(k)[None])
        best = np.where(live[:, None], ways.max(axis=1) + emissions[:, t], best)
    labels = np.empty((n, width), dtype=np.int8)
    now = best.argmax(axis=1)
    for t in range(width - 1, -1, -1):
        labels[:, t] = now
        now = back[np.arange(n), t, now]
    labels[np.arange(width)[None, :] >= lengths[:, None]] = -1
    return labels


def chain_viterbi(emissions: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, block: int = 64) -> np.ndarray:
    """The best labels [places] of chains of any length, laid end to end: the same as viterbi's where one labelling is best. All
    blocks of all chains advance together; best scores are carried over blocks as in chain_posteriors, from both sides, and a
    place's label is the one through which the best labelling of the whole chain runs.

    Arrays have labels first and blocks last, so every step is a few long vector operations."""
    k = emissions.shape[1]
    lengths = lengths[lengths > 0]
    if not len(lengths):
        return np.zeros(0, dtype=np.int8)
    counts = -(-lengths // block)
    chain = np.repeat(np.arange(len(lengths)), counts)
    first = np.cumsum(counts) - counts
    turn = np.arange(len(chain)) - first[chain]
    start = (np.cumsum(lengths) - lengths)[chain] + turn * block
    size = np.minimum(block, lengths[chain] - turn * block)
    inside = np.arange(block)[:, None] < size[None, :]
    places = np.where(inside, start[None, :] + np.arange(block)[:, None], 0)
    e = np.ascontiguousarray(emissions.T)[:, places]  # [labels, places of a block, blocks]
    begins = turn == 0

    def ahead(now: np.ndarray, here: np.ndarray, live: np.ndarray, begin: np.ndarray | None) -> np.ndarray:
        """Best scores ``now`` [..., labels, blocks] moved over a place with emissions ``here`` [labels, blocks]."""
        moved = np.empty_like(now)
        for b in range(k):
            best = now[..., 0, :] + transitions[0, b]
            for a in range(1, k):
                np.maximum(best, now[..., a, :] + transitions[a, b], out=best)
            moved[..., b, :] = best if begin is None else np.where(begin, now[..., b, :], best)
        moved += here
        return moved if live.all() else np.where(live, moved, now)

    left, right = np.zeros((k, len(chain)), dtype=e.dtype), np.zeros((k, len(chain)), dtype=e.dtype)
    several = np.flatnonzero(counts[chain] > 1)
    if len(several):
        over = np.where(np.eye(k, dtype=bool), 0, -1e9).astype(e.dtype)[:, :, None] + np.zeros(len(several), dtype=e.dtype)
        part, live = e[:, :, several], inside[:, several]
        for j in range(block):
            over = ahead(over, part[:, j], live[j], begins[several] if j == 0 else None)
        at = np.full(len(chain), -1)
        at[several] = np.arange(len(several))
        for d in range(1, int(counts.max())):
            b = first[counts > d] + d
            left[:, b] = (left[:, None, b - 1] + over[:, :, at[b - 1]]).max(axis=0)
            left[:, b] -= left[:, b].max(axis=0)
            b = (first + counts - 1 - d)[counts > d]
            right[:, b] = (over[:, :, at[b + 1]] + right[None, :, b + 1]).max(axis=1)
            right[:, b] -= right[:, b].max(axis=0)
    best = np.empty_like(e)
    now = left
    for j in range(block):
        now = ahead(now, e[:, j], inside[j], begins if j == 0 else None)
        best[:, j] = now
    out = np.empty(len(emissions), dtype=np.int8)
    now = right
    for j in range(block - 1, -1, -1):
        live = inside[j]
        out[places[j, live]] = (best[:, j] + now).argmax(axis=0)[live]
        beyond = now + e[:, j]
        back = np.empty_like(now)
        for a in range(k):
            most = beyond[0] + transitions[a, 0]
            for b in range(1, k):
                np.maximum(most, beyond[b] + transitions[a, b], out=most)
            back[a] = most
        now = back if live.all() else np.where(live, back, now)
    return out


def train(
    emit: Callable[[np.ndarray], np.ndarray],
    pull: Callable[[np.ndarray], np.ndarray],
    n_features: int,
    gold: np.ndarray,
    lengths: np.ndarray,
    n_labels: int,
    rounds: int,
    rate: float,
    shrink: float,
) -> tuple[np.ndarray, np.ndarray]:
    """Weights [features, labels] and transitions that maximise the regularised likelihood, by Adam over the whole sample.

    emit turns weights into emissions [chains, places, labels]; pull is its transpose. gold: labels, -1 beyond the end."""
    weights, transitions = np.zeros((n_features, n_labels)), np.zeros((n_labels, n_labels))
    inside = gold >= 0
    marks = np.zeros((*gold.shape, n_labels))
    marks[inside, gold[inside]] = 1
    pairs = inside[:, 1:]
    seen = np.zeros((n_labels, n_labels))
    np.add.at(seen, (gold[:, :-1][pairs], gold[:, 1:][pairs]), 1)
    size = inside.sum()
    state = [[np.zeros_like(x), np.zeros_like(x)] for x in (weights, transitions)]
    for i in range(1, rounds + 1):
        post, expected, _ = forward_backward(emit(weights), transitions, lengths)
        slopes = (pull(marks - post) / size - shrink * weights, (seen - expected) / size - shrink * transitions)
        for x, g, s in zip((weights, transitions), slopes, state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.99 * s[1] + 0.01 * g * g
            x += rate * (s[0] / (1 - 0.9**i)) / (np.sqrt(s[1] / (1 - 0.99**i)) + 1e-8)
    return weights, transitions
