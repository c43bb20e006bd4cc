"""A character BiLSTM with a CRF on top, in numpy: training, fast decoding, nothing about its use.

Both directions run side by side in one set of arrays: step ``t`` of the loop is place ``t`` for the
forward half and place ``T - 1 - t`` for the backward half. Gates lie in the order input, forget,
output, new content, each for both halves; sigmoid gates are written as (tanh + 1) / 2.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Character class of the places behind a window's end.
PAD = 0


@dataclass
class Network:
    """``forward``/``backward``: gate inputs per character class; ``step``: recurrent weights (block
    diagonal); ``out``: tag scores per state; ``bias``, ``moves``, ``first``: tags, tag pairs, starts."""

    forward: np.ndarray
    backward: np.ndarray
    step: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    moves: np.ndarray
    first: np.ndarray

    @property
    def hidden(self) -> int:
        return self.step.shape[0] // 2

    def arrays(self) -> list[np.ndarray]:
        return [self.forward, self.backward, self.step, self.out, self.bias, self.moves, self.first]


def masks(hidden: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which gate columns belong to the forward and the backward half, and which recurrent weights."""
    half = np.tile(np.repeat([True, False], hidden), 4)
    rows = np.repeat([True, False], hidden)
    return half, ~half, rows[:, None] == half[None, :]


def fresh(classes: int, hidden: int, tags: int, seed: int) -> Network:
    random = np.random.default_rng(seed)
    ahead, back, blocks = masks(hidden)

    def draw(*shape: int, scale: float) -> np.ndarray:
        return random.normal(0, scale, shape).astype(np.float32)

    forward, backward = draw(classes, 8 * hidden, scale=0.5) * ahead, draw(classes, 8 * hidden, scale=0.5) * back
    for table in (forward, backward):
        table[:, 2 * hidden : 4 * hidden] += 0.5 * (table[0, 2 * hidden : 4 * hidden] != 0)  # remember at first
    backward[PAD] = np.where(back, -20, 0)  # the backward half starts empty behind the pad
    return Network(
        forward, backward, draw(2 * hidden, 8 * hidden, scale=0.5 / np.sqrt(hidden)) * blocks,
        draw(2 * hidden, tags, scale=0.5), np.zeros(tags, np.float32),
        np.zeros((tags, tags), np.float32), np.zeros(tags, np.float32),
    )


def states(net: Network, chars: np.ndarray, keep: list | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward states (places x rows x hidden) of ``chars`` (places x rows)."""
    length, rows = chars.shape
    n = net.hidden
    ahead, back = np.empty((2, length, rows, n), np.float32)
    h, c = np.zeros((2, rows, 2 * n), np.float32)
    gates, move = np.empty((2, rows, 8 * n), np.float32)
    some, more = np.empty((2, rows, 2 * n), np.float32)
    i, f, o, g = (gates[:, 2 * n * j : 2 * n * (j + 1)] for j in range(4))
    for t in range(length):
        np.take(net.forward, chars[t], axis=0, out=gates, mode="clip")
        gates += np.take(net.backward, chars[length - 1 - t], axis=0, out=move, mode="clip")
        gates += np.matmul(h, net.step, out=move)
        np.tanh(gates, out=gates)
        if keep is not None:
            keep.append((gates.copy(), c.copy(), h.copy()))
        # With gates (x + 1) / 2: twice the new content is (f + 1) c + (i + 1) g.
        np.multiply(f, c, out=some)
        c += some
        np.multiply(i, g, out=more)
        more += g
        c += more
        c *= 0.5
        np.tanh(c, out=some)
        np.multiply(o, some, out=h)
        h += some
        h *= 0.5
        ahead[t] = h[:, :n]
        back[length - 1 - t] = h[:, n:]
    return ahead, back


def emissions(net: Network, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
    n = net.hidden
    return ahead @ net.out[:n] + back @ net.out[n:] + net.bias


def decode(net: Network, chars: np.ndarray) -> np.ndarray:
    """Best tags (places x rows, int8); tag 0 is the outside.

    Where no run of other tags, each place with its best and all moves at their best, would gain over
    staying outside, the outside is best all along; only the other rows go through the Viterbi steps.
    """
    ahead, back = states(net, chars)
    n, k = net.hidden, len(net.bias)
    length, rows = chars.shape
    lift = net.out[:, 1:] - net.out[:, :1]
    gain = lift[:n].T @ ahead.reshape(-1, n).T
    gain += lift[n:].T @ back.reshape(-1, n).T
    gain += (net.bias[1:] - net.bias[0])[:, None]
    gain = gain.max(axis=0).reshape(length, rows)
    inside = np.concatenate([chars != PAD, np.zeros((1, rows), bool)])
    tags = np.zeros((length, rows), np.int8)
    # Upper bound of what a run of other tags that ends here gains over staying outside.
    moves = net.moves - net.moves[0, 0]
    enter, go_on, leave = moves[0, 1:].max(), moves[1:, 1:].max(), moves[1:, 0].max()
    run = gain[0] + (net.first[1:] - net.first[0]).max()
    opened = np.zeros(rows, bool)
    for t in range(length):
        if t:
            run = np.maximum(run + go_on, enter)
            run += gain[t]
        opened |= inside[t] & (run + np.where(inside[t + 1], leave, 0) > 0)
    inside = inside[:length]
    open_rows = np.flatnonzero(opened)
    if len(open_rows):
        score = emissions(net, ahead[:, open_rows], back[:, open_rows])
        score[~inside[:, open_rows]] = [0, *[-1e4] * (k - 1)]
        tags[:, open_rows] = viterbi(net, score)
    return tags


def viterbi(net: Network, score: np.ndarray) -> np.ndarray:
    length, rows, k = score.shape
    best = score[0] + net.first
    origin = np.empty((length, rows, k), np.int8)
    for t in range(1, length):
        paths = best[:, :, None] + net.moves
        origin[t] = paths.argmax(axis=1)
        best = paths.max(axis=1) + score[t]
    tags = np.empty((length, rows), np.int8)
    tags[-1] = best.argmax(axis=1)
    each = np.arange(rows)
    for t in range(length - 1, 0, -1):
        tags[t - 1] = origin[t, each, tags[t]]
    return tags


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def crf(net: Network, score: np.ndarray, tags: np.ndarray, inside: np.ndarray):
    """Mean loss per row and its gradients for the scores, the moves and the starts."""
    length, rows, k = score.shape
    alpha, beta = np.empty_like(score), np.zeros_like(score)
    alpha[0] = net.first + score[0]
    for t in range(1, length):
        step = _lse(alpha[t - 1][:, :, None] + net.moves, 1) + score[t]
        alpha[t] = np.where(inside[t][:, None], step, alpha[t - 1])
    for t in range(length - 2, -1, -1):
        step = _lse(net.moves + (score[t + 1] + beta[t + 1])[:, None, :], 2)
        beta[t] = np.where(inside[t + 1][:, None], step, 0)
    total = _lse(alpha[-1], 1)
    each = np.arange(rows)
    d_score = np.exp(alpha + beta - total[:, None])
    gold = net.first[tags[0]] + score[0, each, tags[0]]
    d_moves, d_first = np.zeros_like(net.moves), d_score[0].sum(axis=0)
    np.add.at(d_first, tags[0], -1)
    for t in range(1, length):
        on = inside[t]
        pair = alpha[t - 1][:, :, None] + net.moves + (score[t] + beta[t])[:, None, :] - total[:, None, None]
        d_moves += np.exp(pair[on]).sum(axis=0)
        np.add.at(d_moves, (tags[t - 1][on], tags[t][on]), -1)
        gold = gold + np.where(on, net.moves[tags[t - 1], tags[t]] + score[t, each, tags[t]], 0)
    d_score[~inside] = 0
    t, r = np.nonzero(inside)
    d_score[t, r, tags[t, r]] -= 1
    return float((total - gold).mean()), d_score / rows, d_moves / rows, d_first / rows


def gradients(net: Network, chars: np.ndarray, tags: np.ndarray) -> tuple[float, list[np.ndarray]]:
    length, rows = chars.shape
    n = net.hidden
    left, right, blocks = masks(n)
    kept: list = []
    ahead, back = states(net, chars, kept)
    loss, d_score, d_moves, d_first = crf(net, emissions(net, ahead, back), tags, chars != PAD)
    d_out = np.concatenate([np.einsum("trh,trk->hk", s, d_score) for s in (ahead, back)])
    d_ahead, d_back = d_score @ net.out[:n].T, d_score @ net.out[n:].T
    d_forward, d_backward = np.zeros_like(net.forward), np.zeros_like(net.backward)
    d_step = np.zeros_like(net.step)
    d_h, d_c = np.zeros((2, rows, 2 * n), np.float32)
    classes = np.arange(len(net.forward))[:, None]
    for t in range(length - 1, -1, -1):
        gates, c_before, h_before = kept[t]
        s = (gates[:, : 6 * n] + 1) / 2
        i, f, o, g = (*(s[:, 2 * n * j : 2 * n * (j + 1)] for j in range(3)), gates[:, 6 * n :])
        c = f * c_before + i * g
        tc = np.tanh(c)
        d_h = d_h + np.concatenate([d_ahead[t], d_back[length - 1 - t]], axis=1)
        d_c = d_c + d_h * o * (1 - tc * tc)
        soft = np.concatenate([d_c * g, d_c * c_before, d_h * tc], axis=1)
        d_gate = np.concatenate([soft * 2 * s * (1 - s), d_c * i * (1 - g * g)], axis=1)
        d_step += h_before.T @ d_gate
        d_forward += (classes == chars[t]).astype(np.float32) @ d_gate
        d_backward += (classes == chars[length - 1 - t]).astype(np.float32) @ d_gate
        d_h, d_c = d_gate @ net.step.T, d_c * f
    d_backward[PAD] = 0
    return loss, [d_forward * left, d_backward * right, d_step * blocks, d_out, d_score.sum(axis=(0, 1)), d_moves, d_first]


def train(chars: np.ndarray, tags: np.ndarray, classes: int, hidden: int, kinds: int, steps: int, batch: int, seed: int) -> Network:
    """Fit to ``chars`` and ``tags`` (places x rows) by Adam; the same for the same input."""
    net = fresh(classes, hidden, kinds, seed)
    random = np.random.default_rng(seed)
    first = [np.zeros_like(a) for a in net.arrays()]
    second = [np.zeros_like(a) for a in net.arrays()]
    for step in range(1, steps + 1):
        rows = random.choice(chars.shape[1], min(batch, chars.shape[1]), replace=False)
        _, grads = gradients(net, chars[:, rows], tags[:, rows])
        size = np.sqrt(sum(float((g * g).sum()) for g in grads))
        rate = 0.03 * min(1.0, 2 * (1 - step / (steps + 1)))
        for a, g, m, v in zip(net.arrays(), grads, first, second, strict=True):
            g = g * min(1.0, 5.0 / (size + 1e-9))
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net
