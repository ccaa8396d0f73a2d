"""A character-level bidirectional LSTM with CRF transitions, in numpy: training and decoding."""

from __future__ import annotations

import numpy as np

#: Characters with a letter of their own; others fall into a few classes.
_OWN = "".join(map(chr, range(32, 127)))
N_CHARS = len(_OWN) + 5


def char_ids(text: str) -> np.ndarray:
    """The class of each character: 0 is padding."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    ids = np.where((codes >= 32) & (codes < 127), codes.astype(np.int64) - 31, 0)
    for i in np.flatnonzero(ids == 0):
        c = chr(codes[i])
        ids[i] = len(_OWN) + (1 if c.isspace() else 2 if c.isupper() else 3 if c.isalpha() else 4)
    return ids


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


class Tagger:
    """Scores and decodes windows of equal length; ``params`` are plain arrays that travel to the workers."""

    def __init__(self, n_tags: int, embedding: int = 12, hidden: int = 20, seed: int = 0, params: dict[str, np.ndarray] | None = None):
        self.n_tags, self.hidden = n_tags, hidden
        if params is None:
            rng = np.random.default_rng(seed)
            params = {"embed": rng.normal(0, 0.3, (N_CHARS, embedding))}
            for side in "fb":
                params["x" + side] = rng.normal(0, embedding**-0.5, (embedding, 4 * hidden))
                params["h" + side] = rng.normal(0, hidden**-0.5, (hidden, 4 * hidden))
                params["b" + side] = np.zeros(4 * hidden)
                params["b" + side][hidden : 2 * hidden] = 1.0
            params["out"] = rng.normal(0, 0.1, (2 * hidden, n_tags))
            params["bias"] = np.zeros(n_tags)
            params["trans"] = np.zeros((n_tags, n_tags))
            params["start"] = np.zeros(n_tags)
        self.params = {k: np.asarray(v, np.float32) for k, v in params.items()}

    def _run(self, ids: np.ndarray, side: str, keep: bool):
        """Hidden states by step of one direction, and what the backward pass needs."""
        p, k = self.params, self.hidden
        drive = p["embed"] @ p["x" + side] + p["b" + side]
        n, length = ids.shape
        h, c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
        states, saved = np.empty((length, n, k), np.float32), []
        for t in range(length) if side == "f" else range(length - 1, -1, -1):
            z = drive[ids[:, t]] + h @ p["h" + side]
            gates = _sigmoid(z[:, : 3 * k])
            i, f, o = gates[:, :k], gates[:, k : 2 * k], gates[:, 2 * k :]
            g = np.tanh(z[:, 3 * k :])
            past, h_past = c, h
            c = f * past + i * g
            tc = np.tanh(c)
            h = o * tc
            states[t] = h
            if keep:
                saved.append((t, i, f, o, g, past, tc, h_past))
        return states, saved

    def emissions(self, ids: np.ndarray, keep: bool = False):
        """Tag scores (step, window, tag)."""
        fs, f_saved = self._run(ids, "f", keep)
        bs, b_saved = self._run(ids, "b", keep)
        both = np.concatenate([fs, bs], axis=2)
        scores = both @ self.params["out"] + self.params["bias"]
        return (scores, both, f_saved, b_saved) if keep else scores

    def decode(self, scores: np.ndarray) -> np.ndarray:
        """The best tag sequence of each row of tag scores (row, step, tag); what precedes and follows is tag 0.

        Rows shorter than the others are padded by scores that leave nothing but tag 0.
        """
        trans = self.params["trans"]
        n, length, k = scores.shape
        best = trans[0] + scores[:, 0]
        back = np.empty((length, n, k), np.int8)
        for t in range(1, length):
            moved = best[:, :, None] + trans
            back[t] = moved.argmax(axis=1)
            best = moved.max(axis=1) + scores[:, t]
        tags = np.empty((n, length), np.int64)
        tags[:, -1] = (best + trans[:, 0]).argmax(axis=1)
        rows = np.arange(n)
        for t in range(length - 1, 0, -1):
            tags[:, t - 1] = back[t, rows, tags[:, t]]
        return tags

    def open_places(self, scores: np.ndarray) -> np.ndarray:
        """Where the best sequence over (step, tag) scores may have another tag than 0; elsewhere it surely has 0.

        A run of other tags gains at most the sum of its steps' best margins over tag 0 and of the best transitions; a step
        is open if some run that holds it can gain at all.
        """
        trans = self.params["trans"]
        margins = (scores[:, 1:] - scores[:, :1]).max(axis=1).astype(np.float64) + (trans[1:, 1:].max() - trans[0, 0])
        ends = float(trans[0, 1:].max() + trans[1:, 0].max() - trans[0, 0] - trans[1:, 1:].max())
        sums = np.concatenate([[0.0], np.cumsum(margins)])
        highest = np.maximum.accumulate(sums[:0:-1])[::-1]
        return highest - np.minimum.accumulate(sums[:-1]) + ends > -1e-3

    def gradients(self, ids: np.ndarray, tags: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of the tag sequences, and its gradients."""
        p, k = self.params, self.hidden
        scores, both, f_saved, b_saved = self.emissions(ids, keep=True)
        length, n, n_tags = scores.shape
        trans = p["trans"]
        alpha, beta = np.empty_like(scores), np.zeros_like(scores)
        alpha[0] = scores[0] + p["start"]
        for t in range(1, length):
            alpha[t] = _logsumexp(alpha[t - 1][:, :, None] + trans, 1) + scores[t]
        for t in range(length - 2, -1, -1):
            beta[t] = _logsumexp(trans + (beta[t + 1] + scores[t + 1])[:, None, :], 2)
        total = _logsumexp(alpha[-1], 1)
        unary = np.exp(alpha + beta - total[:, None])
        rows = np.arange(n)
        pairs = alpha[:-1, :, :, None] + trans + (beta[1:] + scores[1:])[:, :, None, :] - total[:, None, None]
        d_trans = np.exp(pairs).sum(axis=(0, 1))
        np.subtract.at(d_trans, (tags[:, :-1].ravel(), tags[:, 1:].ravel()), 1.0)
        steps = np.arange(length)[:, None]
        gold = scores[steps, rows, tags.T].sum(axis=0) + p["start"][tags[:, 0]] + trans[tags[:, :-1], tags[:, 1:]].sum(axis=1)
        d_scores = unary
        d_scores[steps, rows, tags.T] -= 1.0
        d_scores /= n
        seen = np.zeros((length * n, N_CHARS), np.float32)
        seen[np.arange(length * n), ids.T.ravel()] = 1.0
        grads = {"trans": d_trans / n, "start": d_scores[0].sum(axis=0), "bias": d_scores.sum(axis=(0, 1)), "out": np.einsum("tnk,tnj->kj", both, d_scores), "embed": np.zeros_like(p["embed"])}
        d_both = d_scores @ p["out"].T
        for side, saved, d_states in (("f", f_saved, d_both[:, :, :k]), ("b", b_saved, d_both[:, :, k:])):
            d_h, d_c = np.zeros((n, k), np.float32), np.zeros((n, k), np.float32)
            d_zs, before = np.empty((length, n, 4 * k), np.float32), np.empty((length, n, k), np.float32)
            for t, i, f, o, g, past, tc, h_past in reversed(saved):
                d_h = d_h + d_states[t]
                d_c = d_c + d_h * o * (1 - tc * tc)
                d_z = np.concatenate([d_c * g * i * (1 - i), d_c * past * f * (1 - f), d_h * tc * o * (1 - o), d_c * i * (1 - g * g)], axis=1)
                d_c = d_c * f
                d_zs[t], before[t] = d_z, h_past
                d_h = d_z @ p["h" + side].T
            d_zs = d_zs.reshape(-1, 4 * k)
            d_drive = seen.T @ d_zs
            grads["h" + side], grads["b" + side] = before.reshape(-1, k).T @ d_zs, d_drive.sum(axis=0)
            grads["x" + side] = p["embed"].T @ d_drive
            grads["embed"] += d_drive @ p["x" + side].T
        return float((total - gold).mean()), grads

    def fit(self, ids: np.ndarray, tags: np.ndarray, steps: int, batch: int = 48, rate: float = 0.03, seed: int = 1) -> list[float]:
        """Adam over random batches; the losses by step."""
        rng = np.random.default_rng(seed)
        first = {k: np.zeros_like(v) for k, v in self.params.items()}
        second = {k: np.zeros_like(v) for k, v in self.params.items()}
        losses = []
        for step in range(1, steps + 1):
            rows = rng.integers(0, len(ids), batch)
            loss, grads = self.gradients(ids[rows], tags[rows])
            losses.append(loss)
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
            pace = np.float32(rate * min(1.0, 2.0 * (1 - step / (steps + 1))))
            shrink = np.float32(min(1.0, 5.0 / (norm + 1e-9)))
            for k, g in grads.items():
                g = g * shrink
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                self.params[k] -= pace * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
        return losses

