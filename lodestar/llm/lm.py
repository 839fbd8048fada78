"""A small causal self-attention language model on subword ids, trained and applied in numpy."""

from __future__ import annotations

import numpy as np

#: Positions that a scoring window scores, and context positions before them; a training window has both as targets.
SCORED, CONTEXT = 32, 32
LENGTH = SCORED + CONTEXT
#: Windows per batch in scoring and in training: so few that most of a batch's arrays stay in a core's cache.
BATCH, STEP = 64, 128
#: Windows of a training step whose arrays are held at a time.
PIECE = 32
_NAMES = ("embed", "project", "lift", "bias", "near")
#: No exponential of so large a number overflows, nor does its inverse vanish.
SAFE = np.float32(40)


class AttentionModel:
    """P(next id | ids so far) = sum over k of g_k * P_k(next), where the gate g is computed by causal self-attention.

    Each position attends, by query-key products and a learnt distance term, to itself and the positions
    before it in its window; the attended values, lifted to the parts, and its own embedding give the gate's logits. The
    P_k are proper distributions over the vocabulary, so the probabilities of all continuations sum to one.
    Gate and embeddings are trained by gradient (Adam), the P_k by expectation-maximisation.
    ``project`` maps an embedding to its (scaled) query, key, value and own logits, side by side.
    """

    def __init__(self, vocabulary: int, parts: int = 64, width: int = 16, heads: int = 8, values: int = 8, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
        self.vocabulary, self.parts, self.heads, self.values = vocabulary, parts, heads, values
        self.embed = rng.standard_normal((vocabulary, width)).astype(np.float32) * np.float32(0.5)
        self.project, self.lift = draw(width, 2 * heads + values + parts), draw(values, parts)
        self.project[:, :heads] /= np.float32(np.sqrt(heads))
        self.bias, self.near = np.zeros(parts, np.float32), np.zeros(LENGTH, np.float32)
        noise = rng.random((vocabulary, parts)) + 0.5
        self.tables = (noise / noise.sum(axis=0)).astype(np.float32)

    def parameters(self) -> dict[str, np.ndarray]:
        return {n: getattr(self, n) for n in _NAMES}

    def copy(self) -> AttentionModel:
        new = AttentionModel.__new__(AttentionModel)
        new.__dict__ = {k: v.copy() if isinstance(v, np.ndarray) else v for k, v in self.__dict__.items()}
        return new

    def set_tables(self, counts: np.ndarray, unigram: np.ndarray, prior: float = 50.0) -> None:
        """P_k from expected counts, smoothed towards the unigram distribution."""
        smooth = counts + prior * unigram[:, None]
        self.tables = (smooth / smooth.sum(axis=0)).astype(np.float32)

    def split(self, projected: np.ndarray) -> tuple[np.ndarray, ...]:
        """Query, key, value and own parts of projections."""
        return tuple(np.split(projected, np.cumsum([self.heads, self.heads, self.values]), axis=-1))

    def distances(self, queries: int, keys: int, shift: int) -> np.ndarray:
        """The additive mask: the distance term where key position <= query position, else minus infinity."""
        gap = np.arange(queries)[:, None] + shift - np.arange(keys)[None, :]
        return np.where(gap >= 0, self.near[np.clip(gap, 0, LENGTH - 1)], np.float32(-1e9)).astype(np.float32)

    def step(self, windows: np.ndarray, lengths: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray, float]:
        """Of windows [n, T + 1] with so many targets each: gradients, the distinct targets, the expected counts of their
        parts, and the summed log-likelihood.

        The windows are taken PIECE at a time. The sums under the softmaxes are divided out where rows are narrow: the attention
        is never normalised itself, only the attended values are, and the tables are multiplied in after the rows of a target are summed.
        """
        x, y = np.ascontiguousarray(windows[:, :-1]), np.ascontiguousarray(windows[:, 1:])
        (n, t), kind, width, heads = x.shape, self.embed.dtype, self.embed.shape[1], self.heads
        narrow = 2 * heads + self.values
        weight = (np.arange(t)[None, :] < lengths[:, None]).astype(kind)
        rows = np.pad(self.embed, ((0, 0), (0, self.values)))  # with room for the attended values
        low = np.pad(self.project[:, :narrow], ((0, 0), (0, -narrow % 8 or 8)))  # with room for a column of ones
        gate = np.concatenate([self.project[:, narrow:], self.lift])
        back, low_back = np.ascontiguousarray(gate.T), np.ascontiguousarray(self.project[:, :narrow].T)
        mask, all_parts, all_keys = self.distances(t, t, 0), np.ones(self.parts, kind), np.ones(t, kind)
        d_gate, d_low, d_bias, d_mask = np.zeros_like(gate), np.zeros((width, narrow), kind), np.zeros(self.parts, kind), np.zeros(t * t, kind)
        d_rows, share, likelihood, most_near = np.empty((n * t, width), kind), np.empty((n * t, self.parts), kind), 0.0, float(np.abs(self.near).max())
        for a in range(0, n, PIECE):
            m, here = min(PIECE, n - a), slice(a * t, (a + PIECE) * t)
            inputs = rows.take(x[a : a + m].ravel(), axis=0)
            attended = inputs.reshape(m, t, -1)[:, :, width:]
            p = (inputs[:, :width] @ low).reshape(m, t, -1)
            p[:, :, narrow] = 1
            q, k, v, v_one = p[:, :, :heads], p[:, :, heads : 2 * heads], p[:, :, 2 * heads : narrow], p[:, :, 2 * heads : narrow + 1]
            s = q @ k.transpose(0, 2, 1)
            s += mask
            if longest(q) * longest(k) + most_near > SAFE:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            inverse = (1 / (s @ all_keys))[:, :, None]
            np.multiply(s @ v, inverse, out=attended)
            g = inputs @ gate
            g += self.bias
            if max(float(g.max()), -float(g.min())) > SAFE:
                g -= g.max(axis=1, keepdims=True)
            np.exp(g, out=g)
            following = self.tables.take(y[a : a + m].ravel(), axis=0)
            total, scored = np.einsum("ij,ij->i", g, following), weight[a : a + m].ravel()
            chance = total / (g @ all_parts)
            likelihood += float((np.log(chance) * scored).sum())
            posterior = np.multiply(g, (scored / total)[:, None], out=share[here])  # over the table
            dz = np.subtract(chance[:, None], following, out=following)
            dz *= posterior
            d_gate += inputs.T @ dz
            d_bias += np.ones(m * t, kind) @ dz
            dx = dz @ back
            du = np.empty((m, t, self.values + 1), kind)
            np.multiply(dx.reshape(m, t, -1)[:, :, width:], inverse, out=du[:, :, :-1])
            np.einsum("ijk,ijk->ij", du[:, :, :-1], attended, out=du[:, :, -1])
            du[:, :, -1] *= -1  # the mean that a softmax takes off its gradient
            ds = du @ v_one.transpose(0, 2, 1)
            ds *= s
            d_mask += np.ones(m, kind) @ ds.reshape(m, -1)
            down = np.concatenate([ds @ k, ds.transpose(0, 2, 1) @ q, s.transpose(0, 2, 1) @ du[:, :, :-1]], axis=2).reshape(m * t, -1)
            d_low += inputs[:, :width].T @ down
            np.add(down @ low_back, dx[:, :width], out=d_rows[here])
        gap = np.clip(np.arange(t)[:, None] - np.arange(t)[None, :], 0, LENGTH - 1)
        grads = {
            "embed": scatter(x.ravel(), d_rows, self.vocabulary), "project": np.concatenate([d_low, d_gate[:width]], axis=1), "lift": d_gate[width:],
            "bias": d_bias, "near": np.bincount(gap.ravel(), np.tril(d_mask.reshape(t, t)).ravel(), LENGTH),
        }
        found, sums = summed(y.ravel(), share)
        sums *= self.tables[found]
        return grads, found, sums, likelihood

    def lookup(self) -> dict[str, np.ndarray]:
        """Per-id rows of all projections, so that scoring looks up instead of multiplying."""
        q, k, v, own = self.split(self.embed @ self.project)
        rows = {"query": q, "attended": np.concatenate([k, v], axis=1), "own": own + self.bias, "next": self.tables}
        return {n: np.ascontiguousarray(r) for n, r in rows.items()}

    def log10_probabilities(self, ids: np.ndarray, sizes: np.ndarray, lookup: dict[str, np.ndarray], start: int, most: int = BATCH) -> np.ndarray:
        """log10 P of every id, for documents of `sizes` ids laid end to end in `ids`.

        A document is cut into windows that score SCORED ids each and see CONTEXT earlier positions besides,
        so windows overlap and each id is scored once; a batch of windows is one masked attention.
        """
        ends = sizes.cumsum()
        begins = ends - sizes
        per = -(-sizes // SCORED)
        doc = np.repeat(np.arange(len(sizes)), per)
        first = np.arange(len(doc)) - np.repeat(per.cumsum() - per, per)
        at = begins[doc] + first * SCORED
        before = np.concatenate([[start], ids[:-1]]) if len(ids) else ids
        before[begins[sizes > 0]] = start
        out = np.empty(len(ids), np.float64)
        mask = self.distances(SCORED, LENGTH, CONTEXT)
        ones, all_parts = np.ones(LENGTH, np.float32), np.ones(self.parts, np.float32)
        most_near = float(np.abs(self.near).max())
        for a in range(0, len(at), most):
            here, low, high = at[a : a + most, None], begins[doc[a : a + most], None], ends[doc[a : a + most], None]
            seen = here - CONTEXT + np.arange(LENGTH)
            inside = (seen >= low) & (seen < high)
            x = before.take(seen, mode="clip")
            own = x[:, CONTEXT:].ravel()
            attended = lookup["attended"].take(x.ravel(), axis=0).reshape(*x.shape, -1)
            q, k, v = lookup["query"].take(own, axis=0).reshape(len(x), SCORED, -1), attended[:, :, : self.heads], attended[:, :, self.heads :]
            s = q @ k.transpose(0, 2, 1)
            s += mask
            first_in_text = np.flatnonzero(~inside[:, 0])
            s[first_in_text, :, :CONTEXT] += np.where(inside[first_in_text, None, :CONTEXT], np.float32(0), np.float32(-1e9))
            if longest(q) * longest(k) + most_near > SAFE:
                s -= s.max(axis=2, keepdims=True)
            np.exp(s, out=s)
            u = s @ v
            u /= (s @ ones)[:, :, None]
            z = u.reshape(len(own), -1) @ self.lift
            z += lookup["own"].take(own, axis=0)
            if max(float(z.max()), -float(z.min())) > SAFE:
                z -= z.max(axis=1, keepdims=True)
            np.exp(z, out=z)
            place = seen[:, CONTEXT:]
            following = lookup["next"].take(ids.take(place.ravel(), mode="clip"), axis=0)
            got = np.einsum("ij,ij->i", z, following) / (z @ all_parts)
            score = inside[:, CONTEXT:]
            out[place[score]] = got.reshape(score.shape)[score]
        return np.log10(out)


def longest(rows: np.ndarray) -> float:
    """The greatest length of a row; the product of two bounds all products of their rows."""
    return float(np.sqrt(np.einsum("ijk,ijk->ij", rows, rows).max(initial=0)))


def summed(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct row numbers (below 65,536) and the sums of their value rows."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")
    ordered, values = rows[order], values.take(order, axis=0)
    cuts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    if values.shape[1] % 2:
        return ordered[cuts], np.add.reduceat(values, cuts, axis=0)
    # two columns are added as one complex number, which takes half the time
    return ordered[cuts], np.add.reduceat(values.view(np.result_type(values, np.complex64)), cuts, axis=0).view(values.dtype)


def scatter(rows: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the value rows by row number."""
    out = np.zeros((n, values.shape[1]), np.float32)
    found, sums = summed(rows, values)
    out[found] = sums
    return out


class Adam:
    def __init__(self, model: AttentionModel, rate: float):
        self.model, self.rate, self.k = model, rate, 0
        self.m = {n: np.zeros_like(p) for n, p in model.parameters().items()}
        self.v = {n: np.zeros_like(p) for n, p in model.parameters().items()}

    def update(self, grads: dict[str, np.ndarray], tokens: float) -> None:
        self.k += 1
        for n, p in self.model.parameters().items():
            g = (grads[n] / np.float32(max(tokens, 1))).astype(np.float32)
            self.m[n] += np.float32(0.1) * (g - self.m[n])
            self.v[n] += np.float32(0.01) * (g * g - self.v[n])
            p -= np.float32(self.rate / (1 - 0.9**self.k)) * self.m[n] / (np.sqrt(self.v[n] / np.float32(1 - 0.99**self.k)) + np.float32(1e-8))


def warm_up(model: AttentionModel, windows: np.ndarray, lengths: np.ndarray, unigram: np.ndarray, steps: int, rate: float = 0.03) -> None:
    """First training on a bounded set of windows, with stepwise expectation-maximisation of the tables."""
    if not len(windows):
        model.set_tables(np.zeros_like(model.tables), unigram)
        return
    rng, adam, counts = np.random.default_rng(9), Adam(model, rate), None
    model.set_tables(model.tables * unigram[:, None] * rng.uniform(0.2, 1.8, model.tables.shape) * 1000 * len(unigram), unigram)
    for k in range(steps):
        adam.rate = rate * (1 - 0.7 * k / steps)
        pick = rng.integers(0, len(windows), BATCH)
        grads, found, sums, _ = model.step(windows[pick], lengths[pick])
        adam.update(grads, float(lengths[pick].sum()))
        got = np.zeros_like(model.tables)
        got[found] = sums
        counts = got if counts is None else counts * np.float32(0.97) + got
        model.set_tables(counts, unigram)


def train_part(model: AttentionModel, windows: np.ndarray, lengths: np.ndarray, adam: Adam, counts: np.ndarray) -> None:
    """Trains the gate on the windows, one step a batch, and adds their expected table counts to `counts`."""
    for a in range(0, len(windows), STEP):
        grads, found, sums, _ = model.step(windows[a : a + STEP], lengths[a : a + STEP])
        adam.update(grads, float(lengths[a : a + STEP].sum()))
        counts[found] += sums
