"""A log-bilinear language model in numpy, trained by noise-contrastive estimation.

The model predicts the class of a token from the classes of the tokens before it: their vectors, each through the matrix
of its distance, add up to a vector whose products with the vectors of all classes are the logits. Training tells every
token from noise drawn by the classes' frequencies, with the same draws for a whole batch, so that all work is matrix
products; it starts as the frequencies themselves, which are normalised. Scoring normalises over all classes.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np

#: Tokens before, length of the vectors; noise draws and tokens of a batch; step of the row-wise Adagrad.
BEFORE, WIDTH = 3, 32
NOISE, BATCH, STEP = 64, 1024, 0.05
#: Tokens that are scored at once.
SCORED = 1024
#: Contexts that are normalised at once; their rows stay in the cache.
PRODUCTS = 128


def contexts(classes: np.ndarray, first: np.ndarray, end: int) -> np.ndarray:
    """The classes of the tokens before each token of its text, nearest first; before the text there are ends."""
    place = np.arange(len(classes)) - np.repeat(first[:-1], np.diff(first))
    out = np.full((BEFORE, len(classes)), end, np.int32)
    for d in range(1, BEFORE + 1):
        out[d - 1, d:] = np.where(place[d:] >= d, classes[:-d], end)
    return out


def _add_rows(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums): values summed by row; rows under 65,536."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort
    sorted_rows = rows[order]
    begin = np.flatnonzero(np.append(True, sorted_rows[1:] != sorted_rows[:-1]))
    return sorted_rows[begin], np.add.reduceat(values.take(order, 0), begin, axis=0)


@dataclass
class Model:
    """Vectors of classes as context and as outcome, biases, matrices of distances, and the squared steps of Adagrad so far."""

    context: np.ndarray
    outcome: np.ndarray
    bias: np.ndarray
    matrix: np.ndarray
    context_steps: np.ndarray
    outcome_steps: np.ndarray
    bias_steps: np.ndarray
    matrix_steps: np.ndarray

    @classmethod
    def start(cls, frequency: np.ndarray, seed: int = 0) -> Model:
        """The model that knows the frequencies of classes only."""
        r, n = np.random.default_rng(seed), len(frequency)
        small = lambda *shape: (r.standard_normal(shape) * 0.1).astype(np.float32)
        matrix = np.stack([np.eye(WIDTH, dtype=np.float32)] * BEFORE) / BEFORE
        steps = [np.full(shape, 0.1, np.float32) for shape in (n, n, n, BEFORE)]
        return cls(small(n, WIDTH), small(n, WIDTH) * 0, np.log(frequency).astype(np.float32), matrix, *steps)

    def copy(self) -> Model:
        return Model(*(getattr(self, f.name).copy() for f in fields(self)))

    def hidden(self, before: np.ndarray) -> np.ndarray:
        return sum(self.context.take(before[d], 0) @ self.matrix[d] for d in range(BEFORE))

    def _step(self, name: str, rows: np.ndarray, grad: np.ndarray) -> None:
        steps = getattr(self, name + "_steps")
        steps[rows] += np.square(grad).reshape(len(grad), -1).mean(1)
        getattr(self, name)[rows] += STEP * grad / np.sqrt(steps[rows]).reshape(-1, *[1] * (grad.ndim - 1))

    def learn(self, before: np.ndarray, target: np.ndarray, noise: np.ndarray, frequency: np.ndarray) -> None:
        """One step over a batch: before (BEFORE, batch), target (batch), noise (draws)."""
        seen = [self.context.take(before[d], 0) for d in range(BEFORE)]
        h = sum(seen[d] @ self.matrix[d] for d in range(BEFORE))
        expected = np.log(NOISE * frequency)
        out, draws = self.outcome.take(target, 0), self.outcome.take(noise, 0)
        told = 1 / (1 + np.exp(np.einsum("ij,ij->i", h, out) + self.bias[target] - expected[target]))  # how far a token is from certain
        fooled = h @ -draws.T
        fooled += expected[noise] - self.bias[noise]
        np.exp(fooled, out=fooled)
        fooled += 1
        np.divide(-1, fooled, out=fooled)
        grad_h = told[:, None] * out + fooled @ draws
        rows, sums = _add_rows(np.append(target, noise), np.concatenate([told[:, None] * h, fooled.T @ h]))
        bias_rows, bias_sums = _add_rows(np.append(target, noise), np.append(told, fooled.sum(0)))
        grads = [grad_h @ self.matrix[d].T for d in range(BEFORE)]
        context_rows, context_sums = _add_rows(before.ravel(), np.concatenate(grads))
        matrix_grad = np.stack([seen[d].T @ grad_h for d in range(BEFORE)])
        self._step("outcome", rows, sums)
        self._step("bias", bias_rows, bias_sums)
        self._step("context", context_rows, context_sums)
        self._step("matrix", np.arange(BEFORE), matrix_grad)

    def learn_all(self, before: np.ndarray, target: np.ndarray, frequency: np.ndarray, r: np.random.Generator) -> None:
        """One pass over all tokens, in random order."""
        order = r.permutation(len(target))
        share = np.cumsum(frequency.astype(np.float64))
        batches = -(-len(order) // BATCH)
        draws = np.minimum(np.searchsorted(share, r.random((batches, NOISE)) * share[-1]), len(frequency) - 1)
        for b in range(batches):
            at = order[b * BATCH : (b + 1) * BATCH]
            self.learn(before.take(at, 1), target[at], draws[b], frequency)

    def log_probability(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Natural log probability of each token's class, normalised over all classes. A logit is a sum over distances, so its exponential
        is a product of table entries, and none is taken for each token; each table is scaled by its row's greatest entry."""
        parts = [(self.context @ self.matrix[d]) @ self.outcome.T for d in range(BEFORE)]
        parts[0] = parts[0] + self.bias
        most = [x.max(1) for x in parts]
        if sum(float((m - x.min(1)).max()) for x, m in zip(parts, most, strict=True)) > 80:  # else no product leaves the range of floats
            return self._log_probability(before, target)
        tables = [np.exp(x - m[:, None]) for x, m in zip(parts, most, strict=True)]
        order = np.lexsort(before[::-1].astype(np.uint16))  # equal contexts lie side by side and are normalised once
        seen = before.take(order, 1)
        new = np.append(True, (seen[:, 1:] != seen[:, :-1]).any(0)) if len(target) else np.zeros(0, bool)
        contexts_, total = seen[:, new], np.empty(int(new.sum()), np.float64)
        for s in range(0, len(total), PRODUCTS):
            at = contexts_[:, s : s + PRODUCTS]
            product = tables[0].take(at[0], 0)
            for d in range(1, BEFORE - 1):
                product *= tables[d].take(at[d], 0)
            total[s : s + PRODUCTS] = np.einsum("ij,ij->i", product, tables[-1].take(at[-1], 0))
        out = np.empty(len(target), np.float64)
        out[order] = np.log(total)[np.cumsum(new) - 1]
        return sum(parts[d][before[d], target].astype(np.float64) - most[d][before[d]] for d in range(BEFORE)) - out

    def _log_probability(self, before: np.ndarray, target: np.ndarray) -> np.ndarray:
        """The same for vectors of any length."""
        out = np.empty(len(target), np.float64)
        longest = np.sqrt(np.square(self.outcome).sum(1).max())
        for s in range(0, len(target), SCORED):
            h = self.hidden(before[:, s : s + SCORED])
            logits = h @ self.outcome.T
            logits += self.bias
            own = logits[np.arange(len(h)), target[s : s + SCORED]]
            most = 0.0
            if np.sqrt(np.square(h).sum(1).max()) * longest + np.abs(self.bias).max() > 60:  # else no exponential is out of range
                most = logits.max(1)
                logits -= most[:, None]
            out[s : s + SCORED] = own - most - np.log(np.exp(logits, out=logits) @ np.ones(logits.shape[1], np.float32))
        return out
