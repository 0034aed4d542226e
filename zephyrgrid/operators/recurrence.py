"""Linear recurrences over series of any length: x[t] = u[t] - sum of c[k] x[t - k].

A block of rows maps the state before it (the last values of x) to the state after it by an affine map: a matrix that
depends on the coefficients and the number of rows only, and a vector that the block's own input gives from a zero state.
Maps compose, so blocks are worked on side by side: one pass gives every block's vector, a scan over one row per block
gives the state each block starts from, and a second pass adds what that state contributes. The same composition splits a
block into short runs that numpy advances together.
"""

from __future__ import annotations

import numpy as np


class Recurrence:
    """One set of coefficients by lag. States hold the last ``reach`` values, newest first."""

    def __init__(self, coefficients: dict[int, float], reach: int) -> None:
        self.coefficients = {int(k): float(c) for k, c in coefficients.items() if c != 0.0}
        self.reach = max([reach, 1, *self.coefficients])

    def advance(self, inputs: np.ndarray, states: np.ndarray) -> np.ndarray:
        """Values for rows of inputs (runs x steps), each from its own state (runs x reach)."""
        runs, steps = inputs.shape
        x = np.concatenate([states[:, ::-1], inputs], axis=1)
        if self.coefficients:
            for t in range(self.reach, self.reach + steps):
                for k, c in self.coefficients.items():
                    x[:, t] -= c * x[:, t - k]
        return x[:, self.reach:]

    def response(self, steps: int) -> np.ndarray:
        """What each entry of the state contributes to the next values: reach x steps."""
        return self.advance(np.zeros((self.reach, steps)), np.eye(self.reach))

    def state_after(self, values: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The state once ``values`` follow the state ``before``."""
        return np.concatenate([before[::-1], values])[-self.reach:][::-1]

    def transition(self, steps: int) -> np.ndarray:
        """Matrix from the state before ``steps`` rows without input to the state after them, by repeated squaring."""
        one = np.zeros((self.reach, self.reach))
        one[1:, :-1] = np.eye(self.reach - 1)
        for k, c in self.coefficients.items():
            one[0, k - 1] = -c
        return np.linalg.matrix_power(one, steps)

    def run(self, inputs: np.ndarray, state: np.ndarray | None = None) -> np.ndarray:
        """Values over a whole block: runs of about the square root of its length advance side by side, then the state
        each run starts from is carried through them."""
        n = len(inputs)
        state = np.zeros(self.reach) if state is None else np.asarray(state, dtype=float)
        steps = max(self.reach, int(np.ceil(np.sqrt(max(n, 1)))))
        runs = -(-n // steps)
        if runs <= 1:
            return self.advance(np.asarray(inputs, dtype=float)[None, :], state[None, :])[0]
        padded = np.zeros(runs * steps)
        padded[:n] = inputs
        alone = self.advance(padded.reshape(runs, steps), np.zeros((runs, self.reach)))
        reply = self.response(steps)
        last = reply[:, ::-1][:, :self.reach]
        starts = np.empty((runs, self.reach))
        for i in range(runs):
            starts[i] = state
            state = alone[i, ::-1][:self.reach] + state @ last
        return (alone + starts @ reply).reshape(-1)[:n]
