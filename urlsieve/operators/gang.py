"""What tasks of a barrier stage that train one model together share: sums of arrays over all of them."""

from __future__ import annotations

import base64
import zlib
from collections.abc import Callable

import numpy as np
from pyspark import BarrierTaskContext

#: Rows from which more than one task trains a model, and the most tasks: each sends what it has to all others.
ROWS, TASKS = 500_000, 32


def summing(context: BarrierTaskContext, tasks: int) -> Callable[[np.ndarray], np.ndarray]:
    """A function that adds up arrays of one shape over the stage's tasks, in order of task, which all must call alike.

    A gather takes about a second, however little is sent.
    """

    def add(numbers: np.ndarray) -> np.ndarray:
        if tasks == 1:
            return numbers
        every = context.allGather(base64.b64encode(zlib.compress(numbers.tobytes(), 1)).decode())
        return np.sum([np.frombuffer(zlib.decompress(base64.b64decode(e)), numbers.dtype).reshape(numbers.shape) for e in every], axis=0)

    return add
