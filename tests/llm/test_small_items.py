"""Benchmark items of one and two shingles, wherever they stand in a document."""

import random

import numpy as np
import pyarrow as pa
import pytest

from laneflow.llm import containment


@pytest.mark.parametrize("words", [3, 5, 6])
@pytest.mark.parametrize("place", ["start", "inside", "end"])
def test_small_items_are_found(words, place):
    rng = random.Random(words)
    word = lambda: f"w{rng.randrange(10**6)}"
    texts = [" ".join(word() for _ in range(words)) for _ in range(300)]
    before = {"start": 0, "inside": 20, "end": 20}[place]
    after = {"start": 20, "inside": 20, "end": 0}[place]
    docs = [" ".join([*(word() for _ in range(before)), x, *(word() for _ in range(after))]) for x in texts]
    part = pa.RecordBatch.from_arrays([pa.array(docs)], ["text"])
    row, item, _ = containment.found_in(part, containment.items_of(list(range(300)), texts), 0.8)
    order = np.argsort(row)
    assert row[order].tolist() == item[order].tolist() == list(range(300))
