from collections import Counter

import numpy as np
import pyarrow as pa

from colligate.llm import collocations
from colligate.llm.collocations import Grams


def test_a_text_is_kept_once(monkeypatch):
    monkeypatch.setattr(collocations, "ROWS_OUT", 7)
    rng, grams, wanted, sizes = np.random.default_rng(3), Grams(), Counter(), []
    for _ in range(40):
        keys, counts = np.unique(rng.integers(0, 60, 100).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15), return_counts=True)
        names = [f"w{k % 60} x{k}" for k in keys.tolist()]
        new = grams.add(keys, counts)
        grams.named(pa.array([f"l{k % 3}" for k in keys[new].tolist()], pa.string()), pa.array([n for n, is_new in zip(names, new, strict=True) if is_new], pa.string()))
        wanted.update({(f"l{k % 3}", n): c for k, n, c in zip(keys.tolist(), names, counts.tolist(), strict=True)})
        sizes.append(grams.nbytes)
    assert sizes[-1] < 4000  # it doesn't grow with the batches
    batches = list(grams.empty())
    rows = [(r["lang"], " ".join(r["words"]), r["n"]) for b in batches for r in b.to_pylist()]
    assert max(b.num_rows for b in batches) <= 7
    assert rows == sorted((*key, n) for key, n in wanted.items())
    assert not grams.nbytes and not list(grams.empty())
