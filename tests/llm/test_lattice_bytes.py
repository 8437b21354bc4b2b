"""What a vector costs on its way to its cells."""

import inspect

import numpy as np
import pyarrow as pa

from quillstone.llm import lattice as L


def test_floats_travel_as_floats_and_a_cell_is_met_once():
    v = np.random.default_rng(3).normal(size=(5, 8)).astype(np.float32)
    batch = pa.record_batch([pa.array([b"%d" % i for i in range(5)]), pa.array(v.astype(np.float64).tolist()), pa.array([1] * 5, pa.int32()), pa.array([1] * 5, pa.int64())], names=["node", "v", "label", "w"])
    (out,) = L._coded(iter([batch]), 2, 1, 2.5, 5, "float32")
    assert {len(x) for x in out.column("raw").to_pylist()} == {32}
    back = np.frombuffer(b"".join(out.column("raw").to_pylist()), np.float32).reshape(5, 8)
    assert (L._units(back.astype(np.float64)) == L._units(v.astype(np.float64))).all()
    options = inspect.signature(L.embedding_links).parameters
    assert options["block"].default >= options["crowd"].default
