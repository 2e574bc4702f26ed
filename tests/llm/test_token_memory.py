"""Files of ids are packed and read piece by piece."""

import tracemalloc

import numpy as np

from recordloom.llm import pfor_files


def test_a_file_is_packed_and_read_in_pieces():
    ids = (np.random.default_rng(1).zipf(1.2, 1_000_000) % 49_000).astype(np.uint32)
    tracemalloc.start()
    raw = pfor_files.encode(np.arange(10), np.full(10, 100_000), ids)
    packing = tracemalloc.get_traced_memory()[1]
    offsets = pfor_files.contents(raw)[2]
    before = tracemalloc.get_traced_memory()[0]
    tracemalloc.reset_peak()
    back = pfor_files.decode(raw, offsets)
    reading = tracemalloc.get_traced_memory()[1] - before
    tracemalloc.stop()
    assert (back.ravel()[:len(ids)] == ids).all()
    assert packing < 3 * ids.nbytes and reading < 4 * ids.nbytes  # all at once: 32 and 30 bytes an id
