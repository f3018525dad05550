"""The fit's memory on the driver is that of the kernel matrix; blocks of landmarks change no value."""

import random
import tracemalloc

import numpy as np

from protloom.llm import toxicity


def test_blocks_of_landmarks_change_no_value():
    rng = random.Random(2)
    strings = [" " + "".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 12))) + " " for _ in range(150)]
    marks = strings[:70] + ["", "  "]
    alphabet = " abcdefg"
    known = lambda x: "".join(ch if ch in alphabet else "\0" for ch in x)
    got = toxicity.gram(strings[60:90], marks, alphabet)
    keep = [(i, j) for i, a in enumerate(strings[60:90]) for j, b in enumerate(marks) if "\0" not in known(a) + known(b)]
    assert keep and all(abs(got[i, j] - toxicity.kernel(strings[60 + i], marks[j])) < 1e-5 for i, j in keep)


def test_peak_of_the_kernel_with_many_landmarks():
    rng = random.Random(3)
    strings = ["".join(chr(0x4E00 + rng.randrange(100)) for _ in range(24)) for _ in range(256)]
    alphabet = "".join(chr(0x4E00 + k) for k in range(100))
    tracemalloc.start()
    got = toxicity.gram(strings[:100], strings, alphabet)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert np.isclose(got[7, 7], toxicity.kernel(strings[7], strings[7]), rtol=1e-3)
    assert peak < 250e6
