"""What a Python worker of the packing stage takes, and that bounds on it change no ids."""

from __future__ import annotations

import random
import subprocess
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from vantarow.llm import packing

GROWTH = """
import random, resource
import pyarrow as pa
from vantarow.llm import packing
r = random.Random(5)
texts = [" ".join("%x" % r.getrandbits(48) for _ in range(250)) for _ in range(2000)]
column, path = pa.array(texts), packing.tokenizer_path()
del texts
for _ in packing.token_ids(pa.array(["some words to warm up"]), path):
    pass
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
for _ in packing.token_ids(column, path):
    pass
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


def test_distinct_words_take_bounded_memory():
    root = Path(__file__).resolve().parents[2]
    grown = int(subprocess.run([sys.executable, "-c", GROWTH], cwd=root, capture_output=True, text=True, check=True, timeout=120).stdout)
    assert grown < 120, f"{grown} MB for half a million distinct words"


def test_memo_of_long_units_is_bounded(monkeypatch):
    monkeypatch.setattr(packing, "MEMO_IDS", 2000, raising=False)
    monkeypatch.setattr(packing, "CALL", 3, raising=False)
    r = random.Random(6)
    texts = [" ".join("".join(r.choice("abcdefgh中文é") for _ in range(r.choice((3, 700)))) for _ in range(6)) for _ in range(60)] + ["", None]
    texts += texts[:5]
    path = packing.tokenizer_path()
    memo = packing._memo(path)
    memo.clear()
    plain = Tokenizer.from_file(path)
    most = 0
    for i, ids in packing.token_ids(pa.array(texts), path, step=4000):
        assert ids.dtype == np.uint32 and ids.tolist() == plain.encode(texts[i] or "", add_special_tokens=False).ids
        most = max(most, len(memo.pool))
    memo.clear()
    assert 2000 < most < 8000  # one step more than the bound
