"""Words of texts in Arrow batches: what :func:`vantarow.functions.text.tokens` finds, by operations over all bytes at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Lower-cased ASCII letters and digits by byte; all else parts words.
_LOWER = np.array([x | 32 if 65 <= x <= 90 else x if 97 <= x <= 122 or 48 <= x <= 57 else 0 for x in range(256)], np.uint8)
#: The only other characters whose lower case has an ASCII letter.
_OTHERS = {"K": "k", "İ": "i̇"}


def words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a column of texts in order, and how many each text has; a null has none."""
    texts = texts.cast(pa.large_string()).fill_null("")
    for old, new in _OTHERS.items():
        if pc.any(pc.match_substring(texts, old)).as_py():
            texts = pc.replace_substring(texts, old, new)
    if not len(texts):
        return pa.array([], pa.string()), np.zeros(0, np.int64)
    edges = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    low = _LOWER[np.frombuffer(data, np.uint8)[edges[0] : edges[-1]]] if data else np.empty(0, np.uint8)
    edges = edges - edges[0]
    inside = low != 0
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    begins = edges[:-1][edges[:-1] < len(low)]
    first[begins] = inside[begins]  # a text begins anew
    start = np.flatnonzero(first)
    place = np.append(np.cumsum(inside, dtype=np.int32)[start] - 1, np.count_nonzero(inside)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(start), pa.py_buffer(place), pa.py_buffer(low[inside]))
    return found, np.diff(np.searchsorted(start, edges))
