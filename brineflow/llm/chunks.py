"""Cutting a text where every byte-level pre-tokenizer of this family cuts it too.

The pattern takes one space before letters, digits or signs into the match that
they start, and leaves the last of several blanks to it. So a match starts at
every space before a non-blank, and the pieces between can be looked up whole.
"""

from __future__ import annotations

import contextlib
import ctypes
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A space before a blank of any kind, or at the end.
_RUN = r" (?:[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|$)"
_CUT = re.compile(r" (?=\S)")


Find = Callable[[list[str]], list[bytes]]


def encode_column(column: pa.Array, first: Find, later: Find) -> list[bytes]:
    """The bytes of each text's pieces in a row. ``first`` and ``later`` get distinct pieces.

    The pieces are cut, made distinct and put back in place by Arrow; texts
    with runs of blanks are cut one by one.
    """
    texts = column.fill_null("")
    has_run = np.asarray(pc.match_substring_regex(texts, _RUN).to_numpy(zero_copy_only=False), bool)
    runs, plain = np.flatnonzero(has_run).tolist(), np.flatnonzero(~has_run)
    out: list[bytes] = [b""] * len(texts)
    if len(plain):
        lists = pc.split_pattern(texts.filter(pa.array(~has_run)) if runs else texts, " ")
        bounds = lists.offsets.to_numpy()
        flat = lists.values
        begin = np.zeros(len(flat), bool)
        begin[bounds[:-1]] = True
        start = flat.take(pa.array(bounds[:-1])).dictionary_encode()
        heads = pa.array(first(start.dictionary.to_pylist()), pa.large_binary()).take(start.indices).to_pylist()
        coded = flat.filter(pa.array(~begin)).dictionary_encode()
        values = pa.array(later(coded.dictionary.to_pylist()), pa.large_binary()).take(coded.indices)
        ends = np.frombuffer(values.buffers()[1], np.int64) if len(values) else np.zeros(1, np.int64)
        data = memoryview(values.buffers()[2] or b"") if len(values) else memoryview(b"")
        cuts = ends[bounds - np.arange(len(bounds))].tolist()
        for i, head, a, b in zip(plain.tolist(), heads, cuts[:-1], cuts[1:], strict=True):
            out[i] = head + data[a:b]
    for i in runs:
        pieces = _CUT.split(texts[i].as_py())
        rest = list(dict.fromkeys(pieces[1:]))
        known = dict(zip(rest, later(rest), strict=True))
        out[i] = first(pieces[:1])[0] + b"".join(map(known.__getitem__, pieces[1:]))
    return out


#: What a worker process keeps from one task to the next, by name.
KEPT: dict[str, object] = {}


def forget() -> None:
    """Drop what this worker keeps and give freed memory back: workers are shared by all stages, and a task that needs room starts with this."""
    KEPT.clear()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
        ctypes.CDLL(None).malloc_trim(0)


#: Bytes that an entry takes besides its key's and value's own.
ENTRY_BYTES = 200


class Memo:
    """Values of keys seen before, in two generations; ``find`` makes those of a list of distinct new keys.

    When the younger generation is full it becomes the older, and what is asked for
    again comes back from there; ``most_bytes`` bounds the two together, whatever the
    length of the keys. A pair that would fill a fourth of it is not kept. Forgetting
    costs time only.
    """

    def __init__(self, find, most_bytes: int):
        self.find, self.most = find, most_bytes // 2
        self.young: dict = {}
        self.older: dict = {}
        self.held = 0

    def _keep(self, key, value) -> None:
        size = len(key) + len(value) + ENTRY_BYTES
        if 2 * size > self.most:
            return
        if self.held + size > self.most:
            self.older, self.young, self.held = self.young, {}, 0
        self.held += size
        self.young[key] = value

    def __call__(self, keys: list) -> list:
        """The values of distinct keys."""
        out = list(map(self.young.get, keys))
        new = []
        for i, value in enumerate(out):
            if value is None:
                if (old := self.older.get(keys[i])) is None:
                    new.append(i)
                else:
                    out[i] = old
                    self._keep(keys[i], old)
        for i, value in zip(new, self.find([keys[i] for i in new]), strict=True):
            out[i] = value
            self._keep(keys[i], value)
        return out
