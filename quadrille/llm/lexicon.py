"""A minimal acyclic transducer from words to token ids, in flat arrays that are memory-mapped.

Words are byte strings.  The automaton is built from sorted words, merging equal suffix states as they
become final (incremental minimisation), so common endings are stored once.  Every arc carries how
many words come before those through it; summed along a path these outputs number the words in
order, and that number indexes the table of ids.  States are ranges of a label-sorted arc table, and
lookups walk all words of a batch at once, one byte position a step.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

import numpy as np

#: ``key`` is (state, label) of every arc, in order, as one number; it is stored like the rest, so it is shared, too.
FIELDS = ("first", "final", "key", "target", "output", "offset", "ids")


class Lexicon:
    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)

    @staticmethod
    def build(entries: Iterable[tuple[bytes, list[int]]]) -> "Lexicon":
        """From distinct words with their ids, in any order."""
        items = sorted(entries)
        register: dict[tuple, int] = {}
        done: list[tuple[bool, list[tuple[int, int]], int]] = []  # final, arcs, words below

        def freeze(node: list) -> int:
            final, arcs = node
            key = (final, tuple(arcs))
            if key not in register:
                register[key] = len(done)
                done.append((final, arcs, final + sum(done[t][2] for _, t in arcs)))
            return register[key]

        path: list[list] = [[False, []]]
        last = b""
        for word, _ in items:
            same = 0
            while same < min(len(word), len(last)) and word[same] == last[same]:
                same += 1
            while len(path) - 1 > same:
                node = path.pop()
                path[-1][1].append((last[len(path) - 1], freeze(node)))
            path += [[False, []] for _ in range(len(word) - same)]
            path[-1][0] = True
            last = word
        while len(path) > 1:
            node = path.pop()
            path[-1][1].append((last[len(path) - 1], freeze(node)))
        root = freeze(path[0])
        first, label, target, output = [0], [], [], []
        for final, arcs, _ in done:
            before = int(final)
            for byte, t in arcs:
                label.append(byte)
                target.append(t)
                output.append(before)
                before += done[t][2]
            first.append(len(label))
        offset = np.zeros(len(items) + 1, np.int64)
        np.cumsum([len(i) for _, i in items], out=offset[1:])
        arrays = {
            "first": np.array(first, np.int64), "final": np.array([f for f, _, _ in done], np.bool_), "key": np.repeat(np.arange(len(first) - 1, dtype=np.int64), np.diff(first)) * 256 + np.array(label, np.int64), "target": np.array(target, np.int64),
            "output": np.array(output, np.int64), "offset": offset, "ids": np.array([x for _, i in items for x in i], np.int32), "root": np.array([root], np.int64),
        }
        return Lexicon(arrays)

    def to_bytes(self) -> bytes:
        """One file: a line of JSON with the layout, then the arrays, aligned to 64 bytes."""
        parts, layout, at = [], {}, 0
        for name in (*FIELDS, "root"):
            a = np.ascontiguousarray(getattr(self, name))
            layout[name] = [a.dtype.str, len(a), at]
            data = a.tobytes()
            data += b"\0" * (-len(data) % 64)
            parts.append(data)
            at += len(data)
        head = json.dumps(layout).encode()
        return len(head).to_bytes(8, "little") + head + b"".join(parts)

    @staticmethod
    def open(path: str) -> "Lexicon":
        """Memory-mapped: all workers of a machine share the pages."""
        data = np.memmap(path, np.uint8, "r")
        n = int.from_bytes(data[:8].tobytes(), "little")
        body = data[8 + n :]
        cut = lambda kind, size, at: np.frombuffer(body, np.dtype(kind), size, at)
        return Lexicon({k: cut(*v) for k, v in json.loads(data[8 : 8 + n].tobytes()).items()})

    def lookup(self, words: list[bytes]) -> np.ndarray:
        """The number of each word, -1 for words that aren't in the lexicon."""
        n = len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        start = np.concatenate([[0], np.cumsum(size)[:-1]]) if n else size
        state, number = np.full(n, self.root[0], np.int64), np.zeros(n, np.int64)
        live, pos = np.flatnonzero(size >= 0), 0
        while len(live):
            going = live[size[live] > pos]
            if not len(going) or not len(self.key):
                state[going] = -1
                break
            want = state[going] * 256 + flat[start[going] + pos]
            arc = np.minimum(np.searchsorted(self.key, want), len(self.key) - 1)
            hit = self.key[arc] == want
            state[going[~hit]] = -1
            live, arc = going[hit], arc[hit]
            state[live] = self.target[arc]
            number[live] += self.output[arc]
            pos += 1
        ends = (state >= 0) & self.final[np.maximum(state, 0)]
        return np.where(ends, number, -1)

    def ids_of(self, number: int) -> list[int]:
        return self.ids[self.offset[number] : self.offset[number + 1]].tolist()
