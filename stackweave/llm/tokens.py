"""Text to ids of a byte-level tokenizer, many texts at a time.

A byte-level BPE tokenizer first cuts a text into pieces and then encodes each piece by itself, and most
pieces of a corpus are repeats. Pieces are therefore cut for a whole run of texts on its UTF-8 bytes, hashed, and each
distinct piece is encoded by the tokenizers library once (a bounded memo keeps the ids; when it is full, pieces that were
met in one run only are forgotten, so rare pieces do not push out the common ones). Which code
points are letters, numbers, spaces or others is asked from the library. Pieces of equal hash are compared byte by byte, and
the memo's keys are the pieces themselves, so ids never rest on a hash. A worker process keeps its encoder and memo
from task to task (`encoder_of`). Texts that hold an added token's string, or
code points beyond the table, go to the library whole; so do all texts if the tokenizer is of another kind.
"""

from __future__ import annotations

import os
from itertools import chain, repeat

import numpy as np
import pandas as pd
import pyarrow as pa

from stackweave.llm import words as W

LETTER, NUMBER, OTHER, SPACE, BEYOND = range(5)
_TABLE = 0x2070  # code points that are cut here; 1 to 3 bytes
_MEMO = 500_000
_ENDINGS = (b"s", b"t", b"m", b"d", b"re", b"ve", b"ll")  # fixed values: endings cut with their apostrophe


_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _distinct(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Groups of byte ranges by hash: a sample of each group, each range's group, and the ranges that differ from their sample.

    A range of up to eight bytes is one number; only the bytes of longer ones are hashed and compared one by one.
    """
    size = ends - starts
    padded = np.concatenate((data, np.zeros(8, np.uint8)))
    heads = np.ndarray(len(data) + 1, "<u8", padded, strides=(1,))[starts] & _MASKS[np.minimum(size, 8)]
    hashes = W.mix(heads ^ (size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    long = np.flatnonzero(size > 8)
    stop = np.cumsum(size[long])
    begin = stop - size[long]
    body = data[np.arange(int(stop[-1]) if len(long) else 0) + np.repeat(starts[long] - begin, size[long])]
    hashes[long] = W.hash_bytes(body, begin, stop)
    place, groups = pd.factorize(hashes)
    sample = np.empty(len(groups), np.int64)
    sample[place[::-1]] = np.arange(len(place))[::-1]  # the first range of a group is written last
    twin = sample[place]
    odd = (size != size[twin]) | (heads != heads[twin])
    check = np.flatnonzero(~odd[long] & (twin[long] != long))
    if len(check):
        number = np.full(len(size), -1, np.int64)
        number[long] = np.arange(len(long))
        length = size[long][check]
        step = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
        differ = body[np.repeat(begin[check], length) + step] != body[np.repeat(begin[number[twin[long[check]]]], length) + step]
        odd[long[check[np.searchsorted(np.cumsum(length), np.flatnonzero(differ), "right")]]] = True
    return sample, place, np.flatnonzero(odd)


_ENCODERS: dict[str, "Encoder"] = {}


def encoder_of(path: str) -> "Encoder":
    """The encoder of this worker process: its tokenizer is loaded once, its memo outlives the task."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Encoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        cutter = self.tokenizer.pre_tokenizer
        self.fast = cutter is not None and type(cutter).__name__ == "ByteLevel" and cutter.use_regex and not cutter.add_prefix_space and self.tokenizer.normalizer is None
        if self.fast:
            self.kinds = np.full(_TABLE, BEYOND, np.uint8)
            for c in range(_TABLE):
                for kind, probe in ((LETTER, "a"), (NUMBER, "1"), (OTHER, "!"), (SPACE, "\n\n")):
                    if len(cutter.pre_tokenize_str(probe + chr(c))) == 1:
                        self.kinds[c] = kind
                        break
            # The tokenizer's own model, and the letters that it writes the 256 bytes as, to encode pieces that are already cut.
            self.model = self.tokenizer.model
            plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
            other = [b for b in range(256) if b not in plain]
            self.letters = np.arange(256, dtype="<u2")
            self.letters[other] = 256 + np.arange(len(other))
        self._clear()

    def _clear(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.begin, self.size, self.uses = (np.zeros(1 << 14, kind) for kind in (np.int64, np.int32, np.int32))

    def _add(self, pieces: list[bytes], sizes: np.ndarray, ids: np.ndarray) -> None:
        """Remember distinct new pieces: how many ids each has, and all ids one after another."""
        base, stop, used = len(self.known), len(self.known) + len(pieces), self.used + len(ids)
        for array, need in (("flat", used), ("begin", stop), ("size", stop), ("uses", stop)):
            held = getattr(self, array)
            if need > len(held):
                setattr(self, array, np.concatenate((held, np.zeros(max(need - len(held), len(held)), held.dtype))))
        self.begin[base:stop] = self.used + np.cumsum(sizes) - sizes
        self.size[base:stop] = sizes
        self.uses[base:stop] = 0
        self.flat[self.used:used] = ids
        self.used = used
        self.known.update(zip(pieces, range(base, stop)))

    def _forget(self) -> None:
        """Keep the pieces that several runs have asked for since the last time, unless they fill most of the memo."""
        often = np.flatnonzero(self.uses[:len(self.known)] > 1)
        pieces, index = list(self.known), often if len(often) <= _MEMO * 3 // 4 else often[:0]
        sizes, ids = self.size[index], self._ids(index)
        self._clear()
        self._add([pieces[i] for i in index.tolist()], sizes, ids)

    def _ids(self, index: np.ndarray) -> np.ndarray:
        """The ids of remembered pieces, one after another."""
        sizes = self.size[index]
        stop = np.cumsum(sizes)
        return self.flat[np.arange(int(stop[-1]) if len(stop) else 0) + np.repeat(self.begin[index] - stop + sizes, sizes)]

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and how many each text has."""
        data, offsets = W.buffers(texts)
        if not self.fast:
            return self._join([self._whole(t) for t in texts.to_pylist()])
        kinds = self._kinds(data)
        odd = np.unique(np.searchsorted(offsets, np.flatnonzero(kinds == BEYOND), "right") - 1).tolist()
        for added in self.added:
            odd += [i for i in range(len(texts)) if added in texts[i].as_buffer().to_pybytes()] if added in data.tobytes() else []
        starts = self._cut(data, offsets, kinds)
        ends = np.append(starts[1:], len(data))
        ids, counts = self._pieces(data, starts, ends, np.searchsorted(starts, offsets))
        if odd:
            parts = np.split(ids, np.cumsum(counts)[:-1])
            for i in set(odd):
                parts[i] = self._whole(texts[i].as_py())
            return self._join(parts)
        return ids, counts

    @staticmethod
    def _join(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        return np.concatenate([np.zeros(0, np.uint32), *parts]), np.array([len(p) for p in parts], np.int64)

    def _kinds(self, data: np.ndarray) -> np.ndarray:
        """The kind of the code point that each byte belongs to."""
        single = np.concatenate((self.kinds[:128], np.full(128, BEYOND, np.uint8)))
        kinds = single[data]
        two = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        kinds[two] = kinds[two + 1] = self.kinds[(data[two].astype(np.int32) & 31) << 6 | data[two + 1] & 63]
        three = np.flatnonzero((data >= 0xE0) & (data < 0xF0))
        points = (data[three].astype(np.int32) & 15) << 12 | (data[three + 1].astype(np.int32) & 63) << 6 | data[three + 2] & 63
        found = np.where(points < _TABLE, self.kinds[np.minimum(points, _TABLE - 1)], BEYOND)
        for k in range(3):
            kinds[three + k] = found
        return kinds

    def _cut(self, data: np.ndarray, offsets: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Starts of all pieces: runs of one kind, a blank before a run joined to it, other spaces before a run apart."""
        if not len(data):
            return np.zeros(0, np.int64)
        start = np.ones(len(data) + 1, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=start[1:-1])
        start[offsets] = True
        bounds = np.zeros(len(data) + 1, bool)
        bounds[offsets] = True
        runs = np.flatnonzero(start)
        after = runs[1:][(kinds[runs[:-1]] == SPACE)]  # ends of runs of spaces
        after = after[~bounds[after]]
        last = after - 1
        for _ in range(2):  # back to the first byte of the last space
            last = np.where(data[last] & 0xC0 == 0x80, last - 1, last)
        start[last] = True
        start[after[data[last] == 32]] = False
        quote = np.flatnonzero(data == 39)
        quote = quote[start[quote] & start[quote + 1]]
        for p in quote[~bounds[quote + 1]].tolist():
            stop = int(offsets[np.searchsorted(offsets, p, "right")])
            rest = data[p + 1:min(p + 3, stop)].tobytes()
            for ending in _ENDINGS:
                if rest.startswith(ending):
                    start[p + 1] = False
                    start[p + 1 + len(ending)] = True
                    break
        return np.flatnonzero(start[:-1])

    def _pieces(self, data, starts, ends, first) -> tuple[np.ndarray, np.ndarray]:
        sample, place, other = _distinct(data, starts, ends)
        body = data.tobytes()
        keys = [body[a:b] for a, b in zip(starts[sample].tolist(), ends[sample].tolist())]
        if len(other):  # pieces whose hash is another piece's: each is a key of its own
            more = [body[a:b] for a, b in zip(starts[other].tolist(), ends[other].tolist())]
            place = place.copy()
            place[other] = np.arange(len(keys), len(keys) + len(more))
            keys += more
        if len(self.known) + len(keys) > _MEMO:
            self._forget()
        known = self.known
        index = np.fromiter(map(known.get, keys, repeat(-1)), np.int64, len(keys))
        missing = np.flatnonzero(index < 0)
        if len(missing):
            asked = [keys[i] for i in missing.tolist()]
            new = dict(zip(asked, missing.tolist()))
            written = self.letters[data].tobytes().decode("utf-16-le")  # one letter a byte
            places = np.concatenate((sample, other))[list(new.values())]
            tokenize = self.model.tokenize
            found = [[t.id for t in tokenize(written[a:b])] for a, b in zip(starts[places].tolist(), ends[places].tolist())]
            new = list(new)
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            self._add(new, sizes, np.fromiter(chain.from_iterable(found), np.uint32, int(sizes.sum())))
            index[missing] = np.fromiter(map(known.__getitem__, asked), np.int64, len(asked))
        self.uses[index] += 1
        index = index[place]
        total = np.concatenate(([0], np.cumsum(self.size[index])))
        return self._ids(index), np.diff(total[first])
