"""Token ids by a tokenizer file, with a table of white-space-separated chunks that are known.

The file's normaliser and splitter never join text across white space, so a text's ids are the ids of its chunks
in order. That holds for texts over SAFE characters, where composition changes nothing and lower-casing goes
character by character; any other text, and any that may hold a special token's name, goes to the tokenizer whole.
Chunks are found in the table by array operations over many texts at once, by hash and then by all of their bytes.
"""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import numpy as np

#: ASCII and the Latin letters up to U+017F but for the two that don't lower-case or compose alone.
SAFE = re.compile(r"[\t\n\r\x20-\x7e¡-įı-ňŊ-ſ]*")
_PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_²³¹¼-¾]+|[0-9²³¹¼-¾]|(?:[^\w]|_)+")
#: Chunks that a worker's table holds, and bytes of them; the half met most often, without long ones, stays when it is full.
CHUNKS, CHUNK_BYTES, LONG = 250_000, 32 << 20, 64
_SPACE = re.compile(r"[\t\n\r ]")
END = "</w>"
_TOGETHER, _BYTES = 256, 1 << 19
_ODD = np.uint64(0x9E3779B97F4A7C15)


class _Table:
    """Chunks by hash: open addressing over arrays; their bytes and ids lie in two pools."""

    def __init__(self, limit: int) -> None:
        self.limit, self.bits = limit, (4 * max(limit, _BYTES // 2)).bit_length()
        self._clear()

    def _clear(self) -> None:
        self.slots = np.full(1 << self.bits, -1, dtype=np.int32)
        self.n = 0
        self.hash = np.empty(0, dtype=np.uint64)
        self.met = np.empty(0, dtype=np.int64)
        self.text, self.ids = np.empty(0, dtype=np.uint8), np.empty(0, dtype="<u4")
        self.text_at, self.ids_at = np.zeros(1, dtype=np.int64), np.zeros(1, dtype=np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash's chunk, -1 if unknown."""
        out = np.full(len(hashes), -1, dtype=np.int64)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(hashes)) if self.n else np.empty(0, np.int64)
        while len(todo):
            held = self.slots[slot[todo]]
            some = held >= 0
            todo, held = todo[some], held[some]
            same = self.hash[held] == hashes[todo]
            out[todo[same]] = held[same]
            todo = todo[~same]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1
        return out

    def add(self, hashes: np.ndarray, texts: list[bytes], ids: list[bytes], met: np.ndarray) -> None:
        first = self.n
        self.hash, self.met = np.r_[self.hash, hashes], np.r_[self.met, met]
        self.text = np.r_[self.text, np.frombuffer(b"".join(texts), dtype=np.uint8)]
        self.ids = np.r_[self.ids, np.frombuffer(b"".join(ids), dtype="<u4")]
        self.text_at = np.r_[self.text_at, self.text_at[-1] + np.cumsum([len(x) for x in texts])]
        self.ids_at = np.r_[self.ids_at, self.ids_at[-1] + np.cumsum([len(x) // 4 for x in ids])]
        self.n += len(texts)
        slot = (hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        todo = np.arange(len(hashes))
        while len(todo):
            free = todo[self.slots[slot[todo]] < 0]
            self.slots[slot[free]] = first + free  # of several for one slot the last stays
            todo = todo[self.slots[slot[todo]] != first + todo]
            slot[todo] = slot[todo] + 1 & (1 << self.bits) - 1

    def shrink(self) -> None:
        """Keeps the half met most often, without long ones."""
        keep = np.argsort(-self.met, kind="stable")[: self.limit // 2]
        keep = np.sort(keep[(self.text_at[keep + 1] - self.text_at[keep]) <= LONG])
        text, ids = self.text.tobytes(), self.ids.tobytes()
        kept = ([text[a:b] for a, b in zip(self.text_at[keep].tolist(), self.text_at[keep + 1].tolist(), strict=True)], [ids[4 * a : 4 * b] for a, b in zip(self.ids_at[keep].tolist(), self.ids_at[keep + 1].tolist(), strict=True)])
        hashes, met = self.hash[keep], self.met[keep] // 2
        self._clear()
        self.add(hashes, *kept, met)


@functools.cache
def _open(path: str, limit: int):  # noqa: ANN202
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    ends = np.zeros(t.get_vocab_size() + 1, dtype=bool)
    ends[[i for k, i in t.get_vocab().items() if k.endswith(END)]] = True
    return t, ends, _Table(limit)


@functools.cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _ODD and of its inverse modulo 2^64."""
    back = np.uint64(pow(int(_ODD), -1, 1 << 64))
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, dtype=np.uint64)]) for x in (_ODD, back))


def word_bpe_path() -> str:
    """The default tokenizer file on the machine that runs this."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _pack(ids: list[int]) -> bytes:
    return np.array(ids, dtype="<u4").tobytes()


def _encoded(chunks: list[str], t, ends: np.ndarray) -> list[bytes]:  # noqa: ANN001
    """The ids of chunks. They are encoded in one go and cut where words end, if the ends add up."""
    ids = np.array(t.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, dtype="<u4")
    stops = np.flatnonzero(ends[ids]) + 1
    words = np.cumsum([len(_PIECE.findall(x)) for x in chunks])
    if len(stops) == words[-1]:
        raw, at = ids.tobytes(), (stops[words - 1] * 4).tolist()
        return [raw[a:b] for a, b in zip([0, *at], at, strict=False)]
    return [_pack(e.ids) for e in t.encode_batch_fast(chunks, add_special_tokens=False)]


def _spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... sizes[0] of them, then the same for the others."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(sizes.sum())


def _together(texts: list[str], t, ends: np.ndarray, table: _Table, full: bool = False) -> list[bytes]:  # noqa: ANN001
    """Ids of texts over SAFE characters, of no more than about _BYTES together. full: the table has been shrunk for them."""
    raw = [text.lower().encode() for text in texts]
    data = np.frombuffer(b"\n".join([*raw, b""]), dtype=np.uint8)
    black = np.r_[False, data > 32, False]
    edges = np.flatnonzero(black[1:] != black[:-1])
    starts, stops = edges[::2], edges[1::2]
    if not len(starts):
        return [b""] * len(texts)
    power, inverse = _powers(1 << max(20, len(data).bit_length()))
    sums = np.r_[np.uint64(0), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])]
    hashes = (sums[stops] - sums[starts]) * inverse[starts]
    hashes = (hashes ^ hashes >> np.uint64(32)) * _ODD
    sizes = stops - starts
    found = table.find(hashes)
    if (found < 0).any():
        new, first = np.unique(hashes[found < 0], return_index=True)
        at = np.flatnonzero(found < 0)[first]
        own = data.tobytes()
        chunks = [own[a:b] for a, b in zip(starts[at].tolist(), stops[at].tolist(), strict=True)]
        if not full and (table.n + len(chunks) > table.limit or len(table.text) > CHUNK_BYTES):
            table.shrink()
        table.add(new, chunks, _encoded([c.decode() for c in chunks], t, ends), np.zeros(len(new), dtype=np.int64))
        found = table.find(hashes)
        if (found < 0).any():  # what was known went with the half that wasn't kept
            return _together(texts, t, ends, table, full=True)
    np.add.at(table.met, found, 1)
    # All bytes of all chunks against those in the table.
    alike = (table.text_at[found + 1] - table.text_at[found] == sizes).all() and (table.text[_spread(table.text_at[found], sizes)] == data[_spread(starts, sizes)]).all()
    if not alike:
        return [_pack(t.encode(text, add_special_tokens=False).ids) for text in texts]
    counts = table.ids_at[found + 1] - table.ids_at[found]
    ids = table.ids[_spread(table.ids_at[found], counts)].tobytes()
    upto = np.r_[0, np.cumsum(counts)]
    cuts = (4 * upto[np.searchsorted(starts, np.cumsum([len(r) + 1 for r in raw]))]).tolist()
    return [ids[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]


def _parts(text: str) -> Iterator[str]:
    """A long text in parts of about _BYTES that end at white space."""
    at = 0
    while at < len(text):
        m = _SPACE.search(text, at + _BYTES)
        stop = m.end() if m else len(text)
        yield text[at:stop]
        at = stop


def encode(texts: list[str | None], path: str) -> list[bytes]:
    """The ids of each text (null: none) as little-endian unsigned 32-bit integers."""
    t, ends, table = _open(path, CHUNKS)
    out: list[bytes] = [b""] * len(texts)
    group: list[int] = []
    waiting = 0

    def flush() -> None:
        for i, ids in zip(group, _together([texts[i] for i in group], t, ends, table), strict=True):
            out[i] = ids
        group.clear()

    for i, text in enumerate(texts):
        if not text:
            continue
        if len(text) > _BYTES and "<|" not in text and SAFE.fullmatch(text):
            out[i] = b"".join(_together([part], t, ends, table)[0] for part in _parts(text))
            continue
        if "<|" in text or not SAFE.fullmatch(text):
            out[i] = _pack(t.encode(text, add_special_tokens=False).ids)
            continue
        group.append(i)
        waiting += len(text)
        if waiting > _BYTES or len(group) >= _TOGETHER:
            flush()
            waiting = 0
    if group:
        flush()
    return out
