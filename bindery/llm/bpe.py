"""Byte-level BPE: encoding by batched numpy merge rounds, and decoding.

Texts are cut into pre-tokens with array operations over a flat byte buffer.
The distinct pre-tokens not met before are merged together: their symbols lie
in one flat array, the rank of every adjacent pair is found by binary search
over the sorted pair keys, and each round merges the lowest-ranked pair of
every word at once. Results are kept in a hash table of bounded size, so a
pre-token is merged about once per worker.

Identifiers equal those of the tokenizers library with special tokens in the
text recognised, none added, and no truncation or padding.
"""

from __future__ import annotations

import functools
import hashlib
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .flat import bounds, mix, ragged, span_hashes, text_slices

_NONE = np.int32(2**31 - 1)
_LETTER, _NUMBER, _OTHER, _WHITE, _BLANK = range(5)
#: Pre-tokens that the table of known ones holds before it starts anew.
KNOWN = 1 << 20


def _byte_characters() -> dict[str, int]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@functools.cache
def _classes() -> np.ndarray:
    """Class of each code point: letter, number, white space, blank or other."""
    kind = {"L": _LETTER, "N": _NUMBER}
    table = np.full(0x110000, _OTHER, np.uint8)
    for c in range(0x110000):
        table[c] = kind.get(unicodedata.category(chr(c))[0], _OTHER)
    # The code points with the Unicode property White_Space.
    table[[*range(0x09, 0x0E), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _WHITE
    table[0x20] = _BLANK
    return table


class ByteBPE:
    """Encoder and decoder of one vocabulary file."""

    def __init__(self, path: str, known: int = KNOWN):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, to_byte = spec["model"]["vocab"], _byte_characters()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *special.values()]) + 1
        pieces = [b""] * self.size
        for token, i in vocab.items():
            pieces[i] = bytes(to_byte[c] for c in token)
        for token, i in special.items():
            pieces[i] = token.encode()
        self.special = [(t.encode(), i) for t, i in special.items()]
        self.piece_len = np.fromiter(map(len, pieces), np.int64, self.size)
        self.piece_at = bounds(self.piece_len)[:-1]
        self.piece_data = np.frombuffer(b"".join(pieces), np.uint8)
        self.byte_id = np.zeros(256, np.int32)
        for c, b in to_byte.items():
            self.byte_id[b] = vocab[c]
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        left = np.fromiter((vocab[a] for a, _ in merges), np.int64, len(merges))
        right = np.fromiter((vocab[b] for _, b in merges), np.int64, len(merges))
        self.made = np.fromiter((vocab[a + b] for a, b in merges), np.int32, len(merges))
        keys = left * self.size + right
        order = np.argsort(keys, kind="stable")
        self.pair_keys, self.pair_rank = keys[order], order.astype(np.int32)
        self._limit = known
        self._clear(known)

    # ---- pre-tokens

    def pre_tokens(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int]]]:
        """Byte positions where pre-tokens start, and (position, id) of special tokens. Pre-tokens cover all bytes."""
        n = len(data)
        at = np.flatnonzero((data & 0xC0) != 0x80)
        lead = data[at]
        kind = _classes()[:128][np.minimum(lead, 127)]
        wide = np.flatnonzero(lead >= 0x80)
        if len(wide):
            b = np.concatenate([data, np.zeros(3, np.uint8)])
            p = at[wide]
            b0, b1, b2, b3 = (b[p + k].astype(np.int32) & m for k, m in ((0, 0xFF), (1, 0x3F), (2, 0x3F), (3, 0x3F)))
            point = np.where(b0 < 0xE0, (b0 & 0x1F) << 6 | b1, np.where(b0 < 0xF0, (b0 & 0x0F) << 12 | b1 << 6 | b2, (b0 & 0x07) << 18 | b1 << 12 | b2 << 6 | b3))
            kind[wide] = _classes()[np.minimum(point, 0x10FFFF)]
        count = len(at)
        first = np.zeros(count + 3, bool)
        first[np.searchsorted(at, offsets[:-1][offsets[:-1] < offsets[1:]])] = True
        first[count:] = True
        specials = self._find_specials(data, offsets)
        for pos, end, _ in specials:
            first[np.searchsorted(at, [pos, end])] = True
        family = np.minimum(kind, _WHITE)
        change = first[:count].copy()
        change[1:] |= family[1:] != family[:-1]
        start = change.copy()
        # A blank before a run joins it; other white space before a run stands alone.
        i = np.flatnonzero(change[1:] & ~first[1:count] & (family[1:] != _WHITE) & (family[:-1] == _WHITE)) + 1
        start[i - 1] = True
        start[i] = kind[i - 1] == _WHITE
        # 's 't 'm 'd 're 've 'll are pre-tokens of their own.
        i = np.flatnonzero(start & (lead == 39) & ~first[1 : count + 1])
        if len(i):
            c = np.concatenate([lead, np.zeros(3, np.uint8)])
            one, two = c[i + 1], np.where(first[i + 2], 0, c[i + 2])
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for hit, size in ((short, 2), (long, 3)):
                j = i[hit]
                start[j + 1] = False
                rest = j + size
                rest = rest[rest < count]
                start[rest[~change[rest]]] = True
        for pos, end, _ in specials:
            a, b = np.searchsorted(at, [pos, end])
            start[a + 1 : b] = False
        return at[start], [(pos, i) for pos, _, i in specials]

    def _find_specials(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int]]:
        found, raw = [], data.tobytes()
        for token, i in self.special:
            pos = raw.find(token)
            while pos >= 0:
                k = int(np.searchsorted(offsets, pos, "right"))
                inside = pos + len(token) <= offsets[k]
                if inside:
                    found.append((pos, pos + len(token), i))
                pos = raw.find(token, pos + (len(token) if inside else 1))
        return sorted(found)

    # ---- merging

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) * self.size + b
        i = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[i] == key, self.pair_rank[i], _NONE)

    def merge(self, symbols: np.ndarray, lengths: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Merge words given as flat symbols; yields (word numbers, their lengths, flat ids) as words finish."""
        word = np.arange(len(lengths))
        rank = np.full(len(symbols), _NONE, np.int32)
        if len(symbols) > 1:
            rank[:-1] = self._ranks(symbols[:-1], symbols[1:])
        rank[np.cumsum(lengths) - 1] = _NONE
        while len(word):
            low = np.minimum.reduceat(rank, bounds(lengths)[:-1])
            open_ = low < _NONE
            if not open_.all():
                keep = np.repeat(open_, lengths)
                yield word[~open_], lengths[~open_], symbols[~keep]
                word, lengths, low, symbols, rank = word[open_], lengths[open_], low[open_], symbols[keep], rank[keep]
                if not len(word):
                    return
            owner = np.repeat(np.arange(len(word)), lengths)
            pos = np.flatnonzero(rank == low[owner])
            # Of overlapping pairs (a a a) every second one, from the left.
            step = np.ones(len(pos), bool)
            step[1:] = pos[1:] != pos[:-1] + 1
            run = np.flatnonzero(step)
            pos = pos[(np.arange(len(pos)) - np.repeat(run, np.diff(np.append(run, len(pos))))) % 2 == 0]
            symbols[pos] = self.made[rank[pos]]
            rank[pos] = rank[pos + 1]  # none where the word ends behind the pair
            keep = np.ones(len(symbols), bool)
            keep[pos + 1] = False
            lengths = lengths - np.bincount(owner[pos], minlength=len(word))
            spot = pos - np.arange(len(pos))
            symbols, rank = symbols[keep], rank[keep]
            last = np.cumsum(lengths) - 1
            ends = np.zeros(len(symbols) + 1, bool)
            ends[last] = True
            ends[-1] = True
            spot = np.concatenate([spot, spot - 1])
            spot = np.unique(spot[(spot >= 0)])
            rank[spot[ends[spot]]] = _NONE
            spot = spot[~ends[spot]]
            rank[spot] = self._ranks(symbols[spot], symbols[spot + 1])

    # ---- table of known pre-tokens

    def _clear(self, known: int) -> None:
        self._known, self._count, self._used = known, 0, 0
        self._keys = np.zeros(2 * (1 << (known - 1).bit_length()), np.uint64)
        self._at = np.zeros(len(self._keys), np.int64)
        self._len = np.zeros(len(self._keys), np.int32)
        self._pool = np.zeros(4 * known, np.int32)

    def _slots(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slot of each hash, or of the free place that ends the search for it; and whether it was found."""
        mask = np.uint64(len(self._keys) - 1)
        slot = (h & mask).astype(np.int64)
        todo = np.arange(len(h))
        found = np.zeros(len(h), bool)
        while len(todo):
            k = self._keys[slot[todo]]
            same = k == h[todo]
            found[todo[same]] = True
            todo = todo[~same & (k != 0)]
            slot[todo] = (slot[todo] + 1) & int(mask)
        return slot, found

    def _learn(self, h: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> None:
        at, size = np.zeros(len(h), np.int64), np.zeros(len(h), np.int32)
        for who, n, ids in self.merge(self.byte_id[data[ragged(starts, lengths)]], lengths):
            if self._used + len(ids) > len(self._pool):
                self._pool = np.concatenate([self._pool, np.zeros(max(len(self._pool), len(ids)), np.int32)])
            self._pool[self._used : self._used + len(ids)] = ids
            at[who], size[who] = self._used + bounds(n)[:-1], n
            self._used += len(ids)
        todo = np.arange(len(h))
        while len(todo):
            slot, _ = self._slots(h[todo])
            self._keys[slot] = h[todo]  # of several for one place, one wins
            won = self._keys[slot] == h[todo]
            i = todo[won]
            self._at[slot[won]], self._len[slot[won]] = at[i], size[i]
            todo = todo[~won]
        self._count += len(h)

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts in a flat buffer, and the offsets of each text's ids."""
        if not len(data):
            return np.zeros(0, np.int32), np.zeros(len(offsets), np.int64)
        starts, specials = self.pre_tokens(data, offsets)
        ends = np.append(starts[1:], len(data))
        h = mix(span_hashes(data, starts, ends))
        h[h == 0] = 1
        slot, found = self._slots(h)
        if not found.all():
            miss = np.flatnonzero(~found)
            fresh, where = np.unique(h[miss], return_index=True)
            if self._count + len(fresh) > self._known:
                self._clear(max(self._limit, 1 << len(h).bit_length()))
                miss = np.arange(len(h))
                fresh, where = np.unique(h, return_index=True)
            where = miss[where]
            self._learn(fresh, data, starts[where], ends[where] - starts[where])
            slot, _ = self._slots(h)
        at, size = self._at[slot], self._len[slot].astype(np.int64)
        if specials:
            ids = self._pool[ragged(at, size)]
            spot = np.searchsorted(starts, [p for p, _ in specials])
            before = bounds(size)
            keep = np.ones(len(ids), bool)
            for s, (_, i) in zip(spot, specials, strict=True):
                keep[before[s] + 1 : before[s + 1]] = False
                ids[before[s]] = i
                size[s] = 1
            ids = ids[keep]
        else:
            ids = self._pool[ragged(at, size)]
        return ids, bounds(size)[np.searchsorted(starts, offsets)]

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Flat bytes that the ids stand for, and the offsets of each text's bytes."""
        size = self.piece_len[ids]
        return self.piece_data[ragged(self.piece_at[ids], size)], bounds(size)[offsets]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> ByteBPE:
    """One encoder per worker and vocabulary."""
    return ByteBPE(path)


def _columns(batch: pa.RecordBatch, id_col: str, text: str):
    return batch.column(batch.schema.get_field_index(id_col)), batch.column(batch.schema.get_field_index(text))


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as an array.

    A null or empty text gives an empty array, a null id is kept, repeated
    rows give repeated rows, other columns are ignored, and an empty table
    gives no rows.
    """

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            ident, column = _columns(batch, "doc_id", "text")
            for lo, hi, data, offsets in text_slices(column):
                ids, at = bpe.encode(data, offsets)
                yield pa.RecordBatch.from_arrays([ident.slice(lo, hi - lo), pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text}` AS text").mapInArrow(run, f"doc_id {kind}, ids array<int>")


def decode_documents(tokens: DataFrame, path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(doc_id, text): texts of id arrays; bytes that are no UTF-8 become U+FFFD. A null array gives an empty text."""

    def run(batches):
        bpe = encoder(path)
        for batch in batches:
            column = batch.column(1).fill_null([]) if batch.column(1).null_count else batch.column(1)
            at = np.asarray(column.offsets, dtype=np.int64)
            raw, ends = bpe.decode(np.asarray(column.flatten()), at - at[0])
            raw = raw.tobytes()
            out = [raw[a:b].decode("utf-8", "replace") for a, b in zip(ends[:-1], ends[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    kind = tokens.schema[id_col].dataType.simpleString()
    return tokens.selectExpr(f"`{id_col}` AS doc_id", f"`{ids}` AS ids").mapInArrow(run, f"doc_id {kind}, text string")


def round_trip_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of every whole text, encoded and decoded in one pass.

    Cases as in `encode_documents`; the digests of an empty text are those of
    the empty string.
    """

    def run(batches):
        bpe = encoder(path)
        figures = [b"%d," % i for i in range(bpe.size)]
        width = np.fromiter(map(len, figures), np.int64, bpe.size)
        table = np.zeros((bpe.size, int(width.max())), np.uint8)
        for i, f in enumerate(figures):
            table[i, : len(f)] = list(f)
        used = np.arange(table.shape[1]) < width[:, None]
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            ident, column = _columns(batch, "doc_id", "text")
            for lo, hi, data, offsets in text_slices(column):
                ids, at = bpe.encode(data, offsets)
                flat = table[ids][used[ids]].tobytes()
                cut = bounds(width[ids])[at].tolist()
                raw, ends = bpe.decode(ids, at)
                raw, ends = raw.tobytes(), ends.tolist()
                a = [sha(flat[x : max(x, y - 1)]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
                b = [sha(raw[x:y].decode("utf-8", "replace").encode()) for x, y in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([ident.slice(lo, hi - lo), pa.array(np.diff(at)), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.selectExpr(f"`{id_col}` AS doc_id", f"`{text}` AS text").mapInArrow(run, f"doc_id {kind}, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
