"""Finding stored quotes in a corpus with the tolerance of `find_anchor`.

A quote is found exactly, without regard to white space, without regard to
anything but letters, digits and Chinese characters, or by the first twelve of
those. Each of these implies the last, so a quote has one key: the hash of the
head of its cleaned form (of a weaker form where nothing is left by cleaning).
Texts take a rolling hash over the same form and probe a bit map of fixed size
that holds all keys; only places that hit become rows. Those join the quotes,
and the texts they were found in are searched level by level. A table of the
characters that each form keeps leads back to offsets in the text.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..functions.anchors import HEAD_CHARS
from ..functions.text import SPACE_CHARS
from ..session import cut_lineage

#: Bits of the map of keys: 1 MiB whatever the number of quotes. More quotes only mean more places that turn out wrong.
MAP_BITS = 1 << 23
_PER_BUCKET = 32_768
#: Quotes that are looked for in one copy of a text.
PER_COPY = 256

_UNCLEAN = re.compile("[^一-龥a-zA-Z0-9]")
_SPACES = [ord(c) for c in SPACE_CHARS]
_NO_SPACE = dict.fromkeys(_SPACES)
#: Forms of a text, strongest first: what cleaning leaves, all but white space, all.
CLEAN, SPACELESS, WHOLE = range(3)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def kept(form: int, p: np.ndarray) -> np.ndarray:
    """Places of the characters that a form keeps."""
    if form == CLEAN:
        low = p | 0x20
        letters = (low >= 0x61) & (low <= 0x7A) & (p < 0x80)
        return np.flatnonzero(letters | ((p >= 0x30) & (p <= 0x39)) | ((p >= 0x4E00) & (p <= 0x9FA5)))
    if form == SPACELESS:
        return np.flatnonzero(~np.isin(p, _SPACES))
    return np.arange(len(p))


def rolled(p: np.ndarray, size: int, form: int) -> np.ndarray:
    """A 64-bit hash of each run of `size` characters; forms and sizes do not mix."""
    n = max(len(p) - size + 1, 0)
    h = np.full(n, size * 4 + form, np.uint64)
    for j in range(size):
        h = (h * _BASE) ^ p[j : j + n].astype(np.uint64)
        h ^= h >> np.uint64(29)
    return h * _BASE


def head(quote: str) -> tuple[int, int, int]:
    """(form, size, hash) of a quote's key."""
    p = points(quote)
    for form in (CLEAN, SPACELESS, WHOLE):
        own = p[kept(form, p)][:HEAD_CHARS]
        if len(own):
            return form, len(own), int(rolled(own, len(own), form).view(np.int64)[0])
    raise ValueError("an empty quote has no key")


class Searched:
    """A text with the forms it is searched in, each made when it is first asked for."""

    def __init__(self, text: str):
        self.text, self._forms, self._points = text, {}, None

    def form(self, form: int) -> tuple[str, np.ndarray]:
        if form not in self._forms:
            if self._points is None:
                self._points = points(self.text)
            at = kept(form, self._points)
            self._forms[form] = (_reduced(form, self.text), at)
        return self._forms[form]

    def find(self, quote: str) -> tuple[int, int]:
        """(level, offset) as `find_anchor` gives them; (0, -1) if nowhere."""
        at = self.text.find(quote)
        if at >= 0:
            return 1, at
        clean = _reduced(CLEAN, quote)
        for level, form, wanted in ((2, SPACELESS, _reduced(SPACELESS, quote)), (3, CLEAN, clean), (4, CLEAN, clean[:HEAD_CHARS])):
            if wanted:
                short, places = self.form(form)
                at = short.find(wanted)
                if at >= 0:
                    return level, int(places[at])
        return 0, -1


def _reduced(form: int, text: str) -> str:
    return _UNCLEAN.sub("", text) if form == CLEAN else text.translate(_NO_SPACE)


def _keyed(quotes: DataFrame) -> DataFrame:
    """`quotes` with _form, _size and _key; null and empty quotes are left out."""

    def run(batches):
        for batch in batches:
            keys = [head(q) for q in batch.column(batch.schema.get_field_index("quote")).to_pylist()]
            form, size, key = (np.array([k[i] for k in keys], t) for i, t in enumerate((np.int32, np.int32, np.int64)))
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, (form, size, key))], [*batch.schema.names, "_form", "_size", "_key"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in quotes.schema.fields)
    return quotes.where("length(quote) > 0").mapInArrow(run, f"{kinds}, _form int, _size int, _key bigint")


def _key_map(keyed: DataFrame, bits: int) -> np.ndarray:
    place = F.pmod("_key", F.lit(bits)) + 1
    rows = keyed.groupBy(F.bitmap_bucket_number(place).alias("b")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("m"))
    out = np.zeros(bits // 8, np.uint8)
    for r in rows.collect():  # bits / 32768 rows of 4 KiB
        at = (r["b"] - 1) * (_PER_BUCKET // 8)
        out[at : at + _PER_BUCKET // 8] = np.frombuffer(r["m"], np.uint8)
    return out


def locate_quotes(docs: DataFrame, quotes: DataFrame, bits: int = MAP_BITS, per_copy: int = PER_COPY) -> DataFrame:
    """(doc_id, quote columns, level, quote_offset): where each quote stands first in each text.

    docs(doc_id, text); quotes(quote, ...). Levels and offsets (characters,
    from 0) are those of `find_anchor`; pairs that no level finds have no row.
    Null and empty texts and quotes are found nowhere. A row of `docs` that is
    repeated gives its rows again.

    Only hashes of places where some key may stand are shuffled, and a text
    goes to a search once for every `per_copy` quotes that may be in it.
    """
    names = list(quotes.columns)
    keyed = cut_lineage(_keyed(quotes))
    sizes = [(r["_form"], r["_size"]) for r in keyed.select("_form", "_size").distinct().collect()]  # three forms, a few sizes
    context = docs.sparkSession.sparkContext
    keys = context.broadcast(_key_map(keyed, bits))  # of fixed size

    def probe(batches):
        for batch in batches:
            rows, hashes = [], []
            for i, text in enumerate(batch.column(2).to_pylist()):
                p = points(text)
                forms = {form: p[kept(form, p)] for form in {f for f, _ in sizes}}
                for form, size in sizes:
                    h = rolled(forms[form], size, form)
                    at = (h & np.uint64(bits - 1)).astype(np.int64)
                    h = np.unique(h[keys.value[at >> 3] >> (at & 7).astype(np.uint8) & 1 == 1])
                    rows.append(np.full(len(h), i))
                    hashes.append(h.view(np.int64))
            at = pa.array(np.concatenate(rows) if rows else np.zeros(0, np.int64))
            found = np.concatenate(hashes) if hashes else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(found)], ["doc_id", "k", "_key"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.xxhash64("text").alias("k"), "text").where("length(text) > 0")
    offered = texts.mapInArrow(probe, f"doc_id {kind}, k bigint, _key bigint")
    wanted = F.struct(*[F.col(f"`{c}`") for c in quotes.columns])
    pairs = cut_lineage(offered.join(keyed.select("_key", wanted.alias("_q")), "_key").select("doc_id", "k", "_q").distinct())
    same = lambda a, b: a["doc_id"].eqNullSafe(b["_d"]) & (a["k"] == b["_k"])
    copies = pairs.groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k")).agg(F.ceil(F.count(F.lit(1)) / per_copy).alias("_copies"))
    dealt = pairs.join(copies, same(pairs, copies)).select("doc_id", "k", "_q", F.pmod(F.xxhash64("_q"), F.col("_copies")).alias("_copy"))
    lists = dealt.groupBy(F.col("doc_id").alias("_d"), F.col("k").alias("_k"), "_copy").agg(F.collect_list("_q").alias("_qs"))
    met = texts.join(lists, same(texts, lists)).select("doc_id", "text", "_qs")

    def search(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                listed = batch.column(2).slice(i, 1).flatten()
                text = Searched(batch.column(1)[i].as_py())
                found = np.array([text.find(q) for q in listed.field("quote").to_pylist()], np.int64).reshape(-1, 2)
                some = np.flatnonzero(found[:, 0])
                listed = listed.take(pa.array(some))
                ident = batch.column(0).take(pa.array(np.full(len(some), i)))
                columns = [listed.field(c) for c in names]
                yield pa.RecordBatch.from_arrays([ident, *columns, pa.array(found[some, 0].astype(np.int32)), pa.array(found[some, 1])], ["doc_id", *names, "level", "quote_offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in quotes.schema.fields)
    return met.mapInArrow(search, f"doc_id {kind}, {kinds}, level int, quote_offset bigint")
