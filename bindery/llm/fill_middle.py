"""Fill-in-the-middle rearrangement by a secondary sort.

Each document is cut into units (white space with the word behind it, white
space at the end) and its units into prefix, middle and suffix. What travels
is pieces: chunks of whole units, keyed by document and by their position in
the output, each part led by its marker. One shuffle brings the pieces of a
document together, sorted by position within the partition; they stream into
an incremental digest, so a document of any length takes the memory of a
piece. For restoration the markers in that stream tell the parts apart, and
the same partitions are sorted again, by place in the original: no further
shuffle.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .flat import SPACE, text_slices, words

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: The parts of a text in order; their place in this list is their place in the original.
MARKERS = (PREFIX, MIDDLE, SUFFIX)
#: Order of the parts in the output of each form.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Per cent of documents that are rearranged, and of these the ones with the suffix first.
RATE, SUFFIX_FIRST = 50, 80
#: Bytes of a piece. Pieces end with a unit; a unit longer than this is cut.
PIECE_BYTES = 1 << 15


def _cuts(ends: np.ndarray, start: int, stop: int, size: int) -> list[int]:
    """Where pieces of the bytes start..stop end: at the last unit end within `size`, or at `size`."""
    out = []
    while stop - start > size:
        at = int(np.searchsorted(ends, start + size, "right")) - 1
        start = int(ends[at]) if at >= 0 and ends[at] > start else start + size
        out.append(start)
    return [*out, stop]


def _chars(data: np.ndarray) -> int:
    return int(np.count_nonzero((data & 0xC0) != 0x80))


def pieces(docs: DataFrame, seed: int = 42, rate: int = RATE, suffix_first: int = SUFFIX_FIRST, piece_bytes: int = PIECE_BYTES, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(row, position, doc_id, n, form, prefix_chars, middle_chars, piece, last): all documents in the order of their output.

    `row` is a number of its own for every row, so ids may be null or repeat.
    The digits of the choice come from the SHA-256 of "seed:id" (a null id is
    written as nothing). Null and empty texts, and texts that hold a marker,
    stay plain.
    """
    names = ["row", "position", "doc_id", "n", "form", "prefix_chars", "middle_chars", "piece", "last"]

    def cut(data, ends, start, stop, digest):
        """(form, prefix_chars, middle_chars, [(lead, bytes)]) of one text, given the ends of its units."""
        n = len(ends)
        h1, h2, h3, h4 = (int(digest[8 * k : 8 * k + 8], 16) for k in range(4))
        raw = data[start:stop]
        if not n or h3 % 100 >= rate or any(m in raw.tobytes() for m in MARKERS):
            form, parts, counts = "plain", [(b"", start, stop)], (None, None)
        else:
            form = "spm" if h4 % 100 < suffix_first else "psm"
            low, high = sorted((h1 % (n + 1), h2 % (n + 1)))
            a, b = (int(ends[k - 1]) if k else start for k in (low, high))
            spans = ((start, a), (a, b), (b, stop))
            parts = [(MARKERS[k], *spans[k]) for k in FORMS[form]]
            counts = (_chars(data[start:a]), _chars(data[a:b]))
        out = []
        for lead, at, end in parts:
            for to in _cuts(ends, at, end, piece_bytes):
                out.append(lead + data[at:to].tobytes())
                lead, at = b"", to
        return n, form, *counts, out

    def run(batches):
        for batch in batches:
            digests = batch.column(3)
            for lo, hi, data, offsets in text_slices(batch.column(2)):
                _, word_ends, at = words(data, offsets)
                position, of, number, form, before, middle, body, last = ([] for _ in range(8))
                for i in range(hi - lo):
                    start, stop = int(offsets[i]), int(offsets[i + 1])
                    ends = word_ends[at[i] : at[i + 1]]
                    if stop > start and SPACE[data[stop - 1]]:
                        ends = np.append(ends, stop)
                    n, kind, p, m, out = cut(data, ends, start, stop, digests[lo + i].as_py())
                    k = len(out)
                    of += [lo + i] * k
                    position += range(k)
                    number += [n] * k
                    form += [kind] * k
                    before += [p] * k
                    middle += [m] * k
                    body += out
                    last += [False] * (k - 1) + [True]
                take = pa.array(of, pa.int64())
                rows, ident = batch.column(0).take(take), batch.column(1).take(take)
                yield pa.RecordBatch.from_arrays([rows, pa.array(position, pa.int64()), ident, pa.array(number, pa.int64()), pa.array(form, pa.string()), pa.array(before, pa.int64()), pa.array(middle, pa.int64()), pa.array(body, pa.binary()), pa.array(last, pa.bool_())], names)

    kind = docs.schema[id_col].dataType.simpleString()
    ident = F.col(f"`{id_col}`")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(ident.cast("string"), F.lit(""))), 256)
    rows = docs.select(F.monotonically_increasing_id().alias("row"), ident.alias("doc_id"), F.col(f"`{text}`").alias("text"), digest.alias("digest"))
    return rows.mapInArrow(run, f"row bigint, position bigint, doc_id {kind}, n bigint, form string, prefix_chars bigint, middle_chars bigint, piece binary, last boolean")


def assemble(cut: DataFrame) -> DataFrame:
    """`cut` with the pieces of a document in one partition, in the order of the output."""
    return cut.repartition("row").sortWithinPartitions("row", "position")


_KEPT = ["doc_id", "n", "form", "prefix_chars", "middle_chars"]


def transform(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output): the rearranged text of every document.

    A row per row of `docs`; null texts give an empty output. No rows in, no
    rows out. Other columns of `docs` are not looked at.
    """

    def run(batches):
        held, last = [], None

        def row():
            text = b"".join(held).decode()
            return pa.RecordBatch.from_arrays([*last.columns, pa.array([text], pa.string())], [*_KEPT, "output"])

        for batch in batches:
            ident, kept = np.asarray(batch.column(0)), batch.select(_KEPT)
            for i in range(batch.num_rows):
                if last is not None and ident[i] != current:
                    yield row()
                    held = []
                current, last = ident[i], kept.slice(i, 1)
                held.append(batch.column(7)[i].as_py())
        if last is not None:
            yield row()

    cut = assemble(pieces(docs, **settings))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cut.schema.fields if f.name in _KEPT)
    return cut.mapInArrow(run, f"{kinds}, output string")


def restore(output: str, form: str) -> str:
    """The text that `form` made `output` of."""
    if form == "plain":
        return output
    at = {m: output.index(m.decode()) for m in MARKERS}
    edges = [*sorted(at.values()), len(output)]
    return "".join(output[at[m] + len(m) : edges[edges.index(at[m]) + 1]] for m in MARKERS)


def round_trip_digests(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256), a row per row of `docs`.

    The second digest is of the text that is put together again from the
    pieces of the output. Nulls, repeats and empty tables as in `transform`.
    """

    def forward(batches):
        """The pieces as they are, without markers but with the part that those name; the last of a document has the digest."""
        current, digest, part = None, None, 0
        for batch in batches:
            ident, form, last, body = np.asarray(batch.column(0)), batch.column(4).to_pylist(), batch.column(8).to_pylist(), batch.column(7).to_pylist()
            parts, sums = [0] * len(ident), [None] * len(ident)
            for i, piece in enumerate(body):
                if ident[i] != current:
                    current, digest, part = ident[i], hashlib.sha256(), 0
                digest.update(piece)
                if form[i] != "plain" and piece[:3] in MARKERS:
                    part, body[i] = MARKERS.index(piece[:3]), piece[3:]
                parts[i] = part
                if last[i]:
                    sums[i] = digest.hexdigest()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(parts, pa.int32()), *[batch.column(k) for k in range(1, 7)], pa.array(body, pa.binary()), pa.array(sums, pa.string())], ["row", "part", *batch.schema.names[1:8], "output_sha256"])

    def back(batches):
        current, held, digest, found = None, None, None, None

        def row():
            return pa.RecordBatch.from_arrays([*held.columns, pa.array([found], pa.string()), pa.array([digest.hexdigest()], pa.string())], [*_KEPT, "output_sha256", "restored_sha256"])

        for batch in batches:
            ident, body, sums, kept = np.asarray(batch.column(0)), batch.column(8), batch.column(9), batch.select(_KEPT)
            done = []
            for i in range(batch.num_rows):
                if ident[i] != current:
                    if held is not None:
                        done.append(row())
                    current, held, digest, found = ident[i], kept.slice(i, 1), hashlib.sha256(), None
                digest.update(body[i].as_buffer())
                found = sums[i].as_py() or found
            if done:
                yield pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        if held is not None:
            yield row()

    cut = pieces(docs, **settings)
    kinds = {f.name: f.dataType.simpleString() for f in cut.schema.fields}
    kept = ", ".join(f"{c} {kinds[c]}" for c in _KEPT)
    ordered = assemble(cut)
    streamed = ordered.mapInArrow(forward, f"row bigint, part int, position bigint, {kept}, piece binary, output_sha256 string")
    return streamed.sortWithinPartitions("row", "part", "position").mapInArrow(back, f"{kept}, output_sha256 string, restored_sha256 string")


_UNIT = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+"
SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
u AS (SELECT doc_id, t, regexp_extract_all(t, '{_UNIT}') AS w, CAST('0x' || h[1:8] AS BIGINT) AS h1, CAST('0x' || h[9:16] AS BIGINT) AS h2,
  CAST('0x' || h[17:24] AS BIGINT) AS h3, CAST('0x' || h[25:32] AS BIGINT) AS h4 FROM d),
c AS (SELECT *, len(w) AS n, least(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS p, greatest(h1 % (len(w) + 1), h2 % (len(w) + 1)) AS q FROM u),
f AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= {RATE} THEN 'plain'
  WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(w[1:p], '') AS a, array_to_string(w[p + 1:q], '') AS b, array_to_string(w[q + 1:n], '') AS z FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || a || '<S>' || z || '<M>' || b ELSE '<S>' || z || '<P>' || a || '<M>' || b END) AS output_sha256,
  sha256(t) AS restored_sha256 FROM f
"""
