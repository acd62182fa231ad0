"""Fill-in-middle transformation as one numpy kernel over an Arrow batch's UTF-8 buffers.

A text is cut into lines (a line feed belongs to the line that it ends).  Two cuts, drawn from a hash of doc_id,
make a prefix, a middle and a suffix, which are put out with markers in one of two orders:

    psm: <P>prefix<S>suffix<M>middle      spm: <S>suffix<P>prefix<M>middle

All rows of a batch are treated together: a table gives each byte its class (line feed, first byte of a code point,
other), a line begins at a document's first byte and after each line feed, a cumulative sum numbers the lines and is
reset at each document by what it was there, one searchsorted over it finds the bytes of all rows' cuts, and one
gather lays the pieces out.  ``restore`` rebuilds the texts from outputs and forms, which holds since a text that has
a marker in it stays plain.

The draws: h1 to h4 are the first four groups of eight hex digits of sha256("<seed>:<doc_id>"); the cuts are h1 and
h2 modulo (lines + 1); a text is transformed if h3 % 100 < rate, to spm if h4 % 100 < spm_rate.

Defined cases: a null or empty text is plain and empty; a null doc_id draws as an empty one; rows that repeat a
doc_id have equal draws; a text of any length is cut whole (a worker holds about 20 bytes for each byte of a batch's
slice or, if that is longer, of one text); a cut at either end gives an empty piece; other columns are carried along,
those named like an added one are replaced; no rows, no result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestrand.llm.scratch import without
from lodestrand.llm.textkit import slices

#: The markers of prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
ADDED = ("n_lines", "form", "prefix_chars", "middle_chars", "fim_text")
FORMS = np.array(["plain", "psm", "spm"])
_MARKS = np.frombuffer(PREFIX + SUFFIX + MIDDLE, np.uint8)
#: Class of a byte: 0 goes on a code point, 1 begins one, 2 is a line feed.
_CLASS = np.array([2 if b == 10 else 0 if 0x80 <= b < 0xC0 else 1 for b in range(256)], np.uint8)
_LETTER = np.zeros(256, np.int8)
_LETTER[[PREFIX[1], SUFFIX[1], MIDDLE[1]]] = 1, 2, 3


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string array without nulls, and where each row's begin and end."""
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None else np.zeros(0, np.uint8)), off - off[0]


def markers(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where a marker begins, and its kind: 1 prefix, 2 suffix, 3 middle."""
    at = np.flatnonzero((d[:-2] == PREFIX[0]) & (d[2:] == PREFIX[2]) & (_LETTER[d[1:-1]] > 0)) if len(d) > 2 else np.zeros(0, np.int64)
    return at, _LETTER[d[at + 1]]


def gather(source: np.ndarray, begin: np.ndarray, size: np.ndarray, pieces: int) -> pa.Array:
    """Strings made of ``pieces`` runs of the source's bytes each, given row by row."""
    ends = np.cumsum(size)
    out = np.empty(int(ends[-1]) if len(ends) else 0, np.uint8)
    if len(size) == pieces:
        for b, n, e in zip(begin.tolist(), size.tolist(), ends.tolist(), strict=True):
            out[e - n : e] = source[b : b + n]
    else:
        out[:] = source[np.repeat(begin - (ends - size), size) + np.arange(len(out))]
    offsets = np.concatenate([[0], ends[pieces - 1 :: pieces]]).astype(np.int64)
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(out)).cast(pa.string())


def lines_of(d: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The class of each byte, the running number of lines up to each byte, and that number before each document."""
    kind = _CLASS[d]
    opens = np.zeros(len(d), bool)
    opens[off[:-1][off[:-1] < off[1:]]] = True
    opens[1:] |= kind[:-1] == 2
    number = np.cumsum(opens, dtype=np.int32)
    return kind, number, np.concatenate([np.zeros(1, np.int32), number])[off]


def transform(texts: pa.Array, draws: np.ndarray, rate: int, spm_rate: int) -> dict[str, pa.Array]:
    """What ``fim`` adds, for a string array without nulls and four draws a row."""
    d, off = buffers(texts)
    rows = len(texts)
    kind, number, before = lines_of(d, off)
    n = np.diff(before).astype(np.int64)
    at, _ = markers(d)
    marked = np.zeros(rows, bool)
    if len(at):
        row = np.searchsorted(off, at, "right") - 1
        marked[row[at + 3 <= off[row + 1]]] = True
    plain = marked | (n == 0) | (draws[:, 2] % 100 >= rate)
    form = np.where(plain, 0, np.where(draws[:, 3] % 100 < spm_rate, 2, 1))
    cuts = np.sort(draws[:, :2] % (n + 1)[:, None], axis=1)
    # The byte where line u of a document begins is the first whose running number exceeds the document's own by u.
    cut = np.searchsorted(number, (before[:-1, None] + cuts + 1).astype(np.int32))
    cut = np.clip(cut, off[:-1, None], off[1:, None])
    spots = np.column_stack([off[:-1], cut])
    chars = np.add.reduceat(np.append(kind > 0, False), spots.ravel(), dtype=np.int64).reshape(rows, 3) if rows else np.zeros((0, 3), np.int64)
    chars[np.diff(np.column_stack([spots, off[1:]])) == 0] = 0
    source = np.concatenate([d, _MARKS])
    mark = len(d) + np.arange(3) * 3
    text, (a, b), e = off[:-1], cut.T, off[1:]
    zero = np.zeros(rows, np.int64)
    three = zero + 3
    psm = ((mark[0] + zero, three), (text, a - text), (mark[1] + zero, three), (b, e - b), (mark[2] + zero, three), (a, b - a))
    spm = (psm[2], psm[3], psm[0], psm[1], psm[4], psm[5])
    whole = ((text, e - text), *[(zero, zero)] * 5)
    begin, size = (np.column_stack([np.choose(form, [whole[k][i], psm[k][i], spm[k][i]]) for k in range(6)]).ravel() for i in range(2))
    hidden = form == 0
    return {
        "n_lines": pa.array(n),
        "form": pa.array(FORMS[form], pa.string()),
        "prefix_chars": pa.array(chars[:, 0], mask=hidden),
        "middle_chars": pa.array(chars[:, 1], mask=hidden),
        "fim_text": gather(source, begin, size, 6),
    }


def rebuild(outputs: pa.Array, forms: np.ndarray) -> pa.Array:
    """The texts that gave ``outputs``."""
    d, off = buffers(outputs)
    rows = len(outputs)
    at, kind = markers(d)
    row = np.searchsorted(off, at, "right") - 1
    spot = np.zeros((rows, 4), np.int64)
    moved = forms != "plain"
    use = moved[row]
    spot[row[use], kind[use]] = at[use]
    _, p, s, m = spot.T
    end = off[1:]
    psm = forms == "psm"
    begin = np.column_stack([np.where(moved, p + 3, off[:-1]), m + 3, s + 3])
    stop = np.column_stack([np.where(moved, np.where(psm, s, m), end), end, np.where(psm, m, p)])
    size = np.where(moved[:, None] | (np.arange(3) == 0), stop - begin, 0)
    return gather(d, np.where(size > 0, begin, 0).ravel(), size.ravel(), 3)


def draws(seed: int) -> list[Column]:
    """h1 to h4 of a row."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long").alias(f"_h{k + 1}") for k in range(4)]


def fim(docs: DataFrame, seed: int = 7, rate: int = 100, spm_rate: int = 50) -> DataFrame:
    """``docs`` with n_lines, form, prefix_chars, middle_chars (null if plain) and fim_text."""
    docs = without(docs, *ADDED)
    width, text_at = len(docs.columns), [c.lower() for c in docs.columns].index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(text_at)):
                h = np.column_stack([c.to_numpy(zero_copy_only=False) for c in part.columns[width : width + 4]]).reshape(-1, 4)
                out = transform(part.column(text_at).fill_null(""), h, rate, spm_rate)
                yield pa.record_batch([*part.columns[:width], *out.values()], names=[*batch.schema.names[:width], *out])

    kinds = (T.LongType(), T.StringType(), T.LongType(), T.LongType(), T.StringType())
    schema = T.StructType([*docs.schema.fields, *[T.StructField(c, t) for c, t in zip(ADDED, kinds, strict=True)]])
    return docs.select("*", *draws(seed)).mapInArrow(run, schema)


def restore(out: DataFrame, name: str = "restored_text") -> DataFrame:
    """``out`` (with form and fim_text) with the text that each row was made of; rows without a form have none."""
    out = without(out, name)
    at, form_at = ([c.lower() for c in out.columns].index(c) for c in ("fim_text", "form"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch.rename_columns([str(i) for i in range(batch.num_columns)]), str(at)):
                forms = np.array(part.column(form_at).fill_null("plain").to_pylist(), object)
                text = rebuild(part.column(at).fill_null(""), forms)
                yield pa.record_batch([*part.columns, text], names=[*batch.schema.names, name])

    return out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField(name, T.StringType())]))
