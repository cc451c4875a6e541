"""Vectorised word and shingle hashing over Arrow string buffers."""

import numpy as np
import pyarrow as pa

_U = np.uint64
MULT = 0x9E3779B97F4A7C15
STEP = 0xD1342543DE82EF95


def mix(x):
    """Finaliser with full avalanche over a uint64 array."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def byte_table(lower=True, seed=1):
    """A fixed random 64-bit value for each byte; A-Z count as a-z when `lower`."""
    t = mix(np.arange(1, 257, dtype=_U) * _U(MULT) + _U(seed))
    if lower:
        t[65:91] = t[97:123]
    return t


def space_table():
    t = np.zeros(256, dtype=bool)
    t[[0x20, 9, 10, 11, 12, 13]] = True
    return t


BYTES, SPACES = byte_table(), space_table()


def powers(n):
    """STEP**i and STEP**-i for i < n, modulo 2**64."""
    fwd, back = np.empty(n, dtype=_U), np.empty(n, dtype=_U)
    fwd[0] = back[0] = 1
    inv = pow(STEP, -1, 1 << 64)
    done, f, b = 1, STEP, inv
    while done < n:
        k = min(done, n - done)
        fwd[done : done + k] = fwd[:k] * _U(f)
        back[done : done + k] = back[:k] * _U(b)
        done += k
        f, b = f * f % (1 << 64), b * b % (1 << 64)
    return fwd, back


def string_buffers(array):
    """(bytes as uint8, offsets as int64) of an Arrow string array; nulls count as empty."""
    if isinstance(array, pa.ChunkedArray):
        array = array.combine_chunks()
    if array.null_count:
        array = array.fill_null("")
    kind = np.int64 if pa.types.is_large_string(array.type) or pa.types.is_large_binary(array.type) else np.int32
    _, offs, data = array.buffers()
    if len(array) == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(len(array) + 1, np.int64)
    offs = np.frombuffer(offs, dtype=kind)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    data = np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offs - offs[0]


def small_batches(batches, column="text", most=1 << 20):
    """Slices of the record batches with about `most` bytes of text each, so memory follows neither batch nor row count."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offs = string_buffers(batch.column(batch.schema.get_field_index(column)))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offs, offs[at] + most, side="right")) - 1)
            to = min(to, at + 20000, batch.num_rows)
            yield batch.slice(at, to - at)
            at = to


def word_spans(data, offs):
    """Start and end byte of each word [^\\x20\\x09-\\x0D]+ and, per document, the index of its first word."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offs), np.int64)
    word = ~SPACES[data]
    start, end = word.copy(), word.copy()
    start[1:] &= ~word[:-1]
    end[:-1] &= ~word[1:]
    inner = offs[1:-1]
    inner = inner[(inner > 0) & (inner < len(data))]
    start[inner] = word[inner]
    end[inner - 1] = word[inner - 1]
    s, e = np.flatnonzero(start), np.flatnonzero(end) + 1
    return s, e, np.searchsorted(s, offs)


def span_hasher(data, table=None, pows=None):
    """A function from byte spans (starts, ends) of data to their 64-bit hashes."""
    fwd, back = pows if pows is not None and len(pows[0]) > len(data) else powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=_U)
    np.cumsum((BYTES if table is None else table)[data] * fwd[: len(data)], out=sums[1:])
    return lambda starts, ends: mix((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(_U))


def span_hashes(data, starts, ends, table=None, pows=None):
    """64-bit hash of each byte span."""
    return span_hasher(data, table, pows)(starts, ends)


def shingles(words, first, n):
    """Hashes of the n-word shingles at each word position, and which positions start one inside their document.

    A document of fewer than n words, but at least one, has its whole sequence as one shingle.
    """
    m = len(words)
    counts = np.diff(first)
    out, valid = np.zeros(m, _U), np.zeros(m, bool)
    if not m:
        return out, valid
    if m >= n:
        acc = words[: m - n + 1].copy()
        for j in range(1, n):
            acc *= _U(MULT)
            acc += words[j : m - n + 1 + j]
        out[: m - n + 1] = mix(acc + _U(n))
    last = np.repeat(first[1:], counts)
    valid = np.arange(m) + n <= last
    short = np.flatnonzero((counts > 0) & (counts < n))
    if len(short):
        at, k = first[short], counts[short]
        acc = words[at].copy()
        for j in range(1, n - 1):
            more = k > j
            acc[more] = acc[more] * _U(MULT) + words[at[more] + j]
        out[at] = mix(acc + k.astype(_U))
        valid[at] = True
    return out, valid
