"""TLS records and handshakes of a whole Arrow batch at once.

Records are stepped over for all rows together.  Handshake messages are read from the
contents of a row's handshake records put together, so a message may run over any number of
records; hellos are then walked field by field for all messages together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewire.decode.batch import Bytes, listed, read_once, slices, texts
from tidewire.functions.names import TLS_SUITES

LONGEST_RECORD, MOST_RECORDS = 18_432, 8
CHANGE, ALERT, HANDSHAKE, HEARTBEAT = 20, 21, 22, 24
CLIENT_HELLO, SERVER_HELLO, CERTIFICATE = 1, 2, 11
SERVER_NAME, SUPPORTED_VERSIONS = 0, 43

_INT = T.IntegerType()
RECORD = T.StructType([T.StructField(n, _INT) for n in ("content_type", "version", "length")])
SEGMENT = T.StructType(
    [
        *[T.StructField(n, _INT) for n in ("version", "handshake_type", "handshake_length", "alert_level", "alert")],
        T.StructField("sni", T.StringType()),
        T.StructField("records", T.ArrayType(RECORD)),
        T.StructField("suites", T.ArrayType(_INT)),
        T.StructField("cipher_suites", T.ArrayType(T.StringType())),
    ]
)
SERVER = T.StructType(
    [
        *[T.StructField(n, _INT) for n in ("record_version", "version", "suite", "alert_level", "alert", "certificate_count")],
        T.StructField("certificates", T.ArrayType(T.BinaryType())),
    ]
)


class Records:
    """(row, kind, version, declared length, begin and size of the content) of the records of each row, by row."""

    def __init__(self, source: Bytes, most: int | None, strict: bool) -> None:
        """``strict`` ends a row at a record that is too long; else it is read as far as there are bytes."""
        rows = np.flatnonzero(source.size >= 5)
        at = np.zeros(len(rows), dtype=np.int64)
        found, k = [], 0
        while len(rows) and (most is None or k < most):
            kind, version, length = source.uint(at, 1, rows), source.uint(at + 1, 2, rows), source.uint(at + 3, 2, rows)
            fine = (kind >= CHANGE) & (kind <= HEARTBEAT) & (at + 5 <= source.size[rows])
            if strict:
                fine &= (version >> 8 == 3) & (length <= LONGEST_RECORD)
            rows, at, kind, version, length = (x[fine] for x in (rows, at, kind, version, length))
            left = source.size[rows] - at - 5
            size = np.where(length > LONGEST_RECORD, left, np.minimum(length, left))
            found.append((rows, kind, version, length, at + 5, size))
            more = at + 5 + length <= source.size[rows] if strict else np.ones(len(rows), dtype=bool)
            rows, at = rows[more], (at + 5 + size)[more]
            k += 1
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 6
        order = np.argsort(columns[0], kind="stable")
        self.row, self.kind, self.version, self.length, self.at, self.size = (c[order] for c in columns)

    def first(self, n: int, where: np.ndarray, values: np.ndarray, last: bool = False) -> np.ndarray:
        """The value of each row's first (or last) record among some, -1 without one."""
        out = np.full(n, -1, dtype=np.int64)
        rows, values = self.row[where], values[where]
        out[rows if last else rows[::-1]] = values if last else values[::-1]
        return out


def _part(data: np.ndarray, offsets: np.ndarray) -> Bytes:
    return Bytes(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(data))]))


def handshakes(source: Bytes, records: Records) -> Bytes:
    """The handshake bytes of each row, its records' contents put together."""
    of = records.kind == HANDSHAKE
    data, ends = slices(source.data, source.begin[records.row[of]] + records.at[of], records.size[of])
    return _part(data, ends[np.searchsorted(records.row[of], np.arange(len(source) + 1))])


def messages(stream: Bytes) -> tuple[np.ndarray, ...]:
    """(row, kind, begin, size) of the handshake messages, by row; the last may break off."""
    rows, at, found = np.flatnonzero(stream.size >= 4), None, []
    at = np.zeros(len(rows), dtype=np.int64)
    while len(rows):
        size = np.minimum(stream.uint(at + 1, 3, rows), stream.size[rows] - at - 4)
        found.append((rows, stream.uint(at, 1, rows), at + 4, size))
        at = at + 4 + size
        more = at + 4 <= stream.size[rows]
        rows, at = rows[more], at[more]
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 4
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


class Hellos:
    """Fields of hellos at (row, begin, size) of a stream; what lies past a hello's end is not there."""

    def __init__(self, stream: Bytes, rows: np.ndarray, at: np.ndarray, size: np.ndarray, server: bool) -> None:
        n, end = len(rows), at + size
        self.stream, self.rows = stream, rows
        read = lambda place, width, ok: np.where(ok & (place + width <= end), stream.uint(place, width, rows), 0)
        self.legacy = read(at, 2, np.ones(n, dtype=bool))
        whole = at + 34 < end
        place = at + 35 + read(at + 34, 1, whole)
        if server:
            whole &= place + 2 <= end
            self.suites_at, self.suites = place, np.where(whole, 1, 0)
            place = place + 3
        else:
            whole &= place + 2 <= end
            length = read(place, 2, whole)
            self.suites_at, self.suites = place + 2, np.where(whole, np.clip((end - place - 2) // 2, 0, length // 2), 0)
            place = place + 2 + length
            place = place + 1 + read(place, 1, whole)
        whole &= place + 2 <= end
        stop = np.minimum(end, place + 2 + read(place, 2, whole))
        self.sni_at, self.sni_size, self.version = (np.zeros(n, dtype=np.int64) for _ in range(3))
        live, place = np.flatnonzero(whole), place + 2
        while len(live):
            here, row = place[live], rows[live]
            kind, length = stream.uint(here, 2, row), stream.uint(here + 2, 2, row)
            fits = (here + 4 <= stop[live]) & (here + 4 + length <= stop[live])
            live, here, row, kind, length = (x[fits] for x in (live, here, row, kind, length))
            value = here + 4
            name_size = stream.uint(value + 3, 2, row)
            named = (kind == SERVER_NAME) & (length > 5) & (stream.uint(value, 2, row) + 2 <= length) & (stream.uint(value + 2, 1, row) == 0) & (5 + name_size <= length)
            self.sni_at[live[named]], self.sni_size[live[named]] = (value + 5)[named], name_size[named]
            newer = (kind == SUPPORTED_VERSIONS) & (length >= 2)
            self.version[live[newer]] = stream.uint(value, 2, row)[newer]
            place[live] = value + length

    def names(self) -> pa.Array:
        return texts(self.stream.data, self.stream.begin[self.rows] + self.sni_at, self.sni_size)

    def suite_lists(self) -> tuple[np.ndarray, np.ndarray]:
        """(hello, suite) in order."""
        which = np.repeat(np.arange(len(self.rows)), self.suites)
        nth = np.arange(len(which)) - np.repeat(np.cumsum(self.suites) - self.suites, self.suites)
        return which, self.stream.uint(self.suites_at[which] + 2 * nth, 2, self.rows[which])


def _numbers(values: np.ndarray) -> pa.Array:
    """Integers, null where they are below 0."""
    return pa.array(values.astype(np.int32), mask=values < 0)


def _scatter(n: int, rows: np.ndarray, values: np.ndarray, other: int) -> np.ndarray:
    out = np.full(n, other, dtype=np.int64)
    out[rows] = values
    return out


@read_once
@F.arrow_udf(SEGMENT)
def segments(payloads: pa.Array) -> pa.Array:
    """Up to eight records of each payload, its alert and what its hello says; null without a record.

    The version is the one that a server chose by extension, else that of the first record.
    """
    source = Bytes(payloads)
    n = len(source)
    records = Records(source, MOST_RECORDS, True)
    every = np.ones(len(records.row), dtype=bool)
    alerts = (records.kind == ALERT) & (records.size >= 2)
    stream = handshakes(source, records)
    row, kind, at, size = messages(stream)
    greeting = np.isin(kind, (CLIENT_HELLO, SERVER_HELLO)) & (size >= 38)
    # the first hello of a row counts
    first = np.flatnonzero(greeting)
    first = first[np.unique(row[first], return_index=True)[1]]
    version, handshake = records.first(n, every, records.version), _scatter(n, row[::-1], kind[::-1], 0)
    sni, suites, owners = np.full(n, "", dtype=object), [], []
    for server in (False, True):
        which = first[kind[first] == (SERVER_HELLO if server else CLIENT_HELLO)]
        hello = Hellos(stream, row[which], at[which], size[which], server)
        if server:
            chosen = hello.version > 0
            version[row[which][chosen]] = hello.version[chosen]
        else:
            sni[row[which]] = hello.names().to_pylist()
        handshake[row[which]] = kind[which]
        owner, suite = hello.suite_lists()
        owners.append(row[which][owner])
        suites.append(suite)
    owner, suite = np.concatenate(owners), np.concatenate(suites)
    order = np.argsort(owner, kind="stable")
    listing = pa.StructArray.from_arrays([_numbers(records.kind), _numbers(records.version), _numbers(records.length)], [f.name for f in RECORD])
    columns = [
        _numbers(version),
        _numbers(handshake),
        _numbers(_scatter(n, row[::-1], stream.uint(at - 3, 3, row)[::-1], -1)),
        _numbers(records.first(n, alerts, source.uint(records.at, 1, records.row))),
        _numbers(records.first(n, alerts, source.uint(records.at + 1, 1, records.row))),
        pa.array(sni.tolist(), pa.string()),
        listed(records.row, n, listing),
        listed(owner[order], n, _numbers(suite[order])),
        listed(owner[order], n, pa.array([TLS_SUITES.get(s, f"0x{s:04x}") for s in suite[order].tolist()], pa.string())),
    ]
    return pa.StructArray.from_arrays(columns, [f.name for f in SEGMENT], mask=pa.array(~np.isin(np.arange(n), records.row)))


def _certificates(stream: Bytes, row: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, begin, size) of the certificates in Certificate messages."""
    end = np.minimum(at + size, at + 3 + stream.uint(at, 3, row))
    place, found = at + 3, []
    while len(row):
        length = stream.uint(place, 3, row)
        fits = (place + 3 <= end) & (length > 0) & (place + 3 + length <= end)
        row, place, length, end = row[fits], place[fits], length[fits], end[fits]
        found.append((row, place + 3, length))
        place = place + 3 + length
    columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, dtype=np.int64)] * 3
    order = np.argsort(columns[0], kind="stable")
    return tuple(c[order] for c in columns)


@read_once
@F.arrow_udf(SERVER)
def server_streams(streams: pa.Array) -> pa.Array:
    """What a server answered: version, suite, last alert and certificates; null if it is no TLS.

    The version is that of the supported-versions extension, else of the ServerHello, else null;
    an answer of records without a handshake or an alert is no TLS.
    """
    source = Bytes(streams)
    n = len(source)
    records = Records(source, None, False)
    every = np.ones(len(records.row), dtype=bool)
    alerts = (records.kind == ALERT) & (records.size >= 2)
    stream = handshakes(source, records)
    row, kind, at, size = messages(stream)
    greets = (kind == SERVER_HELLO) & (size >= 2)
    hello = Hellos(stream, row[greets], at[greets], size[greets], True)
    version = _scatter(n, row[greets], np.where(hello.version > 0, hello.version, hello.legacy), -1)
    owner, suite = hello.suite_lists()
    certified = kind == CERTIFICATE
    cert_row, cert_at, cert_size = _certificates(stream, row[certified], at[certified], size[certified])
    raw, ends = slices(stream.data, stream.begin[cert_row] + cert_at, cert_size)
    ders = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cert_row), [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(raw))]).cast(pa.binary())
    tls = np.isin(np.arange(n), np.concatenate([records.row[alerts], records.row[records.kind == HANDSHAKE]]))
    columns = [
        _numbers(records.first(n, every, records.version)),
        _numbers(version),
        _numbers(_scatter(n, hello.rows[owner], suite, -1)),
        _numbers(records.first(n, alerts, source.uint(records.at, 1, records.row), True)),
        _numbers(records.first(n, alerts, source.uint(records.at + 1, 1, records.row), True)),
        _numbers(np.bincount(cert_row, minlength=n)),
        listed(cert_row, n, ders),
    ]
    return pa.StructArray.from_arrays(columns, [f.name for f in SERVER], mask=pa.array(~tls))
