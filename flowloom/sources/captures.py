"""Capture files (pcap and pcapng) as a Spark data source.

A file is read in byte ranges, one task each, so a folder of rotated captures and one very large capture are both read in
parallel. Capture files have no marks between records: a task finds a first record in its range by a chain of
plausible headers. Such a guess can be wrong (a capture may hold another capture in its payloads), so
no packet is taken on its word. A first job walks the record headers of all ranges; the walk of a range must end where the
next range begins, and a range that began elsewhere is walked again from the right place. The ranges
that are read then have known first records, numbers and interfaces, and give the same packets for every range size.

A task takes the packet fields of a whole batch at once from the raw bytes. Kept are IPv4 packets with TCP or UDP.

What a file holds besides is told by `capture_audit`: frames of unknown link types, frames without IPv4 and
without time, a tail that was cut off. Files that are no captures give no packets and an audit row.
"""

from __future__ import annotations

import json
import struct
from dataclasses import asdict, dataclass, replace
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .files import base_name, located

SCHEMA = ("packet_id bigint, ts_us bigint, src_ip string, dst_ip string, src_port int, dst_port int, protocol int, "
          "header_len int, payload_len int, packet_len int, tcp_flags int, window_size int, capture string")
BATCH = 50_000
READ_BYTES = 8 << 20
#: A task reads about so much of a file.
RANGE_BYTES = 128 << 20
#: Headers in a row that must be plausible where a range is entered, the longest frame, and the largest step in time among them.
CHAIN, LONGEST_FRAME, TIME_STEP = 12, 1 << 18, 86_400
# Link types with the bytes before the network header, and where the protocol number sits.
LOOPBACK, ETHERNET, RAW_IP, LINUX_COOKED, IPV4_ONLY, LINUX_COOKED_2 = 0, 1, 101, 113, 228, 276
IPV4, VLAN_TAGS = 0x0800, (0x8100, 0x88A8)
# Magic numbers of classic captures, little and big endian, in micro- and nanoseconds; of pcapng.
CLASSIC = {b"\xd4\xc3\xb2\xa1": ("<", False), b"\xa1\xb2\xc3\xd4": (">", False),
           b"\x4d\x3c\xb2\xa1": ("<", True), b"\xa1\xb2\x3c\x4d": (">", True)}
SECTION = b"\x0a\x0d\x0d\x0a"
# What an audit row counts, in the order of its columns.
AUDIT = ("number bigint, capture string, format string, frames bigint, ipv4_frames bigint, unknown_link_frames bigint, other_frames bigint, "
         "untimed_frames bigint, truncated boolean")


@dataclass(frozen=True)
class Layout:
    """What must be known before a record can be read: byte order, time unit, and (link type, ticks per second) of the interfaces."""

    kind: str | None
    order: str = "<"
    nano: bool = False
    links: tuple[tuple[int, int], ...] = ()

    def text(self) -> str:
        return json.dumps(asdict(self))

    @staticmethod
    def of(text: str) -> Layout:
        d = json.loads(text)
        return Layout(**d | {"links": tuple(map(tuple, d["links"]))})


class _Bytes:
    """A forward reader that holds one window of the file."""

    def __init__(self, stream, start: int = 0):
        self.stream, self.data, self.at, self.base = stream, b"", 0, start

    def where(self) -> int:
        return self.base + self.at

    def need(self, n: int) -> bool:
        if len(self.data) - self.at < n:
            self.base += self.at
            self.data = self.data[self.at:] + self.stream.read(max(n, READ_BYTES))
            self.at = 0
        return len(self.data) - self.at >= n

    def left(self) -> bool:
        """Whether bytes follow."""
        return self.need(1)

    def take(self, n: int) -> bytes | None:
        if not self.need(n):
            return None
        out = self.data[self.at:self.at + n]
        self.at += n
        return out


def _head(src: _Bytes) -> Layout:
    """The layout at the beginning of a file; `src` then stands before the first record. A kind without links broke off."""
    magic = src.take(4)
    if magic == SECTION:
        src.at -= 4
        return Layout("pcapng")
    if magic not in CLASSIC:
        return Layout(None)
    order, nano = CLASSIC[magic]
    head = src.take(20)
    # The upper bits of the link field tell of check sums at the end of frames.
    links = () if head is None else ((struct.unpack(order + "I", head[16:])[0] & 0xFFFF, 1_000_000),)
    return Layout("pcap", order, nano, links)


class Walk:
    """`(time, link, frame)` of the records that begin before `stop`; a last item None if the file breaks off inside one.

    Frames of simple packet blocks have no time. Afterwards `layout` is what holds for the next record, and `sections`
    tells whether a section began on the way.
    """

    def __init__(self, src: _Bytes, layout: Layout, stop: int | None = None):
        self.src, self.layout, self.stop, self.sections, self.broken = src, layout, stop, 0, False

    def __iter__(self):
        yield from {"pcap": self._classic, "pcapng": self._blocks}.get(self.layout.kind, lambda: ())()

    def _more(self) -> bool:
        return self.stop is None or self.src.where() < self.stop

    def _break(self) -> None:
        self.broken = True

    def _classic(self):
        src, layout = self.src, self.layout
        if not layout.links:
            yield self._break()
            return
        link = layout.links[0][0]
        record = struct.Struct(layout.order + "IIII")
        while self._more() and (head := src.take(16)) is not None:
            seconds, fraction, size, _ = record.unpack(head)
            body = src.take(size)
            if body is None:
                yield self._break()
                return
            yield seconds * 1_000_000 + (fraction // 1000 if layout.nano else fraction), link, body
        if self._more() and src.left():
            yield self._break()

    def _blocks(self):
        src, order, links = self.src, self.layout.order, list(self.layout.links)
        while self._more() and (head := src.take(8)) is not None:
            if head[:4] == SECTION:
                src.need(4)
                order = "<" if src.data[src.at:src.at + 4] == b"\x4d\x3c\x2b\x1a" else ">"
                links = []
                self.sections += 1
            kind, size = struct.unpack(order + "II", head)
            body = src.take(size - 8) if size >= 12 else None
            if body is None:
                yield self._break()
                return
            if kind == 1:
                links.append((struct.unpack_from(order + "H", body)[0], _ticks(body, order)))
            self.layout = replace(self.layout, order=order, links=tuple(links)) if kind == 1 or head[:4] == SECTION else self.layout
            if kind in (2, 6):  # 2 is the older form, with a drop count beside a short interface number
                port, high, low, kept = struct.unpack_from(order + ("HxxIII" if kind == 2 else "IIII"), body)
                link, ticks = links[port] if port < len(links) else (-1, 1)
                yield ((high << 32) | low) * 1_000_000 // ticks, link, body[20:20 + kept]
            elif kind == 3:
                yield None, links[0][0] if links else -1, body[4:-4]
        if self._more() and src.left():
            yield self._break()


def _chains(data: bytes, at: int, layout: Layout, size: int, whole: bool) -> bool | None:
    """Whether plausible headers follow each other from `at`; None if more bytes must be read to tell.

    `whole` says that `data` reaches the end of the file: a chain may then end there, and only there.
    """
    before = None
    for _ in range(CHAIN):
        if at == size and whole:
            return True
        if at + 16 > len(data):
            return False if whole else None
        if layout.kind == "pcap":
            seconds, fraction, kept, sent = struct.unpack_from(layout.order + "IIII", data, at)
            if kept > min(LONGEST_FRAME, sent) or fraction >= (10**9 if layout.nano else 10**6):
                return False
            if before is not None and abs(seconds - before) > TIME_STEP:
                return False
            before, at = seconds, at + 16 + kept
        else:
            kind, length = struct.unpack_from(layout.order + "II", data, at)
            if length % 4 or not 12 <= length <= 2 * LONGEST_FRAME or not (kind < 0x100 or kind == 0x0A0D0D0A or kind & 0x80000000):
                return False
            if at + length > len(data):
                return False if whole else None
            if struct.unpack_from(layout.order + "I", data, at + length - 4)[0] != length:
                return False
            at += length
    return at <= len(data) or (None if not whole else False)


def _entered(stream, start: int, end: int, size: int, layout: Layout) -> int | None:
    """The first offset in a range where a chain of headers begins."""
    step = 4 if layout.kind == "pcapng" else 1  # blocks lie on whole words
    at, reach = start + -start % step, 1 << 16
    while at < min(end, size):
        stream.seek(at)
        data = stream.read(reach)
        whole = at + len(data) >= size
        for i in range(0, len(data), step):
            if at + i >= end:
                return None
            found = _chains(data, i, layout, size - at, whole)
            if found:
                return at + i
            if found is None:
                # Start again here with more to look at.
                reach = reach if i else 4 * reach
                at += i
                break
        else:
            at += len(data)
    return None


def _ticks(body: bytes, order: str) -> int:
    """Ticks per second of an interface block: option 9, a power of ten or of two."""
    at = 8
    while at + 4 <= len(body) - 4:
        code, size = struct.unpack_from(order + "HH", body, at)
        if code == 0:
            break
        if code == 9:
            power = body[at + 4]
            return 2 ** (power & 0x7F) if power & 0x80 else 10 ** power
        at += 4 + (size + 3) // 4 * 4
    return 1_000_000


LINKS = {LOOPBACK, ETHERNET, RAW_IP, LINUX_COOKED, IPV4_ONLY, LINUX_COOKED_2}


def _network_offset(link: int, frame: bytes) -> int:
    """Where the IPv4 header begins, or -1."""
    if link in (RAW_IP, IPV4_ONLY):
        return 0 if frame and frame[0] >> 4 == 4 else -1
    if link == LOOPBACK:  # the address family in the byte order of the machine that wrote it; 2 is IPv4
        return 4 if frame[:4] in (b"\2\0\0\0", b"\0\0\0\2") and len(frame) > 4 and frame[4] >> 4 == 4 else -1
    if link == LINUX_COOKED_2:
        return 20 if frame[:2] == b"\x08\x00" and len(frame) > 20 else -1
    at = {ETHERNET: 12, LINUX_COOKED: 14}.get(link)
    while at is not None and at + 2 <= len(frame):
        kind = (frame[at] << 8) | frame[at + 1]
        if kind == IPV4:
            return at + 2
        if kind not in VLAN_TAGS:
            return -1
        at += 4
    return -1


def _dotted(word: np.ndarray) -> list[str]:
    distinct, back = np.unique(word, return_inverse=True)
    texts = np.array([".".join(str(int(w) >> s & 255) for s in (24, 16, 8, 0)) for w in distinct], dtype=object)
    return texts[back].tolist()


def packet_columns(times: list[int], ids: list[int], frames: list[bytes], offsets: list[int]) -> dict[str, list]:
    """Packet fields of a batch of IPv4 frames; TCP and UDP only, first fragments only."""
    data = np.frombuffer(b"".join(frames) + bytes(64), dtype=np.uint8).astype(np.int64)
    sizes = np.array([len(f) for f in frames])
    ends = np.cumsum(sizes)
    ip = ends - sizes + np.array(offsets)

    def u16(at):
        return data[at] << 8 | data[at + 1]

    def u32(at):
        return u16(at) << 16 | u16(at + 2)

    room = ends - ip
    ihl = (data[ip] & 15) * 4
    proto = data[ip + 9]
    first = (u16(ip + 6) & 0x1FFF) == 0
    keep = first & (room >= 20) & (ihl >= 20) & (((proto == 6) & (room >= ihl + 20)) | ((proto == 17) & (room >= ihl + 8)))
    ip, ihl, proto = ip[keep], ihl[keep], proto[keep]
    l4 = ip + ihl
    tcp = proto == 6
    header = ihl + np.where(tcp, (data[np.where(tcp, l4 + 12, l4)] >> 4) * 4, 8)
    payload = np.maximum(0, u16(ip + 2) - header)
    return {
        "packet_id": np.array(ids)[keep], "ts_us": np.array(times)[keep],
        "src_ip": _dotted(u32(ip + 12)), "dst_ip": _dotted(u32(ip + 16)),
        "src_port": u16(l4), "dst_port": u16(l4 + 2), "protocol": proto,
        "header_len": header, "payload_len": payload, "packet_len": header + payload,
        "tcp_flags": np.where(tcp, data[np.where(tcp, l4 + 13, l4)], 0),
        "window_size": np.where(tcp, u16(np.where(tcp, l4 + 14, l4)), 0),
    }


RANGE = "number long, uri string, size long, start long, end long, at long, layout string"
WALKED = "number long, start long, at long, landing long, frames long, sections boolean, added string"


def _walked(batches):
    """Each range from its first record, given or guessed: where the walk landed, and what it met."""
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            fs, path = located(r["uri"])
            with fs.open_input_file(path) as stream:
                layout, at = Layout.of(r["layout"]), r["at"]
                at = _entered(stream, r["start"], r["end"], r["size"], layout) if at is None else at
                row = {"number": r["number"], "start": r["start"], "at": at, "landing": None, "frames": 0, "sections": False, "added": layout.text()}
                if at is not None:
                    stream.seek(at)
                    walk = Walk(src := _Bytes(stream, at), replace(layout, links=layout.links if layout.kind == "pcap" else ()), r["end"])
                    row["frames"] = sum(item is not None for item in walk)
                    row |= {"landing": None if walk.broken else src.where(), "sections": walk.sections > 0, "added": walk.layout.text()}
                out.append(row)
        yield pa.RecordBatch.from_pylist(out, _schema(WALKED))


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "bigint": pa.int64(), "boolean": pa.bool_()}
    return pa.schema([(n, kinds[k]) for n, k in (f.split() for f in ddl.split(", "))])


@dataclass(frozen=True)
class Part:
    """A range to read: records that begin in [at, stop), the first of which has this number in its file."""

    number: int
    uri: str
    at: int
    stop: int | None
    ordinal: int
    layout: Layout | None  # None: read the file's head first


HEAD = "number long, first long, layout string"


def _heads(batches):
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            fs, path = located(r["uri"])
            with fs.open_input_file(path) as stream:
                layout = _head(src := _Bytes(stream))
            out.append({"number": r["number"], "first": src.where(), "layout": layout.text()})
        yield pa.RecordBatch.from_pylist(out, _schema(HEAD))


def settled(spark: SparkSession, files: list[tuple[str, int]], range_bytes: int) -> list[Part]:
    """The ranges of all files, each with its true first record. The driver holds a row per range, as Spark does for tasks."""
    parts = [Part(number, uri, 0, None, 0, None) for number, (uri, size) in enumerate(files) if size <= range_bytes]
    large = {number: f for number, f in enumerate(files) if f[1] > range_bytes}
    ranged = {}
    if large:
        rows = spark.createDataFrame([(n, uri) for n, (uri, _) in large.items()], "number long, uri string")
        for r in rows.repartition(min(len(large), 256)).mapInArrow(_heads, HEAD).collect():
            (uri, size), layout = large[r.number], Layout.of(r.layout)
            if layout.links or layout.kind == "pcapng":
                ranged[r.number] = (uri, size, r.first, layout, list(range(0, size, range_bytes)))
            else:
                parts.append(Part(r.number, uri, 0, None, 0, None))
    todo = [(number, uri, size, start, min(start + range_bytes, size), first if start == 0 else None, layout.text())
            for number, (uri, size, first, layout, starts) in ranged.items() for start in starts]
    known: dict[tuple[int, int], object] = {}
    while todo:
        rows = spark.createDataFrame(todo, RANGE).repartition(min(len(todo), 4 * spark.sparkContext.defaultParallelism), "number", "start").mapInArrow(_walked, WALKED)
        known |= {(r.number, r.start): r for r in rows.collect()}
        todo = []
        for number, (uri, size, first, layout, starts) in ranged.items():
            found, at, ordinal = [], first, 0
            for start in starts:
                end = min(start + range_bytes, size)
                if at is None or at >= end:  # inside a longer record, or the file broke off before
                    continue
                r = known[number, start]
                if r.at != at:
                    todo.append((number, uri, size, start, end, at, layout.text()))
                    break
                last = end == size
                found.append(Part(number, uri, at, None if last or r.landing is None else end, ordinal, layout))
                if layout.kind == "pcapng":
                    new = Layout.of(r.added)
                    layout = new if r.sections else replace(layout, links=layout.links + new.links)
                at, ordinal = r.landing, ordinal + r.frames
            else:
                parts += found
                ranged[number] = (uri, size, first, layout, [])
        ranged = {k: v for k, v in ranged.items() if v[4]}
    return sorted(parts, key=lambda p: (p.number, p.at))


class CaptureReader(DataSourceReader):
    def __init__(self, parts: list[Part], max_packets: int | None, audit: bool = False):
        self.parts, self.max_packets, self.audit = parts, max_packets, audit

    def partitions(self):
        return [InputPartition(p) for p in self.parts if self.max_packets is None or p.ordinal < self.max_packets or not p.ordinal]

    def read(self, partition):
        part: Part = partition.value
        fs, path = located(part.uri)
        name = base_name(part.uri)
        ints = {"src_port", "dst_port", "protocol", "header_len", "payload_len", "packet_len", "tcp_flags", "window_size"}

        def batch(times, ids, frames, offsets):
            cols = packet_columns(times, ids, frames, offsets)
            arrays = [pa.array(v, pa.int32() if k in ints else None) for k, v in cols.items()]
            n = len(cols["packet_id"])
            return pa.RecordBatch.from_arrays(arrays + [pa.array([name] * n, pa.string())], [*cols, "capture"])

        with fs.open_input_file(path) as stream:
            stream.seek(part.at)
            src = _Bytes(stream, part.at)
            layout = part.layout or _head(src)
            records = Walk(src, layout, part.stop)
            if self.audit:
                yield pa.RecordBatch.from_pylist([{"number": part.number, "capture": name, "format": layout.kind, **_tally(records)}], _schema(AUDIT))
                return
            held: tuple[list, list, list, list] = ([], [], [], [])
            for i, item in enumerate(records, part.ordinal):
                if item is None or self.max_packets is not None and i >= self.max_packets:
                    break
                ts, link, frame = item
                at = _network_offset(link, frame)
                if at < 0 or ts is None:
                    continue
                # Ids order packets inside a file and differ between files.
                for store, value in zip(held, (ts, (part.number << 40) + i, frame, at)):
                    store.append(value)
                if len(held[0]) >= BATCH:
                    yield batch(*held)
                    held = ([], [], [], [])
            if held[0]:
                yield batch(*held)


def _tally(records) -> dict[str, int | bool]:
    n = {"frames": 0, "ipv4_frames": 0, "unknown_link_frames": 0, "other_frames": 0, "untimed_frames": 0, "truncated": False}
    for item in records:
        if item is None:
            n["truncated"] = True
            break
        ts, link, frame = item
        n["frames"] += 1
        if link not in LINKS:
            n["unknown_link_frames"] += 1
        elif _network_offset(link, frame) < 0:
            n["other_frames"] += 1
        else:
            n["untimed_frames" if ts is None else "ipv4_frames"] += 1
    return n


class CaptureSource(DataSource):
    """Options: `parts` (the settled ranges), `maxPackets`, counted per file before filtering, and `audit`."""

    @classmethod
    def name(cls):
        return "captures"

    def schema(self):
        return AUDIT if self._audits() else SCHEMA

    def _audits(self) -> bool:
        return str(self.options.get("audit", "")).lower() == "true"

    def reader(self, schema):
        limit = self.options.get("maxpackets") or self.options.get("maxPackets")
        parts = [Part(**p | {"layout": p["layout"] and Layout.of(p["layout"])}) for p in json.loads(self.options["parts"])]
        return CaptureReader(parts, int(limit) if limit else None, self._audits())


def _reader(spark: SparkSession, path: str, range_bytes: int):
    listed = spark.read.format("binaryFile").load(path)
    # Names and sizes only. Empty files are among the names alone; these are encoded, the paths of the rows are not.
    sizes = {r.path: r.length for r in listed.select("path", "length").collect()}
    files = [(f, sizes.get(unquote(f).replace("file:///", "file:/", 1), 0)) for f in sorted(listed.inputFiles())]
    parts = settled(spark, files, range_bytes)
    spark.dataSource.register(CaptureSource)
    return spark.read.format("captures").option("parts", json.dumps([asdict(p) | {"layout": p.layout and p.layout.text()} for p in parts]))


def read_captures(spark: SparkSession, path: str, max_packets: int | None = None, range_bytes: int = RANGE_BYTES):
    """Packets of all capture files under `path`, in tasks of about `range_bytes`."""
    reader = _reader(spark, path, range_bytes)
    return (reader.option("maxPackets", max_packets) if max_packets is not None else reader).load()


def capture_audit(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES):
    """One row per file under `path`: its format, and how many frames were taken or passed over, and why."""
    rows = _reader(spark, path, range_bytes).option("audit", "true").load()
    counts = [n for n in rows.columns if n.endswith("frames")]
    return rows.groupBy("number", "capture", "format").agg(
        *[F.sum(n).alias(n) for n in counts], F.max("truncated").alias("truncated")).drop("number")
