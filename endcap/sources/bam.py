"""BAM files through a Python data source that reads one file in many partitions.

A file is cut at any byte. A partition owns the records that begin in compressed blocks which
begin within its bytes. It looks for the first whole block (header, checksum, and another block
or the end behind it), then for the first place in it where ``CHAIN`` records follow one another
with every field in its bounds. Each partition also looks up the place where the next one will
begin; if that isn't where its own last record ends, the read fails instead of losing rows.

With regions, the index file beside a BAM file gives the byte ranges to read; other bytes of it
are left alone.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from endcap.sources.storage import exists, listed, opened

SCHEMA = ("file string, ord long, name string, flag int, ref string, pos int, mapq int, "
          "cigar string, seq string, qual string")
ARROW = pa.schema([("file", pa.string()), ("ord", pa.int64()), ("name", pa.string()),
                   ("flag", pa.int32()), ("ref", pa.string()), ("pos", pa.int32()),
                   ("mapq", pa.int32()), ("cigar", pa.string()), ("seq", pa.string()),
                   ("qual", pa.string())])
# Fixed values of the format.
BASES = "=ACMGRSVTWYHKDBN"
OPS = "MIDNSHP=X"
ON_REFERENCE = "MDN=X"
TAG_BYTES = {"A": 1, "c": 1, "C": 1, "s": 2, "S": 2, "i": 4, "I": 4, "f": 4}
MAGIC = b"\x1f\x8b\x08\x04"
MOST_BLOCK = 1 << 16
TOP_BIN_SHIFT, LEVELS, LINEAR_SHIFT = 29, 5, 14

#: Records in a row that prove a beginning.
CHAIN = 3
READ_BYTES = 1 << 20
#: An Arrow batch ends at this many records or letters.
BATCH_ROWS, BATCH_LETTERS = 2000, 8 << 20
SPLIT_BYTES = 64 << 20

FROM_HEX = str.maketrans("0123456789abcdef", BASES)
TO_QUAL = bytes(min(x + 33, 126) for x in range(256))


def block_size(data: bytes, at: int) -> int | None:
    """Compressed bytes of the block whose header is at ``at``; None if there is no header."""
    if data[at:at + 4] != MAGIC or len(data) < at + 12:
        return None
    extra = struct.unpack_from("<H", data, at + 10)[0]
    field, end = at + 12, at + 12 + extra
    while field + 6 <= end and end <= len(data):
        n = struct.unpack_from("<H", data, field + 2)[0]
        if data[field:field + 2] == b"BC" and n == 2:
            size = struct.unpack_from("<H", data, field + 4)[0] + 1
            return size if size >= extra + 20 else None
        field += 4 + n
    return None


def inflated(data: bytes) -> bytes | None:
    """Content of one block, None if the checksum or the length is wrong."""
    extra = struct.unpack_from("<H", data, 10)[0]
    try:
        out = zlib.decompress(data[12 + extra:-8], wbits=-15)
    except zlib.error:
        return None
    crc, size = struct.unpack("<II", data[-8:])
    return out if crc == zlib.crc32(out) and size == len(out) else None


class Blocks:
    """Blocks of a file from a byte on: (offset, content)."""

    def __init__(self, path: str) -> None:
        self.path, self.file = path, opened(path)
        self.size = self.file.size()
        self.buf, self.base = b"", 0

    def bytes_at(self, at: int, n: int) -> bytes:
        n = min(n, self.size - at)
        if at < self.base or at + n > self.base + len(self.buf):
            self.buf, self.base = self.file.read_at(max(n, min(READ_BYTES, self.size - at)), at), at
        return self.buf[at - self.base:at - self.base + n]

    def one(self, at: int) -> tuple[int, bytes]:
        """(compressed bytes, content) of the block at ``at``."""
        data = self.bytes_at(at, MOST_BLOCK)
        size = block_size(data, 0)
        if size is None:
            if data[:4] != MAGIC[:len(data[:4])]:
                raise ValueError(f"{self.path} is not block-gzip compressed")
            raise EOFError(f"{self.path} is truncated")
        if size > len(data):
            raise EOFError(f"{self.path} is truncated")
        content = inflated(data[:size])
        if content is None:
            raise ValueError(f"{self.path} is damaged at byte {at}")
        return size, content

    def first(self, at: int) -> int:
        """Offset of the first block that begins at ``at`` or behind it; the size if there is none."""
        if at == 0 or at >= self.size:
            return min(at, self.size)
        while at < self.size:
            data = self.bytes_at(at, 3 * MOST_BLOCK)
            hit = data.find(MAGIC)
            while 0 <= hit < MOST_BLOCK:
                size = block_size(data, hit)
                if size is not None and hit + size <= len(data) \
                        and (at + hit + size == self.size or data[hit + size:hit + size + 4] == MAGIC) \
                        and inflated(data[hit:hit + size]) is not None:
                    return at + hit
                hit = data.find(MAGIC, hit + 1)
            at += MOST_BLOCK
        return self.size


class Records:
    """The uncompressed stream from one block on; places are (offset of block, byte in it)."""

    def __init__(self, blocks: Blocks, at: int) -> None:
        self.blocks, self.next = blocks, at
        self.buf, self.at, self.keep = b"", 0, False
        self.starts: list[tuple[int, int]] = []       # (place in buf, offset of the block)

    def more(self) -> bool:
        if self.next >= self.blocks.size:
            return False
        size, content = self.blocks.one(self.next)
        cut = self.at if self.at > MOST_BLOCK and not self.keep else 0
        if cut:
            self.buf, self.at = self.buf[cut:], 0
            kept = [(p - cut, b) for p, b in self.starts]
            below = [x for x in kept if x[0] <= 0]
            self.starts = below[-1:] + [x for x in kept if x[0] > 0]
        if content:
            self.starts.append((len(self.buf), self.next))
            self.buf += content
        self.next += size
        return True

    def holds(self, n: int) -> bool:
        """Whether ``n`` bytes follow; reads blocks as needed."""
        while len(self.buf) - self.at < n:
            if not self.more():
                return False
        return True

    def take(self, n: int) -> bytes:
        if not self.holds(n):
            raise EOFError(f"{self.blocks.path} is truncated inside a record")
        self.at += n
        return self.buf[self.at - n:self.at]

    def int32(self) -> int:
        return struct.unpack("<i", self.take(4))[0]

    def ended(self) -> bool:
        return not self.holds(1)

    def place(self) -> tuple[int, int]:
        """Where the stream stands; behind the last byte the size of the file."""
        if self.ended():
            return self.blocks.size, 0
        while len(self.starts) > 1 and self.starts[1][0] <= self.at:
            self.starts.pop(0)
        return self.starts[0][1], self.at - self.starts[0][0]


def header(path: str) -> tuple[list[str], tuple[int, int]]:
    """Names of the reference sequences, and the place of the first record."""
    s = Records(Blocks(path), 0)
    if not s.holds(4) or s.take(4) != b"BAM\1":
        raise ValueError(f"{path} is not a BAM file")
    s.take(s.int32())
    refs = []
    for _ in range(s.int32()):
        refs.append(s.take(s.int32())[:-1].decode())
        s.take(4)
    return refs, s.place()


def _tags_end(s: Records, at: int, end: int) -> bool:
    """Whether optional fields fill the bytes from ``at`` to ``end``; reads no farther than they go."""
    while at + 3 <= end:
        if not s.holds(at + 8 - s.at) and not s.holds(at + 3 - s.at):
            return False
        kind = chr(s.buf[at + 2])
        if min(s.buf[at], s.buf[at + 1]) < 33:
            return False
        at += 3
        if kind in "ZH":
            while (stop := s.buf.find(b"\0", at, end)) < 0:
                at = len(s.buf)
                if at >= end or not s.more():
                    return False
            at = stop + 1
        elif kind == "B":
            if at + 5 > min(end, len(s.buf)) or chr(s.buf[at]) not in TAG_BYTES:
                return False
            at += 5 + TAG_BYTES[chr(s.buf[at])] * struct.unpack_from("<I", s.buf, at + 1)[0]
        elif kind in TAG_BYTES:
            at += TAG_BYTES[kind]
        else:
            return False
    return at == end and s.holds(end - s.at)


def _chained(s: Records, at: int, refs: int, left: int = CHAIN) -> bool:
    """Whether ``left`` records, or all up to the end of the file, follow from ``at`` in the buffer."""
    own, s.at = s.at, at
    try:
        while left and not s.ended():
            if not s.holds(36):
                return False
            size, ref, pos, n_name, _, _, n_cig, _, n_seq, ref2, pos2, _ = \
                struct.unpack_from("<iiiBBHHHiiii", s.buf, s.at)
            fixed = 32 + n_name + 4 * n_cig + (n_seq + 1) // 2 + n_seq
            if not (n_seq >= 0 and n_name and fixed <= size and -1 <= ref < refs
                    and -1 <= ref2 < refs and pos >= -1 and pos2 >= -1):
                return False
            if not s.holds(36 + n_name):
                return False
            name = s.buf[s.at + 36:s.at + 36 + n_name]
            if name[-1] or any(x < 32 and x != 9 for x in name[:-1]) or not s.holds(4 + fixed):
                return False
            ops = struct.unpack_from(f"<{n_cig}I", s.buf, s.at + 36 + n_name)
            if any(x & 15 >= len(OPS) for x in ops) or \
                    not _tags_end(s, s.at + 4 + fixed, s.at + 4 + size):
                return False
            s.at += 4 + size
            left -= 1
        return True
    finally:
        s.at = own


def first_record(path: str, at: int, refs: int, top: tuple[int, int]) -> tuple[int, int]:
    """Place of the first record that begins in a block at ``at`` or behind it."""
    if at <= top[0]:
        return top
    blocks = Blocks(path)
    s = Records(blocks, blocks.first(at))
    s.keep = True                     # nothing is dropped while places in the buffer are tried
    while not s.ended():
        if _chained(s, s.at, refs):
            return s.place()
        s.at += 1
    return blocks.size, 0


@dataclass
class BamPartition(InputPartition):
    """Records that begin in blocks from ``begin`` on and before ``end``; places if ``known``."""

    path: str
    begin: tuple[int, int]
    end: tuple[int, int]
    known: bool = False
    #: reference, first and behind-last letter (from 0) that a record must touch; empty: no rule
    regions: tuple[tuple[str, int, int], ...] = ()


def decoded(raw: bytes, refs: list[str]) -> tuple:
    ref, pos, n_name, mapq, _, n_cig, flag, n_seq = struct.unpack_from("<iiBBHHHi", raw)
    at = 32
    name = raw[at:at + n_name - 1].decode()
    at += n_name
    ops = struct.unpack_from(f"<{n_cig}I", raw, at)
    at += 4 * n_cig
    half = (n_seq + 1) // 2
    seq = raw[at:at + half].hex().translate(FROM_HEX)[:n_seq]
    q = raw[at + half:at + half + n_seq]
    qual = "" if not q or q[0] == 255 else q.translate(TO_QUAL).decode()
    cigar = "".join(f"{c >> 4}{OPS[c & 15]}" for c in ops)
    return (name, flag, refs[ref] if ref >= 0 else "*", pos + 1, mapq, cigar or "*", seq, qual)


def touches(raw: bytes, refs: list[str], regions: tuple[tuple[str, int, int], ...]) -> bool:
    ref, pos, n_name, _, _, n_cig = struct.unpack_from("<iiBBHH", raw)
    if not regions:
        return True
    if ref < 0:
        return False
    ops = struct.unpack_from(f"<{n_cig}I", raw, 32 + n_name)
    end = pos + max(1, sum(c >> 4 for c in ops if OPS[c & 15] in ON_REFERENCE))
    return any(refs[ref] == name and pos < hi and end > lo for name, lo, hi in regions)


def records(part: BamPartition) -> Iterator[tuple]:
    """Rows of one partition in file order.

    ``ord`` is four times the block's offset plus the record's number among those that begin in
    the block. A record takes over a quarter of a compressed byte, so it grows along the file.
    """
    refs, top = header(part.path)
    begin = part.begin if part.known else first_record(part.path, part.begin[0], len(refs), top)
    end = part.end
    if begin < end:
        s = Records(Blocks(part.path), begin[0])
        s.take(begin[1])
        block, number = -1, 0
        while (here := s.place()) < end:
            number, block = (number + 1, block) if here[0] == block else (0, here[0])
            raw = s.take(s.int32())
            if touches(raw, refs, part.regions):
                yield (part.path, 4 * block + number, *decoded(raw, refs))
        begin = here
    if not part.known and begin != first_record(part.path, end[0], len(refs), top):
        raise ValueError(f"{part.path} cannot be cut at byte {end[0]}: read it with splitBytes 0")


def batches(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    held, letters = [], 0
    for row in rows:
        held.append(row)
        letters += 2 * len(row[-2])
        if len(held) >= BATCH_ROWS or letters >= BATCH_LETTERS:
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)
            held, letters = [], 0
    if held:
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*held), ARROW)], schema=ARROW)


def bins_of(lo: int, hi: int) -> set[int]:
    """Numbers of all bins that letters ``lo`` to ``hi`` (behind the last) of a reference meet."""
    out = {0}
    first = 1
    for level in range(1, LEVELS + 1):
        shift = TOP_BIN_SHIFT - 3 * level
        out.update(range(first + (lo >> shift), first + ((hi - 1) >> shift) + 1))
        first += 8 ** level
    return out


def _place(virtual: int) -> tuple[int, int]:
    return virtual >> 16, virtual & 0xFFFF


def indexed_ranges(path: str, refs: list[str], regions: tuple[tuple[str, int, int], ...]
                   ) -> list[tuple[tuple[int, int], tuple[int, int]]]:
    """Places of all records that may touch the regions, by the index file, none twice."""
    with opened(path) as f:
        data = f.read()
    if data[:4] != b"BAI\1":
        raise ValueError(f"{path} is not an index of a BAM file")
    at, found = 8, []
    for no in range(struct.unpack_from("<i", data, 4)[0]):
        own = [(lo, hi) for name, lo, hi in regions if no < len(refs) and refs[no] == name]
        bins = [bins_of(lo, hi) for lo, hi in own]
        chunks = []
        n_bin = struct.unpack_from("<i", data, at)[0]
        at += 4
        for _ in range(n_bin):
            number, n = struct.unpack_from("<Ii", data, at)
            at += 8
            for k in range(n):
                chunk = struct.unpack_from("<QQ", data, at + 16 * k)
                chunks += [(i, *chunk) for i, b in enumerate(bins) if number in b]
            at += 16 * n
        n_lin = struct.unpack_from("<i", data, at)[0]
        lin = struct.unpack_from(f"<{n_lin}Q", data, at + 4)
        at += 4 + 8 * n_lin
        for i, b, e in chunks:
            window = own[i][0] >> LINEAR_SHIFT
            b = max(b, lin[window]) if window < n_lin else b
            if b < e:
                found.append((b, e))
    merged: list[list[int]] = []
    for b, e in sorted(found):
        if merged and b <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([b, e])
    return [(_place(b), _place(e)) for b, e in merged]


def parsed_regions(text: str) -> tuple[tuple[str, int, int], ...]:
    """``name`` or ``name:first-last`` (from 1, both counted), separated by commas."""
    out = []
    for item in filter(None, (x.strip() for x in text.split(","))):
        m = re.fullmatch(r"(.+):(\d+)-(\d+)", item)
        out.append((m[1], max(0, int(m[2]) - 1), int(m[3])) if m else (item, 0, 1 << TOP_BIN_SHIFT))
    return tuple(out)


class BamReader(DataSourceReader):
    def __init__(self, path: str, split: int, regions: str) -> None:
        self.path, self.split, self.regions = path, split, parsed_regions(regions)

    def partitions(self) -> list[BamPartition]:
        out = []
        for path, size in listed(self.path, ".bam"):
            if not size:
                raise ValueError(f"{path} is not a BAM file")
            index = next((x for x in (path + ".bai", path[:-4] + ".bai") if exists(x)), None)
            if self.regions and index:
                refs, _ = header(path)
                out += [BamPartition(path, b, e, True, self.regions)
                        for b, e in indexed_ranges(index, refs, self.regions)]
            else:
                step = self.split if self.split > 0 else size
                out += [BamPartition(path, (b, 0), (min(b + step, size), 0), False, self.regions)
                        for b in range(0, size, max(step, 1))]
        # a partition is always there, so that the schema has a reader
        return out or [BamPartition(self.path, (0, 0), (0, 0), True)]

    def read(self, partition: BamPartition) -> Iterator[pa.RecordBatch]:
        return batches(records(partition)) if partition.begin < partition.end else iter(())


class PushedBamReader(BamReader):
    """Takes the names of references out of the query's own filters."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            names = (f.value,) if isinstance(f, EqualTo) else f.value if isinstance(f, In) else ()
            if isinstance(f, (EqualTo, In)) and f.attribute == ("ref",) and not self.regions \
                    and names and "*" not in names and None not in names:
                self.regions = tuple((x, 0, 1 << TOP_BIN_SHIFT) for x in names)
            yield f                                     # rows are held against it once more


class BamSource(DataSource):
    """``spark.read.format("bam").load(path)``: a file, a pattern or a folder all tasks can see.

    Options: ``splitBytes`` of a partition (0: whole files); ``regions`` such as
    ``chr1:1-500000,chr2``; ``pushdown`` true where the session may push filters to Python sources.
    """

    @classmethod
    def name(cls) -> str:
        return "bam"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        kind = PushedBamReader if self.options.get("pushdown") == "true" else BamReader
        return kind(self.options["path"], int(self.options.get("splitBytes", SPLIT_BYTES)),
                    self.options.get("regions", ""))


def read_alignments(spark: SparkSession, path: str, regions: str = "",
                    split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Alignment rows; with ``regions`` only those that touch one of them."""
    spark.dataSource.register(BamSource)
    pushed = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    return (spark.read.format("bam").option("splitBytes", split_bytes).option("regions", regions)
            .option("pushdown", pushed).load(path))


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """Reads of a BAM file with the supplementary flag."""
    return read_alignments(spark, path).selectExpr(
        "file", "ord", "replace(name, '\t', ' ') as name", "seq", "qual",
        "(flag & 2048) <> 0 as is_sup")
