"""WARC archives and a two-level index of captures.

Each task writes its pages as gzip members of a WARC file of its own and returns an entry for each record. Entries are sorted by
reversed-host key over all tasks; a task writes its run of the order as compressed blocks and, behind them, a directory
with the first key of each block. The upper level is one row for each index file with its first key. A look-up finds the file by
binary search, then the block in that file's directory, reads the block's range and then the record's range.

Files are reached through ``pyarrow.fs`` by URI, so the folder may be on any storage that it knows.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard as zstd
from pyspark.sql import Column, DataFrame, functions as F

from deedlink.llm.common import map_arrow, new_folder, stage

#: Payloads shorter than this are always written whole.
LEAST_PAYLOAD = 100
#: Entries in a block of the index.
BLOCK_ENTRIES = 512
#: Groups of equal payloads that are sent to all executors, at most; beyond that they are joined by a shuffle.
BROADCAST_GROUPS = 100_000
#: A gap between two wanted records that is read over instead of asking twice, and the most that is read at once.
READ_OVER = 65_536
READ_AT_ONCE = 8_000_000
#: Fixed value: the time of capture written to every record, since the pages have none.
CAPTURED = "2024-01-01T00:00:00Z"
_TRAILER = "<QQ"
_ENTRY = "page_id bigint, url_key string, file string, offset bigint, length bigint"


def url_key(url: Column) -> Column:
    """Host parts from the last to the first, then port, path and query: pages of a domain are neighbours.

    Scheme, user and fragment are left out, the host is in lower case. A null or empty URL has the key ``)/``.
    """
    rest = F.regexp_replace(F.coalesce(url, F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://|#.*$", "")
    place = F.regexp_extract(rest, r"^[^/?]*", 0)
    place = F.regexp_replace(F.lower(place), r"^[^@]*@", "")
    host, port = F.regexp_extract(place, r"^[^:]*", 0), F.regexp_extract(place, r":.*$", 0)
    path = F.regexp_replace(rest, r"^[^/?]*", "")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), port, F.lit(")"), F.when(path == "", F.lit("/")).otherwise(path))


def _open(name: str) -> tuple[pafs.FileSystem, str]:
    """File system and path of a URI or a plain path."""
    return pafs.FileSystem.from_uri(name) if ":/" in name else (pafs.LocalFileSystem(), name)


def _create(name: str):
    system, path = _open(name)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def warc_record(kind: str, page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One gzip member."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    body = http + b"\r\n" + payload if kind == "response" else http + b"Content-Length: 0\r\n\r\n"
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{page_id} {url} {digest}')}>"),
        ("WARC-Date", CAPTURED),
        ("WARC-Target-URI", "".join((url or "").split("\r")).replace("\n", "")),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Page-Id", "" if page_id is None else str(page_id)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page-Id", str(refers_to))]
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode("utf-8", "replace") + body + b"\r\n\r\n", 5, mtime=0)


def parse_record(member: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and payload of a gzip member."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode("utf-8").split("\r\n")[1:])
    body = rest[: int(fields["Content-Length"])]
    return fields, body.partition(b"\r\n\r\n")[2]


def write_archives(pages: DataFrame, folder: str, least_payload: int = LEAST_PAYLOAD) -> DataFrame:
    """WARC files of ``pages`` (page_id, url, html) under ``folder``; gives the entries (page_id, url_key, file, offset, length).

    Of pages with equal payloads of ``least_payload`` bytes or more the one with the least page_id is a response and
    the others are revisits of it; null ids come last and are never referred to. Of rows that repeat a response's id and payload
    one is the response. Null payloads and URLs count as empty.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("html"))
    digest = F.sha2(F.col("html").cast("binary"), 256)
    slim = pages.where(F.octet_length("html") >= least_payload).select("page_id", digest.alias("digest"))
    groups = slim.groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).where("pages > 1 and first is not null")
    groups = stage(groups.select("digest", "first"), "warc-groups")
    few = groups.count() <= BROADCAST_GROUPS
    dealt = pages.withColumn("digest", digest).join(F.broadcast(groups) if few else groups, "digest", "left")
    # which of several rows with the id and payload of a response is it: settled by the order in which tasks meet them
    twins = stage(
        slim.join(F.broadcast(groups) if few else groups, "digest").where("page_id = first").groupBy("digest").count().where("count > 1").select("digest"), "warc-twins"
    )
    has_twins = not twins.isEmpty()
    if has_twins:
        chosen = F.row_number().over(_twin_order())
        same = dealt.where("page_id = first").join(twins, "digest", "left_semi").withColumn("nth", chosen)
        other = dealt.where("page_id is null or first is null or page_id <> first").withColumn("nth", F.lit(1))
        lone = dealt.where("page_id = first").join(twins, "digest", "left_anti").withColumn("nth", F.lit(1))
        dealt = same.unionByName(other).unionByName(lone)
    else:
        dealt = dealt.withColumn("nth", F.lit(1))
    dealt = dealt.select("page_id", "url", "html", "digest", "first", "nth", url_key(F.col("url")).alias("url_key"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"  # a repeated task writes another file; entries name the one that counts
        offset, out = 0, None
        for batch in batches:
            if out is None:
                out = _create(name)
            rows: tuple[list, list, list, list] = ([], [], [], [])
            columns = (batch.column(c) for c in ("page_id", "url", "html", "digest", "first", "nth", "url_key"))
            for values in zip(*columns):
                page_id, url, html, own, first, nth, key = (v.as_py() for v in values)
                response = first is None or page_id == first and nth == 1
                record = warc_record("response" if response else "revisit", page_id, url, html.encode("utf-8", "replace"), own, None if response else first)
                out.write(record)
                for column, value in zip(rows, (page_id, key, offset, len(record))):
                    column.append(value)
                offset += len(record)
            yield pa.RecordBatch.from_arrays(
                [pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.string()), pa.array([name] * len(rows[0]), pa.string()), pa.array(rows[2], pa.int64()), pa.array(rows[3], pa.int64())],
                ["page_id", "url_key", "file", "offset", "length"],
            )
        if out is not None:
            out.close()

    return stage(map_arrow(dealt, run, _ENTRY), "warc-entries")


def _twin_order():
    from pyspark.sql import Window

    return Window.partitionBy("digest", "page_id").orderBy("url")


def write_index(entries: DataFrame, folder: str, block_entries: int = BLOCK_ENTRIES) -> DataFrame:
    """Index files of ``entries`` under ``folder``; gives the upper level (first_key, file, entries).

    A file holds compressed blocks of ``block_entries`` sorted entries, then the directory (first key, offset and length of each
    block), then the directory's place. Entries with the same URL key are told apart by page_id, so that they can lie in several files.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name = f"{folder}/{uuid.uuid4().hex}.idx"
        out, compress = None, zstd.ZstdCompressor(level=3).compress
        directory: list[tuple[str, int, int]] = []
        waiting: list[list] = []
        offset = total = 0

        def flush() -> None:
            nonlocal offset, waiting
            block = compress("\n".join(json.dumps(w, ensure_ascii=False) for w in waiting).encode("utf-8", "replace"))
            out.write(block)
            directory.append((waiting[0][0], offset, len(block)))
            offset, waiting = offset + len(block), []

        for batch in batches:
            if out is None:
                out = _create(name)
            total += batch.num_rows
            for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length"))):
                waiting.append(list(row))
                if len(waiting) == block_entries:
                    flush()
        if out is None:
            return
        if waiting:
            flush()
        data = compress(json.dumps(directory, ensure_ascii=False).encode("utf-8", "replace"))
        out.write(data)
        out.write(struct.pack(_TRAILER, offset, len(data)))
        out.close()
        columns = [pa.array([directory[0][0]], pa.string()), pa.array([name], pa.string()), pa.array([total], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, ["first_key", "file", "entries"])

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = entries.repartitionByRange(parts, "url_key", "page_id", "file", "offset").sortWithinPartitions("url_key", "page_id", "file", "offset")
    return stage(map_arrow(ordered, run, "first_key string, file string, entries bigint"), "warc-directory")


class IndexReader:
    """Look-ups in index files; keeps the directory and the block that it read last."""

    def __init__(self, upper: list[tuple[str, str]]):
        self.upper = sorted(upper)
        self.first_keys = [k for k, _ in self.upper]
        self._directory: tuple[str, list] = ("", [])
        self._block: tuple[str, int, list] = ("", -1, [])

    def directory(self, file: str) -> list[tuple[str, int, int]]:
        if self._directory[0] != file:
            system, path = _open(file)
            with system.open_input_file(path) as f:
                size = f.size()
                offset, length = struct.unpack(_TRAILER, f.read_at(16, size - 16))
                self._directory = file, json.loads(zstd.ZstdDecompressor().decompress(f.read_at(length, offset)))
        return self._directory[1]

    def block(self, file: str, offset: int, length: int) -> list[list]:
        if self._block[:2] != (file, offset):
            system, path = _open(file)
            with system.open_input_file(path) as f:
                data = zstd.ZstdDecompressor().decompress(f.read_at(length, offset))
            self._block = file, offset, [json.loads(line) for line in data.decode("utf-8").split("\n")]
        return self._block[2]

    def find(self, key: str) -> Iterator[list]:
        """Entries [url_key, page_id, file, offset, length] with this key."""
        # the key may already be at the end of the file or block before the one that begins with it
        at = max(0, self._before(self.first_keys, key))
        while at < len(self.upper) and self.first_keys[at] <= key:
            file = self.upper[at][1]
            directory = self.directory(file)
            firsts = [d[0] for d in directory]
            b = max(0, self._before(firsts, key))
            while b < len(firsts) and firsts[b] <= key:
                for entry in self.block(file, directory[b][1], directory[b][2]):
                    if entry[0] == key:
                        yield entry
                b += 1
            at += 1

    @staticmethod
    def _before(keys: list[str], key: str) -> int:
        """The last place whose key is less, so that all equal ones follow."""
        low, high = 0, len(keys)
        while low < high:
            middle = (low + high) // 2
            low, high = (middle + 1, high) if keys[middle] < key else (low, middle)
        return low - 1


def look_up(keys: DataFrame, upper: DataFrame) -> DataFrame:
    """The entries of the keys in ``keys`` (url_key); each distinct key once. The upper level has a row for each index file."""
    level = [(r["first_key"], r["file"]) for r in upper.select("first_key", "file").collect()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, names = IndexReader(level), ["url_key", "page_id", "file", "offset", "length"]
        kinds = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            rows: list[list] = []
            for key in batch.column("url_key").to_pylist():
                for entry in reader.find(key):
                    rows.append(entry)
                    if len(rows) == 20_000:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)
                        rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    parts = int(keys.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    wanted = keys.select("url_key").where(F.col("url_key").isNotNull()).distinct()
    ordered = wanted.repartitionByRange(parts, "url_key").sortWithinPartitions("url_key")
    return map_arrow(ordered, run, "url_key string, page_id bigint, file string, offset bigint, length bigint")


def read_records(entries: DataFrame) -> DataFrame:
    """page_id, record_type, payload_bytes, payload_digest (of what is in the record), declared_digest, refers_to of the entries' records.

    Entries are dealt out by stretches of an archive and read in its order; records that lie close together are read at once.
    """
    schema = "page_id bigint, record_type string, payload_bytes bigint, payload_digest string, declared_digest string, refers_to bigint"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, handle = None, None
        for batch in batches:
            rows: list[tuple] = []
            wanted = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))))
            i = 0
            while i < len(wanted):
                file, start, length = wanted[i]
                end, j = start + length, i + 1
                while j < len(wanted) and wanted[j][0] == file and wanted[j][1] <= end + READ_OVER and wanted[j][1] + wanted[j][2] - start <= READ_AT_ONCE:
                    end, j = max(end, wanted[j][1] + wanted[j][2]), j + 1
                if file != name:
                    system, path = _open(file)
                    name, handle = file, system.open_input_file(path)
                data = handle.read_at(end - start, start)
                for _, offset, size in wanted[i:j]:
                    fields, payload = parse_record(data[offset - start : offset - start + size])
                    page, refers = fields["WARC-Page-Id"], fields.get("WARC-Refers-To-Page-Id")
                    rows.append((
                        int(page) if page else None, fields["WARC-Type"], len(payload), hashlib.sha256(payload).hexdigest(),
                        fields["WARC-Payload-Digest"].partition(":")[2], int(refers) if refers else None,
                    ))
                i = j
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            names = ["page_id", "record_type", "payload_bytes", "payload_digest", "declared_digest", "refers_to"]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)

    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    stretch = F.floor(F.col("offset") / F.lit(READ_AT_ONCE))
    dealt = entries.repartition(parts, "file", stretch).sortWithinPartitions("file", "offset")
    return map_arrow(dealt.select("file", "offset", "length"), run, schema)


def captures(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Archives and index of ``pages``, then all of it read back through the index.

    One row per row of ``pages``: page_id, payload_bytes, payload_digest (both of the full payload; a revisit's come from the
    response it refers to), record_type, refers_to. No rows give no rows.
    """
    folder = folder or new_folder(pages.sparkSession, "warc")
    entries = write_archives(pages, f"{folder}/archives")
    upper = write_index(entries, f"{folder}/index")
    found = look_up(pages.select(url_key(F.col("url")).alias("url_key")), upper)
    records = stage(read_records(found), "warc-records")
    responses = records.where("record_type = 'response'")
    revisits = records.where("record_type = 'revisit'")
    # a payload that is revisited has one response, so this join gives a row per revisit
    origin = responses.where(F.col("payload_bytes") >= LEAST_PAYLOAD).select(
        F.col("payload_digest").alias("declared_digest"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("full_bytes")
    )
    resolved = revisits.join(origin, ["declared_digest", "refers_to"]).select(
        "page_id", F.col("full_bytes").alias("payload_bytes"), F.col("declared_digest").alias("payload_digest"), "record_type", "refers_to"
    )
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").unionByName(resolved)


#: The same figures in SQL.
CAPTURES_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST_PAYLOAD} AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST_PAYLOAD} AND page_id <> first_id THEN first_id END AS refers_to
FROM f
"""
