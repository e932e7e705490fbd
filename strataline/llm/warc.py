"""WARC archives: written as one gzip stream a file, normalised to one member a record, and read by offset.

Files go to a folder that all executors share, through Arrow's file systems, so the folder may lie in any store
Arrow can write. A task writes under a name of its own and tells it in a row; only rows of tasks that
succeeded are kept, so a repeated task leaves a file that nothing refers to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import materialise, scratch_path
from .batches import struct

_CHUNK = 1 << 20
#: Level of gzip: archives are rewritten soon, so speed counts for more than size.
GZIP_LEVEL = 1
INDEX_SCHEMA = "archive string, record long, page_id long, offset long, size long"
RECORD_SCHEMA = ("page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
                 "refers_to long, payload binary")


def open_store(folder: str):
    """The Arrow file system of a folder or file, and its path there."""
    from pyarrow import fs

    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return fs.FileSystem.from_uri(folder)


def digest_of(payload: bytes) -> str:
    """Base32 of the SHA-1, upper case."""
    from base64 import b32encode
    from hashlib import sha1

    return b32encode(sha1(payload).digest()).decode()


def record_bytes(page_id, url, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One WARC record. A revisit has no payload; extension fields keep the page, and size of the full payload."""
    revisit = refers_to is not None
    body = b"" if revisit else payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c.isprintable() else "%%%02X" % ord(c) for c in url or ""),
        f"WARC-Payload-Digest: sha1:{digest}",
        f"X-Payload-Length: {size}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse_head(head: bytes) -> dict[str, str]:
    """Header fields of a record, names in lower case."""
    lines = head.decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:60]!r}")
    return {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}


def _page_number(value: str):
    number = value.removeprefix("<urn:page:").removesuffix(">")
    return int(number) if number else None


def records_of(chunks):
    """(head, whole record) of every record in a stream of inflated chunks; holds one record and a chunk at a time."""
    buffer = bytearray()
    at, chunks = 0, iter(chunks)

    def more() -> bool:
        nonlocal at
        piece = next(chunks, None)
        if piece is None:
            return False
        del buffer[:at]
        at = 0
        buffer.extend(piece)
        return True

    while True:
        end, seen = buffer.find(b"\r\n\r\n", at), at
        while end < 0:
            seen = len(buffer) - at
            if not more():
                if len(buffer) > at:
                    raise ValueError("the archive ends within a record's head")
                return
            end = buffer.find(b"\r\n\r\n", max(0, seen - 3))
        head = bytes(buffer[at:end])
        size = end + 4 - at + int(parse_head(head)["content-length"]) + 4
        while len(buffer) - at < size:
            if not more():
                raise ValueError("the archive ends within a record")
        yield head, bytes(buffer[at:at + size])
        at += size


def inflate(handle):
    """Chunks of a gzip file of any number of members, read once from start to end."""
    import zlib

    inflater = zlib.decompressobj(31)
    while raw := handle.read(_CHUNK):
        while raw:
            piece = inflater.decompress(raw, 4 * _CHUNK)
            if piece:
                yield piece
            raw = inflater.unconsumed_tail
            if inflater.eof:
                raw = inflater.unused_data
                inflater = zlib.decompressobj(31)
    if piece := inflater.flush():
        yield piece


def mark_revisits(pages: DataFrame, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url",
                  html_col: str = "html") -> DataFrame:
    """(page_id, url, payload, payload_bytes, refers_to): what each page's record is to hold.

    Of equal payloads of at least ``min_bytes`` that with the largest id is the response; the others refer to
    it. Rows that share this id are all responses, as is a row with a null id. A null payload is empty. Equal payloads are known by
    SHA-256 and size; only ids and digests of repeated payloads are joined.
    """
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit("")).cast("binary")
    rows = (pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
            .withColumn("payload_bytes", F.length("payload").cast("bigint")).withColumn("_digest", F.sha2("payload", 256)))
    repeated = (rows.filter(F.col("payload_bytes") >= min_bytes).groupBy("_digest")
                .agg(F.max("page_id").alias("_last"), F.count("*").alias("_n")).filter("_n > 1").drop("_n"))
    refers = F.when(F.col("page_id") != F.col("_last"), F.col("_last"))
    return rows.join(repeated, "_digest", "left").withColumn("refers_to", refers).drop("_digest", "_last")


def write_archives(records: DataFrame, folder: str) -> DataFrame:
    """(archive, records): writes each partition of ``mark_revisits`` rows as one gzip stream."""
    def run(batches):
        import uuid
        import zlib

        import pyarrow as pa

        store = path = out = None
        deflater, count = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31), 0
        for batch in batches:
            names = batch.schema.names
            for i in range(batch.num_rows):
                row = {n: batch.column(k)[i].as_py() for k, n in enumerate(names)}
                if out is None:
                    store, root = open_store(folder)
                    store.create_dir(root, recursive=True)
                    path = f"{root}/{uuid.uuid4().hex}.warc.gz"
                    out = store.open_output_stream(path, compression=None)
                record = record_bytes(row["page_id"], row["url"], row["payload"], row["payload_bytes"],
                                      digest_of(row["payload"]), row["refers_to"])
                out.write(deflater.compress(record))
                count += 1
        if out is not None:
            out.write(deflater.flush())
            out.close()
            yield pa.RecordBatch.from_pydict({"archive": [path.rsplit("/", 1)[1]], "records": pa.array([count], pa.int64())})

    return materialise(records.mapInArrow(run, struct("archive string, records long")), "archives")


def normalise_archives(archives: DataFrame, source: str, folder: str) -> DataFrame:
    """The offset index of the archives, rewritten with every record as a gzip member of its own.

    ``archives`` names files in ``source``; a file is inflated once, from start to end, whatever its members. The new
    file lies in ``folder`` beside its index (``.idx``, a line for each record: record, page, offset, size). Rows are
    (archive, record, page_id, offset, size). A file is one task's work, as one gzip stream must be.
    """
    def run(batches):
        import uuid
        import zlib

        import pyarrow as pa

        schema = pa.schema([("archive", pa.string()), *[(n, pa.int64()) for n in ("record", "page_id", "offset", "size")]])
        for batch in batches:
            for name in batch.column(0).to_pylist():
                store, root = open_store(source)
                target, base = open_store(folder)
                target.create_dir(base, recursive=True)
                new = f"{uuid.uuid4().hex}.warc.gz"
                rows, offset, record = {n: [] for n in schema.names}, 0, 0
                with store.open_input_stream(f"{root}/{name}", compression=None) as handle, \
                        target.open_output_stream(f"{base}/{new}", compression=None) as out, \
                        target.open_output_stream(f"{base}/{new}.idx", compression=None) as index:
                    for head, whole in records_of(inflate(handle)):
                        deflater = zlib.compressobj(GZIP_LEVEL, zlib.DEFLATED, 31)
                        member = deflater.compress(whole) + deflater.flush()
                        out.write(member)
                        page = _page_number(parse_head(head)["warc-record-id"])
                        index.write(f"{record}\t{'' if page is None else page}\t{offset}\t{len(member)}\n".encode())
                        for n, v in zip(schema.names, (new, record, page, offset, len(member))):
                            rows[n].append(v)
                        offset, record = offset + len(member), record + 1
                        if record % 4096 == 0:
                            yield pa.RecordBatch.from_pydict(rows, schema=schema)
                            rows = {n: [] for n in schema.names}
                yield pa.RecordBatch.from_pydict(rows, schema=schema)

    names = archives.select("archive")
    spread = names.repartition(max(1, names.count()))  # a task for each file, however small the table of names
    return materialise(spread.mapInArrow(run, struct(INDEX_SCHEMA)), "offsets")


def read_archives(index: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to[, payload]) of every indexed record.

    Members are read by offset. A response whose payload does not have its digest is an error.
    """
    schema = struct(RECORD_SCHEMA if with_payload else RECORD_SCHEMA.removesuffix(", payload binary"))

    def run(batches):
        import gzip

        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)
        store, root = open_store(folder)
        opened, handle = None, None
        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("archive", "offset", "size")]
            rows = {n: [] for n in arrow.names}
            for name, offset, size in zip(*columns):
                if name != opened:
                    if handle:
                        handle.close()
                    opened, handle = name, store.open_input_file(f"{root}/{name}")
                head, _, body = gzip.decompress(handle.read_at(size, offset)).partition(b"\r\n\r\n")
                fields = parse_head(head)
                digest, kind = fields["warc-payload-digest"].removeprefix("sha1:"), fields["warc-type"]
                payload = body[:int(fields["content-length"])]
                if kind == "response" and digest_of(payload) != digest:
                    raise ValueError(f"payload of {fields['warc-record-id']} does not have its digest")
                refers = _page_number(fields["warc-refers-to"]) if kind == "revisit" else None
                row = (_page_number(fields["warc-record-id"]), fields["warc-target-uri"], int(fields["x-payload-length"]), digest,
                       kind, refers, *([payload] if with_payload else []))
                for n, v in zip(rows, row):
                    rows[n].append(v)
                if len(rows["page_id"]) == 256:
                    yield pa.RecordBatch.from_pydict(rows, schema=arrow)
                    rows = {n: [] for n in arrow.names}
            if rows["page_id"]:
                yield pa.RecordBatch.from_pydict(rows, schema=arrow)
        if handle:
            handle.close()

    files = index.select("archive").distinct().count()
    spread = index.repartition(max(1, files), "archive").sortWithinPartitions("archive", "offset")
    return spread.mapInArrow(run, schema)


def archive_pages(pages: DataFrame, spark: SparkSession, min_bytes: int = 0) -> tuple[DataFrame, str]:
    """Write a record for every page, normalise the archives; the offset index and the folder of the new archives."""
    raw, folder = scratch_path(spark, "warc-raw"), scratch_path(spark, "warc")
    archives = write_archives(mark_revisits(pages, min_bytes), raw)
    return normalise_archives(archives, raw, folder), folder
