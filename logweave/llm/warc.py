"""WARC archives: write pages as records, normalise whole-file gzip, read back through an index.

``write_archives`` writes one archive per partition, each a single gzip stream over all its records as
crawlers that compress whole files leave them. Such a stream cannot be entered in the middle.
``normalise`` inflates each once, record by record, and rewrites every record as a gzip member of its
own, with a sidecar index of offsets beside the archive. ``read_records`` reads records of normalised
archives by index, so the work is split by records, not by files.

Archives lie in the folder of ``spark.checkpoint.dir`` or any folder that pyarrow's file systems reach
(local, hdfs, s3, gs). A task writes under a name of its own attempt and moves the finished file in
place, so repeated attempts leave one whole file. Memory is bounded by the largest record.

Nulls and edges: a null html is an empty payload; a null url becomes a name made from the page's id;
pages with a null page_id are records without id. Among equal payloads of at least ``REVISIT_FROM``
bytes those with the smallest page_id are responses, the others (null ids too, unless all are null)
revisit it.
"""

import gzip
import hashlib
import json
import re
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import functions as F

from logweave.session import checkpoint_dir, materialize

REVISIT_FROM = 100
CHUNK = 1 << 16
READ_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_HEADER_END = b"\r\n\r\n"


def record_kinds(pages, least=REVISIT_FROM):
    """``page_id, url, html, digest, record_type, refers_to`` of every page.

    Groups of equal payloads are found by digest, pre-aggregated; only digests that occur twice are
    joined back.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                         F.coalesce("html", F.lit("")).alias("html")).withColumn("digest", F.sha2(F.col("html").cast("binary"), 256))
    firsts = (pages.where(F.octet_length("html") >= least).groupBy("digest")
              .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 AND first IS NOT NULL").select("digest", "first"))
    joined = pages.join(materialize(firsts, "copied"), "digest", "left")
    again = F.coalesce(F.col("first") != F.col("page_id"), F.col("first").isNotNull())
    return joined.select("page_id", "url", "html", "digest", F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("first")).alias("refers_to"))


def _name(page_id):
    return f"urn:page:{'' if page_id is None else page_id}"


def record(page_id, url, payload, digest, kind, refers_to):
    """Bytes of one record, not compressed. A revisit carries no payload, only its length and digest."""
    target = re.sub(r"[^\x21-\x7e]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url or "") or _name(page_id)
    head = [f"WARC/1.1\r\nWARC-Type: {kind}", f"WARC-Record-ID: <{_name(page_id)}>", f"WARC-Target-URI: {target}", f"WARC-Date: {DATE}",
            f"WARC-Payload-Digest: sha256:{digest}", f"WARC-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{_name(refers_to)}>"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http if kind == "revisit" else http + payload
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _HEADER_END + block + b"\r\n\r\n"


def parse(data):
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of a record's bytes; length
    and digest of a response are taken from its payload."""
    head, _, rest = data.partition(_HEADER_END)
    fields = {}
    for line in head.split(b"\r\n")[1:]:
        key, _, value = line.partition(b":")
        fields[key.strip().lower()] = value.strip().decode()
    block = rest[:int(fields[b"content-length"])]
    kind = fields[b"warc-type"]

    def page(field):
        number = fields.get(field, "").strip("<>").removeprefix("urn:page:")
        return int(number) if number else None
    if kind == "revisit":
        size, digest = int(fields[b"warc-payload-length"]), fields[b"warc-payload-digest"].removeprefix("sha256:")
    else:
        payload = block.partition(_HEADER_END)[2]
        size, digest = len(payload), hashlib.sha256(payload).hexdigest()
    return page(b"warc-record-id"), size, digest, kind, page(b"warc-refers-to")


class _Output:
    """A file that appears under its name only once it is whole."""

    def __init__(self, folder, name):
        self.fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        self.fs.create_dir(root, recursive=True)
        self.final, self.draft = f"{root}/{name}", f"{root}/.{name}-{uuid.uuid4().hex}"
        self.stream = self.fs.open_output_stream(self.draft)
        self.size = 0

    def write(self, data):
        self.stream.write(data)
        self.size += len(data)

    def close(self):
        self.stream.close()
        try:
            self.fs.move(self.draft, self.final)
        except OSError:  # some stores do not replace; an earlier attempt's file holds the same records
            if self.fs.get_file_info(self.final).type == pyarrow.fs.FileType.NotFound:
                raise
            self.fs.delete_file(self.draft)


def write_archives(pages, folder):
    """Write ``pages`` (as from :func:`record_kinds`) into whole-file gzip archives; ``archive`` names.

    Written once: the names come back as a table read from the shared folder.
    """
    def run(batches):
        from pyspark import TaskContext
        # the name belongs to the partition, so that a repeated attempt replaces its file
        out, name = None, f"pages-{TaskContext.get().partitionId():06d}.warc.gz"
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "record_type", "refers_to")]
            for page_id, url, html, *rest in zip(*columns):
                if out is None:
                    out, packer = _Output(folder, name), zlib.compressobj(1, zlib.DEFLATED, 31)
                out.write(packer.compress(record(page_id, url, html.encode("utf-8", "replace"), *rest)))
        if out is not None:
            out.write(packer.flush())
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name])], ["archive"])
    return materialize(pages.mapInArrow(run, "archive string"), "archives")


def records_of(stream):
    """The records of one gzip stream (of any number of members), inflated piece by piece."""
    data, buffer, need = zlib.decompressobj(31), bytearray(), None
    while piece := stream.read(CHUNK):
        while piece:
            buffer += data.decompress(piece)
            piece = b""
            if data.eof:
                piece, data = data.unused_data, zlib.decompressobj(31)
            at = 0
            while True:
                if need is None:
                    end = buffer.find(_HEADER_END, at)
                    if end < 0:
                        break
                    length = re.search(rb"(?im)^content-length:\s*(\d+)", buffer[at:end])
                    need = end + 4 - at + int(length[1]) + 4
                if len(buffer) - at < need:
                    break
                yield bytes(buffer[at:at + need])
                at, need = at + need, None
            del buffer[:at]
    if buffer:
        raise ValueError(f"the last record is cut short: {len(buffer)} bytes left")


def normalise(archives, source, target):
    """Rewrite each archive with one gzip member per record: ``archive, offset, length``.

    Beside each archive lies ``<name>.idx``, a JSON line per record. Each archive is read once, as a stream.
    """
    def run(batches):
        for batch in batches:
            for name in batch.column("archive").to_pylist():
                fs, root = pyarrow.fs.FileSystem.from_uri(source)
                out, index, places = _Output(target, name), _Output(target, f"{name}.idx"), []
                with fs.open_input_file(f"{root}/{name}") as stream:
                    for data in records_of(stream):
                        member = gzip.compress(data, 6, mtime=0)
                        place = (name, out.size, len(member))
                        index.write((json.dumps(dict(zip(("archive", "offset", "length"), place))) + "\n").encode())
                        places.append(place)
                        out.write(member)
                        if len(places) >= 4096:
                            yield _places(places)
                            places = []
                out.close()
                index.close()
                yield _places(places)
    # one archive is one stream, so archives are the unit of work
    spread = archives.repartitionByRange(max(1, archives.count()), "archive")
    return materialize(spread.mapInArrow(run, "archive string, offset long, length long"), "index")


def _places(places):
    names, offsets, lengths = zip(*places) if places else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(offsets, pa.int64()), pa.array(lengths, pa.int64())], ["archive", "offset", "length"])


def read_records(index, folder):
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of the records that ``index`` names."""
    def run(batches):
        fs, root = pyarrow.fs.FileSystem.from_uri(folder)
        open_files = {}
        for batch in batches:
            out = []
            for name, offset, length in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))):
                if name not in open_files:
                    for f in open_files.values():
                        f.close()
                    open_files = {name: fs.open_input_file(f"{root}/{name}")}
                open_files[name].seek(offset)
                out.append(parse(gzip.decompress(open_files[name].read(length))))
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())
            columns = [pa.array(c, k) for c, k in zip(zip(*out) if out else [()] * 5, kinds)]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])
    size = index.agg(F.sum("length")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, size // READ_BYTES)
    return index.repartitionByRange(parts, "archive", "offset").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def round_trip(pages):
    """Pages written, normalised and read back; the rows of :func:`read_records`."""
    folder = f"{checkpoint_dir(pages.sparkSession)}/logweave/warc-{uuid.uuid4().hex}"
    whole, parts = f"{folder}/whole", f"{folder}/records"
    archives = write_archives(record_kinds(pages), whole)
    return read_records(normalise(archives, whole, parts), parts)
