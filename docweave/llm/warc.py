"""WARC archives: writing with revisits, chunked bodies and segments; reading with reassembly.

``plan_revisits`` decides on digests alone which pages are revisits. ``write_warc`` writes gzip
archives, one record to a gzip member, whose HTTP blocks use chunked transfer framing; a block longer
than ``segment_bytes`` goes out as a first record and continuation records. ``read_archive`` reads what was
written, by the manifest, which stays a table; ``read_warc`` reads any archives. Both parse records as a stream,
group segments by their origin identifier, order them by segment number, verify numbers
and total length, decode the framing, and verify payload digests. A record in one part is decoded
where it is read; only segments are shuffled, a group being one record.

Defined results: a null html is empty; null ids or urls read back as null, and urls as they were; of pages
with one page_id and equal payloads, all are what the first is; an empty table writes nothing and reads as
empty; extra columns are ignored. Of records that others wrote, page_id is null, and so is refers_to; a
missing or foreign digest isn't verified, payload_digest is computed, or null for a revisit without one,
like its payload_bytes without a length. A damaged group raises ``ValueError``: nothing is dropped silently.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.tokenstore import open_fs
from docweave.runtime import cut, shared_path, ship_package

MIN_REVISIT = 1000
SEGMENT_BYTES = 16 << 10
FILE_BYTES = 12 << 20
READ_TASKS = 20_000  # of one read, at most; a task reads several files
CHUNK = 4096
END = b"\r\n"


def plan_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, digest, refers_to of the pages that are revisits; only digests and ids are shuffled."""
    html = F.coalesce("html", F.lit(""))
    meta = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n")).where(F.col("n") >= min_bytes).drop("n")
    firsts = meta.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    return meta.join(firsts, "digest").where("page_id <> refers_to").dropDuplicates(["page_id", "digest"]).select("page_id", "digest", "refers_to")


def chunked(body: bytes, size: int = CHUNK) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(c), c) for c in (body[i : i + size] for i in range(0, len(body), size))]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunk(raw: bytes) -> bytes:
    out, at = [], 0
    while True:
        end = raw.index(END, at)
        n = int(raw[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            if raw[at:].strip(END):  # trailer fields may follow; each ends a line
                if not raw.endswith(END + END):
                    raise ValueError("chunked body: the trailer doesn't end")
            return b"".join(out)
        if raw[at + n : at + n + 2] != END:
            raise ValueError("chunked body: a chunk's length is wrong")
        out.append(raw[at : at + n])
        at += n + 2


def _record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))]) + "\r\n"
    return gzip.compress(head.encode() + block + END + END, 1, mtime=0)


def _name(page_id, digest: str) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}>"


_OWN = re.compile(r"<urn:x-page:(null|-?\d+):[0-9a-f]{40}>")


def _page(name: str | None) -> int | None:
    """The page_id in a record id of this library."""
    m = _OWN.fullmatch(name or "")
    return int(m[1]) if m and m[1] != "null" else None


def _target(url: str | None) -> list[tuple[str, str]]:
    """The url as it is where a header can hold it, or else escaped, with a header that says so."""
    if url is None:
        return []
    if url and url == url.strip() and url.isprintable():
        return [("WARC-Target-URI", url)]
    return [("WARC-Target-URI", quote(url, safe="")), ("X-Target-URI-Encoding", "percent")]


def page_records(page_id, url, html: str, refers_to, segment_bytes: int = SEGMENT_BYTES) -> list[bytes]:
    payload = (html or "").encode()
    sha = hashlib.sha1(payload)
    digest = "sha1:" + base64.b32encode(sha.digest()).decode()
    own = _name(page_id, sha.hexdigest())
    base = [("WARC-Record-ID", own), ("WARC-Date", "2024-01-01T00:00:00Z"), *_target(url), ("WARC-Payload-Digest", digest), ("Content-Type", "application/http; msgtype=response")]
    if refers_to is not None:
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
        more = [("WARC-Type", "revisit"), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", _name(refers_to, sha.hexdigest()))]
        return [_record(more + base, head)]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment_bytes:
        return [_record([("WARC-Type", "response"), *base], block)]
    cuts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    out = [_record([("WARC-Type", "response"), ("WARC-Segment-Number", "1"), *base], cuts[0])]
    for i, part in enumerate(cuts[1:], 2):
        own_id = own[:-1] + f":{i}>"
        head = [("WARC-Type", "continuation"), ("WARC-Record-ID", own_id), ("WARC-Date", "2024-01-01T00:00:00Z"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(i))]
        if i == len(cuts):
            head.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(_record(head, part))
    return out


def write_warc(pages: DataFrame, path: str, revisits: DataFrame | None = None, segment_bytes: int = SEGMENT_BYTES, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write all pages under ``path``/warc; returns the manifest (file, records, bytes)."""
    spark = pages.sparkSession
    ship_package(spark)
    revisits = plan_revisits(pages) if revisits is None else revisits
    html = F.coalesce("html", F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(html).alias("digest"))
    rows = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "refers_to")

    def run(batches):
        from pyspark import TaskContext

        context = TaskContext.get()  # an attempt that died leaves files that no manifest names
        task, number, out, size, records, done = f"{context.partitionId():06d}-{context.taskAttemptId()}", 0, None, 0, 0, []
        fs, root = open_fs(f"{path}/warc")

        def close():
            nonlocal out, number
            out.close()
            fs.move(name + ".part", name)
            done.append((name.rsplit("/", 1)[1], records, size))
            out, number = None, number + 1

        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for raw in page_records(*row, segment_bytes=segment_bytes):
                    if out is None:
                        fs.create_dir(root, recursive=True)
                        name, size, records = f"{root}/part-{task}-{number:05d}.warc.gz", 0, 0
                        out = fs.open_output_stream(name + ".part", compression=None)
                    out.write(raw)
                    size += len(raw)
                    records += 1
                    if size >= file_bytes:
                        close()
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["file", "records", "bytes"])

    rows.mapInArrow(run, "file string, records long, bytes long").write.parquet(f"{path}/manifest")
    return spark.read.parquet(f"{path}/manifest")


def parse_members(raw):
    """(headers, block) of each record of an archive, bytes or an open file, gzip members or plain."""
    source = io.BytesIO(raw) if isinstance(raw, bytes) else raw
    zipped = source.read(2) == b"\x1f\x8b"
    source.seek(0)
    stream = io.BufferedReader(gzip.GzipFile(fileobj=source) if zipped else source)
    while True:
        line = stream.readline()
        while line in (END, b"\n"):
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record: {line[:40]!r}")
        head: dict[str, str] = {}
        for line in iter(stream.readline, END):
            if not line:
                raise ValueError("a record's header doesn't end")
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        n = int(head["content-length"])
        block = stream.read(n)
        if len(block) != n:
            raise ValueError("a record is cut short")
        yield head, block


def decode_http(block: bytes) -> bytes:
    head, _, body = block.partition(END + END)
    fields = dict(x.lower().split(b":", 1) for x in head.split(END)[1:] if b":" in x)
    return unchunk(body) if fields.get(b"transfer-encoding", b"").strip() == b"chunked" else body


def _sha1(declared: str | None) -> str | None:
    """The hexadecimal form of a SHA-1 digest header, base 32 or hexadecimal; None for anything else."""
    kind, _, value = (declared or "").partition(":")
    if kind.lower() != "sha1":
        return None
    if re.fullmatch("[0-9a-fA-F]{40}", value):
        return value.lower()
    return base64.b32decode(value.upper()).hex() if re.fullmatch("[A-Za-z2-7]{32}", value) else None


def _facts(head: dict, block: bytes) -> tuple:
    """page_id, url, payload bytes, digest, type, refers_to and payload of a whole record; digests are verified."""
    name, declared, url = head.get("warc-record-id"), _sha1(head.get("warc-payload-digest")), head.get("warc-target-uri")
    if head.get("x-target-uri-encoding") == "percent":
        url = unquote(url)
    if head["warc-type"] == "revisit":
        fields = dict(x.lower().split(b":", 1) for x in block.split(END)[1:] if b":" in x)
        n = fields.get(b"content-length", b"").strip()
        return _page(name), url, int(n) if n.isdigit() else None, declared, "revisit", _page(head.get("warc-refers-to")), None
    payload = decode_http(block) if "http" in head.get("content-type", "http") else block
    found = hashlib.sha1(payload).hexdigest()
    if declared not in (None, found):
        raise ValueError(f"{name}: the payload doesn't match its digest")
    return _page(name), url, len(payload), found, "response", None, payload


def reassemble(parts: list[dict]) -> tuple[dict, bytes]:
    """Headers and whole block of a record's segments, ``number``, ``head``, ``block``, in any order."""
    by = {}
    for p in parts:
        if by.setdefault(p["number"], p)["block"] != p["block"]:
            raise ValueError("two segments have one number")
    order = sorted(by)
    if order != list(range(1, len(order) + 1)):
        raise ValueError(f"segments are missing: {order[:9]}")
    total = by[order[-1]]["head"].get("warc-segment-total-length")
    block = b"".join(by[i]["block"] for i in order)
    if total is None or int(total) != len(block):
        raise ValueError(f"segments hold {len(block)} bytes of {total}")
    return by[1]["head"], block


_ROW = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
_TYPES = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
_NAMES = [x.split()[0] for x in _ROW.split(", ")]


def read_archive(spark: SparkSession, path: str, with_payload: bool = False) -> DataFrame:
    """What ``write_warc`` wrote under ``path``. Files that a dead attempt left aren't in the manifest.

    The list of files is dealt out to tasks; none passes the driver.
    """
    manifest = spark.read.parquet(f"{path}/manifest")
    files = manifest.select("file").repartition(max(1, min(READ_TASKS, manifest.count())))

    def opened(batch):
        for file in batch.column(0).to_pylist():
            fs, root = open_fs(f"{path}/warc")
            with fs.open_input_file(f"{root}/{file}") as f:
                yield f

    return _records(files, opened, with_payload)


def read_warc(spark: SparkSession, paths: str | list[str], with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of every record (and payload)."""
    if not paths:
        return spark.createDataFrame([], _ROW if with_payload else _ROW.rsplit(",", 1)[0])
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(paths).select("content")
    return _records(files, lambda batch: (memoryview(raw.as_buffer()).tobytes() for raw in batch.column(0)), with_payload)


def _records(files: DataFrame, opened, with_payload: bool) -> DataFrame:
    """Records of ``files``; ``opened`` yields the archives that a batch of its rows names."""
    ship_package(files.sparkSession)
    names, types = [*_NAMES, "origin", "number", "head", "block"], [*_TYPES, pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]

    def parse(batches):
        for batch in batches:
            for archive in opened(batch):
                rows, size = [], 0
                for head, block in parse_members(archive):
                    if "warc-segment-number" in head:
                        origin = head.get("warc-segment-origin-id", head["warc-record-id"])
                        rows.append((*[None] * 7, origin, int(head["warc-segment-number"]), list(head.items()), block))
                    elif head["warc-type"] in ("response", "revisit"):
                        got = _facts(head, block)
                        rows.append((*got[:6], got[6] if with_payload else None, None, None, None, None))
                    size += len(block)
                    if len(rows) >= 2000 or size > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    parsed = cut(files.mapInArrow(parse, _ROW + ", origin string, number long, head map<string,string>, block binary"), "warcrows")
    groups = parsed.where("origin is not null").groupBy("origin").agg(F.collect_list(F.struct("number", "head", "block")).alias("parts"))

    def join(batches):
        for batch in batches:
            rows = []
            for parts in batch.column(1):
                got = _facts(*reassemble([{"number": p["number"].as_py(), "head": dict(p["head"].as_py()), "block": p["block"].as_py()} for p in parts]))
                rows.append((*got[:6], got[6] if with_payload else None))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)

    whole = parsed.where("origin is null").select(*_NAMES).unionByName(groups.mapInArrow(join, _ROW))
    return whole if with_payload else whole.drop("payload")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    write_warc(spark.read.parquet(f"{sf_dir}/pages.parquet"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url")


ORACLE = """
with p as (select page_id, url, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
largest as (select html, max(page_id) as top from p where n >= 1000 group by html)
select page_id, n::bigint as payload_bytes, sha1(p.html) as payload_digest, case when top <> page_id then 'revisit' else 'response' end as record_type,
       case when top <> page_id then top end as refers_to, url
from p left join largest on n >= 1000 and p.html = largest.html
"""
