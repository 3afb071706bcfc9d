"""Deterministic sharded WARC writer and reader.

Writing.  Light rows (id, digest) decide the record types: of records with equal
payloads the one with the smallest id is the response, the others revisit it.  Ids
are cut into contiguous ranges of about ``shard_bytes`` payload bytes: exact byte
counts of equal id slices, and of slices of a slice that holds more than a shard, until
none does or it is one id; so clustered ids and outliers give even shards, and the same
input always gives the same ones.  Each shard is sorted by id and written by one task,
which starts a new file when the compressed size passes ``file_bytes``.  Payloads are shuffled once: the decisions
travel as marker rows that sort right before the pages they are about.  Every
record is a gzip member of its own with its headers and digests computed anew.

Committing.  A file is written under a temporary name that no other attempt uses
and renamed when complete.  Names and contents depend on the input alone, so a
task that runs again replaces its files with equal ones.  The manifest, one row
for each file with its records, sizes and SHA-1, is written last; a file that is
not in the manifest is not part of the archive.

Reading.  ``read_archive`` reads the manifest's files whole (their size is
bounded by ``file_bytes`` plus one record), checks them against the manifest,
and re-computes each block's and payload's digest.

Files are written through pyarrow's file systems, so any store that Arrow knows
will do, and read with Spark's binaryFile source.

Defined cases: a null payload is empty; a null URL is written as an empty
header; null ids sort first and are a response only when no id has the payload;
rows with the same id and payload are one response and revisits of it; an empty
table gives an archive without files.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, fresh_folder

_SLICES = 1 << 16
_STEP = 1 << 13
_MANIFEST = "shard long, file string, records long, bytes long, sha1 string"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _revisits(pages: DataFrame, least_bytes: int) -> DataFrame:
    """(page_id, digest, refers_to) of payloads that a smaller id has as well."""
    light = pages.select("page_id", F.sha1("html").alias("digest"), "n_bytes").where(F.col("n_bytes") >= least_bytes)
    first = light.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    return light.join(first, "digest").where("refers_to < page_id or page_id is null and refers_to is not null") \
        .select("page_id", "digest", "refers_to").distinct()


def _slice_bytes(pages: DataFrame, parts: list[tuple[int, int, int]]) -> dict[tuple[int, int], int]:
    """{(part, slice): bytes} of the pages whose ids lie in the parts (start, end, width)
    of the id range, each cut into slices of its width."""
    starts, ends, widths = (np.array(x, np.int64) for x in zip(*parts))

    def key(ids: pd.Series) -> pd.Series:
        i = ids.to_numpy(np.int64)
        at = np.maximum(np.searchsorted(starts, i, "right") - 1, 0)
        inside = (i >= starts[at]) & (i <= ends[at])
        # differences of ids may pass 2**63
        offset = (i.view(np.uint64) - starts[at].view(np.uint64)) // widths[at].view(np.uint64)
        return pd.Series(np.where(inside, at * (2 * _SLICES) + offset.astype(np.int64), -1))

    sums = pages.where("page_id is not null").select(F.pandas_udf(key, "long")("page_id").alias("k"), "n_bytes") \
        .where("k >= 0").groupBy("k").agg(F.sum(F.col("n_bytes") + 600).alias("n"))
    return {divmod(k, 2 * _SLICES): n for k, n in sums.collect()}  # at most 2 * _SLICES rows


def _shards(pages: DataFrame, shard_bytes: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(first ids of slices, their shards, number of shards)."""
    low, high = pages.agg(F.min("page_id"), F.max("page_id")).first()
    if low is None:
        return np.array([0], np.int64), np.array([0], np.int64), 1
    todo, sizes = [(low, high)], {}
    while todo:
        per = max(2, _SLICES // len(todo))
        parts = [(a, b, (b - a) // per + 1) for a, b in sorted(todo)]
        todo = []
        for (at, nth), n in _slice_bytes(pages, parts).items():
            a, b, width = parts[at]
            start, end = a + nth * width, min(b, a + (nth + 1) * width - 1)
            if n > shard_bytes and end > start:
                todo.append((start, end))
            else:
                sizes[start] = n
    starts = sorted(sizes)
    before = np.cumsum([0] + [sizes[s] for s in starts[:-1]], dtype=object)
    # numbers without holes: a slice larger than a shard would leave some
    shard = np.unique(np.array([n // shard_bytes for n in before]), return_inverse=True)[1]
    return np.array(starts, np.int64), shard.astype(np.int64), int(shard[-1]) + 1


def record_bytes(page_id, key: str, url: str, payload: bytes, digest: str, refers: str | None,
                 refers_to, date: str) -> bytes:
    """One WARC/1.1 record, response or revisit, uncompressed."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers else http + payload
    clean = (url or "").translate({10: "%0A", 13: "%0D"})
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers else 'response'}", f"WARC-Record-ID: <{key}>",
            f"WARC-Date: {date}", f"WARC-Target-URI: {clean}", "Content-Type: application/http; msgtype=response",
            f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{sha1_base32(block)}",
            f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers:
        head += [f"WARC-Refers-To: <{refers}>", f"X-Refers-To-Page-ID: {'' if refers_to is None else refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _gzip_member(data: bytes) -> bytes:
    c = zlib.compressobj(6, zlib.DEFLATED, 31)  # 31: gzip framing, its time field is 0
    return c.compress(data) + c.flush()


def write_archive(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  least_bytes: int = 0, shard_bytes: int = 32 << 20, file_bytes: int = 32 << 20,
                  date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Write the pages as WARC files below ``folder``; returns the manifest, which
    is also written to ``folder``/manifest."""
    spark = pages.sparkSession
    bounded_batches(spark, 500)
    html = F.coalesce(F.col(payload_col).cast("string"), F.lit(""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"),
                        html.alias("html")).withColumn("n_bytes", F.octet_length("html").cast("long"))
    starts, shards, n_shards = _shards(rows, shard_bytes)

    def shard_of(ids: pd.Series) -> pd.Series:
        known = ids.notna().to_numpy()
        i = np.array([int(x) for x in ids[known]], np.int64)
        out = np.zeros(len(ids), np.int64)  # null ids: shard 0
        out[known] = shards[np.maximum(np.searchsorted(starts, i, "right") - 1, 0)]
        return pd.Series(out)

    marks = _revisits(rows, least_bytes).select("page_id", "digest", "refers_to", F.lit(0).alias("is_page"),
                                                F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    both = marks.unionByName(rows.select("page_id", F.sha1("html").alias("digest"), F.lit(None).cast("long").alias("refers_to"),
                                         F.lit(1).alias("is_page"), "url", "html"))
    sharded = both.withColumn("shard", F.pandas_udf(shard_of, "long")(F.col("page_id").cast("string")))
    dealt = sharded.repartitionById(n_shards, F.col("shard").cast("int")) \
        .sortWithinPartitions("shard", "page_id", "digest", "is_page", "url") \
        .withColumns({c: F.col(c).cast("string") for c in ("page_id", "refers_to")})  # pandas would make them floats

    def run(batches):
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder)
        store.create_dir(base, recursive=True)
        out = shard = temp = None
        done, part, count, size, sha = [], 0, 0, 0, None
        mark, last, repeat = None, None, 0

        def finish():
            nonlocal out
            if out is None:
                return
            out.close()
            name = f"shard-{shard:06d}-{part:05d}.warc.gz"
            store.move(f"{base}/{temp}", f"{base}/{name}")
            done.append((shard, name, count, size, sha.hexdigest()))
            out = None

        for b in batches:
            for r in b.itertuples(index=False):
                page = None if r.page_id is None else int(r.page_id)
                if not r.is_page:
                    mark = (page, r.digest, int(r.refers_to))
                    continue
                if r.shard != shard:
                    finish()
                    shard, part = r.shard, 0
                elif out is not None and size >= file_bytes:
                    finish()
                    part += 1
                if out is None:
                    temp, count, size, sha = f".tmp-{uuid.uuid4().hex}", 0, 0, hashlib.sha1()
                    out = store.open_output_stream(f"{base}/{temp}", compression=None)
                repeat, last = (repeat + 1 if last == (page, r.digest) else 0), (page, r.digest)
                payload = r.html.encode()
                digest = base64.b32encode(bytes.fromhex(r.digest)).decode()
                refers_to = refers = None
                if mark is not None and mark[:2] == last:
                    refers_to = mark[2]
                    refers = f"urn:page:{refers_to}:{digest}:0"
                elif repeat and len(payload) >= least_bytes:
                    refers_to, refers = page, f"urn:page:{page}:{digest}:0"
                member = _gzip_member(record_bytes(page, f"urn:page:{page}:{digest}:{repeat}", r.url, payload, digest,
                                                   refers, refers_to, date))
                out.write(member)
                sha.update(member)
                count, size = count + 1, size + len(member)
        finish()
        if done:
            yield pd.DataFrame(done, columns=["shard", "file", "records", "bytes", "sha1"])

    path = f"{folder}/manifest"
    dealt.mapInPandas(run, _MANIFEST).write.parquet(path)
    return spark.read.schema(_MANIFEST).parquet(path)


def parse_records(data: bytes):
    """(headers, block) of every record of a WARC file of gzip members."""
    view, at = memoryview(data), 0
    while at < len(view):
        member, raw = zlib.decompressobj(31), b""
        while not member.eof:  # in steps, so that what follows the member isn't copied
            if at >= len(view):
                raise ValueError("truncated gzip member")
            raw += member.decompress(view[at:at + _STEP])
            at += min(_STEP, len(view) - at)
        at -= len(member.unused_data)
        head, _, rest = raw.partition(b"\r\n\r\n")
        lines = head.decode().split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError("not a WARC record")
        headers = {k: v for k, _, v in (line.partition(": ") for line in lines[1:])}
        size = int(headers["Content-Length"])
        if rest[size:] != b"\r\n\r\n":
            raise ValueError("wrong Content-Length")
        yield headers, rest[:size]


def read_archive(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per record: page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, payload (null for revisits).  Damage is an error: a file of
    the manifest that is missing, or whose size, digest or number of records differs."""
    spark = manifest.sparkSession
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder) \
        .select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    lost = manifest.select("file").join(files.select("file"), "file", "left_anti").first()  # names alone
    if lost is not None:
        raise ValueError(f"{lost.file} of the manifest is missing")
    listed = files.join(F.broadcast(manifest.select("file", "records", "bytes", "sha1")), "file") \
        if manifest.count() <= 1_000_000 else files.join(manifest.select("file", "records", "bytes", "sha1"), "file")

    def run(batches):
        for b in batches:
            for f in b.itertuples(index=False):
                if len(f.content) != f.bytes or hashlib.sha1(f.content).hexdigest() != f.sha1:
                    raise ValueError(f"{f.file} differs from its manifest entry")
                rows, n = [], 0
                for h, block in parse_records(f.content):
                    n += 1
                    if sha1_base32(block) != h["WARC-Block-Digest"].removeprefix("sha1:"):
                        raise ValueError(f"{f.file}: block digest")
                    digest, kind = h["WARC-Payload-Digest"].removeprefix("sha1:"), h["WARC-Type"]
                    payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                    if payload is not None and (sha1_base32(payload) != digest or len(payload) != int(h["X-Payload-Length"])):
                        raise ValueError(f"{f.file}: payload digest")
                    rows.append((h["X-Page-ID"] or None, h["WARC-Target-URI"], int(h["X-Payload-Length"]), digest, kind,
                                 h.get("X-Refers-To-Page-ID") or None, payload.decode() if payload is not None else None))
                    if len(rows) == 500:
                        yield _frame(rows)
                        rows = []
                if n != f.records:
                    raise ValueError(f"{f.file} has {n} records, its manifest entry {f.records}")
                yield _frame(rows)

    records = listed.mapInPandas(run, "page_id string, url string, payload_bytes long, payload_digest string, "
                                      "record_type string, refers_to string, payload string")
    return records.withColumns({c: F.col(c).cast("long") for c in ("page_id", "refers_to")})


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"])


def archive_round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write the pages to a new archive in the shared folder, read it back, and
    return what the archive says of each page."""
    folder = fresh_folder(pages.sparkSession, "warc")
    manifest = write_archive(pages, folder, **options)
    return read_archive(folder, manifest).drop("payload", "url")
