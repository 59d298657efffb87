"""WARC archives: writing captures, reading records, and transaction assembly.

A capture is written as up to three records, each a gzip member of its own: a response (or, for a payload
already written, a revisit that names it), the request, and a metadata record;
the last two carry ``WARC-Concurrent-To`` with the response's id.  Reading
streams one record at a time.  Assembly joins records through those ids, in
either direction and over intermediate records, and emits one nested row per
capture.

Defined results: a null html is an empty payload; a null url is written as
``about:blank``; repeated rows are captures of their own (of equal rows one is
the response); a null page_id counts as larger than all others; records that
lead to no response form a capture without one; an empty table gives no files
and no rows; further columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomery.llm.frames import file_system
from loomery.llm.shingles import buffers
from loomery.operators.skew import join_back
from loomery.sources.staging import staged

MIN_SHARED = 100
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_DATE = "2024-01-01T00:00:00Z"
_ROLL_BYTES = 1 << 30
ANCHORS = ("response", "revisit", "resource")

RECORD_SCHEMA = "record_id string, record_type string, target_uri string, warc_date string, concurrent_to array<string>, refers_to string, payload_bytes long, payload_digest string, block binary"


def record_id(*parts: object) -> str:
    """A urn:uuid that depends on the parts alone, so a repeated task writes the same ids."""
    raw = hashlib.sha256("\x1f".join(map(str, parts)).encode()).digest()[:16]
    return f"<urn:uuid:{uuid.UUID(bytes=raw, version=5)}>"


def _record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + f"Content-Length: {len(block)}\r\n\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", 3, mtime=0)


def _clean(uri: str | None) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", uri) if uri else "about:blank"


def capture_records(page_key: str, page_id: int | None, url: str | None, payload: bytes, digest: str, target_key: str | None) -> bytes:
    """The records of one page; ``target_key`` names the page a revisit refers to."""
    own, uri = record_id("response", page_key), _clean(url)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    common = [("WARC-Target-URI", uri), ("WARC-Date", _DATE)]
    answer = [("WARC-Record-ID", own), *common, ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if target_key is None:
        out = _record([("WARC-Type", "response"), *answer], http + payload)
    else:
        out = _record([("WARC-Type", "revisit"), *answer, ("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id("response", target_key))], http)
    get = f"GET {uri} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode()
    request = [("WARC-Type", "request"), ("WARC-Record-ID", record_id("request", page_key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/http;msgtype=request")]
    facts = f"pageId: {'' if page_id is None else page_id}\r\n".encode()
    meta = [("WARC-Type", "metadata"), ("WARC-Record-ID", record_id("metadata", page_key)), *common, ("WARC-Concurrent-To", own), ("Content-Type", "application/warc-fields")]
    return out + _record(request, get) + _record(meta, facts)


def _digest_pages(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        offsets, data = buffers(batch.column(2))
        view, at = memoryview(data), offsets.tolist()
        found = [hashlib.sha256(view[at[i] : at[i + 1]]).hexdigest() for i in range(len(at) - 1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), pa.array([at[i + 1] - at[i] for i in range(len(at) - 1)], pa.int64())], names=["page_id", "row", "digest", "bytes"])


def find_revisits(pages: DataFrame, min_shared: int = MIN_SHARED) -> DataFrame:
    """``(page_id, row, digest, to_id, to_row)`` of the pages that revisit another.

    ``pages`` has ``page_id``, ``row`` (which tells repeated ids apart) and ``html``.
    """
    rows = staged(pages.select("page_id", "row", "html").mapInArrow(_digest_pages, "page_id long, row long, digest string, bytes long"), "warc-digests")
    large = rows.filter(F.col("bytes") >= min_shared)
    first = F.min(F.struct(F.col("page_id").isNull().alias("none"), F.col("page_id").alias("id"), F.col("row").alias("row")))
    groups = large.groupBy("digest").agg(first.alias("first"), F.count("*").alias("n")).filter("n > 1")
    groups = staged(groups.select("digest", "n", F.col("first.id").alias("to_id"), F.col("first.row").alias("to_row")), "warc-groups")
    total = groups.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    met = join_back(large, groups, "digest", "n", total, "inner")
    return met.filter(~(F.col("page_id").eqNullSafe(F.col("to_id")) & (F.col("row") == F.col("to_row")))).select("page_id", "row", "digest", "to_id", "to_row")


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_shared: int = MIN_SHARED) -> DataFrame:
    """Write ``pages`` as ``.warc.gz`` files under ``path``; lists ``(file, captures)`` as it is evaluated."""
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.col(html_col).alias("html"))
    ids = slim.groupBy("page_id").agg(F.count("*").alias("n"))
    if ids.filter("n > 1 or page_id is null").limit(1).collect():
        slim = staged(slim.withColumn("row", F.monotonically_increasing_id()), "warc-pages")
    else:
        slim = slim.withColumn("row", F.lit(0).cast("long"))
    revisits = staged(find_revisits(slim, min_shared), "warc-revisits").select(F.col("page_id").alias("_id"), F.col("row").alias("_row"), "to_id", "to_row")
    joined = slim.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("row") == F.col("_row")), "left")
    joined = joined.select("page_id", "row", "url", "html", "to_id", "to_row")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        fs, root = file_system(path)
        state: dict = {"n": 0}

        def close() -> pa.RecordBatch:
            state["stream"].close()
            name = f"{root}/pages-{context.partitionId():06d}-{state['n']:04d}.warc.gz"
            fs.move(state["hidden"], name)
            state["n"] += 1
            del state["stream"]
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([state["captures"]], pa.int64())], names=["file", "captures"])

        for batch in batches:
            ids, rows, urls, html, to_id, to_row = batch.columns
            offsets, data = buffers(html)
            for k in range(len(batch)):
                if "stream" not in state:
                    fs.create_dir(root, recursive=True)
                    state["hidden"] = f"{root}/_{context.partitionId()}-{context.taskAttemptId()}-{state['n']}"
                    state |= {"stream": fs.open_output_stream(state["hidden"]), "captures": 0}
                payload = data[offsets[k] : offsets[k + 1]].tobytes()
                target = f"{to_id[k].as_py()}.{to_row[k].as_py()}" if to_row[k].is_valid else None
                key = f"{ids[k].as_py()}.{rows[k].as_py()}"
                state["stream"].write(capture_records(key, ids[k].as_py(), urls[k].as_py(), payload, hashlib.sha256(payload).hexdigest(), target))
                state["captures"] += 1
                if state["stream"].tell() > _ROLL_BYTES:
                    yield close()
        if "stream" in state:
            yield close()

    return joined.mapInArrow(write, "file string, captures long")


def _records(stream) -> Iterator[tuple[list[tuple[str, str]], bytes]]:
    """Header fields and block of each record of an uncompressed stream."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {line[:40]!r}")
        fields = []
        while (line := stream.readline()).strip():
            if line[:1] in b" \t" and fields:  # a folded line goes on
                fields[-1] = (fields[-1][0], f"{fields[-1][1]} {line.decode('utf-8', 'replace').strip()}")
                continue
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields.append((name.strip().lower(), value.strip()))
        size = int(next((v for k, v in fields if k == "content-length"), "0"))
        block = stream.read(size)
        if len(block) != size:
            raise ValueError("a record ends early")
        yield fields, block


def _row(fields: list[tuple[str, str]], block: bytes, payloads: bool) -> dict:
    one = dict(reversed(fields))
    kind = one.get("warc-type", "").lower()
    named = (one.get("warc-payload-digest") or "").partition(":")
    payload, length, digest = block, len(block), None
    if "application/http" in one.get("content-type", "").lower():
        head, _, payload = block.partition(b"\r\n\r\n")
        length = len(payload)
        if kind == "revisit":
            found = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", head)
            length = int(found[1]) if found else 0
    if kind == "revisit":
        digest = named[2].lower() if named[0].lower() == "sha256" else None
    elif kind in ANCHORS:
        digest = hashlib.sha256(payload).hexdigest()
        if named[0].lower() == "sha256" and named[2].lower() != digest:
            raise ValueError(f"{one.get('warc-record-id')}: the payload differs from its digest")
    return {
        "record_id": one.get("warc-record-id"), "record_type": kind, "target_uri": one.get("warc-target-uri"), "warc_date": one.get("warc-date"),
        "concurrent_to": [v for k, v in fields if k == "warc-concurrent-to"], "refers_to": one.get("warc-refers-to"),
        "payload_bytes": length, "payload_digest": digest, "block": block if payloads or kind not in ANCHORS else None,
    }


_ARROW = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("warc_date", pa.string()), ("concurrent_to", pa.list_(pa.string())), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("block", pa.binary())])


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of all ``.warc`` and ``.warc.gz`` files under ``path``.

    Digests and sizes are taken from the payloads read (for revisits, from
    their headers).  Without ``payloads`` the blocks of responses are not
    returned, only measured.
    """
    fs, root = file_system(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    files = sorted(f.path for f in found if f.base_name.endswith((".warc", ".warc.gz")) and f.base_name[0] not in "_.")
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(len(files), 1), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with fs.open_input_stream(file, compression=None, buffer_size=1 << 20) as raw:
                    stream = io.BufferedReader(gzip.GzipFile(fileobj=raw) if file.endswith(".gz") else raw, 1 << 20)
                    rows, held = [], 0
                    for fields, block in _records(stream):
                        rows.append(_row(fields, block, payloads))
                        held += len(rows[-1]["block"] or b"") + 300
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, _ARROW)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)

    return listed.mapInArrow(read, RECORD_SCHEMA)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``(capture_id, response struct, requests array, metadata array)``.

    Links are followed in both directions, hop by hop from the responses, until
    a hop reaches no new record; a record that reaches several responses belongs to the
    nearest, and of those to the one with the least id.  Each hop joins the
    records first reached in the hop before, so the work is that of the links; a
    chain of n records takes n hops.
    """
    anchor = F.col("record_type").isin(*ANCHORS)
    others = records.filter(~anchor)
    links = records.select("record_id", F.explode("concurrent_to").alias("to"))
    edges = staged(links.select(F.col("record_id").alias("a"), F.col("to").alias("b")).unionByName(links.select(F.col("to").alias("a"), F.col("record_id").alias("b"))), "warc-links")
    heads = records.filter(anchor).select("record_id")
    wave, owned = heads.select("record_id", F.col("record_id").alias("capture_id")), None
    while True:
        step = edges.join(wave.withColumnRenamed("record_id", "a"), "a").groupBy(F.col("b").alias("record_id")).agg(F.min("capture_id").alias("capture_id"))
        step = step.join(heads, "record_id", "left_anti")
        wave = staged(step if owned is None else step.join(owned, "record_id", "left_anti"), "warc-wave")
        if not wave.limit(1).collect():
            break
        owned = wave if owned is None else staged(owned.unionByName(wave), "warc-owned")
        # Only records that links name can be reached; none left, and the next hop is empty.
        if not others.join(owned, "record_id", "left_anti").join(edges.select(F.col("b").alias("record_id")), "record_id", "left_semi").limit(1).collect():
            break
    body = F.struct("record_id", "record_type", "target_uri", "warc_date", "payload_bytes", "block")
    placed = others.join(owned, "record_id", "left") if owned is not None else others.withColumn("capture_id", F.lit(None).cast("string"))
    sides = placed.withColumn("capture_id", F.coalesce("capture_id", "record_id")).groupBy("capture_id").agg(
        F.sort_array(F.collect_list(F.when(F.col("record_type") == "request", body))).alias("requests"),
        F.sort_array(F.collect_list(F.when(F.col("record_type") != "request", body))).alias("metadata"),
    )
    main = records.filter(anchor).select(
        F.col("record_id").alias("capture_id"),
        F.struct("record_id", "record_type", "target_uri", "warc_date", "refers_to", "payload_bytes", "payload_digest", "block").alias("response"),
    )
    return main.join(sides, "capture_id", "full")


def page_captures(captures: DataFrame) -> DataFrame:
    """``(page_id, payload_bytes, payload_digest, record_type, refers_to)`` of assembled captures.

    The page id is read from the metadata record, and a revisit's target from
    the capture it refers to.
    """
    facts = F.decode(F.get(F.col("metadata"), F.lit(0))["block"], "UTF-8")
    number = F.regexp_extract(facts, r"(?m)^pageId: (-?\d+)", 1)
    flat = captures.filter("response is not null").select(
        "capture_id", F.when(number != "", number.cast("long")).alias("page_id"), F.col("response.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"), F.col("response.record_type").alias("record_type"), F.col("response.refers_to").alias("target"),
    )
    flat = staged(flat, "warc-captures")
    counts = flat.filter("target is not null").groupBy("target").agg(F.count("*").alias("n"))
    targets = counts.join(flat.select(F.col("capture_id").alias("target"), F.col("page_id").alias("refers_to")), "target")
    targets = staged(targets, "warc-targets")
    total = targets.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    seen = join_back(flat.filter("target is not null"), targets, "target", "n", total).select(*_CAPTURE, "refers_to")
    return flat.filter("target is null").select(*_CAPTURE, F.lit(None).cast("long").alias("refers_to")).unionByName(seen)


_CAPTURE = ["page_id", "payload_bytes", "payload_digest", "record_type"]
