"""Token-id files of independent zstandard frames with a trailing seek table.

One file per range of documents, in ascending order of their ids.  Each
document's ids (little-endian unsigned 32-bit) are one zstandard frame with its own content
checksum.  Two skippable frames end the file: the number of frames without an id
(they come first) and the doc_ids of the frames, and the seek table of the public zstd seekable format (compressed size,
decompressed size and the low 32 bits of XXH64 of the content for each frame,
then the frame count, a descriptor byte and the magic number).  A reader fetches
the tail, then only the frames it was asked for; a whole file is also a valid
input for any zstd tool.

Defined results: a null text counts as empty and is the end id alone; repeated
doc_ids are frames of their own, ordered by text; a null doc_id comes first;
an empty table gives no files and no rows; further columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Magic numbers of the zstd seekable format.
_SKIPPABLE, _IDS_FRAME, _SEEKABLE = 0x184D2A5E, 0x184D2A5D, 0x8F92EAB1
_CHECKSUMS = 0x80
# The normaliser and the splitting of lower-casing vocabularies with word ends.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]}
_SPLITTER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
_MEMO_WORDS, _MEMO_LONGEST = 1_200_000, 120
_TEXTS = 64


class FrameWriter:
    """Writes documents to an open binary stream."""

    def __init__(self, stream, level: int = 1):
        self.stream, self.ids, self.entries, self.nulls = stream, [], [], 0
        self.pack = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)

    def add(self, doc_id: int | None, payload: bytes) -> None:
        """Append a document; those without an id come first."""
        frame = self.pack.compress(payload)
        self.stream.write(frame)
        self.ids.append(doc_id or 0)
        self.nulls += doc_id is None
        self.entries.append((len(frame), len(payload), xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF))

    def close(self) -> None:
        ids = np.array([self.nulls, *self.ids], "<i8").tobytes()
        self.stream.write(struct.pack("<II", _IDS_FRAME, len(ids)) + ids)
        table = np.array(self.entries, "<u4").tobytes() + struct.pack("<IBI", len(self.entries), _CHECKSUMS, _SEEKABLE)
        self.stream.write(struct.pack("<II", _SKIPPABLE, len(table)) + table)


class FrameReader:
    """Reads single documents of a file; ``source`` offers seek, read and size."""

    def __init__(self, source, size: int):
        self.source, self.unpack = source, zstandard.ZstdDecompressor()
        source.seek(size - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != _SEEKABLE:
            raise ValueError("no seek table")
        tail = 8 + 12 * count + 9
        source.seek(size - tail - 8 * count - 16)
        raw = source.read(8 * count + 16 + tail)
        self.nulls = int(np.frombuffer(raw, "<i8", 1, 8)[0])
        self.ids = np.frombuffer(raw, "<i8", count, 16)
        self.entries = np.frombuffer(raw, "<u4", 3 * count, 24 + 8 * count).reshape(count, 3)
        self.offsets = np.concatenate(([0], np.cumsum(self.entries[:, 0], dtype=np.int64)))

    def frame(self, k: int) -> np.ndarray:
        """The ids of the k-th document; raises ValueError if its checksum differs."""
        self.source.seek(int(self.offsets[k]))
        payload = self.unpack.decompress(self.source.read(int(self.entries[k, 0])), max_output_size=max(int(self.entries[k, 1]), 1))
        if xxhash.xxh64_intdigest(payload) & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"frame {k} is damaged")
        return np.frombuffer(payload, "<u4")

    def find(self, doc_id: int) -> list[int]:
        """The frames of a document: none, one, or one for each repeated row."""
        low, high = (self.nulls + int(np.searchsorted(self.ids[self.nulls :], doc_id, side)) for side in ("left", "right"))
        return list(range(low, high))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or absolute path, and the path within it."""
    return pafs.FileSystem.from_uri(path) if ":/" in path else (pafs.LocalFileSystem(), path)


def _splits_at_spaces(tokenizer) -> bool:
    """Whether the file states the normaliser and the splitting that :class:`WordMemo` relies on."""
    stated = json.loads(tokenizer.to_str())
    plain = all(t["special"] for t in stated["added_tokens"]) and not stated["truncation"] and not stated["padding"]
    return plain and stated["normalizer"] == _NORMALIZER and stated["pre_tokenizer"] == _SPLITTER and not stated["model"].get("dropout")


class WordMemo:
    """Encodes texts word by word through the tokenizers library.

    The vocabulary's own splitting never joins across white space and drops
    it, so the ids of a text are those of its pieces between spaces and line
    feeds.  Each distinct piece goes through the library once and is then
    remembered (up to a bounded number, then the memory starts anew).  Pieces
    of Latin letters and closing punctuation are split there, as the
    vocabulary splits them, and their lower-cased letters are encoded many at
    a time: a letter run is one word, and its last id alone is a word end.

    All this holds for the normaliser and the splitting of one family of
    vocabularies; a file that states any other has its texts encoded whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), {"": b""}
        self.by_word = _splits_at_spaces(self.tokenizer)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.splits = bool(self.ends.any())

    def _many(self, pieces: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

    def _runs(self, runs: list[str]) -> None:
        """Remember lower-cased letter runs, encoded many to a text."""
        groups = [runs[k : k + 256] for k in range(0, len(runs), 256)]
        for some, found in zip(groups, self.tokenizer.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False), strict=True):
            ids = np.array(found.ids, "<u4")
            cuts = (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            if len(cuts) == len(some):
                raw = ids.tobytes()
                self.known.update(zip(some, [raw[a:b] for a, b in zip([0, *cuts], cuts, strict=False)], strict=True))
            else:
                self.known.update(zip(some, self._many(some), strict=True))

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        known, plain, other = self.known, [], []
        for piece in pieces:
            core = piece.rstrip(",.!?;:")
            run = core.lower()
            if self.splits and run.isalpha() and len(run) == len(core) <= _MEMO_LONGEST and (core.isascii() or max(core) < "\u0250"):
                plain.append((piece, run, piece[len(core) :]))
            else:
                other.append(piece)
        made = dict(zip(other, self._many(other), strict=True))
        self._runs(list({run for _, run, _ in plain if run not in known}))
        tails = list({tail for _, _, tail in plain if tail not in known})
        known.update(zip(tails, self._many(tails), strict=True))
        made.update([(piece, known[run] + known[tail] if tail else known[run]) for piece, run, tail in plain])
        return made

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit."""
        if not self.by_word:
            return self._many(texts)
        if len(self.known) > _MEMO_WORDS:
            self.known = {"": b""}
        known = self.known
        words = [t.replace("\n", " ").split(" ") for t in texts]
        found = [list(map(known.get, w)) for w in words]
        gaps = [[k for k, g in enumerate(got) if g is None] for got in found]
        missing = {own[k] for own, at in zip(words, gaps, strict=True) for k in at}
        if missing:
            made = self._learn(list(missing))
            for own, got, at in zip(words, found, gaps, strict=True):
                for k in at:
                    got[k] = made[own[k]]
            known.update((w, b) for w, b in made.items() if len(w) <= _MEMO_LONGEST)
        return [b"".join(f) for f in found]


_MEMOS: dict[str, WordMemo] = {}


def _memo(path: str) -> WordMemo:
    """A worker's memory, kept from task to task."""
    if path not in _MEMOS:
        _MEMOS.clear()
        _MEMOS[path] = WordMemo(path)
    return _MEMOS[path]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode ``docs`` and write files under ``path``; the frame returned lists
    ``(part, file, documents, tokens)``.  It is lazy: files are written as it is
    evaluated, each under a name of its attempt first and then renamed, so
    a task that is run again replaces its file by an equal one.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
    ordered = slim.repartitionByRange(parts, "doc_id").sortWithinPartitions("doc_id", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part = context.partitionId()
        fs, root = file_system(path)
        name = f"{root}/ids-{part:06d}.zst"
        hidden = f"{root}/_{part:06d}-{context.taskAttemptId()}"
        memo, end = _memo(tokenizer), struct.pack("<I", end_id)
        writer, stream, tokens = None, None, 0
        for batch in batches:
            if writer is None and len(batch):
                fs.create_dir(root, recursive=True)
                stream = fs.open_output_stream(hidden)
                writer = FrameWriter(stream)
            for k in range(0, len(batch), _TEXTS):
                some = batch.slice(k, _TEXTS)
                for doc_id, ids in zip(some.column(0).to_pylist(), memo.encode(some.column(1).to_pylist()), strict=True):
                    payload = ids + end
                    tokens += len(payload) // 4
                    writer.add(doc_id, payload)
        if writer is not None:
            writer.close()
            stream.close()
            fs.move(hidden, name)
            row = [[part], [name], [len(writer.ids)], [tokens]]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(row, (pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], names=["part", "file", "documents", "tokens"])

    return ordered.mapInArrow(write, "part long, file string, documents long, tokens long")


def token_files(spark: SparkSession, path: str) -> list[str]:
    """The data files under ``path``, in order."""
    fs, root = file_system(path)
    found = fs.get_file_info(pafs.FileSelector(root, allow_not_found=True))
    return sorted(f.path for f in found if f.base_name.startswith("ids-"))


def read_token_files(spark: SparkSession, path: str, doc_ids: list[int] | None = None, with_ids: bool = True) -> DataFrame:
    """``(part, at, doc_id, n_tokens, ids_crc32[, ids binary])`` of the files under ``path``.

    With ``doc_ids`` only their frames are fetched and decompressed.  ``at`` is
    the number of ids before the document in its file.
    """
    files = token_files(spark, path)
    wanted = None if doc_ids is None else sorted(set(doc_ids))
    schema = "part long, at long, doc_id long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    listed = spark.createDataFrame([(f,) for f in files], "file string").repartition(max(len(files), 1), "file")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = file_system(path)
        names = [n for n, _ in (c.split() for c in schema.split(", "))]
        for batch in batches:
            for file in batch.column(0).to_pylist():
                part = int(file.rsplit("-", 1)[1].split(".")[0])
                with fs.open_input_file(file) as source:
                    reader = FrameReader(source, source.size())
                    before = np.concatenate(([0], np.cumsum(reader.entries[:, 1] // 4, dtype=np.int64)))
                    frames = range(len(reader.ids)) if wanted is None else [k for d in wanted for k in reader.find(d)]
                    for some in (frames[i : i + 512] for i in range(0, len(frames), 512)):
                        ids = [reader.frame(k).tobytes() for k in some]
                        doc = [None if k < reader.nulls else int(reader.ids[k]) for k in some]
                        columns = [[part] * len(ids), [int(before[k]) for k in some], doc, [len(x) // 4 for x in ids], [zlib.crc32(x) for x in ids]]
                        arrays = [pa.array(c, pa.int64()) for c in columns] + ([pa.array(ids, pa.binary())] if with_ids else [])
                        yield pa.RecordBatch.from_arrays(arrays, names=names)

    return listed.mapInArrow(read, schema)
