"""Token ids as bit-packed shard files with random access.

A shard file (little endian) is

    magic ``CGTB``, version u16, bits u16, ids a block u32
    blocks: each id in ``bits`` bits, lowest bit first; a block starts at a whole byte
    footer: u64 offset of each block; u64 lengths of the documents; their ids as an Arrow stream
    tail: u64 blocks, documents, ids and footer offset, magic

``bits`` is the least that the vocabulary needs. Any block is unpacked by numpy alone, and id ``i``
of a shard lies in block ``i // block``, so documents are read without reading what is before them.

Documents are range-partitioned by id, a shard being one partition, so shard order is id order. A
task writes to a name of its own attempt and renames at its end: a lost or repeated task leaves
one whole shard. The manifest has a row for each shard.

Defined cases: null text is empty; every document ends with ``end_id``, so an empty one has just
that; null ids come first, ties in id are ordered by the text's hash; repeated rows are written each; an empty table
gives no shard. A text is encoded whole, however long, so a task holds its ids at once; the shard takes
them a block at a time. The manifest, a row a shard, is summed up in one task. Only the id and the text are read, so
other columns may have any names. An end id that needs more bits than the vocabulary is refused.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from chronograft.storage import keep, new_path

MAGIC, VERSION, BLOCK = b"CGTB", 1, 1 << 16
END_ID = 1
#: Pieces of text in each of the two generations whose ids a Python worker remembers.
MEMORY = 800_000

_SPACED = bytes(32 if c in b"\t\n\r" else c for c in range(256))
_FOLD = bytes(c + 32 if 65 <= c <= 90 else _SPACED[c] for c in range(256))
_TAIL = b".,;:!?#*$%&|"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Ids below 2**bits, each in ``bits`` bits."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    return np.packbits(np.unpackbits(raw, axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little").tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    """The first ``n`` ids of a block as u32."""
    flat = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits, bitorder="little").reshape(n, bits)
    wide = np.zeros((n, 32), np.uint8)
    wide[:, :bits] = flat
    return np.packbits(wide, axis=1, bitorder="little").view("<u4").ravel()


class _Memory(dict):
    """Ids of pieces as bytes. Of ``MEMORY`` pieces or more, those not met since the last turn are forgotten."""

    def __init__(self, tokenizer):
        super().__init__()
        self.tokenizer, self.old = tokenizer, {}

    def __missing__(self, piece: bytes) -> bytes:
        if len(self) >= MEMORY:
            self.old = dict(self)
            self.clear()
        ids = self.old.get(piece)
        if ids is None:
            core = piece.rstrip(_TAIL)
            # the tokenizer always cuts between a letter or digit and such marks
            if core and len(core) < len(piece) and core.decode().lower()[-1].isalnum():
                ids = self[core] + self[piece[len(core) :]]
            else:
                ids = np.array(self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids, "<u4").tobytes()
        self[piece] = ids
        return ids


#: The text rules of the tokenizer files whose ids may be looked up by piece.
_NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
_WORDS = {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}


def cuts_at_spaces(tokenizer) -> bool:
    """Whether a tokenizer lowers its text and cuts it at white space, which it drops, by the rules above."""
    rules = json.loads(tokenizer.to_str())
    before = rules["pre_tokenizer"] or {}
    first = (before.get("pretokenizers") or [before])[0]
    spaced = any(any(c.isspace() for c in t["content"]) or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or not t["content"].startswith("<|") for t in rules["added_tokens"])
    return rules["normalizer"] == _NORMALIZER and (first.get("type"), first.get("pattern"), first.get("behavior"), first.get("invert")) == ("Split", _WORDS, "Removed", True) and not spaced


class Encoder:
    """Ids of whole texts by a tokenizer file: ``.json``, ``.tiktoken`` ranks or a sentencepiece ``.model``.

    Where a ``.json`` file's own rules cut at spaces anyway, texts are cut there and the ids of each piece are
    remembered; all other tokenizers get each text whole.
    """

    def __init__(self, path: str):
        self.known = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(path)
            self.tokenizer.no_truncation()
            self.tokenizer.no_padding()
            self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
            if cuts_at_spaces(self.tokenizer):
                self.known = _Memory(self.tokenizer)
            self._whole = lambda texts: [e.ids for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]
        elif path.endswith(".tiktoken"):
            import base64

            import public_tokenizers
            import tiktoken

            with open(path, "rb") as file:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in file if line.strip())}
            self.tokenizer = tiktoken.Encoding(path, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            # one more, so that an end id is left
            self.size = max(ranks.values()) + 2
            self._whole = lambda texts: [self.tokenizer.encode_ordinary(t) for t in texts]
        elif path.endswith(".model"):
            import sentencepiece

            self.tokenizer = sentencepiece.SentencePieceProcessor(model_file=path)
            self.size = self.tokenizer.vocab_size()
            self._whole = lambda texts: self.tokenizer.encode(texts, num_threads=1)
        else:
            raise ValueError(f"no tokenizer file of a known kind: {path}")

    @property
    def bits(self) -> int:
        return max(1, (self.size - 1).bit_length())

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        if self.known is None:
            return [np.array(ids, "<u4") for ids in self._whole([t or "" for t in texts])]
        ids_of = self.known.__getitem__
        out = []
        for text in texts:
            raw = (text or "").encode()
            # the tokenizer lowers A-Z itself, but not within a special token, which begins with "<|"
            pieces = raw.translate(_SPACED if b"<|" in raw else _FOLD).split(b" ")
            out.append(np.frombuffer(b"".join(map(ids_of, pieces)), "<u4"))
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str | None) -> Encoder:
    """The worker's encoder for a tokenizer file; by default the public 49k word vocabulary."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    if path not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[path] = Encoder(path)
    return _encoders[path]


class ShardWriter:
    def __init__(self, out, bits: int, block: int = BLOCK):
        self.out, self.bits, self.block = out, bits, block
        self.at = out.write(struct.pack("<4sHHI", MAGIC, VERSION, bits, block))
        self.offsets: list[int] = []
        self.lengths: list[int] = []
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0

    def add(self, ids: np.ndarray) -> None:
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            whole = np.concatenate(self.held)
            cut = len(whole) - len(whole) % self.block
            for s in range(0, cut, self.block):
                self._put(whole[s : s + self.block])
            self.held, self.n_held = [whole[cut:]], len(whole) - cut

    def _put(self, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        data = pack(ids, self.bits)
        self.out.write(data)
        self.at += len(data)
        self.n += len(ids)

    def close(self, names: pa.ChunkedArray) -> None:
        if self.n_held:
            self._put(np.concatenate(self.held))
        foot = np.array(self.offsets, "<u8").tobytes() + np.array(self.lengths, "<u8").tobytes()
        sink = pa.BufferOutputStream()
        table = pa.table({"id": names})
        with pa.ipc.new_stream(sink, table.schema) as stream:
            stream.write_table(table)
        self.out.write(foot + sink.getvalue().to_pybytes())
        self.out.write(struct.pack("<QQQQ4s", len(self.offsets), len(self.lengths), self.n, self.at, MAGIC))


class ShardReader:
    """Random access to one shard."""

    def __init__(self, file):
        self.file = file
        magic, version, self.bits, self.block = struct.unpack("<4sHHI", file.read_at(12, 0))
        size = file.size()
        self.n_blocks, self.n_docs, self.n, foot, tail = struct.unpack("<QQQQ4s", file.read_at(36, size - 36))
        if magic != MAGIC or tail != MAGIC or version != VERSION:
            raise ValueError("not a whole token shard")
        raw = file.read_at(size - 36 - foot, foot)
        self.offsets = np.append(np.frombuffer(raw, "<u8", self.n_blocks), foot).astype(np.int64)
        lengths = np.frombuffer(raw, "<u8", self.n_docs, 8 * self.n_blocks)
        self.starts = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        self.names = pa.ipc.open_stream(raw[8 * (self.n_blocks + self.n_docs) :]).read_all().column("id")
        self._last = (-1, np.zeros(0, "<u4"))

    def _block(self, b: int) -> np.ndarray:
        if self._last[0] != b:
            n = min(self.block, self.n - b * self.block)
            at = int(self.offsets[b])
            self._last = (b, unpack(self.file.read_at(int(self.offsets[b + 1]) - at, at), self.bits, n))
        return self._last[1]

    def ids(self, lo: int, hi: int) -> np.ndarray:
        """Ids lo to hi (exclusive) of the shard."""
        parts = [self._block(b)[max(0, lo - b * self.block) : hi - b * self.block] for b in range(lo // self.block, -(-hi // self.block))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def document(self, d: int) -> np.ndarray:
        return self.ids(int(self.starts[d]), int(self.starts[d + 1]))


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _write(folder: str, path: str | None, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        store, base = _open(folder)
        store.create_dir(base, recursive=True)
        enc, end = encoder(path), np.array([end_id], "<u4")
        if end_id >> enc.bits:
            raise ValueError(f"end id {end_id} does not fit {enc.bits} bits")
        name, draft = f"{base}/shard-{task.partitionId():06d}.cgtb", f"{base}/.draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        writer, names = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                out = store.open_output_stream(draft)
                writer = ShardWriter(out, enc.bits)
            names.append(batch.column(0))
            for at in range(0, batch.num_rows, 500):
                for ids in enc.encode(batch.column(1)[at : at + 500].to_pylist()):
                    writer.add(np.concatenate((ids, end)))
        if writer is None:
            return
        writer.close(pa.chunked_array(names))
        out.close()
        store.move(draft, name)
        row = [task.partitionId()], [f"{folder}/shard-{task.partitionId():06d}.cgtb"], [len(writer.lengths)], [writer.n]
        yield pa.RecordBatch.from_arrays(
            [pa.array(row[0], pa.int64()), pa.array(row[1]), pa.array(row[2], pa.int64()), pa.array(row[3], pa.int64())],
            names=["shard", "path", "n_docs", "n_ids"])

    return run


def write_tokens(docs: DataFrame, folder: str | None = None, tokenizer_path: str | None = None, end_id: int = END_ID,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Writes all documents in ascending id order; returns the manifest (shard, path, n_docs, n_ids, start)."""
    folder = folder or new_path(docs.sparkSession, "tokens")
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.cast("string").alias("text"), F.xxhash64(text).alias("h"))
    rows = rows.repartitionByRange("id", "h").sortWithinPartitions("id", "h").select("id", "text")
    made = rows.mapInArrow(_write(folder, tokenizer_path, end_id), "shard long, path string, n_docs long, n_ids long")
    made = keep(made, "token-manifest")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return made.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame, id_type: str = "long", value: Callable[[np.ndarray], object] | None = None,
                value_type: str = "array<long>") -> DataFrame:
    """(id, start, n_tokens, value) of each document, read back from the shards.

    ``value`` maps a document's ids to what is returned; by default the ids themselves.
    """
    kinds = {"long": pa.int64(), "array<long>": pa.list_(pa.int64())}
    of = value or (lambda ids: ids.astype(np.int64))
    kind = kinds[value_type]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, _ = _open(path.rsplit("/", 1)[0])
                with store.open_input_file(_open(path)[1]) as file:
                    shard = ShardReader(file)
                    for lo in range(0, shard.n_docs, 1000):
                        hi = min(shard.n_docs, lo + 1000)
                        yield pa.RecordBatch.from_arrays(
                            [shard.names.slice(lo, hi - lo).combine_chunks(), pa.array(start + shard.starts[lo:hi]),
                             pa.array(np.diff(shard.starts[lo : hi + 1])), pa.array([of(shard.document(d)) for d in range(lo, hi)], kind)],
                            names=["id", "start", "n_tokens", "value"])

    shards = manifest.select("path", "start")
    n = max(1, shards.count())
    return shards.repartition(n, "path").mapInArrow(run, f"id {id_type}, start long, n_tokens long, value {value_type}")
