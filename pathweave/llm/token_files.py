"""Token-id files with Elias-Fano document boundaries.

A token table is a Parquet folder of blocks in ascending document order.  A block holds about BLOCK ids: the
concatenated id array (16 bits an id where the vocabulary allows it) and two Elias-Fano sequences, the
documents' ends in that array and the document ids.  Elias-Fano keeps n ascending numbers below u in about
n * (2 + log2(u / n)) bits and returns any of them by a select on its high bits; every 64th one-bit's place
is kept as a 32-bit sample, so there is no 64-bit offset table.  Columns beside the payload (shard, block, counts)
give the starts of blocks without reading any ids.

Spark's own writer commits the blocks, so a lost executor or a repeated task leaves no half file, and the folder
can be in any store that Spark reaches.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pathweave.llm.bpe import _CLEAN, UnitEncoder, byte_characters
from pathweave.llm.shared import attach

BLOCK = 1 << 18  # ids after which a block ends
SAMPLE = 64
RECENT = 1 << 19  # pieces of a generation that a worker remembers, and half as many units that are not cut into pieces
SLICE, SLICE_BYTES = 1024, 1 << 22  # rows and bytes of text that are encoded side by side
# units of printable ASCII and Latin letters, with single line ends between them and no apostrophe: the splitting pattern cuts them
# where the kind of characters changes, and the space before a unit goes with what follows it (for Arrow)
_LATIN = "\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
_PLAIN = rf"\A[!-&(-~{_LATIN}]+(?:\n[!-&(-~{_LATIN}]+)*\z"
_PIECE = rf" ?[A-Za-z{_LATIN}]+| ?[0-9]+| ?[!-/:-@\[-`{{-~]+|\n"
# two white-space characters in a row, as Python knows them, for Arrow
_SPACES = "[\t-\r\x1c- \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{2}"
JOINED = 256  # new units that the library reads as one text
MAGIC = b"EFTOK001"
_SCHEMA = "shard int, block int, first_id long, n_docs long, n_tokens long, payload binary"


class EliasFano:
    """Ascending non-negative integers in near-minimal space, with select."""

    def __init__(self, n: int, low_bits: int, lows: bytes, highs: bytes, samples: bytes):
        self.n, self.low_bits, self.lows, self.highs, self.samples = n, low_bits, lows, highs, samples

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        if not n:
            return cls(0, 0, b"", b"", b"")
        bits = max(0, int((int(values[-1]) + 1) // n).bit_length() - 1)
        lows = b""
        if bits:
            low = values & np.uint64((1 << bits) - 1)
            lows = np.packbits(((low[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel(), bitorder="little").tobytes()
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(int(ones[-1]) + 1, np.uint8)
        high[ones] = 1
        return cls(n, bits, lows, np.packbits(high, bitorder="little").tobytes(), ones[::SAMPLE].astype("<u4").tobytes())

    def __getitem__(self, i: int) -> int:
        """select: from the sample before it, over the high bits to the i-th one-bit."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at = int(np.frombuffer(self.samples, "<u4")[i // SAMPLE])
        left = i % SAMPLE
        first, high = at // 8, np.frombuffer(self.highs, np.uint8)
        step = 32
        while True:
            bits = np.unpackbits(high[first : first + step], bitorder="little")
            ones = np.flatnonzero(bits) + first * 8
            ones = ones[ones >= at]
            if len(ones) > left:
                break
            step *= 2
        value = (int(ones[left]) - i) << self.low_bits
        if self.low_bits:
            start = i * self.low_bits
            part = int.from_bytes(self.lows[start // 8 : (start + self.low_bits + 7) // 8], "little")
            value |= (part >> (start % 8)) & ((1 << self.low_bits) - 1)
        return value

    def all(self) -> np.ndarray:
        if not self.n:
            return np.zeros(0, np.int64)
        ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.highs, np.uint8), bitorder="little"))[: self.n]
        out = (ones - np.arange(self.n)) << self.low_bits
        if self.low_bits:
            bits = np.unpackbits(np.frombuffer(self.lows, np.uint8), bitorder="little")[: self.n * self.low_bits]
            out += bits.reshape(self.n, self.low_bits).astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out

    def to_bytes(self) -> bytes:
        return struct.pack("<5q", self.n, self.low_bits, len(self.lows), len(self.highs), len(self.samples)) + self.lows + self.highs + self.samples

    @classmethod
    def read(cls, data: bytes, at: int) -> tuple[EliasFano, int]:
        n, bits, *sizes = struct.unpack_from("<5q", data, at)
        at += 40
        parts = []
        for s in sizes:
            parts.append(data[at : at + s])
            at += s
        return cls(n, bits, *parts), at


class Block:
    """A block's documents: id, start and ids of each, found by select."""

    def __init__(self, payload: bytes):
        magic, self.width, self.nulls, self.base = struct.unpack_from("<8s3q", payload, 0)
        if magic != MAGIC:
            raise ValueError("not a token block")
        self.ends, at = EliasFano.read(payload, 32)
        self.doc_ids, at = EliasFano.read(payload, at)
        self.ids = np.frombuffer(payload, f"<u{self.width}", offset=at)

    @staticmethod
    def pack(doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> bytes:
        known = np.array([x for x in doc_ids if x is not None], np.int64)
        base = int(known[0]) if len(known) else 0
        ends = EliasFano.of(np.cumsum([len(x) for x in ids]))
        head = struct.pack("<8s3q", MAGIC, width, len(doc_ids) - len(known), base)
        body = np.concatenate(ids).astype(f"<u{width}").tobytes()
        return head + ends.to_bytes() + EliasFano.of(known - base).to_bytes() + body

    def __len__(self) -> int:
        return self.ends.n

    def span(self, i: int) -> tuple[int, int]:
        return (self.ends[i - 1] if i else 0), self.ends[i]

    def document(self, i: int) -> np.ndarray:
        start, end = self.span(i)
        return self.ids[start:end]

    def doc_id(self, i: int) -> int | None:
        return None if i < self.nulls else self.base + self.doc_ids[i - self.nulls]


class RecentUnits(UnitEncoder):
    """A unit encoder that forgets only units that were not met for a while.

    New units gather in one generation; when that is full it becomes the older one, whose units move up when they are met again.
    """

    def __init__(self, encode_all, size: int):
        super().__init__(encode_all, size)
        self.older: dict[str, bytes] = {}

    def _learn(self, known: dict[str, bytes], lead: str, units: set[str]) -> None:
        if known is not self.rest:
            return super()._learn(known, lead, units)
        if len(known) > self.size:
            self.older, self.rest = known, {}
            known = self.rest
        new = units.difference(known)
        older = self.older
        known.update([(x, older[x]) for x in new if x in older])
        new = [x for x in new if x not in older]
        known.update(zip(new, self.encode_all([lead + x for x in new]), strict=True))

    def ids_of(self, units: list[str], lead: str) -> list[bytes]:
        self._learn(self.rest, lead, set(units))
        return list(map(self.rest.__getitem__, units))


def _strings(of: pa.Array) -> list[str]:
    return of.to_numpy(zero_copy_only=False).tolist()


def _flags(of: pa.Array) -> np.ndarray:
    return of.to_numpy(zero_copy_only=False)


def _gather(ids: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """Of parts of ``ids`` that follow each other, those of ``which``, one after the other."""
    starts, out = np.cumsum(sizes) - sizes, [ids[:0]]
    for lo in range(0, len(which), 1 << 20):
        part = which[lo : lo + (1 << 20)]
        n = sizes[part]
        at = np.repeat(starts[part] - np.cumsum(n) + n, n)
        at += np.arange(len(at))
        out.append(ids[at])
    return np.concatenate(out)


def _parts(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(found), "<u4"), np.fromiter(map(len, found), np.int64, len(found)) // 4


_encoders: dict[str, Callable[[pa.Array | list[str | None]], list[np.ndarray]]] = {}


def _encoder(path: str, text: str):
    """Encode texts with the tokenizers library, unit by unit, so that a unit met again is not encoded again.

    Arrow cuts a slice's texts into distinct units and these into distinct pieces; only pieces that the worker does not remember are
    read by the model.  Ids of pieces are put together to units, and those to texts, by place.
    """
    if path not in _encoders:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import WhitespaceSplit

        tokenizer = Tokenizer.from_str(text)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        model = tokenizer.model
        # a byte-level pattern without anything else around it, so that a word of letters is one piece
        kind = json.loads(tokenizer.to_str())
        plain = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        by_model = kind["normalizer"] is None and kind["pre_tokenizer"] == plain and kind["post_processor"] in (None, plain)
        special = [t.content for t in tokenizer.get_added_tokens_decoder().values()]
        # the same model over pieces that are already cut and spelled in the vocabulary's characters
        spelled = Tokenizer(model)
        spelled.pre_tokenizer = WhitespaceSplit()
        spelling = {b: c for c, b in byte_characters().items()} | {ord(" "): " \u0120"}  # the space goes with the piece after it

        vocabulary = tokenizer.get_vocab()
        begins = np.zeros(max(vocabulary.values(), default=0) + 1, bool)
        begins[[i for t, i in vocabulary.items() if t.startswith("\u0120")]] = True  # how the vocabulary writes a space

        def each(units: list[str]) -> list[bytes]:
            return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch_fast(units, add_special_tokens=False)]

        def cut(ids: np.ndarray, n: int) -> list[bytes] | None:
            """The ids of n units with one space, at the front: their first ids are those that begin with a space."""
            at = np.flatnonzero(begins[ids])
            if len(at) != n:  # a vocabulary that does not split before every space
                return None
            data, ends = ids.tobytes(), [*(4 * at).tolist(), 4 * len(ids)]
            return [data[x:y] for x, y in zip(ends[:-1], ends[1:], strict=True)]

        def joined(read: Tokenizer, groups: list[str]) -> np.ndarray:
            found = [e.ids for e in read.encode_batch_fast(groups, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(found), "<u4", sum(map(len, found)))

        def running_text(units: list[str]) -> list[bytes]:
            found = cut(joined(tokenizer, ["".join(units[k : k + JOINED]) for k in range(0, len(units), JOINED)]), len(units))
            return each(units) if found is None else found

        def spell(x: str) -> str:
            return x.replace(" ", " \u0120") if x.isascii() else x.encode().decode("latin-1").translate(spelling)

        def piece(x: str) -> bytes:
            """Ids of a piece that the pattern does not split: the model reads it without a text around it."""
            return array("I", [t.id for t in model.tokenize(x.encode().decode("latin-1").translate(spelling).strip(" "))]).tobytes()

        def read_pieces(new: list[str]) -> list[bytes]:
            spaced = sorted([x for x in new if len(x) > 1 and x[0] == " "], key=str.isascii)
            found = cut(joined(spelled, [spell("".join(spaced[k : k + JOINED])) for k in range(0, len(spaced), JOINED)]), len(spaced))
            known = {} if found is None else dict(zip(spaced, found, strict=True))
            return [known[x] if x in known else piece(x) for x in new]

        def read_units(new: list[str]) -> list[bytes]:
            """Units with one space, at the front, as running text, the rest each for itself."""
            running = [x for x in new if x[:1] == " " and len(x) > 1 and not x[-1].isspace() and x.find(" ", 1) < 0]
            known = dict(zip(running, running_text(running), strict=True))
            rest = [x for x in new if x not in known]
            known.update(zip(rest, each(rest), strict=True))
            return [known[x] for x in new]

        pieces, units = RecentUnits(read_pieces, RECENT), RecentUnits(read_units, RECENT // 2)

        def by_pieces(plain: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            """Ids of plain units after a space, one after the other, and how many each has."""
            cuts = pc.split_pattern(pc.replace_substring_regex(pc.binary_join_element_wise(" ", plain, ""), _PIECE, "\t\\0"), "\t")
            coded = cuts.flatten().dictionary_encode()
            ids, sizes = _parts(pieces.ids_of(_strings(coded.dictionary), ""))
            which = coded.indices.to_numpy()
            ends = np.cumsum(sizes[which])[cuts.offsets.to_numpy()[1:] - 1]
            return _gather(ids, sizes, which), np.diff(ends, prepend=0)

        def encode(texts: pa.Array | list[str | None]) -> list[np.ndarray]:
            texts = pc.fill_null(pa.array(texts, pa.string()) if isinstance(texts, list) else texts.cast(pa.string()), "")
            whole = np.zeros(len(texts), bool)  # texts with special tokens
            for x in special:
                whole |= _flags(pc.match_substring(texts, x))
            spaces = _flags(pc.match_substring_regex(texts, _SPACES)) & ~whole
            clean, spaces, whole = (np.flatnonzero(x) for x in (~(whole | spaces), spaces, whole))
            # the units of all texts, one after the other
            split = pc.split_pattern(texts if len(clean) == len(texts) else texts.take(pa.array(clean)), " ")
            others = [_CLEAN.split(x) for x in _strings(texts.take(pa.array(spaces)))]
            n_units = np.concatenate([pc.list_value_length(split).to_numpy(), np.array([len(x) for x in others], np.int64)]).astype(np.int64)
            coded = pa.concat_arrays([split.flatten(), pa.array(list(chain.from_iterable(others)), pa.string())]).dictionary_encode()
            words, which, last = coded.dictionary, coded.indices.to_numpy().astype(np.int64), np.cumsum(n_units)
            # a text's first unit has no space before it
            first = last - n_units
            begin = _strings(words.take(pa.array(which[first])))
            which[first] = len(words) + np.arange(len(first))
            after = np.bincount(which, minlength=len(words))[: len(words)] > 0
            plain = _flags(pc.match_substring_regex(words, _PLAIN)) & after & by_model
            rest = after & ~plain
            found = by_pieces(words.filter(pa.array(plain))), _parts(units.ids_of(_strings(words.filter(pa.array(rest))), " ")), _parts(each(begin))
            ids, sizes = zip(*found, strict=True)
            place = np.empty(len(words) + len(first), np.int64)
            place[np.concatenate([np.flatnonzero(plain), np.flatnonzero(rest), len(words) + np.arange(len(first))])] = np.arange(sum(map(len, sizes)))
            sizes, which = np.concatenate(sizes), place[which]
            ids, ends = _gather(np.concatenate(ids), sizes, which), np.cumsum(sizes[which])[last - 1].tolist()
            done: list[np.ndarray] = [ids[:0]] * len(texts)
            for i, x, y in zip(chain(clean.tolist(), spaces.tolist()), [0, *ends][:-1], ends, strict=True):
                done[i] = ids[x:y]
            for i, x in zip(whole.tolist(), each(_strings(texts.take(pa.array(whole)))), strict=True):
                done[i] = np.frombuffer(x, "<u4")
            return done

        _encoders[path] = encode
    return _encoders[path]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The rows of a batch, at most SLICE and, but for a single row, about SLICE_BYTES of text at a time."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < batch.num_rows:
        most = (size[lo - 1] if lo else 0) + SLICE_BYTES
        hi = max(lo + 1, min(lo + SLICE, int(np.searchsorted(size, most, "right"))))
        yield batch.slice(lo, hi - lo)
        lo = hi


def write_tokens(docs: DataFrame, to: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write every whole text's ids, each followed by ``end_id``, to the folder ``to`` in ascending order of ids.

    ``tokenizer`` is a byte-level BPE file.  Null texts are empty: just the end id.  Rows with a null document id come
    first; rows that repeat an id follow each other in order of their texts.  An empty table writes no block.
    """
    with open(tokenizer, encoding="utf-8") as f:
        text = f.read()
    known = json.loads(text)
    largest = max([end_id, *known["model"]["vocab"].values(), *[t["id"] for t in known.get("added_tokens", [])]])
    width = 2 if largest < 65536 else 4
    shared = attach(docs).sparkContext.broadcast(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, shared.value)
        shard, block, doc_ids, ids, size = TaskContext.get().partitionId(), 0, [], [], 0
        end = np.array([end_id], "<u4")

        def send() -> pa.RecordBatch:
            row = (shard, block, doc_ids[0], len(doc_ids), size, Block.pack(doc_ids, ids, width))
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names=["shard", "block", "first_id", "n_docs", "n_tokens", "payload"])

        for batch in batches:
            for part in _slices(batch):
                for i, x in zip(part.column(0).to_pylist(), encode(part.column(1)), strict=True):
                    doc_ids.append(i)
                    ids.append(np.concatenate([x, end]))
                    size += len(x) + 1
                    if size >= BLOCK:
                        yield send()
                        block, doc_ids, ids, size = block + 1, [], [], 0
        if doc_ids:
            yield send()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    ordered = rows.repartitionByRange(F.col("id").asc_nulls_first()).sortWithinPartitions(F.col("id").asc_nulls_first(), "text")
    ordered.mapInArrow(run, _SCHEMA).write.mode("errorifexists").option("compression", "zstd").parquet(to)


def read_tokens(spark: SparkSession, at: str, id_col: str = "doc_id", with_ids: bool = True) -> DataFrame:
    """From the files: id, start (ids of all documents before), n_tokens (with the end id), ids_crc32 and (``with_ids``)
    ids (little-endian, as wide as in the files) of each document."""
    blocks = spark.read.schema(_SCHEMA).parquet(at)
    attach(blocks)
    names = ["shard", "block", id_col, "within", "n_tokens", "ids_crc32", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, number, payload in zip(*(batch.column(i) for i in range(3)), strict=True):
                block = Block(payload.as_py())
                ends = block.ends.all()
                starts = np.concatenate([[0], ends[:-1]])
                wide = block.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(starts, ends, strict=True)]
                n, known = len(block), block.doc_ids.all() + block.base
                columns = [
                    pa.array([shard.as_py()] * n, pa.int32()),
                    pa.array([number.as_py()] * n, pa.int32()),
                    pa.array([None] * block.nulls + known.tolist(), pa.int64()),
                    pa.array(starts, pa.int64()),
                    pa.array(ends - starts, pa.int64()),
                    pa.array(crc, pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.array([block.ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)], pa.binary()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    found = blocks.select("shard", "block", "payload").mapInArrow(
        run, f"shard int, block int, `{id_col}` long, within long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    )
    # starts of shards (one row each), then of the blocks within each shard
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("tokens"))
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("tokens").over(before), F.lit(0)).alias("shard_start"))
    inside = W.partitionBy("shard").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    starts = blocks.select("shard", "block", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)).alias("block_start")).join(shards, "shard")
    return found.join(starts, ["shard", "block"]).select(id_col, (F.col("shard_start") + F.col("block_start") + F.col("within")).alias("start"), *names[4:])
