"""Byte-level BPE as a streaming transducer with bounded lookahead, and its decoder.

A text is fed in chunks and ids come out as soon as nothing that follows can change them:

* The splitting pattern never joins words over a single space between two characters that are not
  white space, so everything before such a space is final.  What lies between two of them (a *unit*) is
  encoded once and kept in a bounded cache.
* Inside one very long pretoken the merge list itself bounds how far a decision can depend on
  what follows.  Whether rule r may merge at a place depends on the bytes of its right part and on
  whether a rule of smaller rank takes the end of that part away first, which again depends on the bytes
  of that rule's right part, and so on with ever smaller ranks.  ``sufficient_lookahead`` is the longest
  such chain.  A token that ends at least so many bytes before what is known is final, and BPE
  of the rest starts afresh there.

So memory beyond the text's own cell is a chunk, the lookahead and the cache.  Decoding walks the bytes
of the ids through an incremental UTF-8 machine that holds at most three bytes.
"""

from __future__ import annotations

import codecs
import heapq
import json
import re
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pathweave.llm.shared import attach, tidy

# Fixed value: how the public byte-level vocabulary splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_PRETOKEN = regex.compile(PATTERN)
_KINDS = tuple(regex.compile(x) for x in (r"\p{L}+", r"\p{N}+", r"[^\s\p{L}\p{N}]+", r"\s+"))
_DIRTY = re.compile(r"\s\s")
_CLEAN = regex.compile(r"(?<=[^\s\x1c-\x1f]) (?=[^\s\x1c-\x1f])")
CHUNK = 1 << 16
CACHE = 1 << 16  # units that a task keeps


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte: itself where it is printable, else the next one from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


class Vocabulary:
    def __init__(self, text: str):
        data = json.loads(text)
        model, of = data["model"], byte_characters()
        self.special = {t["content"]: t["id"] for t in data["added_tokens"]}
        self.bytes: dict[int, bytes] = {i: bytes(of[c] for c in t) for t, i in model["vocab"].items() if all(c in of for c in t)}
        self.bytes |= {i: t.encode() for t, i in self.special.items()}
        self.byte_id = [0] * 256
        for c, b in of.items():
            self.byte_id[b] = model["vocab"][c]
        pairs = [(m.split(" ") if isinstance(m, str) else m) for m in model["merges"]]
        self.rules = [(model["vocab"][a], model["vocab"][b], model["vocab"][a + b]) for a, b in pairs]
        self.rank = {(a, b): (r, c) for r, (a, b, c) in enumerate(self.rules)}

    def merge(self, data: bytes) -> list[int]:
        """BPE of one pretoken: the rule of least rank first, the leftmost place first."""
        ids = [self.byte_id[b] for b in data]
        rank = self.rank
        if len(ids) > 48:
            return self._merge_long(ids)
        while len(ids) > 1:
            best = min((rank[p] for p in zip(ids, ids[1:], strict=False) if p in rank), default=None)
            if best is None:
                break
            a, b, c = self.rules[best[0]]
            out, i, n = [], 0, len(ids)
            while i < n:
                if ids[i] == a and i + 1 < n and ids[i + 1] == b:
                    out.append(c)
                    i += 2
                else:
                    out.append(ids[i])
                    i += 1
            ids = out
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same with a heap of places: n log n."""
        n, rank = len(ids), self.rank
        after, before, alive = [*range(1, n + 1)], [*range(-1, n - 1)], [True] * n
        heap = [(rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in rank]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or (ids[i], ids[j]) != self.rules[r][:2]:
                continue
            ids[i], alive[j], after[i] = self.rules[r][2], False, after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (found := rank.get((ids[x], ids[y]))):
                    heapq.heappush(heap, (found[0], x))
        return [t for t, a in zip(ids, alive, strict=True) if a]

    def _table(self) -> tuple[np.ndarray, np.ndarray]:
        """An open-addressing table from pairs of ids to ranks, and the id that each rank makes."""
        if not hasattr(self, "_pairs"):
            size = 1 << 18
            while size < 4 * len(self.rules):
                size *= 2
            keys, ranks = np.full(size, -1, np.int64), np.zeros(size, np.int32)
            for r, (a, b, _) in reversed(list(enumerate(self.rules))):
                k = (a << 32) | b
                at = self._home(k, size)
                while keys[at] not in (-1, k):
                    at = (at + 1) & (size - 1)
                keys[at], ranks[at] = k, r
            self._pairs = keys, ranks, np.array([c for _, _, c in self.rules] + [0], np.int32)
        return self._pairs

    @staticmethod
    def _home(k, size: int):
        return ((k >> 32) * 40503 + (k & 0xFFFFFFFF) * 2654435) % 4294967291 & (size - 1)

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, ranks, made = self._table()
        none, k = np.int32(len(self.rules)), (left.astype(np.int64) << 32) | right
        at = self._home(k, len(keys))
        found = keys[at]
        out = np.where(found == k, ranks[at], none)
        look = np.flatnonzero((found != k) & (found != -1))
        while len(look):
            at[look] = (at[look] + 1) & (len(keys) - 1)
            found = keys[at[look]]
            hit = found == k[look]
            out[look[hit]] = ranks[at[look[hit]]]
            look = look[~hit & (found != -1)]
        return out

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many pretokens as bytes, merged side by side in numpy: in each round every
        pretoken applies its rule of least rank."""
        out: list[bytes] = [b""] * len(pieces)
        short = []
        for i, x in enumerate(pieces):
            if len(x) > 64:
                out[i] = np.array(self.merge(x), "<u4").tobytes()
            elif x:
                short.append(i)
        if not short:
            return out
        _, _, made = self._table()
        none = len(self.rules)
        lengths = np.array([len(pieces[i]) for i in short])
        ids = np.array(self.byte_id, np.int32)[np.frombuffer(b"".join(pieces[i] for i in short), np.uint8)]
        piece = np.repeat(np.arange(len(short)), lengths)
        done_ids, done_pieces = [], []
        while len(ids):
            ranks = np.full(len(ids), none, np.int32)
            if len(ids) > 1:
                same = piece[1:] == piece[:-1]
                ranks[:-1][same] = self._ranks(ids[:-1][same], ids[1:][same])
            starts = np.flatnonzero(np.concatenate([[True], piece[1:] != piece[:-1]]))
            counts = np.diff(np.append(starts, len(ids)))
            least = np.repeat(np.minimum.reduceat(ranks, starts), counts)
            end = least == none
            if end.any():
                done_ids.append(ids[end])
                done_pieces.append(piece[end])
                ids, piece, ranks, least = ids[~end], piece[~end], ranks[~end], least[~end]
            take = ranks == least
            take[1:] &= ~take[:-1]  # of overlapping places the left one; the others come in the next round
            at = np.flatnonzero(take)
            ids[at] = made[ranks[at]]
            keep = np.ones(len(ids), bool)
            keep[at + 1] = False
            ids, piece = ids[keep], piece[keep]
        ids, piece = np.concatenate(done_ids), np.concatenate(done_pieces)
        order = np.argsort(piece, kind="stable")
        data = ids[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(piece, minlength=len(short))) * 4
        at = 0
        for i, end in zip(short, ends.tolist(), strict=True):
            out[i] = data[at:end]
            at = end
        return out

    def sufficient_lookahead(self) -> int:
        """Bytes after a token that decide whether its end stays; see the module's text."""
        made = {c: (r, b) for r, (_, b, c) in reversed(list(enumerate(self.rules)))}
        length = {i: len(b) for i, b in self.bytes.items()}
        by_left: dict[int, tuple[list[int], list[int]]] = {}  # ranks of a left part's rules, longest chain so far
        longest = 0
        for r, (a, b, _) in enumerate(self.rules):
            part, bound, beyond = b, r, 0
            while part is not None:  # every piece that is b's end at some time before r
                if part in by_left:
                    ranks, chains = by_left[part]
                    if k := bisect_left(ranks, bound):
                        beyond = max(beyond, chains[k - 1])
                made_at, right = made.get(part, (0, None))
                part, bound = right, min(bound, made_at)
            chain = length[b] + beyond
            ranks, chains = by_left.setdefault(a, ([], []))
            ranks.append(r)
            chains.append(max(chain, chains[-1] if chains else 0))
            longest = max(longest, chain)
        return longest


class UnitEncoder:
    """Encode texts unit by unit; ``encode_all`` turns a list of units into the bytes of their ids."""

    def __init__(self, encode_all, size: int | None = None):
        self.encode_all, self.size = encode_all, size or CACHE
        self.first: dict[str, bytes] = {}
        self.rest: dict[str, bytes] = {}  # of units after a space, which the key leaves out

    def _learn(self, known: dict[str, bytes], lead: str, units: set[str]) -> None:
        if len(known) > self.size:
            known.clear()
        new = list(units.difference(known))
        known.update(zip(new, self.encode_all([lead + x for x in new] if lead else new), strict=True))

    def forget(self) -> None:
        self.first.clear()
        self.rest.clear()

    def __call__(self, texts: list[str]) -> list[bytes]:
        split = [x.split(" ") if not _DIRTY.search(x) else _CLEAN.split(x) for x in texts]
        self._learn(self.first, "", {parts[0] for parts in split})
        self._learn(self.rest, " ", set().union(*(parts[1:] for parts in split)))
        get = self.rest.__getitem__
        return [self.first[parts[0]] + b"".join(map(get, parts[1:])) for parts in split]


class Transducer:
    """feed() chunks of one text, then finish(); each returns the ids that are now certain, as bytes."""

    def __init__(self, vocabulary: Vocabulary, lookahead: int, chunk: int = CHUNK):
        self.vocabulary, self.lookahead, self.chunk = vocabulary, lookahead, chunk
        self.units = UnitEncoder(self._encode_all)
        self.pieces: dict[str, bytes] = {}
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None
        self.margin = max([4, *map(len, special)])
        self.pending, self.run, self.tail = "", None, b""

    def _ids(self, ids: list[int]) -> bytes:
        return np.array(ids, "<u4").tobytes()

    def _encode_all(self, units: list[str]) -> list[bytes]:
        split = [_PRETOKEN.findall(x) if not (x.isascii() and (x.isalpha() or x[1:].isalpha() and x[0] == " ")) else [x] for x in units]
        known = self.pieces
        if len(known) > CACHE:
            known.clear()
        new = list(set().union(*split).difference(known)) if split else []
        known.update(zip(new, self.vocabulary.merge_all([x.encode() for x in new]), strict=True))
        return [known[x[0]] if len(x) == 1 else b"".join(map(known.__getitem__, x)) for x in split]

    def _text(self, text: str) -> bytes:
        """A stretch that nothing around it changes."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return self.units([text])[0] if text else b""
        parts = self.special.split(text)
        return b"".join(self._ids([self.vocabulary.special[x]]) if i % 2 else (self.units([x])[0] if x else b"") for i, x in enumerate(parts))

    def _stable(self, more: bytes) -> bytes:
        """Go on with a pretoken that has not ended: its ids that no longer can change."""
        self.tail += more
        if len(self.tail) <= self.lookahead + self.chunk:
            return b""
        ids, end, out = self.vocabulary.merge(self.tail), 0, []
        for i in ids:
            if end + len(self.vocabulary.bytes[i]) + self.lookahead > len(self.tail):
                break
            end += len(self.vocabulary.bytes[i])
            out.append(i)
        self.tail = self.tail[end:]
        return self._ids(out)

    def _go_on(self, final: bool) -> bytes:
        """Take what belongs to the run from the pending text."""
        known = len(self.pending) if final else max(0, len(self.pending) - self.margin)
        found = self.run.match(self.pending)
        end = found.end() if found else 0
        if self.special and (s := self.special.search(self.pending)) and s.start() < end:
            end = s.start()
            ended = True
        else:
            ended = final or end < known
        if not ended:
            end = min(end, known)
        elif self.run is _KINDS[3] and 0 < end < len(self.pending) and not (self.special and self.special.match(self.pending, end)):
            end -= 1  # the last white space before a word is the word's
        out = self._stable(self.pending[:end].encode())
        self.pending = self.pending[end:]
        if ended:
            out += self._ids(self.vocabulary.merge(self.tail))
            self.run, self.tail = None, b""
        return out

    def _long(self) -> bytes:
        """Pretokens of a long pending text without a clean space; may begin a run."""
        known, at, out = len(self.pending) - self.margin, 0, []
        if self.special and (s := self.special.search(self.pending)):
            out.append(self._text(self.pending[: s.end()]))
            self.pending = self.pending[s.end() :]
            return out[0]
        for m in _PRETOKEN.finditer(self.pending):
            if m.end() > known:
                if m.end() - m.start() > self.chunk // 2:
                    kind = next(k for k in reversed(_KINDS) if k.match(self.pending, m.start() + 1))
                    out.append(self._stable(self.pending[m.start() : m.start() + 1].encode()))
                    self.run, at = kind, m.start() + 1
                break
            out.append(self._ids(self.vocabulary.merge(m.group().encode())))
            at = m.end()
        self.pending = self.pending[at:]
        return b"".join(out)

    def feed(self, text: str) -> bytes:
        self.pending += text
        out = b""
        if self.run is not None:
            out = self._go_on(False)
            if self.run is not None:
                return out
        cut = len(self.pending) - self.margin
        while (cut := self.pending.rfind(" ", 0, max(cut, 0))) > 0:
            if not _DIRTY.search(self.pending[cut - 1 : cut + 2]) and self.pending[cut + 1 : cut + 2]:
                out += self._text(self.pending[:cut])
                self.pending = self.pending[cut:]
                break
        while self.run is None and len(self.pending) > self.chunk:
            before = len(self.pending)
            out += self._long()
            if len(self.pending) == before:
                break
        return out

    def finish(self) -> bytes:
        out = b""
        if self.run is not None:
            out = self._go_on(True)
        out += self._text(self.pending)
        self.pending = ""
        return out

    def encode(self, text: str) -> bytes:
        if len(text) <= self.chunk:
            return self._text(text)
        return b"".join(self.feed(text[i : i + self.chunk]) for i in range(0, len(text), self.chunk)) + self.finish()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of several texts; those that fit one chunk look their new units up together."""
        plain = [i for i, x in enumerate(texts) if 0 < len(x) <= self.chunk and not any(s in x for s in self.vocabulary.special)]
        done = dict(zip(plain, self.units([texts[i] for i in plain]), strict=True)) if plain else {}
        return [done[i] if i in done else self.encode(x) for i, x in enumerate(texts)]


class Decoder:
    """feed() ids of one text, then finish(); invalid bytes become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary):
        self.bytes = [vocabulary.bytes.get(i, b"") for i in range(max(vocabulary.bytes) + 1)]
        self.machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, ids: np.ndarray) -> str:
        return self.machine.decode(b"".join(map(self.bytes.__getitem__, ids.tolist())))

    def finish(self) -> str:
        out = self.machine.decode(b"", True)
        self.machine.reset()
        return out

    def decode(self, ids: bytes) -> str:
        block = 4 * CHUNK
        return "".join(self.feed(np.frombuffer(ids[i : i + block], "<u4")) for i in range(0, len(ids), block)) + self.finish()


_ready: dict[int, tuple[Transducer, Decoder]] = {}


def _machines(shared) -> tuple[Transducer, Decoder]:
    """This worker's transducer and decoder of the broadcast vocabulary."""
    if shared.id not in _ready:
        text, lookahead = shared.value
        vocabulary = Vocabulary(text)
        _ready[shared.id] = Transducer(vocabulary, lookahead), Decoder(vocabulary)
    return _ready[shared.id]


class _Shared:
    def __init__(self, df: DataFrame, path: str):
        with open(path, encoding="utf-8") as f:
            text = f.read()
        self.shared = attach(df).sparkContext.broadcast((text, Vocabulary(text).sufficient_lookahead()))
        self.id = path

    @property
    def value(self):
        return self.shared.value


ROWS = 256  # rows in an output batch


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """id, n_tokens and ids (little-endian unsigned 32-bit integers) of each whole text; with ``decoded`` also the text
    that the ids decode to, worked out by the same worker.

    ``path`` is a byte-level BPE file of the tokenizers library.  A null text is empty: no ids.  The strings
    of special tokens become their ids.  Null and repeated document ids are kept as they are;
    other columns are ignored.
    """
    shared = _Shared(docs, path)
    names = [id_col, "n_tokens", "ids", *["decoded"] * decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine, decoder = _machines(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                ids = machine.encode_all([x or "" for x in part.column(1).to_pylist()])
                counts = pa.array([len(x) // 4 for x in ids], pa.int64())
                columns = [part.column(0), counts, pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([decoder.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=names)
        machine.units.forget()
        machine.pieces.clear()

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, F.col(text_col).cast("string").alias("text")).mapInArrow(tidy(run), f"`{id_col}` {kind}, n_tokens long, ids binary" + ", decoded string" * decoded)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with its ids column replaced by ``decoded``, the text of the ids; null ids are no ids."""
    shared = _Shared(encoded, path)
    others = [c for c in encoded.columns if c != ids_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, machine = _machines(shared)
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                decoded = pa.array([machine.decode(x or b"") for x in part.column(len(others)).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*part.columns[:-1], decoded], names=[*others, "decoded"])

    schema = encoded.select(*others).schema.add("decoded", "string")
    return encoded.select(*others, ids_col).mapInArrow(tidy(run), schema)


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens and SHA-256 of the ids and of what they decode to."""
    coded = encode(docs, path, id_col, text_col, decoded=True)
    return coded.select(id_col, "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.encode("decoded", "utf-8"), 256).alias("decoded_sha256"))
