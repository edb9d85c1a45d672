"""Token ids in binary files, coded by a static range asymmetric numeral system.

One frequency table, counted over all tokens, serves all files. Tokens are cut into blocks that stand alone. In a
block token i belongs to lane i mod `lanes`; every lane has a 64-bit state, and all lanes write their 32-bit words to
one stream in an order that the decoder meets again. Every `segment` steps a checkpoint keeps the states and the place
in the stream, so that decoding starts at any of them: the segments of a block are decoded side by side, and each must
end in the states that the next checkpoint holds. Checksums cover the coded bytes and the ids.

A file is a sequence of blocks, each followed by MARK, which Spark's text source takes as the end of a line: files
are written, split and read by Spark wherever it can. A folder holds `blocks` and the `table` (id, frequency).
"""

from __future__ import annotations

import functools
import json
import re
import struct
import uuid
import zlib
from array import array
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.llm._common import discard, release, shared_dir, stored

#: Ends a block. A block whose bytes would hold it is stored with another key.
MARK = "~end-of-token-block~"
#: Frequencies of a table sum to 2^SCALE_BITS.
SCALE_BITS = 20
_SCALE = 1 << SCALE_BITS
#: States are at least this between two tokens, and below 2^63.
_LOW = 1 << 31


@dataclass(frozen=True)
class FileParams:
    """block: tokens to a block. lanes: interleaved states. segment: steps of all lanes between checkpoints."""

    block: int = 1 << 20
    lanes: int = 2048
    segment: int = 128


def frequencies(counts: dict[int, int]) -> dict[int, int]:
    """Counts scaled to a sum of 2^20, each at least 1, what rounding leaves going to the largest remainders."""
    if len(counts) > _SCALE:
        raise ValueError(f"more than {_SCALE} different ids")
    total, free = sum(counts.values()), _SCALE - len(counts)
    parts = {i: divmod(n * free, total) for i, n in counts.items()}
    out = {i: 1 + whole for i, (whole, _) in parts.items()}
    for i in sorted(parts, key=lambda i: (-parts[i][1], i))[: _SCALE - sum(out.values())]:
        out[i] += 1
    return out


class Table:
    """A frequency table ready for use: ids ascending, their frequencies and the sums before them."""

    def __init__(self, freq: dict[int, int]):
        self.ids = np.array(sorted(freq), np.uint32)
        self.freq = np.array([freq[i] for i in self.ids.tolist()], np.uint64)
        self.below = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.freq)])[:-1].astype(np.uint64)
        self.digest = zlib.crc32(self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())
        self._slots = self._places = None

    @property
    def slots(self) -> np.ndarray:
        """The place in `ids` that each of the 2^20 slots belongs to."""
        if self._slots is None:
            self._slots = np.repeat(np.arange(len(self.ids), dtype=np.uint16 if len(self.ids) <= 65536 else np.uint32), self.freq.astype(np.int64))
        return self._slots

    def places(self, ids: np.ndarray) -> np.ndarray:
        if not len(self.ids) or self.ids[-1] > 1 << 24:  # no room for a place for each number
            at = np.minimum(np.searchsorted(self.ids, ids), max(0, len(self.ids) - 1))
        else:
            if self._places is None:
                self._places = np.zeros(int(self.ids[-1]) + 1, np.int32)
                self._places[self.ids] = np.arange(len(self.ids))
            at = self._places[np.minimum(ids, self.ids[-1])]
        if len(ids) and (not len(self.ids) or (self.ids[at] != ids).any()):
            raise ValueError("an id is not in the table")
        return at


def encode_ids(ids: np.ndarray, table: Table, lanes: int, segment: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(states at the checkpoints, places of the checkpoints in the stream, stream of words)."""
    at = table.places(ids)
    steps = -(-len(ids) // lanes)
    # the last step is filled up with the most frequent id
    at = np.concatenate([at, np.full(steps * lanes - len(ids), int(table.freq.argmax()) if len(ids) else 0)]).reshape(steps, lanes)
    f, c = table.freq[at], table.below[at]
    most = f << np.uint64(63 - SCALE_BITS)
    x = np.full(lanes, _LOW, np.uint64)
    words, sent, states, places = [], 0, [], []
    for t in range(steps - 1, -1, -1):
        full = x >= most[t]
        out = x[full]
        if len(out):
            words.append(out.astype(np.uint32))  # the low 32 bits
            sent += len(out)
            x = np.where(full, x >> np.uint64(32), x)
        q, r = np.divmod(x, f[t])
        x = (q << np.uint64(SCALE_BITS)) + r + c[t]
        if t % segment == 0:
            states.append(x)
            places.append(sent)
    stream = np.concatenate(words[::-1]) if words else np.zeros(0, np.uint32)
    return np.array(states[::-1], np.uint64).reshape(-1, lanes), sent - np.array(places[::-1], np.int64), stream


def decode_ids(n: int, states: np.ndarray, places: np.ndarray, stream: np.ndarray, table: Table, segment: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of segments first to last (all), decoded side by side from their checkpoints."""
    lanes = states.shape[1]
    steps = -(-n // lanes) if lanes else 0
    last = len(states) if last is None else last
    if first >= last:
        return np.zeros(0, np.uint32)
    lengths = [min(segment, steps - g * segment) for g in range(first, last)]
    out = np.zeros((last - first, segment, lanes), table.slots.dtype)
    words = np.append(stream, np.uint32(0)).astype(np.uint64)
    x, ptr = states[first:last].copy(), places[first:last].copy()
    for j in range(lengths[0]):
        live = len(lengths) if lengths[-1] > j else len(lengths) - 1  # only the last one can be shorter
        y = x[:live]
        slot = y & np.uint64(_SCALE - 1)
        s = table.slots[slot]
        out[:live, j] = s
        y = table.freq[s] * (y >> np.uint64(SCALE_BITS)) + slot - table.below[s]
        low = y < _LOW
        place = np.cumsum(low, 1, dtype=np.int64) + (ptr[:live, None] - 1)  # of the word that a low state takes
        ptr[:live] = place[:, -1] + 1
        x[:live] = np.where(low, (y << np.uint64(32)) | words[np.maximum(place, 0)], y)
    after = np.concatenate([states[first + 1 : last + 1], np.full((1, lanes), _LOW, np.uint64)])[: last - first]
    if (x != after).any():
        raise ValueError("a segment does not end at the next checkpoint")
    flat = out.reshape(-1, lanes)[: steps - first * segment].reshape(-1)
    return table.ids[flat[: n - first * segment * lanes]]


#: key, part, number in the part, tokens of the part before it, tokens, lanes, steps of a segment, checkpoints, words, pieces,
#: digest of the table, checksum of the ids, checksum of the rest.
_HEAD = "<4sBIIQIIIIIIIII"
_HEAD_SIZE = struct.calcsize(_HEAD)
#: Pieces of documents in a block: id, whether it is null, number of the document in the part, number of the piece, tokens, whether it is the last.
_PIECE = np.dtype([("id", "<i8"), ("null", "?"), ("document", "<i8"), ("piece", "<i4"), ("n", "<i8"), ("last", "?")])


def pack_block(ids: np.ndarray, pieces: np.ndarray, table: Table, part: int, number: int, before: int, p: FileParams) -> bytes:
    lanes = max(1, min(p.lanes, len(ids)))
    states, places, stream = encode_ids(ids, table, lanes, p.segment)
    rest = pieces.tobytes() + states.astype("<u8").tobytes() + places.astype("<i8").tobytes() + stream.astype("<u4").tobytes()
    sums = zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(rest)
    for key in range(256):
        body = rest if not key else np.bitwise_xor(np.frombuffer(rest, np.uint8), np.uint8(key)).tobytes()
        out = struct.pack(_HEAD, b"TIDB", key, part, number, before, len(ids), lanes, p.segment, len(states), len(stream), len(pieces), table.digest, *sums) + body
        # the end of the block and the mark may overlap, too
        if (out + MARK.encode()).find(MARK.encode()) == len(out):
            return out
    raise ValueError("no key keeps the mark out of the block")


@dataclass(frozen=True)
class Block:
    """A block as read: what its header says, the pieces of documents, and what decoding needs."""

    part: int
    number: int
    before: int
    n: int
    segment: int
    table_digest: int
    ids_sum: int
    pieces: np.ndarray
    states: np.ndarray
    places: np.ndarray
    stream: np.ndarray

    def ids(self, table: Table) -> np.ndarray:
        """All ids; damage is an error."""
        if table.digest != self.table_digest:
            raise ValueError(f"block {self.number} of part {self.part} was written with another table")
        out = decode_ids(self.n, self.states, self.places, self.stream, table, self.segment)
        if zlib.crc32(out.astype("<u4").tobytes()) != self.ids_sum:
            raise ValueError(f"the ids of block {self.number} of part {self.part} are damaged")
        return out

    def from_checkpoint(self, table: Table, first: int, last: int | None = None) -> np.ndarray:
        """The ids of some segments only."""
        return decode_ids(self.n, self.states, self.places, self.stream, table, self.segment, first, last)


def read_header(data: bytes) -> tuple:
    if len(data) < _HEAD_SIZE or data[:4] != b"TIDB":
        raise ValueError("no block of token ids")
    return struct.unpack_from(_HEAD, data)


def unpack_block(data: bytes) -> Block:
    _, key, part, number, before, n, lanes, segment, marks, words, pieces, digest, ids_sum, rest_sum = read_header(data)
    rest = data[_HEAD_SIZE :]
    if key:
        rest = np.bitwise_xor(np.frombuffer(rest, np.uint8), np.uint8(key)).tobytes()
    sizes = np.cumsum([pieces * _PIECE.itemsize, marks * lanes * 8, marks * 8, words * 4])
    if len(rest) != sizes[-1] or zlib.crc32(rest) != rest_sum:
        raise ValueError(f"block {number} of part {part} is damaged")
    cut = [rest[a:b] for a, b in zip([0, *sizes[:-1].tolist()], sizes.tolist())]
    states = np.frombuffer(cut[1], "<u8").reshape(marks, lanes)
    return Block(
        part, number, before, n, segment, digest, ids_sum, np.frombuffer(cut[0], _PIECE), states, np.frombuffer(cut[2], "<i8"), np.frombuffer(cut[3], "<u4")
    )


def joined_crc(first: int, second: int, size: int) -> int:
    """The CRC-32 of two byte strings in a row, from their own and the second's size: the first one is shifted by
    8 * size places, that is multiplied by a power of x modulo the CRC's polynomial (bits reversed)."""

    def product(a: int, b: int) -> int:
        out = 0
        for i in range(31, -1, -1):
            if a >> i & 1:
                out ^= b
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        return out

    power, square = 1 << 31, 1 << 30  # 1 and x
    bits = 8 * size
    while bits:
        if bits & 1:
            power = product(square, power)
        square, bits = product(square, square), bits >> 1
    return product(power, first) ^ second


# The normaliser and the splitter whose work on plain words is known.
_KNOWN_NORMALIZER = [("NFC", None), ("Replace", "\\s+"), ("Lowercase", None)]
_KNOWN_SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Letters that composition leaves alone and that have one lower-case form, then punctuation without an apostrophe.
PLAIN = "^(?P<letters>[A-Za-zÀ-ÖØ-öø-ÿ]+)(?P<marks>[!-&(-/:-@\\[-`{-~]*)$"


class WordTokenizer:
    """Encodes texts with a tokenizer file of the tokenizers library whose tokens never hold ASCII white space.

    Such a tokenizer gives the words of a text the ids that they have alone, so texts are encoded word by word. Where
    the file's normaliser and splitter are the known ones, a word of letters and punctuation falls into these two, which go
    to the library's merges as they are; every other word goes through the whole library. Words and parts that have been seen are
    remembered, a bounded number of short ones.
    """

    def __init__(self, path: str, most: int = 600_000, longest: int = 40):
        from tokenizers import Tokenizer

        self.tokenizer, self.most, self.longest = Tokenizer.from_file(path), most, longest
        self.merges, self.words, self.parts = self.tokenizer.model, {}, {}
        spec = json.loads(self.tokenizer.to_str())
        steps = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [(n["type"], n.get("pattern", {}).get("Regex")) for n in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        known = steps == _KNOWN_NORMALIZER and splits == [("Split", _KNOWN_SPLIT), ("ByteLevel", None)]
        # an added token with punctuation before letters cannot stand in a plain word
        apart = all(re.search("[^A-Za-z].*[A-Za-z]", t["content"]) for t in spec["added_tokens"])
        self.plain = PLAIN if known and apart else None
        # byte-level tokens name bytes by characters; those of letters' bytes are printable, or 128 to 160 and 173
        others = [*range(33), *range(127, 161), 173]
        self.names = {b: 256 + n for n, b in enumerate(others)}

    def _part(self, part: str) -> bytes:
        """The merges of a plain part, ids of 32 bits."""
        text = part if part.isascii() else part.encode().decode("latin-1").translate(self.names)
        return array("I", [t.id for t in self.merges.tokenize(text)]).tobytes()

    def _word(self, word: str) -> bytes:
        return array("I", self.tokenizer.encode(word, add_special_tokens=False).ids).tobytes()

    def _spelled(self, known: dict[str, bytes], spell, names: list[str]) -> list[bytes]:
        found = [known.get(n) for n in names]
        if None in found:
            new = {n: spell(n) for n, ids in zip(names, found) if ids is None}
            if len(known) + len(new) > self.most:
                known.clear()
            known.update((n, ids) for n, ids in new.items() if len(n) <= self.longest)
            found = [new[n] if ids is None else ids for n, ids in zip(names, found)]
        return found

    def _vocabulary(self, words) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words in a row, how many each has)."""
        import pyarrow.compute as pc

        if not self.plain:
            return joined_row(self._spelled(self.words, self._word, strings(words)))
        cut = pc.extract_regex(words, self.plain)
        whole = pc.is_null(cut)
        letters = pc.fill_null(pc.utf8_lower(pc.struct_field(cut, "letters")), "").dictionary_encode()
        marks = pc.fill_null(pc.struct_field(cut, "marks"), "").dictionary_encode()
        others = strings(words.filter(whole))
        spelled = [self._spelled(self.parts, self._part, strings(x.dictionary)) for x in (letters, marks)]
        ids, sizes = joined_row([*spelled[0], *spelled[1], *self._spelled(self.words, self._word, others)])
        # a plain word is two entries of that row, another one its own entry and an empty one
        n, m = len(spelled[0]), len(spelled[1])
        two = np.stack([letters.indices.to_numpy(), marks.indices.to_numpy() + n], 1).astype(np.int64)
        two[whole.to_numpy(zero_copy_only=False), 0] = n + m + np.arange(len(others))
        out, ends = gather(ids, sizes, two.reshape(-1))
        return out, np.diff(ends[1::2], prepend=0)

    def texts(self, texts, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, where each text ends there) of an Arrow array; a null text is empty."""
        import pyarrow.compute as pc

        lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        coded = lists.flatten().dictionary_encode()
        out, ends = gather(*self._vocabulary(coded.dictionary), coded.indices.to_numpy())
        of_text = np.concatenate([[0], ends])[lists.offsets.to_numpy()[1:] - lists.offsets[0].as_py()]
        if end_id is None:
            return out, of_text
        return np.insert(out, of_text, end_id), of_text + np.arange(1, len(of_text) + 1)


def strings(column) -> list[str]:
    return column.to_numpy(zero_copy_only=False).tolist()  # faster than to_pylist


def joined_row(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(parts), np.uint32), np.fromiter(map(len, parts), np.int64, len(parts)) // 4


def gather(ids: np.ndarray, sizes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the entries `at` of a row of entries, one after the other, where each of them ends)."""
    if not len(at):
        return np.zeros(0, np.uint32), np.zeros(0, np.int64)
    counts = sizes[at]
    ends = np.cumsum(counts)
    begins = (np.cumsum(sizes) - sizes)[at]
    return ids[np.arange(ends[-1]) + np.repeat(begins - (ends - counts), counts)], ends


@functools.lru_cache(maxsize=2)
def word_tokenizer(path: str) -> WordTokenizer:
    """One for each file and worker."""
    return WordTokenizer(path)


#: Bytes of text that a task encodes together; a longer text goes alone.
_SLICE = 8 << 20


def slices(texts, most: int = _SLICE):
    """Parts of an Arrow array of strings with about so many bytes each."""
    import pyarrow.compute as pc

    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield texts.slice(at, end - at)
        at = end


def width(tokenizer: str, end_id: int | None) -> str:
    """The narrowest integers that hold the ids of a tokenizer file, and the end id."""
    most = max(word_tokenizer(tokenizer).tokenizer.get_vocab_size(), (end_id or 0) + 1)
    return "<u2" if most <= 1 << 16 else "<u4"


def encoded(text: Column, tokenizer: str, end_id: int | None, kind: str = "<u4") -> Column:
    """The ids of each text as little-endian integers of a kind, with the end id; a null text is empty."""

    @F.arrow_udf("binary")
    def run(texts):
        import pyarrow as pa

        release()
        encode, out = word_tokenizer(tokenizer), []
        for part in slices(texts):
            ids, ends = encode.texts(part, end_id)
            offsets = np.concatenate([[0], np.dtype(kind).itemsize * ends]).astype(np.int32)
            out.append(pa.Array.from_buffers(pa.binary(), len(part), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype(kind).tobytes())]))
        return pa.concat_arrays(out) if out else pa.array([], pa.binary())

    return run(text.cast("string"))


def count_ids(coded: DataFrame, ids_col: str, kind: str = "<u4") -> dict[int, int]:
    """How often each id occurs; what reaches the driver is a row for each id of the vocabulary."""

    def run(it):
        import pyarrow as pa

        total = np.zeros(0, np.int64)
        for b in it:
            ids = np.frombuffer(b"".join(b.column(0).drop_null().to_pylist()), kind)
            own = np.bincount(ids, minlength=len(total))
            own[: len(total)] += total
            total = own
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    counted = coded.select(ids_col).mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r["id"]: r["n"] for r in counted.collect()}


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = 2, params: FileParams = FileParams()) -> None:
    """Encodes whole texts and writes their ids, in ascending order of document ids, under path.

    Ids of documents are longs, null ones come first. A null text is empty; with an end id every document has a token at
    least. Rows that repeat an id stay apart, ordered by their tokens. Other columns are not written, whatever they are called. An
    empty table gives a folder without blocks. A document longer than a block goes on in the next one; blocks end with
    their task. Tasks hold one block besides their batch of rows.
    """
    p, kind = params, width(tokenizer, end_id)
    coded = docs.select(F.col(id_col).cast("long").alias("id"), encoded(F.col(text_col), tokenizer, end_id, kind).alias("ids"))
    # the last column, fixed once written, spreads rows that repeat both id and text
    coded = stored(coded.withColumn("spread", F.monotonically_increasing_id()), "token-ids")
    table_rows = frequencies(count_ids(coded, "ids", kind))
    spark = docs.sparkSession
    spark.createDataFrame(sorted(table_rows.items()), "id long, frequency long").coalesce(1).write.parquet(f"{path}/table")
    ordered = coded.withColumn("tie", F.xxhash64("ids")).repartitionByRange("id", "tie", "spread").sortWithinPartitions("id", "tie", "spread")

    def run(it):
        import pyarrow as pa
        from pyspark import TaskContext

        release()
        part, table = TaskContext.get().partitionId(), Table(table_rows)
        number, before, document, held, pieces = 0, 0, 0, [], []
        room = p.block

        def block():
            ids = np.concatenate(held) if held else np.zeros(0, np.uint32)
            return pa.RecordBatch.from_arrays([pa.array([pack_block(ids, np.array(pieces, _PIECE), table, part, number, before, p)], pa.binary())], ["value"])

        for b in it:
            for doc, raw in zip(b.column(0), b.column(1)):
                ids, piece = np.frombuffer(raw.as_buffer(), kind).astype(np.uint32), 0
                while True:
                    now, ids = ids[:room], ids[room:]
                    held.append(now)
                    pieces.append((doc.as_py() or 0, not doc.is_valid, document, piece, len(now), not len(ids)))
                    room, piece = room - len(now), piece + 1
                    if not room:
                        yield block()
                        before, number, room, held, pieces = before + p.block, number + 1, p.block, [], []
                    if not len(ids):
                        break
                document += 1
        if pieces:
            yield block()

    blocks = ordered.select("id", "ids").mapInArrow(run, "value binary")
    blocks.select(F.col("value").cast("string")).write.option("lineSep", MARK).text(f"{path}/blocks")
    discard(coded)


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    """(value): the bytes of each block; large files are split between blocks."""
    return spark.read.schema("value string").option("lineSep", MARK).text(f"{path}/blocks").select(F.col("value").cast("binary"))


def read_table(spark: SparkSession, path: str) -> dict[int, int]:
    return {r["id"]: r["frequency"] for r in spark.read.parquet(f"{path}/table").collect()}  # a row for each id of the vocabulary


def read_token_files(spark: SparkSession, path: str, with_ids: bool = True) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, ids): what the files hold of each document.

    start counts the tokens of all documents before; ids_crc32 is that of the ids as little-endian unsigned 32-bit
    integers, as `ids` holds them (null unless with_ids). A damaged block, or one written with another table, is an error.
    """
    table_rows = read_table(spark, path)
    blocks = read_blocks(spark, path)

    def sizes(it):
        import pyarrow as pa

        for b in it:
            heads = [read_header(x) for x in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([h[2] for h in heads], pa.int64()), pa.array([h[5] for h in heads], pa.int64())], ["part", "n"])

    # one number a file, as many as tasks wrote
    totals = {r["part"]: r["n"] for r in blocks.select(F.substring("value", 1, _HEAD_SIZE)).mapInArrow(sizes, "part long, n long").groupBy("part").agg(F.sum("n").alias("n")).collect()}
    start, starts = 0, {}
    for part in sorted(totals):
        starts[part], start = start, start + totals[part]

    names = ["part", "document", "piece", "last", "doc_id", "start", "n_tokens", "ids_crc32", "ids"]

    def run(it):
        import pyarrow as pa

        release()
        table = Table(table_rows)
        for b in it:
            for value in b.column(0):
                block = unpack_block(value.as_py())
                raw, q = memoryview(block.ids(table).astype("<u4").tobytes()), block.pieces
                ends = np.cumsum(q["n"])
                begins = ends - q["n"]
                each = [raw[4 * i : 4 * j] for i, j in zip(begins.tolist(), ends.tolist())]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(q), block.part)), pa.array(q["document"]), pa.array(q["piece"]), pa.array(q["last"]),
                    pa.array(q["id"], mask=q["null"]), pa.array(begins + (starts[block.part] + block.before)), pa.array(q["n"]),
                    pa.array([zlib.crc32(e) for e in each], pa.int64()), pa.array([bytes(e) if with_ids else None for e in each], pa.binary())
                ], names)

    kinds = "part long, document long, piece int, last boolean, doc_id long, start long, n_tokens long, ids_crc32 long, ids binary"
    pieces = blocks.mapInArrow(run, kinds)
    whole = pieces.where("piece = 0 and last")
    # documents that blocks cut: a few pieces each, by file and number
    parts = F.sort_array(F.collect_list(F.struct("piece", "doc_id", "start", "n_tokens", "ids_crc32", "ids")))
    cut = pieces.where("piece > 0 or not last").groupBy("part", "document").agg(parts.alias("p"))

    @F.arrow_udf("long")
    def crc_of(sums, counts):
        import pyarrow as pa

        out = []
        for s, c in zip(sums.to_pylist(), counts.to_pylist()):
            total = s[0]
            for crc, n in zip(s[1:], c[1:]):
                total = joined_crc(total, crc, 4 * n)
            out.append(total)
        return pa.array(out, pa.int64())

    count = F.aggregate("p.n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)
    ids = F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)) if with_ids else F.lit(None).cast("binary")
    first = F.element_at("p", 1)
    joined = cut.select(first["doc_id"].alias("doc_id"), first["start"].alias("start"), count.alias("n_tokens"), crc_of("p.ids_crc32", "p.n_tokens").alias("ids_crc32"), ids.alias("ids"))
    return whole.select("doc_id", "start", "n_tokens", "ids_crc32", "ids").unionByName(joined)


def token_files(docs: DataFrame, tokenizer: str, path: str | None = None, with_ids: bool = False, **names) -> DataFrame:
    """Writes docs as token files (to a new folder beside the checkpoints unless path is given) and reads them back."""
    path = path or f"{shared_dir(docs.sparkSession)}/token-files-{uuid.uuid4().hex}"
    write_token_files(docs, path, tokenizer, **names)
    return read_token_files(docs.sparkSession, path, with_ids)
