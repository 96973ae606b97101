"""Token-ID output as sorted-string-table shards.

A shard holds documents ordered by identifier. Layout, all integers little-endian:

    data blocks   zstd(entries); an entry is
                  varint shared, varint unshared, key suffix bytes, varint n_tokens, n_tokens ids as u16 or u32
    filter block  Bloom filter bits
    index block   per data block: last key (9 bytes), u64 offset, u32 length, u64 tokens before the block
    footer        u64 filter offset, u64 filter length, u64 index offset, u64 index length,
                  u64 documents, u64 tokens, u32 id width, u32 Bloom hashes, 8 bytes magic

A key is 9 bytes, big-endian and order-preserving: 0x00 for a null id, else 0x01 and the id with its sign bit
flipped. Keys are prefix-compressed inside a block and start afresh with each block, so a lookup is: Bloom
filter, binary search in the index, one block.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from grainsift.llm.common import bounded_batches, give_back_memory, shuffle_partitions, without_cycle_collection, work_path, written

MAGIC = b"TOKSST01"
FOOTER = struct.Struct("<QQQQQQII8s")
INDEX = struct.Struct("<9sQIQ")
BLOCK_BYTES = 1 << 16
BLOOM_BITS, BLOOM_HASHES = 10, 7
ROWS_PER_SHARD = 4_000_000  # 16 bytes a key and 10 bits of filter are held while a shard is written


def key_of(doc_id: int | None) -> bytes:
    return b"\x00" * 9 if doc_id is None else b"\x01" + (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at += 1
        if b < 128:
            return n, at
        shift += 7


def _hashes(key: bytes) -> tuple[int, int]:
    return xxhash.xxh3_64_intdigest(key), xxhash.xxh3_64_intdigest(key, seed=1) | 1


def _spots(key: bytes, bits: int, hashes: int) -> list[int]:
    a, b = _hashes(key)
    return [(a + i * b) % (1 << 64) % bits for i in range(hashes)]


class ShardWriter:
    """Writes one shard to a binary file object; entries come in key order."""

    def __init__(self, out, width: int = 2):
        self.out, self.width = out, width
        self.at = self.docs = self.tokens = self.before = 0
        self.block, self.last, self.hashes, self.index = bytearray(), b"", array("Q"), []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        """ids: packed integers of the shard's width."""
        key, count = key_of(doc_id), len(ids) // self.width
        shared = 0
        if self.block:
            while shared < 9 and key[shared] == self.last[shared]:
                shared += 1
        self.block += _varint(shared) + _varint(9 - shared) + key[shared:] + _varint(count) + ids
        self.last = key
        self.hashes.extend(_hashes(key))
        self.docs += 1
        self.tokens += count
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        data = zstandard.ZstdCompressor(level=1).compress(bytes(self.block))
        self.out.write(data)
        self.index.append(INDEX.pack(self.last, self.at, len(data), self.before))
        self.at += len(data)
        self.before = self.tokens
        self.block = bytearray()

    def close(self) -> None:
        if self.block:
            self._flush()
        bits = max(64, self.docs * BLOOM_BITS)
        bloom, pairs = np.zeros(bits, bool), np.frombuffer(self.hashes, np.uint64).reshape(-1, 2)
        for i in range(BLOOM_HASHES):
            bloom[((pairs[:, 0] + np.uint64(i) * pairs[:, 1]) % np.uint64(bits)).astype(np.int64)] = True
        packed, index = struct.pack("<Q", bits) + np.packbits(bloom).tobytes(), b"".join(self.index)
        self.out.write(packed + index)
        self.out.write(FOOTER.pack(self.at, len(packed), self.at + len(packed), len(index), self.docs, self.tokens, self.width, BLOOM_HASHES, MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary file: footer, index and filter first, blocks as needed."""

    def __init__(self, file):
        self.file = file
        size = file.seek(0, 2)
        file.seek(size - FOOTER.size)
        f_at, f_len, i_at, i_len, self.docs, self.tokens, self.width, self.hashes, magic = FOOTER.unpack(file.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a token shard")
        file.seek(f_at)
        raw = file.read(f_len)
        self.bits, self.bloom = struct.unpack("<Q", raw[:8])[0], raw[8:]
        file.seek(i_at)
        self.index = list(INDEX.iter_unpack(file.read(i_len)))

    def block(self, n: int) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(id, tokens before, ids) of every entry of block n."""
        _, at, size, start = self.index[n]
        self.file.seek(at)
        data, pos, key = zstandard.ZstdDecompressor().decompress(self.file.read(size)), 0, b""
        while pos < len(data):
            shared, pos = _read_varint(data, pos)
            rest, pos = _read_varint(data, pos)
            key = key[:shared] + data[pos : pos + rest]
            count, pos = _read_varint(data, pos + rest)
            ids = np.frombuffer(data, f"<u{self.width}", count, pos)
            pos += count * self.width
            yield id_of(key), start, ids
            start += count

    def __iter__(self):
        for n in range(len(self.index)):
            yield from self.block(n)

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The token lists stored under an id, found by filter, binary search and the blocks that may hold it."""
        key = key_of(doc_id)
        if not all(self.bloom[s >> 3] & (128 >> (s & 7)) for s in _spots(key, self.bits, self.hashes)):
            return []
        lo, hi = 0, len(self.index)
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (mid + 1, hi) if self.index[mid][0] < key else (lo, mid)
        found = []
        while lo < len(self.index):
            found += [ids for i, _, ids in self.block(lo) if i == doc_id]
            if self.index[lo][0] > key:
                break
            lo += 1
        return found


def _file_system(uri: str):
    import pyarrow.fs as fs

    return fs.FileSystem.from_uri(uri if ":" in uri.split("/")[0] else f"file://{uri}")


_TOKENIZERS: dict = {}


def _tokenizer(name: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # the cores belong to Spark's tasks
    from tokenizers import Tokenizer

    if name not in _TOKENIZERS:
        _TOKENIZERS[name] = Tokenizer.from_file(name if "/" in name else public_tokenizers.path(name))
    return _TOKENIZERS[name]


#: White space other than blank and line feed; a text with any of it goes to the library as a whole.
ODD_SPACE = re.compile("[\t\r\x0b\x0c\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
PORTION = 1 << 25  # characters whose pieces are looked up at once
MEMO_PIECES = 1_500_000
MEMO_TEXTS = 8_192  # of at most 8 kB of ids
#: Characters that are letters, or neither letters, numbers nor space, in every version of Unicode since 5.0.
LETTERS, MARKS = "A-Za-zÀ-ÖØ-öø-ɏ", "!-/:-@\\[-`{-~¡-©«¬®-±´¶-¸»¿×÷‐-‧"
#: The library's pre-tokens of text of these characters and tabs, without the tabs.
PRE_TOKEN = re.compile(rf" ?[{LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[0-9]+| ?[{MARKS}]+|\n+(?!\S)|\n+")
_SHOWN = {*range(33, 127), *range(161, 173), *range(174, 256)}
#: Bytes as a byte-level tokenizer writes them, but for the tab, which becomes a blank.
BYTE_LEVEL = {b: b if b in _SHOWN else 256 + sum(x not in _SHOWN for x in range(b)) for b in range(256)} | {9: 32}


class PieceEncoder:
    """Ids of texts as packed little-endian integers, from the tokenizers library.

    With a byte-level pre-tokeniser a single blank between two other characters always opens a pre-token, so a text may
    be cut before such blanks and each distinct piece encoded once. Pieces of LETTERS, digits, MARKS and line feeds alone are
    cut into pre-tokens here and go straight to the library's model. Other texts and tokenizers are encoded whole.
    """

    def __init__(self, name: str, width: int, pieces: int = MEMO_PIECES, texts: int = MEMO_TEXTS):
        self.library, self.dtype, self.most_pieces, self.most_texts = _tokenizer(name), f"<u{width}", pieces, texts
        spec = json.loads(self.library.to_str())
        blank = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"])
        self.cuts = not blank and spec["normalizer"] is None and spec["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        self._forget()
        self.texts: dict[bytes, bytes] = {}  # ids of recent texts by 128-bit digest: copies are encoded once
        tab = self.library.encode("\t", add_special_tokens=False).ids
        self.tab = tab[0] if len(tab) == 1 else None
        added = ["".join(rf"\x{{{ord(c):x}}}" for c in t["content"]) for t in spec["added_tokens"]]
        self.odd = "|".join([rf"^\n|[^\n0-9{LETTERS}{MARKS}]", *added])  # what a piece that is cut into pre-tokens doesn't hold
        self.model = self._model_alone(spec) if self.cuts else None

    def _model_alone(self, spec: dict):
        """The library's model without its pre-tokeniser: it is given pre-tokens in the byte-level alphabet, with blanks between."""
        from tokenizers import Tokenizer, pre_tokenizers

        model = spec["model"]
        if model["type"] != "BPE" or any(model[k] for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")):
            return None
        alone = Tokenizer(self.library.model)
        alone.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.n_bytes = np.zeros(max(model["vocab"].values()) + 1, np.int64)  # of each token; a character of the alphabet is a byte
        for token, i in model["vocab"].items():
            self.n_bytes[i] = len(token)
        return alone

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _by_library(self, new: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one behind the other, and how many each has. Many go to a call: pieces open with a blank and hold no
        tab, so a tab between them is a token of its own."""
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(new), 256):
            part = new.slice(i, 256).to_pylist()
            if self.tab is not None:
                ids = np.array(self.library.encode_batch_fast([" " + "\t ".join(part)], add_special_tokens=False)[0].ids, self.dtype)
                tab = ids == self.tab
                ends = np.flatnonzero(tab)
                if len(ends) == len(part) - 1:
                    flat.append(ids[~tab])
                    sizes.append(np.diff(ends, prepend=-1, append=len(ids)) - 1)
                    continue
            got = [e.ids for e in self.library.encode_batch_fast([" " + w for w in part], add_special_tokens=False)]
            flat.append(np.array([x for ids in got for x in ids], self.dtype))
            sizes.append(np.array(list(map(len, got)), np.int64))
        return np.concatenate(flat), np.concatenate(sizes)

    def _by_model(self, new: pa.Array, one: bool) -> tuple[np.ndarray, np.ndarray]:
        """The same for pieces without anything odd, by the model alone; one: each is one pre-token. Whose a token is, its bytes tell."""
        flat, sizes = [np.zeros(0, self.dtype)], [np.zeros(0, np.int64)]
        for i in range(0, len(new), 1024):
            words = new.slice(i, 1024)
            text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words.cast(pa.string())), "\t ")[0].as_py()
            shown = (text if one else "\t".join(PRE_TOKEN.findall(text + "\t"))).encode().decode("latin-1").translate(BYTE_LEVEL)
            ids = np.array(self.model.encode_batch_fast([shown], add_special_tokens=False)[0].ids, self.dtype)
            ends, wanted = np.cumsum(self.n_bytes[ids]), np.cumsum(pc.binary_length(words).to_numpy() + 1)
            at = np.searchsorted(ends, wanted)
            if not len(ends) or ends[-1] != wanted[-1] or (ends[at] != wanted).any():  # a byte that the model doesn't know
                got, size = self._by_library(words)
                flat.append(got)
                sizes.append(size)
                continue
            flat.append(ids)
            sizes.append(np.diff(at, prepend=-1))
        return np.concatenate(flat), np.concatenate(sizes)

    def _learn(self, new: pa.Array) -> None:
        """Encode new pieces and remember them."""
        ways = [(new, self._by_library)]
        if self.model:
            odd, more = pc.match_substring_regex(new, self.odd), pc.match_substring_regex(new, f"[^{LETTERS}]")
            plain, mixed = new.filter(pc.invert(more)), new.filter(pc.and_(more, pc.invert(odd)))
            ways = [(plain, lambda x: self._by_model(x, True)), (mixed, lambda x: self._by_model(x, False)), (new.filter(odd), self._by_library)]
        for words, encode in ways:
            flat, size = encode(words)
            ids = _lists(np.concatenate([[0], np.cumsum(size)]) * flat.itemsize, pa.py_buffer(flat))
            self.known, self.ids = pa.concat_arrays([self.known, words]), pa.concat_arrays([self.ids, ids])

    def _forget(self) -> None:
        """No piece known but the empty one, which has no ids."""
        self.known, self.ids = pa.array([""], pa.large_string()), pa.array([b""], pa.large_binary())

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Ids of all texts; a text seen lately in this worker is not encoded again."""
        digests = [xxhash.xxh3_128_digest(t.encode("utf-8", "surrogatepass")) for t in texts]
        new = {d: t for d, t in zip(digests, texts, strict=True) if d not in self.texts}
        got = dict(zip(new, self._encode_distinct(list(new.values())), strict=True))
        out = [got[d] if d in got else self.texts[d] for d in digests]
        if len(self.texts) + len(got) > self.most_texts:
            self.texts = {}
        if len(got) <= self.most_texts:
            self.texts.update((d, ids) for d, ids in got.items() if len(ids) <= 1 << 13)
        return out

    def _encode_distinct(self, texts: list[str]) -> list[bytes]:
        """Texts that may be cut go portion by portion through their distinct pieces; the others are encoded whole."""
        out: list[bytes | None] = [None] * len(texts)
        portion, size = [], 0
        for i, t in enumerate(texts):
            if not self.cuts or "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " " or ODD_SPACE.search(t):
                out[i] = self.whole(t)
                continue
            portion.append(i)
            size += len(t)
            if size >= PORTION:
                self._encode_portion(texts, portion, out)
                portion, size = [], 0
        if portion:
            self._encode_portion(texts, portion, out)
        return out

    def _encode_portion(self, texts: list[str], portion: list[int], out: list[bytes | None]) -> None:
        """Look up the distinct pieces of some texts, encode the new ones together, and lay the ids of all pieces out as one array."""
        lists = pc.split_pattern(pa.array([texts[i] for i in portion], pa.large_string()), " ")
        cuts = lists.offsets.to_numpy()
        cuts = cuts - cuts[0]
        coded = lists.flatten().dictionary_encode()
        pieces, code = coded.dictionary, coded.indices.to_numpy().copy()
        first = [self.whole(w) for w in pieces.take(coded.indices.take(pa.array(cuts[:-1]))).to_pylist()]
        code[cuts[:-1]] = len(pieces) + np.arange(len(portion))  # the first piece of a text has no blank before it
        del lists, coded
        at = pc.index_in(pieces, value_set=self.known)
        new, n = pc.is_null(at), len(self.known)
        if pc.any(new).as_py():
            self._learn(pieces.filter(new))
            fresh = pieces.filter(new)
            at = pc.replace_with_mask(at, new, pc.add(pc.index_in(fresh, value_set=self.known.slice(n)), n).cast(at.type))
        laid = pa.concat_arrays([self.ids.take(at), pa.array(first, pa.large_binary())]).take(pa.array(code))
        stops, data = _stops(laid)[cuts].tolist(), memoryview(laid.buffers()[2] or b"")
        for i, x, y in zip(portion, stops, stops[1:], strict=False):
            out[i] = bytes(data[x:y])
        if len(self.known) > self.most_pieces:
            self._forget()


def _stops(lists: pa.Array) -> np.ndarray:
    return np.frombuffer(lists.buffers()[1], np.int64, len(lists) + 1, lists.offset * 8)


def _lists(stops: np.ndarray, data: pa.Buffer) -> pa.Array:
    """Byte strings that lie one behind the other in data."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(stops) - 1, [None, pa.py_buffer(stops.astype(np.int64)), data])


_ENCODERS: dict[tuple, PieceEncoder] = {}


def _encoder(*kind) -> PieceEncoder:
    """One encoder for each worker process, so that what it remembers serves all its tasks."""
    if kind not in _ENCODERS:
        _ENCODERS[kind] = PieceEncoder(*kind)
    return _ENCODERS[kind]


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", n_shards: int | None = None, order_col: str | None = None, pieces: int = MEMO_PIECES, texts: int = MEMO_TEXTS) -> DataFrame:
    """Encode docs and write one shard per range of identifiers into folder; returns the manifest.

    There are as many shards as shuffle partitions, and so many that one holds about ROWS_PER_SHARD rows at most. A worker
    remembers the ids of up to `pieces` pieces and `texts` short texts.

    Manifest, one row per shard: shard (in key order), path, docs, tokens. A task writes to a name of its own and renames
    it when complete, and the manifest only lists complete files, so retried or doubled tasks do no harm.
    Null ids sort first; rows that repeat an id are all kept, ordered by their text. A null text is empty and
    becomes the end id alone. An empty table writes no shard. order_col sorts by another integer column, which
    then is the key.
    """
    spark = docs.sparkSession
    bounded_batches(spark, rows=10_000, mbytes=20)
    n_shards = n_shards or max(shuffle_partitions(spark), -(-docs.count() // ROWS_PER_SHARD))
    width = 2 if _tokenizer(tokenizer).get_vocab_size(with_added_tokens=True) <= 1 << 16 and end_id < 1 << 16 else 4
    root = folder.rstrip("/")
    fs, path = _file_system(root)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(order_col or id_col).cast("long").alias("k"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    rows = rows.repartitionByRange(n_shards, "k", F.xxhash64("t")).sortWithinPartitions("k", "t").withColumn("p", F.spark_partition_id())

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        writer = out = None
        for b in batches:
            if not b.num_rows:
                continue
            if writer is None:
                encoder, end = _encoder(tokenizer, width, pieces, texts), end_id.to_bytes(width, "little")
                store, base = _file_system(root)
                shard = b.column(2)[0].as_py()
                temp, name = f"{base}/.{shard:06d}-{uuid.uuid4().hex}", f"shard-{shard:06d}.sst"
                out = store.open_output_stream(temp)
                writer = ShardWriter(out, width)
            with without_cycle_collection():
                encoded = encoder.encode_all(b.column(1).to_pylist())
            for k, ids in zip(b.column(0).to_pylist(), encoded, strict=True):
                writer.add(k, ids + end)
        if writer is not None:
            writer.close()
            out.close()
            store.move(temp, f"{base}/{name}")
            give_back_memory()
            yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([f"{root}/{name}"]), pa.array([writer.docs]), pa.array([writer.tokens])], ["shard", "path", "docs", "tokens"])

    return written(rows.mapInArrow(encode, "shard int, path string, docs long, tokens long"), "token-manifest")


def read_shards(manifest: DataFrame) -> DataFrame:
    """(shard, nth, doc_id, start, n_tokens, ids_crc32) of every stored document, from the files alone.

    start counts the ids of all documents before it: tokens of the earlier shards, from their footers, then
    those before it inside the shard. crc32 is over the ids as little-endian u32.
    """
    order = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    placed = manifest.select("shard", "path", F.coalesce(F.sum("tokens").over(order), F.lit(0)).alias("base"))
    placed = placed.repartition(shuffle_partitions(manifest.sparkSession), "shard")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for shard, path, base in zip(*(c.to_pylist() for c in b.columns), strict=True):
                store, name = _file_system(path)
                with store.open_input_file(name) as f:
                    reader, nth = ShardReader(f), 0
                    for n in range(len(reader.index)):
                        got = [(i, base + start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())) for i, start, ids in reader.block(n)]
                        cols = list(zip(*got, strict=True))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([shard] * len(got), pa.int32()), pa.array(range(nth, nth + len(got)), pa.int64()), *(pa.array(c, pa.int64()) for c in cols)],
                            ["shard", "nth", "doc_id", "start", "n_tokens", "ids_crc32"],
                        )
                        nth += len(got)

    return placed.mapInArrow(decode, "shard int, nth long, doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract query: byte_bpe_50k.json ids with end id 0, written and read back in doc_id order."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    manifest = write_shards(docs, work_path(spark, "token-shards"), "byte_bpe_50k.json", end_id=0)
    return read_shards(manifest).select("doc_id", "start", "n_tokens", "ids_crc32")
