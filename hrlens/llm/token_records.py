"""Token ids as length-delimited binary records, with an offset index.

A record file is a run of records, each

    uint64  length of the payload
    uint32  masked CRC-32 of those 8 bytes
    payload: 1 byte (1: the document has an id; 2: ids of 16 bits),
             int64 document id, then its token ids as uint16 where the
             vocabulary has 65,536 ids at most, as uint32 otherwise
    uint32  masked CRC-32 of the payload
    1 byte  line feed, the end of the record

all little-endian; a checksum is masked by a rotation and a constant so that a
checksum of data holding checksums stays sound. Files follow the order of
document ids, records within a file too. The index is a table apart from the
files: (file, offset, length, doc_id, n_tokens, before, ids_crc32), ``before``
being the tokens of the file's earlier records. ``read_at`` reads records in
any order from index rows.

Texts are encoded in parts that the tokenizer never joins. Where all characters
are ASCII or Latin letters, these are the pieces that a byte-level
pre-tokenizer makes by its regular expression: a word with the space before it,
the comma after it; they are cut from the bytes of many texts at once. Other
texts are cut into stretches: the pre-tokenizer starts a new token at a space
between two characters that are no white space. The different parts of some
megabytes of text are found by Arrow. Those met before are looked up; new words
go to the tokenizer's model, for which each is one token of the pre-tokenizer;
the other new parts go to the tokenizer together, and the tokens that begin with
a space tell where each starts. The tokenizer's own added tokens are found in a text as its plain call finds them (their strings
give their ids); they hold no space and take none in, so no cut into stretches
meets one, and a text that holds one is cut into stretches.

Files are written by Spark's own writer into any folder that it can reach, and
committed by it, so a lost executor leaves none half-written.

Cases: null or empty text is a record with the end id alone; a null document
id sorts first; repeated rows are records of their own; an empty table gives
no records.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hrlens.llm.common import byte_batches, scratch, small_batches

LENGTH = struct.Struct("<QI")
CRC = struct.Struct("<I")
HEAD = struct.Struct("<Bq")
END = b"\n"
# Fixed value: added to a checksum rotated by 15 bits to mask it.
MASK = 0xA282EAD8

# A space between two characters of which neither is white space.
_GAP = re.compile(r"(?<=\S) (?=\S)")
# White space other than the space and the line feed: texts with any go by _GAP.
_OTHER = [chr(c) for c in range(0x3001) if chr(c).isspace() and chr(c) not in " \n"]
# Letters of the first Latin blocks: with ASCII, the characters of texts that are cut into pieces.
_LATIN = "ªµºÀ-ÖØ-öø-ɏ"
# One such word with the space before it, if any: one token of a byte-level pre-tokenizer.
_WORD = re.compile(f" ?[A-Za-z{_LATIN}]+")
# Whether two bytes (as one number) are a letter of these blocks, all of which take two.
_PAIRS = np.zeros(1 << 16, bool)
_PAIRS[[int.from_bytes(x.encode()) for x in re.findall(f"[{_LATIN}]", "".join(map(chr, range(0x80, 0x250))))]] = True
# Kinds of bytes in such texts: a pre-tokenizer's regular expression keeps to one kind but for a space in front.
_WHITE, _DIGIT, _LETTER, _MARK = range(4)
_KIND = np.full(256, _MARK, np.uint8)
_KIND[list(b" \t\n\x0b\f\r")] = _WHITE
_KIND[list(b"0123456789")] = _DIGIT
_KIND[[*range(65, 91), *range(97, 123), *range(128, 256)]] = _LETTER
# Byte-level vocabularies write bytes as letters: those that do not print (and the space) as the letters from 256 on.
_PRINT = {*range(33, 127), *range(161, 173), *range(174, 256)}
_LETTERS = dict(zip([b for b in range(256) if b not in _PRINT], range(256, 512)))
# Bytes of text whose different parts are found together.
_CHUNK = 2_000_000


def stretches(text: str) -> list[str]:
    """The text cut at spaces (which go) between two characters that are no
    white space."""
    if text[:1].isspace() or text[-1:].isspace() or "  " in text or "\n " in text or " \n" in text or any(c in text for c in _OTHER):
        return _GAP.split(text)
    return text.split(" ")


def pieces(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Whether a piece starts at each byte of ``data``, UTF-8 texts of ASCII and
    Latin letters that begin at ``off`` (its last value: the end), as in
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    One value more stands for the end."""
    kind = _KIND[data]
    text = np.zeros(len(data) + 1, bool)
    text[off] = True
    start = text.copy()
    start[1:-1] |= kind[1:] != kind[:-1]
    # The last white space before something else is a piece of its own; a space goes to what follows.
    last = np.flatnonzero((kind[:-1] == _WHITE) & start[1:-1] & ~text[1:-1])
    start[last] = True
    start[last + 1] = data[last] != 32
    # 's and its like, where a piece starts at the apostrophe.
    at = np.flatnonzero(data == 39)
    at = at[start[at] & ~text[at + 1]]
    follow = data[at + 1]
    short = np.isin(follow, list(b"stmd"))
    start[at[short] + 1], start[at[short] + 2] = False, True
    at, follow = at[~short], follow[~short]
    inside = ~text[at + 2]
    at, follow = at[inside], follow[inside].astype(np.int64) << 8 | data[at[inside] + 2]
    at = at[np.isin(follow, [int.from_bytes(x) for x in (b"re", b"ve", b"ll")])]
    start[at + 1], start[at + 3] = False, True
    return start


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return (((c >> 15) | (c << 17)) + MASK) & 0xFFFFFFFF


def record(doc_id: int | None, ids: bytes, narrow: bool) -> bytes:
    payload = HEAD.pack((doc_id is not None) + 2 * narrow, doc_id or 0) + ids
    n = struct.pack("<Q", len(payload))
    return n + CRC.pack(masked(n)) + payload + CRC.pack(masked(payload)) + END


def parse(data: memoryview | bytes, at: int = 0) -> tuple[int | None, np.ndarray, int]:
    """The record at an offset: (doc_id, ids as uint32, offset of the next);
    ValueError where a checksum or the framing fails."""
    n, check = LENGTH.unpack_from(data, at)
    if check != masked(bytes(data[at : at + 8])):
        raise ValueError(f"record at {at}: length checksum")
    payload = bytes(data[at + LENGTH.size : at + LENGTH.size + n])
    end = at + LENGTH.size + n
    if len(payload) != n or CRC.unpack_from(data, end)[0] != masked(payload) or bytes(data[end + 4 : end + 5]) != END:
        raise ValueError(f"record at {at}: payload checksum")
    flags, doc_id = HEAD.unpack_from(payload)
    ids = np.frombuffer(payload, "<u2" if flags & 2 else "<u4", offset=HEAD.size)
    return (doc_id if flags & 1 else None), ids.astype("<u4"), end + 5


@dataclass(frozen=True)
class Tokens:
    """``path`` of a tokenizers file (which every executor can open);
    ``end_id`` closes each document; ``file_bytes``: stored input per
    file, about; ``memory``: parts that a worker remembers."""

    path: str
    end_id: int = 0
    file_bytes: int = 6_000_000
    memory: int = 600_000


class Encoder:
    """A tokenizer with a memory for the ids of the parts it has encoded."""

    def __init__(self, spec: Tokens):
        from tokenizers import Tokenizer

        self.spec = spec
        self.tokenizer = Tokenizer.from_file(spec.path)
        self.narrow = self.tokenizer.get_vocab_size() <= 1 << 16
        self.kind = np.dtype("<u2" if self.narrow else "<u4")
        # Byte-level vocabularies write a space as this letter.
        self.begins = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(self.tokenizer.get_vocab_size())])
        cut = self.tokenizer.pre_tokenizer and json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        self.cuts = bool(cut) and cut["type"] == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and self.tokenizer.normalizer is None
        added = [re.escape(x.content.encode()) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile(b"|".join(added)) if added else None
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _cut(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where the parts of the texts that begin at ``off`` start in ``data``,
        the end included."""
        if self.cuts:
            start = pieces(data, off)
            lead = np.flatnonzero(data >= 0xC0)
            other = lead[~_PAIRS[data[lead].astype(np.int64) << 8 | data[lead + 1]]]
            if self.added:
                held = [x for m in self.added.finditer(data) for x in (m.start(), m.end() - 1)]
                other = np.append(other, np.array(held, np.int64))
            texts = np.unique(np.searchsorted(off, other, "right") - 1)
        else:
            start = np.zeros(len(data) + 1, bool)
            start[off] = True
            texts = np.flatnonzero(np.diff(off))
        for lo, hi in zip(off[texts].tolist(), off[texts + 1].tolist()):
            first, *others = stretches(data[lo:hi].tobytes().decode())
            start[lo + 1 : hi] = False
            start[lo + np.cumsum([len(first.encode()), *[1 + len(x.encode()) for x in others]])] = True
        return np.flatnonzero(start)

    def _words(self, new: list[str]) -> None:
        """Encode parts that are one token of the pre-tokenizer."""
        tokenize, kind = self.tokenizer.model.tokenize, self.kind.char
        for x in new:
            letters = x.replace(" ", "Ġ") if x.isascii() else x.encode().decode("latin-1").translate(_LETTERS)
            self.known[x] = array(kind, [t.id for t in tokenize(letters)]).tobytes()

    def _alone(self, new: list[str]) -> None:
        made = self.tokenizer.encode_batch_fast(new, add_special_tokens=False)
        self.known.update((x, np.array(e.ids, self.kind).tobytes()) for x, e in zip(new, made))

    def _together(self, new: list[str]) -> None:
        """Encode parts that hold a space at the start only as one text."""
        for lo in range(0, len(new), 4096):
            part = new[lo : lo + 4096]
            ids = np.array(self.tokenizer.encode_batch_fast(["".join(part)], add_special_tokens=False)[0].ids, self.kind)
            at = np.flatnonzero(self.begins[ids])
            if len(at) != len(part):  # a part with a token of its own that begins so
                self._alone(part)
                continue
            cuts = (np.append(at, len(ids)) * self.kind.itemsize).tolist()
            data = ids.tobytes()
            self.known.update(zip(part, [data[i:j] for i, j in zip(cuts, cuts[1:])]))

    def _look_up(self, need: set[str]) -> None:
        """Make ``known`` hold all of ``need``. Half the memory is a younger
        generation; once that is full it becomes the older one, of which what
        is met again comes back."""
        if len(self.known) + len(need) > self.spec.memory // 2:
            self.older, self.known = self.known, {}
        new = need.difference(self.known)
        if self.older:
            found = {x: self.older[x] for x in self.older.keys() & new}
            self.known.update(found)
            new.difference_update(found)
        if self.cuts:
            words = list(filter(_WORD.fullmatch, new))
            if self.added and self.added.search("".join(words).encode()):  # only stretches can hold one
                words = [x for x in words if not self.added.search(x.encode())]
            self._words(words)
            new.difference_update(words)
        spaced = [x for x in new if x[:1] == " " and x.rfind(" ") == 0 and not x.isspace()]
        self._together(spaced)
        self._alone(list(new.difference(spaced)))

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """Ids (little-endian, 16 bits if ``narrow``) of each text, the end id
        included."""
        texts = texts.cast(pa.large_string()) if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())
        if not len(texts):
            return []
        _, ends, data = texts.buffers()
        off = np.frombuffer(ends, np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(data or b"", np.uint8)
        end = np.array([self.spec.end_id], self.kind).tobytes()
        out = []
        chunks = [0, *(np.flatnonzero(np.diff((off[:-1] - off[0]) // _CHUNK)) + 1).tolist(), len(texts)]
        for lo, hi in zip(chunks, chunks[1:]):  # texts that are looked up together
            ids, cuts = self._ids(data[off[lo] : off[hi]], off[lo : hi + 1] - off[lo])
            out += [ids[i:j] + end for i, j in zip(cuts, cuts[1:])]
        return out

    def _ids(self, data: np.ndarray, off: np.ndarray) -> tuple[bytes, list[int]]:
        """The ids of all texts that begin at ``off`` in ``data``, and where
        those of each begin."""
        cuts = self._cut(data, off)
        if len(cuts) == 1:  # no text but empty ones
            return b"", [0] * len(off)
        parts = pa.LargeStringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts), pa.py_buffer(data)).dictionary_encode()
        cuts = np.searchsorted(cuts, off)  # the first part of each text
        names = parts.dictionary.to_numpy(zero_copy_only=False).tolist()
        self._look_up(set(names))
        made = pa.array(list(map(self.known.__getitem__, names)), pa.large_binary())
        del names
        made = made.take(parts.indices)
        _, ends, ids = made.buffers()
        ends = np.frombuffer(ends, np.int64)[made.offset : made.offset + len(made) + 1]
        return ids.to_pybytes(), ends[cuts].tolist()


@lru_cache(2)
def encoder(spec: Tokens) -> Encoder:
    """The encoder of a task's worker. A task has one core, so the library
    starts no threads, each of which would hold memory of its own."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return Encoder(spec)


def write(docs: DataFrame, folder: str, spec: Tokens, text: str = "text", doc_id: str = "doc_id") -> None:
    """Record files of ``docs``, in the order of ``doc_id`` (equal ids: of the
    text's hash)."""
    small_batches(docs.sparkSession, 500)
    byte_batches(docs.sparkSession)
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), t.alias("text"))
    # Sized by the scan's statistics, so that no job reads the texts for it; where there are none, by the texts.
    stats = rows._jdf.queryExecution().optimizedPlan().stats()
    size = int(str(stats.sizeInBytes()))
    if size > 1 << 60:  # Spark's own default, which stands for an unknown size
        size = int(rows.agg(F.sum(F.octet_length("text").cast("decimal(38,0)"))).first()[0] or 0) // 2
    files = max(1, -(-size // spec.file_bytes))

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(spec)
        for b in batches:
            made = zip(b.column("doc_id").to_pylist(), e.encode(b.column("text")))
            yield pa.record_batch({"record": pa.array([record(k, x, e.narrow)[:-1] for k, x in made], pa.binary())})

    dealt = rows.repartitionByRange(files, "doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    # The text writer ends each value with a line feed and changes no byte of it.
    dealt.mapInArrow(frames, "record binary").select(F.col("record").cast("string")).write.option("lineSep", "\n").text(folder)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """file (its place in order), content."""
    byte_batches(spark)  # a file at a time goes to a worker
    number = F.regexp_extract("path", r"part-(\d+)-[^/]*$", 1).cast("int")
    return spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(folder).select(number.alias("file"), "content")


def index(spark: SparkSession, folder: str) -> DataFrame:
    """The offset index of the record files in ``folder``, from reading them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, content in zip(b["file"], b["content"]):
                rows, at, before = [], 0, 0
                view = memoryview(content)
                while at < len(view):
                    key, ids, end = parse(view, at)
                    rows.append((number, at, end - at, key, len(ids), before, zlib.crc32(ids.tobytes())))
                    at, before = end, before + len(ids)
                made = pd.DataFrame(rows, columns=["file", "offset", "length", "doc_id", "n_tokens", "before", "ids_crc32"])
                yield made.assign(doc_id=pd.array([r[3] for r in rows], dtype="Int64"))

    shape = "file int, offset long, length long, doc_id long, n_tokens long, before long, ids_crc32 long"
    return files(spark, folder).mapInPandas(run, shape)


def read_at(spark: SparkSession, folder: str, entries: DataFrame) -> DataFrame:
    """file, offset, doc_id, ids of the records that ``entries`` (file,
    offset) point to, in any order."""
    wanted = entries.groupBy("file").agg(F.collect_set("offset").alias("offsets"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for number, content, offsets in zip(b["file"], b["content"], b["offsets"]):
                found = [(number, int(at), *parse(memoryview(content), int(at))[:2]) for at in offsets]
                made = pd.DataFrame(found, columns=["file", "offset", "doc_id", "ids"])
                yield made.assign(doc_id=pd.array([r[2] for r in found], dtype="Int64"), ids=[x.astype(np.int64) for x in made["ids"]])

    return files(spark, folder).join(wanted, "file").mapInPandas(run, "file int, offset long, doc_id long, ids array<long>")


def write_and_index(docs: DataFrame, spec: Tokens, text: str = "text", doc_id: str = "doc_id", folder: str | None = None) -> DataFrame:
    """Write record files and their index (folders ``records`` and ``index``
    in ``folder``, by default one in the shared location) and return the index
    with ``start``: the tokens of all earlier documents."""
    spark = docs.sparkSession
    folder = folder or scratch(spark, "tokens")
    write(docs, f"{folder}/records", spec, text, doc_id)
    made = index(spark, f"{folder}/records")
    made.write.parquet(f"{folder}/index")
    entries = spark.read.schema(made.schema).parquet(f"{folder}/index")
    # One row for each file: what stands before it.
    totals = entries.groupBy("file").agg(F.sum("n_tokens").alias("all"))
    ahead = F.sum("all").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("file", F.coalesce(ahead, F.lit(0)).alias("ahead"))
    return entries.join(totals, "file").withColumn("start", F.col("ahead") + F.col("before")).drop("ahead")
