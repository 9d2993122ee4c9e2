"""Byte-level BPE: encoding, decoding and token files.

Texts are encoded by the tokenizers library over Arrow batches. Words repeat, so a text is first split at single spaces
between two characters that aren't white space. The pattern never matches across such a place (a match either ends before a
space that follows other characters, or starts with that space), so the pieces' ids put together are the text's ids. Pieces
that are new to a worker are cut by the pattern, and matches that are new are given to the library, many in a string, a
line break between them. What a worker remembers is bounded by PIECES and MATCHES.

Rank files: every way to split a token into two tokens becomes a merge, in rank order, so that the library merges the
neighbours whose union has the lowest rank, as the ranks ask for.

Decoding looks up the bytes of each id (the byte table, reversed) and puts them together; characters split over ids are whole
again after that. `decode` replaces what is no valid UTF-8.

Nulls and odd rows: a null text is an empty one and has no ids. Ids, ties and repeated rows don't matter for encoding; every
row gives one row. Extra columns pass through `encode`; an extra column named as one of its results gives way to the result.
"""

from __future__ import annotations

import base64
import hashlib
import os
import re
import string
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from tidebar.llm.common import new_path, table

PIECES = 250_000
MATCHES = 120_000
#: Longer pieces are encoded each time they come.
LONG_PIECE = 200
#: Characters that are neither letters nor numbers nor white space.
MARKS = string.punctuation
RANKS = "byte_bpe_multi_50k.tiktoken"
MODEL = "byte_bpe_50k.json"

_SAFE_SPACE = re.compile(r"(?<=\S) (?=\S)")
#: Texts with a space at an end or beside other white space, as RE2 writes it.
_UNSAFE = r"^ | $| [\s\x0b\x1c-\x1f\x85\p{Z}]|[\s\x0b\x1c-\x1f\x85\p{Z}] "


def byte_characters() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies: itself if it prints, else one from 256 on."""
    printed = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shift = iter(range(256, 512))
    return [chr(b) if b in printed else chr(next(shift)) for b in range(256)]


def from_ranks(path: str, pattern: str):
    """A tokenizers.Tokenizer that encodes as the rank file says, each match of pattern by itself."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    sign = byte_characters()
    name = {t: "".join(sign[b] for b in t) for t in ranks}
    merges = []
    for t in sorted(ranks, key=ranks.get):
        pairs = [(t[:i], t[i:]) for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        merges += [(name[a], name[b]) for a, b in sorted(pairs, key=lambda p: (ranks[p[0]], ranks[p[1]]))]
    out = Tokenizer(models.BPE(vocab={name[t]: r for t, r in ranks.items()}, merges=merges, ignore_merges=True))
    out.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
    return out


class Codec:
    """Encodes and decodes in one worker; made there from the file's path, once a process."""

    _own: dict[str, Codec] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = self._load(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        byte = {c: b for b, c in enumerate(byte_characters())}
        added = {x.content for x in self.tokenizer.get_added_tokens_decoder().values()}
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = token.encode() if token in added else bytes(byte[c] for c in token)
        self.matches = regex.compile(public_tokenizers.PATTERN)
        # The same model for matches of the pattern that stand between line breaks.
        self.model = self._load(path)
        self.model.encode_special_tokens = True
        self.model.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.line_break = self.bytes.index(b"\n")
        # And for words after a space each, which tell where they start.
        self.words = self._load(path)
        self.words.encode_special_tokens = True
        self.words.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split(" ", "merged_with_next"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.starts_word = np.array([x[:1] == b" " for x in self.bytes])
        # Pieces after a space: where each one's ids start and how many they are, in ids of all.
        self.known, self.starts, self.lengths, self.known_ids = pa.array([], pa.string()), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")
        self.small: dict[str, bytes] = {}  # matches of the pattern

    def _load(self, path: str):
        return from_ranks(path, public_tokenizers.PATTERN) if path.endswith(".tiktoken") else Tokenizer.from_file(path)

    def _encode_matches(self, matches: list[str]) -> Iterator[bytes]:
        """Ids of each of some matches of the pattern without line breaks."""
        runs = ["\n".join(matches[i : i + 100]) for i in range(0, len(matches), 100)]
        for e in self.model.encode_batch_fast(runs, add_special_tokens=False):
            ids = np.asarray(e.ids, "<u4")
            packed, at = ids.tobytes(), (np.flatnonzero(ids == self.line_break) * 4).tolist()
            a = 0
            for z in at:
                yield packed[a:z]
                a = z + 4
            yield packed[a:]

    def _encode_words(self, words: list[str]) -> Iterator[bytes]:
        """Ids of each of some words after a space. Only the first id of a word has that space."""
        runs = [" " + " ".join(words[i : i + 100]) for i in range(0, len(words), 100)]
        for e in self.words.encode_batch_fast(runs, add_special_tokens=False):
            ids = np.asarray(e.ids, "<u4")
            packed, at = ids.tobytes(), (np.flatnonzero(self.starts_word[ids]) * 4).tolist()
            for a, z in zip(at, [*at[1:], len(packed)], strict=True):
                yield packed[a:z]

    def _fresh(self, pieces: list[str], lead: str) -> dict[str, bytes]:
        """Ids of different pieces. A piece of letters is one match; others are cut by the pattern."""
        letters = [x for x in pieces if x.isalpha()]
        out = dict(zip(letters, self._encode_words(letters) if lead else self._encode_matches(letters), strict=True))
        cut = {x: self._cut(x, lead) for x in pieces if x not in out}
        # A match may be known by itself or, after a space, as a piece.
        ids = {m: self.small.get(m) for m in dict.fromkeys(chain.from_iterable(cut.values()))}
        spaced = [m[1:] for m, known in ids.items() if known is None and m[0] == " "]
        beside = out if lead else {}
        ids |= {" " + x: self.known_ids[self.starts[k] : self.starts[k] + self.lengths[k]].tobytes() if k >= 0 else beside.get(x) for x, k in zip(spaced, self._places(pa.array(spaced, pa.string())).tolist(), strict=True)}
        new = [m for m, known in ids.items() if known is None]
        plain = [m for m in new if "\n" not in m]
        made = dict(zip(plain, self._encode_matches(plain), strict=True))
        if len(plain) < len(new):
            made |= {m: np.asarray(self.tokenizer.encode(m, add_special_tokens=False).ids, "<u4").tobytes() for m in new if "\n" in m}
        ids |= made
        if len(self.small) < MATCHES:
            self.small.update((m, x) for m, x in made.items() if len(m) <= LONG_PIECE)
        find = ids.__getitem__
        for x, ms in cut.items():
            out[x] = b"".join(map(find, ms))
        return out

    def _cut(self, piece: str, lead: str) -> list[str]:
        """The pattern's matches in a piece after its lead. Most are letters with marks after them, or such parts at single line breaks,
        which need no pattern: letters are one match, so are marks, and so is a line break between two that aren't white space."""
        out = []
        for part in piece.split("\n"):
            word = part.rstrip(MARKS)
            if not word.isalpha():
                return self.matches.findall(lead + piece)
            out += (word if out else lead + word, part[len(word) :], "\n") if len(word) < len(part) else (word if out else lead + word, "\n")
        return out[:-1]

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """The place of each piece among the known ones, else -1."""
        return pc.fill_null(pc.index_in(pieces, value_set=self.known), -1).to_numpy(zero_copy_only=False)

    def _ids(self, pieces: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For different pieces that follow a space, where the ids of each start, how many they are, and the ids. The first pieces seen,
        which are the frequent ones, are remembered."""
        place = self._places(pieces)
        gaps = np.flatnonzero(place < 0)
        starts, lengths = np.zeros(len(pieces), np.int64), np.zeros(len(pieces), np.int64)
        starts[place >= 0], lengths[place >= 0] = self.starts[place[place >= 0]], self.lengths[place[place >= 0]]
        if not len(gaps):
            return starts, lengths, self.known_ids
        new = pieces.take(pa.array(gaps))
        names = new.to_numpy(zero_copy_only=False).tolist()
        fresh = self._fresh(names, " ")
        made = [fresh[x] for x in names]
        lengths[gaps] = np.fromiter(map(len, made), np.int64, len(made)) // 4
        starts[gaps] = len(self.known_ids) + np.cumsum(lengths[gaps]) - lengths[gaps]
        ids = np.concatenate([self.known_ids, np.frombuffer(b"".join(made), "<u4")])
        if len(self.known) < PIECES:
            short = pc.less_equal(pc.utf8_length(new), LONG_PIECE)
            kept = gaps[short.to_numpy(zero_copy_only=False)]
            self.known = pa.concat_arrays([self.known, new.filter(short)])
            self.lengths = np.append(self.lengths, lengths[kept])
            # Without those of long pieces.
            self.known_ids = np.concatenate([self.known_ids, np.frombuffer(b"".join([x for x, keep in zip(made, short.to_pylist(), strict=True) if keep]), "<u4")])
            self.starts = np.cumsum(self.lengths) - self.lengths
        return starts, lengths, ids

    def _slow(self, text: str) -> bytes:
        """A text in which spaces stand beside other white space."""
        first, *rest = _SAFE_SPACE.split(text)
        numbered = pa.array(rest, pa.string()).dictionary_encode()
        starts, lengths, ids = self._ids(numbered.dictionary)
        own = [ids[a : a + n].tobytes() for a, n in zip(starts.tolist(), lengths.tolist(), strict=True)]
        return self._fresh([first], "")[first] + b"".join([own[i] for i in numbered.indices.to_pylist()])

    def encode(self, texts: pa.Array) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers, put together.

        Arrow splits the texts and numbers their different pieces; ids are then gathered by those numbers."""
        texts = pc.fill_null(texts.cast(pa.string()), "")
        slow = pc.match_substring_regex(texts, _UNSAFE).to_numpy(zero_copy_only=False)
        out: list[bytes] = [b""] * len(texts)
        for i in np.flatnonzero(slow).tolist():
            out[i] = self._slow(texts[i].as_py())
        plain = np.flatnonzero(~slow)
        if not len(plain):
            return out
        split = pc.split_pattern(texts.take(pa.array(plain)), " ")
        ends, numbered = np.asarray(split.offsets), split.values.dictionary_encode()
        codes, different = np.asarray(numbered.indices).astype(np.int64), numbered.dictionary
        firsts = different.take(pa.array(codes[ends[:-1]])).to_pylist()
        of_first = self._fresh(list(dict.fromkeys(firsts)), "")
        used = np.ones(len(codes), bool)
        used[ends[:-1]] = False
        place = np.flatnonzero(np.bincount(codes[used], minlength=len(different)))
        starts, lengths, ids = self._ids(different.take(pa.array(place)))
        renumber = np.zeros(len(different), np.int64)
        renumber[place] = np.arange(len(place))
        codes = renumber[codes]
        codes[ends[:-1]] = len(place) + np.arange(len(firsts))
        begun = [of_first[x] for x in firsts]
        more = np.fromiter(map(len, begun), np.int64, len(begun)) // 4
        starts, lengths = np.append(starts, len(ids) + np.cumsum(more) - more), np.append(lengths, more)
        ids = np.append(ids, np.frombuffer(b"".join(begun), "<u4"))
        n = lengths[codes]
        after = np.cumsum(n)
        index = np.repeat(starts[codes] - (after - n), n)
        index += np.arange(len(index))
        packed, at = ids[index].tobytes(), (np.append(0, after)[ends] * 4).tolist()
        for i, a, z in zip(plain.tolist(), at, at[1:], strict=False):
            out[i] = packed[a:z]
        return out

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))

    def offsets(self, text: str) -> tuple[list[int], list[tuple[int, int]]]:
        """Ids and the character span of each; ids that share a character share its span."""
        e = self.tokenizer.encode(text, add_special_tokens=False)
        return e.ids, e.offsets


def _slices(batches: Iterator[pa.RecordBatch], most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Smaller batches, of a row or about `most` bytes of text, so that long texts stay small once encoded."""
    for b in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(b.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        a = 0
        while a < b.num_rows:
            z = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + most, "right")))
            yield b.slice(a, z - a)
            a = z


def _lists(chunks: list[bytes], kind: pa.DataType) -> pa.ListArray:
    """The 32-bit integers of each chunk as one list."""
    ends = np.cumsum([0, *map(len, chunks)], dtype=np.int64) // 4
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.Array.from_buffers(kind, int(ends[-1]), [None, pa.py_buffer(b"".join(chunks))]))


def encode(docs: DataFrame, path: str, with_offsets: bool = False) -> DataFrame:
    """Adds ids (array of int) to documents; with_offsets also starts and ends, the span of characters of each id."""
    added = ["ids", "starts", "ends"] if with_offsets else ["ids"]
    kept = [f for f in docs.schema.fields if f.name not in added]
    schema = T.StructType([*kept, *[T.StructField(x, T.ArrayType(T.IntegerType())) for x in added]])

    def run(batches):
        codec = Codec.of(path)
        for b in _slices(batches):
            if with_offsets:
                found = [codec.offsets(x or "") for x in b.column("text").to_pylist()]
                new = [[ids for ids, _ in found], [[a for a, _ in at] for _, at in found], [[z for _, z in at] for _, at in found]]
                arrays = [pa.array(x, pa.list_(pa.int32())) for x in new]
            else:
                arrays = [_lists(codec.encode(b.column("text")), pa.int32())]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], *arrays], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def decode(docs: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Replaces the column of ids by text, the decoded characters."""
    kept = [f for f in docs.schema.fields if f.name not in (ids, "text")]
    schema = T.StructType([*kept, T.StructField("text", T.StringType())])

    def run(batches):
        codec = Codec.of(path)
        for b in batches:
            texts = [None if x is None else codec.decode(x).decode("utf-8", "replace") for x in b.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in kept], pa.array(texts, pa.string())], names=[f.name for f in schema])

    return docs.mapInArrow(run, schema)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every document: encoded, and decoded again from the ids."""

    def run(batches):
        codec = Codec.of(path)
        number = [str(i) for i in range(len(codec.bytes))]
        for b in _slices(batches):
            n, ids_sha, decoded_sha = [], [], []
            for packed in codec.encode(b.column("text")):
                ids = np.frombuffer(packed, "<u4").tolist()
                n.append(len(ids))
                ids_sha.append(hashlib.sha256(",".join(map(number.__getitem__, ids)).encode()).hexdigest())
                decoded_sha.append(hashlib.sha256(codec.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def write_tokens(docs: DataFrame, path: str, target: str, end_id: int = 0, partitions: int | None = None) -> None:
    """Writes the ids of every document, closed by end_id, as ORC in ascending order of doc_id.

    Rows: part and seq (the file's place in the order, the row's place in its file), doc_id, n_tokens, ids. Ids are run-length
    encoded; stripes are read in parallel; row indexes and Bloom filters on doc_id let a reader skip what it doesn't ask for.
    Null ids come first; documents of equal id are ordered by a hash of their text."""
    order = ["doc_id", "__tie"]
    ranged = docs.select("doc_id", "text", F.xxhash64("text").alias("__tie"))
    ranged = (ranged.repartitionByRange(partitions, *order) if partitions else ranged.repartitionByRange(*order)).sortWithinPartitions(*order)

    def run(batches):
        codec, seq, end = Codec.of(path), 0, int(end_id).to_bytes(4, "little")
        for b in _slices(batches):
            ids = _lists([x + end for x in codec.encode(b.column("text"))], pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(range(seq, seq + b.num_rows), pa.int64()), ids], names=["doc_id", "seq", "ids"])
            seq += b.num_rows

    encoded = ranged.mapInArrow(run, "doc_id long, seq long, ids array<int>")
    out = encoded.select(F.spark_partition_id().alias("part"), "seq", "doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids")
    out.write.options(**{"orc.compress": "ZSTD", "orc.stripe.size": str(16 << 20), "orc.row.index.stride": "1000", "orc.bloom.filter.columns": "doc_id", "orc.bloom.filter.fpp": "0.01"}).orc(target)


def read_tokens(spark: SparkSession, target: str, doc_ids: list[int] | None = None) -> DataFrame:
    """The rows of token files; with doc_ids only those documents', found by file and stripe statistics and Bloom filters."""
    out = spark.read.schema("part int, seq long, doc_id long, n_tokens long, ids array<int>").orc(target)
    return out if doc_ids is None else out.where(F.col("doc_id").isin(doc_ids))


def token_index(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of token files.

    Starts are summed inside each file, then shifted by the ids of the files before it: one row a file."""

    def run(batches):
        for b in batches:
            ids = b.column("ids")
            flat, ends = memoryview(ids.values.buffers()[1] or b""), (np.asarray(ids.offsets, np.int64) + ids.values.offset) * 4
            crc = [zlib.crc32(flat[a:z]) for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            counts = np.diff(ends) // 4
            yield pa.RecordBatch.from_arrays([b.column("part"), b.column("seq"), b.column("doc_id"), pa.array(counts, pa.int64()), pa.array(crc, pa.int64())], names=["part", "seq", "doc_id", "n_tokens", "ids_crc32"])

    rows = tokens.select("part", "seq", "doc_id", "ids").mapInArrow(run, "part int, seq long, doc_id long, n_tokens long, ids_crc32 long")
    sizes = tokens.groupBy("part").agg(F.sum("n_tokens").alias("__all"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    shifts = sizes.select(F.col("part").alias("__part"), F.coalesce(F.sum("__all").over(before), F.lit(0)).alias("__shift"))
    inside = W.partitionBy("part").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("__in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0)))
    return rows.join(shifts, F.col("part") == F.col("__part")).select("doc_id", (F.col("__shift") + F.col("__in")).alias("start"), "n_tokens", "ids_crc32")


def op4_byte_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), path or public_tokenizers.path(RANKS))


def op7_token_files(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    target = new_path(spark, "tokens")
    write_tokens(table(spark, sf_dir, "documents"), path or public_tokenizers.path(MODEL), target)
    return token_index(read_tokens(spark, target))
