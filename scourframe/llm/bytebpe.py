"""Byte-level BPE over a whole table: each distinct pre-token is encoded once, wherever it occurs."""

from __future__ import annotations

import base64
import itertools
import re
import uuid
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common
from scourframe.session import shared_dir

#: Characters of text whose pre-tokens share one list of distinct words; one longer text has a list of its own.
CHUNK_CHARS = 6_000_000
#: Level at which lists and positions are compressed.
LEVEL = 6
#: A space before white space or the end: such texts are not split at single spaces.
ODD = re.compile(r" (?:\s|\Z)")


def ranks_of(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


@lru_cache(maxsize=2)
def word_encoder(path: str):
    """An encoder that takes each string whole."""
    import tiktoken

    return tiktoken.Encoding("words", pat_str=r"(?s:.+)", mergeable_ranks=ranks_of(path), special_tokens={})


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The token-byte table: as long as the vocabulary, whatever the input."""
    ranks = ranks_of(path)
    table = [b""] * (max(ranks.values()) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    return table


def packed(numbers: np.ndarray) -> bytes:
    """Unsigned 32-bit numbers by byte planes, compressed."""
    return zstandard.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), LEVEL)


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def blob(words: list[str]) -> bytes:
    """Words with their lengths in bytes, compressed."""
    data = [word.encode("utf-8", "surrogatepass") for word in words]
    sizes = np.fromiter(map(len, data), "<u4", len(data))
    return zstandard.compress(len(data).to_bytes(4, "little") + sizes.tobytes() + b"".join(data), LEVEL)


def words_in(data: bytes) -> list[str]:
    data = zstandard.decompress(data)
    n = int.from_bytes(data[:4], "little")
    ends = (4 + 4 * n + np.cumsum(np.frombuffer(data, "<u4", n, 4), dtype=np.int64)).tolist()
    return [data[a:b].decode("utf-8", "surrogatepass") for a, b in zip([4 + 4 * n, *ends], ends)]


def ragged(values: np.ndarray, starts: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs of `values` named by `at`, one after another."""
    n = counts[at]
    ends = np.cumsum(n)
    return values[np.repeat(starts[at] - (ends - n), n) + np.arange(ends[-1] if len(at) else 0)]


class Chunk:
    """Distinct words of a run of texts, and each text as positions in that list."""

    def __init__(self, pattern):
        self.pattern = pattern
        self.words: dict[str, int] = {}
        self.segments: dict[str, int] = {}
        self.values, self.starts, self.counts = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.texts: list[np.ndarray] = []
        self.chars = 0

    def numbers(self, text: str) -> list[int]:
        return [self.words.setdefault(word, len(self.words)) for word in self.pattern.findall(text)]

    def learn(self, segments: list[str]) -> None:
        """Match each new segment, with the space before it, once."""
        new = [x for x in segments if x not in self.segments]
        own = [self.numbers(f" {segment}") for segment in new]
        counts = np.fromiter(map(len, own), np.int64, len(own))
        values = np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(counts.sum()))
        self.starts = np.append(self.starts, np.cumsum(counts) - counts + len(self.values))
        self.values, self.counts = np.append(self.values, values), np.append(self.counts, counts)
        self.segments.update(zip(new, range(len(self.segments), len(self.segments) + len(new))))

    def add(self, texts: list[str]) -> None:
        """Words never reach across a single space that a visible character follows, so texts are split there first."""
        odd = [bool(ODD.search(text)) for text in texts]
        split = pc.split_pattern(pa.array(["" if x else text for x, text in zip(odd, texts)], pa.large_string()), " ")
        coded = split.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        self.learn(distinct)
        codes = np.fromiter(map(self.segments.__getitem__, distinct), np.int64, len(distinct))[coded.indices.to_numpy()]
        offsets = split.offsets.to_numpy()
        for i, text in enumerate(texts):
            if odd[i]:
                found = np.array(self.numbers(text), np.uint32)
            else:
                first = np.array(self.numbers(text.partition(" ")[0]), np.uint32)
                found = np.concatenate([first, ragged(self.values, self.starts, self.counts, codes[offsets[i] + 1: offsets[i + 1]])])
            self.texts.append(found)
            self.chars += len(text)

    def finish(self) -> tuple[list[str], list[np.ndarray]]:
        """Words by falling count, so that most positions are small."""
        words = list(self.words)
        seen = np.zeros(len(words), np.int64)
        for text in self.texts:
            seen += np.bincount(text, minlength=len(words)) if len(text) * 20 > len(words) else 0
            if len(text) * 20 <= len(words):
                np.add.at(seen, text, 1)
        order = np.argsort(-seen, kind="stable")
        to = np.empty(len(words), np.uint32)
        to[order] = np.arange(len(words))
        return [words[i] for i in order], [to[text] for text in self.texts]


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    """Write `df` to the shared folder in buckets of `key`, so that its rows need no further exchange to meet others by it."""
    spark = df.sparkSession
    name = f"scourframe_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).option("path", f"{shared_dir(spark).rstrip('/')}/{name}").format("parquet").saveAsTable(name)
    table = spark.table(name)
    table.schema  # resolved; the files stay when the name goes
    spark.sql(f"DROP TABLE {name}")
    return table


def encode(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", as_bytes: bool = False) -> DataFrame:
    """Token ids of every whole text: id_col and `ids` (array of int, or little-endian unsigned 32-bit numbers `as_bytes`), a row for each row of `docs`.

    Each task turns its texts into lists of distinct pre-tokens and positions in them, which are written to the shared folder.
    The distinct words of all lists meet by their hash, each is encoded once, and its ids return to the lists it came from;
    there the texts, which lie in buckets of their lists and are not moved, are put together again by position. A word used everywhere is one entry a list, so no key is hot, and a
    list is bounded by CHUNK_CHARS. Words and positions travel as compressed blocks.

    Null and empty texts have no ids. Null ids and repeated rows are rows like any other. An empty table gives no rows.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    texts = docs.select(id_col, text_col)
    partitions = docs.sparkSession.conf.get("spark.sql.shuffle.partitions")
    n_buckets = max(int(partitions), 2 * texts.rdd.getNumPartitions())

    def split(batches):
        import regex

        compiled = regex.compile(pattern)
        task, serial, chunk, names = TaskContext.get().partitionId(), 0, Chunk(compiled), []

        def flushed():
            words, found = chunk.finish()
            number = (task << 20) + serial
            n = len(found)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, number)), pa.concat_arrays(names), pa.array([packed(x) for x in found], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())], fields)
            of = np.fromiter((zlib.crc32(word.encode("utf-8", "surrogatepass")) % n_buckets for word in words), np.int64, len(words))
            order = np.argsort(of, kind="stable")
            cuts = np.flatnonzero(np.diff(of[order], prepend=-1, append=-1))
            rows = [(int(of[order[a]]), order[a:b]) for a, b in zip(cuts[:-1], cuts[1:])]
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(len(rows), number)), pa.nulls(len(rows), names[0].type), pa.nulls(len(rows), pa.binary()), pa.array([b for b, _ in rows], pa.int32()), pa.array([packed(x) for _, x in rows], pa.binary()),
                pa.array([blob([words[i] for i in x]) for _, x in rows], pa.binary())], fields)

        for batch in batches:
            for at, block in common.blocks([x or "" for x in batch.column(1).to_pylist()], 2_000_000):
                names.append(batch.column(0).slice(at, len(block)))
                chunk.add(block)
                if chunk.chars >= CHUNK_CHARS:
                    yield from flushed()
                    serial, chunk, names = serial + 1, Chunk(compiled), []
        if names:
            yield from flushed()

    fields = ["chunk", "doc", "positions", "bucket", "numbers", "words"]
    schema = f"chunk long, doc {kind}, positions binary, bucket int, numbers binary, words binary"
    lists = bucketed(texts.mapInArrow(split, schema), "chunk", n_buckets)

    def learn(table: pa.Table) -> pa.Table:
        encoder = word_encoder(ranks)
        number: dict[str, int] = {}
        at = []
        for data in table.column("words"):
            words = words_in(data.as_py())
            at.append(np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words)))
        own = [encoder.encode_ordinary(word) for word in number]
        counts = np.fromiter(map(len, own), np.int64, len(own))
        values = np.fromiter(itertools.chain.from_iterable(own), np.uint32, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        return pa.table({
            "chunk": table.column("chunk"), "numbers": table.column("numbers"),
            "counts": pa.array([packed(counts[x]) for x in at], pa.binary()),
            "ids": pa.array([packed(ragged(values, starts, counts, x)) for x in at], pa.binary())})

    found = lists.filter("bucket is not null").select("chunk", "bucket", "numbers", "words").groupBy("bucket").applyInArrow(learn, "chunk long, numbers binary, counts binary, ids binary")

    def together(texts: pa.Table, words: pa.Table) -> pa.Table:
        parts = [[unpacked(x.as_py()) for x in words.column(c)] for c in ("numbers", "counts", "ids")]
        at, n, values = (np.concatenate(x) if x else np.zeros(0, np.uint32) for x in parts)
        counts, starts = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        counts[at], starts[at] = n, np.cumsum(n, dtype=np.int64) - n
        ids = (ragged(values, starts, counts, unpacked(x.as_py())) for x in texts.column("positions"))
        if as_bytes:
            return pa.table({id_col: texts.column("doc"), "ids": pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary())})
        return pa.table({id_col: texts.column("doc"), "ids": pa.array([x.astype(np.int32) for x in ids], pa.list_(pa.int32()))})

    placed = lists.filter("positions is not null").select("chunk", "doc", "positions")
    kinds = "binary" if as_bytes else "array<int>"
    return placed.groupBy("chunk").cogroup(found.groupBy("chunk")).applyInArrow(together, f"`{id_col}` {kind}, ids {kinds}")


def decode(encoded: DataFrame, ranks: str, ids_col: str = "ids", to: str = "decoded") -> DataFrame:
    """Append the bytes of `ids_col` (array of int, or bytes as from `encode`) in column `to`: a join with the token-byte table, which is as
    long as the vocabulary and held by every task, so that nothing is exchanged.

    Null ids give null, empty ones give no bytes; an id outside of the table is an error; an empty table stays empty.
    """
    kept = [c for c in encoded.columns if c != to]
    at = kept.index(ids_col)

    def join(batches):
        table = token_bytes(ranks)
        for batch in batches:
            column = []
            for value in batch.column(at):
                if not value.is_valid:
                    column.append(None)
                    continue
                ids = np.frombuffer(value.as_py(), "<u4") if isinstance(value, pa.BinaryScalar) else value.values.to_numpy()
                column.append(b"".join(map(table.__getitem__, ids.tolist())))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(column, pa.binary())], [*kept, to])

    schema = encoded.select(*kept).schema.add(to, "binary")
    return encoded.select(*kept).mapInArrow(join, schema)


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """Contract: all documents by the multilingual ranks, and back; digests of the ids and of the bytes."""
    import public_tokenizers

    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    whole = decode(encode(common.table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN, as_bytes=True), ranks)
    return whole.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
