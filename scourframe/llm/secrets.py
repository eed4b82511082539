"""Secret scans: a keyword automaton, anchored patterns at its hits only, and keys that prove themselves by a checksum."""

from __future__ import annotations

import hashlib
import itertools
import re
import zlib
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scourframe.llm import common

# Alphabets of the encodings, generator of the bech32 checksum, prefixes and lengths of published key formats.
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BECH32 = "qpzry9x8gf2tvdw0s3jn54khce6mua7l"
BECH32_GENERATOR = (0x3B6A57B2, 0x26508E6D, 0x1EA119FA, 0x3D4233DD, 0x2A1462B3)
#: Kinds that a pattern alone decides, in the order in which they are listed, and kinds that a checksum decides.
BASE_KINDS = ("assign", "access", "hex")
CHECKED_KINDS = ("token_crc32", "key_base58check", "key_bech32")
KINDS = BASE_KINDS + CHECKED_KINDS
LEAST_VALUE, LEAST_ACCESS, LEAST_HEX = 6, 20, 24

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{%d,}" % LEAST_HEX)
TOKEN = re.compile(r"(?<![A-Za-z0-9])(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
XPRV = re.compile(r"(?<![A-Za-z0-9])xprv[%s]{107}(?![A-Za-z0-9])" % BASE58)
AGE = re.compile(r"(?<![A-Za-z0-9])(?:AGE-SECRET-KEY-1[%s]{58}|nsec1[%s]{58})(?![A-Za-z0-9])" % (BECH32.upper(), BECH32))
HEX_DIGITS, HEX_GRAM = "0123456789abcdef", 4
KEYWORDS = {
    "assign": ("password", "passwd", "secret", "token", "apikey", "api_key"),
    "access": ("akia",),
    "token_crc32": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_"),
    "key_base58check": ("xprv",),
    "key_bech32": ("age-secret-key-1", "nsec1"),
}


def crc32_matches(body: str, check: str) -> bool:
    """Whether `check` is the CRC-32 of `body` in base 62, padded to its length."""
    value = 0
    for letter in check:
        value = value * 62 + BASE62.index(letter)
    return value == zlib.crc32(body.encode())


def base58_matches(text: str) -> bool:
    """Whether the last four bytes of a base-58 number of 82 bytes are the head of the double SHA-256 of the others."""
    value = 0
    for letter in text:
        value = value * 58 + BASE58.index(letter)
    if value >> 8 * 82:
        return False
    data = value.to_bytes(82, "big")
    return hashlib.sha256(hashlib.sha256(data[:-4]).digest()).digest()[:4] == data[-4:]


def bech32_matches(text: str) -> bool:
    """Whether the polynomial checksum of a bech32 text comes to one."""
    head, _, data = text.lower().rpartition("1")
    state = 1
    for value in [*(ord(c) >> 5 for c in head), 0, *(ord(c) & 31 for c in head), *map(BECH32.index, data)]:
        top = state >> 25
        state = (state & 0x1FFFFFF) << 5 ^ value
        for i, generator in enumerate(BECH32_GENERATOR):
            if top >> i & 1:
                state ^= generator
    return state == 1


@lru_cache(maxsize=1)
def automaton():
    """All keywords, and every run of HEX_GRAM hexadecimal digits, in one automaton: a hit names its kind and its length."""
    machine = ahocorasick.Automaton()
    for kind, words in KEYWORDS.items():
        for word in words:
            machine.add_word(word, (kind, len(word)))
    for gram in itertools.product(HEX_DIGITS, repeat=HEX_GRAM):
        machine.add_word("".join(gram), ("hex", HEX_GRAM))
    machine.make_automaton()
    return machine


def found_at(kind: str, text: str, at: int) -> tuple[int, bool]:
    """End of the pattern of `kind` that begins at `at` (0 if none does), and whether the match counts."""
    if kind == "hex":
        match = HEX.match(text, at)
        return (match.end(), True) if match else (0, False)
    if kind == "assign":
        match = ASSIGN.match(text, at)
        return (match.end(), len(match.group(2)) >= LEAST_VALUE) if match else (0, False)
    if kind == "access":
        match = ACCESS.match(text, at)
        return (match.end(), match.end() - at >= LEAST_ACCESS) if match else (0, False)
    if kind == "token_crc32":
        match = TOKEN.match(text, at)
        return (match.end(), crc32_matches(*match.groups())) if match else (0, False)
    match = (XPRV if kind == "key_base58check" else AGE).match(text, at)
    if not match:
        return 0, False
    return match.end(), (base58_matches if kind == "key_base58check" else bech32_matches)(match.group())


def secrets_of(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, begin, end) of the secrets of a text, by begin and then by the order of KINDS.

    The automaton reads a lower-cased copy, in which every letter keeps its place; a pattern is tried only where a keyword of its
    kind begins. Matches of one kind do not overlap, and one that fails its condition still takes up its letters, as in a search from left
    to right. A run of hexadecimal digits begins at the first hit behind the last run, for the hit before it would have been inside of it.
    """
    if not text:
        return []
    lowered = text.replace("İ", "i").lower()  # the one letter whose small form has another length
    end_of = dict.fromkeys(KINDS, 0)
    spans = []
    for last, (kind, length) in automaton().iter(lowered):
        begin = last - length + 1
        if begin < end_of[kind]:
            continue
        end, counts = found_at(kind, text, begin)
        if end:
            end_of[kind] = end
            if counts:
                spans.append((begin, KINDS.index(kind), end))
    return [(KINDS[k], begin, end) for begin, k, end in sorted(spans)]


SPANS = "array<struct<kind:string,begin:int,end:int,value:string>>"


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The secrets of every whole text: id_col and `secrets`, a list of (kind, begin, end, value) in code points, end exclusive.

    `assign` is a value given to a password, secret, token or key by name, `access` an access key by its prefix, `hex` a run of hexadecimal
    digits; the other kinds are keys of published formats and are listed only if the checksum inside of them is right: tokens with a
    CRC-32 in base 62, extended private keys in base 58 with a double SHA-256, and bech32 secret keys. A projection: no exchange.

    A null or empty text has no secrets. A null id stays null, repeated rows are each scanned, an empty table gives no rows. Other
    columns are not read.
    """
    kind = dict(docs.select(id_col).dtypes)[id_col]
    item = pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("value", pa.string())])

    def scan(batches):
        for batch in batches:
            rows = []
            for value in batch.column(1):
                text = value.as_py()
                rows.append([{"kind": k, "begin": b, "end": e, "value": text[b:e]} for k, b, e in secrets_of(text)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.list_(item))], [id_col, "secrets"])

    return docs.select(id_col, text_col).mapInArrow(scan, f"`{id_col}` {kind}, secrets {SPANS}")


def spelled(secrets: Column) -> Column:
    """The spans as kind:begin:end, joined by commas."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["begin"].cast("string"), s["end"].cast("string"))), ",")


def op13_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Contract: all documents; the base kinds are counted and digested, all spans are spelled out."""
    found = scan_secrets(common.table(spark, sf_dir, "documents"))
    base = F.filter("secrets", lambda s: s["kind"].isin(*BASE_KINDS))
    kinds = F.transform("secrets", lambda s: s["kind"])
    counts = [(F.size("secrets") - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(spelled(base).cast("binary"), 256).alias("base_sha256"), spelled(F.col("secrets")).alias("spans"))
