"""Secret scans against searches from left to right, and keys with right and wrong checksums."""

import hashlib
import random
import re
import zlib

from scourframe.llm import secrets
from tests.llm.conftest import SF, TEXTS

ASSIGN = re.compile(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")


def plain(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m.group(2)) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 24]
    return [(("assign", "access", "hex")[k], b, e) for b, k, e in sorted(found)]


def base62(n):
    out = ""
    for _ in range(6):
        n, rest = divmod(n, 62)
        out = secrets.BASE62[rest] + out
    return out


def base58check(data):
    n = int.from_bytes(data + hashlib.sha256(hashlib.sha256(data).digest()).digest()[:4], "big")
    out = ""
    while n:
        n, rest = divmod(n, 58)
        out = secrets.BASE58[rest] + out
    return out


TOKEN_BODY = "a1B2c3D4e5F6g7H8i9J0k1L2m3N4o5"
TOKEN = "ghp_" + TOKEN_BODY + base62(zlib.crc32(TOKEN_BODY.encode()))
XPRV = base58check(bytes.fromhex("0488ade4") + bytes(range(74)))
#: A published example of a bech32 secret key.
NSEC = "nsec1vl029mgpspedva04g90vltkh6fvh240zqtv9k0t9af8935ke9laqsnlfe5"


def test_base_kinds_equal_a_search_from_left_to_right():
    draw = random.Random(11)
    parts = ["password", "PassWd", "secret", "token", "api_key", "APIKEY", "AKIA", "akia", "=", ":", " ", "'", '"', "abcdef0123", "DEADBEEF", "x/+_.=-", "İ", "ſecret", "toKen", "Z9", "\n", "é", "0" * 24, "ABCDEFGHIJKLMNOP"]
    for _ in range(20_000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(1, 14)))
        assert [s for s in secrets.secrets_of(text) if s[0] in secrets.BASE_KINDS] == plain(text), text


def test_checksums_decide():
    assert XPRV.startswith("xprv") and len(XPRV) == 111
    for kind, key in (("token_crc32", TOKEN), ("token_crc32", "npm_" + TOKEN[4:]), ("key_base58check", XPRV), ("key_bech32", NSEC)):
        text = f"see {key}, please"
        assert (kind, 4, 4 + len(key)) in secrets.secrets_of(text)
        for at in range(len(key) - 8, len(key)):  # one letter exchanged
            other = next(c for c in "qp2z" if c != key[at])
            assert not [s for s in secrets.secrets_of(f"see {key[:at]}{other}{key[at + 1:]}, please") if s[0] == kind]
        assert not [s for s in secrets.secrets_of(f"see x{key}") + secrets.secrets_of(f"{key}x") if s[0] == kind]


def test_odd_rows(spark, odd, none):
    rows = secrets.scan_secrets(odd).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(i) for i, _ in TEXTS)
    assert not any(r.secrets for r in rows)
    assert secrets.scan_secrets(none).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000 + "token = abcdef" + " " * 100_000 + "secret", "s")], "doc_id long, text string, secrets string")
    assert [tuple(s) for s in secrets.scan_secrets(long).first().secrets] == [("assign", 1_000_000, 1_000_014, "token = abcdef")]


def test_op13(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    more = [(900, f"password: hunter22 {TOKEN} {'0a' * 12}"), (901, "AKIA" + "Q" * 16 + " AKIAshort"), (902, None)]
    docs.unionByName(spark.createDataFrame(more, "doc_id long, text string"), allowMissingColumns=True).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()}
    rows = secrets.op13_secret_scan(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(texts) and len(rows) == len(texts)
    for r in rows:
        want = plain(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(s[0] == k for s in want) for k in secrets.BASE_KINDS)
        assert r.base_sha256 == hashlib.sha256(",".join(f"{k}:{b}:{e}" for k, b, e in want).encode()).hexdigest()
        assert set(f"{k}:{b}:{e}" for k, b, e in want) <= set(r.spans.split(",")) | {""}
    one = next(r for r in rows if r.doc_id == 900)
    assert one.spans == f"assign:0:18,token_crc32:19:{19 + len(TOKEN)},hex:{20 + len(TOKEN)}:{44 + len(TOKEN)}"
