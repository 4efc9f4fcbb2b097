"""Secret scan: keyword automaton, anchored expressions at its hits, embedded checksums.

One pass over the texts, no shuffle.  The automaton finds keywords; only where
one stands is the expression of its kind tried, anchored.  Kinds whose tokens
carry a checksum or a header count only if that is right.  Long hexadecimal
runs have no keyword; one search per text finds them.
"""

from __future__ import annotations

import base64
import binascii
import json
import re
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from huetide.llm.frames import kept, table
from huetide.llm.keywords import Keywords, code_points
from huetide.llm.tokens import chunks, text_bytes

RESULT = "found array<struct<kind:string,start:long,end:long>>"
_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def crc_suffix(body: bytes) -> bytes:
    """The six base-62 digits of a body's CRC-32 that end some platforms' tokens."""
    n, out = zlib.crc32(body), ""
    while n:
        n, k = divmod(n, 62)
        out = _DIGITS[k] + out
    return out.rjust(6, "0").encode()


def _crc_right(m: re.Match[bytes]) -> bool:
    body = m[1]
    return crc_suffix(body[:-6]) == body[-6:]


def _header_right(m: re.Match[bytes]) -> bool:
    head = m[1]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + b"=" * (-len(head) % 4)))
    except (binascii.Error, ValueError):
        return False


Rule = tuple[str, tuple[str, ...], "re.Pattern[bytes]", Callable[["re.Match[bytes]"], bool]]
#: Kind, its keywords (lower case), the expression anchored at a keyword, and what else must hold.
RULES: list[Rule] = [
    (
        "assign",
        ("password", "passwd", "secret", "token", "api_key", "apikey"),
        re.compile(rb"""(password|passwd|secret|token|api_?key)(?-i:["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+))""", re.I),
        lambda m: len(m[2]) >= 6,
    ),
    ("access", ("akia",), re.compile(rb"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("platform", ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"), re.compile(rb"gh[pousr]_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_right),
    ("package", ("npm_",), re.compile(rb"npm_([A-Za-z0-9]{36})(?![A-Za-z0-9])"), _crc_right),
    ("webtoken", ("eyj",), re.compile(rb"(eyJ[A-Za-z0-9_-]{8,})\.eyJ[A-Za-z0-9_-]{4,}\.[A-Za-z0-9_-]{8,}"), _header_right),
    ("privatekey", ("-----begin ",), re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"), lambda m: True),
    ("chat", ("xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-"), re.compile(rb"xox[abprs]-[0-9A-Za-z]{8,}(?:-[0-9A-Za-z]+)+"), lambda m: True),
    ("payment", ("sk_live_", "rk_live_"), re.compile(rb"[sr]k_live_[0-9A-Za-z]{24,}"), lambda m: True),
    ("cloud", ("aiza",), re.compile(rb"AIza[0-9A-Za-z_-]{35}(?![0-9A-Za-z_-])"), lambda m: True),
]
#: Kinds whose expression begins with one run of these characters that must end before what follows: where it fails
#: at a keyword, it fails at every later keyword of the same run.
RUNS = {"webtoken": re.compile(rb"[A-Za-z0-9_-]+")}
HEX = re.compile(rb"[0-9a-f]{24,}")
KINDS = ["assign", "access", "hex", *(r[0] for r in RULES[2:])]


def find(raw: bytes, gate: Keywords, by_word: dict[str, Rule]) -> list[tuple[int, int, str]]:
    """Byte spans of a text's secrets by start, then by the order of KINDS."""
    spans = [(m.start(), m.end(), "hex") for m in HEX.finditer(raw)]
    past: dict[str, int] = {}  # where a kind may begin again
    for at, word in sorted(gate.hits(raw.lower())):
        kind, _, pattern, holds = by_word[word]
        # as a search from left to right would: nothing begins inside an earlier match of its kind, kept or not
        if at < past.get(kind, 0):
            continue
        if m := pattern.match(raw, at):
            past[kind] = m.end()
            if holds(m):
                spans.append((at, m.end(), kind))
        elif kind in RUNS and (run := RUNS[kind].match(raw, at)):
            past[kind] = run.end()
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2])))


def scan_secrets(docs: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Secrets of every text: kind and span in code points, end exclusive.

    One row per input row (repeated rows stay), with ``keep`` and RESULT.
    Null and empty texts have none.  Other input columns are ignored; a kept
    column called ``found`` gives way to the result.
    """
    carry, schema = kept(docs, keep, RESULT)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word = {w: rule for rule in RULES for w in rule[1]}
        gate = Keywords(by_word)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for whole in batches:
            for batch in chunks(whole, "_text"):
                data, at = text_bytes(batch.column("_text"))
                found = []
                for lo, hi in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
                    raw = data[lo:hi].tobytes()
                    spans = find(raw, gate, by_word)
                    place = code_points(raw, [p for s in spans for p in s[:2]]) if spans else {}
                    found.append([{"kind": k, "start": place[a], "end": place[b]} for a, b, k in spans])
                yield pa.RecordBatch.from_arrays([batch.column(c) for c in carry] + [pa.array(found, kind)], names=[*carry, "found"])

    return docs.select(*carry, F.col("text").cast("string").alias("_text")).mapInArrow(scan, schema)


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's secrets; the base kinds are assign, access and hex."""
    said = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    base = F.filter("found", lambda s: s["kind"].isin("assign", "access", "hex"))
    many = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return scan_secrets(table(spark, sf_dir, "documents")).select(
        "doc_id",
        *map(many, ("assign", "access", "hex")),
        F.sha2(F.array_join(F.transform(base, said), ",").cast("binary"), 256).alias("base_sha256"),
        F.array_join(F.transform("found", said), ",").alias("spans"),
    )
