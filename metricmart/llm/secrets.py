"""Secret scans by dictionary-primed zstandard novelty (operator 11).

Three fixed shapes are always reported: an assignment to a sensitive name (``assign``; the span is the whole match), an
access key (``access``) and a run of hexadecimal digits (``hex``). Beyond these, a string that follows a sensitive word
in its line is a candidate. Its novelty is the share of its bytes that zstandard still has to write when primed with a
dictionary of known identifiers and with the code around the candidate: an identifier, a placeholder or a value that
the surroundings explain costs little, a random key all of its bytes. Candidates of ``least`` novelty or more that no
fixed shape covers are reported as ``novel``. All spans carry their novelty.

* The dictionary holds the identifiers that stand most often in the surroundings of all candidates and fixed shapes of
  all documents, counted once for each distinct surrounding, so copies of a document don't make its secret known. Only
  words of letters and underscores enter it; ``dictionary_bytes`` bounds it, and so what is broadcast.
* A value's own repeats are cut from its surroundings, so a secret said twice stays novel.
* Values are measured in pieces of ``PIECE`` bytes, too short for zstandard to code literals by frequency: a byte that
  nothing before explains costs a byte, whatever the alphabet. Work is linear in a value's length.

Spans count code points, the end exclusive. Null texts count as empty and empty texts have no spans. Rows are
independent, so null and repeated ids and repeated rows matter nothing: each row has its result. Spans come by start,
then kind (``KINDS``), which leaves no ties: matches of a kind don't overlap. Texts are searched whole, whatever their
length. Extra columns pass through, but for ``spans``, which is replaced. An empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from metricmart.llm import kernel

KINDS = ("assign", "access", "hex", "novel")
PIECE = 48
SPAN = "struct<kind:string,start:long,end:long,value:string,novelty:double>"
_FOUND = "array<struct<kind:int,start:long,end:long,value:string,around:string>>"
# of lower-cased bytes, so letters of either case match
_ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
_HEX = re.compile(rb"[0-9a-f]{16,}")  # maximal runs, as those of any length less the short ones
_SENSITIVE = re.compile(rb"pass(?:word|wd|phrase)|\bpwd\b|secret|token|bearer|credential|\bauth(?:orization)?\b|(?:api|access|private|signing|encryption)[_-]?key")
_VALUE = re.compile(rb"[A-Za-z0-9+/_.=-]{12,}")
_IS_HEX = bytes(c in b"0123456789abcdef" for c in range(256))
#: One of these is in every lower-cased text that the two patterns of names can match in.
_HINTS = (b"pass", b"pwd", b"secret", b"token", b"bearer", b"credential", b"auth", b"api", b"key")
_INSIDE = frozenset(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-") | frozenset(range(0x80, 0x100))
#: Words of the dictionary before any corpus is read (fixed values).
COMMON = ("http", "https", "www", "example", "localhost", "config", "settings", "environment", "password", "secret", "token", "bearer", "access", "private", "public", "client", "server", "service", "account", "default", "value", "string", "your_api_key_here", "changeme", "placeholder", "/usr/local/lib/python", "/usr/share/doc", "/home/user", "//www.example.com/api/v1", "javascript", "version", "authorization")

_KNOWN = " ".join(COMMON).encode()


def _wanted_shape(value: bytes) -> bool:
    """Three letters or more, and a digit or both cases after the first character."""
    letters = sum(65 <= c <= 90 or 97 <= c <= 122 for c in value)
    rest = value[1:]
    return letters >= 3 and (any(48 <= c <= 57 for c in value) or (any(65 <= c <= 90 for c in rest) and any(97 <= c <= 122 for c in rest)))


def spans_of(text: bytes, reach: int = 64) -> list[tuple[int, int, int, int, int]]:
    """(kind, start, end, value's start, value's end) in bytes: all fixed shapes, and candidates that touch none."""
    low = text.lower()
    named = any(hint in low for hint in _HINTS)
    found = [(0, *m.span(), *m.span(1)) for m in _ASSIGN.finditer(low) if len(m[1]) >= 12] if named else []
    if b"AKIA" in text:
        found += [(1, *m.span(), *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 18]
    if b"\1" * 16 in text.translate(_IS_HEX):
        found += [(2, *m.span(), *m.span()) for m in _HEX.finditer(text)]
    taken = sorted((a, b) for _, a, b, _, _ in found)
    starts, ends, extra = [a for a, _ in taken], list(accumulate((b for _, b in taken), max)), set()
    for word in _SENSITIVE.finditer(low) if named else ():
        end = word.end() + reach
        line = text.find(b"\n", word.end(), end)
        for m in _VALUE.finditer(text, word.end(), end + 11 if line < 0 else line):
            a = m.start()
            if a >= end or text[a - 1] in _INSIDE:
                continue
            b = a + len(_VALUE.match(text, a)[0].rstrip(b"."))
            before = bisect_left(starts, b)  # fixed shapes that start before the end
            if b - a >= 12 and not (before and ends[before - 1] > a) and _wanted_shape(text[a:b]):
                extra.add((a, b))
    return sorted(found + [(3, a, b, a, b) for a, b in extra], key=lambda s: (s[1], s[0]))


def _code_points(text: bytes, at: list[int]) -> dict[int, int]:
    """The code points before each of some positions."""
    raw, out, done, n = np.frombuffer(text, np.uint8), {}, 0, 0
    for p in sorted(set(at)):
        n += int(np.count_nonzero((raw[done:p] & 0xC0) != 0x80))
        out[p], done = n, p
    return out


def _surroundings(text: bytes, a: int, b: int, reach: int) -> str:
    around = text[b : b + reach] + b" " + text[max(0, a - reach) : a]
    return around.replace(text[a:b], b" ").decode("utf-8", "ignore")


def find(docs: DataFrame, around: int = 256) -> DataFrame:
    """All columns but ``spans``, and the fixed shapes and candidates of each text with their surroundings."""
    kernel.small_batches(docs.sparkSession)
    names = [c for c in docs.columns if c != "spans"]
    others = [c for c in names if c != "text"]
    docs = docs.select(*others, F.col("text").cast("string").alias("text"))
    found = kernel.fresh(docs, "found")
    item = pa.struct([("kind", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("around", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(batch.num_columns - 1).cast(pa.binary()):
                text = text.as_py() or b""
                spans = spans_of(text)
                if not spans:
                    rows.append([])
                    continue
                point = _code_points(text, [p for _, a, b, _, _ in spans for p in (a, b)])
                rows.append([{"kind": k, "start": point[a], "end": point[b], "value": text[c:d].decode(), "around": _surroundings(text, c, d, around)} for k, a, b, c, d in spans])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(rows, pa.list_(item))], names=[*batch.schema.names[:-1], found])

    return docs.mapInArrow(scan, ", ".join([*(f"`{c}` {t}" for c, t in docs.select(others).dtypes), f"`{found}` {_FOUND}"]))


def identifiers(found: DataFrame, column: str, dictionary_bytes: int = 32768) -> bytes:
    """The identifiers of all distinct surroundings, the most frequent last, in at most so many bytes."""
    word = r"(?<![A-Za-z0-9_+/=-])[A-Za-z_]{4,32}(?![A-Za-z0-9_+/=-])"
    around = found.select(F.explode(column).alias("f")).select(F.col("f.around").alias("around")).distinct()
    counts = around.select(F.explode(F.array_distinct(F.regexp_extract_all("around", F.lit(word), F.lit(0)))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    top = [r.word for r in counts.orderBy(F.desc("n"), "word").limit(dictionary_bytes // 5).collect()]  # bounded: five bytes a word at least
    out = _KNOWN
    for w in top:
        if len(out) + len(w) >= dictionary_bytes:
            break
        out = w.encode() + b" " + out
    return out


def _compressor(known: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(known, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(value: bytes, around: bytes, known: bytes) -> float:
    """The share of the value's bytes that zstandard adds after the dictionary and the surroundings; 0 to 1."""
    if not value:
        return 0.0
    press = _compressor(known + b" " + around)
    none, cost = len(press.compress(_KNOWN)), 0  # words of the dictionary after the piece pay the fixed costs of a frame, and matches may reach the end of the piece
    for at in range(0, len(value), PIECE):
        piece = value[at : at + PIECE]
        cost += min(len(piece), max(0, len(press.compress(piece + _KNOWN)) - none))
    return cost / len(value)


def scan(docs: DataFrame, least: float = 0.9, around: int = 256, dictionary_bytes: int = 32768) -> DataFrame:
    """All columns of ``docs`` (text is read) but the text, and ``spans``. See the module for what is reported."""
    rows = kernel.stored(find(docs, around))
    column = rows.columns[-1]
    known = rows.sparkSession.sparkContext.broadcast(identifiers(rows, column, dictionary_bytes))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("novelty", pa.float64())])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, seen = [], {}
            for found in batch.column(batch.num_columns - 1).to_pylist():
                spans = []
                for f in found:
                    key = (f["value"], f["around"])
                    if key not in seen:
                        seen[key] = novelty(f["value"].encode(), f["around"].encode(), known.value)
                    if f["kind"] < 3 or seen[key] >= least:
                        spans.append({"kind": KINDS[f["kind"]], "start": f["start"], "end": f["end"], "value": f["value"], "novelty": seen[key]})
                out.append(spans)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.list_(span))], names=[*batch.schema.names[:-1], "spans"])

    return rows.mapInArrow(measure, ", ".join([*(f"`{c}` {t}" for c, t in rows.dtypes[:-1]), f"spans array<{SPAN}>"]))


def digest(scanned: DataFrame) -> DataFrame:
    """doc_id, counts by fixed shape, the hash of the fixed spans and all spans as text."""
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    fixed = F.filter("spans", lambda s: s["kind"] != "novel")
    return scanned.select("doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"), F.sha2(listed(fixed), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
