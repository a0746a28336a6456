"""Secret scans: keyword automaton, anchored expressions near its hits, checksums of what embeds one."""

from __future__ import annotations

import base64
import hashlib
import json
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import arrow_rows

#: Kinds in the order in which they are listed, base kinds first.
BASE_KINDS = ("assign", "access", "hex")
KINDS = (*BASE_KINDS, "github", "npm", "jwt")
#: What the automaton looks for in the text with A-Z lowered, and the kind it may begin.
KEYWORDS = {"password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign", "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm", "eyj": "jwt"}
ANCHORED = {
    "assign": re.compile(r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "github": re.compile(r"gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "npm": re.compile(r"npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])"),
    "jwt": re.compile(r"eyJ[A-Za-z0-9_-]*+\.[A-Za-z0-9_-]++\.[A-Za-z0-9_-]++"),
}
#: What a JWT's head is made of; all heads that start in one such run end with it.
_JWT_RUN = re.compile(r"[A-Za-z0-9_-]++")
HEX_LEAST = 24
_HEX_RUN = re.compile(r"[0-9a-f]+")
_HEX_TWO = re.compile(r"[0-9a-f]{2,}")
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def base62_crc32(body: str) -> str:
    """CRC32 of body as six base-62 digits, as tokens of several forges and registries end with it."""
    n, out = zlib.crc32(body.encode()), ""
    for _ in range(6):
        n, d = divmod(n, 62)
        out = _BASE62[d] + out
    return out


def valid(kind: str, m: re.Match) -> bool:
    """The test that a match of its kind has to pass."""
    if kind == "assign":
        return len(m.group(1)) >= 6
    if kind == "access":
        return m.end() - m.start() >= 20
    if kind in ("github", "npm"):
        return base62_crc32(m.group()[4:-6]) == m.group()[-6:]
    head = m.group().split(".")[0]
    try:
        return "alg" in json.loads(base64.urlsafe_b64decode(head + "=" * (-len(head) % 4)))
    except (ValueError, RecursionError):  # no JSON, or nested deeper than any head
        return False


def hex_runs(text: str) -> Iterator[tuple[int, int]]:
    """Maximal runs of 24 and more [0-9a-f]: such a run covers two neighbours of every twelfth character, so only near those is looked."""
    step, end = HEX_LEAST // 2, 0
    for m in _HEX_TWO.finditer(text[::step]):
        for at in range(m.start() * step, (m.end() - 1) * step, step):
            if at < end:
                continue
            stop = _HEX_RUN.match(text, at).end()
            if stop - at <= step:
                continue
            start = at
            while start > end and text[start - 1] in "0123456789abcdef":
                start -= 1
            end = stop
            if end - start >= HEX_LEAST:
                yield start, end


def automaton():
    import ahocorasick

    a = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        a.add_word(word, (len(word), kind))
    a.make_automaton()
    return a


def find_secrets(text: str, words) -> list[tuple[int, int, str]]:
    """(start, end, kind) of every secret, by start and then kind as listed; leftmost and non-overlapping in each kind."""
    low = text.lower() if text.isascii() else text.encode().lower().decode()
    found, last = [], dict.fromkeys(ANCHORED, 0)
    for start, kind in sorted((at - n + 1, kind) for at, (n, kind) in words.iter(low)):
        if start < last[kind]:
            continue
        m = ANCHORED[kind].match(text, start)
        if m:
            last[kind] = m.end()
            if valid(kind, m):
                found.append((start, m.end(), kind))
        elif kind == "jwt":
            last[kind] = _JWT_RUN.match(text, start).end()
    found += [(a, b, "hex") for a, b in hex_runs(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each stretch that spans cover, overlapping ones together, replaced by [SECRET]."""
    out, at = [], 0
    stretch: list[list[int]] = []
    for a, b, _ in spans:
        if stretch and a <= stretch[-1][1]:
            stretch[-1][1] = max(b, stretch[-1][1])
        else:
            stretch.append([a, b])
    for a, b in stretch:
        out += [text[at:a], "[SECRET]"]
        at = b
    return "".join(out) + text[at:] if out else text


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def scan_secrets(docs: DataFrame, keep: list[str], text_col: str = "text", redact: bool = False) -> DataFrame:
    """The columns `keep` of every row, with n_assign, n_access, n_hex, base_sha256 and spans, or with redact=True those columns with the text's secrets replaced.

    One pass without a shuffle; what a task holds is a slice of a batch. Defined results: a null text has no spans (and
    stays null when redacted); repeated rows are scanned each; columns outside keep are dropped, so clashing names do
    no harm; very long texts take time in proportion, as a run of characters in which a token could start is read a
    fixed number of times; a head that nests deeper than Python's parser goes is no JWT; an empty table gives none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    own = [] if redact else [T.StructField(c, T.LongType()) for c in ("n_assign", "n_access", "n_hex")] + [T.StructField(c, T.StringType()) for c in ("base_sha256", "spans")]
    schema = T.StructType([docs.schema[c] for c in keep] + own)
    kind = to_arrow_schema(schema)

    def make():
        words = automaton()

        def step(batch: pa.RecordBatch):
            texts = batch.column("_text").to_pylist()
            found = [find_secrets(t, words) if t else [] for t in texts]
            out = {c: batch.column(c) for c in keep}
            if redact:
                out[text_col] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, found, strict=True)], pa.string())
                yield out
                return
            base = [[s for s in f if s[2] in BASE_KINDS] for f in found]
            for i, k in enumerate(BASE_KINDS):
                out[f"n_{k}"] = pa.array([sum(s[2] == k for s in f) for f in base], pa.int64())
            out["base_sha256"] = pa.array([hashlib.sha256(listed(f).encode()).hexdigest() for f in base])
            out["spans"] = pa.array([listed(f) for f in found])
            yield out

        return step

    rows = docs.select(*[docs[c] for c in keep if not (redact and c == text_col)], docs[text_col].alias("_text"))
    if redact:
        rows = rows.withColumn(text_col, rows["_text"])
    return arrow_rows(rows, make, kind, schema)
