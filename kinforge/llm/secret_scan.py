"""Secret scanning of whole texts: three base patterns, and a token-efficiency test for random strings.

Ordinary words cost few tokens for their characters; random strings cost many. A run of 16 or more key-like characters
with letters that stays under ``MAX_RATIO`` characters per token is reported as ``random``, unless it is a digest of a usual
length, a UUID, or overlaps a base span. Runs without digits whose letters are cased like a word's (all lower, all upper,
or capitalised) may be long compounds and have to stay under ``WORD_RATIO``. Runs without a letter are left out: any number
costs as many tokens as a random one. Digests and UUIDs are known in either case. Null text counts as empty; empty and
blank texts have no spans; long texts are scanned whole, and a run of any length is one span. Every input row gives one
output row, repeated rows too; ids may be null or repeat; an empty table has no rows; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

from kinforge.llm.runtime import batch, map_batches, texts

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
RUN = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}")
UUID = re.compile(r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
DIGEST = re.compile(r"(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128})", re.IGNORECASE)
MAX_RATIO, WORD_RATIO = 2.2, 2.0


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("scan", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def looks_random(run: str, encoding, max_ratio: float = MAX_RATIO) -> bool:
    """Whether a key-like run has letters, is no known digest or identifier, and tokenises badly."""
    if not any(c.isalpha() for c in run):
        return False
    if not any(c.isdigit() for c in run) and (run.islower() or run.isupper() or run.istitle()):
        max_ratio = min(max_ratio, WORD_RATIO)
    if DIGEST.fullmatch(run) or UUID.fullmatch(run):
        return False
    return len(run) / len(encoding.encode_ordinary(run)) < max_ratio


def scan(text: str, encoding, max_ratio: float = MAX_RATIO) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) of all spans in order."""
    spans = []
    lowered = text.lower()
    if any(x in lowered for x in KEYWORDS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    long_words = [x for x in text.split() if len(x) >= 16]
    if any(map(HEX.search, long_words)):
        spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    if any(RUN.search(x) and any(c.isalpha() for c in x) for x in long_words):
        base = sorted(spans)
        for m in RUN.finditer(text):
            if not any(a < m.end() and m.start() < b for a, _, b in base) and looks_random(m[0], encoding, max_ratio):
                spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def find_secrets(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text", max_ratio: float = MAX_RATIO) -> DataFrame:
    """Per row: id_col and found, an array of (kind, start, end) in code points, end exclusive, by start and then kind."""
    kind = dict(docs.dtypes)[id_col]
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def each(batches):
        encoding = vocabulary(vocabulary_path)
        for b in batches:
            found = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in scan(t, encoding, max_ratio)] for t in texts(b.column(1))]
            yield batch({"id": (b.column(0), b.column(0).type), "found": (found, pa.list_(span))})

    return map_batches(docs.select(id_col, text_col), each, f"id {kind}, found array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)
