"""Secrets in whole texts: three fixed patterns, and strings that a primed zstandard dictionary cannot shorten.

Base spans, leftmost non-overlapping per kind: ``assign`` (a value set after a password-like name), ``access`` (an access
key id), ``hex`` (a long run of hex digits); matches that are too short are dropped. Novelty spans: a run of 20 or more
token characters with a digit and a letter, with a word that speaks of secrets in the ``SURROUNDING_CHARS`` characters on
either side or in the name it sets (``name=value``), or with only white space between it and a run before that is a base span
or has such a word, directly or in the same way (the lines of a wrapped key). Its marginal size is what it adds
to a compressed frame whose dictionary holds known identifiers and the text around it, other copies of the run cut out; runs
the dictionary can build from what it has seen are shortened, random strings are not and are reported as ``novel``. What
counts as shortened is measured against a random string of the same length over the run's own symbols, in the same frame, so
that what the entropy coder saves on a small alphabet does not count, whatever the length.

Defined results: null text is empty and has no span; a novelty candidate is not reported again if base spans leave fewer than
``CANDIDATE_MIN`` characters of it uncovered; equal spans of several kinds are listed in the order of ``KINDS``; offsets are
code points, end exclusive.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

KINDS = ("assign", "access", "hex", "novel")
# The patterns and lengths of the base kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_MIN = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_MIN = 20
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGN_NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")

CONTEXT_WORDS = ("key", "secret", "token", "passw", "pwd", "credential", "auth", "bearer", "private", "signature")
CANDIDATE_MIN = 20
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{CANDIDATE_MIN},}}")
_DIGIT, _LETTER = re.compile("[0-9]"), re.compile("[A-Za-z]")
SURROUNDING_CHARS = 2048
NOVEL_SHARE = 0.8
#: Identifiers that code and configuration repeat; the dictionary starts with them.
IDENTIFIERS = (
    "access_token refresh_token client_secret client_id api_key secret_key private_key public_key authorization "
    "Authorization: Bearer content-type application/json username password database connection_string endpoint "
    "environment configuration production development staging version example default localhost timeout "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0123456789abcdef YOUR_API_KEY_HERE xxxxxxxxxxxxxxxx "
    "import return function public static final String const class self config settings request response header "
).encode()


def _around(text: str, start: int, end: int) -> str:
    """The text on both sides of a run, without other copies of the run or of a long value it sets (``name=value``)."""
    run = text[start:end]
    reach = SURROUNDING_CHARS + len(run)  # a copy across the edge is seen whole
    before, after = text[max(0, start - reach):start], text[end:end + reach]
    for copy in (run, *(v for v in run.split("=") if len(v) >= CANDIDATE_MIN)):
        before, after = before.replace(copy, " "), after.replace(copy, " ")
    return before[-SURROUNDING_CHARS:] + after[:SURROUNDING_CHARS]


def _has_context(text: str, start: int, end: int) -> bool:
    name = text.find("=", start, end)
    return any(w in part for part in (text[max(0, start - SURROUNDING_CHARS):max(start, name)].lower(),
                                      text[end:end + SURROUNDING_CHARS].lower()) for w in CONTEXT_WORDS)


def _is_novel(candidate: str, around: str) -> bool:
    """Whether the bytes the candidate adds to the frame reach ``NOVEL_SHARE`` of those a random string like it adds."""
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "replace"),
                                           dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    packer = zstandard.ZstdCompressor(level=19, dict_data=primed, write_content_size=False, write_dict_id=False)
    own, nothing = candidate.encode(), len(packer.compress(b""))
    added = len(packer.compress(own)) - nothing
    if added >= NOVEL_SHARE * len(own):
        return True
    symbols = np.unique(np.frombuffer(own, np.uint8))
    drawn = symbols[np.random.default_rng(len(own)).integers(0, len(symbols), len(own))].tobytes()
    return added >= NOVEL_SHARE * (len(packer.compress(drawn)) - nothing)


def _uncovered(start: int, end: int, busy: list[tuple[int, int]], first: int) -> int:
    """Characters of a run outside the sorted spans."""
    done = free = 0
    for n in range(first, len(busy)):
        s, e = busy[n]
        if s >= end:
            break
        free += max(0, s - max(start, done))
        done = max(done, e)
    return free + max(0, end - max(start, done))


def _novel(text: str, taken: list[tuple[int, int, str]]) -> Iterator[tuple[int, int, str]]:
    busy, b = sorted((s, e) for s, e, _ in taken), 0
    told, told_to = False, 0  # whether the run before has a context, and its end
    for m in CANDIDATE.finditer(text):
        run, start, end = m.group(), m.start(), m.end()
        while b < len(busy) and busy[b][1] <= start:
            b += 1
        free = _uncovered(start, end, busy, b)
        told = free < len(run) or (told and text[told_to:start].isspace()) or _has_context(text, start, end)
        told_to = end
        if not told or free < CANDIDATE_MIN or not (_DIGIT.search(run) and _LETTER.search(run)):
            continue
        if _is_novel(run, _around(text, start, end)):
            yield start, end, "novel"


def find_spans(text: str | None) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then kind as listed."""
    if not text:
        return []
    low = text.lower()
    spans = []
    if any(name in low for name in ASSIGN_NAMES):
        spans += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m.group(2)) >= ASSIGN_MIN]
    if "AKIA" in text:
        spans += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_MIN]
    spans += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    if spans or any(word in low for word in CONTEXT_WORDS):
        spans += list(_novel(text, spans))
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def _joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def scan_secrets(docs: DataFrame) -> DataFrame:
    """``doc_id``, counts of base spans, ``base_sha256`` and all ``spans`` of every row."""
    schema = docs.select("doc_id").schema
    for name, kind in (("n_assign", "long"), ("n_access", "long"), ("n_hex", "long"), ("base_sha256", "string"), ("spans", "string")):
        schema = schema.add(name, kind)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts: list[list[int]] = [[], [], []]
            digests, spans = [], []
            for text in batch.column(1):
                found = find_spans(text.as_py())
                for n, kind in enumerate(KINDS[:3]):
                    counts[n].append(sum(1 for s in found if s[2] == kind))
                base = _joined([s for s in found if s[2] != "novel"])
                digests.append(hashlib.sha256(base.encode()).hexdigest())
                spans.append(_joined(found))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()),
                 pa.array(spans, pa.string())], names=schema.names)

    return docs.select("doc_id", "text").mapInArrow(scan, schema)


def redact(text: str, spans: list[tuple[int, int, str]], mark: str = "[SECRET]") -> str:
    """The text with every span, overlapping ones joined, replaced by ``mark``."""
    out, done, covered = [], 0, 0
    for start, end, _ in spans:
        if start >= covered:
            out += [text[done:start], mark]
        covered = max(covered, end)
        done = covered
    return "".join([*out, text[done:]])


def without_secrets(docs: DataFrame) -> DataFrame:
    """All documents, secrets in the text replaced; ``n_chars``, where there is one, follows the new text."""
    names = docs.columns
    at = names.index("text")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns = batch.column(at).to_pylist(), list(batch.columns)
            found = [find_spans(t) for t in texts]
            if any(found):
                clean = [redact(t, s) if s else t for t, s in zip(texts, found, strict=True)]
                columns[at] = pa.array(clean, batch.schema.field(at).type)
                if "n_chars" in names:
                    n = names.index("n_chars")
                    old = columns[n].to_pylist()
                    columns[n] = pa.array([len(t) if s else o for t, s, o in zip(clean, found, old, strict=True)],
                                          batch.schema.field(n).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(scan, docs.schema)
