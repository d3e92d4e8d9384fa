"""Secret scans: fixed patterns, and strings in a sensitive context that a primed compressor finds new.

Candidates are strings of any length that follow a sensitive word or another find closely: long token-like strings, and shorter ones that stand in quotes. Each is compressed by zstandard together with
the code around it, under a dictionary of common identifiers; what it adds to the size of its surroundings alone is its
novelty. Every candidate is measured, also where a fixed pattern covers it. Names, paths and values that the surroundings repeat add little; random material adds nearly a byte for each character
and is reported as kind `novel`. Spans of the fixed patterns always stay. Tokens that only a line end or dots separate are a run: from its first
find on a run is followed to its end, and one span reaches from the first find to the last, so keys in many lines and tokens in parts are spanned whole; finds inside the span of a
fixed pattern have spans of their own. The last line of a key may be short.

A null text counts as empty, an empty text has no spans; texts of any length are scanned whole. Offsets are code points. Rows are scanned each for itself: equal rows, and rows that
repeat an id, give as many equal rows; an empty table gives an empty result; extra columns are not read and not returned.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import by_batch

# Patterns and kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
KINDS = ("assign", "access", "hex", "novel")
SENSITIVE = re.compile(r"(?:pass(?:word|wd|phrase)|pwd|secret|token|api[_ -]?key|auth|bearer|credential|private[_ -]?key|access[_ -]?key|signature|session)", re.IGNORECASE | re.ASCII)
#: What every sensitive word starts with or is, in lower case: a text without them needs no search.
STEMS = ("pass", "pwd", "secret", "token", "api", "auth", "bearer", "credential", "private", "access", "signature", "session")
#: Strings of 8 to 40 characters in quotes, and long ones anywhere.
TOKEN = re.compile(r"""(?<=["'`])(?![^"'`]*://)[^\s"'`\\<>(){}]{8,40}(?=["'`])|(?:(?<!\\)|(?![nrt]))[A-Za-z0-9+/_=-]{16,}""")  # not the letter of an escape
# What stands between the tokens of a run (line ends also as written in string literals), and a key's short last line.
LINE_END = r"(?:\r?\n|(?:\\r)?\\n)[\x20\t]*"
JOINED = re.compile(rf"(?:\.[A-Za-z0-9+/_=-]{{1,15}})*\.|{LINE_END}")
LAST_LINE = re.compile(rf"{LINE_END}((?!-----)[A-Za-z0-9+/_=-]+?)(?P<closed>(?:{LINE_END})-----END)?(?=[\x20\t]*(?:[\r\n\\\"'`]|-----END|\Z))")
# Identifiers and phrases of ordinary code, which prime the compressor.
IDENTIFIERS = """import from return self class public private static const function async await string number boolean null none true false
default config settings environment variable process system request response header content application json authorization
username password passwd secret token access_token refresh_token session_id api_key apikey client_id client_secret private_key public_key
database connection host port user root admin localhost example test sample placeholder changeme your_password_here your_api_key
get set put post delete update select insert value values index length size name type path file data key code error message result
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 1234567890 0000000000000000 xxxxxxxxxxxxxxxx"""
#: Characters after a sensitive word or a find in which a candidate may start; characters of surroundings.
REACH, AROUND = 40, 256
#: Least bytes added for each character, of candidates of LONG characters or more and of shorter ones; least bytes of a long one.
LONG, LEAST_RATE, SHORT_RATE, LEAST_BYTES = 16, 0.7, 1.0, 12


@lru_cache(1)
def _compressor():
    import zstandard

    return zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(IDENTIFIERS.encode()), write_content_size=False, write_checksum=False, write_dict_id=False)


def novelty(candidate: str, before: str, after: str) -> int:
    """Bytes that the candidate adds to its compressed surroundings."""
    c = _compressor()
    return len(c.compress((before + after + candidate).encode())) - len(c.compress((before + after).encode()))


def is_new(candidate: str, added: int) -> bool:
    n = len(candidate)
    return added >= LEAST_BYTES and added >= LEAST_RATE * n if n >= LONG else added >= SHORT_RATE * n


def _mixed(s: str) -> bool:
    """A digit and a letter, or both cases with a digit: plain words and plain numbers are no candidates."""
    return any(c.isdigit() for c in s) and sum(not c.isdigit() for c in s) >= 2


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 12]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text)]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


def _tokens(text: str):
    """A function from a position to the first token from there on, for positions that do not fall; the text is passed once, from the first position on."""
    last: list[re.Match | None] = []

    def after(at: int) -> re.Match | None:
        if not last or last[0] and last[0].start() < at:
            last[:] = [TOKEN.search(text, at)]
        return last[0]

    return after


def _spans(text: str, run: list[tuple[int, int, bool, bool, bool]]) -> list[tuple[int, int]]:
    """Adjacent finds of a run as one span, with the lines of one length and the mixed parts beside them, and a key's shorter last line."""

    def belongs(i: int, beside: int) -> bool:
        (s, e, *_), (p, q, *_) = run[i], run[beside]
        return e - s == q - p if text[max(s, p) - 1] != "." else _mixed(text[s:e])

    held = [x[2] for x in run]
    for i in range(1, len(run)):
        held[i] = held[i] or held[i - 1] and belongs(i, i - 1)
    for i in range(len(run) - 2, -1, -1):
        held[i] = held[i] or held[i + 1] and belongs(i, i + 1)
    out, first = [], 0
    while first < len(run):
        last = first
        while held[first] and last + 1 < len(run) and held[last + 1]:
            last += 1
        part, first = run[first : last + 1], last + 1
        if not any(new for *_, new in part):
            continue
        own = [(s, e) for s, e, _, inside, _ in part if not inside]  # the others are spanned by fixed patterns
        end, width = own[-1][1], own[-1][1] - own[-1][0]
        wrapped = len(own) > 1 and text[own[-1][0] - 1] != "." and width == own[-2][1] - own[-2][0]
        m = LAST_LINE.match(text, end)
        out.append((own[0][0], m.end(1) if m and (m["closed"] or m[1].endswith("=") or wrapped and len(m[1]) <= width) else end))
    return out


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """Spans of kind novel; and start, end and novelty of every candidate that was measured."""
    out, measured, done = [], [], 0
    lower = text.lower()
    if not any(x in lower for x in STEMS):
        return out, measured
    taken = sorted((s, e) for s, e, _ in base)
    starts, reached = [s for s, _ in taken], list(accumulate((e for _, e in taken), max))
    after = _tokens(text)
    for m in SENSITIVE.finditer(text):
        reach, run = m.end() + REACH, []  # run: start, end, found, inside the span of a fixed pattern, found new
        while True:
            c = after(max(done, m.end()))
            joined = bool(run and c and JOINED.fullmatch(text, run[-1][1], c.start()))
            if run and not joined:
                for s, e in _spans(text, run):
                    out.append((s, e, "novel"))
                    done = max(done, e)
                run = []
                continue
            if not c or c.start() > reach and not joined:
                break
            done = c.end()
            before, at = bisect_left(starts, c.end()), bisect_right(starts, c.start())
            over = before > 0 and reached[before - 1] > c.start()
            inside = at > 0 and reached[at - 1] >= c.end()
            new = False
            if _mixed(c[0]):
                added = novelty(c[0], text[max(0, c.start() - AROUND) : c.start()], text[c.end() : c.end() + AROUND])
                new = is_new(c[0], added)
                measured.append((c.start(), c.end(), added))
            if over or new:
                reach = max(reach, c.end() + REACH)
            if new and inside:
                out.append((c.start(), c.end(), "novel"))
            run.append((c.start(), c.end(), over or new, inside, new and not inside))
    return out, measured


def scan_measured(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, int]]]:
    """(start, end, kind) of every span, by start and then kind in the order of KINDS; and what was measured."""
    text = text or ""
    base = base_spans(text)
    novel, measured = novel_spans(text, base)
    return sorted(base + novel, key=lambda x: (x[0], KINDS.index(x[2]))), measured


def scan(text: str | None) -> list[tuple[int, int, str]]:
    return scan_measured(text)[0]


def redact(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with every span replaced by a marker; overlapping spans become one."""
    out, at = [], 0
    for s, e, kind in spans:
        if s >= at:
            out += [text[at:s], f"[{kind} removed]"]
        at = max(at, e)
    return "".join([*out, text[at:]])


SCHEMA = "doc_id long, spans array<struct<start:int,end:int,kind:string>>"


def secret_spans(docs: DataFrame) -> DataFrame:
    """doc_id and the spans found in the text of every row."""

    def run(b: pa.RecordBatch) -> dict:
        return {"doc_id": b.column("doc_id"), "spans": [[{"start": s, "end": e, "kind": k} for s, e, k in scan(t)] for t in b.column("text").to_pylist()]}

    return by_batch(docs.select("doc_id", "text"), SCHEMA, run)


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts and digests of what `secret_spans` finds, made beside the scan so that spans need no second pass."""

    def run(b: pa.RecordBatch) -> dict:
        every = [scan_measured(t) for t in b.column("text").to_pylist()]
        found = [x for x, _ in every]
        line = lambda spans: ",".join(f"{k}:{s}:{e}" for s, e, k in spans)
        n = lambda kind: [sum(k == kind for _, _, k in x) for x in found]
        return {
            "doc_id": b.column("doc_id"),
            "n_assign": n("assign"),
            "n_access": n("access"),
            "n_hex": n("hex"),
            "base_sha256": [hashlib.sha256(line([s for s in x if s[2] != "novel"]).encode()).hexdigest() for x in found],
            "spans": [line(x) for x in found],
            "n_novel": n("novel"),
            "n_measured": [len(x) for _, x in every],
            "novelty": [sum(added for *_, added in x) for _, x in every],
        }

    return by_batch(docs.select("doc_id", "text"), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long, n_measured long, novelty long", run)


def redacted(docs: DataFrame) -> DataFrame:
    """The columns of documents, every span of a secret replaced in the text. Documents stay."""

    def run(b: pa.RecordBatch) -> dict:
        texts = b.column("text").to_pylist()
        out = [t if t is None else redact(t, scan(t)) for t in texts]
        return {
            **{c: b.column(c) for c in ("doc_id", "lang", "source")},
            "text": out,
            "n_chars": [n if t == o else len(o) for t, o, n in zip(texts, out, b.column("n_chars").to_pylist(), strict=True)],
        }

    return by_batch(docs.select("doc_id", "text", "lang", "source", "n_chars"), "doc_id long, text string, lang string, source string, n_chars long", run)
