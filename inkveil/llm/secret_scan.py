"""Secret scanning: exact patterns plus dictionary-primed zstandard novelty.

Three patterns give the base spans. Beyond them, every long unbroken string that
follows a sensitive word is a candidate, and so is the value of a KEY=VALUE string
with such a word in its key; a candidate's novelty is the number of compressed
bytes it adds to its surroundings, with a compressor primed by a dictionary of
common code identifiers. Repeated identifiers and words of the surroundings or the
dictionary add few bytes; key material adds about as many bytes as it has characters,
and is reported. New words and numbers add bytes too, so novelty is calibrated by what
a candidate is made of: segments that are words (also several in camel case), numbers
and dates are the normal material of paths, addresses and versions, and a candidate is
reported only if most of its letters and digits stand in other segments. UUIDs name
things and are no secrets.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from inkveil.llm._common import Batches, id_and_text, rows, utf8

#: Fixed patterns of the base spans, in the order in which kinds are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ("assign", "access", "hex", "novel")
MIN_ASSIGN, MIN_ACCESS, MIN_HEX = 6, 20, 24

#: Words of which one must stand shortly before a candidate.
SENSITIVE = ("secret", "token", "passw", "pwd", "passphrase", "credential", "api key", "apikey", "api_key", "access key", "auth", "bearer", "private key", "signature", "session", "cookie", "client_id", "login", "-----begin")

#: What code around secrets is made of; primes the compressor.
IDENTIFIERS = (
    "password passwd secret token api_key apiKey access_key secretAccessKey client_id client_secret "
    "authorization Bearer Basic credentials username user_name session_id sessionToken refresh_token "
    "private_key public_key certificate signature encryption environment variable config configuration "
    "settings default example placeholder changeme your_api_key_here your-token-here xxxxxxxxxxxxxxxx "
    "https://www.example.com/ http://localhost:8080/ api/v1/ index.html import from return function "
    "const static public private class void string boolean integer self.this null true false None "
    "os.environ.get getenv process.env System.getProperty BEGIN END RSA PRIVATE KEY abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 1234567890 connection database host port "
)

MIN_NOVEL = 16  # characters of a candidate
CONTEXT = 48  # characters before a candidate in which a sensitive word must stand
SURROUND = 2048  # characters of surrounding text on either side that prime the compressor
NOVELTY = 0.7  # compressed bytes per character from which a candidate is reported
PLAIN = 0.5  # share of letters and digits in segments of words and numbers from which it isn't

CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=.-]{{{MIN_NOVEL},}}")
#: A segment between punctuation that is made of words and numbers: random letters of both cases
#: and digits change their class every one or two characters, words don't.
_WORDS = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}(?![a-z])|[0-9]{1,8}(?![0-9]))+")
_SEGMENT = re.compile(r"[A-Za-z0-9]+")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_SENSITIVE = re.compile("|".join(map(re.escape, SENSITIVE)))
_KEYWORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")


def _class_table(chars: bytes) -> bytes:
    return bytes(120 if c in chars else 32 for c in range(256))


_HEX_RUN = _class_table(b"0123456789abcdef")
_LONG_RUN = _class_table(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=.-")


class SecretScanner:
    """Finds spans in one text at a time; holds the primed compressor."""

    def __init__(self, identifiers: str = IDENTIFIERS, novelty: float = NOVELTY):
        primed = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self._compress = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False).compress
        self._novelty = novelty

    def base(self, data: bytes, text: str) -> list[tuple[int, int, int]]:
        """(start, kind, end) of the pattern spans, sorted; positions in code points."""
        found = []
        lower = data.lower()
        # the byte tests only skip texts in which a pattern can't match at all
        if any(k in lower for k in _KEYWORDS):
            found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
        if b"AKIA" in data:
            found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
        if b"x" * MIN_HEX in data.translate(_HEX_RUN):
            found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
        return sorted(found)

    def marginal_bytes(self, before: str, candidate: str, after: str) -> int:
        """Compressed bytes that the candidate adds to its surroundings."""
        around = (before + "\n" + after + "\n").encode()
        return len(self._compress(around + candidate.encode())) - len(self._compress(around))

    @staticmethod
    def plain(candidate: str) -> bool:
        """Whether a string is a UUID, or its letters and digits are mostly words and numbers: a path, an address, a version."""
        if _UUID.fullmatch(candidate):
            return True
        segments = _SEGMENT.findall(candidate)
        return sum(len(x) for x in segments if _WORDS.fullmatch(x)) >= PLAIN * sum(map(len, segments))

    def novel(self, data: bytes, text: str, taken: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Spans of incompressible strings in a sensitive context that no taken span covers whole."""
        if b"x" * MIN_NOVEL not in data.translate(_LONG_RUN):
            return []
        found = []
        for m in CANDIDATE.finditer(text):
            b = m.end()
            for start in self._starts(text, m.start(), b):
                s = text[start:b]
                if len(s) < MIN_NOVEL or any(x <= start and b <= y for x, _, y in taken):
                    break  # and so are the values within it
                # key material mixes letters of both cases or digits; plain words don't
                if sum(bool(re.search(k, s)) for k in ("[a-z]", "[A-Z]", "[0-9]")) < 2 or self.plain(s):
                    continue
                if self.marginal_bytes(text[max(0, start - SURROUND) : start], s, text[b : b + SURROUND]) >= self._novelty * len(s):
                    found.append((start, 3, b))
                    break
        return found

    @staticmethod
    def _starts(text: str, a: int, b: int) -> Iterator[int]:
        """Where a candidate, or a value after a key within it, starts that has a sensitive word before."""
        before = bool(_SENSITIVE.search(text[max(0, a - CONTEXT) : a].lower()))
        if before:
            yield a
        key, first = a, True
        while (at := text.find("=", key, b)) >= 0:
            # the first key may also be the end of a phrase that starts before the candidate
            if first and before or _SENSITIVE.search(text[max(0, a - CONTEXT) if first else key : at].lower()):
                yield at + 1
            key, first = at + 1, False

    def spans(self, data: bytes) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        text = data.decode()
        base = self.base(data, text)
        return base, sorted(base + self.novel(data, text, base))


def written(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Spans of secrets in whole texts, one row per input row.

    Columns: doc_id, n_assign, n_access, n_hex, n_novel, base (pattern spans),
    spans (all spans), each as ``kind:start:end`` by start, comma-joined, in code
    points. Null and empty texts have no spans; a null id stays null; repeated rows
    are scanned each; an empty table gives an empty table; other input columns are
    not read. No shuffle: texts stay in the task that reads them.
    """

    def scan(batches: Batches) -> Batches:
        scanner = SecretScanner()
        for batch in batches:
            n: list[list[int]] = [[], [], [], []]
            base, spans = [], []
            for data in utf8(batch):
                b, every = scanner.spans(data)
                for k in range(4):
                    n[k].append(sum(x[1] == k for x in every))
                base.append(written(b))
                spans.append(written(every))
            yield rows({
                "doc_id": (pa.int64(), batch.column("doc_id")),
                **{f"n_{kind}": (pa.int64(), n[k]) for k, kind in enumerate(KINDS)},
                "base": (pa.string(), base),
                "spans": (pa.string(), spans),
            })

    kept = id_and_text(docs, id_col, text_col)
    return kept.mapInArrow(scan, "doc_id bigint, n_assign bigint, n_access bigint, n_hex bigint, n_novel bigint, base string, spans string")


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns with every span (overlapping ones merged) replaced by a mark.

    Null and empty texts stay as they are, repeated rows each. All columns keep names,
    types and order. An empty table gives an empty table.
    """

    def cut(batches: Batches) -> Batches:
        scanner = SecretScanner()
        for batch in batches:
            at = batch.schema.get_field_index(text_col)
            out = []
            for data in utf8(batch, text_col):
                if data is None:
                    out.append(None)
                    continue
                text, end, parts = data.decode(), 0, []
                for a, _, b in scanner.spans(data)[1]:
                    if a >= end:
                        parts += [text[end:a], mark]
                    end = max(end, b)
                out.append("".join([*parts, text[end:]]))
            yield batch.set_column(at, batch.schema.field(at), pa.array(out, type=batch.schema.field(at).type))

    return docs.mapInArrow(cut, docs.schema)
