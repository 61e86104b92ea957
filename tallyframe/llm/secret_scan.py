"""Secret scans: fixed patterns, and random strings by their token efficiency.

A public byte-pair vocabulary writes ordinary words in few tokens. A run of code-like characters that
needs a token for every two characters or so is random: a key, a token, a password. Runs join secrets to
names and paths, so the ratio is taken of the whole run, of each long part between separators, and of up
to ``JOINED`` neighbouring parts, as a secret may hold separators itself; if one is random, the whole run is
a span. Known digests and identifiers are excluded first, inside runs too.

Defined results: null text is empty and has no spans. Repeated rows are scanned alike, each on its own.
Spans count code points, end exclusive, and are ordered by start, then by kind as in ``KINDS``. An empty
table gives an empty result. Other columns of the input are ignored by ``scan``; ``redact`` keeps them.
"""

import base64
import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from tallyframe.llm.common import give_back, utf8

KINDS = ("assign", "access", "hex", "random")

# Fixed patterns and least lengths: of the value, of the whole key, of the whole run.
ASSIGN = rb"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = rb"AKIA[A-Z0-9]+"
HEX = rb"[0-9a-f]+"
ASSIGN_VALUE, ACCESS_LENGTH, HEX_LENGTH = 12, 18, 16
KEYWORD = re.compile(rb"passw|secret|token|api_?key", re.I)

LEAST = 16  # characters of a random string
CANDIDATE = re.compile(rb"[A-Za-z0-9+/_=-]{%d,}" % LEAST)
CHARS_PER_TOKEN = 2.2  # at most, for a random string
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)  # hexadecimal digits of known digests
IDENTIFIER = re.compile(rb"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}|[0-9+/_=-]+")
UUID = re.compile(rb"(?<![0-9A-Fa-f])[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}(?![0-9A-Fa-f])")
PART = re.compile(rb"[/_=+-]+")
PIECE = 512  # characters encoded at a time
JOINED = 3  # neighbouring parts looked at as one string
DIGIT, LOWER, UPPER = re.compile(rb"[0-9]"), re.compile(rb"[a-z]"), re.compile(rb"[A-Z]")
PLAIN_CHARS_PER_TOKEN = 1.9  # at most, for a random string of letters of one case
REPLACEMENT = "<secret>"
SLICE = 200  # texts redacted at a time

SPANS = "n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def vocabulary(name="byte_bpe_50k.tiktoken"):
    """The path of a public rank file, to be opened inside tasks."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _mixed(part):
    """Whether a part has digits and letters, or an upper-case letter after a lower-case one."""
    lower = LOWER.search(part)
    if DIGIT.search(part):
        return bool(lower or UPPER.search(part))
    return bool(lower and UPPER.search(part, lower.end()))


class Scanner:
    def __init__(self, path, chars_per_token=CHARS_PER_TOKEN):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.encoding = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.limit = chars_per_token
        self.assign = re.compile(ASSIGN, re.I)
        self.access, self.hex = re.compile(ACCESS), re.compile(HEX + b"")
        self.long_hex = re.compile(rb"[0-9a-f]{%d}" % HEX_LENGTH)

    def _tokens(self, part):
        # In pieces: the encoder takes time with the square of a run's length.
        encode, text = self.encoding.encode_ordinary, part.decode("ascii")
        return sum(len(encode(text[i : i + PIECE])) for i in range(0, len(text), PIECE))

    def _random(self, run):
        """Whether a run of code-like characters, a part or neighbouring parts of it take too many tokens."""
        whole_digest = len(run) in DIGEST_LENGTHS and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", run)
        if IDENTIFIER.fullmatch(run) or whole_digest:
            return False
        # Paths, slugs and names in parts: at least one part has to be long and mixed itself.
        if any(len(p) >= 12 and _mixed(p) for p in PART.split(run)) and len(run) <= self.limit * self._tokens(run):
            return True
        return any(self._random_parts(piece) for piece in UUID.split(run) if len(piece) >= LEAST)

    def _random_parts(self, run):
        """Whether a part, or neighbouring parts, of a run take too many tokens; digests and words are neither."""
        parts = [p for p in PART.split(run) if p]
        digest = [len(p) in DIGEST_LENGTHS and re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", p) is not None for p in parts]
        mixed = [not d and _mixed(p) for p, d in zip(parts, digest)]
        tokens = [self._tokens(p) if m else 0 for p, m in zip(parts, mixed)]
        for i, part in enumerate(parts):
            if not mixed[i]:
                if len(part) >= LEAST and part.isalpha() and len(part) <= PLAIN_CHARS_PER_TOKEN * self._tokens(part):
                    return True
                continue
            size = count = 0
            for j in range(i, min(i + JOINED, len(parts))):
                if not mixed[j]:
                    break
                size, count = size + len(parts[j]), count + tokens[j]
                if size >= LEAST and size <= self.limit * count:
                    return True
        return False

    def spans(self, text):
        """Byte spans (start, kind number, end), in order."""
        found = []
        if KEYWORD.search(text):
            found += [
                (m.start(), 0, m.end()) for m in self.assign.finditer(text) if len(m[2]) >= ASSIGN_VALUE
            ]
        if b"AKIA" in text:
            found += [
                (m.start(), 1, m.end()) for m in self.access.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH
            ]
        if self.long_hex.search(text):
            found += [(m.start(), 2, m.end()) for m in self.hex.finditer(text) if m.end() - m.start() >= HEX_LENGTH]
        found += [(m.start(), 3, m.end()) for m in CANDIDATE.finditer(text) if self._random(m[0])]
        found.sort()
        if found and not text.isascii():
            starts = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
            points = np.concatenate([[0], np.cumsum(starts)])
            found = [(int(points[a]), k, int(points[b])) for a, k, b in found]
        return found


def _row(found):
    named = [f"{KINDS[k]}:{a}:{b}" for a, k, b in found]
    base = ",".join(n for n, (_, k, _) in zip(named, found) if k < 3)
    counts = [sum(k == kind for _, k, _ in found) for kind in range(4)]
    return (*counts, hashlib.sha256(base.encode()).hexdigest(), ",".join(named))


def found_spans(text, path=None):
    """A struct column: counts by kind, the digest of the base spans, and all spans."""
    path, names = path or vocabulary(), [part.split()[0] for part in SPANS.split(", ")]
    opened = []

    @arrow_udf(SPANS)
    def scan_texts(texts: pa.Array) -> pa.Array:
        if not opened:
            opened.append(Scanner(path))
        rows = [_row(opened[0].spans(t or b"")) for t in utf8(texts)]
        columns = list(zip(*rows)) if rows else [[] for _ in names]
        types = [*[pa.int64()] * 4, pa.string(), pa.string()]
        return pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return scan_texts.asNondeterministic()(text)


def scan(docs, path=None):
    """One row per document: counts by kind, the digest of the base spans, and all spans as text."""
    found = docs.select("doc_id", found_spans(F.col("text"), path).alias("_s"))
    return found.select("doc_id", "_s.*")


def _redacted(scanner, text, replacement):
    found = scanner.spans(text.encode()) if text else ()
    done, parts = 0, []
    for start, _, end in found:
        if start >= done:
            parts += [text[done:start], replacement]
        done = max(done, end)
    return "".join([*parts, text[done:]]) if found else text


def redact(docs, path=None, replacement=REPLACEMENT):
    """The documents with every span, overlapping ones joined, replaced; ``n_chars`` is counted anew."""
    path, kinds = path or vocabulary(), dict(docs.dtypes)
    opened = []

    @arrow_udf("string")
    def replace(texts: pa.Array) -> pa.Array:
        if not opened:
            opened.append(Scanner(path))
        # In slices: a batch of long texts is held once as Arrow has it, and once more as the result.
        parts = [texts.slice(at, SLICE) for at in range(0, len(texts), SLICE)]
        done = [pa.array([_redacted(opened[0], t, replacement) for t in part.to_pylist()], pa.string()) for part in parts]
        give_back()
        return pa.concat_arrays(done) if done else pa.array([], pa.string())

    packed = docs.select(F.struct("*").alias("_row"), replace.asNondeterministic()(F.col("text")).alias("_text"))
    return packed.select(
        *[
            F.col("_text").alias(c) if c == "text"
            else F.when(F.col("_text").isNotNull(), F.length("_text")).otherwise(F.col(f"_row.`{c}`"))
            .cast(kinds[c]).alias(c) if c == "n_chars"
            else F.col(f"_row.`{c}`").alias(c)
            for c in docs.columns
        ]
    )
