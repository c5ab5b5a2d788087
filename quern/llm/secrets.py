"""Credentials embedded in code, configuration and commands: found, and masked in place.

Literals are taken from assignment contexts (``key = "value"`` in the many notations of
code, markup, shells and prose). Key and value are segmented into dictionary words by
Viterbi: the key must spell a secret (``PGPASSWORD`` -> pg password), the value must leave a
residual that words do not explain. Formats that carry their own proof (vendor prefixes,
signed tokens, private key blocks, passwords in connection strings) need no key. Digests,
plain ids, public keys, certificates, references and placeholders are excluded.

The dictionary is the vocabulary of a public tokenizer (``vocabulary``: a path), whose
ranks serve as word costs; it is never copied.

A name on no list is no hindrance: a long literal that is assigned to it and that words leave mostly unexplained is a
secret too, unless the name says that its value is open (an id, a digest, a version).

Each detector runs only where a sign it cannot do without occurs (``may_hold``). JSON is scanned string
by string with its escapes decoded; the mask goes back into the raw text, so every other
character, white space included, stays as it was.

Defined results: NULL and blank fields hold nothing; broken JSON is scanned as plain text;
a field of any length is scanned whole; repeated rows give one row.
"""

from __future__ import annotations

import base64
import functools
import json
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MASK = "[MASKED_SECRET]"
#: Bits a value needs beyond its dictionary words before it counts as a secret.
LEAST_BITS = 26.0

_PEM = re.compile(r"-----BEGIN (?P<kind>[A-Z0-9 ]+)-----(?P<body>.*?)(?:-----END (?P=kind)-----|\Z)", re.S)
#: Formats that are credentials by themselves.
_FORMAT = re.compile(
    r"(?<![A-Za-z0-9_-])(?:gh[pousr]_[A-Za-z0-9]{12,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abeprs]-[A-Za-z0-9-]{16,}|sk-[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{12,}|npm_[A-Za-z0-9]{20,}|pypi-[\w-]{30,}|A[KS]IA[A-Z0-9]{16}|AIza[\w-]{30,}|eyJ[\w-]{8,}\.eyJ[\w-]{6,}\.[\w-]{6,})"
)
_USERINFO = re.compile(r"\b[A-Za-z][A-Za-z0-9+.-]{1,20}://(?P<user>[^\s:/@\"'<>]*):(?P<value>[^\s@/\"'<>]+)@")
#: Steps through command lines: a client's name, the end of its line (one that is not continued), a password.
_MYSQL = re.compile(r"""\b(?P<command>mysql|mysqldump|mysqladmin|mariadb|sshpass)\b|(?P<end>[;|]|(?<!\\)\n(?!-p[^\s"';|]))|(?<=\s)-p(?P<value>[^\s"';|]+)""")
#: What a key's name must contain, and what names are made of.
_KEYWORD = re.compile(r"pass|pwd|secret|token|key|auth|credential|kennwort|contrase|\bsig", re.I)
_ON = re.compile(r"[\w.\-]*")
#: What may stand between a key and its value.
_LINK = re.compile(
    r"""["'`\]]*(?:\s*\n\s*value:\s*|:\s*\n\s*value:\s*|["'\s]*\bvalue\s*=\s*|\s*:\s*&?'?[\w<>\[\]]+\s+=(?!=)\s*|\s*(?:=>|:=|==?|:|,|>)\s*|\s+(?:to|is|was|ist|lautet|est|es)\s+|[ \t]+)(?:(?:Bearer|Basic|Token)\s+)?(?P<quote>["'`]?)"""
)
_BARE = re.compile(r"[^\s\"'`<>&,;)}\]|]+")
_QUOTED = {q: re.compile(rf"[^{q}\n]*") for q in "\"'`"}
_CAMEL = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")

#: The rest of a literal that is written in several pieces: "abc" + \ "def".
_CONTINUED = re.compile(r"""["']\s*(?:\+|\.\.|&|\\)\s*\\?\s*["'](?P<value>[^"'\n]{4,})["']""")

#: A literal that is assigned to any name; see ``_unlisted``.
_LITERAL = re.compile(r"""[=:]>?[ \t\\]*["'`]?(?P<value>[^\s"'`<>,;(){}\[\]\\|]{12,})""")
#: Words of names whose values are random by nature and open to all.
_OPEN_WORDS = frozenset("id ids uuid guid hash digest checksum sha md5 crc etag integrity commit rev revision fingerprint thumbprint cursor version image img icon data src href url uri link ref trace span request session build job run node cert certificate pem public csr mappings slug path file".split())

_SECRET_WORDS = {"password", "passwd", "passwort", "pass", "pwd", "passphrase", "passcode", "secret", "token", "kennwort", "contrasena", "contraseña", "credential", "credentials", "auth", "authorization", "apikey"}
_KEY_WORDS = {"api", "access", "private", "secret", "signing", "sign", "encryption", "encrypt", "master", "auth", "service", "shared", "account", "storage", "deploy", "hmac", "license"}
_NOT_SECRET = {"id", "ids", "name", "field", "file", "path", "type", "url", "uri", "count", "length", "limit", "ttl", "expiry", "header", "policy", "tokens", "tokenizer", "public", "csrf", "prompt", "label", "hint", "min", "max", "hash", "digest", "author", "authors", "authority", "keyboard", "etag", "reset"}
_PLACEHOLDER = re.compile(
    r"^(?:\$[({A-Za-z]|<|\{\{|\[|!secret|!vault|!ref|%\(|%[A-Za-z_]+%$|@\{|arn:|vault[:/]|ref[:+]|env[:.]|ssm:|op://|secret(?:s|ref)?[:/]|null$|none$|nil$|true$|false$|undefined$|os\.|process\.|env\.|request\.|config\.|self\.|settings\.|getenv)|\(|\{\{|\$\{|^[\W_]*$|^x[x\W_]*$|^(?:[A-Za-z_]\w*\.)+[A-Za-z_]\w*$|redacted|masked|placeholder|changeme|change[-_ ]me|your[-_ ]|fill[-_ ]|example|dummy|insert[-_ ]|todo|^(?:test|secret|password|passwd|token)$",
    re.I,
)
_HASHED = re.compile(r"^(?:sha\d+[:\-]|md5[:\-]|\$2[aby]\$|\$argon|\$6\$|\$5\$|\$1\$|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$)", re.I)


@functools.cache
def dictionary(vocabulary: str = VOCABULARY) -> dict[str, float]:
    """Words of three letters or more with their cost in bits, from a tokenizer's ranked vocabulary."""
    words: dict[str, float] = {}
    with open(vocabulary, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            text = base64.b64decode(piece).decode("utf-8", "replace")
            if text[:1] == " " and len(text) > 3 and text[1:].isalpha():
                word = text[1:].lower()
                cost = math.log2(int(rank) + 2)
                words[word] = min(cost, words.get(word, 99.0))
    for word in _SECRET_WORDS | _KEY_WORDS | {"pg", "db", "aws", "smtp", "key", "jwt"}:
        words[word] = min(8.0, words.get(word, 99.0))
    return words


def _letter_bits(c: str) -> float:
    return 3.3 if c.isdigit() else 5.2 if c.isalpha() else 4.0


@functools.cache
def longest(vocabulary: str = VOCABULARY) -> int:
    return max(map(len, dictionary(vocabulary)))


@functools.lru_cache(maxsize=50_000)
def segment(text: str, vocabulary: str = VOCABULARY) -> tuple[tuple[str, ...], float, int]:
    """Cheapest split into dictionary words and single characters: (words, bits, unexplained characters)."""
    words, low, most = dictionary(vocabulary), text.lower(), longest(vocabulary)
    n = len(low)
    best: list[tuple[float, int, bool]] = [(0.0, 0, False)] + [(math.inf, 0, False)] * n
    for end in range(1, n + 1):
        base = best[end - 1][0] + _letter_bits(low[end - 1])
        choice = (base, end - 1, False)
        for start in range(max(0, end - most), end - 1):
            cost = words.get(low[start:end])
            if cost is not None and best[start][0] + cost < choice[0]:
                choice = (best[start][0] + cost, start, True)
        best[end] = choice
    found, plain, end = [], 0, n
    while end:
        _, start, word = best[end]
        if word:
            found.append(low[start:end])
        else:
            plain += 1
        end = start
    return tuple(reversed(found)), best[n][0], plain


@functools.lru_cache(maxsize=50_000)
def names_secret(key: str, vocabulary: str = VOCABULARY) -> bool:
    """Does an identifier name a secret? Its words are found by case, punctuation and, where glued, by Viterbi."""
    words: list[str] = []
    for piece in _CAMEL.findall(key):
        low = piece.lower()
        words += [low] if low in _SECRET_WORDS or low in _NOT_SECRET or low in dictionary(vocabulary) else segment(low, vocabulary)[0]
    if not words or words[-1] in _NOT_SECRET or words[0] in ("csrf", "public", "max", "min"):
        return False
    if any(w in _SECRET_WORDS for w in words[-2:]):
        return True
    return words[-1] == "key" and any(w in _KEY_WORDS for w in words[:-1])


def residual(text: str, vocabulary: str = VOCABULARY) -> tuple[float, int]:
    """Bits and unexplained characters as ``segment`` finds them, in little memory for a text of any length."""
    words, low, most = dictionary(vocabulary), text.lower(), longest(vocabulary)
    bits, plain = [0.0], [0]  # of the ends from ``first`` on
    first = 0
    for end in range(1, len(low) + 1):
        best, count = bits[-1] + _letter_bits(low[end - 1]), plain[-1] + 1
        for start in range(max(0, end - most), end - 1):
            cost = words.get(low[start:end])
            if cost is not None and bits[start - first] + cost < best:
                best, count = bits[start - first] + cost, plain[start - first]
        bits.append(best)
        plain.append(count)
        if len(bits) > 4096:
            first += len(bits) - most
            bits, plain = bits[-most:], plain[-most:]
    return bits[-1], plain[-1]


def is_secret(value: str, vocabulary: str = VOCABULARY) -> bool:
    """Is the literal assigned to a secret's name a real value?"""
    value = value.strip()
    if len(value) < 6 or _PLACEHOLDER.search(value) or _HASHED.match(value) or len(set(value)) < 4:
        return False
    bits, plain = residual(value, vocabulary)
    marks = sum(c.isdigit() or not c.isalpha() for c in value)
    if marks == 0 and plain < 4:
        return False
    if not any(c.isdigit() for c in value) and plain - marks < 3:
        return False
    return bits >= LEAST_BITS


def _command_passwords(text: str) -> Iterator[tuple[int, int]]:
    """Spans of what stands behind -p in a database client's command, however many options come before."""
    inside = False
    for m in _MYSQL.finditer(text):
        if m["command"]:
            inside = True
        elif m["value"] and inside:
            yield m.span("value")
            inside = False
        elif m["end"]:
            inside = False


def _unlisted(text: str, vocabulary: str) -> Iterator[tuple[int, int]]:
    """Literals assigned to a name that is on no list: secrets where most of a long literal is left unexplained by words.

    Small and capital letters and digits must be mixed, as they are in no hexadecimal digest, number or plain id.
    """
    done = 0
    for m in _LITERAL.finditer(text):
        value = m["value"].rstrip(".:")
        if not (any(map(str.isdigit, value)) and any(map(str.isupper, value)) and any(map(str.islower, value))) or value[:2] == "//":
            continue
        at = m.start()
        while at > done and text[at - 1] in " \t\"'`]\\:=":
            at -= 1
        start = at
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_-."):
            start -= 1
        done = m.end()
        if start == at or not _OPEN_WORDS.isdisjoint(w.lower() for w in _CAMEL.findall(text[start:at])):
            continue
        _, plain = residual(value, vocabulary)
        if plain >= 10 and plain >= 0.6 * len(value) and is_secret(value, vocabulary):
            yield m.start("value"), m.start("value") + len(value)


_KEYWORDS = ("pass", "pwd", "secret", "token", "key", "auth", "credential", "kennwort", "contrase", "sig")
_PREFIXES = ("gh", "glpat-", "xox", "sk-", "sk_", "rk_", "npm_", "pypi-", "AKIA", "ASIA", "AIza", "eyJ")
_COMMANDS = ("mysql", "mariadb", "sshpass")


def may_hold(text: str) -> bool:
    """Can any detector match? Each has its own necessary sign here; escapes of JSON may hide one, so they count as one."""
    low = text.lower()
    return (
        "-----BEGIN" in text or "://" in text or ":\\/" in text or "\\u00" in low or any(k in low for k in _KEYWORDS) or any(c in text for c in _COMMANDS) or any(p in text for p in _PREFIXES)
        or (("=" in text or ":" in text) and _LITERAL.search(text) is not None)
    )


def spans(text: str, vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    """Non-overlapping spans of credentials in one piece of text."""
    out: list[tuple[int, int]] = []
    blocked: list[tuple[int, int]] = []
    for m in _PEM.finditer(text) if "-----BEGIN" in text else ():
        blocked.append(m.span())
        if "PRIVATE KEY" in m["kind"] and m["body"].strip(" \r\n\\n"):
            out.append(m.span("body"))
    free = lambda a, b: all(b <= x or a >= y for x, y in blocked) and all(b <= x or a >= y for x, y in out)
    for m in _FORMAT.finditer(text) if any(p in text for p in _PREFIXES) else ():
        if free(*m.span()) and "xxxx" not in m[0].lower():
            out.append(m.span())
    users = (m.span("value") for m in _USERINFO.finditer(text)) if "://" in text else ()
    commands = _command_passwords(text) if any(c in text for c in _COMMANDS) else ()
    for a, b in [*users, *commands]:
        if free(a, b) and is_secret(text[a:b], vocabulary):
            out.append((a, b))
    done = 0
    low = text.lower()
    for m in _KEYWORD.finditer(text) if any(k in low for k in _KEYWORDS) else ():
        if m.start() < done:
            continue
        start = m.start()
        while start > done and (text[start - 1].isalnum() or text[start - 1] in "_.-"):
            start -= 1
        done = _ON.match(text, m.end()).end()
        whole = text[start:done]
        at = start + len(whole.rstrip(".-"))
        name = whole.strip(".-")
        query = start and text[start - 1] in "?&" and name.lower() in ("key", "sig", "signature")
        if not (query or names_secret(name, vocabulary)):
            continue
        link = _LINK.match(text, at)
        if not link:
            continue
        quote = link["quote"]
        value = (_QUOTED[quote] if quote else _BARE).match(text, link.end())
        if not value:
            continue
        literal = value[0] if quote else value[0].rstrip(".,:")
        a, b = value.start(), value.start() + len(literal)
        if literal and free(a, b) and is_secret(literal, vocabulary):
            out.append((a, b))
    if "=" in text or ":" in text:
        out += [s for s in _unlisted(text, vocabulary) if free(*s)]
    for _, b in list(out):
        while (m := _CONTINUED.match(text, b)) and free(*m.span("value")):
            out.append(m.span("value"))
            b = m.end("value")
    return sorted(out)


_STRING = re.compile(r'"((?:[^"\\]|\\.)*)"', re.S)
_ESCAPE = re.compile(r"\\(?:u[0-9a-fA-F]{4}|.)", re.S)


def json_spans(raw: str, vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    """Spans in raw JSON text; strings are scanned decoded and mapped back through their escapes."""
    try:
        json.loads(raw)
    except (ValueError, RecursionError):
        return spans(raw, vocabulary)
    out = []
    for m in _STRING.finditer(raw):
        inner = m[1]
        if "\\" not in inner:
            out += [(m.start(1) + a, m.start(1) + b) for a, b in spans(inner, vocabulary)]
            continue
        place, chars, at = [], [], 0
        while at < len(inner):
            e = _ESCAPE.match(inner, at)
            piece = e[0] if e else inner[at]
            chars.append(json.loads(f'"{piece}"') if e else piece)
            place.append(at)
            at += len(piece)
        place.append(len(inner))
        out += [(m.start(1) + place[a], m.start(1) + place[b]) for a, b in spans("".join(chars), vocabulary)]
    # A member's own name is its assignment context: {"password": "..."}.
    out += [s for s in spans(raw, vocabulary) if all(s[1] <= a or s[0] >= b for a, b in out) and "\\" not in raw[slice(*s)]]
    return sorted(out)


def field_spans(text: str, field: str, vocabulary: str = VOCABULARY) -> list[tuple[int, int]]:
    if not may_hold(text):
        return []
    return json_spans(text, vocabulary) if field == "result" else spans(text, vocabulary)


def mask(text: str, found: list[tuple[int, int]]) -> str:
    out, at = [], 0
    for a, b in found:
        out += [text[at:a], MASK]
        at = b
    return "".join([*out, text[at:]])


def _fields(parts: DataFrame) -> DataFrame:
    """(session_id, message_id, part_id, field_name, value) of every text and result, in one pass over the table."""
    both = F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("value")) for f in ("text", "result")])
    rows = parts.select("session_id", "message_id", F.col("id").alias("part_id"), F.explode(F.filter(both, lambda x: x["value"].isNotNull())).alias("f"))
    return rows.select("session_id", "message_id", "part_id", "f.field_name", "f.value")


_FOUND = pa.schema([(c, pa.string()) for c in ("session_id", "message_id", "part_id", "field_name")])


def find(parts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(session_id, message_id, part_id, field_name) of every field that holds a credential."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, values = batch.column(3).to_pylist(), batch.column(4).to_pylist()
            hit = [i for i, (f, v) in enumerate(zip(fields, values, strict=True)) if field_spans(v, f, vocabulary)]
            yield pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in batch.take(pa.array(hit, pa.int64())).columns[:4]], schema=_FOUND)

    return _fields(parts).mapInArrow(task, "session_id string, message_id string, part_id string, field_name string").distinct()


def redact(parts: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(session_id, message_id, part_id, field_name, masked bigint, value): every field of text with its credentials masked."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, values = [], []
            for f, v in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                found = field_spans(v, f, vocabulary)
                counts.append(len(found))
                values.append(mask(v, found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(counts, pa.int64()), pa.array(values, pa.string())], names=["session_id", "message_id", "part_id", "field_name", "masked", "value"])

    return _fields(parts).mapInArrow(task, "session_id string, message_id string, part_id string, field_name string, masked bigint, value string")
