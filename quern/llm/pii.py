"""Personal information in free text, by a semi-Markov conditional random field.

Whole spans are labelled, not tokens. Candidate segments of each type (name, email, phone,
id_number, address) are scored by features of the whole span: its form, which kinds of words
it is made of, what stands before and behind it, what it touches. Where the end of an entity
is open (a further word, a further group of digits, a town), spans of every length compete. A
labelling is a chain of segments that do not overlap, with text of no label between; its
score is the sum of the segments' scores and of a weight for each pair of labels that follow
each other. Dynamic programming over at most ``MOST`` words a segment chooses boundaries and
types jointly (``decode``).

The weights are trained here by conditional likelihood: forward and backward sums over all
labellings of a few thousand sentences (``gradient``), AdaGrad steps, a quadratic penalty. The
sentences are generated from carrier phrases written for this module, with common and
invented names and numbers and with look-alikes; none of them is taken from the data (a test
looks). The seed is fixed, so every task has the same model.

Kinds of words come from the vocabulary of a public tokenizer (a path): a word that it knows
rather in capitals than in small letters is a proper noun, one that it does not know at all is
likely a name, and a short list of frequent given names tells people from other proper nouns.

Defined results: NULL and blank texts mention nobody; every other text is read by the model, whole at any length;
repeated rows give one row; a login in a remote, command or connection string is no email;
a town without a street is no address; a name inside an email address is none. A name of more than ``MOST``
words is found in pieces.
"""

from __future__ import annotations

import base64
import functools
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.text import id_key
from quern.llm.secrets import VOCABULARY

KINDS = ("name", "email", "phone", "id_number", "address")
PLACEHOLDERS = {"name": "[NAME]", "email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]"}
MOST = 8

_TITLE = r"[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+(?:-[A-ZÀ-ÖØ-Þ][a-zß-öø-ÿ]+)*"
_NAME_TOKEN = re.compile(rf"(?:(?:O['’]|D['’]|Mc|Mac|De|Le|La)(?=[A-ZÀ-ÖØ-Þ]))?{_TITLE}|[A-ZÀ-ÖØ-Þ]{{3,}}(?:-[A-ZÀ-ÖØ-Þ]{{3,}})*|[A-Z]\.")
_PARTICLE = re.compile(r"[^\S\n]+(?:(?:de la|de los|van der|van den|von der|dos|das|de|da|del|della|di|du|van|von|der|den|ter|la|le|el|al|bin|ibn|zu)[^\S\n]+)?")
_INVERTED = re.compile(r",[^\S\n]+")
_HONORIFIC = re.compile(r"\b(?:mr|mrs|ms|miss|dr|prof|herr|frau|monsieur|madame|mme|sr|sra|señor|señora|don|doña)\.?\s+(?P<n>[^\W\d_]{3,}(?:-[^\W\d_]{3,})?)", re.I)
_AT, _DOT = r"(?:@|\s?\(at\)\s?|\s?\[at\]\s?|\s?\{at\}\s?|\s+at\s+(?=[\w-]+\s+dot\s))", r"(?:\.|\s?\(dot\)\s?|\s?\[dot\]\s?|\s+dot\s+)"
_EMAIL = re.compile(rf"(?<![\w.+%-])[A-Za-z0-9](?:[A-Za-z0-9._%+-]*[A-Za-z0-9_+])?{_AT}[A-Za-z0-9-]+(?:{_DOT}[A-Za-z0-9-]+)+")
_PHONE = re.compile(r"(?<![\w.:/@+$-])(?:\+\d{1,3}(?:[\s.-]?\(?\d{1,6}\)?){2,6}|(?:\(\d{2,5}\)[\s.-]?)?\d{2,6}(?:[\s./-]\d{2,6}){1,5})(?:\s*(?:ext|x|extension|Durchwahl)\.?\s*\d{1,5})?(?![\w/:]|[.-]\d)")
_ID_CUE = r"(?:SSN|S\.S\.N\.|social security (?:number|no\.?)|national insurance (?:number|no\.?)|NI(?:NO| number)|passport(?: (?:number|no\.?))?|pasaporte|passeport|Reisepass(?:nummer)?|driver'?s'? licen[cs]e(?: (?:number|no\.?))?|driving licen[cs]e|DNI|NIE|NIF|Steuer-?ID|Steueridentifikationsnummer|Personalausweis(?:nummer)?|tax (?:id|number)|id card(?: (?:number|no\.?))?|INSEE|CURP|SIN|TIN)"
_ID = re.compile(rf"(?<!\w)(?P<cue>{_ID_CUE})(?:\s+(?:is|number|no\.?|ist|es|est))?[\s:#=\"']*(?P<value>[A-Z]{{0,2}}[\s-]?\d(?:[\d\s-]*\d)?(?:[\s-]?[A-Z])?)(?!\w)", re.I)
_ID_BARE = re.compile(r"(?<![\w.-])(?:\d{3}-\d{2}-\d{4}|\d{1,2}-\d{2}-\d{4}|[A-Z]\d{7}|[A-Z]\d{3}-\d{7}|\d{8}[A-Z]|[A-Z]{2} \d\d \d\d \d\d [A-Z]|\d{2} \d{3} \d{3} \d{3})(?![\w-])")
_TOWN = rf"{_TITLE}(?:[ -]{_TITLE}){{0,2}}"
_TAIL = rf"(?:(?:,\s*|\s*\n\s*|\s+)(?:Apt|Apartment|Suite|Unit|Flat|Wohnung|Stock|\d{{1,2}}\.?º)\.?\s*\w{{1,4}})?(?:(?:,\s*|\s*\n\s*)(?:\d{{4,5}}\s+{_TOWN}|{_TOWN}(?:,?\s+\d{{4,5}})?)|(?:,\s*|\s+)\d{{4,5}}\b)?"
_WAY = r"(?:Street|St|Avenue|Ave|Lane|Ln|Road|Rd|Close|Drive|Way|Court|Place|Boulevard|Blvd|Terrace|Square|Crescent|Row|Hill|Green|Gardens)"
_ADDRESS = (
    ("en", re.compile(rf"(?<![\w.-])(?P<head>(?:(?:Flat|Apt|Unit|Suite)\.?\s+\w{{1,4}}(?:,\s*|\s*\n\s*))?\d{{1,5}}[A-Za-z]?\s+(?:[A-Z][\w'-]*\s+){{1,3}}{_WAY}\b\.?){_TAIL}")),
    ("fr", re.compile(rf"(?<![\w.-])(?P<head>\d{{1,4}}(?:\s?(?:bis|ter))?,?\s+(?i:rue|avenue|boulevard|chemin|place|impasse|allée|quai|cours|route)\s+(?:(?:du|de la|des|de|de l'|d')\s*)?{_TITLE})(?:[ -]{_TITLE}){{0,2}}{_TAIL}")),
    ("de", re.compile(rf"(?<!\w)(?P<head>[A-ZÄÖÜ][a-zäöüß]+(?:straße|strasse|str\.|weg|platz|allee|gasse|ring|damm|ufer)\s+\d{{1,4}}(?: ?[a-z]\b)?(?!\d)){_TAIL}")),
    ("es", re.compile(rf"(?<!\w)(?P<head>(?:Calle|C/|Avenida|Avda\.?|Plaza|Paseo|Carrera|Camino)\s+(?:(?:del|de la|de los|de las|de)\s+)?{_TOWN},?\s+\d{{1,4}}(?:,\s*\d{{1,2}}\.?\s?º\s*\w)?){_TAIL}")),
    ("way", re.compile(rf"(?<!\w)(?P<head>(?:[A-Z][\w'-]*\s+){{1,2}}{_WAY}\b(?:\s+\d{{1,4}})?|{_WAY}\s+\d{{1,4}})")),
)

# Frequent given names of several languages; the second list holds those that are also common words.
_GIVEN = frozenset(
    """james robert john michael david william richard joseph thomas charles christopher daniel matthew anthony steven paul andrew joshua kenneth kevin brian george timothy ronald edward jason jeffrey ryan jacob gary nicholas eric
    jonathan stephen larry justin scott brandon benjamin samuel gregory alexander patrick dennis jerry tyler aaron peter henry walter kyle martin mary patricia jennifer linda elizabeth barbara susan jessica sarah karen lisa nancy
    betty margaret sandra ashley kimberly emily donna michelle carol amanda melissa deborah stephanie rebecca sharon laura cynthia kathleen amy angela anna emma nicole helen samantha katherine christine rachel maria julia sophie
    hans klaus jürgen wolfgang stefan andreas ursula monika petra sabine heike jean pierre michel philippe jacques françois camille claire juan josé carlos luis miguel pedro javier carmen ana lucía elena pablo ahmed mohammed fatima
    wei li priya raj oliver noah liam olivia mia lucas hannah leon felix lena nina marco luca giulia paolo""".split()
)
_ALSO_WORD = frozenset("will mark grace rose may june april hope joy frank bill art max jack victor guy grant ray dean jordan faith dawn ruby iris ivy chase drew rob sue pat".split())
# Frequent proper nouns that are no people.
_NO_PERSON = frozenset(
    """monday tuesday wednesday thursday friday saturday sunday january february march april may june july august september october november december english french german spanish italian chinese japanese russian europe america africa
    asia germany france spain england britain london paris berlin madrid washington york boston chicago texas california china japan india russia canada mexico google microsoft amazon apple facebook twitter github gitlab docker linux
    windows ubuntu debian python java javascript typescript rust ruby perl kubernetes postgres redis kafka spark hadoop node react angular django flask chrome firefox safari android mac macos intel nvidia oracle cisco slack zoom
    internet web wifi bluetooth north south east west spring summer autumn winter christmas easter god lord king queen president minister senate congress university college school institute museum""".split()
)

#: Words before and behind a span that may speak for or against a type.
_NAME_CUES = frozenset(
    "by contact hi hello hey dear from client customer author applicant owner reviewer assignee maintainer with to ask asked tell told mr mrs ms miss dr prof thanks thank patient cc user name colleague employee manager tester herr frau monsieur madame señor señora bitte von de mit an firma et y und and for meet met see saw called named regards sincerely cheers greetings attn todo fixme signed".split()
)
_NOT_CUES = frozenset("in at near into of on the a an our this that".split())
_PHONE_CUES = frozenset("call tel telephone phone text mobile cell fax at on unter numéro number ring reach reached sms whatsapp dial file telefon teléfono contact móvil handy tél".split())
_AGAINST = frozenset(
    "build order offset serial port version line row rows job listen retry chunk code ticket issue commit lane step px release suite sprint theme board milestone cluster room host exit range page room team project framework library module server service database api protocol algorithm license bug branch".split()
)
_SAYS = frozenset("asked moved will wants said says wrote writes fragen opened closed tel can could called lives reports agreed needs signed here has is was and knows thinks left joined sent works told replied approved added fixed mentioned porte habite wohnt vive ha hat a".split())
_COMMAND = re.compile(r"(?<!\w)(?:ssh|scp|sftp|rsync|clone|remote)\s")
_WORD = re.compile(r"[^\W\d_]+")
_ALPHA = re.compile(r"[^\W\d_]")
_SPACE = re.compile(r"\s")


@functools.cache
def lexicon(vocabulary: str = VOCABULARY) -> dict[str, tuple[float, float]]:
    """Word in small letters -> bits of its small and of its capitalised form in a ranked vocabulary (99 where it has none)."""
    out: dict[str, tuple[float, float]] = {}
    with open(vocabulary, "rb") as lines:
        for line in lines:
            piece, rank = line.split()
            text = base64.b64decode(piece).decode("utf-8", "replace")
            if text[:1] == " " and len(text) > 3 and text[1:].isalpha():
                word, bits = text[1:], math.log2(int(rank) + 2)
                small, capital = out.get(word.lower(), (99.0, 99.0))
                out[word.lower()] = (min(small, bits), capital) if word.islower() else (small, min(capital, bits))
    for word in ("todo", "fixme", "makefile", "dockerfile", "json", "yaml", "http", "https", "readme"):
        out.setdefault(word, (8.0, 99.0))
    return out


@functools.lru_cache(maxsize=200_000)
def word_kind(word: str, vocabulary: str = VOCABULARY) -> str:
    """g given name, a given name that is also a word, n proper noun of no person, u unknown, p other proper noun, k plain word."""
    low = word.lower()
    if low in _GIVEN:
        return "g"
    if low in _ALSO_WORD:
        return "a"
    if low in _NO_PERSON:
        return "n"
    if low.endswith("file") and len(low) > 4:
        return "k"
    if "-" in low:
        kinds = {word_kind(p, vocabulary) for p in word.split("-") if len(p) > 2}
        return next((k for k in "ugpank" if k in kinds), "k")
    found = lexicon(vocabulary).get(low)
    if found is None:
        return "u" if len(low) > 2 else "k"
    return "p" if found[1] + 1.0 < found[0] else "k"


Segment = tuple[int, int, str, tuple[str, ...]]


class _Page:
    """A text with its words, commands and line ends, looked up by position."""

    def __init__(self, text: str):
        self.text = text
        found = [m.span() for m in _WORD.finditer(text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]
        self._commands: list[int] | None = None

    def before(self, a: int) -> str:
        i = bisect_right(self.ends, a) - 1
        return self.text[self.starts[i] : self.ends[i]].lower() if i >= 0 else ""

    def behind(self, b: int) -> str:
        i = bisect_left(self.starts, b)
        return self.text[self.starts[i] : self.ends[i]].lower() if i < len(self.starts) else ""

    def opens(self, a: int) -> bool:
        """Does a sentence or a line begin here?"""
        at = a - 1
        while at >= 0 and self.text[at] in " \t\"'`([":
            at -= 1
        return at < 0 or self.text[at] in "\n.!?"

    def command(self, a: int) -> bool:
        if self._commands is None:
            self._commands = [m.start() for m in _COMMAND.finditer(self.text)]
        i = bisect_left(self._commands, a) - 1
        return i >= 0 and self._commands[i] > self.text.rfind("\n", self._commands[i], a)


def _glued(text: str, a: int, b: int) -> bool:
    return (a > 0 and (text[a - 1].isalnum() or text[a - 1] in "/@#$%+=_-.")) or (b < len(text) and (text[b].isalnum() or text[b] in "/@#$%+=_" or text[b] == "-" and text[b + 1 : b + 2].isalnum() or text[b] == "." and text[b + 1 : b + 2].isalnum()))


def _name_segments(page: _Page, vocabulary: str, out: list[Segment]) -> None:
    text = page.text
    tokens = [(m.start(), m.end(), m[0], "i" if m[0][-1] == "." else word_kind(m[0], vocabulary)) for m in _NAME_TOKEN.finditer(text)]
    for i, (a, b, word, kind) in enumerate(tokens):
        words, kinds, gaps, count = [word], kind, [], 1
        alone = i == 0 or not _PARTICLE.fullmatch(text, tokens[i - 1][1], a)
        left = "" if alone else tokens[i - 1][3]
        while True:
            more = i + count < len(tokens)
            gap = (_PARTICLE.fullmatch(text, b, tokens[i + count][0]) if more else None) or (_INVERTED.fullmatch(text, b, tokens[i + count][0]) if more and count == 1 else None)
            right = tokens[i + count][3] if gap and "," not in gap[0] else ""
            if "g" in kinds or "u" in kinds or "p" in kinds or "a" in kinds or page.before(a) in _NAME_CUES:
                _add_name(page, a, b, words, kinds, gaps, left, right, out)
            if not gap or count >= MOST:
                break
            gaps = [*gaps, "comma" if "," in gap[0] else "particle" if gap[0].strip() else "space"]
            _, b, word, kind = tokens[i + count]
            words, kinds, count = [*words, word], kinds + kind, count + 1
    for m in _HONORIFIC.finditer(text):
        if m["n"].islower() and word_kind(m["n"], vocabulary) in "ugp":
            out.append((*m.span("n"), "name", ("name:honorific", f"name:honorific:{word_kind(m['n'], vocabulary)}")))


def _add_name(page: _Page, a: int, b: int, words: list[str], kinds: str, gaps: list[str], left: str, right: str, out: list[Segment]) -> None:
    full = [w for w, k in zip(words, kinds, strict=True) if k != "i"]
    if not full or _glued(page.text, a, b) or max(map(len, full)) < 3 and "g" not in kinds:
        return
    shape = kinds.replace("i", "")
    before, behind = page.before(a), page.behind(b)
    cue = before in _NAME_CUES
    if len(full) == 1 and shape in "kn" and not cue:
        return
    person = "g" if "g" in shape else "u" if "u" in shape else "a" if "a" in shape else "p" if "p" in shape else "k"
    pattern = shape if len(shape) < 4 else f"{shape[:2]}+"
    size = min(3, len(full))
    shouted = sum(w.isupper() and len(w) > 2 for w in full)
    f = [f"name:size{size}", f"name:is:{pattern}", f"name:person:{person}{size}", f"name:first:{shape[0]}", f"name:last:{shape[-1]}", f"name:cue{int(cue)}:{person}{size}", f"name:shout{min(shouted, 2)}of{size}:{person}"]
    f += [f"name:gap:{g}:{person}{size}" for g in sorted(set(gaps))]
    f.append(f"name:before:{before}" if before in _NAME_CUES or before in _NOT_CUES else "name:before:other")
    if before in _NOT_CUES:
        f.append(f"name:notcue:{person}{size}")
    says = behind in _SAYS
    f.append(f"name:says{int(says)}:{person}{size}")
    if behind in _AGAINST or before in _AGAINST:
        f.append(f"name:against:{person}")
    if "i" in kinds:
        f.append(f"name:initial:{'first' if kinds[0] == 'i' else 'inside' if kinds[-1] != 'i' else 'last'}:{person}")
    if any(_WAYS.fullmatch(w) for w in full):
        f.append("name:way")
    if page.text[max(0, a - 2) : a].strip(" ").isdigit():
        f.append(f"name:number:{person}")
    if page.opens(a):
        f.append(f"name:opens:{pattern}:says{int(says)}" if size < 3 else "name:opens:long")
    f += [f"name:left:{left or '-'}", f"name:right:{right or '-'}"]
    out.append((a, b, "name", tuple(f)))


def _pattern_segments(page: _Page, vocabulary: str, out: list[Segment]) -> None:
    text = page.text
    head = seen = 0
    for m in _EMAIL.finditer(text):
        a, b = m.span()
        # Start of the run of non-spaces that leads up to the address, carried from match to match.
        for space in _SPACE.finditer(text, seen, a):
            head = space.end()
        seen = a
        f = ["email:plain" if "@" in m[0] else "email:disguised"]
        lead = text[head:a] if a - head < 4096 else text[a - 4096 : a]
        if "://" in lead or re.search(r"\w:[^\s]*$", lead) and "=" not in lead and '"' not in lead and "'" not in lead and "mailto" not in lead.lower() or re.match(r":[\w/~]|/\w", text[b : b + 2]):
            f.append("email:login")
        if page.command(a):
            f.append("email:command")
        if re.search(r"@\d|\d+\.\d+\.\d+$", m[0]):
            f.append("email:version")
        out.append((a, b, "email", tuple(f)))
    for m in _PHONE.finditer(text):
        groups = list(re.finditer(r"\d+", m[0]))
        # The whole run competes with runs of one group less at either end.
        spans = {m.span()}
        if len(groups) > 2:
            spans |= {(m.start(), m.start() + groups[-2].end()), (m.start() + groups[1].start(), m.end())}
        for a, b in sorted(spans):
            _add_phone(page, a, b, out, (a, b) == m.span())
    named = {}
    for m in _ID.finditer(text):
        if sum(c.isdigit() for c in m["value"]) >= 5:
            named[m.span("value")] = True
            # A letter behind the number may belong to it or to the next word.
            if re.search(r"[\s-][A-Za-z]$", m["value"]):
                named.setdefault((m.start("value"), m.end("value") - 2), False)
    out += [(a, b, "id_number", ("id:cue", f"id:cue:whole{int(whole)}")) for (a, b), whole in sorted(named.items())]
    for m in _ID_BARE.finditer(text):
        if m.span() in named:
            continue
        before, behind = page.before(m.start()), page.behind(m.end())
        f = ["id:bare", f"id:bare:{re.sub(r'[A-Z]', 'A', re.sub(r'[0-9]', '9', m[0]))}"]
        if before in _AGAINST or behind in _AGAINST:
            f.append("id:against")
        out.append((*m.span(), "id_number", tuple(f)))
    for lang, pattern in _ADDRESS:
        for m in pattern.finditer(text):
            a, b = m.span()
            f = [f"address:{lang}", f"address:tail{int(',' in m[0] or chr(10) in m[0])}:{'full' if lang != 'way' else 'way'}"]
            if _glued(text, a, b):
                f.append("address:glued")
            # The town may swallow the first words of the next sentence: shorter spans compete with the whole.
            end = m[0]
            for cut in range(4):
                last = re.split(r"\s+", end)[-1].strip(".,")
                ending = "number" if last[-1:].isdigit() else word_kind(last, vocabulary) if last else "k"
                out.append((a, a + len(end), "address", (*f, f"address:cut{min(cut, 2)}:ends:{ending}", f"address:ends:{ending}", f"address:comma{int(end.rstrip().endswith(','))}")))
                shorter = re.sub(r"\s+\S+$", "", end)
                if lang == "way" or ending == "number" or shorter == end or len(shorter) < m.end("head") - a or not re.search(r"[^\W\d_]$", shorter):
                    break
                end = shorter


def _add_phone(page: _Page, a: int, b: int, out: list[Segment], whole: bool) -> None:
    v = page.text[a:b]
    digits = sum(c.isdigit() for c in re.split(r"[a-zA-Z]", v)[0])
    if digits < 6:
        return
    groups = re.findall(r"\d+", v)
    before, behind = page.before(a), page.behind(b)
    form = "plus" if v[0] == "+" else "paren" if v[0] == "(" else "ext" if _ALPHA.search(v) else "zero" if v[0] == "0" and " " in v else "dotted" if re.fullmatch(r"\d{3}\.\d{3}\.\d{4}", v) else "dashed" if re.fullmatch(r"\d{3}-\d{3}-\d{4}", v) else "date" if re.fullmatch(r"\d{4}-\d\d-\d\d", v) else "dots" if re.fullmatch(r"[\d.]+", v) else f"{len(groups)}groups"
    cue = int(before in _PHONE_CUES)
    f = [f"phone:{form}", f"phone:{form}:cue{cue}", f"phone:digits{'<9' if digits < 9 else '9+' if digits < 14 else '14+'}", f"phone:cue{cue}", f"phone:whole{int(whole)}", f"phone:whole{int(whole)}:{form}"]
    if before in _AGAINST or behind in _AGAINST:
        f.append("phone:against")
    if _glued(page.text, a, b):
        f.append("phone:glued")
    out.append((a, b, "phone", tuple(f)))


def segments(text: str, vocabulary: str = VOCABULARY) -> list[Segment]:
    """Candidate segments with their features, in order of their ends."""
    out: list[Segment] = []
    page = _Page(text)
    _name_segments(page, vocabulary, out)
    if any(c in text for c in "0123456789@") or "(at)" in text or "[at]" in text or "{at}" in text or " at " in text or _WAYS.search(text):
        _pattern_segments(page, vocabulary, out)
    return sorted(out, key=lambda s: (s[1], s[0], s[2]))


_WAYS = re.compile(rf"\b{_WAY}\b")
_LABEL = {k: i for i, k in enumerate(KINDS)}


class Model:
    """Weights of span features and of labels that follow each other (the last row: a text's first label)."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.weights = np.zeros(0)
        self.table: dict[str, float] = {}
        self.follow = np.zeros((len(KINDS) + 1, len(KINDS)))

    def freeze(self) -> Model:
        self.table = {f: float(self.weights[i]) for f, i in self.number.items()}
        self.rows = self.follow.tolist()
        return self


def decode(found: list[Segment], model: Model) -> list[Segment]:
    """The likeliest labelling: the best chain of segments, by dynamic programming over their ends."""
    table, rows, first = model.table, model.rows, len(KINDS)
    into = [max(r[k] for r in rows) for k in range(first)]
    out_of = [max(0.0, *rows[k]) for k in range(first)]
    # Per label: ends, scores so far and where they come from; scores only grow along a list.
    ends: list[list[int]] = [[] for _ in KINDS]
    best: list[list[tuple[float, int]]] = [[] for _ in KINDS]
    back: list[tuple[Segment, int]] = []
    top, top_at = 0.0, -1
    for s in found:
        k = _LABEL[s[2]]
        own = sum([table.get(f, 0.0) for f in s[3]])
        if own + into[k] + out_of[k] <= 0:
            continue
        score, come = own + rows[first][k], -1
        for other in range(first):
            i = bisect_right(ends[other], s[0]) - 1
            if i >= 0 and best[other][i][0] + rows[other][k] + own > score:
                score, come = best[other][i][0] + rows[other][k] + own, best[other][i][1]
        back.append((s, come))
        if score > top:
            top, top_at = score, len(back) - 1
        if not best[k] or score > best[k][-1][0]:
            ends[k].append(s[1])
            best[k].append((score, len(back) - 1))
    out = []
    while top_at >= 0:
        s, top_at = back[top_at]
        out.append(s)
    return out[::-1]


def gradient(found: list[tuple[int, int, int, np.ndarray]], gold: set[int], model: Model) -> tuple[np.ndarray, np.ndarray, float]:
    """Expected minus true counts of one text: per segment, per pair of labels, and the log likelihood of the truth.

    ``found`` are candidates (start, end, label, features) in order of their ends, ``gold`` the true ones.
    """
    n, first = len(found), len(KINDS)
    a, b, k = (np.array([s[i] for s in found]) for i in range(3))
    own = np.array([model.weights[s[3]].sum() for s in found])
    step = np.where(b[:, None] <= a[None, :], model.follow[k][:, k], -np.inf)  # from row to column
    opening = model.follow[first][k]
    forward, backward = np.empty(n), np.zeros(n)
    with np.errstate(divide="ignore"):
        for i in range(n):
            forward[i] = own[i] + np.logaddexp(opening[i], np.logaddexp.reduce(forward[:i] + step[:i, i]) if i else -np.inf)
        total = np.logaddexp(0.0, np.logaddexp.reduce(forward))
        for i in range(n - 1, -1, -1):
            backward[i] = np.logaddexp(0.0, np.logaddexp.reduce((step[i] + own + backward)[i + 1 :])) if i + 1 < n else 0.0
    single = np.exp(forward + backward - total)
    pair = np.exp(forward[:, None] + step + own[None, :] + backward[None, :] - total)
    follow = np.zeros_like(model.follow)
    np.add.at(follow, (k[:, None].repeat(n, 1), k[None, :].repeat(n, 0)), pair)
    np.add.at(follow[first], k, np.exp(opening + own + backward - total))
    score, last = -total, first
    for i in sorted(gold, key=lambda i: a[i]):
        single[i] -= 1
        follow[last, k[i]] -= 1
        score += own[i] + model.follow[last, k[i]]
        last = k[i]
    return single, follow, score


# Carrier phrases, written for this module. {name} {email} {phone} {idcue} {address} are entities, the rest is not.
_CARRIERS = """
Kindly forward this to {name} before noon.|I spoke with {name} about the budget.|{name} said the tests were flaky.|We met {name} and {name} at the fair.|The author is {name}|It was {name} who found the leak.|According to {name}, nothing changed.|Greetings {first}, how was the trip?
Hey {first}!|Dear {first},\\nmany thanks for the parcel.|Dear Mr {last},|Cheers,\\n{first}|Best regards\\n{name}|Yours sincerely,\\n{name}\\n{phone}|Mrs {last} signed the lease.|Mr {last} has been on leave since March.|please tell dr. {lower} about it|prof {lower} agreed|Dr {last} knows the patient.
Acked-by: {name} <{email}>|Co-developed-by: {name} <{email}>|Tested-by: {name} <{email}>|Reported-by: {name}|maintainer: "{name}"|assignee={name}|"full_name": "{name}", "passport_ref": "{idcue}"|<person name="{name}" tel="{phone}" mail="{email}"/>|# XXX({name}) needs care|-- FIXME {name}: slow|{name};{phone};{email};{address}
employee,{name},{email},{phone}|{email},{name},{address}|[{name}]|- {name}|* {name} ({email})|| {name} | {phone} | {email} ||| {name} | {idcue} | {address} ||{name}: sounds good to me|[09:15] {name}: on my way|Attendees: {name}, {name}, {name}|cc {name}
mailto:{email}?subject=hello|?login={email}&next=2|email={email}|Write to {email} or ring {phone}.|My mail is {email}.|reach me under {email}, please|from {email} to {email}|Dial {phone} and ask for {name}.|Tel: {phone}|Fax {phone}|Mobile {phone}, office {phone}.|WhatsApp {phone} is best.|The hotline {phone} was busy.|his cell is {phone}
Bring it to {address}.|My new home is {address}.|She has lived at {address} since 2019.|Billing: {name}, {address}|recipient:\\n{name}\\n{address}|Parcel for {name}\\n{address}\\nFragile.|Pick up at {address} and go.|Adresse : {address}|Wir wohnen in der {address}.|Vivo en {address}.|The flat at {address} The {word} came later.|{address} Where is the {word}?
Frau {last} ist im Urlaub.|Ich habe mit {name} gesprochen.|Rückruf an {name} unter {phone}.|Monsieur {last} est parti.|Appelez {name} au {phone}.|Señora {last} no está.|Pregunta a {name} por el informe.|Die Unterlagen von {name} fehlen.|La demande de {name} est close.|Llame a {name} al {phone}.
My {idcue} was leaked.|Scan shows {idcue} and more.|{name} ({idcue}) is cleared.|Please remove {idcue} from the log.|holder {name}, {idcue}|"{idcue}"|{idcue}|{name} and {name} left early.|{name} moved away in June.|{last} fixed it.|{last} wrote the parser.|{first} and {first} paired on it.|Thanks {first} for the {word}.|Ask {first} first.
Talk to {name}, they know the service.|{name} works here.|This was agreed with {name}.|The patch from {name} looks fine.|Is {name} around?|I think {name} left.|called {name} twice|{name}|{phone}|{email}|{address}|{first} {word} the {word}.|Please ask {name} about the {word}.|the {word} that {name} added|{name} replied to {name} that the {word} is {word}.
The {title} {title} campaign ends soon.|That was for the {title} {title} project.|We named it the {title} {title} board.|the {title} {title} cluster is down|Meet in the {title} Room.|The {title} Road theme is too dark.|Square {n} and Row {n} overlap.|Lane {n} is blocked.|Court mode is on.|Build {build} went red after {n} runs.|Terrace {n}
Order {order} came in twice.|order number {order}|Offset {offset} is beyond the file.|Serial {serial} is broken.|serial no {serial}|Bind 127.0.0.1:{n} or 10.1.{n}.{n}.|git clone git@code.example:apps/{word}.git|git remote set-url origin https://ci:{token}@code.example/apps/y.git|mysql://svc:{token}@db1.example:{n}/app|amqp://app@mq.example:{n}/v|rsync -a run@box.example:/srv .
ssh ops@gate.example uptime|sftp backup@store.example|bump @scope/pkg@{n}.{n}.{n} please|decorate with @cached @ line {n}|I changed {made} only.|The trace starts in {made}.|failed in {made}: again|We keep it in {made}.|Rename {made} to {made}.|{made} holds the settings.|Call {made} before {made}.|see {made} and {made}.
{title} the {word} first.|{title} again.|{title} {title}|## {title} {title} {title}|The {title} is {word}.|{title}: {word}|Open {title} and click {title}.|Use {proper} or {proper}.|We run it on {proper}.|{proper} {proper} is a product.|{proper} released a new version.|The {proper} API changed.|Written in {proper}.|On {proper} we meet.|in {proper} and {proper}
Version {n}.{n}.{n} came in 2023-0{d}-1{d}.|exit status {n}, line {n}|{n} ms, {n} rows|at {n}:{n} on 2023-1{d}-2{d} 1{d}:2{d}:3{d}|id 7b2c-{n}-{n}-{n}|pages {n}-{n}|{n} of {n} done|range {n} {n}|The depot in {town} is shut.|Our {town} office is small.|We fly to {town} next week.|in {town}|near {town} there is a {word}|secret = "{title}{title}{n}!"
Author: release bot|User: admin|Name: {word}|to: the {word} team|from {word} to {word}|{title}-{n}-{word}|TODO: {word} the {word}|NOTE: the {word} is {word}|WARNING: {word}|GET /items/{n}|{title} {n}|Step {n}: {title} the {word}|SELECT {word} FROM {word}|The {word} {word} was {word} by the {word}.|Hello world, {word}.|Thanks for the {word}.|Hi team,|Dear all,
It failed from {title}, row {n}.|repeat that for {title}|patched by {title}|compare with {title} and {title}|went to {title} at last|from {title}|for {title} only|link to {title}, then with {title}|errors from {file} in row {n}|done for {file}|moved to {file}|by {file}|with {file} and {file}
"""  # fmt: skip


class _Maker:
    """Fills carrier phrases with common and invented people, numbers and look-alikes."""

    def __init__(self, seed: int, vocabulary: str):
        self.r = random.Random(seed)
        words = lexicon(vocabulary)
        self.known = words
        fit = sorted(w for w in words if 4 <= len(w) <= 9 and w.isascii())
        self.plain = [w for w in fit if word_kind(w, vocabulary) == "k"]
        self.proper = [w for w in fit if word_kind(w, vocabulary) == "p"]
        self.given, self.doubtful, self.things = sorted(_GIVEN), sorted(_ALSO_WORD), sorted(_NO_PERSON)

    def made(self, parts: int) -> str:
        r = self.r
        while True:
            word = "".join(r.choice(["b", "br", "d", "dr", "f", "g", "h", "j", "k", "l", "m", "n", "p", "qu", "r", "s", "st", "t", "v", "w", "z", "th"]) + r.choice(["a", "e", "i", "o", "u", "ie", "aa"]) for _ in range(parts)) + r.choice(["", "n", "sk", "l", "rt", "ck", "nd"])
            if word not in self.known:
                return word.capitalize()

    def first(self) -> str:
        pick = self.r.random()
        return (self.r.choice(self.given) if pick < 0.5 else self.r.choice(self.doubtful) if pick < 0.55 else self.r.choice(self.proper) if pick < 0.6 else self.made(2)).capitalize()

    def last(self) -> str:
        pick = self.r.random()
        return (self.made(self.r.choice([2, 3])) if pick < 0.5 else self.r.choice(self.proper) if pick < 0.8 else self.r.choice(self.plain) if pick < 0.95 else self.r.choice(self.given)).capitalize()

    def slot(self, kind: str) -> tuple[str, str]:
        r, d = self.r, lambda n: "".join(self.r.choice("0123456789") for _ in range(n))
        first, last = self.first(), self.last()
        if kind == "name":
            double = f"{last}-{self.made(3)}" if r.random() < 0.12 else last
            particle = r.choice(["de la ", "van ", "von ", "dos ", "del "]) if r.random() < 0.1 else ""
            pick = r.random()
            form = f"{first} {particle}{double}" if pick < 0.6 else f"{first} {first[0]}. {double}" if pick < 0.72 else f"{first[0]}. {double}" if pick < 0.82 else f"{last.upper()} {first}" if pick < 0.9 else f"{last}, {first}" if pick < 0.96 else f"{first} {self.first()} {double}"
            return form, "name"
        if kind in ("first", "last", "lower"):
            return {"first": first, "last": last, "lower": self.made(2).lower()}[kind], "name"
        if kind == "email":
            host = r.choice(["corp.example", "inbox.example.org", "firm.test", "a.b.example.com", "uni.invalid"])
            user = r.choice([f"{first}.{last}", f"{first}{d(2)}", f"{last}+x", f"{first[0]}_{last}"]).lower()
            return r.choice([f"{user}@{host}", f"{user}@{host}".upper(), f"{user} (at) {host}", f"{user}[at]{host.replace('.', '[dot]')}", f"{user} at {host.replace('.', ' dot ')}"]), "email"
        if kind == "phone":
            return r.choice([f"+49 {d(3)} {d(4)} {d(3)}", f"+1-{d(3)}-{d(3)}-{d(4)}", f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"0{d(2)} {d(4)} {d(4)}", f"0{d(1)} {d(2)} {d(2)} {d(2)} {d(2)}", f"{d(3)}-{d(4)} ext. {d(3)}", f"+44 {d(4)} {d(6)}", f"+61 {d(1)} {d(4)} {d(4)}", f"+33 {d(1)} {d(2)} {d(2)} {d(2)} {d(2)}"]), "phone"
        if kind == "idcue":
            value = r.choice([("SSN ", f"{d(3)}-{d(2)}-{d(4)}"), ("social security no. ", f"{d(3)} {d(2)} {d(4)}"), ("passport ", f"K{d(7)}"), ("passport number ", f"X{d(7)}"), ("DNI ", f"{d(8)}A"), ("Steuer-ID ", f"{d(2)} {d(3)} {d(3)} {d(3)}"), ("driver's license ", f"A{d(3)}-{d(7)}"), ("NI number ", f"QQ {d(2)} {d(2)} {d(2)} C"), ("tax id ", d(9)), ("id card no. ", d(8)), ("INSEE ", d(13))])
            return "\0".join(value), "id_number"
        if kind == "address":
            way, town = f"{r.choice(self.plain).capitalize()} {r.choice(['Street', 'Lane', 'Avenue', 'Rd.', 'Rd', 'Close', 'Drive', 'Court', 'Green'])}", r.choice([self.made(3), self.made(3), self.r.choice(self.proper).capitalize()])
            return r.choice([f"{d(2)} {way}, {town} {d(5)}", f"1{d(2)} Old {way}, Apt {d(2)}, {town}", f"Flat 1{d(1)}, 3{d(2)} {way}, {town}", f"{d(2)} {way}", f"4{d(1)} rue des {self.made(2)}, {d(5)} {town}", f"{self.made(2)}straße 5{d(1)}, {d(5)} {town}", f"Calle {self.made(2)} 7{d(1)}, 5.º B, {d(5)} {town}", f"{self.made(2)}straße 5{d(1)}\n{d(5)} {town}", f"{d(3)} {way}\nApt {d(1)}\n{town}"]), "address"
        text = {"title": lambda: r.choice(self.plain).capitalize(), "proper": lambda: r.choice(self.things if r.random() < 0.7 else self.proper).capitalize(), "word": lambda: r.choice(self.plain), "n": lambda: d(r.choice([1, 2, 3])), "d": lambda: r.choice("012345"), "build": lambda: f"555-0{d(3)}", "order": lambda: f"{d(3)} {d(3)} {d(3)}", "offset": lambda: f"{d(1)}-{d(2)}-{d(4)}", "serial": lambda: f"X{d(7)}",
                "file": lambda: f"{r.choice(self.plain).capitalize()}file", "made": lambda: r.choice([self.made(3), f"{self.made(2).lower()}_{r.choice(self.plain)}", f"{r.choice(self.plain).capitalize()}file"]), "town": lambda: self.made(3), "token": lambda: f"{self.made(2)}{d(3)}{self.made(2)}"}[kind]()
        return text, ""

    def sentence(self) -> tuple[str, set[tuple[int, int, str]]]:
        """One phrase, or two in a row: labels follow labels."""
        text, gold = "", set()
        for phrase in self.r.sample(PHRASES, self.r.choice([1, 1, 2])):
            text += self.r.choice([" ", "\n"]) if text else ""
            for i, piece in enumerate(re.split(r"\{(\w+)\}", phrase)):
                cue, value, kind = "", piece, ""
                if i % 2:
                    filled, kind = self.slot(piece)
                    cue, _, value = filled.rpartition("\0")
                if kind:
                    gold.add((len(text) + len(cue), len(text) + len(cue) + len(value), kind))
                text += cue + value
        return text, gold


PHRASES = [p.replace("\\n", "\n") for line in _CARRIERS.strip().split("\n") for p in line.split("|") if p.strip()]


@functools.cache
def train(vocabulary: str = VOCABULARY, sentences: int = 4000, epochs: int = 2, seed: int = 11, rate: float = 0.5, penalty: float = 1e-4) -> Model:
    """Weights of largest penalised conditional likelihood over generated sentences, by AdaGrad."""
    maker, model = _Maker(seed, vocabulary), Model()
    data = []
    for _ in range(sentences):
        text, gold = maker.sentence()
        found = segments(text, vocabulary)
        if found:
            rows = [(a, b, _LABEL[kind], np.array([model.number.setdefault(f, len(model.number)) for f in fs])) for a, b, kind, fs in found]
            # Where several patterns propose a true span, the last one counts.
            truth = {(a, b, kind): i for i, (a, b, kind, _) in enumerate(found) if (a, b, kind) in gold}
            data.append((rows, set(truth.values())))
    model.weights = np.zeros(len(model.number))
    seen, seen_follow = np.full(len(model.number), 1e-2), np.full(model.follow.shape, 1e-2)
    for _ in range(epochs):
        maker.r.shuffle(data)
        for rows, gold in data:
            single, follow, _ = gradient(rows, gold, model)
            at = np.concatenate([r[3] for r in rows])
            slope = np.bincount(at, np.repeat(single, [len(r[3]) for r in rows]), len(seen))
            at = np.unique(at)
            slope = slope[at] + penalty * model.weights[at]
            seen[at] += slope * slope
            model.weights[at] -= rate * slope / np.sqrt(seen[at])
            follow += penalty * model.follow
            seen_follow += follow * follow
            model.follow -= rate * follow / np.sqrt(seen_follow)
    return model.freeze()


def mentions(text: str, model: Model, vocabulary: str = VOCABULARY) -> list[tuple[int, int, str]]:
    if not text:
        return []
    found = segments(text, vocabulary)
    return [s[:3] for s in decode(found, model)] if found else []


def mask(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in found:
        out += [text[at:a], PLACEHOLDERS[kind]]
        at = b
    return "".join([*out, text[at:]])


def texts(parts: DataFrame, messages: DataFrame) -> DataFrame:
    """(session_id, message_id, part_id, value): the fields that people are mentioned in; message_id in comparison form."""
    p = parts.where("text is not null").select("session_id", id_key("message_id").alias("message_id"), F.col("id").alias("part_id"), F.col("text").alias("value"))
    m = messages.where("content is not null").select("session_id", id_key("id").alias("message_id"), F.lit("").alias("part_id"), F.col("content").alias("value"))
    return p.unionByName(m)


_FOUND = pa.schema([(c, pa.string()) for c in ("session_id", "message_id", "part_id", "kind")])


def find(parts: DataFrame, messages: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(session_id, message_id, part_id, kind), one row per field and kind found in it."""
    model = train(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, kinds = [], []
            for i, value in enumerate(batch.column(3).to_pylist()):
                for kind in {k for _, _, k in mentions(value, model, vocabulary)}:
                    rows.append(i)
                    kinds.append(kind)
            hit = batch.take(pa.array(rows, pa.int64()))
            yield pa.RecordBatch.from_arrays([*(c.cast(pa.string()) for c in hit.columns[:3]), pa.array(kinds, pa.string())], schema=_FOUND)

    return texts(parts, messages).mapInArrow(task, "session_id string, message_id string, part_id string, kind string").distinct()


def redact(parts: DataFrame, messages: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(session_id, message_id, part_id, mentions bigint, value): every text with typed placeholders."""
    model = train(vocabulary)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, values = [], []
            for value in batch.column(3).to_pylist():
                found = mentions(value, model, vocabulary)
                counts.append(len(found))
                values.append(mask(value, found))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64()), pa.array(values, pa.string())], names=["session_id", "message_id", "part_id", "mentions", "value"])

    return texts(parts, messages).mapInArrow(task, "session_id string, message_id string, part_id string, mentions bigint, value string")
