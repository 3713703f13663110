"""PII surrogates: keyed replacements of the same type and form, distinct and coreferent.

1. Detection finds e-mail addresses, telephone, card, account (IBAN) and IP numbers, secret tokens and titled person
   names in whole texts. Within a text a person is carried on: an untitled repeat of the name, and its
   family or given name alone (with a title or without), are mentions of the same person and receive
   the same part of the surrogate. What is compared is the canonical value (letter case and separators
   aside), so all mentions of one entity share a surrogate.
2. A surrogate is drawn from HMAC-SHA256(key, type, canonical value, attempt) and takes the mention's
   form: digits for digits and letters for letters of the same case and script, separators in place,
   a given name of the same gender, which the title tells or else the given name; one gender for all
   mentions of a name in the corpus. Mail goes to the reserved domain example and addresses lie in
   10.0.0.0/8 and fd00::/8, so no one is reached by a surrogate.
3. Collision checks: the distinct entities of all documents are grouped by surrogate. Of those that
   share one, or whose surrogate is itself an entity of the corpus, all but the first draw again,
   until none is left. Only what drew again, or is said with different genders, is handed to the rewriting pass.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType, _parse_datatype_string

from panelworks.llm.names import unused
from panelworks.session import checkpoint

#: Redrawn surrogates are broadcast up to this many rows (some 100 bytes each), else joined.
BROADCAST_ROWS = 50_000
ATTEMPTS = 64

# Given names by gender and script; titles by gender.
GIVEN = {
    ("female", "LATIN"): "Alice Anna Carla Clara Diana Elena Emma Eva Grace Helen Ines Julia Laura Lena Lucia Maria Mary Nora Olga Paula Rosa Sara Sofia Vera".split(),
    ("male", "LATIN"): "Adam Alan Bruno Carl Carlos David Diego Emil Erik Felix Hugo Ivan James John Jonas Juan Karl Louis Luis Marc Oscar Paul Peter Simon Victor".split(),
    ("female", "CYRILLIC"): "Анна Вера Галина Дарья Елена Ирина Мария Наталья Ольга Светлана".split(),
    ("male", "CYRILLIC"): "Алексей Борис Виктор Дмитрий Иван Михаил Николай Олег Павел Сергей".split(),
    ("female", "GREEK"): "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Ιωάννα Κατερίνα Μαρία Σοφία".split(),
    ("male", "GREEK"): "Αλέξανδρος Ανδρέας Γιάννης Γιώργος Δημήτρης Κώστας Νίκος Πέτρος Σπύρος Χρήστος".split(),
}
#: Ends of drawn names by gender and script, for a lone name that is in no list.
ENDS = {
    ("female", "LATIN"): "a ia ina ella".split(), ("male", "LATIN"): "o us er on".split(),
    ("female", "CYRILLIC"): "ова ина ева".split(), ("male", "CYRILLIC"): "ов ин ев".split(),
    ("female", "GREEK"): "α η ου".split(), ("male", "GREEK"): "ος ης ας".split(),
}
TITLES = {
    "Mr": "male", "Mrs": "female", "Ms": "female", "Miss": "female", "Herr": "male", "Frau": "female", "Monsieur": "male", "Madame": "female", "Señor": "male", "Señora": "female",
    "Dr": None, "Doctor": None, "Prof": None, "Professor": None,
}
_TOLD = {t.casefold(): gender for t, gender in TITLES.items()}
_GENDER = {name.casefold(): gender for (gender, _), names in GIVEN.items() for name in names}

# Two-digit calling codes; 1 and 7 have one digit and all others three.
_CODES = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
#: Lower-case words inside names; they stay, and a capitalised word must follow.
PARTICLES = frozenset("van von der den de del della di da dos du la le zu bin al ter ten y".split())


def _upper_class() -> str:
    """A pattern class of all upper-case and title-case letters, which ``re`` has no name for."""
    codes = [c for c in range(0x110000) if chr(c).isupper() or chr(c).istitle()]
    starts = [c for i, c in enumerate(codes) if not i or codes[i - 1] != c - 1]
    ends = [c for i, c in enumerate(codes) if i + 1 == len(codes) or codes[i + 1] != c + 1]
    return "[" + "".join(chr(a) if a == b else f"{chr(a)}-{chr(b)}" for a, b in zip(starts, ends)) + "]"


_UP = _upper_class()
# A capitalised word (O'Brien is one) after initials and particles; no part begins with a lower-case letter but particles.
_NAME_WORD = rf"(?:(?:{'|'.join(sorted(PARTICLES))})[ ])*(?:{_UP}\.[ -]?)*{_UP}(?:\w+|(?=['’]{_UP}))(?:['’]{_UP}\w*)*"
# Scripts without letter case: a run of their letters is a name where a title stands before it.
_PLAIN = "[\\u0590-\\u06ff\\u0900-\\u0e7f\\u10d0-\\u10ff\\u3041-\\u30ff\\u3400-\\u9fff\\uac00-\\ud7a3]"
_NAME = rf"(?:{_NAME_WORD}(?:[ -]{_NAME_WORD})*|{_PLAIN}{{2,}}(?:[ ・]{_PLAIN}{{2,}})?)"
_LONGEST = sorted(TITLES, key=len, reverse=True)
# As written or in capitals; abbreviations in lower case need their dot.
_TITLE = rf"(?:(?:{'|'.join([*_LONGEST, *(t.upper() for t in _LONGEST)])})\b|(?:mrs|mr|ms|dr|prof)(?=\.))"
_GAP = r"[ ./\-   ‐‑]{0,2}"
# One pattern finds every kind; the first alternative that fits at a place decides. Numbers with a plus sign have 8 to 15
# digits in any groups (11 after +1).
_ENTITY = re.compile(
    r"(?P<email>(?<![\w.+-])[^\W_][\w.%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})*\.[A-Za-z]{2,24}(?![\w-]))"
    rf"|(?P<phone>(?<![\w+])\+1(?:{_GAP}\(?\d\)?){{10}}(?!\d)|(?<![\w+])\+\d(?:{_GAP}\(?\d\)?){{7,14}}(?!\d)"
    r"|(?<![\w+(])\(\d{3}\) ?\d{3}-\d{4}(?!\d)|(?<![\w.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\w.-]*\d))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]*\d))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9]))"
    r"|(?P<card>(?<![\w.-])(?:\d{4}(?P<sep>[ -]?)\d{4}(?P=sep)\d{4}(?P=sep)\d{4}|3[47]\d{2}(?P<gap>[ -]?)\d{6}(?P=gap)\d{5})(?![\w-]*\d))"
    r"|(?P<ipv4>(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\w))"
    r"|(?P<ipv6>(?<![\w:.])(?:[A-Fa-f0-9]{1,4}:){2,7}(?::?[A-Fa-f0-9]{1,4})(?::[A-Fa-f0-9]{1,4}){0,5}(?![\w:]))"
    r"|(?P<token>(?<![A-Za-z0-9])(?=[A-Fa-f]*\d)(?=\d*[A-Fa-f])[A-Fa-f0-9]{32,64}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9]))"
    rf"|(?P<person>\b(?P<titles>(?:{_TITLE}\.?[ ])+)(?P<name>{_NAME}))"
)
#: No entity but a person is without one of these; most texts have none and are left after one quick look.
_HINT = re.compile("[0-9@]|AKIA|ASIA")
_TITLED = re.compile(rf"\b{_TITLE}")
KINDS = ("email", "phone", "ssn", "iban", "card", "ipv4", "ipv6", "token", "person")
_CAPITAL = re.compile(rf"(?<!\w)(?:{_UP}\w*|{_PLAIN}{{2,}})")
_INITIAL = re.compile(rf"{_UP}\.", re.I)


@dataclass(frozen=True)
class Mention:
    """An entity's place in a text, its canonical value, a person's gender, and which words of the name are said."""

    start: int
    end: int
    kind: str
    value: str
    gender: str | None = None
    words: tuple[int, int] | None = None


def find(text: str | None) -> list[Mention]:
    """The entities of a text in order; none overlap."""
    if not text or not (_HINT.search(text) or _TITLED.search(text)):
        return []
    out, named, at = [], [], 0
    while m := _ENTITY.search(text, at):
        kind, at = next(k for k in KINDS if m[k] is not None), m.end()
        if kind == "iban" and not _sound_iban(m[0]) or kind == "ipv6" and not _groups(m[0]):
            at = m.start() + 3  # what looked like one may hold something else
        elif kind == "iban":
            out.append(Mention(m.start(), m.end(), kind, m[0].replace(" ", "").casefold()))
        elif kind == "ipv6":
            out.append(Mention(m.start(), m.end(), kind, ":".join(f"{g:x}" for g in _groups(m[0]))))
        elif kind == "person":
            told = [_TOLD[t.casefold()] for t in re.findall(r"\w+", m["titles"]) if _TOLD[t.casefold()]]
            named.append((m.start("name"), m.end("name"), m["name"], told[0] if told else None))
        elif kind in ("email", "token"):
            out.append(Mention(m.start(), m.end(), kind, m[0].casefold()))
        elif kind == "ipv4":
            out.append(Mention(m.start(), m.end(), kind, ".".join(str(int(x)) for x in m[0].split("."))))
        else:
            # The plus sign tells +45 12 34 56 78 from (451) 234-5678; a trunk zero in brackets is no part of the number.
            plus = "+" if m[0][0] == "+" else ""
            out.append(Mention(m.start(), m.end(), kind, plus + re.sub(r"\D", "", m[0].replace("(0)", "") if plus else m[0])))
    if named:
        out = sorted(out + _persons(text, named, out), key=lambda x: x.start)
    return out


def _sound_iban(said: str) -> bool:
    """Whether an account number has ten digits or more and passes its check."""
    plain = said.replace(" ", "")
    return len(plain) >= 15 and sum(c.isdigit() for c in plain) >= 10 and _remainder(plain) == 1


def _remainder(iban: str) -> int:
    """The account number as one number, its first four places last and letters as 10 to 35, modulo 97."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _groups(said: str) -> list[int] | None:
    """The eight groups of an IPv6 address; None if it is none, or has fewer than three groups in writing."""
    try:
        packed = ipaddress.IPv6Address(said).packed
    except ValueError:
        return None
    return [int.from_bytes(packed[i : i + 2], "big") for i in range(0, 16, 2)] if sum(map(bool, said.split(":"))) > 2 else None


def _words(name: str) -> list[str]:
    return re.split("[ -]", name)


def _persons(text: str, named: list[tuple], others: list[Mention]) -> list[Mention]:
    """Mentions of the persons of a text, titled or not.

    ``named`` has (start, end, name, gender told by the title). A name of one word is a mention of the person
    of more words who has it as family or given name, unless the genders told differ; of several such persons
    the one named last before it, else the first. A word of two letters or more that begins a sentence and is
    also somebody's name is taken for the name.
    """
    genders: dict[str, str | None] = {}
    parts: dict[str, list[tuple[int, str, tuple[int, int] | None]]] = {}  # name in lower case -> (place, person, its words)
    forms: dict[str, set[str]] = {}  # first capitalised word -> names as they are written
    full = [x for x in named if " " in x[2]]
    gendered: dict[str, set] = {}  # genders of the persons who have a part of that name; final once full names are done
    for start, _, name, told in full + [x for x in named if " " not in x[2]]:
        value = name.casefold()
        pieces = [(name, None)]
        if " " in name:
            first, last = name[: name.index(" ")], name[name.rindex(" ") + 1 :]
            n = len(_words(name))
            pieces += [(last, (n - len(_words(last)), n))]
            if not _INITIAL.fullmatch(first) and first not in PARTICLES:
                pieces += [(first, (0, len(_words(first))))]
        else:
            if value not in gendered:
                gendered[value] = {genders[person] for _, person, words in parts.get(value, ()) if words}
            if any(_fits(gender, told) for gender in gendered[value]):
                continue
        given = _GENDER.get(_words(value)[0])
        genders[value] = genders.get(value) or told or given
        for piece, words in pieces:
            parts.setdefault(piece.casefold(), []).append((start, value, words))
            for form in (piece, piece.upper(), *[re.sub(r"\w+", lambda w: w[0] if w[0].casefold() in PARTICLES else w[0].capitalize(), piece)] * piece.isupper()):
                if m := _CAPITAL.search(form):
                    forms.setdefault(form[m.start() : m.end()], set()).add(form[m.start() :] if m.start() == 0 else form)
    order = {k: sorted(v, key=len, reverse=True) for k, v in forms.items()}
    out, taken = [], sorted((x.start, x.end) for x in others)
    titled = {_CAPITAL.search(text, start).start(): (start, end, told) for start, end, _, told in named}  # particles may come first

    said: dict[tuple, tuple] = {}

    def say(start: int, end: int, told: str | None) -> None:
        key = text[start:end].casefold(), told
        if key not in said:
            known = parts.get(key[0], [])
            fit = [x for x in known if x[2] is None or _fits(genders[x[1]], told)] or known
            both = [sorted((x for x in fit if (x[2] is None) == bare), key=lambda x: x[0]) for bare in (True, False)]
            said[key] = [(part, [x[0] for x in part]) for part in both if part]
        # Whole names first: the last one before the place, else the first one after it.
        for part, starts in said[key]:
            if n := bisect_right(starts, start):
                _, value, words = part[bisect_left(starts, starts[n - 1])]
                break
        else:
            _, value, words = said[key][0][0][0]
        out.append(Mention(start, end, "person", value, genders[value], words))

    at, k = 0, 0
    for m in _CAPITAL.finditer(text):
        start = m.start()
        if start < at:
            continue
        if start in titled:
            start, at, told = titled[start]
            say(start, at, told)
            continue
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        if k < len(taken) and taken[k][0] <= start:
            continue
        for form in order.get(m[0], ()):
            end = start + len(form)
            if text.startswith(form, start) and not text[end : end + 1].isalnum():
                say(start, end, None)
                at = end
                break
    return out


def _fits(gender: str | None, told: str | None) -> bool:
    return gender is None or told is None or gender == told


class Stream:
    """A keyed stream of numbers for one entity and attempt."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self._seed, self._left, self._n = hmac.digest(key, f"{kind}\0{value}\0{attempt}".encode("utf-8", "surrogatepass"), "sha256"), b"", 0

    def below(self, n: int) -> int:
        while len(self._left) < 8:
            self._left += hashlib.sha256(self._seed + self._n.to_bytes(4, "big")).digest()
            self._n += 1
        x, self._left = int.from_bytes(self._left[:8], "big"), self._left[8:]
        return x % n


def _letters(like: str, draw: Stream) -> str:
    """A letter for each letter, of the same script and case; digits for digits; the rest stays."""
    out = []
    for ch in like:
        if ch.isdigit():
            out.append(str(draw.below(10)))
        elif not ch.isalpha():
            out.append(ch)
        else:
            script = unicodedata.name(ch, "LATIN").split()[0]
            low, n = {"CYRILLIC": ("а", 32), "GREEK": ("α", 17)}.get(script, ("a", 26))
            new = chr(ord(low) + draw.below(n))
            out.append(new.upper() if ch.isupper() else new)
    return "".join(out)


_SOUNDS = {"LATIN": ("bdfgklmnprstvz", "aeiou"), "CYRILLIC": ("бвгдзклмнпрст", "аеиоу"), "GREEK": ("βγδζκλμνπρστ", "αειου")}


def _syllables(draw: Stream, script: str, n: int, like: str) -> str:
    """n syllables of the script; of scripts without a list, of the letters beside ``like``."""
    if script not in _SOUNDS:
        beside = map(chr, range(max(0, ord(like) - 40), ord(like) + 41))
        letters = "".join(c for c in beside if c.isalpha() and c == c.casefold() and unicodedata.name(c, "").split(" ")[0] == script) or like
        return "".join(letters[draw.below(len(letters))] for _ in range(2 * n))
    onsets, vowels = _SOUNDS[script]
    return "".join(onsets[draw.below(len(onsets))] + vowels[draw.below(len(vowels))] for _ in range(n))


def _told(value: str, gender: str | None) -> str:
    """The value as :func:`surrogate_value` takes it, with the gender of a person in front."""
    return f"{gender}\t{value}" if gender else value


def surrogate_value(kind: str, value: str, key: bytes, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    draw = Stream(key, kind, value, attempt)
    if kind == "email":
        # Both sides keep their form, and addresses of one domain share its surrogate; short ones grow when they run out.
        local, _, domain = value.partition("@")
        labels, keyed = domain.split(".")[:-1], Stream(key, "domain", domain, 0)
        labels[0] = labels[0].ljust(6, "x")
        return _letters(local, draw) + _letters("a" * (attempt // 2), draw) + "@" + ".".join(_letters(label, keyed) for label in labels) + ".example"
    if kind == "iban":
        front, rest = value[:2], _letters(value[4:], draw)
        return front + f"{98 - _remainder(front + '00' + rest):02d}" + rest
    if kind == "ipv6":
        # In the network of local addresses; groups of zeros stay, the others keep their length.
        groups = value.split(":")
        new = [g if g == "0" else "%x" % (16 ** (len(g) - 1) + draw.below(15 * 16 ** (len(g) - 1))) for g in groups[1:]]
        return ":".join(["fd%02x" % draw.below(256), *new])
    if kind == "ipv4":
        # The private network; where that runs out, the reserved addresses, then all.
        front = ["10"] if attempt < 16 else [str(240 + draw.below(16))] if attempt < 32 else [str(draw.below(256))]
        return ".".join(front + [str(draw.below(256)) for _ in range(3)])
    if kind == "person":
        told, _, value = value.rpartition("\t")
        words = _words(value)
        names = [i for i, w in enumerate(words) if w not in PARTICLES]
        gender = told or _GENDER.get(words[names[0]])
        out = []
        for i, w in enumerate(words):
            script = unicodedata.name(w[0], "LATIN").split()[0]
            end, pool = ENDS.get((gender, script), [""]), GIVEN.get((gender, script))
            if w in PARTICLES:
                out.append(w)
            elif w.endswith("."):
                out.append(_letters(w, draw))
            elif i == names[0] and pool and (w in _GENDER or len(names) > 1):
                # A lone given name grows when it is drawn again, so names never run out.
                more = _syllables(draw, script, attempt + 2, w[0]) if attempt and len(names) == 1 else ""
                out.append(pool[draw.below(len(pool))].casefold() + more)
            elif i == names[0]:
                out.append(_syllables(draw, script, 3 + attempt, w[0]) + end[draw.below(len(end))])
            else:
                out.append(_syllables(draw, script, 5, w[0]) + (end[draw.below(len(end))] if script != "LATIN" else ""))
        return " ".join(out)
    if kind == "token":
        if len(value) == 20:  # an access key: its fixed beginning, then letters and the digits 2 to 7
            return value[:4] + "".join("abcdefghijklmnopqrstuvwxyz234567"[draw.below(32)] for _ in value[4:])
        return "".join("0123456789abcdef"[draw.below(16)] if c in "0123456789abcdef" else _letters(c, draw) for c in value)
    if kind == "phone":
        digits = value.removeprefix("+")
        code = 0 if digits == value else 1 if digits[0] in "17" else 2 if digits[:2] in _CODES else 3
        keep = len(value) - len(digits) + code if attempt < 16 else len(value) - len(digits)  # short numbers of one country may run out
        return value[:keep] + _letters("0" * (len(value) - keep), draw)
    digits = ("9" if kind == "ssn" else "0") + _letters(value, draw)[1:]  # no such numbers are given out
    if kind == "card" and not _check_sum(value):
        digits = next(d for d in (digits[:-1] + str(i) for i in range(10)) if not _check_sum(d))
    return digits


def _check_sum(digits: str) -> int:
    """0 for a card number that passes the usual check: every other digit from the right counts twice."""
    return sum(int(d) if i % 2 == 0 else sum(map(int, str(2 * int(d)))) for i, d in enumerate(reversed(digits))) % 10


def formed(kind: str, mention: str, new: str) -> str:
    """The canonical surrogate in the mention's form."""
    if kind in ("phone", "ssn", "card"):
        digits = iter(new.removeprefix("+"))
        trunk = "(0)" if new.startswith("+") else "^"
        return trunk.join("".join(next(digits) if ch.isdigit() else ch for ch in part) for part in mention.split(trunk))
    if kind == "iban":
        chars = iter(new.upper())
        return "".join(ch if ch == " " else next(chars) for ch in mention)
    if kind == "ipv6":
        groups, (front, _, back) = new.split(":"), mention.partition("::")
        front, back = front.split(":"), back.split(":") if back else []
        at = [*range(len(front)), *range(8 - len(back), 8)]
        told = [groups[i].zfill(len(w)) for i, w in zip(at, front + back)]
        out = ":".join(told[: len(front)]) + ("::" if "::" in mention else "") + ":".join(told[len(front) :])
        return out.upper() if mention.isupper() else out
    if kind == "person":
        said = _words(mention)
        words = [w if w in PARTICLES else w.upper().capitalize() for w in new.split(" ")]  # upper first, for final sigmas
        words = [w.upper() if len(old) > 1 and old.isupper() else w for w, old in zip(words, said)]
        seps = re.findall("[ -]", mention)
        return "".join(x for pair in zip(words, [*seps, ""]) for x in pair)
    return new.upper() if mention.isupper() else new


def rewrite(text: str | None, key: bytes, redrawn: Callable[[str, str], str | None]) -> tuple[str | None, list[dict]]:
    """The text with surrogates, and (kind, start, end, surrogate) of each in the new text."""
    out, at, size, spans, drawn = [], 0, 0, [], {}
    found = find(text)
    for m in found:
        if (m.kind, m.value) not in drawn:
            drawn[m.kind, m.value] = redrawn(m.kind, m.value) or surrogate_value(m.kind, _told(m.value, m.gender), key)
    # Two persons of a text may have drawn one given name: then that name alone would not tell them apart.
    alone = Counter(new.split(" ")[0] for (kind, _), new in drawn.items() if kind == "person")
    for m in found:
        new = drawn[m.kind, m.value]
        if m.words:
            part = " ".join(new.split(" ")[slice(*m.words)])
            new = formed(m.kind, text[m.start : m.end], part) if m.words[0] or alone[part] == 1 else " ".join(w.upper().capitalize() for w in new.split(" "))
        else:
            new = formed(m.kind, text[m.start : m.end], new)
        size += m.start - at
        out += [text[at : m.start], new]
        spans.append({"kind": m.kind, "start": size, "end": size + len(new), "surrogate": new})
        size, at = size + len(new), m.end
    return ("".join([*out, text[at:]]), spans) if spans else (text, [])


def _entities(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = {(m.kind, m.value, m.gender) for text in batch.column(0).to_pylist() for m in find(text)}
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in seen], pa.string()) for i in range(3)], names=["kind", "value", "gender"])


def _draw(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns[:3]))
            new = [surrogate_value(k, _told(v, g), key, attempt) for k, v, g in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(new, pa.string())], names=[*_DRAWN])

    return run


_DRAWN = {"kind": "string", "value": "string", "gender": "string", "mixed": "boolean", "new": "string"}


def redrawn_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, new) of the entities whose first surrogate was taken or whose mentions tell different genders.

    A surrogate is taken if an entity with a smaller value drew it too, if an entity settled on it
    before, or if it is itself the value of an entity.
    """
    schema = ", ".join(map(" ".join, _DRAWN.items()))
    said = docs.select("text").mapInArrow(_entities, "kind string, value string, gender string").distinct()
    said = said.groupBy("kind", "value").agg(F.min("gender").alias("gender"), (F.count("*") > 1).alias("mixed"))
    entities = checkpoint(said.mapInArrow(_draw(key, 0), schema))
    values = entities.select("kind", F.col("value").alias("new"))
    settled, open_, redrawn = None, entities, None
    for attempt in range(1, ATTEMPTS + 1):
        first = open_.groupBy("kind", "new").agg(F.min("value").alias("value"))
        free = first.join(values, ["kind", "new"], "left_anti")
        if settled is not None:
            free = free.join(settled.select("kind", "new"), ["kind", "new"], "left_anti")
        free = checkpoint(free.select("kind", "value", "new"))
        lost = checkpoint(open_.join(free, ["kind", "value"], "left_anti"))
        settled = free if settled is None else settled.unionByName(free)
        redrawn = free.join(entities.where("mixed").select("kind", "value"), ["kind", "value"], "left_semi") if attempt == 1 else redrawn.unionByName(free)
        if not lost.limit(1).count():
            return redrawn
        open_ = checkpoint(lost.select("kind", "value", "gender", "mixed").mapInArrow(_draw(key, attempt), schema))
    raise ValueError("too few surrogates of a kind for the entities of the corpus")


_SPANS = "array<struct<kind: string, start: int, end: int, surrogate: string>>"


def replace_pii(docs: DataFrame, key: bytes) -> DataFrame:
    """``docs`` with surrogates in ``text`` and, last, a column ``pii`` of what was put where.

    Other columns stay as they are; where one is named pii, the new column is ``pii_``. Null and empty texts stay; repeated
    rows get equal results; an empty table gives no rows. The same key gives the same surrogates for the same corpus.
    """
    spark = docs.sparkSession
    redrawn = checkpoint(redrawn_surrogates(docs, key))
    columns, kept = docs.columns, [c for c in docs.columns if c != "text"]
    spans_of, own_of, hash_of, said_of = unused(docs, "pii", "_redrawn", "_hash", "_said")
    if redrawn.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        held = spark.sparkContext.broadcast({(r["kind"], r["value"]): r["new"] for r in redrawn.collect()})
        rows = docs.withColumn(own_of, F.lit(None).cast("map<string,string>"))
    else:
        held = None
        mentions = docs.select("text").distinct().mapInArrow(_mentions, "text string, kind string, value string")
        maps = mentions.join(redrawn, ["kind", "value"]).groupBy(F.xxhash64("text").alias(hash_of), F.col("text").alias(said_of)).agg(
            F.map_from_entries(F.collect_set(F.struct(F.concat_ws("\0", "kind", "value"), "new"))).alias(own_of)
        )
        rows = docs.join(maps, (F.xxhash64("text") == F.col(hash_of)) & (F.col("text") == F.col(said_of)), "left")
    rows = rows.select(*kept, "text", own_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, spans = [], []
            for text, own in zip(batch.column(len(kept)).to_pylist(), batch.column(len(kept) + 1).to_pylist()):
                own = dict(own or ())
                look = (lambda k, v: held.value.get((k, v))) if held else (lambda k, v: own.get(f"{k}\0{v}"))
                new, found = rewrite(text, key, look)
                texts.append(new)
                spans.append(found)
            kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("surrogate", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(texts, pa.string()), pa.array(spans, kind)], names=[*kept, "text", spans_of])

    schema = StructType([*(docs.schema[c] for c in kept), StructField("text", StringType()), StructField(spans_of, _parse_datatype_string(_SPANS))])
    return rows.mapInArrow(run, schema).select(*columns, spans_of)


def _mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(text, k, v) for text in batch.column(0).to_pylist() for k, v in sorted({(m.kind, m.value) for m in find(text)})]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in (zip(*rows) if rows else [()] * 3)], names=["text", "kind", "value"])
