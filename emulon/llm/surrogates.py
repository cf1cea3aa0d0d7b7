"""Personal data and secrets replaced by surrogates: keyed, of the same type and form, distinct, and the same everywhere.

Found are e-mail and IP addresses (both versions), phone, payment-card, social-security and IBAN numbers, secrets (a value after a
word such as token or password, keys of known prefixes, and long hexadecimal strings), and names: after one or more titles, after
words that introduce them ("my name is"), two capitalised words before a verb said of persons ("called", "was born"), and further
mentions of a whole name in the same text.  Other names without a title are not found.  A quoted value after such a word
that has no letter or digit (asterisks, dots) is a mask, not a secret, and stays.  A surrogate keeps the form: letters
become letters, digits digits, capitals capitals, separators stay, card and IBAN check digits are right where they were, an address
keeps its top-level domain and a phone number its country code.  Names keep script, capitals and, by title, gender;
given name and surname are replaced for themselves, so "Mr. A. Smith" and "Mr. Smith" go on sharing a surname, and a given name
has one surrogate whatever its titles: of the gender that they tell in all documents, neutral if they tell none or both.

The surrogate is a keyed permutation of the values of the same form, so one entity gets one surrogate in all documents
and different entities get different ones.  Secrets with letters or digits beyond a-z and 0-9 get drawn ones of these instead.
Invented names have so many syllables that there are at least
32 times as many as entities of the type.  Names, drawn values, and forms with few values, may meet; and a surrogate may be another's true
value.  So the entities of all documents are gathered, each once; an entity whose surrogate is a true value, or that
of a smaller entity, takes its next one, until none is left.  From the eighth on, e-mails, phone numbers, secrets and names grow
longer every eight, so no form is too small; the others have at least a thousand million values, of which the true ones
must be less than half.  The few that did so meet their documents in a join.

Nulls and oddities: a null text stays null; a text without entities is unchanged; repeated rows and null keys are treated like any; an empty
table gives an empty result; other columns are kept.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from emulon.llm.common import column, spare
from emulon.runtime import cut_lineage

#: Titles before names, by gender.
TITLES = {
    "m": "Mr Herr Monsieur Señor Mister господин κύριος".split(),
    "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Señorita госпожа κυρία".split(),
    "n": "Mx Dr Prof Professor доктор профессор".split(),
}
#: Syllables of invented names, and endings by gender.
SCRIPTS = {
    "latin": ("ba be di do fe ga ha je ka la le ma mi na no pa re ri sa se ta te to va vi wa ya zo".split(),
              {"m": "ron den las mir tor".split(), "f": "ra na lia sa mina".split(), "n": "ley rin lan sel den".split()}),
    "cyrillic": ("ба ве га да жи за ка ла ма ни по ра са та фе ха".split(),
                 {"m": "ров лан мир дон тин".split(), "f": "ра на лия са мина".split(), "n": "лен рин сель дан тей".split()}),
    "greek": ("βα γε δη ζα θε κα λα μα νι πα ρο σα τε φι χα".split(),
              {"m": "ρος νης λας μων τωρ".split(), "f": "ρα να λια σα μινη".split(), "n": "λεν ριν σελ δαν τει".split()}),
}
EMAIL = re.compile(r"[A-Za-z0-9][A-Za-z0-9._%+-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}")
SECRET = re.compile(r"""(?i)\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)["']?\s*[:=]\s*["']([^"'\s]{6,})["']""")
BARE_SECRET = re.compile(r"(?i)\b(?:api[_-]?key|access[_-]?key|auth[_-]?token|token|secret|password|passwd|pwd)\s*[:=]\s*(?=[^\s\"']*\d)(?=[^\s\"']*[a-z])([\w+/=.-]{8,})")
#: How some issuers begin their keys.
ISSUERS = ("AKIA", "ASIA", "sk-", "sk_", "pk_", "rk_", "ghp_", "gho_", "ghs_", "xoxb-", "xoxp-")
ISSUED = re.compile(rf"(?<!\w)(?:{'|'.join(ISSUERS)})[A-Za-z0-9_-]{{16,}}(?!\w)")
HEX = re.compile(r"(?<![0-9A-Za-z])(?=[0-9A-Fa-f]*[A-Fa-f])(?=[0-9A-Fa-f]*\d)[0-9A-Fa-f]{32,}(?![0-9A-Za-z])")
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])")
PHONE = re.compile(r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w.+-])(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?![\d-])")
SSN = re.compile(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])")
IP = re.compile(r"(?<![\w.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?![\w]|\.\d)")
CARD = re.compile(r"(?<![\w-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])")
IP6 = re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,6}[0-9A-Fa-f]{0,4}(?![\w:])")
#: Small words inside surnames, words before a name, and verbs after one.
PARTICLES = "da de del della der den di dos du la le van von bin ibn al y".split()
INTRODUCED = ("my name is", "mein name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es", "il mio nome è", "меня зовут")
DEEDS = ("called", "phoned", "emailed", "texted", "was born", "lives in", "lived in", "resides", "got married")
NO_NAMES = "A An And At But For From He Her His If In It My New No Of On Our Saint San She South North The Their They This That To United We West East When You".split()
_WORD = r"[^\W\d_a-zà-öø-ÿа-яё][^\W\d_]*(?:['’-][^\W\d_]+)*"
_CAPITAL = r"[A-ZÀ-ÖØ-ÞΑ-ΩА-ЯЁ][^\W\d_]*(?:['’-][^\W\d_]+)*"
_INITIAL = r"[^\W\d_a-zа-я]\. "
_INITIALS = rf"(?:{_INITIAL})*"
_MORE = rf"(?: {_INITIALS}(?:(?:{'|'.join(PARTICLES)}) ){{0,2}}{_CAPITAL}){{0,4}}"
_FULL = rf"{_INITIALS}(?:{_WORD} (?!{_INITIAL}){_WORD}{_MORE}|{_WORD}{_MORE})"
_TITLE = "|".join(t for ts in TITLES.values() for t in ts)
NAME = re.compile(rf"\b((?:(?:{_TITLE})\.? )+)({_FULL})")
SMALL_TITLE = re.compile(rf"\b((?:(?:mrs?|ms|dr|prof)\. )+)({_CAPITAL}{_MORE})|\b(mrs?|ms)\. ([a-z]+(?:['’-][a-z]+)*)")
INTRODUCTION = re.compile(rf"\b(?i:{'|'.join(INTRODUCED)}):? ({_CAPITAL}{_MORE})")
DEED = re.compile(rf"(?<![\w.'’-])(?<!\bthe )(?<!\bThe )(?!(?:{'|'.join(NO_NAMES)}) )([A-Z][a-z]+(?: [A-Z]\.)? [A-Z][a-z]+)(?= (?:{'|'.join(DEEDS)})\b)")
GENDER = {t: g for g, ts in TITLES.items() for t in ts}
SMALL_GENDER = {t.lower(): g for t, g in GENDER.items()}
Entity = tuple[str, str]  # type, canonical form


_LETTERS: dict[str, str] = {}


def letters_of(script: str) -> str:
    """The plain small or caseless letters whose Unicode names begin with the script; unified ideographs are those of the first block."""
    if script not in _LETTERS:
        start = {"cjk": "CJK UNIFIED IDEOGRAPH-", "hangul": "HANGUL SYLLABLE "}.get(script, f"{script.upper()} ")
        plain = (c for c in map(chr, range(0x4E00, 0xA000) if script == "cjk" else range(0x370, 0x20000)) if unicodedata.name(c, "").startswith(start))
        found = [c for c in plain if unicodedata.category(c) in ("Ll", "Lo") and unicodedata.normalize("NFKC", c) == c]
        _LETTERS[script] = "".join(c for c in found if c.lower() == c and "LIGATURE" not in unicodedata.name(c))
    return _LETTERS[script]


def script_of(word: str) -> str:
    """The script of the first letter that is not Latin; one of too few letters counts as Latin."""
    if re.search("[а-яё]", word, re.I):
        return "cyrillic"
    for c in word if not word.isascii() else "":
        script = unicodedata.name(c, "latin").split(" ")[0].lower()
        if c.isalpha() and script != "latin" and (script in SCRIPTS or len(letters_of(script)) >= 16):
            return script
    return "latin"


def find(text: str) -> list[tuple[int, int, Entity]]:
    """Spans of the whole text and what they hold, in order, without overlaps; earlier types go first."""
    found: list[tuple[int, int, Entity]] = []
    taken: list[tuple[int, int]] = []

    def add(start: int, end: int, kind: str, canonical: str) -> None:
        if all(end <= a or b <= start for a, b in taken):
            taken.append((start, end))
            found.append((start, end, (kind, canonical)))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(), "email", m[0].lower())
    if '"' in text or "'" in text:
        for m in SECRET.finditer(text):
            if any(map(_is_letter_or_digit, m[1])):  # else a mask
                add(*m.span(1), "secret", m[1].lower())
    if "=" in text or ":" in text:
        for m in BARE_SECRET.finditer(text):
            add(*m.span(1), "secret", m[1].lower())
    if any(p in text for p in ISSUERS):
        for m in ISSUED.finditer(text):
            add(*m.span(), "secret", m[0].lower())
    if _DIGIT.search(text):
        for m in HEX.finditer(text):
            add(*m.span(), "secret", m[0].lower())
        for m in IBAN.finditer(text):
            plain = m[0].replace(" ", "")
            if 15 <= len(plain) <= 34 and _mod97(plain) == 1:
                add(*m.span(), "iban", plain)
        for m in IP.finditer(text):
            add(*m.span(), "ip", ".".join(str(int(p)) for p in m[0].split(".")))
        for m in PHONE.finditer(text):
            plain = re.sub(r"\D", "", m[0])
            if 7 <= len(plain) <= 15:
                code = re.match(r"\+(\d{1,3})(?=\D)", m[0])
                add(*m.span(), "phone", f"{code[1] if code else ''}+{plain[len(code[1]) if code else 0:]}")
        for m in SSN.finditer(text):
            add(*m.span(), "ssn", re.sub(r"\D", "", m[0]))
        for m in CARD.finditer(text):
            add(*m.span(), "card", re.sub(r"\D", "", m[0]))
    if text.count(":") > 1:
        for m in IP6.finditer(text):
            if (plain := _address(m[0])) is not None:
                add(*m.span(), "ip6", plain)
    wholes: dict[str, str] = {}  # names of several words, and the gender their titles tell

    def add_name(start: int, name: str, gender: str) -> None:
        words = [w for w in re.finditer(r"\S+", name) if not w[0].endswith(".") and w[0] not in PARTICLES]
        for i, w in enumerate(words):
            kind = "surname" if i == len(words) - 1 else f"given-{gender}"
            add(start + w.start(), start + w.end(), f"{kind}-{script_of(w[0])}", w[0].lower())
        if len(words) > 1 and wholes.get(name, "n") == "n":
            wholes[name] = gender

    def told(titles: str) -> str:
        return next((g for t in titles.split() if (g := SMALL_GENDER[t.rstrip(".").lower()]) != "n"), "n")

    if any(t in text for t in GENDER):
        for m in NAME.finditer(text):
            add_name(m.start(2), m[2], told(m[1]))
    if any(t in text for t in ("mr. ", "mrs. ", "ms. ", "dr. ", "prof. ")):
        for m in SMALL_TITLE.finditer(text):
            at = 2 if m[2] else 4
            add_name(m.start(at), m[at], told(m[at - 1]))
    if any(t in text for t in ("ame is", "ame ist", "heiße", "appelle", "llamo", "ombre es", "ome è", "зовут")):
        for m in INTRODUCTION.finditer(text):
            add_name(m.start(1), m[1], "n")
    if any(t in text for t in DEEDS):
        for m in DEED.finditer(text):
            add_name(m.start(1), m[1], "n")
    if wholes:
        again = "|".join(map(re.escape, sorted(wholes, key=len, reverse=True)))
        for m in re.finditer(rf"(?<![\w'’-])(?:{again})(?![\w’-])", text):
            add_name(m.start(), m[0], wholes[m[0]])
    return sorted(found)


_DIGIT = re.compile(r"\d[^a-z]{0,4}\d")


def _address(text: str) -> str | None:
    """The eight groups of an address of version 6; None for other texts, and for those of fewer than three groups."""
    groups = [g for g in text.split(":") if g]
    if len(groups) < 3 or not any(c.isdigit() for c in text) or not any(int(g, 16) for g in groups):
        return None
    try:
        return ipaddress.IPv6Address(text).exploded
    except ValueError:
        return None


def _is_letter_or_digit(c: str) -> bool:
    return unicodedata.category(c)[0] in "LN"


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _luhn(digits: str) -> int:
    """The last digit that makes ``digits`` followed by it valid."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _permute(key: bytes, label: str, value: int, size: int) -> int:
    """A keyed permutation of 0 to size - 1: a Feistel network over the next even number of bits, walked until inside."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for turn in range(6):
            h = hashlib.blake2b(f"{label}|{turn}|{right}".encode(), key=key, digest_size=16 + half // 8).digest()
            left, right = right, left ^ (int.from_bytes(h, "big") & mask)
        value = left << half | right
        if value < size:
            return value


def _scramble(key: bytes, label: str, text: str, hexadecimal: bool = False) -> str:
    """Permutes among the texts of the same form: lower-case letters and digits, anything else stays."""
    alphabets = []
    for c in text:
        if hexadecimal and c in "0123456789abcdef":
            alphabets.append("0123456789abcdef")
        elif "a" <= c <= "z":
            alphabets.append("abcdefghijklmnopqrstuvwxyz")
        else:
            alphabets.append("0123456789" if "0" <= c <= "9" else c)
    value, size = 0, 1
    for c, a in zip(text, alphabets):
        value, size = value * len(a) + a.index(c), size * len(a)
    form = "".join(a[0] if len(a) > 1 else c for c, a in zip(text, alphabets))
    value = _permute(key, f"{label}|{form}", value, size)
    out = []
    for a in reversed(alphabets):
        value, i = divmod(value, len(a))
        out.append(a[i])
    return "".join(reversed(out))


def _draw(key: bytes, label: str, text: str, more: int) -> str:
    """Letters for letters and marks, digits for digits, by a hash of the whole text, and ``more`` letters; anything else stays."""
    seed = hashlib.blake2b(f"{label}|{text}".encode(), key=key).digest()
    raw = hashlib.shake_256(seed).digest(2 * (len(text) + more))
    out = []
    for i, c in enumerate(text + "x" * more):
        n, sort = int.from_bytes(raw[2 * i : 2 * i + 2], "big"), unicodedata.category(c)[0]
        out.append("0123456789"[n % 10] if sort == "N" else "abcdefghijklmnopqrstuvwxyz"[n % 26] if sort in "LM" else c)
    return "".join(out)


def surrogate(key: bytes, entity: Entity, attempt: int = 0, longer: int = 0) -> str:
    """The canonical form of the entity's surrogate; attempts after the first give others, ``longer`` is a name's number of
    syllables beyond two."""
    kind, value = entity
    label = f"{kind}|{attempt}"
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        host, top = domain.rsplit(".", 1)
        if attempt >= 8:  # a form of few values: longer names
            local += "x" * (attempt // 8)
        return f"{_scramble(key, label, f'{local}@{host}')}.{top}"
    if kind == "ip":
        a, b, c, d = map(int, value.split("."))
        new = _permute(key, label, a << 24 | b << 16 | c << 8 | d, 1 << 32)
        return ".".join(str(new >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ip6":  # groups of nought stay
        plain = ":".join("----" if g == "0000" else g for g in value.split(":"))
        return _scramble(key, label, plain, True).replace("-", "0")
    if kind == "phone":
        code, rest = value.split("+")
        if attempt >= 8:
            rest += "0" * (attempt // 8)
        return f"{code}+{_scramble(key, f'{label}|{code}', rest)}"
    if kind == "card" and _luhn(value[:-1]) == int(value[-1]):
        new = _scramble(key, f"{label}|valid", value[:-1])
        return new + str(_luhn(new))
    if kind == "iban":
        new = _scramble(key, f"{label}|{value[:2]}", value[4:].lower()).upper()
        return f"{value[:2]}{98 - _mod97(value[:2] + '00' + new):02d}{new}"
    if kind.startswith(("given", "surname")):
        gender, script = kind.split("-", 2)[1:] if kind.startswith("given") else ("n", kind.split("-", 1)[1])
        syllables, endings = SCRIPTS.get(script) or (letters_of(script), dict.fromkeys("mfn", letters_of(script)))
        ends = endings[gender]
        h = int.from_bytes(hashlib.blake2b(f"{label}|{value}".encode(), key=key, digest_size=16).digest(), "big")
        name = ""
        for _ in range(2 + longer + attempt // 8):
            h, i = divmod(h, len(syllables))
            name += syllables[i]
        return name + ends[h % len(ends)]
    if kind == "secret" and (attempt >= 8 or any(not c.isascii() and unicodedata.category(c)[0] in "LMN" for c in value)):
        return _draw(key, label, value, attempt // 8)
    return _scramble(key, label, value, kind == "secret" and all(c in "0123456789abcdef" for c in value))


def _dress(new: str, kind: str, old: str) -> str:
    """The surrogate in the form of the text it replaces: separators and capitals."""
    if kind == "ip":
        return new
    if kind == "ip6":
        new = new if len(old) == len(new) else str(ipaddress.IPv6Address(new))
        return new.upper() if old.isupper() else new
    if kind in ("phone", "card", "ssn", "iban"):
        plain = iter(new.replace("+", ""))
        return "".join(next(plain) if c.isalnum() else c for c in old) + "".join(plain)
    if old.isupper() and len(old) > 1:
        return new.upper()
    if kind.startswith(("given", "surname")):
        return new.capitalize()
    if len(new) == len(old):
        return "".join(n.upper() if o.isupper() else n for n, o in zip(new, old))
    return new


def replace(text: str, key: bytes, fixes: dict[Entity, tuple[str, int]], known: dict[tuple[str, str, int], str],
            longer: dict[str, int] | None = None) -> str:
    """``fixes`` holds the settled type and the attempt of entities that do not keep their first surrogate; ``longer`` is of ``syllables``."""
    out, at = [], 0
    for start, end, entity in find(text):
        kind, attempt = fixes.get(entity, (entity[0], 0))
        if (new := known.get((kind, entity[1], attempt))) is None:
            new = known[kind, entity[1], attempt] = surrogate(key, (kind, entity[1]), attempt, (longer or {}).get(_split_kind(kind)[0], 0))
        out += [text[at:start], _dress(new, entity[0], text[start:end])]
        at = end
    return "".join(out) + text[at:] if out else text


def _split_kind(kind: str) -> tuple[str, str | None]:
    """The type without the title's gender, and that gender."""
    if not kind.startswith("given-"):
        return kind, None
    _, gender, script = kind.split("-", 2)
    return f"given-{script}", gender


def _titled(kind: str, gender: str | None) -> str:
    return kind if gender is None else f"given-{gender}{kind[len('given'):]}"


def entities(docs: DataFrame, text: str = "text") -> DataFrame:
    """``kind, value, gender, said`` of every entity of the whole texts, once (written).

    Given names have one row whatever their titles: ``said`` holds the genders of these, ``gender`` the one they come to.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = {e for t in column(batch, "text").to_pylist() if t for _, _, e in find(t)}
            rows = [(*_split_kind(kind), value) for kind, value in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)], names=["kind", "gender", "value"])

    said = F.concat_ws("", *[F.max(F.when(F.col("gender") == g, g)) for g in "mfn"])
    once = docs.select(F.col(f"`{text}`").alias("text")).mapInArrow(run, "kind string, gender string, value string").groupBy("kind", "value").agg(
        said.alias("said"))
    told = F.regexp_replace("said", "n", "")
    gender = F.when(F.col("said") == "", None).when(F.length(told) == 1, told).otherwise("n")
    return cut_lineage(once.select("kind", "value", gender.alias("gender"), "said"))


def syllables(found: DataFrame) -> dict[str, int]:
    """For each type of names, of which there are two a script, by how many syllables they must be longer."""
    out = {}
    for r in found.where("kind like 'given-%' or kind like 'surname-%'").groupBy("kind").count().collect():
        letters, endings = SCRIPTS.get(r["kind"].split("-")[1]) or (letters_of(r["kind"].split("-")[1]), {"n": "-"})
        size, more = len(letters) ** 2 * len(endings["n"]), 0
        while size < 32 * r["count"]:
            size, more = size * len(letters), more + 1
        if more:
            out[r["kind"]] = more
    return out


def exceptions(found: DataFrame, key: bytes, longer: dict[str, int]) -> DataFrame:
    """``kind, value, settled, attempt`` of the entities, as ``find`` gives them, that cannot keep their first surrogate (written).

    In each round a surrogate belongs to the smallest entity that has it, unless it is a true value; the others try again.
    Given names whose titles tell different genders take the settled type of all.
    """

    @F.pandas_udf("string")
    def propose(kind: pd.Series, gender: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([surrogate(key, (_titled(k, g), v), a, longer.get(k, 0)) for k, g, v, a in zip(kind, gender, value, attempt)], dtype=object)

    names = ["kind", "value", "gender", "said"]
    new = propose("kind", "gender", "value", "attempt")
    all_values = found.select("kind", F.col("value").alias("new")).withColumn("true", F.lit(True))
    assigned = cut_lineage(found.select(*names).withColumn("attempt", F.lit(0)).withColumn("new", new))
    while True:
        owner = assigned.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("owner"), F.count("*").alias("n"))
        checked = assigned.join(owner, ["kind", "new"]).join(all_values, ["kind", "new"], "left")
        bad = F.col("true").isNotNull() | ((F.col("n") > 1) & (F.col("owner.value") != F.col("value")))
        checked = checked.select(*names, "attempt", "new", bad.alias("bad"))
        if not checked.where("bad").limit(1).count():
            break
        again = checked.where("bad").select(*names, (F.col("attempt") + 1).alias("attempt"))
        assigned = cut_lineage(checked.where("not bad").drop("bad").unionByName(again.withColumn("new", new)))
    as_found = F.expr("explode(if(gender is null, array(kind), transform(filter(split(said, ''), g -> g <> ''), g -> concat('given-', g, substr(kind, 6)))))")
    settled = F.expr("if(gender is null, kind, concat('given-', gender, substr(kind, 6)))")
    each = assigned.where("attempt > 0 or length(said) > 1").select(as_found.alias("found"), "value", settled.alias("settled"), "attempt")
    return cut_lineage(each.where("attempt > 0 or found <> settled").withColumnRenamed("found", "kind"))


def replace_entities(docs: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """All rows and columns, ``text`` with surrogates; ``count`` names a column for the number of entities."""
    found = entities(docs, text)
    longer = syllables(found)
    others = exceptions(found, key, longer)
    body = F.col(f"`{text}`")

    def mentions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(h, *e) for h, t in zip(column(batch, "hash").to_pylist(), column(batch, "text").to_pylist()) if t
                    for e in {e for _, _, e in find(t)}]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[], [], []], (pa.int64(), pa.string(), pa.string()))],
                                             names=["hash", "kind", "value"])

    hashed, mended, done_as = (spare(docs, c) for c in ("__hash", "__fixes", "__done"))
    named = docs.withColumn(hashed, F.xxhash64(body))
    if others.limit(1).count():  # else no document needs to know of any
        where = docs.select(F.xxhash64(body).alias("hash"), body.alias("text")).mapInArrow(mentions, "hash long, kind string, value string")
        fixes = cut_lineage(where.join(others, ["kind", "value"]).groupBy("hash").agg(
            F.collect_set(F.struct("kind", "value", "settled", "attempt")).alias("fixes")))
        named = named.join(fixes.select(F.col("hash").alias(hashed), F.col("fixes").alias(mended)), hashed, "left")
    else:
        named = named.withColumn(mended, F.expr("cast(null as array<struct<kind:string,value:string,settled:string,attempt:int>>)"))

    @F.pandas_udf("text string, n int")
    def clean(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for texts, fixes in batches:
            rows = []
            for t, f in zip(texts, fixes):
                others = {(e["kind"], e["value"]): (e["settled"], e["attempt"]) for e in f} if f is not None else {}
                rows.append((None, 0) if t is None else (replace(t, key, others, known, longer), len(find(t)) if count else 0))
            if len(known) > 200_000:
                known = {}
            yield pd.DataFrame(rows, columns=["text", "n"])

    clean = clean.asNondeterministic()  # never evaluated twice
    done = named.withColumn(done_as, clean(body, F.col(mended)))
    kept = [F.col(f"{done_as}.text").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    return done.select(*kept, *([F.col(f"{done_as}.n").alias(count)] if count else []))
