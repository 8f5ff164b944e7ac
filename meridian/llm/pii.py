"""PII surrogates: every detected entity gets a keyed replacement of its own type, form, script and gender.

Mail addresses, telephone numbers, IPv4 and IPv6 addresses, social security numbers, card numbers (Luhn), IBANs and names
after a title are detected. Digits of a kind are moved by a keyed Feistel permutation of all digit strings of that length, so
distinct numbers stay distinct; words become pronounceable words of the same length and script from a keyed digest.

A name has any number of words, particles (de, van, ...) between them, and is replaced word by word: a word has one surrogate in the
whole corpus, so a person keeps one name under every title and in every document. Inside a document, later and earlier mentions
of the words of its titled names without a title are replaced too. Endings that tell a given name's gender (a, o) are kept.

A distributed check of all distinct entities finds surrogates that collide with each other or with a real entity; those are drawn
anew with a higher counter until none collides. Up to `most_exceptions` of these exceptions are broadcast; more are joined to the
texts that hold them. Equal entities get equal surrogates everywhere (coreference). The key is the caller's: who has it can undo
the permutations.

Defined results: null text stays null; empty text stays empty; text without entities stays as it is; texts of any length are read
whole; repeated rows are replaced alike; an empty table gives an empty result; all other columns are kept as they are, and the counts
take underscores where a column has their name. Initials (J.) are replaced but may coincide, since there are too few letters.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import json
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import durable, small

KINDS = ("email", "iban", "ipv6", "ip", "card", "ssn", "phone", "person")
# Titles.
TITLES = ("Mr", "Mrs", "Ms", "Miss", "Sir", "Lady", "Herr", "Frau", "Monsieur", "Madame", "Mme", "Señor", "Señora", "Sr", "Sra", "Dr", "Prof")
_PATTERN = re.compile(
    r"(?P<email>(?<![\w.+-])[\w.+-]+@[\w-]+(?:\.[\w-]+)+)"
    r"|(?P<iban>(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?!\w))"
    r"|(?P<ipv6>(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?=[A-Fa-f:]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?)(?![\w:]))"
    r"|(?P<ip>(?<![\w.])(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?:\.(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)){3}(?![\w]|\.\d))"
    r"|(?P<card>(?<![\w-])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?![\w-]))"
    r"|(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))"
    r"|(?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)|\d{2,4})[ .-]?\d{3,4}[ .-]\d{3,4}(?![\w-])|(?<!\w)\+\d{8,15}(?!\w)"
    r"|(?<![\w+])\+(?=(?:[ .()-]{0,2}\d){8,15}(?![\w]))\d{1,12}(?:[ .-]?\(\d{1,5}\)|[ .-]\d{1,12}){1,7}(?![\w-])|(?<![\w+.-])0\d(?:[ .-]\d{2}){4}(?![\w-]))"
    r"|(?<!\w)(?P<person>" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\.?(?=[ \u00a0][^\W\d_])"
)
_NAME = re.compile(r"[ \u00a0]([^\W\d_]+(?:[-'’][^\W\d_]+)*)(\.)?")
_NAME_WORD = re.compile(r"[^\W\d_]+(?:[-'’][^\W\d_]+)*")
# Particles inside names.
PARTICLES = frozenset("de del della di da das dos do la le las los van von der den het ter ten zu zur y e i bin ibn al el".split())
# Country codes of two digits; 1 and 7 are codes of one digit, all others have three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_QUICK = re.compile(r"[@\d]|\b(?:" + "|".join(TITLES) + r")\b")
_LATIN = ("bcdfghklmnprstvz", "aeiou")


def _luhn(digits: str) -> bool:
    total = sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits)))
    return total % 10 == 0


def _prf(key: bytes, *parts) -> int:
    return int.from_bytes(hmac.new(key, "\x1f".join(map(str, parts)).encode("utf-8", "surrogatepass"), hashlib.sha256).digest(), "big")


def permute(digits: str, key: bytes, tweak: str) -> str:
    """A keyed permutation of the digit strings of this length (unbalanced Feistel network, ten rounds)."""
    n = len(digits)
    if n < 2:
        return str((int(digits or 0) + _prf(key, tweak, n)) % 10) if digits else ""
    a, b = digits[: n // 2], digits[n // 2 :]
    for r in range(10):
        a, b = b, str((int(a) + _prf(key, tweak, n, r, b)) % 10 ** len(a)).zfill(len(a))
    return a + b


def _like(word: str, key: bytes, tweak: str) -> str:
    """A word of the same length, case and script for each letter; digits stay digits."""
    seed = _prf(key, tweak, word)
    out = []
    for i, c in enumerate(word):
        seed, low = divmod(seed, 1009) if seed > 1 << 20 else (_prf(key, tweak, word, i), i)
        if c.isdigit():
            out.append(str(low % 10))
        elif c.isalpha():
            script = unicodedata.name(c, "").split(" ")[0].split("-")[0]
            if script == "LATIN":
                kind = _LATIN[i % 2]
                new = kind[low % len(kind)]
            else:
                lower = c.lower()
                start = {"GREEK": 0x3B1, "CYRILLIC": 0x430, "HEBREW": 0x5D0, "ARABIC": 0x628, "HIRAGANA": 0x3042, "KATAKANA": 0x30A2, "HANGUL": 0xAC00, "CJK": 0x4E00, "DEVANAGARI": 0x915}.get(script)
                new = chr(start + low % (16 if start < 0x4E00 else 256)) if start else lower
            out.append(new.upper() if c.isupper() else new)
        else:
            out.append(c)
    return "".join(out)


def _refill(form: str, digits: str) -> str:
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in form)


def canonical(kind: str, value: str) -> str:
    """What entities must share to be one: mail, names and hex without case, numbers by their digits."""
    if kind in ("email", "person", "initial"):
        return value.lower()
    if kind == "ipv6":
        return str(ipaddress.IPv6Address(value))
    if kind in ("phone", "card", "ssn"):
        return ("+" if value.startswith("+") else "") + re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    return value


def country_code(number: str) -> str:
    """The digits of a canonical telephone number's country code; it is kept, so it must not depend on how the number is written."""
    if not number.startswith("+"):
        return ""
    return number[1:2] if number[1:2] in ("1", "7") else number[1:3] if number[1:3] in _TWO else number[1:4]


def surrogate(kind: str, value: str, key: bytes, turn: int = 0) -> str:
    """The replacement of `value`; a higher `turn` draws another."""
    tweak = f"{kind}{turn or ''}"
    if kind in ("phone", "card", "ssn"):
        known = re.sub(r"\D", "", value)
        fixed = len(country_code(canonical(kind, value))) if kind == "phone" else 0
        if kind == "card":
            for bump in range(50):
                body = permute(known[:-1], key, f"{tweak}/{bump}")
                if body != known[:-1]:
                    break
            new = next(body + str(d) for d in range(10) if _luhn(body + str(d)))
        else:
            new = known[:fixed] + permute(known[fixed:], key, tweak)
            if new == known:
                new = known[:fixed] + permute(known[fixed:], key, tweak + "'")
        return _refill(value, new)
    if kind == "ip":
        number = 0
        for p in value.split("."):
            number = number * 256 + int(p)
        left, right = number >> 16, number & 0xFFFF
        for r in range(8):
            left, right = right, left ^ (_prf(key, tweak, r, right) & 0xFFFF)
        return ".".join(str(b) for b in (left >> 8, left & 255, right >> 8, right & 255))
    if kind == "ipv6":
        bits = _prf(key, tweak, canonical(kind, value))
        return ":".join(f"{bits >> 16 * i & 0xFFFF:x}" for i in range(8))
    if kind == "iban":
        plain = value.replace(" ", "")
        body = plain[:2] + "00" + "".join(_like(c, key, f"{tweak}/{i}/{plain}").upper() for i, c in enumerate(plain[4:]))
        number = int("".join(str(int(c, 36)) for c in body[4:] + body[:4]))
        body = body[:2] + f"{98 - number % 97:02d}" + body[4:]
        rest = iter(body)
        return "".join(c if c == " " else next(rest) for c in value)
    if kind == "email":
        local, _, domain = value.lower().partition("@")
        host = domain.split(".")
        tag = _prf(key, tweak, value.lower())
        name = "".join(c if not c.isalnum() else d for c, d in zip(local, _like(re.sub(r"\W", "a", local), key, tweak + domain)))
        extra, code = "", tag % 36**8
        for _ in range(8):
            code, low = divmod(code, 36)
            extra += "0123456789abcdefghijklmnopqrstuvwxyz"[low]
        return f"{name}{extra}@{'.'.join(_like(h, key, tweak) for h in host[:-1])}.{host[-1]}"
    low = canonical(kind, value)
    new = _like(low, key, tweak)
    if turn > 3:  # short forms run out; later draws are longer
        new += _like("en" * (turn - 3), key, tweak + low)
    elif low[-1] in "ao" and len(low) > 2:
        new = new[:-1] + low[-1]
    shout = value.isupper() and len(value) > 1
    return "".join(c.upper() if shout or i < len(value) and value[i].isupper() else c for i, c in enumerate(new))


def _is_ipv6(value: str) -> bool:
    try:
        return bool(ipaddress.IPv6Address(value))
    except ValueError:
        return False


def _name(text: str, at: int) -> list[tuple[int, int]]:
    """Spans of the words of the name that begins at `at` (before its blank): capital words, particles between them left out; of scripts without case two words at most."""
    out, held = [], at
    while m := _NAME.match(text, held):
        word = m[1]
        held = m.end(1)
        if word in PARTICLES and out:
            continue
        cased = word[0].lower() != word[0].upper()
        if cased and word[0].islower() or not cased and len(out) == 2:
            break
        out.append((m.start(1), m.end(1)))
        if m[2] and len(word) == 1:  # an initial
            held = m.end()
        elif m[2]:
            break
    return out


def detect(text) -> list[tuple[int, int, str]]:
    """(start, end, kind) of each entity, left to right; a name gives one for each of its words, and so do its words elsewhere in the text."""
    if not text or not _QUICK.search(text):
        return []
    out, names = [], set()
    at = 0
    while m := _PATTERN.search(text, at):
        kind, at = m.lastgroup, m.end()
        if kind == "person":
            for a, z in _name(text, m.end()):
                out.append((a, z, "person" if z - a > 1 else "initial"))
                if z - a > 2:
                    names.add(text[a:z])
                at = z
            continue
        if kind == "ipv6" and not _is_ipv6(m.group()):
            continue
        if kind == "card" and not _luhn(re.sub(r"\D", "", m.group())):
            kind = "phone"
        out.append((m.start(), m.end(), kind))
    if names:
        spans = iter([*out, (len(text) + 1, 0, "")])
        a, z, _ = next(spans)
        more = []
        for m in _NAME_WORD.finditer(text):
            if m.group() not in names:
                continue
            while z and z <= m.start():
                a, z, _ = next(spans)
            if m.end() <= a:
                more.append((m.start(), m.end(), "person"))
        out = sorted(out + more)
    return out


def entities(docs: DataFrame) -> DataFrame:
    """(kind, value, n): all distinct entities in their canonical form."""

    def run(batches):
        for b in batches:
            rows = []
            for t in b.column("text").to_pylist():
                rows += [(kind, canonical(kind, t[a:z])) for a, z, kind in detect(t) if kind != "initial"]
            cols = list(zip(*rows)) if rows else [[], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], ["kind", "value"])

    return docs.select("text").mapInArrow(run, "kind string, value string").groupBy("kind", "value").agg(F.count("*").alias("n"))


def _drawn(found: DataFrame, key: bytes) -> DataFrame:
    def run(batches):
        for b in batches:
            got = [canonical(k, surrogate(k, v, key, t)) for k, v, t in zip(*(b.column(c).to_pylist() for c in ("kind", "value", "turn")))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("kind", "value", "turn")), pa.array(got, pa.string())], ["kind", "value", "turn", "made"])

    return found.select("kind", "value", "turn").mapInArrow(run, "kind string, value string, turn int, made string")


def exceptions(found: DataFrame, key: bytes) -> DataFrame:
    """Entities whose first surrogate collides with another one's or with a real entity, and the turn that does not. Later turns of names are longer, so there is one."""
    real = found.select("kind", F.col("value").alias("made")).distinct()
    now = durable(_drawn(found.withColumn("turn", F.lit(0)), key))
    keys = ["kind", "value"]
    while True:
        first = F.struct("turn", "value")
        owner = now.groupBy("kind", "made").agg(F.min(first).alias("owner"), F.count("*").alias("claims"))
        taken = now.join(owner.where("claims > 1"), ["kind", "made"]).where(first != F.col("owner")).select(*keys)
        clash = now.join(real, ["kind", "made"], "left_semi").select(*keys)
        bad = durable(taken.union(clash).distinct())
        if bad.isEmpty():
            return now.where("turn > 0").select(*keys, "turn")
        moved = _drawn(now.join(bad, keys, "left_semi").withColumn("turn", F.col("turn") + 1), key)
        now = durable(now.join(bad, keys, "left_anti").unionByName(moved))


def replace(text, key: bytes, turns: dict) -> tuple[str | None, list[str]]:
    spans = detect(text)
    if not spans:
        return text, []
    out, at = [], 0
    for a, z, kind in spans:
        value = canonical(kind, text[a:z])
        new = surrogate(kind, value if kind in ("email", "ipv6") else text[a:z], key, turns.get((kind, value), 0))
        out += [text[at:a], new]
        at = z
    return "".join(out) + text[at:], [x[2] for x in spans]


_TURNS, _MARK = "__turns", "__text_sha256"


def _with_turns(docs: DataFrame, odd: DataFrame) -> DataFrame:
    """`docs` with the turns of each text's own exceptions (JSON), by the digest of the text."""

    def run(batches):
        for b in batches:
            rows = []
            for t in dict.fromkeys(b.column("text").to_pylist()):
                if spans := detect(t):
                    mark = hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()
                    rows += [(mark, *e) for e in dict.fromkeys((kind, canonical(kind, t[a:z])) for a, z, kind in spans)]
            cols = list(zip(*rows)) if rows else [[]] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in cols], [_MARK, "kind", "value"])

    held = docs.select("text").mapInArrow(run, f"{_MARK} string, kind string, value string").dropDuplicates()
    entry = F.array("kind", "value", F.col("turn").cast("string"))
    by = held.join(odd, ["kind", "value"]).groupBy(_MARK).agg(F.to_json(F.collect_list(entry)).alias(_TURNS))
    return docs.withColumn(_MARK, F.sha2(F.col("text"), 256)).join(by, _MARK, "left").drop(_MARK)


def anonymise(docs: DataFrame, key: bytes, most_exceptions: int = 200_000) -> DataFrame:
    """`docs` with text replaced, plus n_<kind> counts (long) for each kind, with underscores where a column has that name; names are counted by words."""
    spark = docs.sparkSession
    found = durable(entities(docs))
    odd = durable(exceptions(found, key))
    joined = len(few := odd.limit(most_exceptions + 1).collect()) > most_exceptions
    turns = spark.sparkContext.broadcast({} if joined else {(r["kind"], r["value"]): r["turn"] for r in few})
    names = docs.columns
    fed = _with_turns(docs, odd) if joined else docs
    low = {n.lower() for n in names}
    extra = {}
    for k in KINDS:
        n = f"n_{k}"
        while n in low:
            n += "_"
        extra[n] = k

    def run(batches):
        for b in small(batches):
            own = [{tuple(x[:2]): int(x[2]) for x in json.loads(o or "[]")} for o in b.column(_TURNS).to_pylist()] if joined else [turns.value] * b.num_rows
            got = [replace(t, key, o) for t, o in zip(b.column("text").to_pylist(), own)]
            cols = [pa.array([g[0] for g in got], pa.string()) if n == "text" else b.column(n) for n in names]
            counts = [pa.array([g[1].count(k) for g in got], pa.int64()) for k in extra.values()]
            yield pa.RecordBatch.from_arrays([*cols, *counts], [*names, *extra])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [f"{n} long" for n in extra])
    return fed.mapInArrow(run, schema)
