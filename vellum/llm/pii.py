"""Personal data replaced by surrogates that keep type, format, gender and script.

Detection: e-mail addresses, telephone numbers, IPv4 addresses, payment cards
(Luhn-checked), IBANs (mod 97), US social security numbers, secrets after a
key sign, and person names (after a title, or a known given name with a
surname, initials between them or not; then the same names at their other
capitalised places in the text).

Surrogates come from a keyed permutation of the values of one format: digits
give digits, letters letters of the same script and kind, check digits are
made valid again, given names go round a keyed cycle of names of the same
gender and script. A permutation maps equal values alike (coreference, over
all documents, without any table) and different values apart (distinctness).
A surrogate may still be someone else's real value in the corpus. So the
distinct values found are joined with their surrogates: values whose
surrogate is an original, or another's surrogate, get the next permutation
until no collision is left. A name or address whose format is used up (a
surname of two letters, say) gets a letter more every ``GROW`` attempts, so
the rounds end; digits of fixed formats need a free value of their format.
These exceptions are handed to the rewriting pass
by broadcast, or by a join on the row when they are more than ``BROADCAST``.

Scale: two narrow passes over the texts; between them only distinct values
are shuffled, combined first. Nothing whole reaches the driver.
"""

from __future__ import annotations

import hashlib
import re
import secrets
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.common import batch, chunks, doc_rows, store, table, with_uid

KEY_SETTING = "spark.vellum.pii.key"  # of the session; the key is never stored here
BROADCAST = 20_000
ROUNDS = 6
GROW = 4
PART = 32  # symbols of a long value permuted at once; a draw has 256 bits and must reach every symbol of half of twice as many

# Titles by gender, and given names by (script, gender).
TITLES = {"Mr": "m", "Sir": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m", "Signor": "m", "Господин": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Madam": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mademoiselle": "f", "Señora": "f",
          "Sra": "f", "Srta": "f", "Doña": "f", "Signora": "f", "Госпожа": "f", "Dr": "n", "Prof": "n", "Professor": "n"}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Paul Peter Hans Klaus "
                    "Jürgen Stefan Andreas Pierre Jean Louis François Antoine Carlos José Luis Miguel Javier Pablo Marco Giovanni".split(),
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Emily Emma Anna Laura Julia Petra Sabine Heike "
                    "Monika Ursula Marie Sophie Camille Chloé Amélie María Carmen Lucía Isabel Elena Paula Giulia Francesca".split(),
    ("cyrillic", "m"): "Александр Дмитрий Сергей Андрей Алексей Иван Михаил Николай Владимир Павел".split(),
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия".split(),
}
LETTERS = {  # symbols that stand for one another
    "latin": ("aeiouy", "bcdfghjklmnpqrstvwxz", "äöüéèêëàâáíìîóòôúùûñçß"),
    "cyrillic": ("аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"),
    "greek": ("αεηιουω", "βγδζθκλμνξπρστφχψ"),
}

EMAIL = re.compile(r"(?<![\w.%+-])[._%+-]*+([^\W_][\w.%+-]*+@(?:[^\W_](?:[\w-]{0,62}\w)?\.)+[^\W\d_]{2,24})")
NUMBER = re.compile(r"[+(\d][\d .()/+-]{6,}+")  # a whole run; the patterns below hold no other characters
IPV4 = re.compile(r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\.?\d|\w)")
CARD = re.compile(r"(?<!\w)(?:\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\w)")
PHONE = re.compile(r"(?<![\w.+])(?:\+\d{1,3}[ .-]?(?:\(0?\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}|\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}|\d{3}[ .-]\d{3}[ .-]\d{4})(?!\w)")
SSN = re.compile(r"(?<![\w-])(?!000|666|9)\d{3}-(?!00)\d{2}-(?!0000)\d{4}(?![\w-])")
IBAN = re.compile(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")
SECRET = re.compile(r"""(?<=[=:])\s{0,8}["'`]?([A-Za-z0-9_+/~-]{16,}+={0,2})(?=["'`]|[\s,;.!#&)|]|$)""")
_WORD = r"[^\W\d_][^\W\d_]+(?:-[^\W\d_][^\W\d_]+)?"
_INITIALS = r"(?:[^\W\d_]\.[ \t]*|[A-Z][ \t]+)*"
WORD = re.compile(_WORD)
NAME = re.compile(r"\b(?:(" + "|".join(sorted(TITLES, key=len, reverse=True)) + r")\b\.?[ \t]+" + _INITIALS + "(" + _WORD + r")(?:[ \t]+" + _INITIALS + "(" + _WORD + r"))?|("
                  + "|".join(sorted((n for x in GIVEN.values() for n in x), key=len, reverse=True)) + r")[ \t]+" + _INITIALS + "(" + _WORD + r"))")
GENDER = {name: (script, gender) for (script, gender), names in GIVEN.items() for name in names}


def luhn(digits: str) -> int:
    """Luhn sum of all digits, modulo 10; 0 is valid."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10


def _iban_check(country: str, rest: str) -> str:
    number = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - number % 97:02d}"


def find(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of the entities, in order, not overlapping; earlier types win."""
    found: list[tuple[int, int, str, str]] = []
    taken: list[tuple[int, int]] = []  # in order

    def add(a, b, kind, value):
        i = bisect_left(taken, (a, b))
        if (i == 0 or taken[i - 1][1] <= a) and (i == len(taken) or b <= taken[i][0]):
            taken.insert(i, (a, b))
            found.append((a, b, kind, value))

    if "@" in text:
        for m in EMAIL.finditer(text):
            add(*m.span(1), "email", m[1].lower())
    for m in SECRET.finditer(text):
        value = m[1]
        if len(set(value)) >= 8 and any(c.isdigit() for c in value) and any(c.isalpha() for c in value):
            add(*m.span(1), "secret", value.lower() if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", value) else value)
    for m in IBAN.finditer(text):
        value = m[0].replace(" ", "")
        if 15 <= len(value) <= 34 and _iban_check(value[:2], value[4:]) == value[2:4]:
            add(*m.span(), "iban", value)
    for run in NUMBER.finditer(text):
        a, b = run.start(), run.end() + 1  # what follows the run must be seen
        for m in IPV4.finditer(text, a, b):
            if all(int(x) < 256 and str(int(x)) == x for x in m[0].split(".")):
                add(*m.span(), "ipv4", m[0])
        m = CARD.search(text, a, b)
        while m:
            value = re.sub(r"\D", "", m[0])
            good = 13 <= len(value) <= 19 and luhn(value) == 0 and len(set(value)) > 1
            if good:
                add(*m.span(), "card", value)
            m = CARD.search(text, m.end() if good else m.start() + 1, b)
        for m in SSN.finditer(text, a, b):
            add(*m.span(), "ssn", m[0].replace("-", ""))
        for m in PHONE.finditer(text, a, b):
            value = re.sub(r"\D", "", m[0])
            if 8 <= len(value) <= 15:
                add(*m.span(), "phone", value)
    for m in NAME.finditer(text):
        words = [k for k in (2, 3, 4, 5) if m[k] and m[k][0].isupper()]
        if 3 in words and 2 not in words:
            continue
        for k in words:  # after a title: given name and surname, or either alone
            given = m[k] in GENDER and k != 5 and (k != 3 or m[2] not in GENDER)
            if k != 4 or 5 in words:
                add(*m.span(k), "given" if given else "surname", m[k] if given else m[k].lower())
    names = {v for _, _, k, v in found if k in ("given", "surname")}
    if names:  # the same names at their other places
        for m in WORD.finditer(text):
            words, at = ([m[0]] if m[0].lower() in names else m[0].split("-")), m.start()
            for w in words:
                if w in names and w in GENDER:
                    add(at, at + len(w), "given", w)
                elif w[:1].isupper() and w.lower() in names:
                    add(at, at + len(w), "surname", w.lower())
                at += len(w) + 1
    return sorted(found)


def _draw(key: str, *what) -> int:
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, what)).encode("utf-8", "surrogatepass"), key=key.encode()[:64], digest_size=32).digest(), "big")


def permute(key: str, tweak: str, values: list[int], sizes: list[int]) -> list[int]:
    """A keyed permutation of the tuples below ``sizes``: a Feistel network of modular sums on two halves."""
    half = max(1, len(sizes) // 2) if len(sizes) > 1 else 1

    def pack(v, s):
        n = 0
        for x, y in zip(v, s):
            n = n * y + x
        return n

    def unpack(n, s):
        out = []
        for y in reversed(s):
            n, x = divmod(n, y)
            out.append(x)
        return out[::-1]

    def product(s):
        n = 1
        for x in s:
            n *= x
        return n

    ls, rs = sizes[:half], sizes[half:]
    left, right, lm, rm = pack(values[:half], ls), pack(values[half:], rs), product(ls), product(rs)
    shape = ",".join(map(str, sizes))
    for r in range(ROUNDS):
        if r % 2 == 0:
            left = (left + _draw(key, tweak, shape, r, right)) % lm
        elif rm > 1:
            right = (right + _draw(key, tweak, shape, r, left)) % rm
    return unpack(left, ls) + unpack(right, rs)


def _classes(value: str, extra: str = "") -> tuple[list[int], list[str]]:
    """(positions, symbols) of the characters that may change."""
    at, symbols = [], []
    sets = [extra, "0123456789"] + [g for script in LETTERS.values() for g in script]
    for i, c in enumerate(value):
        s = next((x for x in sets if c in x), None)
        if s is None and c.islower() and c > "\x7f":  # cased letters of other alphabets: those near it in Unicode
            near = (chr(x) for x in range(ord(c) & ~63, (ord(c) & ~63) + 64))
            s = "".join(x for x in near if x.islower() and x.upper() != x and x.upper().lower() == x and not any(x in y for y in sets))
            s = s if c in s else None
        if s is None and c.lower() != c and len(c.lower()) == 1:
            s = next((x.upper() for x in sets if c.lower() in x and len(x.upper()) == len(x)), None)
        if s:
            at.append(i)
            symbols.append(s)
    return at, symbols


def _reformed(key: str, tweak: str, value: str, extra: str = "") -> str:
    at, symbols = _classes(value, extra)
    out = list(value)
    size = len(at) if len(at) <= 2 * PART else PART
    for k in range(0, len(at), size or 1):  # parts of a long value, each under what stands before it
        where, kinds = at[k:k + size], symbols[k:k + size]
        own = f"{tweak}/{hashlib.blake2b(value[:where[0]].encode('utf-8', 'surrogatepass')).hexdigest()}" if k else tweak
        for i, s, n in zip(where, kinds, permute(key, own, [s.index(value[i]) for i, s in zip(where, kinds)], [len(s) for s in kinds])):
            out[i] = s[n]
    return "".join(out)


def _grown(key: str, tweak: str, value: str, attempt: int) -> str:
    """``value`` reformed, longer by a letter every ``GROW`` attempts; all drawn if no symbol of it may change."""
    at, symbols = _classes(value)
    letters = next((s for s in symbols if s.isalpha()), "bcdfghjklmnpqrstvwxz")
    n, base = (attempt // GROW, _reformed(key, tweak, value)) if at else (max(2, len(value)) + attempt // GROW, "")
    return base + "".join(letters[_draw(key, tweak, "grown", value, i) % len(letters)] for i in range(n))


def _cycle(key: str, name: str, tweak: str) -> str:
    script, gender = GENDER[name]
    order = sorted(GIVEN[script, gender], key=lambda n: _draw(key, "names", n))
    return order[(order.index(name) + 1) % len(order)]


def surrogate(key: str, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    tweak = f"{kind}/{attempt}"
    if kind == "given":
        return _cycle(key, value, tweak)
    if kind == "ipv4":
        return ".".join(map(str, permute(key, tweak, [int(x) for x in value.split(".")], [256] * 4)))
    if kind == "card":
        body = value[0] + _reformed(key, tweak, value[1:-1])
        return body + str((10 - luhn(body + "0")) % 10)
    if kind == "iban":
        rest = _reformed(key, tweak, value[4:])
        return value[:2] + _iban_check(value[:2], rest) + rest
    if kind == "ssn":
        area, group, serial = int(value[:3]), int(value[3:5]), int(value[5:])
        areas = [x for x in range(1, 900) if x != 666]
        a, g, s = permute(key, tweak, [areas.index(area), group - 1, serial - 1], [len(areas), 99, 9999])
        return f"{areas[a]:03d}{g + 1:02d}{s + 1:04d}"
    if kind == "secret" and re.fullmatch(r"[0-9a-f]+", value):
        return _reformed(key, tweak, value, "0123456789abcdef")
    if kind == "email":
        local, _, domain = value.rpartition("@")
        host, _, top = domain.rpartition(".")
        if attempt < GROW and _classes(local + host)[0]:
            return f"{_reformed(key, tweak, f'{local}@{host}')}.{top}"
        return f"{_grown(key, tweak, local, attempt)}@{_reformed(key, tweak, host)}.{top}"
    if kind == "phone":
        return value[:1] + _reformed(key, tweak, value[1:])
    return _grown(key, tweak, value, attempt) if kind == "surname" else _reformed(key, tweak, value)


def dressed(kind: str, shown: str, new: str) -> str:
    """A canonical surrogate in the format the value was shown in: its separators and capitals."""
    if kind in ("email", "surname", "secret"):
        rest = new[len(shown):]
        return "".join(n.upper() if c.isupper() and len(n.upper()) == 1 else n for c, n in zip(shown, new)) + (rest.upper() if shown.isupper() else rest)
    if kind in ("card", "phone", "ssn", "iban"):
        symbols = iter(new)
        return "".join(next(symbols) if c.isalnum() else c for c in shown)
    return new


def rewrite(key: str, text: str, exceptions: dict) -> tuple[str, list[tuple[str, int, int]]]:
    """(text with surrogates, (type, start, end) of each in the new text)."""
    out, spans, at, shift = [], [], 0, 0
    for a, b, kind, value in find(text):
        new = exceptions.get((kind, value)) or surrogate(key, kind, value)
        new = dressed(kind, text[a:b], new)
        out += [text[at:a], new]
        spans.append((kind, a + shift, a + shift + len(new)))
        shift += len(new) - (b - a)
        at = b
    return "".join([*out, text[at:]]), spans


def values_found(docs: DataFrame, uid: str | None = None) -> DataFrame:
    """(uid, kind, value): the distinct entities of each row."""
    schema = pa.schema([("uid", pa.int64()), ("kind", pa.string()), ("value", pa.string())])

    def run(batches):
        for b in batches:
            uid, texts = b.column("uid").to_pylist(), b.column("text").to_pylist()
            for lo, hi in chunks(texts):
                rows = [(uid[i], k, v) for i in range(lo, hi) if texts[i] for k, v in {(k, v) for _, _, k, v in find(texts[i])}]
                yield batch(schema, [[r[c] for r in rows] for c in range(3)])

    return doc_rows(docs, uid).select("uid", "text").mapInArrow(run, "uid long, kind string, value string")


def _surrogates(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, attempt) -> the same with their surrogate ``new``."""
    schema = pa.schema([("kind", pa.string()), ("value", pa.string()), ("attempt", pa.int32()), ("new", pa.string())])

    def run(batches):
        for b in batches:
            cols = [b.column(c) for c in ("kind", "value", "attempt")]
            yield batch(schema, [*cols, [surrogate(key, *x) for x in zip(*(c.to_pylist() for c in cols))]])

    return values.select("kind", "value", "attempt").mapInArrow(run, "kind string, value string, attempt int, new string")


def exceptions(values: DataFrame, key: str) -> DataFrame:
    """(kind, value, new): values whose first surrogate collides, with one that doesn't.

    ``values`` has distinct (kind, value). A surrogate collides when it is an
    original of its kind, or that of a value earlier in order. Given names
    only exchange places in a fixed cycle and can't collide.
    """
    todo = _surrogates(values.where("kind <> 'given'").withColumn("attempt", F.lit(0)), key)
    fixed = None
    state = store(todo, "surrogates")
    while True:
        originals = values.select("kind", F.col("value").alias("new"))
        hit = state.join(originals, ["kind", "new"], "left_semi").select("kind", "value")
        first = state.groupBy("kind", "new").agg(F.min(F.struct("attempt", "value")).alias("first"), F.count("*").alias("n")).where("n > 1")
        twice = state.join(first, ["kind", "new"]).where(F.col("value") != F.col("first.value")).select("kind", "value")
        bad = store(hit.union(twice).distinct(), "collisions")
        if not bad.limit(1).count():
            return state.where("attempt > 0").select("kind", "value", "new")
        again = state.join(bad, ["kind", "value"], "left_semi").select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        state = store(state.join(bad, ["kind", "value"], "left_anti").select("kind", "value", "attempt", "new").union(
            _surrogates(again, key)), "surrogates")


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """(uid, doc_id, text, n_entities, entities), one row per input row.

    ``entities`` has (type, start, end) of each surrogate in the new text; no
    original value is returned. Texts without entities, empty and null texts
    come back as they are; a text of any length is read whole. Repeated rows
    come out alike, null ids matter nothing. Two values that would take one
    surrogate are told apart (no ties remain). An empty table gives an empty
    result. Only doc_id and text are read, so extra columns of any name do no
    harm. Whoever has ``key`` can undo the permutations: keep it secret.
    """
    docs, uid = with_uid(docs)
    found = store(values_found(docs, uid), "entities")
    values = store(found.select("kind", "value").distinct(), "entity-values")
    known = exceptions(values, key)
    rows = doc_rows(docs, uid)
    few = known.limit(BROADCAST + 1).collect()  # at most BROADCAST + 1 rows
    table_ = {(r.kind, r.value): r.new for r in few} if len(few) <= BROADCAST else {}
    if len(few) > BROADCAST:
        own = found.join(known, ["kind", "value"]).groupBy("uid").agg(F.collect_list(F.struct("kind", "value", "new")).alias("own"))
        rows = rows.join(own, "uid", "left")
    schema = pa.schema([("uid", pa.int64()), ("doc_id", pa.int64()), ("text", pa.string()), ("n_entities", pa.int32()),
                        ("entities", pa.list_(pa.struct([("type", pa.string()), ("start", pa.int32()), ("end", pa.int32())])))])

    def run(batches):
        for b in batches:
            texts = b.column("text").to_pylist()
            own = b.column("own").to_pylist() if "own" in b.schema.names else None
            for lo, hi in chunks(texts):
                done = [(None, []) if t is None else rewrite(key, t, table_ if own is None else {(x["kind"], x["value"]): x["new"] for x in own[i] or ()})
                        for i, t in enumerate(texts[lo:hi], lo)]
                yield batch(schema, [b.column("uid").slice(lo, hi - lo), b.column("doc_id").slice(lo, hi - lo), [t for t, _ in done],
                                     [len(s) for _, s in done], [[{"type": k, "start": x, "end": y} for k, x, y in s] for _, s in done]])

    return rows.mapInArrow(run, "uid long, doc_id long, text string, n_entities int, entities array<struct<type: string, start: int, end: int>>")


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the session's key, or one drawn for this run alone, after which no one can undo it."""
    key = spark.conf.get(KEY_SETTING, None) or secrets.token_hex(32)
    return replace_pii(table(spark, sf_dir, "documents"), key).drop("uid")
