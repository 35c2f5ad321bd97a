"""Personal data: keyed, type-consistent surrogates.

Entities (e-mail addresses, phone numbers, IPv4 addresses, card and account
numbers, US social security numbers, IBANs, names after a form of address) are
found by shape. Every entity has a canonical value, under which all its
spellings meet (coreference), and one surrogate, a function of a secret key,
type, canonical value and attempt number. A surrogate keeps the format:
digits stay digits, letters keep case and script, separators and a phone's
country code stay, a card stays Luhn-valid or not, a name keeps the gender that
its form of address tells.

Distinctness is checked over the whole corpus: distinct entities are written
once, and as long as two of them have the same surrogate, or a surrogate is a
real entity's value, all but one of those move to the next attempt. These
checks are groupings and joins by surrogate; nothing is gathered. Only
entities with a later attempt than the first are needed for the texts again;
they are grouped by document and joined on a row key, which Spark broadcasts
only when it is small.

Names: all capitalised words after a form of address, the last one the family
name. Family names and given names are entities of their own, so "Mr. Ivan
Petrov" and "Mr. Petrov" get the same family name. Further whole-word mentions of
a name in the same text, capitalised or in capitals, are the same entity (that of
its first mention after a form of address). Names that never follow one stay.

Defined cases: null stays null and has no entity; equal texts get equal
replacements; an empty table gives an empty result; columns of any name are kept.
"""

from __future__ import annotations

import hashlib
import hmac
import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from souk.llm.common import fresh, stored, text_batches
from souk.session import ship_package

KEY = b"surrogates-1"
FIRST_ONLY = 12          # attempts in the entity's own space; later ones may grow longer

# Forms of address and the gender they tell.
TITLES = {"Mr": "m", "Mister": "m", "Herr": "m", "Herrn": "m", "Monsieur": "m", "Señor": "m", "Sr": "m", "Don": "m",
          "Mrs": "f", "Ms": "f", "Miss": "f", "Frau": "f", "Madame": "f", "Mme": "f", "Mlle": "f", "Señora": "f",
          "Sra": "f", "Srta": "f", "Doña": "f", "господин": "m", "госпожа": "f", "г-н": "m", "г-жа": "f"}
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_NOT_NEXT = "|".join(sorted(map(re.escape, set(TITLES) - {"Don"}), key=len, reverse=True))     # Don is a given name too
_CAPITALISED = r"[^\W\d_a-zà-ÿа-яё][^\W\d_]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SHAPES = {
    "email": r"(?<![\w.%+-])\w[\w.%+-]*@(?:[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?\.)+[A-Za-z]{2,}",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3,4}[ .-]\d{3,4}(?![\w-]|\.\d)|(?<![\w.])\+\d{8,15}(?!\w)",
    "ssn": r"(?<![\w.-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": rf"(?<![\w.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\w|\.\d)",
    "card": r"(?<!\w)(?:\d{13,19}|\d{4}(?:[ -]\d{4}){2,3}(?:[ -]\d{1,3})?)(?!\w)",
    "name": (rf"(?<!\w)(?P<title>{_TITLE})\.?[ \t]+(?P<names>{_CAPITALISED}"
             rf"(?:[ -](?!(?:{_NOT_NEXT})(?!\w)){_CAPITALISED})*)"),
}
_PATTERNS = {k: re.compile(p) for k, p in SHAPES.items()}
_DIGIT = re.compile(r"\d")

_ONSETS = {"latin": ["b", "d", "f", "g", "k", "l", "m", "n", "p", "r", "s", "t", "v", "br", "dr", "st"],
           "cyrillic": ["б", "в", "г", "д", "к", "л", "м", "н", "п", "р", "с", "т", "ж", "з", "бр", "ст"]}
_VOWELS = {"latin": ["a", "e", "i", "o", "u", "ai", "ei", "ou"], "cyrillic": ["а", "е", "и", "о", "у", "ю", "я", "э"]}
_ENDINGS = {("latin", "m"): ["n", "r", "s", "rt", "ld", "k", "rd", "no"], ("latin", "f"): ["na", "lia", "ra", "ne", "sa", "tte", "lla", "ria"],
            ("cyrillic", "m"): ["н", "р", "с", "й", "л", "к", "м", "т"], ("cyrillic", "f"): ["на", "ля", "ра", "са", "та", "ва", "да", "ня"]}
_FAMILY = {("latin", "m"): ["son", "mann", "ez", "ard", "ley", "er", "in", "ot"], ("latin", "f"): ["son", "mann", "ez", "ard", "ley", "er", "in", "ot"],
           ("cyrillic", "m"): ["ов", "ев", "ин", "ский", "ко", "ук", "ян", "дзе"], ("cyrillic", "f"): ["ова", "ева", "ина", "ская", "ко", "ук", "ян", "дзе"]}


class _Stream:
    """Keyed numbers of one (type, value, attempt)."""

    def __init__(self, key: bytes, kind: str, value: str, attempt: int):
        self.seed = hmac.new(key, f"{kind}\0{value}\0{attempt}".encode(), hashlib.sha256).digest()
        self.n, self.pool = 0, b""

    def below(self, k: int) -> int:
        if len(self.pool) < 4:
            self.pool += hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        x, self.pool = int.from_bytes(self.pool[:4], "big"), self.pool[4:]
        return x % k

    def pick(self, values):
        return values[self.below(len(values))]


def _luhn(digits: str) -> int:
    return sum(int(d) if i % 2 == 0 else sum(divmod(2 * int(d), 10)) for i, d in enumerate(reversed(digits))) % 10


def _same_shape(text: str, s: _Stream) -> str:
    out = []
    for c in text:
        if c.isdigit():
            out.append(str(s.below(10)))
        elif c.isalpha():
            base = chr(ord("а") + s.below(32)) if "а" <= c.lower() <= "я" or c.lower() == "ё" else chr(97 + s.below(26))
            out.append(base.upper() if c.isupper() else base)
        else:
            out.append(c)
    return "".join(out)


def canonical(kind: str, text: str) -> str:
    if kind in ("phone", "card", "ssn"):
        return ("+" if text.startswith("+") else "") + "".join(_DIGIT.findall(text))
    if kind == "iban":
        return text.replace(" ", "")
    if kind == "email":
        return text.lower()
    return text


def surrogate(kind: str, value: str, attempt: int, key: bytes = KEY) -> str:
    """The surrogate of a canonical value, itself canonical."""
    s = _Stream(key, kind, value, attempt)
    longer = max(0, attempt - FIRST_ONLY)
    if kind == "email":
        local, domain = value.rsplit("@", 1)
        labels = domain.split(".")
        d = _Stream(key, "domain", domain, 0)           # one domain, one surrogate domain
        labels = [_same_shape(x, d) for x in labels[:-2]] + ["example", labels[-1]] if len(labels) > 1 else labels
        return _same_shape(local, s) + "".join(str(s.below(10)) for _ in range(longer)) + "@" + ".".join(labels)
    if kind == "ip":
        return ".".join(str(1 + s.below(254)) for _ in range(4))
    if kind == "phone":
        keep = 2 if value.startswith("+") else 0        # sign and first digit of the country code
        return value[:keep] + "".join(str(s.below(10)) for _ in value[keep:])
    if kind == "card":
        head = value[0] + "".join(str(s.below(10)) for _ in value[1:-1])
        last = next(d for d in "0123456789" if (_luhn(head + d) == 0) == (_luhn(value) == 0))
        return head + last
    if kind == "iban":
        return value[:2] + _same_shape(value[2:], s)
    if kind == "ssn":
        return "9" + "".join(str(s.below(10)) for _ in value[1:])
    part, gender, script, name = value.split(":", 3)
    gender = gender if gender in "mf" else "m"
    syllables = 1 + s.below(2) + longer
    stem = "".join(s.pick(_ONSETS[script]) + s.pick(_VOWELS[script]) for _ in range(syllables + (part == "given")))
    ending = s.pick((_ENDINGS if part == "given" else _FAMILY)[script, gender])
    return f"{part}:{value.split(':', 3)[1]}:{script}:{stem + ending}"


def _dress(kind: str, text: str, new: str) -> str:
    """A canonical surrogate in the spelling of ``text``: separators, case."""
    if kind in ("phone", "card", "ssn", "iban"):
        left = iter(new)
        out = "".join(next(left, "") if c.isalnum() or c == "+" else c for c in text)
        return out + "".join(left)
    if kind == "email" and text.upper() == text and text.lower() != text:
        return new.upper()
    if kind == "name":
        new = new.rsplit(":", 1)[1]
        return new.upper() if text.isupper() else new.capitalize()
    return new


def find_entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value), not overlapping, by start; earlier shapes of ``SHAPES`` win."""
    found: list[tuple[int, int, str, str]] = []
    has_digit = _DIGIT.search(text) is not None
    for kind, pattern in _PATTERNS.items():
        if kind == "email" and "@" not in text or kind in ("iban", "phone", "ssn", "ip", "card") and not has_digit:
            continue
        if kind == "name" and not any(t in text for t in TITLES):
            continue
        for m in pattern.finditer(text):
            if kind == "phone" and sum(c.isdigit() for c in m.group()) < 8:
                continue
            if kind != "name":
                found.append((m.start(), m.end(), kind, canonical(kind, m.group())))
                continue
            gender = TITLES[m["title"]]
            words = list(re.finditer(r"[^ -]+", m["names"]))
            for i, w in enumerate(words):
                part = "family" if i == len(words) - 1 else "given"
                script = "cyrillic" if re.search("[а-яё]", w.group().lower()) else "latin"
                # one family name for all genders in scripts whose family names don't change
                g = gender if part == "given" or script == "cyrillic" else "x"
                found.append((m.start("names") + w.start(), m.start("names") + w.end(), "name",
                              f"{part}:{g}:{script}:{w.group().lower()}"))
    names: dict[str, str] = {}
    for a, b, kind, value in found:
        if kind == "name":
            for spelling in (text[a:b], text[a:b].capitalize(), text[a:b].upper()):
                names.setdefault(spelling, value)
    if names:                                        # after the titled ones, which come first among equal spans
        mention = re.compile(r"(?<!\w)(?:" + "|".join(sorted(map(re.escape, names), key=len, reverse=True)) + r")(?!\w)")
        found += [(m.start(), m.end(), "name", names[m.group()]) for m in mention.finditer(text)]
    order, out, end = {k: i for i, k in enumerate(SHAPES)}, [], 0
    for span in sorted(found, key=lambda x: (x[0], order[x[2]], -x[1])):
        if span[0] >= end:
            out.append(span)
            end = span[1]
    return out


def replace_entities(text: str, attempts: dict[tuple[str, str], int], key: bytes = KEY) -> tuple[str, list]:
    parts, at, spans = [], 0, find_entities(text)
    for a, b, kind, value in spans:
        parts += [text[at:a], _dress(kind, text[a:b], surrogate(kind, value, attempts.get((kind, value), 0), key))]
        at = b
    return "".join([*parts, text[at:]]), spans


def occurrences(docs: DataFrame) -> DataFrame:
    """(rowkey, type, value): the distinct entities of each document."""
    def run(batches):
        for batch in batches:
            rows = [(k, t, v) for k, text in zip(batch.column("rowkey").to_pylist(), batch.column("text").to_pylist())
                    if text for t, v in sorted({(x[2], x[3]) for x in find_entities(text)})]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(3)],
                                             names=["rowkey", "type", "value"])

    ship_package(docs.sparkSession)
    return docs.select(_rowkey().alias("rowkey"), "text").mapInArrow(run, "rowkey string, type string, value string")


def _rowkey():
    text = F.coalesce("text", F.lit(""))
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit(":"), F.md5(text)))


def assign_attempts(entities: DataFrame, key: bytes = KEY, make=None, max_rounds: int = 200) -> DataFrame:
    """(type, value, attempt, surrogate) of distinct entities (type, value), all surrogates distinct.

    In each round, of the entities with one surrogate the one with the smallest
    (attempt, value) keeps it, and none keeps a surrogate that is a real value.
    ``make`` replaces the surrogate function in tests.
    """
    make = make or surrogate

    @F.pandas_udf("string")
    def made(kind: pd.Series, value: pd.Series, attempt: pd.Series) -> pd.Series:
        return pd.Series([make(k, v, int(a), key) for k, v, a in zip(kind, value, attempt)], dtype=object)

    entities = entities.select("type", "value").distinct()
    now = stored(entities.withColumn("attempt", F.lit(0)).withColumn("surrogate", made("type", "value", "attempt")), "pii-round")
    real = now.select(F.col("type").alias("rt"), F.col("value").alias("rv"))
    for _ in range(max_rounds):
        owner = now.groupBy("type", "surrogate").agg(F.min(F.struct(F.col("attempt"), F.col("value"))).alias("first"),
                                                     F.count("*").alias("n"))
        taken = owner.filter("n > 1").select(F.col("type").alias("ot"), F.col("surrogate").alias("os"), F.col("first.value").alias("ov"))
        clash = (now.join(taken, (F.col("type") == F.col("ot")) & (F.col("surrogate") == F.col("os"))).filter("value <> ov").select("type", "value")
                 .unionByName(now.join(real, (F.col("type") == F.col("rt")) & (F.col("surrogate") == F.col("rv")), "left_semi")
                              .select("type", "value")).distinct())
        clash = stored(clash, "pii-clash")
        if clash.isEmpty():
            return now
        clash = clash.select(F.col("type").alias("ct"), F.col("value").alias("cv"))
        moved = now.join(clash, (F.col("type") == F.col("ct")) & (F.col("value") == F.col("cv")), "left")
        moved = moved.withColumn("moved", F.col("ct").isNotNull()).select("type", "value", "surrogate", "moved",
                                 (F.col("attempt") + F.col("moved").cast("int")).alias("attempt"))
        still = moved.filter("not moved").select("type", "value", "attempt", "surrogate")
        anew = moved.filter("moved").select("type", "value", "attempt").withColumn("surrogate", made("type", "value", "attempt"))
        now = stored(still.unionByName(anew), "pii-round")
    raise RuntimeError(f"surrogates still collide after {max_rounds} rounds")


def pseudonymise(docs: DataFrame, key: bytes = KEY) -> tuple[DataFrame, str]:
    """``docs`` with entities replaced in ``text``, plus a column of (type, count); returns its name.

    ``n_chars``, if there, follows the text.
    """
    ship_package(docs.sparkSession)
    text_batches(docs.sparkSession)
    found = stored(occurrences(docs), "pii-found")
    fixed = assign_attempts(found.select("type", "value"), key).filter("attempt > 0")
    later = found.join(fixed.select("type", "value", "attempt"), ["type", "value"])
    later = stored(later.groupBy("rowkey").agg(F.collect_set(F.struct("type", "value", "attempt")).alias("later")), "pii-later")
    rk, lt, name = fresh(docs, "_rowkey", "_later", "entities")
    out = docs.withColumn(rk, _rowkey()).join(later.select(F.col("rowkey").alias(rk), F.col("later").alias(lt)), rk, "left").drop(rk)
    counts = T.ArrayType(T.StructType([T.StructField("type", T.StringType()), T.StructField("n", T.LongType())]))
    schema = T.StructType([*[f for f in out.schema.fields if f.name != lt], T.StructField(name, counts)])
    arrow = pa.list_(pa.struct([("type", pa.string()), ("n", pa.int64())]))

    def run(batches):
        for batch in batches:
            texts, stats = [], []
            for text, extra in zip(batch.column("text").to_pylist(), batch.column(lt).to_pylist()):
                if not text:
                    texts.append(text)
                    stats.append([])
                    continue
                new, spans = replace_entities(text, {(x["type"], x["value"]): x["attempt"] for x in extra or ()}, key)
                kinds = [x[2] for x in spans]
                texts.append(new)
                stats.append([{"type": k, "n": kinds.count(k)} for k in sorted(set(kinds))])
            keep = [c for c in batch.schema.names if c != lt]
            cols = [pa.array(texts, pa.string()) if c == "text" else batch.column(c) for c in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(stats, arrow)], names=[*keep, name])

    out = out.mapInArrow(run, schema)
    if "n_chars" in docs.columns:
        n = F.length("text").cast(docs.schema["n_chars"].dataType)
        out = out.withColumn("n_chars", F.when(F.size(name) > 0, n).otherwise(F.col("n_chars")))
    return out, name
