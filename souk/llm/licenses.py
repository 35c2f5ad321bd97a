"""License scans: ordered signature rules with interval suppression.

A rule is (priority, label, keyword, pattern, confidence) over the text's
words, lower-cased (A-Z) and joined by single blanks, so a pattern never has
to care about punctuation, line ends or comment marks. The rules are the
product of license names, version spellings and statement forms, most
specific first; that order is the priority.

A text goes through three gates, each implied by the rules: it must hold a word
that some rule can't do without (``gate_of``, derived from the rules), then a
rule's own keyword and the other fixed pieces of its pattern, and only then runs
the pattern. So a gate never rejects what a rule would match. Of the
matches, one that lies inside another of the same or a better priority is
suppressed; the rest stand, also where they overlap.

Everything is DataFrame expressions inside one scan; no shuffle.

Defined cases: null is an empty text; a text without words has no match;
repeated places of a rule all count; columns of any name are kept.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from souk.llm.common import GAP_ANY_CASE, WORD_ANY_CASE, ascii_lower, fresh, match_spans

# The base phrases and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# (label, keyword, names as patterns over words, versions); "" is no version.
FAMILIES = [
    ("apache", "apache", [r"apache(?: software)?"], ["1 0", "1 1", "2 0", "2"]),
    ("agpl", "affero", [r"(?:gnu )?affero general public"], ["1 0", "3 0", "3"]),
    ("lgpl", "lesser", [r"(?:gnu )?lesser general public"], ["2 1", "3 0", "3"]),
    ("lgpl", "library general", [r"(?:gnu )?library general public"], ["2 0", "2"]),
    ("gpl", "general public", [r"(?:gnu )?general public"], ["1 0", "2 0", "3 0", "1", "2", "3"]),
    ("gfdl", "free documentation", [r"(?:gnu )?free documentation"], ["1 1", "1 2", "1 3"]),
    ("mit", "mit", [r"mit(?: x11)?"], []),
    ("bsd-2-clause", "bsd", [r"(?:simplified|freebsd|(?:2|two) clause) bsd", r"bsd (?:2|two) clause"], []),
    ("bsd-3-clause", "bsd", [r"(?:new|modified|revised|(?:3|three) clause) bsd", r"bsd (?:3|three) clause"], []),
    ("bsd-4-clause", "bsd", [r"(?:original|old|(?:4|four) clause) bsd", r"bsd (?:4|four) clause"], []),
    ("bsd", "bsd", [r"bsd"], []),
    ("mpl", "mozilla", [r"mozilla public"], ["1 0", "1 1", "2 0"]),
    ("epl", "eclipse public", [r"eclipse public"], ["1 0", "2 0"]),
    ("edl", "eclipse distribution", [r"eclipse distribution"], ["1 0"]),
    ("cddl", "development and distribution", [r"common development and distribution"], ["1 0", "1 1"]),
    ("cpl", "common public", [r"common public"], ["1 0"]),
    ("eupl", "european union", [r"european union public"], ["1 0", "1 1", "1 2"]),
    ("artistic", "artistic", [r"(?:clarified )?artistic"], ["1 0", "2 0"]),
    ("isc", "isc", [r"isc"], []),
    ("zlib", "zlib", [r"zlib(?: libpng)?"], []),
    ("boost", "boost", [r"boost software"], ["1 0"]),
    ("unlicense", "unlicense", [r"(?:the )?unlicense"], []),
    ("wtfpl", "wtfpl", [r"wtfpl"], ["2"]),
    ("python", "python", [r"python(?: software foundation)?"], ["2 0"]),
    ("php", "php", [r"php"], ["3 0", "3 01"]),
    ("ofl", "open font", [r"(?:sil )?open font"], ["1 0", "1 1"]),
    ("postgresql", "postgresql", [r"postgresql"], []),
    ("osl", "open software", [r"open software"], ["1 0", "2 0", "3 0"]),
    ("ms-pl", "microsoft", [r"microsoft public"], []),
    ("ms-rl", "microsoft", [r"microsoft reciprocal"], []),
    ("odbl", "open database", [r"(?:odc )?open database"], ["1 0"]),
    ("cc0", "cc0", [r"cc0"], ["1 0"]),
    ("cc0", "creative commons zero", [r"creative commons zero"], ["1 0"]),
]
CC_PARTS = [("cc-by-nc-nd", "by nc nd", "attribution non ?commercial no ?deriv(?:ative)?s?"),
            ("cc-by-nc-sa", "by nc sa", "attribution non ?commercial share ?alike"),
            ("cc-by-nd", "by nd", "attribution no ?deriv(?:ative)?s?"),
            ("cc-by-nc", "by nc", "attribution non ?commercial"),
            ("cc-by-sa", "by sa", "attribution share ?alike"),
            ("cc-by", "by", "attribution")]
CC_VERSIONS = ["1 0", "2 0", "2 5", "3 0", "4 0"]
TAIL = r"(?:(?: software| public)? licen[sc]e)"
# (pattern with {name}, confidence); {name} holds the version where there is one
FORMS = [
    (r"spdx licen[sc]e identifier {name}", 0.99),
    (r"(?:is |are |be )?(?:re)?licensed under (?:the )?(?:terms of (?:the )?)?{name}", 0.95),
    (r"(?:released|distributed|published|available|provided|redistribute it(?: and or modify it)?) under (?:the )?(?:terms of (?:the )?)?{name}", 0.95),
    (r"subject to (?:the )?(?:terms of (?:the )?)?{name}", 0.9),
    (r"{name}", 0.7),
]
STATEMENTS = [
    ("public-domain", "public domain", r"(?:released|dedicated|placed|is) (?:in|into|to) the public domain", 0.9),
    ("mit", "permission is hereby", r"permission is hereby granted free of charge to any person obtaining a copy", 0.9),
    ("isc", "permission to use", r"permission to use copy modify and or distribute this software for any purpose", 0.9),
    ("bsd", "redistribution and use", r"redistribution and use in source and binary forms with or without modification", 0.9),
    ("zlib", "as is without any", r"provided as is without any express or implied warranty", 0.8),
    ("proprietary", "all rights reserved", r"(?:copyright [^ ]+ (?:[^ ]+ ){0,6})?all rights reserved", 0.6),
    ("unknown", "licen", r"licen[sc]ed under", 0.3),
]


def signature_rules() -> list[tuple[int, str, str, str, float]]:
    """The ordered rules: (priority, label, keyword, pattern, confidence)."""
    named = []                                       # (label, keyword, name pattern)
    for label, word, names, versions in FAMILIES:
        for name in names:
            for v in sorted(versions, key=len, reverse=True):
                named.append((f"{label}-{v.replace(' ', '.')}", word,
                              rf"{name}{TAIL}? (?:agreement )?(?:version |v ?|vers )?{v}"))
    for label, short, long in CC_PARTS:
        for v in CC_VERSIONS:
            for keyword, name in (("cc ", rf"cc {short}"), ("creative commons", rf"creative commons {long}")):
                named.append((f"{label}-{v.replace(' ', '.')}", keyword,
                              rf"{name}(?: (?:international|unported|generic))?{TAIL}? (?:version |v ?)?{v}"))
    plain = [(label, word, rf"{name}{TAIL}") for label, word, names, _ in FAMILIES for name in names]
    plain += [(label, k, rf"{n}(?:{TAIL})?") for label, short, long in CC_PARTS
              for k, n in (("cc ", rf"cc {short}"), ("creative commons", rf"creative commons {long}"))]
    found = [(label, word, form.format(name=name), confidence)
             for group in (named, plain) for form, confidence in FORMS for label, word, name in group]
    found += STATEMENTS
    return [(i, label, word, rf"(?<= ){pattern}(?= )", confidence)
            for i, (label, word, pattern, confidence) in enumerate(found)]


def literals(pattern: str) -> list[str]:
    """The fixed pieces of a rule's pattern: every match holds each of them."""
    p = re.sub(r"\(\?<?= \)", "", pattern)
    while m := re.search(r"\(\?:([^()]*)\)(\?|\{[^}]*\})?", p):
        p = p[:m.start()] + ("\0" if m[2] or "|" in m[1] else m[1]) + p[m.end():]
    if "|" in p or "(" in p:                         # nothing is known of such a pattern
        return []
    p = re.sub(r".[?*]", "\0", re.sub(r"\[[^]]*\][+*?]?", "\0", p))
    return [x for x in p.split("\0") if x.strip()]


def gate_of(rules) -> str:
    """A pattern for unchanged texts: found wherever a rule or base phrase can match.

    Per rule "licen" if its matches can't be without it, else its keyword, with
    any gap for a blank.
    """
    needed = {"licen" if any("licen" in x for x in literals(pattern)) else word for _, _, word, pattern, _ in rules}
    needed |= {"licen" if "licen" in x else x for x in PHRASES}
    least = sorted(x for x in needed if not any(y != x and y in x for y in needed))
    gap = f"(?:{GAP_ANY_CASE}|$)"
    return "(?i)" + "|".join(gap.join(map(re.escape, x.split(" "))) for x in least)


# What a text must hold to get as far as the rules.
GATE = gate_of(signature_rules())


def normal_words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased, each with a blank before and after."""
    words = ascii_lower(F.regexp_replace(text, GAP_ANY_CASE, " "))
    return F.concat(F.lit(" "), F.trim(words), F.lit(" "))


def _detections(normal: Column, rules) -> Column:
    """Standing matches: array<struct<start,end,label,confidence>>, by start."""
    by_word: dict[str, list[Column]] = {}
    for p, label, word, pattern, c in rules:
        pieces = F.array(*map(F.lit, literals(pattern))).cast("array<string>")
        by_word.setdefault(word, []).append(F.struct(
            F.lit(p).alias("priority"), F.lit(label).alias("label"), pieces.alias("pieces"),
            F.lit(pattern).alias("pattern"), F.lit(float(c)).alias("confidence")))
    table = F.array(*[F.struct(F.lit(word).alias("word"), F.array(*rs).alias("rules")) for word, rs in by_word.items()])
    named = F.flatten(F.transform(F.filter(table, lambda g: F.contains(normal, g["word"])), lambda g: g["rules"]))
    gated = F.filter(named, lambda r: F.forall(r["pieces"], lambda x: F.contains(normal, x)))
    found = F.flatten(F.transform(gated, lambda r: F.transform(
        match_spans(normal, r["pattern"]),
        lambda m: F.struct(r["priority"].alias("priority"), (-(m["end"] - m["start"])).alias("neg_size"),
                           m["start"].alias("start"), m["end"].alias("end"), r["label"].alias("label"),
                           r["confidence"].alias("confidence")))))
    ordered = F.array_sort(found)                    # best priority first, longest first inside one
    none = F.expr("cast(array() as array<struct<start:bigint,end:bigint,label:string,confidence:double>>)")

    def keep(acc: Column, m: Column) -> Column:
        inside = F.exists(acc, lambda k: (k["start"] <= m["start"]) & (k["end"] >= m["end"]))
        return F.when(inside, acc).otherwise(F.concat(acc, F.array(
            F.struct(m["start"], m["end"], m["label"], m["confidence"]))))

    return F.array_sort(F.aggregate(ordered, none, keep))


def scan_licenses(docs: DataFrame, rules=None) -> DataFrame:
    """``docs`` plus ``n_words``, ``base`` and ``detections``.

    ``base``: places of the base phrases, array<struct<word,label>>;
    ``detections``: standing matches of the rules, positions in the normalised
    words. Texts that fail the first gate get empty arrays without any
    further work. Input columns named like a new one are replaced by it.
    """
    rules = signature_rules() if rules is None else rules
    text, normal, gate = fresh(docs, "_text", "_normal", "_gate")
    out = docs.select("*", F.coalesce(F.col("text"), F.lit("")).alias(text))
    out = out.withColumn(normal, F.when(F.col(text).rlike(gate_of(rules)), normal_words(F.col(text))))
    pattern = r"(?<= )(?:" + "|".join(PHRASES) + r")(?= )"
    labels = F.create_map(*[F.lit(x) for kv in PHRASES.items() for x in kv])

    def word_at(start: Column) -> Column:            # blanks before it, less the leading one
        head = F.substring(F.col(normal), F.lit(1), start.cast("int"))
        return (F.length(head) - F.length(F.replace(head, F.lit(" "), F.lit(""))) - 1).cast("long")

    base = F.transform(match_spans(F.col(normal), pattern),
                       lambda m: F.struct(word_at(m["start"]).alias("word"), labels[m["hit"]].alias("label")))
    has_phrase = F.col(normal).rlike(pattern)
    none = F.expr("cast(array() as array<struct<word:bigint,label:string>>)")
    nothing = F.expr("cast(array() as array<struct<start:bigint,end:bigint,label:string,confidence:double>>)")
    made = {"n_words": F.regexp_count(F.col(text), F.lit(WORD_ANY_CASE)).cast("long"),
            "base": F.when(has_phrase, base).otherwise(none),
            "detections": F.when(F.col(normal).isNotNull(), _detections(F.col(normal), rules)).otherwise(nothing)}
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made],
                      *[v.alias(k) for k, v in made.items()])
