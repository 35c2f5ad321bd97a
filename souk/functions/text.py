"""Text rules: e-mail acceptance (Q6) and content screening.

Both are column expressions (``rlike``, ``exists``, ``when``) so they run in
whole-stage codegen on batches and on streams alike; no UDF.

Regex dialect notes (SURVEY F6): Java's ``\\b`` treats Cyrillic letters as word
characters while the rules' original engine does not, so word edges are
written as ASCII look-arounds. ``(?iu)`` makes case folding Unicode-aware.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ----------------------------------------------------------------------------- Q6
# E-mail domains accepted (exact or as a parent domain).
ALLOWED_EMAIL_DOMAINS = (
    "gmail.com", "googlemail.com",
    "mail.ru", "bk.ru", "inbox.ru", "list.ru",
    "yandex.ru", "yandex.com", "ya.ru",
    "icloud.com", "me.com", "mac.com",
    "outlook.com", "hotmail.com", "live.com", "msn.com",
    "yahoo.com", "yahoo.ru",
    "proton.me", "protonmail.com",
    "rambler.ru", "rambler.com",
    "vk.com", "internet.ru", "corp.mail.ru",
    "tut.by", "mail.com", "email.com",
)
# Shape of an acceptable address (after trim + lower-case).
EMAIL_SHAPE = r"^[a-z0-9._%+\-]+@[a-z0-9.\-]+\.[a-z]{2,}$"


# What ``(?U)\s`` matches: the white space of Unicode.
WHITE_SPACE = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def js_trim(col: Column) -> Column:
    """Trim all (Unicode) white space at both ends, as a browser's ``trim`` does.
    Only the ends are looked at, whatever the length of the text."""
    return F.trim(col, F.lit(WHITE_SPACE))


def normalized_email(col: str | Column = "email") -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.lower(js_trim(c))


def email_ok(col: str | Column = "email") -> Column:
    """True when the address passes the shape, digit-domain and domain-list rules."""
    e = normalized_email(col)
    # ``\z``: Java's ``$`` would also accept a trailing line break
    shape = e.rlike(EMAIL_SHAPE[:-1] + r"\z")
    domain = F.substring_index(e, "@", -1)
    main_part = F.regexp_replace(domain, r"\.[^.]*\z", "")
    all_digits = main_part.rlike(r"^[0-9]+\z")
    allowed = F.exists(F.array(*[F.lit(d) for d in ALLOWED_EMAIL_DOMAINS]),
                       lambda d: (domain == d) | domain.endswith(F.concat(F.lit("."), d)))
    return F.coalesce(shape & ~all_digits & allowed, F.lit(False))


def validate_emails(users: DataFrame) -> DataFrame:
    """Q6 over a user table: ``id, email, email_ok``."""
    return users.select("id", "email", email_ok("email").alias("email_ok"))


# ----------------------------------------------------------------------------- Q7
# Maximum length per text field.
FIELD_LIMITS = {
    "title": 200,
    "description": 5000,
    "requirements": 2000,
    "message": 2000,
    "bio": 500,
    "specialization": 80,
    "comment": 1000,
}
# Stop words (whole words, any case).
STOP_WORDS = ("casino", "poker", "xxx", "porn", "viagra", "crypto", "nft", "airdrop", "pump")

# Screening rules in the order they are tested; the first one that fires is the reason.
# JavaScript's ``.`` (no line terminators) and ``\s`` (Unicode spaces), spelled out so
# the rule means the same in every regex engine that runs it.
JS_NOT_LINE_END = r"[^\n\r\u2028\u2029]"
JS_NOT_SPACE = r"[^\t\n\u000B\f\r \u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000\uFEFF]"
RULE_REPEAT = r"(?iu)(" + JS_NOT_LINE_END + r")\1{6,}"  # a character 7+ times in a row
RULE_LINK = r"(?i)https?://" + JS_NOT_SPACE + r"{3,}"   # a link
RULE_STOP = r"(?i)(?<![A-Za-z0-9_])(" + "|".join(STOP_WORDS) + r")(?![A-Za-z0-9_])"
RULE_NON_ASCII = r"[^\x00-\x7F]{50,}"                 # 50+ non-ASCII characters in a row


def field_limit(field: Column) -> Column:
    m = F.create_map(*[x for k, v in FIELD_LIMITS.items() for x in (F.lit(k), F.lit(v))])
    return F.element_at(m, field)


def screen_reason(text: Column, field: Column) -> Column:
    """Why ``text`` is refused for ``field`` (null when accepted or empty)."""
    limit = field_limit(field)
    return (F.when(text.isNull() | (F.length(text) == 0), F.lit(None).cast("string"))
            .when(limit.isNotNull() & (F.length(text) > limit), "too_long")
            .when(text.rlike(RULE_REPEAT), "repeat")
            .when(text.rlike(RULE_LINK), "link")
            .when(text.rlike(RULE_STOP), "stop_word")
            .when(text.rlike(RULE_NON_ASCII), "non_ascii"))


def screen_text(df: DataFrame, text_col: str, field: str | Column) -> DataFrame:
    """Add ``reason``: the first failing screening rule, or null.

    ``field`` is either a field name (the same limit for every row) or a
    column naming the field per row. Works unchanged on streaming frames.
    """
    fcol = F.col(field) if isinstance(field, str) and field in df.columns else (
        field if isinstance(field, Column) else F.lit(field))
    return df.withColumn("reason", screen_reason(F.col(text_col), fcol))
