"""Text functions as columns; none leaves the JVM."""

from __future__ import annotations

import functools
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType

# Patterns of personal data, upper or lower case, any white space.
EMAIL = r"(?U)\S@\S+\.\w"
LINK = r"(?i)https?://|www\."
PHONE = r"(?U)\+?\d[\d\s().-]{7,}\d"


@functools.cache
def base_letters() -> tuple[str, str]:
    """Small letters that decompose to one letter and marks, and those letters; the n with tilde is a letter of its own.

    Made from the character database, so no letter is forgotten. Syllables that decompose to several letters stay.
    """
    bare = lambda c: "".join(x for x in unicodedata.normalize("NFD", c) if unicodedata.category(x) != "Mn")
    every = (chr(i) for i in range(0x80, 0x30000) if not 0xD800 <= i < 0xE000)
    pairs = [(c, base) for c in every if c != "ñ" and c == c.lower() and len(base := bare(c)) == 1 and base != c]
    return "".join(c for c, _ in pairs), "".join(base for _, base in pairs)


def fold(c: Column) -> Column:
    """Lower case without accents, whether they are part of a letter or marks behind it."""
    return F.translate(F.regexp_replace(F.lower(c), r"\p{Mn}", ""), *base_letters())


def squeeze(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"(?U)[\s\x1c-\x1f]+", " "))


def normalize_text(c: Column) -> Column:
    """Lower case without accents, punctuation as spaces, white space squeezed."""
    return squeeze(F.regexp_replace(fold(c), r"[^\p{L}\p{N}_]", " "))


def word_count(c: Column) -> Column:
    s = squeeze(c)
    return F.when(s == "", 0).otherwise(F.size(F.split(s, " "))).cast("long")


def has_phone(c: Column, digits: int = 9) -> Column:
    return F.exists(F.regexp_extract_all(c, F.lit(PHONE), F.lit(0)), lambda m: F.length(F.regexp_replace(m, r"(?U)\D", "")) >= digits)


def personal_reason(c: Column) -> Column:
    """email, link or phone, the first that a text holds, or null."""
    return F.when(c.rlike(EMAIL), "email").when(c.rlike(LINK), "link").when(has_phone(c), "phone")


def drop_reason(max_words: int, *texts: Column) -> Column:
    """The first reason in order, or null: any text empty, any too long, then each text's own in turn: email, link, phone."""
    clean = [squeeze(F.coalesce(c, F.lit(""))) for c in texts]
    any_of = lambda test: functools.reduce(lambda a, b: a | b, map(test, clean))
    return F.coalesce(F.when(any_of(lambda c: c == ""), "empty"), F.when(any_of(lambda c: F.size(F.split(c, " ")) > max_words), "too_long"), *map(personal_reason, clean))


def ascii_fold(c: Column) -> Column:
    """``fold`` with the tilde of n gone too."""
    return F.translate(fold(c), "ñ", "n")


def hash_id(prefix: str, *parts: Column) -> Column:
    """The prefix and twelve hex digits of the parts' hash; a null part is a mark of its own, not left out."""
    told = [F.coalesce(p.cast("string"), F.lit("\ufffe")) for p in parts]
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("\u0000", *told), 256), 1, 12))


def read_back(digits: Column) -> Column:
    """Digits in pairs."""
    return F.trim(F.regexp_replace(digits, "(..)", "$1 "))


def read_back_email(c: Column) -> Column:
    """An address with its signs as words."""
    # The signs and their names.
    for sign, name in (("@", " arroba "), (".", " punto "), ("_", " guion bajo "), ("-", " guion ")):
        c = F.replace(c, F.lit(sign), F.lit(name))
    return squeeze(c)


# The fields that hold what a person said.
PERSONAL = ("text", "normalized_value", "raw_span")


def redact(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit("[redacted]"))


def redact_nested(c: Column, kind: DataType, names: tuple[str, ...] = PERSONAL) -> Column:
    """A column of type ``kind`` with personal fields hidden at any depth; nulls stay null."""
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: redact_nested(x, kind.elementType, names))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda k, v: F.when(k.isin(*names), redact(v)).otherwise(redact_nested(v, kind.valueType, names)) if isinstance(kind.valueType, StringType) else redact_nested(v, kind.valueType, names))
    if isinstance(kind, StructType):
        each = [(redact(c[f.name]) if f.name in names else redact_nested(c[f.name], f.dataType, names)).alias(f.name) for f in kind.fields]
        return F.when(c.isNotNull(), F.struct(*each))
    return c


def dotted(schema: StructType, prefix: str = "") -> list[Column]:
    """Every leaf of nested structs as a column with its path as a dotted name."""
    out = []
    for f in schema.fields:
        path = f"{prefix}.{f.name}" if prefix else f.name
        out += dotted(f.dataType, path) if isinstance(f.dataType, StructType) else [F.col(".".join(f"`{p}`" for p in path.split("."))).alias(path)]
    return out


def canonical(field: Column, value: Column) -> Column:
    """The value to write for a field, or null if it is not well formed."""
    phone = F.when(value.rlike(r"^\+52[2-9][0-9]{9}\z"), value)
    address = F.lower(F.trim(value))
    email = F.when(address.rlike(r"^[a-z0-9_%+-]+(\.[a-z0-9_%+-]+)*@([a-z0-9-]+\.)+[a-z]{2,}\z"), address)
    return F.when(field == "phone", phone).when(field == "email", email).when(field == "name", normalize_name(value))


def key_terms(field: Column, name: Column, email: Column) -> Column:
    """Stored words that help to hear a field: a name's words, the first part of an address's host."""
    none = F.array().cast("array<string>")
    words = F.filter(F.split(squeeze(F.coalesce(name, F.lit(""))), " "), lambda w: w != "")
    host = F.regexp_extract(F.coalesce(email, F.lit("")), "@([^@.]*)", 1)
    return F.when(field == "name", F.array_distinct(words)).when((field == "email") & F.contains(F.coalesce(email, F.lit("")), F.lit("@")), F.array(host)).otherwise(none)


def slice_span(c: Column, start: Column, stop: Column) -> Column:
    return F.substring(c, (start + 1).cast("int"), (stop - start).cast("int"))


# Small words that a name keeps in lower case.
PARTICLES = ("de", "del", "la", "las", "los", "y", "van", "von", "da", "di")
# Spellings and their sound, in order.
SOUNDS = [
    ("ch", "C"), ("ll", "y"), ("qu", "k"), ("gu(?=[ei])", "G"), ("c(?=[ei])", "s"), ("c", "k"), ("z", "s"), ("g(?=[ei])", "j"), ("\\bx", "j"), ("x", "ks"),
    ("h", ""), ("v", "b"), ("w", "u"), ("y(?![aeiou])", "i"), (r"(\p{L})\1+", "$1"), ("C", "ch"), ("G", "g"),
]


def normalize_name(c: Column) -> Column:
    """Capitals at the start of words and after marks, particles small unless first; null if it is no name."""
    title = lambda w: F.replace(F.initcap(F.regexp_replace(w, "(['.-])", "$1\u0001 ")), F.lit("\u0001 "), F.lit(""))
    words = F.split(squeeze(F.lower(c)), " ")
    named = F.array_join(F.transform(words, lambda w, i: F.when((i > 0) & w.isin(*PARTICLES), w).otherwise(title(w))), " ")
    return F.when((squeeze(c) != "") & ~c.rlike(r"[\p{N}_]|[^\p{L}\p{M}\s'.-]"), named)


def name_key(c: Column) -> Column:
    """A key that Spanish spellings of one sound share."""
    k = squeeze(F.regexp_replace(fold(c), "[^a-zñ]", " "))
    for pattern, sound in SOUNDS:
        k = F.regexp_replace(k, pattern, sound)
    return k


def hash_fraction(seed: str, group: Column) -> Column:
    """The first eight hex digits of sha256(seed:group) over the largest such number."""
    head = F.substring(F.sha2(F.concat(F.lit(seed + ":"), group.cast("string")), 256), 1, 8)
    return F.conv(head, 16, 10).cast("double") / F.lit(4294967295.0)
