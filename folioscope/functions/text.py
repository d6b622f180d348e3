"""Text functions as column expressions: all run in the JVM, none is a Python UDF."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _latin() -> tuple[str, str]:
    """Accented Latin letters below U+0250 and the letters under their accents."""
    pairs = [(chr(c), d[0]) for c in range(0xC0, 0x250) if (d := unicodedata.normalize("NFD", chr(c)))[0].isascii() and len(d) > 1]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _latin()
#: Endings that a stem loses, in the order in which they are tried.
SUFFIXES = ["ations", "ation", "ions", "ion", "ants", "ant", "ies", "es", "s"]
#: Ordinals of sessions.
ORDINALS = "first second third fourth fifth sixth seventh eighth ninth tenth eleventh twelfth thirteenth fourteenth fifteenth sixteenth seventeenth eighteenth nineteenth twentieth".split()


def squash(c: Column) -> Column:
    """White space collapsed and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \t\n\r\f]+", " "))


def letters_only(c: Column) -> Column:
    """Letters and digits of any script, in lower case."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{M}", "")


def loose(c: Column) -> Column:
    """Folded letters a-z and digits only."""
    return F.regexp_replace(fold(c), "[^a-z0-9]", "")


def word_set(c: Column) -> Column:
    """Sorted distinct folded words, camel case taken apart."""
    parted = F.regexp_replace(c, r"(\p{Ll})(\p{Lu})", "$1 $2")
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(fold(parted), "[^a-z0-9]+"), lambda x: x != ""))), " ")


def singular(w: Column) -> Column:
    return F.when(w.rlike("ies$"), F.regexp_replace(w, "ies$", "y")).when(w.rlike("(ss|us|is)$"), w).when(w.rlike("s$"), F.regexp_replace(w, "s$", "")).otherwise(w)


def term_key(c: Column) -> Column:
    """Singular words, -isation as -ization, without spaces."""
    words = F.filter(F.split(fold(c), "[^a-z0-9]+"), lambda x: x != "")
    return F.array_join(F.transform(words, lambda w: F.regexp_replace(singular(w), "isation$", "ization")), "")


def definition_key(c: Column) -> Column:
    """Without trailing bracketed groups, letters and digits only."""
    return letters_only(F.regexp_replace(c, r"([ \n]*[(\[][^()\[\]]*[)\]][ .]*)+$", ""))


def stem(c: Column) -> Column:
    """The word without the first ending that leaves at least four letters."""
    out = c
    for s in reversed(SUFFIXES):
        out = F.when(c.endswith(s) & (F.length(c) - len(s) >= 4), F.substring(c, F.lit(1), F.length(c) - len(s))).otherwise(out)
    return out


def at_word_start(text: Column, term: str) -> Column:
    return F.lower(text).rlike(r"(^|[^\p{L}\p{N}_])" + term)


def strip_words(c: Column, words: list[str]) -> Column:
    """Without generic words; the original where less than three letters would stay."""
    left = squash(F.regexp_replace(c, r"(?i)\b(" + "|".join(words) + r")\b", " "))
    return F.when(F.length(left) < 3, c).otherwise(left)


def local_name(uri: Column) -> Column:
    return F.element_at(F.split(F.rtrim(F.trim(uri), F.lit("/")), "/"), -1)


def chapter_key(c: Column) -> Column:
    """The numbers of a chapter name joined by dashes, without leading zeros."""
    return F.array_join(F.transform(F.regexp_extract_all(c, F.lit(r"([0-9]+)"), 1), lambda x: x.cast("bigint").cast("string")), "-")


def sentences(c: Column) -> Column:
    """Split after an end mark that white space and a capital follow."""
    return F.split(c, r"(?<=[.!?])\s+(?=[A-Z])")


def strip_citations(c: Column) -> Column:
    return F.regexp_replace(c, r" ?\([^()]*, (19|20)[0-9][0-9]\)", "")


def dois(c: Column) -> Column:
    """Distinct DOIs in order, without trailing punctuation."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(10\.[0-9]{4,9}/[^ \"<>]+)"), 1), lambda x: F.regexp_replace(x, "[.,;)]+$", "")))


def spell_sessions(c: Column, name: str) -> Column:
    """"NAME-3" as "the third session"; numbers over twenty stay."""
    out = c
    for n in range(len(ORDINALS), 0, -1):
        out = F.regexp_replace(out, rf"(?i)\b{name}[- ]0?{n}\b(?!\.?[0-9])", f"the {ORDINALS[n - 1]} session")
    return out


def split_names(c: Column) -> Column:
    """The people of an author field, whatever separates them."""
    return F.filter(F.transform(F.split(c, r"\s*(?:;| and | & )\s*"), lambda x: F.trim(x)), lambda x: x != "")


def clean_caption(c: Column) -> Column:
    """A caption on one line without its label and number."""
    return F.regexp_replace(squash(c), r"^(?:Table|Figure|Box|Map) [0-9A-Z]+(?:\.[0-9A-Z]+)*[.:]? *", "")


def is_reference_page(c: Column) -> Column:
    years = F.regexp_count(c, F.lit(r"\((19|20)[0-9][0-9][a-z]?\)"))
    links = F.regexp_count(c, F.lit("https?://"))
    entries = F.regexp_count(c, F.lit(r"(?m)^\p{Lu}[^\n]{2,60}, \p{Lu}\."))
    return ((years >= 15) & (links >= 3)) | ((years >= 8) & (entries >= 8))


def fit_cell(c: Column, limit: int) -> Column:
    """Cut to limit with a note of the full length."""
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit - 40), F.lit(" [cut, "), F.length(c).cast("string"), F.lit(" characters]"))).otherwise(c)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(c), "[^a-z0-9]+", "_"), "^_|_$", "")


def text_kind(x: Column, y: Column) -> Column:
    """same; punctuation (equal but for marks, accents and case); different."""
    return F.when(squash(x) == squash(y), "same").when(loose(x) == loose(y), "punctuation").otherwise("different")


def markdown_cell(c: Column) -> Column:
    return F.replace(squash(c), F.lit("|"), F.lit("\\|"))


def html_escape(c: Column) -> Column:
    out = F.replace(c, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


#: Code points of Windows-1252 beyond Latin-1, and the bytes that they stand for.
_BEYOND = [(b, bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]


def repair_encoding(c: Column) -> Column:
    """Undo UTF-8 read as Windows-1252, only where its signature is present."""
    as_bytes = F.translate(c, "".join(x for _, x in _BEYOND if x), "".join(chr(b) for b, x in _BEYOND if x))
    signature = as_bytes.rlike(r"[\x{C3}\x{C2}][\x{80}-\x{BF}]|\x{E2}\x{80}") & ~as_bytes.rlike(r"[^\x{00}-\x{FF}]")
    return F.when(signature, F.decode(F.encode(as_bytes, "iso-8859-1"), "utf-8")).otherwise(c)


def roman(c: Column) -> Column:
    """The value of a Roman numeral in any case, null for other strings."""
    digits = F.filter(F.split(F.lower(c), ""), lambda x: x != "")
    value = F.create_map(*[F.lit(x) for pair in {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}.items() for x in pair])
    values = F.transform(digits, lambda d: value[d])
    total = F.aggregate(F.sequence(F.lit(1), F.size(values)), F.lit(0), lambda s, i: s + F.when(F.coalesce(F.try_element_at(values, i) < F.try_element_at(values, i + 1), F.lit(False)), -F.element_at(values, i)).otherwise(F.element_at(values, i)))
    return F.when(F.lower(c).rlike("^m*(cm|cd|d?c{0,3})(xc|xl|l?x{0,3})(ix|iv|v?i{0,3})$") & (F.length(c) > 0), total)


def orcid_valid(c: Column) -> Column:
    """ISO 7064 MOD 11-2 over sixteen characters, hyphens apart."""
    d = F.upper(F.regexp_replace(c, "-", ""))
    total = F.aggregate(F.sequence(F.lit(1), F.lit(15)), F.lit(0), lambda s, i: F.pmod((s + d.substr(i, F.lit(1)).try_cast("int")) * 2, F.lit(11)))
    check = F.pmod(12 - total, F.lit(11))
    return F.coalesce(d.rlike("^[0-9]{15}[0-9X]$") & (F.substring(d, 16, 1) == F.when(check == 10, "X").otherwise(check.cast("string"))), F.lit(False))
