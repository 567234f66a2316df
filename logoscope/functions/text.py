"""Column functions over texts, language tags and voices; all native expressions, usable in batch and in streams."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logoscope.functions import tables as T
from logoscope.functions.chars import SPACE, SPACES, char_class, invisible_class, unpronounceable_class

#: Tokens that look like paths, flags, assignments, dotted names, identifiers, numbers or shell operators (fixed value).
NOISE = r"^(?:[/~]|--?\w|\w+[=:]\S|\w+\.\w+\.\w+|\w+[_]\w+|\d[\d.]*|[<>|&;$(){}\[\]])"
#: Punctuation that a word sheds at its ends, and characters that no natural word holds (fixed values).
EDGES, TECHNICAL = r"[.,;:!?\x22'()\[\]{}]", r"[/\\|<>{}$]"
#: Longest word in capitals that counts as an abbreviation; words between which a text may be of mixed language.
SHORT_CAPITALS, MIXED_LEAST, MIXED_MOST = 4, 8, 600
#: Where a sentence ends (fixed value), and words of a chunk at most.
SENTENCE_END, CHUNK_WORDS = rf"(?<=[.!?])[{SPACE}]+|\n+", 40
#: Words above which a text of mixed language is searched chunk by chunk (fixed value).
WHOLE_WORDS = 30


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACES))


def is_blank(c: Column) -> Column:
    """Null, empty, or white space alone."""
    return F.coalesce(~c.rlike(f"[^{SPACE}]"), F.lit(True))


def words(c: Column) -> Column:
    """What white space separates."""
    return F.filter(F.split(c, f"[{SPACE}]+"), lambda w: w != "")


def lang_code(tag: Column) -> Column:
    """The primary subtag of a language tag or locale, in lower case; null for none."""
    return F.nullif(F.lower(F.regexp_extract(trimmed(tag), r"^[^-_.@]*", 0)), F.lit(""))


def dialect(tag: Column) -> Column:
    """What follows a tag's first hyphen, or else its first underscore; else empty. Case is kept."""
    return F.when(tag.contains("-"), F.regexp_extract(tag, r"(?s)^[^-]*-(.*)$", 1)).otherwise(F.regexp_extract(tag, r"(?s)^[^_]*_(.*)$", 1))


def second_subtag(tag: Column) -> Column:
    return F.coalesce(F.get(F.split(F.translate(tag, "_", "-"), "-"), F.lit(1)), F.lit(""))


def clean_letters(c: Column) -> Column:
    """Letters and separators only."""
    return F.regexp_replace(c, r"[^\p{L}\p{Z}]", "")


def is_noise(word: Column) -> Column:
    return word.rlike(NOISE)


def natural_words(c: Column) -> Column:
    """Words without technical noise and short abbreviations, shorn of punctuation."""
    shorn = F.transform(words(c), lambda w: F.regexp_replace(w, f"^{EDGES}+|{EDGES}+$", ""))
    capitals = lambda w: (F.upper(w) == w) & (F.lower(w) != w) & (F.length(w) <= SHORT_CAPITALS)
    return F.filter(shorn, lambda w: (w != "") & ~is_noise(w) & ~capitals(w) & ~w.rlike(TECHNICAL))


def is_invisible(c: Column) -> Column:
    return c.rlike(f"^{invisible_class()}$")


def is_pronounceable(c: Column) -> Column:
    """Of a single character: whether speech engines read it by themselves."""
    return ~c.rlike(f"^{unpronounceable_class()}$")


#: The characters read aloud, as a class of few ranges: their runs are cut before the large class is held against the rest.
USUAL = char_class(T.READ_ALOUD)


def needs_expansion(c: Column) -> Column:
    return F.regexp_replace(c, f"{USUAL}+", "").rlike(unpronounceable_class())


def mixed_eligible(c: Column, languages: Column, most: int = MIXED_MOST) -> Column:
    """Whether a text is worth a search for several languages: long, not too long, and two languages are usable."""
    return F.size(words(c)).between(MIXED_LEAST, max(MIXED_LEAST, most)) & (languages >= 2)


def sentence_chunks(c: Column) -> Column:
    """Sentences; those of more than CHUNK_WORDS words as groups of that many."""

    def cut(sentence):
        w = words(sentence)
        groups = F.sequence(F.lit(0), F.floor((F.size(w) - 1) / CHUNK_WORDS).cast("int"))
        long = F.transform(groups, lambda g: F.array_join(F.slice(w, g * CHUNK_WORDS + 1, F.lit(CHUNK_WORDS)), " "))
        return F.when(F.size(w) > CHUNK_WORDS, long).otherwise(F.array(sentence))

    return F.flatten(F.transform(F.split(c, SENTENCE_END), cut))


def text_table(path: Column) -> Column:
    """Language code of a braille contraction table's path; null for tables without a spoken language."""
    stem = F.regexp_replace(F.substring_index(path, "/", -1), r"(?<=.)\.[^.]*$", "")
    return F.when(~(stem.contains("IPA") | stem.startswith("unicode-braille")), F.substring_index(stem, "-", 1))


def voice_overlay(key: Column, text: Column, base: dict[str, Column], uppercase: dict[str, Column], other: dict[str, Column]) -> dict[str, Column]:
    """Rate, pitch and gain of a voice once its kind's own settings are laid over it; the family stays.

    The default kind (null or ``default``) takes the settings for capitals if the text is letters in upper case alone."""
    plain = F.coalesce(key, F.lit("default")) == "default"
    capitals = plain & (F.upper(text) == text) & (F.lower(text) != text) & trimmed(text).rlike(r"^\p{L}+$")
    over = lambda f: F.when(capitals | (key == "uppercase"), uppercase[f]).when(~plain, other[f])
    return {f: F.coalesce(over(f), base[f]) for f in base}


def named(code: Column, names: dict[str, str]) -> Column:
    """A label, or the code itself."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.coalesce(table[code], code)
