"""Title normalisation as Column -> Column functions.

Everything here is a built-in Spark expression (JVM side, code-generated). The
``sql_*`` twins emit the same logic as DuckDB text for the oracle queries.
"""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word tokens: letters, digits and underscore in any script (the meaning of \w for str).
WORD_PATTERN = r"[\p{L}\p{N}_]+"

# Lower-case letters that have no ASCII decomposition, with their
# ASCII spelling.
MULTI_LETTER = [("ß", "ss"), ("æ", "ae"), ("œ", "oe"), ("þ", "th"), ("ĳ", "ij")]
SINGLE_LETTER = [("ø", "o"), ("đ", "d"), ("ð", "d"), ("ħ", "h"), ("ı", "i"), ("ł", "l"), ("ŧ", "t"), ("ŋ", "n")]

# Cyrillic and Greek lower-case letters and their Latin spelling.
OTHER_SCRIPTS = [
    ("а", "a"), ("б", "b"), ("в", "v"), ("г", "g"), ("д", "d"), ("е", "e"), ("ж", "zh"), ("з", "z"), ("и", "i"), ("к", "k"),
    ("л", "l"), ("м", "m"), ("н", "n"), ("о", "o"), ("п", "p"), ("р", "r"), ("с", "s"), ("т", "t"), ("у", "u"), ("ф", "f"),
    ("х", "kh"), ("ц", "ts"), ("ч", "ch"), ("ш", "sh"), ("щ", "shch"), ("ы", "y"), ("э", "e"), ("ю", "iu"), ("я", "ia"),
    ("є", "ie"), ("і", "i"), ("ј", "j"), ("љ", "lj"), ("њ", "nj"), ("ћ", "tsh"), ("ђ", "dj"), ("џ", "dzh"), ("ґ", "g"),
    ("α", "a"), ("β", "b"), ("γ", "g"), ("δ", "d"), ("ε", "e"), ("ζ", "z"), ("η", "e"), ("θ", "th"), ("ι", "i"), ("κ", "k"),
    ("λ", "l"), ("μ", "m"), ("ν", "n"), ("ξ", "x"), ("ο", "o"), ("π", "p"), ("ρ", "r"), ("σ", "s"), ("ς", "s"), ("τ", "t"),
    ("υ", "u"), ("φ", "ph"), ("χ", "kh"), ("ψ", "ps"), ("ω", "o"),
]

# Code points whose letters are looked at: Latin with marks, Greek, Cyrillic, further Latin, full-width Latin.
BLOCKS = [(0x00C0, 0x0250), (0x0370, 0x0530), (0x1E00, 0x2000), (0xFF21, 0xFF5B)]

# Fixed value: characters kept by clean_special.
KEEP_CLASS = "[^a-zA-Z0-9 ().\\n]"


def _letters() -> tuple[str, str, list[tuple[str, str]]]:
    """Rule-built tables: a lower-case letter of BLOCKS is spelled as the first character of its
    compatibility decomposition, itself spelled by the fixed lists if it is not ASCII.
    One-letter spellings go into a translation table, longer ones into a list of replacements."""
    fixed = dict(SINGLE_LETTER + MULTI_LETTER + OTHER_SCRIPTS)
    spelled = dict(fixed)
    for first, last in BLOCKS:
        for ch in map(chr, range(first, last)):
            base = unicodedata.normalize("NFKD", ch)[:1]
            if ch.islower() and ch not in fixed and (base in fixed or base.isascii() and base.isalpha()):
                spelled[ch] = fixed.get(base, base.lower())
    one = [(a, b) for a, b in spelled.items() if len(b) == 1]
    return "".join(a for a, _ in one), "".join(b for _, b in one), [(a, b) for a, b in spelled.items() if len(b) > 1]


ACCENT_FROM, ACCENT_TO, LONGER = _letters()


def unaccent(c: Column) -> Column:
    """Spell accented Latin, Cyrillic and Greek letters in ASCII (input already lower-cased)."""
    out = F.translate(c, ACCENT_FROM, ACCENT_TO)
    for a, b in LONGER:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def clean_special(c: Column) -> Column:
    """``&`` -> ``and``, ``a(c)`` -> ``e``, keep ``[a-zA-Z0-9 ().\\n]``, collapse runs of spaces."""
    out = F.replace(c, F.lit("&"), F.lit("and"))
    out = F.replace(out, F.lit("a(c)"), F.lit("e"))
    out = F.regexp_replace(out, KEEP_CLASS, "")
    return F.regexp_replace(out, " +", " ")


def preprocess_title(c: Column) -> Column:
    """Lower -> unaccent -> clean_special."""
    return clean_special(unaccent(F.lower(c)))


def raw_title(c: Column, normalize_all: bool = False) -> Column:
    """C4: cleaned text before the first ``" ("``; titles without one are only lower-cased
    (Q6), or cleaned as well with ``normalize_all``."""
    other = preprocess_title(c) if normalize_all else F.lower(c)
    return F.when(F.instr(c, " (") > 0, preprocess_title(F.substring_index(c, " (", 1))).otherwise(other)


def raw_title_year(c: Column, normalize_all: bool = False) -> Column:
    """Text before the first ``" ("`` plus the last parenthetical (middle ones dropped), cleaned."""
    kept = F.concat(F.substring_index(c, " (", 1), F.lit(" ("), F.substring_index(c, " (", -1))
    other = preprocess_title(c) if normalize_all else F.lower(c)
    return F.when(F.instr(c, " (") > 0, preprocess_title(kept)).otherwise(other)


def parse_date(c: Column, fmt: str = "yyyy-MM-dd") -> Column:
    """C11: date text -> timestamp."""
    return F.to_timestamp(c, fmt)


def clean_year(c: Column) -> Column:
    """Null (or unparseable, e.g. the text ``NULL``) year -> 0, integer."""
    return F.coalesce(c.try_cast("int"), F.lit(0))


def scenario_label(source: Column, init: Column) -> Column:
    """``"<source> to <Init>"``; a missing source is the baseline."""
    return F.coalesce(F.concat(source, F.lit(" to "), F.initcap(init)), F.lit("Baseline"))


def run_key(init: Column, method: Column, limit: Column, split: Column) -> Column:
    """C14: tab-joined configuration key; a null prints as ``None``."""
    return F.concat_ws("\t", *[F.coalesce(x.cast("string"), F.lit("None")) for x in (init, method, limit, split)])


# ---------------------------------------------------------------- DuckDB twins
def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_unaccent(e: str) -> str:
    out = f"translate({e}, {_q(ACCENT_FROM)}, {_q(ACCENT_TO)})"
    for a, b in LONGER:
        out = f"replace({out}, {_q(a)}, {_q(b)})"
    return out


def sql_clean_special(e: str) -> str:
    out = f"replace(replace({e}, '&', 'and'), 'a(c)', 'e')"
    out = f"regexp_replace({out}, '[^a-zA-Z0-9 ().\\n]', '', 'g')"
    return f"regexp_replace({out}, ' +', ' ', 'g')"


def sql_preprocess_title(e: str) -> str:
    return sql_clean_special(sql_unaccent(f"lower({e})"))


def sql_raw_title(e: str) -> str:
    return (f"case when instr({e}, ' (') > 0 then {sql_preprocess_title(f'split_part({e}, {_q(chr(32) + chr(40))}, 1)')} "
            f"else lower({e}) end")


def sql_raw_title_year(e: str) -> str:
    kept = f"(split_part({e}, ' (', 1) || ' (' || string_split({e}, ' (')[-1])"
    return f"case when instr({e}, ' (') > 0 then {sql_preprocess_title(kept)} else lower({e}) end"
