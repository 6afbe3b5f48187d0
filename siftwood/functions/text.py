"""Text cleaning and analysis as Column expressions; everything stays in the JVM.

Patterns avoid backreferences and the shorthand classes whose Unicode meaning
differs between regex engines, and repeat no group that can match in several
lengths: Java recurses once per such repeat, and long runs would end the stack.
"""

from __future__ import annotations

from functools import reduce
from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------

# Function words per language. Japanese has particles and auxiliaries.
STOPWORDS = {
    "en": "a an and are as at be by for from has he in is it its of on or she that the this to was were will with".split(),
    "fr": "au aux avec ce dans de des du elle en est et il la le les mais ou par pas pour que qui sur un une".split(),
    "de": "als am an auf auch aus bei das dem den der des die ein eine er es ich im in ist mit nicht sie und von zu".split(),
    "es": "a al como con de del el en es la las lo los no o para por que se su un una y".split(),
    "ja": "は が を に へ と で の も や から まで より です ます た だ".split(),
}

# Accented Latin letters and their base letters, position by position.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
UNACCENTED = "aaaaaaceeeeiiiinooooouuuuyy"

# Full-width ASCII block (U+FF01 to U+FF5E) and the ASCII it stands for.
FULL_WIDTH = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF_WIDTH = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F))

# The named entities of HTML 4, from Python's table, and the apostrophe; a
# no-break space is a blank.
ENTITIES = {name: chr(code) for name, code in name2codepoint.items()} | {"apos": "'", "nbsp": " "}
ENTITY = "&(#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);"

# A letter or digit of a script written without spaces. The range comes first:
# it settles Latin letters without a script lookup.
CJK = r"[[\x{2E80}-\x{10FFFF}]&&[\p{IsHan}\p{IsHiragana}\p{IsKatakana}ー]&&[\p{L}\p{N}]]"

# Markdown rules as (pattern, replacement), applied in order. Block rules see
# whole lines outside fences; inline rules see prose outside code spans.
MARKDOWN_BLOCK_RULES = [
    (r"^#{1,6}[ \t]*([^\n]*?)[ \t]*#*[ \t]*$", "$1"),  # headings
    (r"^(=+|-+)[ \t]*$", ""),  # underlined headings
    (r"^[ \t]*[-*_][ \t]*[-*_][ \t]*[-*_][-*_ \t]*$", ""),  # horizontal rules
    (r"^[ \t]*>(?:[> ]*>)? ?", ""),  # quotes
    (r"^[ \t]*([*+-]|[0-9]+\.)[ \t]+", ""),  # list markers
    (r"^[ \t]*\|[ \t:|-]+\|[ \t]*$", ""),  # table rulers
    (r"!\[[^\[\]]*\]\([^()\n]*\)", ""),  # images have no text
    (r"\[([^\[\]]*)\]\([^()\n]*\)", "$1"),  # links
    (r"<(https?://[^ <>\n]+)>", "$1"),  # bare links
]
MARKDOWN_INLINE_RULES = [
    (r"\*\*([^ \t\n*][^*\n]*)\*\*", "$1"),
    (r"(^|[^\p{L}\p{N}_])__([^ \t\n_][^_\n]*)__", "$1$2"),
    (r"\*([^ \t\n*][^*\n]*)\*", "$1"),
    (r"(^|[^\p{L}\p{N}_])_([^ \t\n_][^_\n]*)_", "$1$2"),
    (r"</?[A-Za-z][^<>]*>", ""),  # raw tags
]
FENCE = r"^(?:```|~~~)[^\n]*\n?"
TABLE_LINE = r"^[ \t]*\|.*\|[ \t]*$"

# HTML rules. Inline tags vanish, all other tags separate words.
HTML_RULES = [
    (r"(?s)<!--.*?-->", " "),
    (r"(?is)<script[^>]*>.*?</script[^>]*>", " "),
    (r"(?is)<style[^>]*>.*?</style[^>]*>", " "),
    (r"(?i)</?(a|b|i|u|s|em|strong|span|small|sub|sup|mark|code)( [^>]*)?>", ""),
    (r"<[^>]*>", " "),
]

# --- cleaning ---------------------------------------------------------------


def _apply(col: Column, rules, flags: str = "") -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, flags + r[0], r[1]), rules, col)


def _entity(name: Column) -> Column:
    """The character of an entity's name or number; what stands for none stays as it is."""
    named = F.create_map(*[F.lit(x) for pair in ENTITIES.items() for x in pair])
    digits = F.regexp_replace(name, "^#[xX]?0*", "")
    # Eight digits hold every code point; longer ones stand for none.
    digits = F.when(F.length(digits).between(1, 8), digits)
    is_hex = F.lower(F.substring(name, 2, 1)) == "x"
    code = F.when(is_hex, F.conv(digits, 16, 10)).otherwise(digits).cast("bigint")
    real = code.between(1, 0xD7FF) | code.between(0xE000, 0x10FFFF)
    numeric = F.decode(F.unhex(F.lpad(F.hex(F.when(real, code)), 8, "0")), "UTF-32")
    numeric = F.when(code == 0xA0, " ").otherwise(numeric)
    char = F.when(F.startswith(name, F.lit("#")), numeric).otherwise(F.try_element_at(named, name))
    return F.coalesce(char, F.concat(F.lit("&"), name, F.lit(";")))


def decode_entities(col: Column) -> Column:
    """Text with entities, by name or by number in either base, decoded once."""
    names = F.regexp_extract_all(col, F.lit(ENTITY), F.lit(1))
    parts = F.zip_with(F.split(col, ENTITY), names, lambda gap, name: F.concat(gap, F.when(name.isNull(), "").otherwise(_entity(name))))
    return F.when(col.rlike(ENTITY), F.array_join(parts, "")).otherwise(col)


def html_text(col: Column) -> Column:
    """Visible text of a markup column, whitespace squeezed."""
    text = decode_entities(_apply(col, HTML_RULES))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f]+", " "))


def _inline_markdown(text: Column) -> Column:
    # Odd pieces between backtick runs are code and stay as written.
    pieces = F.split(text, "`+")
    prose = lambda p: decode_entities(_apply(p, MARKDOWN_INLINE_RULES))
    return F.array_join(
        F.transform(pieces, lambda p, i: F.when(i % 2 == 0, prose(p)).otherwise(p)), ""
    )


def _block_markdown(text: Column) -> Column:
    # d: only \n ends a line; m: anchors work per line.
    text = _apply(text, MARKDOWN_BLOCK_RULES, "(?dm)")
    cells = F.transform(
        F.split(text, "\n"),
        lambda s: F.when(s.rlike(TABLE_LINE), F.trim(F.regexp_replace(s, r"[ \t]*\|[ \t]*", " "))).otherwise(s),
    )
    return _inline_markdown(F.when(text.contains("|"), F.array_join(cells, "\n")).otherwise(text))


def markdown_text(col: Column) -> Column:
    """Plain text of a Markdown column. Odd pieces between fences are code."""
    pieces = F.split(col, "(?dm)" + FENCE)
    plain = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, _block_markdown(p)).otherwise(p))
    text = F.array_join(plain, "")
    return F.trim(F.regexp_replace(text, r"\n[ \t\n]*\n[ \t]*", "\n"), F.lit(" \t\n"))


# --- analysis ---------------------------------------------------------------


def tokenize(col: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.array_remove(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), "")


def cjk_bigrams(col: Column) -> Column:
    """Terms of text that may be unspaced: runs of Han and Kana become
    overlapping pairs, a lone letter stays, all else is split as usual."""
    # One pass writes each letter and its successor as a separate word; the
    # last letter of a run is part of the pair before it.
    pairs = F.regexp_replace(col, f"({CJK})(?=({CJK}))|(?<={CJK}){CJK}|({CJK})", " $1$2$3 ")
    return tokenize(pairs)


def stop_filter(tokens: Column, lang: Column | None = None, stopwords: dict | None = None) -> Column:
    """Drop function words: those of the row's language, or, with no language
    column, those of every language (the form queries and documents share)."""
    stopwords = STOPWORDS if stopwords is None else stopwords
    if lang is None:
        words = sorted({w for ws in stopwords.values() for w in ws})
        return F.filter(tokens, lambda t: ~t.isin(words))
    without = lambda words: F.filter(tokens, lambda t: ~t.isin(words))
    by_lang = None
    for code, words in stopwords.items():
        kept = without(words)
        by_lang = F.when(lang == code, kept) if by_lang is None else by_lang.when(lang == code, kept)
    return tokens if by_lang is None else by_lang.otherwise(tokens)


def base_forms(tokens: Column, lemmas: Column) -> Column:
    """Replace surfaces found in a map column (surface to base)."""
    return F.transform(tokens, lambda t: F.coalesce(F.element_at(lemmas, t), t))


def normalize_terms(tokens: Column) -> Column:
    """Half-width, lower-case, unaccented forms."""
    fold = lambda t: F.translate(F.lower(t), FULL_WIDTH + ACCENTED, HALF_WIDTH + UNACCENTED)
    # ASCII terms, told by one byte per letter, have nothing to fold.
    return F.transform(tokens, lambda t: F.when(F.octet_length(t) > F.length(t), fold(t)).otherwise(F.lower(t)))


def analyze(
    col: Column,
    lang: Column | None = None,
    lemmas: Column | None = None,
    stopwords: dict | None = None,
) -> Column:
    """The full analyzer: tokens, CJK pairs, base forms, stop words, normal forms.

    Documents and queries must go through the same call.
    """
    tokens = F.when(col.rlike(CJK), cjk_bigrams(col)).otherwise(tokenize(col))
    if lemmas is not None:
        tokens = base_forms(tokens, lemmas)
    return normalize_terms(stop_filter(tokens, lang, stopwords))


def doc_text(*cols: Column) -> Column:
    """Encoder input: the given columns joined by a blank, nulls skipped."""
    return F.concat_ws(" ", *cols)
