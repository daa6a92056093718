"""Text cleaning and parsing expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthlog.functions.numbers import is_finite

# Spark's trim strips the space only; the feed's own trim strips every character up to U+0020.
_CONTROLS = "".join(chr(code) for code in range(0x21))

# White space among those characters.
_WHITESPACE = "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f "

# Spellings accepted in a text feed of motion states.
_MOTION_TRUE = ("true", "t", "yes", "y", "1", "detected")
_MOTION_FALSE = ("false", "f", "no", "n", "0", "clear")

# Spellings a form field accepts for a boolean.
_FORM_TRUE = ("true", "on", "yes", "1")
_FORM_FALSE = ("false", "off", "no", "0")


def trim_controls(text: Column) -> Column:
    """Strip blanks and control characters (up to U+0020) from both ends."""
    return F.btrim(text, F.lit(_CONTROLS))


def required_text(text: Column) -> Column:
    """The trimmed text, or NULL when nothing is left."""
    return F.nullif(trim_controls(text), F.lit(""))


def normalized_email(text: Column) -> Column:
    """Trimmed and lower-cased address, or NULL when blank."""
    return F.lower(required_text(text))


def form_field(body: Column, name: Column) -> Column:
    """First occurrence of one field of a form-encoded body, decoded.

    A missing field gives an empty string, a malformed escape gives NULL. Plain substring functions
    do it: ``str_to_map`` fails the whole job on one repeated field, and a pattern per field is
    several times slower.
    """
    fields = F.concat(F.lit("&"), body)
    marker = F.concat(F.lit("&"), name, F.lit("="))
    found = F.call_function("locate", marker, fields)
    rest = F.substr(fields, found + F.length(marker))
    raw = F.when(found > 0, F.substring_index(rest, "&", 1)).when(found == 0, F.lit(""))
    return F.try_url_decode(raw)


def _word(text: Column, true_words: tuple[str, ...], false_words: tuple[str, ...]) -> Column:
    meanings = {**{word: True for word in true_words}, **{word: False for word in false_words}}
    table = F.create_map(*[F.lit(item) for pair in meanings.items() for item in pair])
    return F.try_element_at(table, F.lower(trim_controls(text)))


def form_boolean(text: Column) -> Column:
    """Boolean of a form field; any other spelling is NULL."""
    return _word(text, _FORM_TRUE, _FORM_FALSE)


def form_double(text: Column) -> Column:
    """Double of a form field; unparsable text is NULL, NaN and infinities pass through.

    The form binder drops white space anywhere in a number, so ``1 5`` reads as 15.
    """
    return trim_controls(F.translate(text, _WHITESPACE, "")).try_cast("double")


def lenient_boolean(text: Column) -> Column:
    """Motion state written by hand (true/yes/1/detected ...), else NULL."""
    return _word(text, _MOTION_TRUE, _MOTION_FALSE)


def lenient_double(text: Column) -> Column:
    """Number written with a decimal point or comma; NULL unless finite."""
    value = trim_controls(F.replace(text, F.lit(","), F.lit("."))).try_cast("double")
    return F.when(is_finite(value), value)


def token_hash(token: Column) -> Column:
    """Lower-case SHA-256 hex of the trimmed device token."""
    return F.sha2(trim_controls(token), 256)


def template_pieces(template: Column) -> Column:
    """A template cut into literal runs and placeholders ``{0}``, ``{1}`` ...

    Each piece is (text, slot); ``slot`` is NULL for a literal run.
    """
    pieces = F.regexp_extract_all(template, F.lit(r"(\{[0-9]+\}|[^{]+|\{)"), F.lit(1))
    return F.transform(
        pieces,
        lambda piece: F.struct(
            piece.alias("text"),
            F.regexp_extract(piece, r"^\{([0-9]+)\}$", 1).try_cast("int").alias("slot"),
        ),
    )


def fill_pieces(pieces: Column, *arguments: Column) -> Column:
    """Put the arguments into a cut template.

    Every placeholder is replaced once, so braces inside an argument (a sensor named ``{1}``) are
    left alone.
    """
    # The outer transform over one element binds the arguments once; named directly in the inner
    # function they would be computed again for every piece.
    filled = F.transform(
        F.array(F.array(*arguments)),
        lambda values: F.array_join(
            F.transform(
                pieces,
                lambda piece: F.when(piece["slot"].isNull(), piece["text"]).otherwise(
                    F.try_element_at(values, piece["slot"] + 1)
                ),
            ),
            "",
        ),
    )
    return F.element_at(filled, 1)


def fill_template(template: Column, *arguments: Column) -> Column:
    """Replace the placeholders of a template in one pass."""
    return fill_pieces(template_pieces(template), *arguments)
