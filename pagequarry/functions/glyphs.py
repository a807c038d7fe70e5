"""Characters of glyphs and strings: text strings, glyph names, ligatures, confidence, labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The bytes 18 to 1F and 80 to 9E, and A0, of the document encoding of ISO 32000, annex D.
_LOW = "˘ˇˆ˙˝˛˚˜"
_HIGH = "•†‡…—–ƒ⁄‹›−‰„“”‘’‚™ﬁﬂŁŒŠŸŽıłœšž"
_CODES = "".join(map(chr, [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]))

# What a whole glyph text of one ligature sign stands for.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl"}

# How far the source of a mapping is trusted; others 0.5.
CONFIDENCE = {
    "actual_text": 1.0,
    "to_unicode": 1.0,
    "cff_glyph_repair": 0.96,
    "ligature_override": 0.94,
    "glyph_name": 0.92,
    "truetype_cmap": 0.90,
    "truetype_glyph_shape": 0.90,
    "predefined_cmap": 0.94,
    "cid_collection": 0.88,
    "encoding": 0.84,
    "identity": 0.58,
    "undefined": 0.05,
    "fallback_nul": 0.05,
    "replacement": 0.05,
}

# Sources whose text stands for itself, and those that are a likely guess.
AUTHORITATIVE = ["actual_text", "to_unicode", "cff_glyph_repair", "ligature_override", "glyph_name", "truetype_cmap", "truetype_glyph_shape", "predefined_cmap"]
HEURISTIC = ["cid_collection", "encoding"]

UNSUPPORTED = r"[\p{Co}\p{Cn}\x{FFFD}\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]"


def _literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])


def text_string(data: Column) -> Column:
    """A binary text string: UTF-16BE or UTF-8 after their byte order marks, else the
    document encoding; null where a byte has no character there."""
    head = F.hex(F.substring(data, 1, 3))
    after = lambda n: F.substring(data, n, 2**31 - 1)
    single = F.decode(data, "ISO-8859-1")
    plain = F.when(~single.rlike(r"[\x7F\x9F\xAD]"), F.translate(single, _CODES, _LOW + _HIGH + "€"))
    return F.when(F.startswith(head, F.lit("FEFF")), F.decode(after(3), "UTF-16BE")).when(head == "EFBBBF", F.decode(after(4), "UTF-8")).otherwise(plain)


def glyph_text(name: Column, names: dict[str, str]) -> Column:
    """The text of a glyph name: what follows a point is dropped, parts are joined by
    underscores, and each part is a known name, ``uniXXXX`` in groups of four digits or
    ``u`` and four to six digits. Null where a part is none of these."""
    parts = F.split(F.regexp_extract(name, r"^([^.]*)", 1), "_", -1)
    known = _literal_map(names) if names else F.lit(None).cast("map<string,string>")

    def one(p: Column) -> Column:
        short = F.when(p.rlike("^uni([0-9A-F]{4})+$"), F.decode(F.unhex(F.substring(p, 4, 2**31 - 1)), "UTF-16BE"))
        code = F.lpad(F.regexp_extract(p, "^u([0-9A-F]{4,6})$", 1), 8, "0")
        return F.coalesce(F.try_element_at(known, p), short, F.when(p.rlike("^u(10|0?[0-9A-F])?[0-9A-F]{4}$"), F.decode(F.unhex(code), "UTF-32")))

    made = F.transform(parts, one)
    return F.when(~F.exists(made, lambda x: x.isNull()), F.array_join(made, ""))


def ligature(text: Column) -> Column:
    """The letters of a text that is one ligature sign; other texts as they are."""
    return F.coalesce(F.try_element_at(_literal_map(LIGATURES), text), text)


def confidence(text: Column, source: Column, alternates: Column) -> Column:
    """How far the text of a glyph is trusted, by where it comes from: at least 0.68 with a
    supported alternate, at most 0.2 with an unsupported character, 0 without text."""
    base = F.coalesce(F.try_element_at(_literal_map(CONFIDENCE), source), F.lit(0.5))
    usable = F.coalesce(F.exists(alternates, lambda a: (a != "") & ~a.rlike(UNSUPPORTED)), F.lit(False))
    raised = F.when(usable, F.greatest(base, F.lit(0.68))).otherwise(base)
    capped = F.when(text.rlike(UNSUPPORTED), F.least(raised, F.lit(0.2))).otherwise(raised)
    return F.when(F.coalesce(text, F.lit("")) == "", 0.0).otherwise(capped)


def semantics(text: Column, source: Column) -> Column:
    """What the text of a glyph stands for: authoritative, heuristic, unknown-identifier or unsupported."""
    bad = (F.coalesce(text, F.lit("")) == "") | text.rlike(UNSUPPORTED)
    return F.when(bad, "unsupported").when(source.isin(*AUTHORITATIVE), "authoritative").when(source.isin(*HEURISTIC), "heuristic").otherwise("unknown-identifier")


def split_labels(text: Column) -> Column:
    """A space between a number and what is glued to it: before a capital after a digit with
    one of ``./,:`` in the seven places before, before a digit and white space after a unit
    m, g or l, and before a digit after a colon."""
    return F.regexp_replace(text, r"(?s)(?<=[./,:].{0,6}\p{Nd})(?=\p{Lu})|(?<= [mglMGL])(?=\p{Nd}\s)|(?<=:)(?=\p{Nd})", " ")


def formula_like(texts: Column) -> Column:
    """Whether any of the texts holds a sign that marks a formula."""
    return F.exists(texts, lambda t: t.rlike("[∂∑√∞∈θΦω]"))
