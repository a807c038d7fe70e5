"""Text predicates and measures as Column expressions (ASCII rules unless said)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BULLETS = "•‣◦▪●–"


def tokens(text: Column) -> Column:
    """Runs of anything but white space."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_key(text: Column) -> Column:
    """Lower case with white space collapsed."""
    return collapse(F.lower(text))


def compact(text: Column) -> Column:
    """Letters and digits only, in lower case."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def content_tokens(text: Column) -> Column:
    """Words, and every other sign that is not white space by itself."""
    return F.regexp_extract_all(text, F.lit(r"([A-Za-z0-9_]+|[^A-Za-z0-9_\s])"), F.lit(1))


def count_of(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(pattern)), F.lit(0))


def quality(text: Column) -> dict[str, Column]:
    """Counts behind the noise score: tokens, wordlike ones (three letters or more, a
    vowel among them), short ones, ones with a digit, symbols, non-ASCII and visible characters."""
    t = tokens(text)
    size = lambda p: F.size(F.filter(t, p)).cast("long")
    return {
        "n_tokens": F.size(t).cast("long"),
        "wordlike": size(lambda x: x.rlike("^[A-Za-z]{3,}$") & x.rlike("[AEIOUaeiou]")),
        "short": size(lambda x: F.char_length(x) <= 2),
        "digit": size(lambda x: x.rlike("[0-9]")),
        "symbols": count_of(text, r"[!-/:-@\[-`{-~]").cast("long"),
        "non_ascii": count_of(text, r"[^\x00-\x7F]").cast("long"),
        "visible": count_of(text, r"[^\x00-\x20]").cast("long"),
    }


def noise(short: Column, symbol: Column, non_ascii: Column, digit: Column, wordlike: Column) -> Column:
    """Weighted shares, clamped to 0..1."""
    raw = 0.35 * short + 0.30 * symbol + 0.20 * non_ascii + 0.15 * digit - 0.25 * wordlike
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))


def suspicious(text: Column) -> Column:
    """Replacement, private-use and control characters."""
    return count_of(text, r"[\x{FFFD}\x{E000}-\x{F8FF}\x00-\x08\x0E-\x1F\x7F]")


def repeated_character(text: Column) -> Column:
    return (F.char_length(text) > 1) & (F.replace(text, F.substring(text, 1, 1), F.lit("")) == "")


def numeric_cell(text: Column) -> Column:
    """A digit, and digits at least half of letters and digits."""
    digits, alnum = count_of(text, "[0-9]"), count_of(text, "[A-Za-z0-9]")
    return (digits >= 1) & (digits * 2 >= F.greatest(F.lit(1), alnum))


def character_spaced(text: Column) -> Column:
    """Four or more alphabetic tokens, half of them single letters."""
    words = F.filter(tokens(text), lambda x: x.rlike("^[A-Za-z]+$"))
    single = F.filter(words, lambda x: F.char_length(x) == 1)
    return (F.size(words) >= 4) & (F.size(single) * 2 >= F.size(words))


def list_kind(line: Column) -> Column:
    """numbered: up to nine digits with a point or parenthesis before space or end;
    bullet: a bullet sign or hyphen or asterisk before space or end."""
    return F.when(line.rlike(r"^\s*[0-9]{1,9}[.)](\s|$)"), "numbered").when(line.rlike(rf"^\s*[-*{BULLETS}](\s|$)"), "bullet")


def element_class(line: Column, centre: Column | None = None) -> Column:
    """Class of a line by place on the page (0..1 from the top), then by its text."""
    alpha, visible = count_of(line, "[A-Za-z]"), count_of(line, r"\S")
    words = F.size(tokens(line))
    rule = F.when(visible == 0, "Empty")
    if centre is not None:
        rule = rule.when(centre < 0.07, "Header").when(centre > 0.93, "Footer")
    rule = rule.when(list_kind(line).isNotNull(), "ListItem").when(line.rlike(r"^\s*[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\s*$"), "EmailAddress")
    rule = rule.when(alpha * 2 < visible, "Text").when((words <= 12) & line.rlike(r"^\s*[A-Z]") & ~line.rlike(r"[.!?,;:]\s*$"), "Title")
    return rule.when((words >= 5) & line.rlike(r"[.!?]\s*$"), "NarrativeText").otherwise("Text")


def contains_run(whole: Column, part: Column) -> Column:
    """Whether an array holds another as a contiguous run; never for an empty one."""
    n, k = F.size(whole), F.size(part)
    last = F.greatest(n - k + 1, F.lit(1))
    return (k > 0) & (n >= k) & F.exists(F.sequence(F.lit(1), last), lambda i: F.slice(whole, i, k) == part)


def one_substitution(a: Column, b: Column) -> Column:
    signs = lambda x: F.split(x, "")
    differ = F.size(F.filter(F.zip_with(signs(a), signs(b), lambda x, y: x != y), lambda d: d))
    return (F.char_length(a) == F.char_length(b)) & (differ == 1)


def edit_distance(a: Column, b: Column, limit: int) -> Column:
    """Levenshtein distance, limit + 1 beyond the limit."""
    d = F.levenshtein(a, b, limit)
    return F.when(d < 0, limit + 1).otherwise(d)


def date_only(text: Column) -> Column:
    """Nothing but numeric dates and separators between them."""
    rest = F.regexp_replace(text, r"\b[0-9]{1,4}[-/.][0-9]{1,2}[-/.][0-9]{1,4}\b", "")
    return (F.char_length(F.trim(text)) > 0) & (F.regexp_replace(rest, r"[\s,;]", "") == "")


def strip_private(text: Column) -> Column:
    """Without private-use and control characters; runs of four or more dots or dashes become three."""
    out = F.regexp_replace(text, r"[\x{E000}-\x{F8FF}\x00-\x08\x0E-\x1F\x7F]", "")
    return F.regexp_replace(F.regexp_replace(out, r"\.{4,}", "..."), r"-{4,}", "---")


def sentence_count(text: Column, least_words: int = 1) -> Column:
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.size(F.filter(parts, lambda s: F.size(tokens(s)) >= least_words))


# ------------------------------------------------------------------------ labels


def roman(n: Column) -> Column:
    """Lower-case roman number of a positive integer, thousands repeated."""
    digits = lambda one, five, ten: ["", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten]
    place = lambda d, names: F.element_at(F.array(*map(F.lit, names)), (F.floor(n / d) % 10 + 1).cast("int"))
    return F.concat(F.repeat(F.lit("m"), F.floor(n / 1000).cast("int")), place(100, digits("c", "d", "m")), place(10, digits("x", "l", "c")), place(1, digits("i", "v", "x")))


def alpha(n: Column) -> Column:
    """a to z, then aa, bb and so on: the letter is repeated."""
    return F.repeat(F.chr((F.lit(97) + (n - 1) % 26).cast("int")), (F.floor((n - 1) / 26) + 1).cast("int"))


def page_label(style: Column, prefix: Column, n: Column) -> Column:
    body = F.when(style == "r", roman(n)).when(style == "R", F.upper(roman(n))).when(style == "a", alpha(n)).when(style == "A", F.upper(alpha(n))).when(style == "D", n.cast("string")).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), body)


# ----------------------------------------------------------------------- markup


def escape_xml(text: Column) -> Column:
    out = text
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\`*_\[\]#<>|])", r"\\$1")


def csv_field(text: Column) -> Column:
    """Quoted where the value holds a quote, comma or line break."""
    return F.when(text.rlike("[\",\r\n]"), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


# ------------------------------------------------------ tokens, scripts, languages


def compact_tokens(text: Column) -> Column:
    """Letters and digits of each token, tokens of at least two of them."""
    return F.filter(F.transform(tokens(text), compact), lambda x: F.char_length(x) >= 2)


def word_gap(space: Column, size: Column) -> Column:
    """Least distance between characters of two words, by width of a space and font size."""
    return F.greatest(space * 0.15, size * 0.08, F.lit(0.75))


RIGHT_TO_LEFT = r"[\x{0590}-\x{08FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFF}]"
NEUTRAL = r"[\s0-9!-/:-@\[-`{-~\x{2000}-\x{206F}]"


def right_to_left(text: Column) -> Column:
    """More characters of right-to-left scripts than of others, neutral ones aside."""
    rtl = count_of(text, RIGHT_TO_LEFT)
    return rtl * 2 > F.char_length(text) - count_of(text, NEUTRAL)


def clean(text: Column) -> Column:
    """No-break spaces and line breaks as spaces, runs of them as one, ends trimmed."""
    return F.trim(F.regexp_replace(F.translate(text, "\u00a0\n\r\t", "    "), " +", " "))


def classifiable(text: Column) -> Column:
    """Half of the visible characters are letters."""
    visible = count_of(text, r"\S")
    return (visible > 0) & (count_of(text, r"\p{L}") * 2 >= visible)


def page_footer(text: Column) -> Column:
    """Nothing but a page number, with or without the word and a total."""
    return text.rlike(r"(?i)^\s*page\s+[0-9]{1,5}(\s+of\s+[0-9]{1,5})?\s*$")


def reconciled(words: Column, text: Column) -> Column:
    """Boxed words where they spell the text's tokens or are as many; else null."""
    t = tokens(text)
    spelled = F.array_join(words, "") == F.array_join(t, "")
    return F.when(spelled | (F.size(words) == F.size(t)), words)


def innocuous(text: Column, words: list[str]) -> Column:
    """Nothing is left once the given words and signs other than letters and digits are taken out."""
    return F.size(F.array_except(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != ""), F.array(*map(F.lit, words)))) == 0


def repeats_native(text: Column, native: Column) -> Column:
    """A second reading that the native text holds, as a whole or token by token."""
    known = compact_tokens(native)
    mine = compact_tokens(text)
    return F.contains(compact(native), compact(text)) | ((F.size(mine) > 0) & F.forall(mine, lambda t: F.array_contains(known, t)))


#: Frequent short words of each language; ISO 639-3 codes.
STOP_WORDS = {
    "deu": ["der", "die", "und", "den", "von", "mit", "ein", "ist", "das", "nicht"],
    "eng": ["the", "and", "of", "is", "it", "for", "by", "was", "that", "with"],
    "fra": ["le", "la", "les", "des", "un", "dans", "est", "une", "pour", "et"],
    "spa": ["el", "los", "de", "las", "del", "por", "con", "una", "que", "y"],
}


def language(text: Column, least: int = 5) -> Column:
    """Code of the language with the most of its frequent words among the tokens, ties to
    the smaller code; English for texts of fewer than ``least`` tokens, null without any hit."""
    t = F.transform(tokens(text), lambda x: F.lower(x))
    count = lambda words: F.size(F.filter(t, lambda x: x.isin(words)))
    hits = [F.struct(count(words).alias("n"), F.lit(code).alias("code")) for code, words in sorted(STOP_WORDS.items())]
    best = F.aggregate(F.array(*hits[1:]), hits[0], lambda a, b: F.when(b["n"] > a["n"], b).otherwise(a))
    return F.when(F.size(t) < least, "eng").when(best["n"] > 0, best["code"])


# ----------------------------------------------------------------------- search


def find_all(text: Column, pattern: str) -> Column:
    """Array of (start, end, text) of a pattern's matches, blank ones left out. Starts
    follow from the pieces between matches, so no Python is needed. The pattern
    must not match an empty string."""
    found, between = F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)), F.split(text, pattern, -1)
    widths = F.transform(F.arrays_zip(found.alias("m"), F.slice(between, F.lit(1), F.size(found)).alias("g")), lambda z: F.struct(z["m"].alias("m"), F.char_length(z["g"]).alias("g")))
    kind = "struct<at:int,out:array<struct<start:int,end:int,text:string>>>"
    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int,text:string>>").alias("out")).cast(kind)

    def step(acc: Column, z: Column) -> Column:
        start = acc["at"] + z["g"]
        end = start + F.char_length(z["m"])
        return F.struct(end.alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), end.alias("end"), z["m"].alias("text"))).alias("out"))

    return F.filter(F.aggregate(widths, begin, step, lambda a: a["out"]), lambda m: F.trim(m["text"]) != "")


# ---------------------------------------------------------------- blocks and tables


def markdown_block(kind: Column, text: Column, level: Column | None = None) -> Column:
    """A heading with its level (2 where unset, within 1..6), a list item or a paragraph."""
    depth = F.lit(2) if level is None else F.greatest(F.lit(1), F.least(F.lit(6), F.coalesce(level, F.lit(2))))
    body = escape_markdown(F.trim(text))
    item = F.regexp_replace(F.trim(text), rf"^([0-9]{{1,9}}[.)]|[-*{BULLETS}])\s*", "")
    number = F.regexp_extract(text, r"^\s*([0-9]{1,9})[.)](\s|$)", 1)
    mark = F.when(number != "", F.concat(number, F.lit(". "))).otherwise("- ")
    return F.when(kind == "heading", F.concat(F.repeat(F.lit("#"), depth), F.lit(" "), body)).when(kind == "list", F.concat(mark, escape_markdown(item))).otherwise(body)


def html_table(rows: Column) -> Column:
    """An array of rows of cells (text, colspan, rowspan) as an HTML table; null cells are empty."""
    span = lambda n, c: F.when(c > 1, F.concat(F.lit(f' {n}="'), c.cast("string"), F.lit('"'))).otherwise("")
    cell = lambda c: F.concat(F.lit("<td"), span("colspan", c["colspan"]), span("rowspan", c["rowspan"]), F.lit(">"), escape_xml(F.coalesce(c["text"], F.lit(""))), F.lit("</td>"))
    row = lambda r: F.concat(F.lit("<tr>"), F.array_join(F.transform(r, cell), ""), F.lit("</tr>"))
    return F.concat(F.lit("<table>"), F.array_join(F.transform(rows, row), ""), F.lit("</table>"))


def content(text: Column, metadata: Column, without: list[str] | None = None) -> Column:
    """A node's text below the lines of its metadata map, the given keys left out."""
    kept = F.map_filter(metadata, lambda k, v: ~k.isin(without)) if without else metadata
    head = F.array_join(F.transform(F.array_sort(F.map_entries(kept)), lambda e: F.concat(e["key"], F.lit(": "), e["value"])), "\n")
    return F.when(F.size(kept) > 0, F.concat(head, F.lit("\n\n"), text)).otherwise(text)


def header_version(head: Column) -> Column:
    """Version after the file mark at the head of a file."""
    return F.nullif(F.regexp_extract(head, r"%PDF-([0-9]+\.[0-9]+)", 1), F.lit(""))


#: Ranges of neutral characters.
NEUTRAL = r"[\x00-/:-@\x{2000}-\x{206F}\x{20A0}-\x{21FF}]"
#: Fixed value: characters of a short cell.
SHORT_CELL = 25


def neutral_count(text: Column) -> Column:
    """Characters that have no direction of their own."""
    return count_of(text, NEUTRAL)


def single_spaces(text: Column) -> Column:
    """Runs of spaces as one space; other white space stays."""
    return F.regexp_replace(text, "  +", " ")


def digit_bearing(text: Column) -> Column:
    return numeric_cell(text) | text.rlike("[0-9]")


def short_digits(text: Column) -> Column:
    """A digit in a text of at most 25 characters."""
    return (F.char_length(text) <= SHORT_CELL) & text.rlike("[0-9]")


def box_of(values: Column) -> Column:
    """A struct of four numbers from an array of exactly four texts that are numbers, else null."""
    one = [F.try_element_at(values, F.lit(i + 1)).try_cast("double") for i in range(4)]
    sound = (F.size(values) == 4) & one[0].isNotNull() & one[1].isNotNull() & one[2].isNotNull() & one[3].isNotNull()
    return F.when(sound, F.struct(*[v.alias(n) for v, n in zip(one, ("x0", "top", "x1", "bottom"))]))


def mapping_usable(native: Column, actual: Column, glyphs: Column, mapped: Column, unknown: Column, unsupported: Column, doubtful: Column) -> Column:
    """Whether the text that a page's fonts give can be used: replaced by actual text for
    four fifths, without glyphs, or mapped nearly whole."""
    clean = (mapped >= 0.95) & (unknown <= 0.05) & (unsupported <= 0.02) & (doubtful <= 0.02)
    return (actual >= F.greatest(F.lit(1), F.floor(native * 0.8))) | (glyphs == 0) | clean


def hidden_trusted(native: Column, painted: Column, odd: Column, actual: Column, glyphs: Column, doubtful: Column, unsupported: Column, sure: Column, mapped: Column, unknown: Column, wordlike: Column, noise: Column) -> Column:
    """Whether text that is not painted may stand for the page."""
    enough = (native >= 100) & (painted < native * 0.2) & (odd / F.greatest(F.lit(1), native) <= 0.01)
    replaced = actual >= F.greatest(F.lit(32), F.floor(native * 0.8))
    clean = (glyphs > 0) & (doubtful <= 0.01) & (unsupported <= 0.01)
    plain = (mapped >= 0.99) & (unknown <= 0.01) & (wordlike >= 0.65) & (noise <= 0.05)
    return enough & (replaced | (clean & ((sure >= 0.9) | plain)))


def utility(text: Column, confidence: Column) -> Column:
    """nonspace, alphanumeric and utility of a reading: its letters and digits with 0.3 for each sign, signs counted
    up to half of them (two at least), weighed by confidence in per cent and, from six characters on, by how far the
    most frequent one, case aside, exceeds 60 %. One sort of the characters, no pass for each."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", "")
    n = F.char_length(bare)
    letters = F.char_length(F.regexp_replace(bare, r"[^\p{L}\p{N}]", ""))
    zero = F.struct(F.lit(None).cast("string").alias("c"), F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(s: Column, c: Column) -> Column:
        run = F.when(s["c"] == c, s["run"] + 1).otherwise(1)
        return F.struct(c.alias("c"), run.alias("run"), F.greatest(s["best"], run).alias("best"))

    most = F.aggregate(F.array_sort(F.split(F.lower(bare), "")), zero, step, lambda s: s["best"])
    credit = F.least((n - letters).cast("double"), F.greatest(F.lit(2.0), letters * 0.5)) * 0.3
    sure = F.lit(0.25) + F.least(F.lit(100.0), F.greatest(F.lit(0.0), confidence)) * 0.75 / 100.0
    over = most / n
    repeated = F.when((n >= 6) & (over > 0.6), F.greatest(F.lit(0.2), 1.0 - (over - 0.6) * 2.0)).otherwise(1.0)
    return F.struct(n.cast("long").alias("nonspace"), letters.cast("long").alias("alphanumeric"), F.when(n == 0, 0.0).otherwise((letters + credit) * sure * repeated).alias("utility"))
