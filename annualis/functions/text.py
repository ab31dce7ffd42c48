"""Text expressions (TXT-*, MET-*) as native Spark Columns.

Python's ``re`` treats ``\\w``/``\\s`` as Unicode; Java's are ASCII by default, so word
characters are written out as ``[\\p{L}\\p{N}_]`` where the result must match, and
Python's ``str.strip()`` becomes an explicit ``^\\s+|\\s+$`` replace.
"""

from __future__ import annotations

from functools import reduce
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from annualis import config as C

WORD = r"[\p{L}\p{N}_]"
TOKEN_RE = r"[\p{L}\p{N}_]+|[^\s\p{L}\p{N}_]"
# HTML entities of the given pages, for the SQL twin (ampersand last).
HTML_ENTITIES = [
    ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"),
    ("&nbsp;", " "), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&"),
]
HTML_REFERENCE = "(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*)"
# Spacing clean-up of the sub-word decoder (space removed before these).
DECODE_CLEANUPS = [
    (" .", "."), (" ?", "?"), (" !", "!"), (" ,", ","), (" ' ", "'"),
    (" n't", "n't"), (" 'm", "'m"), (" 's", "'s"), (" 've", "'ve"), (" 're", "'re"),
]
# white space as Unicode has it
WS = r"[\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


#: The characters of ``WS``.
WS_CHARS = " \t\n\x0b\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip_ws(c) -> Column:
    return F.btrim(_c(c), F.lit(WS_CHARS))


def collapse_ws(c) -> Column:
    return F.regexp_replace(_c(c), WS + "+", " ")


def strip_chars(c, chars: str) -> Column:
    cls = "[" + "".join("\\" + ch if ch in "\\]^-[" else ch for ch in chars) + "]"
    return F.regexp_replace(_c(c), f"^{cls}+|{cls}+$", "")


# ---- normalisers -------------------------------------------------------------------

def normalize_answer(c) -> Column:
    """TXT-10: lower, non-word/non-space -> space, collapse, strip."""
    s = F.lower(F.coalesce(_c(c), F.lit("")))
    # "non-word -> space, then collapse whitespace" is one pass: every run of non-word
    # characters (whitespace included) becomes one space; a plain trim finishes the strip
    return F.trim(F.regexp_replace(s, r"[^\p{L}\p{N}_]+", " "))


# A word of the normalised text is a maximal run of word characters; keep runs of two or
# more characters that are not exactly a stop word (one regex pass, no per-token lambda).
ANSWER_TOKEN_RE = (rf"(?<!{WORD})(?!(?:{'|'.join(C.STOP_WORDS)})(?!{WORD})){WORD}{{2,}}")


def answer_tokens(c) -> Column:
    """TXT-11: normalised words minus stop words and one-letter tokens (same tokens as
    splitting :func:`normalize_answer` on spaces and filtering)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(ANSWER_TOKEN_RE), F.lit(0))


def normalize_extract(c) -> Column:
    """TXT-12: strip, lower, drop trailing [space , ; : .], collapse whitespace."""
    s = F.lower(strip_ws(c))
    s = F.regexp_replace(s, r"[\s,;:.]+$", "")
    return collapse_ws(s)


def clean_candidate(c) -> Column:
    """TXT-13: collapse(strip(s)), strip ' ,.;:-' at both ends, lower."""
    s = collapse_ws(strip_ws(F.coalesce(_c(c), F.lit(""))))
    return F.lower(strip_chars(s, " ,.;:-"))


def normalize_canon(c) -> Column:
    """TXT-14: strip, lower, collapse, strip ' ,.;:-'."""
    s = F.lower(strip_ws(F.coalesce(_c(c), F.lit(""))))
    return strip_chars(collapse_ws(s), " ,.;:-")


def canonicalize(c) -> Column:
    """TXT-15: normalise, ordered substitutions, prefix removals, one doubled word."""
    s = normalize_canon(c)
    for pat, repl in C.CANON_SUBSTITUTIONS:
        s = F.regexp_replace(s, "(?iU)" + pat, repl)
    for pat in C.CANON_PREFIXES:
        s = F.regexp_replace(s, "(?iU)" + pat, "")
    pat, repl = C.CANON_DOUBLED_WORD
    return F.regexp_replace(s, "(?U)" + pat, repl)


# ---- HTML ---------------------------------------------------------------------------

def _named_references() -> Column:
    """A constant map of the standard's named references; numeric ones 128 to 159 mean
    Windows-1252 characters there, so these are in it as well."""
    names = {n[:-1]: text for n, text in html5.items() if n.endswith(";")}
    names |= {f"#{n}": bytes([n]).decode("cp1252", "replace") for n in range(128, 160)}
    cut = "\x01"
    return F.map_from_arrays(F.split(F.lit(cut.join(names)), cut, -1), F.split(F.lit(cut.join(names.values())), cut, -1))


def unescape(c) -> Column:
    """Character references decoded once, named and numeric ones; unknown names stay as they
    are, numbers of no character become U+FFFD."""
    names = _named_references()

    def decoded(part: Column) -> Column:
        name = F.regexp_extract(part, f"^&({HTML_REFERENCE});", 1)
        digits = F.regexp_replace(name, "^#[xX]?0*", "")
        digits = F.when(digits == "", "0").when(F.length(digits) > 7, "9999999").otherwise(digits)
        number = F.when(name.rlike("^#[xX]"), F.conv(digits, 16, 10)).when(name.startswith("#"), F.conv(digits, 10, 10)).cast("long")
        wrong = (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
        character = F.when(wrong, "�").otherwise(F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32"))
        number_name = F.concat(F.lit("#"), number.cast("string"))
        text = F.when(name.startswith("#"), F.coalesce(F.element_at(names, number_name), character)) \
            .when(name != "", F.element_at(names, name))
        return F.coalesce(F.concat(text, F.substr(part, F.length(name) + F.lit(3))), part)

    return F.array_join(F.transform(F.split(_c(c), f"(?=&{HTML_REFERENCE};)"), decoded), "")


def html_to_text(c, drop_noscript: bool = True) -> Column:
    """TXT-1: drop script/style(/noscript) with contents, comments and declarations;
    tags become a space; entities decoded; whitespace collapsed and stripped."""
    s = _c(c)
    tags = ["script", "style"] + (["noscript"] if drop_noscript else [])
    for t in tags:
        s = F.regexp_replace(s, rf"(?is)<{t}\b.*?</{t}\s*>", " ")
    s = F.regexp_replace(s, r"(?s)<!--.*?-->", " ")
    s = F.regexp_replace(s, r"(?s)<![^>]*>", " ")
    s = F.regexp_replace(s, r"(?s)<[^>]+>", " ")
    s = F.regexp_replace(unescape(s), WS + "+", " ")
    return F.regexp_replace(s, r"^ +| +$", "")


# ---- tokens, windows, sentences --------------------------------------------------------

def word_pieces(c) -> Column:
    """Lower-cased word / punctuation tokens (the chunker's token stream)."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(TOKEN_RE), F.lit(0))


def detokenize(tokens) -> Column:
    """TXT-6: join with spaces, then the decoder's spacing clean-ups."""
    s = F.array_join(_c(tokens), " ")
    return reduce(lambda acc, kv: F.replace(acc, F.lit(kv[0]), F.lit(kv[1])), DECODE_CLEANUPS, s)


def window_starts(n_tokens, size: int = C.CHUNK_TOKENS, overlap: int = C.CHUNK_OVERLAP) -> Column:
    """Start offsets 0, step, 2*step ... until a window reaches the end; empty for n = 0."""
    step = max(1, size - overlap)
    n = _c(n_tokens)
    last = F.when(n <= size, F.lit(0)).otherwise(F.ceil((n - F.lit(size)) / F.lit(step)).cast("int"))
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), last), lambda j: j * step)).otherwise(F.array().cast("array<int>"))


def sentences(c) -> Column:
    """TXT-16: split on [.!?•;] + whitespace, strip, drop empties."""
    parts = F.split(F.coalesce(_c(c), F.lit("")), C.SENTENCE_SPLIT)
    return F.filter(F.transform(parts, lambda x: strip_ws(x)), lambda x: x != "")


def answer_after_marker(c, marker: str = "Answer:") -> Column:
    """TXT-20 post-process: the text after the last marker, stripped (whole text if absent)."""
    import re as _re
    return strip_ws(F.element_at(F.split(F.coalesce(_c(c), F.lit("")), _re.escape(marker)), -1))


def snippet(c, n: int = C.SNIPPET_CHARS, suffix: str = C.SNIPPET_ELLIPSIS) -> Column:
    """TXT-18: first n characters plus a suffix when longer."""
    t = _c(c)
    return F.when(F.length(t) > n, F.concat(F.substring(t, 1, n), F.lit(suffix))).otherwise(t)


# ---- answer metrics (MET-1..3, MET-7) ---------------------------------------------------------

def exact_match(pred, gold) -> Column:
    return (normalize_answer(pred) == normalize_answer(gold)).cast("int")


def contains_match(pred, gold) -> Column:
    p, g = normalize_answer(pred), normalize_answer(gold)
    return F.when((p == "") | (g == ""), F.lit(0)).otherwise((F.contains(g, p) | F.contains(p, g)).cast("int"))


def token_f1(pred, gold) -> Column:
    p = F.array_distinct(answer_tokens(pred))
    g = F.array_distinct(answer_tokens(gold))
    tp = F.size(F.array_intersect(p, g))
    prec = tp / F.size(p)
    rec = tp / F.size(g)
    return (F.when((F.size(p) == 0) & (F.size(g) == 0), F.lit(1.0))
            .when((F.size(p) == 0) | (F.size(g) == 0), F.lit(0.0))
            .when(tp == 0, F.lit(0.0))
            .otherwise(2 * prec * rec / (prec + rec)))


def company_key(c, drop_spaces: bool = False) -> Column:
    """TXT-2: trimmed upper-case company key (ingest variant also removes spaces)."""
    s = F.upper(strip_ws(F.coalesce(_c(c), F.lit(""))))
    return F.replace(s, F.lit(" "), F.lit("")) if drop_spaces else s


def zero_pad(c, width: int = 10) -> Column:
    """zfill: left-pad with zeros but never truncate (lpad would)."""
    s = _c(c)
    return F.when(F.length(s) < width, F.lpad(s, width, "0")).otherwise(s)
