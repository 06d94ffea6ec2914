"""Column builders for text: tokens, normal forms, boilerplate, dates, answer matching. All of them stay in the JVM but NFKD folding and sketches."""

from __future__ import annotations

import hashlib
import unicodedata
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

# Patterns and word lists that results depend on.
TOKEN = r"[a-z0-9]+(?:[-/][a-z0-9]+)*"
MASTHEAD = (
    r"(?md)^\[Federal Register Volume.*?\](?U:\s*)$",
    r"(?md)^\[(?:Rules and Regulations|Proposed Rules|Notices)\](?U:\s*)$",
    r"(?md)^\[Pages? [0-9\-]+\](?U:\s*)$",
    r"(?md)^From the Federal Register Online.*?$",
    r"(?md)^\[FR Doc No: [^\]]+\](?U:\s*)$",
    r"\[\[Page [0-9]+\]\]",
    r"(?md)^=+(?U:\s*)$",
    r"(?md)^-{5,}(?U:\s*)$",
)
#: One of these is in whatever a pattern of MASTHEAD matches.
MASTHEAD_BEGINS = ("[Federal Register Volume", "[Rules and Regulations", "[Proposed Rules", "[Notices", "[Page", "From the Federal Register Online", "[FR Doc No: ", "=", "-----")
ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "))
LABEL_WORDS = ("docket", "no", "nos", "number", "numbers", "rin", "id", "identifier", "regulation", "case", "sequence", "accession")
REFUSAL = "Not found in the available documents."
REFUSAL_STARTS = ("i cannot find", "i could not find")
QUESTION_STOP = (
    "the", "a", "an", "of", "for", "on", "in", "by", "to", "and", "is", "what", "when", "which", "does", "must", "date", "number", "rule",
    "rulemaking", "docket", "comments", "received", "effective", "take", "effect", "regulation", "identifier", "rin",
)
IMPORT_TITLE_STOP = ("the", "of", "for", "and", "a", "an", "on", "in", "to", "rule", "rules", "proposed", "notice", "amendment", "establishment", "final", "act", "regulation", "regulations")
AUTHOR_TITLE_STOP = ("the", "of", "for", "and", "a", "an", "on", "in", "to", "rule", "proposed", "rules", "notice", "amendment", "establishment")
TYPOGRAPHY = "\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201c\u201d\u00a0"
IMPORT_TYPOGRAPHY = (("\u2018", "'"), ("\u2019", "'"), ("\u201c", '"'), ("\u201d", '"'), ("\u2013", "-"), ("\u2014", "-"), ("\u00a0", " "), ("\u2032", "'"), ("\u2033", "''"), ("\u00b0", " "))
FACT_LINE = r"(?i)^(?:DATES?|ADDRESSES|EFFECTIVE|COMMENTS?|FOR FURTHER INFORMATION|SUMMARY|ACTION|Docket|RIN)\b"
VALUE_LINE = r"\b(?:19|20)[0-9]{2}\b|\b[0-9]{1,2}:[0-9]{2}\b|\$[0-9]"
CORRECTION_ID = r"^C[0-9]+-"


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Without leading and trailing white space of any script."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"(?U)^\s+", ""), r"(?U)\s+\z", "")


def words(c) -> Column:
    """Pieces between white space; none for null or empty."""
    return F.filter(F.split(F.coalesce(_col(c), F.lit("")), r"(?U)\s+"), lambda w: w != "")


def tokens(c) -> Column:
    """Lower-case index terms; hyphens and slashes inside a term hold it together."""
    return F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit(TOKEN), F.lit(0))


def collapsed(c) -> Column:
    """Lower case, runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"(?U)\s+", " "))


def exact_key(c) -> Column:
    return F.sha2(collapsed(c), 256)


def without_masthead(c) -> Column:
    """Without the header lines that every published document carries; applying it twice changes nothing more."""
    c = whole = F.coalesce(_col(c), F.lit(""))
    for pattern in MASTHEAD:
        c = F.regexp_replace(c, pattern, "")
    # most texts have nothing that a pattern begins with, and are told so at a fraction of the patterns' time
    may = reduce(Column.__or__, [F.contains(whole, F.lit(x)) for x in MASTHEAD_BEGINS])
    return strip(F.regexp_replace(F.when(may, c).otherwise(whole), r"\n{3,}", "\n\n"))


def page_text(c) -> Column:
    """The text of a raw page: the first preformatted part if there is one, without tags, entities decoded in a fixed order."""
    c = F.coalesce(_col(c), F.lit(""))
    c = F.when(c.rlike(r"(?is)<pre>.*?</pre>"), F.regexp_extract(c, r"(?is)<pre>(.*?)</pre>", 1)).otherwise(c)
    c = F.regexp_replace(c, r"<[^>]+>", "")
    for entity, char in ENTITIES:
        c = F.replace(c, F.lit(entity), F.lit(char))
    c = F.regexp_replace(c, r"[ \t]+\n", "\n")
    return strip(F.regexp_replace(c, r"\n{3,}", "\n\n"))


def plain(c) -> Column:
    """Lower case, everything but ASCII letters and digits as one space."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(_col(c), F.lit(""))), r"[^a-z0-9]+", " "))


def plain_imported(c) -> Column:
    """:func:`plain` after folding typographic marks."""
    c = F.coalesce(_col(c), F.lit(""))
    for mark, text in IMPORT_TYPOGRAPHY:
        c = F.replace(c, F.lit(mark), F.lit(text))
    return plain(c)


def _nfkd(c: Column) -> Column:
    """Texts in compatibility decomposition. Only those with letters beyond ASCII reach Python, and few of a batch are held there at once."""

    @F.arrow_udf("string")
    def run(column: pa.Array) -> pa.Array:
        parts = [pa.array([x if x is None else unicodedata.normalize("NFKD", x) for x in column[i : i + 256].to_pylist()], pa.string()) for i in range(0, len(column), 256)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return F.coalesce(run(F.when(c.rlike(r"[^\x00-\x7F]"), c)), c)


def plain_scored(c, ascii_only: bool = False) -> Column:
    """:func:`plain` after compatibility decomposition. ``ascii_only``: the caller knows that there is nothing to decompose."""
    c = F.coalesce(_col(c), F.lit(""))
    if not ascii_only:
        c = _nfkd(c)
    return plain(F.translate(c, TYPOGRAPHY, " " * len(TYPOGRAPHY)))


def question_key(c) -> Column:
    """A question's distinct words, sorted."""
    return F.array_join(F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(_col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)))), " ")


def _stops(stop) -> Column:
    return F.array(*map(F.lit, stop))


def title_words(c, imported: bool = True) -> Column:
    """A title's telling words: imported questions ask for over three letters, authored ones for over two."""
    form, stop, least = (plain_imported, IMPORT_TITLE_STOP, 3) if imported else (plain, AUTHOR_TITLE_STOP, 2)
    return F.filter(F.array_except(F.split(form(c), " "), _stops(stop)), lambda w: F.length(w) > least)


def reused_words(question, title, imported: bool = True) -> Column:
    form = plain_imported if imported else plain
    return F.array_sort(F.array_intersect(F.filter(F.split(form(question), " "), lambda w: w != ""), title_words(title, imported)))


def content_terms(c) -> Column:
    """A question's distinct index terms that are neither function words nor numbers."""
    return F.filter(F.array_except(tokens(c), _stops(QUESTION_STOP)), lambda t: ~t.rlike("^[0-9]+$"))


def is_degenerate(c, least: int = 3) -> Column:
    return F.size(content_terms(c)) < least


def ablate(c, terms, strict: bool = False) -> Column:
    """The question without ``terms`` (longest first, whole words, any case), tidied. ``strict`` keeps words that merely end in a preposition."""
    ordered = F.array_sort(_col(terms), lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).otherwise(F.lit(0)))
    c = F.aggregate(ordered, _col(c), lambda s, x: F.regexp_replace(s, F.concat(F.lit(r"(?iU)\b\Q"), x, F.lit(r"\E\b")), F.lit("")))
    c = F.regexp_replace(c, r"(?U)\s*,\s*,", ",")
    c = F.regexp_replace(c, r"(?U)\s{2,}", " ")
    c = F.regexp_replace(c, r"(?U)\s+([,.?])", "$1")
    c = F.regexp_replace(c, rf"(?iU){chr(92) + 'b' if strict else ''}(for|on|in)\s*\?", "?")
    return strip(c)


def _core(terms: Column) -> Column:
    """From the first term with a digit (and a short plain one before it) to the last."""
    at = F.filter(F.transform(terms, lambda t, i: F.when(t.rlike("[0-9]"), i + 1)), lambda i: i.isNotNull())
    first, last = F.array_min(at), F.array_max(at)
    before = F.try_element_at(terms, first - 1)
    begin = F.when((first > 1) & (F.length(before) <= 6), first - 1).otherwise(first)
    return F.when(F.size(at) > 0, F.array_join(F.slice(terms, begin, last - begin + 1), " "))


def holds_answer(found, expected) -> Column:
    """Whether ``found`` states ``expected``; both in normal form. Either in one piece, or all telling words somewhere and the number with its prefix in one piece."""
    found, expected = _col(found), _col(expected)
    terms = F.split(expected, " ")
    telling = F.array_except(terms, _stops(LABEL_WORDS))
    loose = (F.size(telling) > 0) & (F.size(F.array_except(telling, F.split(found, " "))) == 0) & F.coalesce(F.contains(found, _core(terms)), F.lit(False))
    return F.when(expected == "", False).otherwise(F.contains(found, expected) | loose)


def is_refusal(normal) -> Column:
    normal = _col(normal)
    said = F.contains(normal, F.lit(REFUSAL.lower().rstrip(".")))
    for start in REFUSAL_STARTS:
        said = said | normal.startswith(start)
    return said


def answer_key(id_, question, generated, has_generated=None) -> Column:
    """16 hex digits that name a question and its answer; a null reads as None, an absent answer (``has_generated`` false) as empty."""
    text = lambda c: F.coalesce(_col(c).cast("string"), F.lit("None"))
    answer = text(generated) if has_generated is None else F.when(_col(has_generated), text(generated)).otherwise("")
    return F.left(F.sha2(F.concat_ws(chr(124), text(id_), text(question), answer), 256), F.lit(16))


def spelled_date(c) -> Column:
    """An ISO date in words, as prose has it; null if it is no date."""
    c = _col(c).cast("string")
    return F.when(c.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.date_format(F.try_to_date(c), "MMMM d, yyyy"))


def sketch(c, k: int = 256, shingle: int = 5, most: int | None = 20_000, hashing=F.crc32) -> Column:
    """The ``k`` least hashes of the shingles of a text's first ``most`` words (None: all); a shorter text has one, of all its words.

    Words of a collapsed text are one space apart, so a shingle is a piece of it. CRC-32 and :func:`md5_hash` are taken of these pieces in Arrow batches; other hashes in Spark's own expressions.
    """
    one = _HASHES.get(hashing)
    if one is None:
        return _sketch_columns(c, k, shingle, most, hashing)

    @F.arrow_udf("array<bigint>")
    def least(texts: pa.Array) -> pa.Array:
        data, offsets = laid(texts)
        spaces = np.flatnonzero(data == 32)
        cuts = np.searchsorted(spaces, offsets)
        out, held, size = [], [], 0
        for i in range(len(texts)):
            own = spaces[cuts[i] : cuts[i + 1]]
            starts, ends = np.append(offsets[i], own + 1)[:most], np.append(own, offsets[i + 1])[:most]
            if len(starts) < shingle:
                starts, ends = starts[:1], ends[-1:]
            elif shingle > 1:
                starts, ends = starts[: 1 - shingle], ends[shingle - 1 :]
            held.append((starts, ends))
            size += len(starts)
            if size > 1 << 16 or i == len(texts) - 1:
                hashes = one(data, *map(np.concatenate, zip(*held)))
                out += [np.unique(x)[:k] for x in np.split(hashes, np.cumsum([len(x) for x, _ in held])[:-1])]
                held, size = [], 0
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)]).astype(np.int32), pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), pa.int64()))

    return least(collapsed(c))


def laid(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of strings without nulls, end to end, and where each begins."""
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    return np.frombuffer(column.buffers()[2] or b"", np.uint8), offsets


def _sketch_columns(c, k: int, shingle: int, most: int | None, hashing) -> Column:
    def of(w):  # a variable of a lambda: the words are split once and not for each shingle
        whole = F.array(hashing(F.array_join(w, " ")))
        each = F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - shingle + 1, F.lit(1))), lambda i: hashing(F.array_join(F.slice(w, i, shingle), " ")))
        return F.slice(F.array_sort(F.array_distinct(F.when(F.size(w) < shingle, whole).otherwise(each))), 1, k)

    words = F.split(collapsed(c), " ")
    return F.transform(F.array(words if most is None else F.slice(words, 1, most)), of)[0]


def md5_hash(c) -> Column:
    """32 bits of an MD5: a hash that other SQL engines have too."""
    return F.conv(F.substring(F.md5(c), 1, 8), 16, 10).cast("long")


def _crc32s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    low = int(starts[0])
    held = data[low : int(ends[-1])].tobytes()
    return np.array([zlib.crc32(held[s:e]) for s, e in zip((starts - low).tolist(), (ends - low).tolist())], np.int64)


_TURNS = [t for four in ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)) for t in four * 4]
_SINES = (np.abs(np.sin(np.arange(1, 65))) * 2**32).astype(np.uint32)


def _md5s(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The first 32 bits of the MD5 of each piece: those of one block (up to 55 bytes) many at once, others by hashlib."""
    out, size, low = np.empty(len(starts), np.int64), ends - starts, int(starts[0])
    data, starts, ends = data[low : int(ends[-1])], starts - low, ends - low
    short, long, held = np.flatnonzero(size <= 55), np.flatnonzero(size > 55), data.tobytes()
    out[long] = [int.from_bytes(hashlib.md5(held[s:e], usedforsecurity=False).digest()[:4], "big") for s, e in zip(starts[long].tolist(), ends[long].tolist())]
    windows = np.lib.stride_tricks.sliding_window_view(np.append(data, np.zeros(64, np.uint8)), 64)
    for at in range(0, len(short), 8192):
        some = short[at : at + 8192]
        n = size[some]
        block = windows[starts[some]] * (np.arange(64) < n[:, None]).view(np.uint8)
        block[np.arange(len(some)), n] = 0x80
        words = block.view("<u4").T.copy()
        words[14] = n * 8
        a, b, c, d = (np.full(len(some), x, np.uint32) for x in (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476))
        for i, (turn, sine) in enumerate(zip(_TURNS, _SINES)):
            if i < 16:
                f, g = d ^ (b & (c ^ d)), i
            elif i < 32:
                f, g = c ^ (d & (b ^ c)), (5 * i + 1) % 16
            elif i < 48:
                f, g = b ^ c ^ d, (3 * i + 5) % 16
            else:
                f, g = c ^ (b | ~d), 7 * i % 16
            f += a
            f += sine
            f += words[g]
            a, d, c, b = d, c, b, b + (f << np.uint32(turn) | f >> np.uint32(32 - turn))
        out[some] = (a + np.uint32(0x67452301)).byteswap()
    return out


#: what :func:`sketch` takes of pieces of a text, by the expression that it equals
_HASHES = {F.crc32: _crc32s, md5_hash: _md5s}


def sketch_similarity(a, b, k: int = 256) -> Column:
    """The share of the ``k`` least hashes of both sketches that both hold."""
    a, b = _col(a), _col(b)
    union = F.slice(F.array_sort(F.array_union(a, b)), 1, k)
    return F.when((F.size(a) > 0) & (F.size(b) > 0), F.size(F.array_intersect(union, F.array_intersect(a, b))) / F.size(union)).otherwise(0.0)
