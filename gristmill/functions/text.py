"""Text functions on columns: terms, whole words, norms, keys, detectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD_CHARS = r"[\p{L}\p{N}]"

#: Fixed list: words that are never search terms.
STOP_WORDS = (
    "what", "whats", "who", "whos", "where", "wheres", "when", "whens", "why", "how", "is", "are", "was", "were",
    "the", "a", "an", "of", "in", "on", "at", "to", "for", "do", "does", "did", "i", "we", "you", "my", "our", "it",
    "its", "and", "or", "with", "about", "tell", "me", "get", "got", "need", "any", "some", "there", "have", "has",
    "can", "should", "know", "so", "no", "up", "oh", "be", "he", "us", "ok",
)

#: Fixed list: words that don't tell one question from another.
GAP_STOP_WORDS = ("what", "whats", "is", "an", "the", "who", "how", "do", "does", "we", "where", "when", "why", "are", "our", "my")

#: Fixed list: an answer with one of these is a refusal.
REFUSALS = (
    "i don't know",
    "nothing in what i've got",
    "that's not something i've been told",
    "i don't have any facts",
    "i don't have a fact",
    "the facts provided don't contain",
    "i can only say what the facts state",
)


#: Edges of words of ASCII letters, digits and _; Java's own ``\b`` takes letters of any script for part of a word.
ASCII_EDGE_BEFORE, ASCII_EDGE_AFTER = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"


def strings(values: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once per row, where ``use`` mentions it inside a lambda."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order, repeats kept."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD_CHARS}+"), F.lit(0))


def terms(text: Column, stop: tuple[str, ...] = STOP_WORDS) -> Column:
    """Search terms of a question: its words of two characters or more that aren't stop words."""
    return F.filter(words(text), lambda w: (F.length(w) > 1) & ~F.array_contains(strings(stop), w))


def contains_word(haystack: Column, word: Column) -> Column:
    """Whether the first occurrence of ``word`` stands between non-word characters. Later occurrences don't count, on purpose."""
    at = F.call_function("instr", haystack, word)
    before = F.call_function("substring", haystack, at - 1, F.lit(1))
    after = F.call_function("substring", haystack, at + F.length(word), F.lit(1))
    edge = lambda c: ~c.rlike(WORD_CHARS)
    return (at > 0) & ((at == 1) | edge(before)) & edge(after)


def count_word(haystack: Column, word: Column) -> Column:
    """Whole-word occurrences of an alphanumeric term: equal words."""
    return F.size(F.filter(words(haystack), lambda w: w == word))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalise_question(q: Column) -> Column:
    """Content words, sorted; the squeezed text where there are none."""
    plain = F.lower(F.replace(q, F.lit("’"), F.lit("'")))
    kept = F.filter(F.split(plain, "[^a-z0-9]+"), lambda w: (F.length(w) > 1) & ~F.array_contains(strings(GAP_STOP_WORDS), w))
    joined = F.array_join(F.array_sort(kept), " ")
    return F.when(joined != "", joined).otherwise(F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " ")))


def gap_key(q: Column) -> Column:
    return F.sha2(normalise_question(q), 256)


def is_refusal(a: Column) -> Column:
    plain = F.replace(F.replace(F.lower(a), F.lit("’"), F.lit("'")), F.lit("do not"), F.lit("don't"))
    return F.exists(strings(REFUSALS), lambda r: F.contains(plain, r))


def ascii_norm(name: Column) -> Column:
    """Lower case, ASCII letters, digits and single spaces; everything else goes."""
    return squeeze(F.regexp_replace(F.lower(name), "[^a-z0-9 ]", ""))


def letter_norm(name: Column) -> Column:
    """Lower case, letters and digits of any script, single spaces."""
    return squeeze(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]+", " "))


def skeleton(word: Column) -> Column:
    """Consonants in order, repeats collapsed."""
    return F.regexp_replace(F.regexp_replace(F.lower(word), "[aeiouy]", ""), r"(.)\1+", "$1")


def near_repeat(a: Column, b: Column) -> Column:
    """Whether one text's content words hold all of the other's."""
    x, y = F.array_distinct(terms(a)), F.array_distinct(terms(b))
    return (F.size(x) > 0) & (F.size(y) > 0) & ((F.size(F.array_except(x, y)) == 0) | (F.size(F.array_except(y, x)) == 0))


def strip_invisible(text: Column) -> Column:
    """Without bidirectional marks, and without the at sign before an isolate."""
    marks = "⁦-⁩‎‏‪-‮"
    return F.regexp_replace(F.regexp_replace(text, "@(?=[⁦-⁩])", ""), f"[{marks}]", "")


def strip_handles(text: Column) -> Column:
    return squeeze(F.regexp_replace(F.regexp_replace(strip_invisible(text), r"@\d{6,}", ""), r"@[\p{L}\p{N}_]+", ""))


def quote_verified(haystack: Column, quote: Column) -> Column:
    """Whether the quote stands in the text, white space and case aside."""
    norm = lambda c: F.lower(squeeze(strip_invisible(c)))
    return (F.length(norm(quote)) > 0) & F.contains(norm(haystack), norm(quote))


def quote_pattern(quote: Column) -> Column:
    """A pattern that finds the quote with any white space between its words."""
    return F.concat(F.lit(r"(?iu)\Q"), F.array_join(F.split(squeeze(quote), " "), r"\E\s+\Q"), F.lit(r"\E"))


def locate_quote(text: Column, quote: Column) -> Column:
    """The text's own slice that the quote stands for; null if there is none."""
    found = F.call_function("regexp_substr", text, quote_pattern(quote))
    return F.when(F.length(squeeze(quote)) > 0, found)


def year_in(path: Column) -> Column:
    return F.nullif(F.regexp_extract(path, "20[12][0-9]", 0), F.lit("")).cast("int")


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.trim(text), r"(?<=[.!?])\s+"), lambda s: F.length(s) > 0)


def clip(text: Column, limit: int = 180) -> Column:
    """At most ``limit`` characters, cut at a space where there is one."""
    head = F.substring(text, 1, limit)
    cut = F.regexp_extract(head, r"(?s)^(.*) ", 1)
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.when(cut != "", cut).otherwise(head), F.lit("…")))


def readable(text: Column) -> Column:
    """No word over 25 characters, at most 2 % structural characters, more than a twelfth spaces."""
    parts = F.filter(F.split(text, " "), lambda w: F.length(w) > 0)
    structural = F.length(text) - F.length(F.regexp_replace(text, r'[{}\[\]"]', ""))
    spaces = F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))
    return (F.size(parts) > 0) & ~F.exists(parts, lambda w: F.length(w) > 25) & (structural / F.length(text) <= 0.02) & (spaces / F.length(text) > 1 / 12)


def human_list(items: Column) -> Column:
    """a, b and c"""
    n = F.size(items)
    return F.when(n <= 1, F.coalesce(F.get(items, F.lit(0)), F.lit(""))).otherwise(F.concat(F.array_join(F.slice(items, F.lit(1), n - 1), ", "), F.lit(" and "), F.element_at(items, -1)))


def slug(name: Column) -> Column:
    """ASCII letters and digits joined by hyphens; accented Latin letters lose their accents."""
    folded = F.translate(F.lower(name), "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
    return F.regexp_replace(F.regexp_replace(folded, "[^a-z0-9]+", "-"), "^-+|-+$", "")


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


def word_runs(tokens: Column, n: int) -> Column:
    """All n-word runs, in order."""
    some = lambda w: F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, F.lit(n)), " "))
    return let(tokens, lambda w: F.when(F.size(w) >= n, some(w)).otherwise(F.array().cast("array<string>")))


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-word runs."""
    return F.array_distinct(word_runs(tokens, n))


def unescape_html(text: Column) -> Column:
    """The entities that saved pages use; then squeezed."""
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&mdash;", "—"), ("&ndash;", "–"), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(char))
    return squeeze(text)


def undouble(text: Column) -> Column:
    """Half of a text that is one text written twice, with or without a space between."""
    n = F.length(text)
    half = F.floor(n / 2).cast("int")
    left = F.call_function("left", text, half)
    right = F.call_function("right", text, half)
    middle = F.when(n % 2 == 1, F.call_function("substring", text, half + 1, F.lit(1))).otherwise(F.lit(" "))
    return F.when((n > 1) & (left == right) & (middle == " "), left).otherwise(text)


def holds_phrase(haystack: Column, needle: Column) -> Column:
    """Whether the phrase stands in the text between characters other than a-z and 0-9, case and white space aside; an empty phrase always does."""
    norm = lambda c: F.lower(squeeze(c))
    edge = F.concat(F.lit(r"(?<![a-z0-9])\Q"), norm(needle), F.lit(r"\E(?![a-z0-9])"))
    return F.when(norm(needle) == "", True).otherwise(F.call_function("regexp_instr", norm(haystack), edge) > 0)


def has_name(corpus: Column, name: Column) -> Column:
    """Whether the name's words stand next to each other in the text, case aside."""
    spaced = lambda c: F.concat(F.lit(" "), F.array_join(words(c), " "), F.lit(" "))
    return (F.size(words(name)) > 0) & F.contains(spaced(corpus), spaced(name))


#: Fixed patterns: an answer in an evaluation that has one of these is a refusal.
EVAL_REFUSALS = (
    r"\bi (do not|don't|cannot|can't) know\b",
    r"not something i'?ve been told",
    r"nothing in what i'?ve got",
    r"we have not written (this|that) down",
    r"\bi'?m not sure\b",
)


def eval_refusal(answer: Column) -> Column:
    low = F.lower(answer)
    out = F.lit(False)
    for p in EVAL_REFUSALS:
        out = out | low.rlike(p)
    return out


def initials(name: Column) -> Column:
    """The first letters of the first and last word, upper case."""
    ws = F.filter(F.split(F.trim(name), r"\s+"), lambda w: w != "")
    first = lambda w: F.upper(F.substring(w, 1, 1))
    return F.when(F.size(ws) == 0, "").when(F.size(ws) == 1, first(F.get(ws, F.lit(0)))).otherwise(F.concat(first(F.get(ws, F.lit(0))), first(F.element_at(ws, -1))))


def hue(name: Column) -> Column:
    """A stable hue of a name, case aside: h = 33 h + byte over its UTF-8 bytes, from 5381, in 64 bits that wrap; h modulo 1000 is laid into the
    band from 0.02 to 0.55. Decimals hold what 64 bits times 33 needs, and remainders are what wrapping leaves."""
    low = F.encode(F.lower(name), "utf-8")
    codes = F.transform(F.sequence(F.lit(1), F.length(low)), lambda i: F.conv(F.hex(F.call_function("substring", low, i, F.lit(1))), 16, 10).cast("decimal(20,0)"))
    start, wrap = F.lit(5381).cast("decimal(20,0)"), F.lit(str(1 << 64)).cast("decimal(20,0)")
    h = F.aggregate(codes, start, lambda h, c: F.pmod((h * 33).cast("decimal(38,0)") + c, wrap).cast("decimal(20,0)"))
    h = F.when(F.length(low) == 0, start).otherwise(h)
    return F.round(0.02 + F.pmod(h, F.lit(1000)).cast("double") / 1000 * 0.53, 6)


def plain_document(text: Column) -> Column:
    """Without page and slide marks on lines of their own and without control characters; white space squeezed, blank lines kept single."""
    bare = F.regexp_replace(text, r"(?im)^\s*(?:-+\s*)?(?:page|slide)\s+\d+(?:\s+of\s+\d+)?(?:\s*-+)?\s*$", "")
    bare = F.regexp_replace(bare, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(bare, "[ \t]+", " "), "\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def estimated_tokens(text: Column) -> Column:
    """A third of the characters."""
    return F.floor(F.length(text) / 3).cast("long")


def similar(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length, case aside."""
    x, y = F.lower(a), F.lower(b)
    longest = F.greatest(F.length(x), F.length(y))
    return F.when(longest == 0, 1.0).otherwise(1 - F.levenshtein(x, y) / longest)


def same_person(a: Column, b: Column) -> Column:
    """True, false, or null for a person to look at: equal names, or over 0.95 alike; one name the beginning of the other is unsure."""
    x, y = letter_norm(a), letter_norm(b)
    starts = F.startswith(x, F.concat(y, F.lit(" "))) | F.startswith(y, F.concat(x, F.lit(" ")))
    return F.when((x == y) | (similar(x, y) > 0.95), True).when(starts, F.lit(None).cast("boolean")).otherwise(False)


def year_span(first: Column, last: Column) -> Column:
    """2016–2024, or one year."""
    return F.when(first == last, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit("–"), last.cast("string")))
