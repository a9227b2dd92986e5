"""Text functions as column expressions: answers, refusals, prompts, sentences, windows, n-grams. All stay in the JVM."""

from __future__ import annotations

import sys
import unicodedata
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# The sentinels, tags and abstention patterns that responses are read by.
NO_ANSWER = "<<NO_ANSWER_SUPPORTED>>"
REFUSAL_SENTINEL = "INSUFFICIENT EVIDENCE"
ABSTENTIONS = (
    r"INSUFFICIENT EVIDENCE",
    r"\binsufficient\s+(?:evidence|information|context|data)\b",
    r"\bnot\s+enough\s+(?:evidence|information|context|data)\b",
    r"\b(?:evidence|information|context)\s+is\s+insufficient\b",
    r"\bcannot\s+be\s+(?:determined|answered|established)\b",
    r"\b(?:cannot|can't|could\s+not|unable\s+to)\s+(?:answer|determine|tell|say)\b",
    r"\b(?:passages?|context|documents?|sources?)\s+(?:do(?:es)?\s+not|don't|doesn't)\s+(?:contain|provide|mention|state|specify|say|support)\b",
    r"\bno\s+(?:information|evidence|mention|answer)\b",
    r"\bnot\s+(?:stated|mentioned|specified|provided|given)\b",
    r"\b(?:i\s+)?(?:do\s+not|don't)\s+know\b",
    r"^\s*(?:unknown|n/?a|none)\s*$",
)
SHORT_FIELD = 15
# Capitalised words of answers that name nothing by themselves.
COMMON_ANSWER_WORDS = (
    "january february march april may june july august september october november december north south east west northern southern eastern western united great new old first last "
    "saint mount lake river city county state island house world national international john james david michael robert william mary anne peter paul george charles"
).split()
_PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def let(value: Column, body) -> Column:
    """body of a value that is computed once per row, though body may use it within lambdas, which would compute an expression for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """White-space tokens; none for an empty text, NULL for NULL."""
    return F.filter(F.split(text, r"\s+"), lambda x: x != "")


def first_words(text: Column, most: int, between: str = r"\s+") -> Column:
    """The first words of a text, which is split no further than that: a blank start and what remains are a piece each."""
    return F.slice(F.filter(F.split(text, between, most + 2), lambda x: x != ""), 1, most)


def word_count(text: Column) -> Column:
    return F.size(words(text))


def lower_words(text: Column) -> Column:
    return words(F.lower(text))


#: Marks that a decomposed text is rid of: all characters with a combining class.
COMBINING = "".join(c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.combining(c))


def strip(text: Column) -> Column:
    """Without white space of any kind at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def trim_blanks(text: Column) -> Column:
    """Without blanks at both ends, those of other scripts and widths included; tabs and ends of lines stay, as in DuckDB's trim."""
    return F.regexp_replace(text, r"^\p{Zs}+|\p{Zs}+\z", "")


def lower_each(text: Column) -> Column:
    """Lower case of each character for itself, as in DuckDB: neither depends on its place in the word nor becomes two."""
    return F.lower(F.replace(F.replace(text, F.lit("\u0130"), F.lit("i")), F.lit("\u03a3"), F.lit("\u03c3")))


def fold_accents(text: Column) -> Column:
    """Compatibility decomposition without combining marks. In the JVM, by the library that Spark's collations use; texts of ASCII only aren't looked at."""
    decomposed = F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("decompose"), text, F.lit(True))
    return F.when(F.rlike(text, F.lit(r"[^\x00-\x7F]")), F.translate(decomposed, COMBINING, "")).otherwise(text)


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def strip_markup(text: Column) -> Column:
    """Tags (a letter first, at most 80 further characters) become blanks, and runs of white space one."""
    return squeeze(F.regexp_replace(text, r"</?[A-Za-z][^<>]{0,80}>", " "))


def match_form(text: Column) -> Column:
    """Lower-case letters, digits and single blanks of a text without markup."""
    return squeeze(F.regexp_replace(F.lower(strip_markup(text)), r"[^a-z0-9 ]", " "))


def normalise_answer(text: Column) -> Column:
    """Lower case without ASCII punctuation and articles, single blanks."""
    plain = F.translate(F.lower(text), _PUNCTUATION, "")
    return squeeze(F.regexp_replace(plain, r"\b(?:a|an|the)\b", " "))


def _quoted(text: Column) -> Column:
    """A pattern that matches a text as it is."""
    return F.concat(F.lit("\\Q"), F.replace(text, F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))


def on_word_boundary(needle: Column, haystack: Column) -> Column:
    """Whether the needle stands in the haystack between non-word characters, both in lower case and without accents; an empty needle never does."""
    n, h = fold_accents(F.lower(strip(needle))), fold_accents(F.lower(haystack))
    return F.coalesce((n != "") & F.rlike(h, F.concat(F.lit("(?U)(?<!\\w)"), _quoted(n), F.lit("(?!\\w)"))), F.lit(False))


def on_exact_boundary(needle: Column, haystack: Column) -> Column:
    """Whether the needle stands in the haystack between characters that are no letter, number or underscore, both in lower case and with their accents; NULL if either is NULL.

    The characters beside it are matched rather than looked at: a look behind would take a letter of two UTF-16 units for none.
    """
    n, h = lower_each(trim_blanks(needle)), lower_each(haystack)
    return F.rlike(h, F.concat(F.lit(r"(?:^|[^\p{L}\p{N}_])"), _quoted(n), F.lit(r"(?:\z|[^\p{L}\p{N}_])")))


def exact_match(prediction: Column, gold: Column) -> Column:
    return normalise_answer(prediction) == normalise_answer(gold)


def contains_answer(prediction: Column, gold: Column) -> Column:
    return on_word_boundary(normalise_answer(gold), normalise_answer(prediction))


def bag_overlap(a: Column, b: Column) -> Column:
    """Size of the multiset intersection of two arrays."""
    count = lambda v, x: F.size(F.filter(v, lambda y: y == x))
    return let(a, lambda p: let(b, lambda q: F.aggregate(F.array_distinct(p), F.lit(0), lambda s, x: s + F.least(count(p, x), count(q, x)))))


def token_f1(prediction: Column, gold: Column) -> Column:
    """Bag F1 of normalised tokens; with an empty side 1 if both are empty, else 0."""

    def score(p: Column, g: Column) -> Column:
        both_empty = (F.size(p) == 0) & (F.size(g) == 0)
        return F.when((F.size(p) == 0) | (F.size(g) == 0), both_empty.cast("double")).otherwise(2.0 * bag_overlap(p, g) / (F.size(p) + F.size(g)))

    return let(words(normalise_answer(prediction)), lambda p: let(words(normalise_answer(gold)), lambda g: score(p, g)))


def jaccard(a: Column, b: Column) -> Column:
    """Similarity of two arrays as sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def abstains(field: Column) -> Column:
    return F.rlike(field, F.lit("(?i)" + "|".join(f"(?:{p})" for p in ABSTENTIONS)))


def classify_field(final_answer: Column) -> Column:
    """struct(category, confident): NULL and blank fields are unparseable; an abstention in a long field is a refusal without confidence."""
    field = F.trim(final_answer)
    refusal, short = abstains(field), word_count(field) <= SHORT_FIELD
    category = F.when(field.isNull() | (field == ""), "unparseable").when(refusal, "refusal").otherwise("answer")
    return F.struct(category.alias("category"), (field.isNull() | (field == "") | ~refusal | short).alias("confident"))


def recover(raw: Column) -> Column:
    """struct(answer, method) of a response without a closed field: a bare or trailing sentinel, or an answer in the place of the opening tag; NULLs else."""
    text = F.trim(F.coalesce(raw, F.lit("")))
    bare = F.rlike(text, F.lit(r"(?is)^[ .<>]*INSUFFICIENT EVIDENCE[ .<>]*$"))
    trailing = F.rlike(text, F.lit(r"(?i)(?:^|\n|:)\s*<?\s*INSUFFICIENT EVIDENCE\s*>?\s*[.]?\s*$"))
    inner = F.trim(F.regexp_extract(text, r"(?i)^<([^<>]{1,120})></final_answer>\s*$", 1))
    tag = (inner != "") & (F.lower(inner) != "final_answer")
    method = F.when(bare, "bare_sentinel").when(trailing, "trailing_sentinel").when(tag, "malformed_open_tag")
    return F.struct(F.when(bare | trailing, REFUSAL_SENTINEL).when(tag, inner).alias("answer"), method.alias("method"))


def final_answer(text: Column) -> Column:
    """Trimmed content of the last closed field; NULL without one."""
    return F.trim(F.try_element_at(F.regexp_extract_all(text, F.lit(r"(?is)<final_answer>(.*?)</final_answer>"), 1), F.lit(-1)))


def _unquoted(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(F.trim(line), r"""^["]+|["]+$""", ""), r"""^[']+|[']+$""", ""))


def _items(text: Column) -> Column:
    return F.transform(F.split(text, r"\r\n|\n|\r"), lambda x: F.trim(F.regexp_replace(F.trim(x), r"^(?:\d+\s*[.)]|[-*•])\s*", "")))


def sub_queries(text: Column, most: int = 3) -> Column:
    """Lines without bullets, numbers and quotes; the first `most` that aren't empty."""
    return F.slice(F.filter(F.transform(_items(text), _unquoted), lambda x: x != ""), 1, most)


def generated_questions(text: Column) -> Column:
    return F.filter(F.transform(_items(text), _unquoted), lambda x: x != "")


def statements(text: Column) -> Column:
    """Lines without bullets and numbers; lines that say none are left out."""
    return F.filter(_items(text), lambda x: (x != "") & ~F.rlike(x, F.lit(r"(?i)^\s*none\s*\.?\s*$")))


def next_query(text: Column) -> Column:
    """What follows the first marker on its line, unquoted; NULL if nothing does."""
    return F.nullif(_unquoted(F.regexp_extract(text, r"NEXT_QUERY:[^\S\n]*([^\n]*)", 1)), F.lit(""))


def split_reasoning(text: Column, reasoning: Column) -> Column:
    """struct(answer, trace): a separate reasoning field, else an inline block, else what stands before a lone closing tag."""
    block = F.regexp_extract(text, r"(?is)<think>(.*?)</think>", 1)
    has_block, has_close = F.rlike(text, F.lit(r"(?is)<think>.*?</think>")), F.rlike(text, F.lit(r"(?i)</think>"))
    given = F.coalesce(reasoning != "", F.lit(False))
    before = F.regexp_extract(text, r"(?is)^(.*?)</think>", 1)
    answer = F.when(given, F.trim(text)).when(has_block, F.trim(F.concat(F.regexp_extract(text, r"(?is)^(.*?)<think>", 1), F.regexp_extract(text, r"(?is)<think>.*?</think>(.*)$", 1))))
    answer = answer.when(has_close, F.trim(F.regexp_extract(text, r"(?is)^.*?</think>(.*)$", 1))).otherwise(F.trim(text))
    trace = F.when(given, F.trim(reasoning)).when(has_block, F.nullif(F.trim(block), F.lit(""))).when(has_close, F.nullif(F.trim(before), F.lit("")))
    return F.struct(answer.alias("answer"), trace.alias("trace"))


def rubric_score(text: Column) -> Column:
    return F.nullif(F.regexp_extract(text, r"(?i)<score>\s*([0-4])\s*</score>", 1), F.lit("")).cast("int")


def reply_label(text: Column) -> Column:
    up = F.upper(text)
    return F.when(up.contains("ANSWER"), "answer").when(up.contains("REFUSAL"), "refusal").when(up.contains("UNPARSEABLE"), "unparseable")


def verdicts(text: Column, n: Column) -> Column:
    """One boolean per statement; NULL unless exactly the numbers 1 to n have one. The last of repeated numbers counts."""
    lines = F.filter(F.split(text, r"\r\n|\n|\r"), lambda x: F.rlike(x, F.lit(r"^\s*\d+\s*[:.)-]\s*[01]\b")))
    pairs = F.transform(lines, lambda x: F.struct(F.regexp_extract(x, r"^\s*(\d+)", 1).cast("int").alias("k"), (F.regexp_extract(x, r"^\s*\d+\s*[:.)-]\s*([01])\b", 1) == "1").alias("v")))
    numbers = F.array_sort(F.array_distinct(F.transform(pairs, lambda p: p["k"])))
    last = lambda i: F.element_at(F.filter(pairs, lambda p: p["k"] == i), -1)["v"]
    wanted = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    return F.when(numbers == wanted, F.transform(wanted, last))


def selected_sentences(text: Column, n: Column) -> Column:
    found = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+)"), 1), lambda x: x.try_cast("int"))
    kept = F.array_sort(F.array_distinct(F.filter(found, lambda i: i.between(1, n))))
    return F.when(F.rlike(F.trim(text), F.lit(r"(?i)^\s*none\s*\.?\s*$")), F.array().cast("array<int>")).otherwise(kept)


def sentences(text: Column) -> Column:
    """Sentences that end in . ! ? before white space and a capital, digit, quote or bracket. (F.trim itself would take an element's index for the characters to trim.)"""
    return F.filter(F.transform(F.split(F.trim(text), r"""(?<=[.!?])\s+(?=[A-Z0-9"'(\[])"""), lambda s: F.trim(s)), lambda x: x != "")


def claim_sentence(passage: Column, answer: Column) -> Column:
    """First sentence that contains the answer anywhere, in any case; NULL without one."""
    hit = let(F.lower(F.trim(answer)), lambda needle: F.filter(F.split(passage, r"(?<=[.!?])\s+"), lambda s: (needle != "") & F.contains(F.lower(s), needle)))
    return F.trim(F.get(hit, F.lit(0)))


def aligned_sentence(generated: Column, premise: Column) -> Column:
    """The sentence most similar to the premise by word sets, the first of equals; the first 400 characters of a text without sentences."""
    parts = F.filter(F.transform(F.split(generated, r"(?<=[.!?])\s+"), lambda s: F.trim(s)), lambda x: x != "")
    wanted = F.array_distinct(lower_words(premise))
    scored = let(wanted, lambda w: F.transform(parts, lambda s, i: F.struct(jaccard(F.array_distinct(lower_words(s)), w).alias("j"), (-i).alias("i"), s.alias("s"))))
    return F.when(F.size(parts) == 0, F.substring(generated, 1, 400)).when(F.size(wanted) == 0, F.get(parts, F.lit(0))).otherwise(F.array_max(scored)["s"])


def answer_window(text: Column, answer: Column, most: int) -> Column:
    """At most `most` words around the answer's first occurrence; the whole text if it is short; NULL if the answer isn't there, or not whole in a window that begins with it.

    A text without the answer isn't split; one with it is split once, and what precedes the answer once more if the text is long.
    """

    def around(w: Column, needle: Column, before: Column) -> Column:
        start = F.greatest(F.lit(0), before - F.floor((most - F.size(words(needle))) / 2).cast("int"))
        cut = lambda s: F.array_join(F.slice(w, s + 1, F.lit(most)), " ")
        holding = lambda x: F.when(F.contains(F.lower(x), needle), x)
        return F.coalesce(let(cut(start), holding), let(cut(before), holding))

    def found(needle: Column) -> Column:
        at = F.instr(F.lower(text), needle)
        window = lambda w, k: F.when(F.size(w) <= most, F.array_join(w, " ")).otherwise(let(F.size(words(F.substring(text, F.lit(1), k - 1))), lambda before: around(w, needle, before)))
        return F.when(needle != "", let(at, lambda k: F.when(k > 0, let(words(text), lambda w: window(w, k)))))

    return let(F.lower(F.trim(answer)), found)


def context_windows(text: Column, answer: Column, most: int, windows: int = 6, least: int = 50) -> Column:
    """Successive windows of `most` words, without those shorter than `least` words or containing the answer; the first `windows` of them."""

    def cut(w: Column) -> Column:
        starts = F.when(F.size(w) >= max(least, 1), F.sequence(F.lit(0), F.size(w) - 1, F.lit(most))).otherwise(F.array().cast("array<int>"))
        parts = F.filter(F.transform(starts, lambda s: F.slice(w, s + 1, F.lit(most))), lambda p: F.size(p) >= least)
        return F.transform(parts, lambda p: F.array_join(p, " "))

    joined = let(words(text), cut)
    return F.slice(let(F.lower(F.trim(answer)), lambda needle: F.filter(joined, lambda x: (needle == "") | ~F.contains(F.lower(x), needle))), 1, windows)


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), text, F.lit(" "))


def distinctive_parts(answer: Column) -> Column:
    """Normalised words of a multi-word answer that could name it alone: five letters or more, capitalised or in an upper-case answer, not common."""
    raw = words(answer)
    part = lambda r: F.regexp_replace(r, "[^A-Za-z']", "")
    upper = (F.upper(answer) == answer) & (F.lower(answer) != answer)
    good = lambda r: (F.length(part(r)) >= 5) & ~F.contains(part(r), F.lit("'")) & (F.rlike(r, F.lit(r"^\p{Lu}")) | upper) & ~F.lower(part(r)).isin(*COMMON_ANSWER_WORDS)
    return F.when(F.size(raw) >= 2, F.transform(F.filter(raw, good), lambda r: F.lower(part(r)))).otherwise(F.array().cast("array<string>"))


def states_answer(text: Column, answer: Column) -> Column:
    """Whether a distractor gives the answer away: whole, as an inverted two-word name, or by a distinctive part, between blanks of the match form."""
    hay, needle = _padded(match_form(text)), match_form(answer)
    raw = words(answer)
    name = (F.size(raw) == 2) & F.forall(raw, lambda t: F.rlike(t, F.lit(r"^\p{L}+$")))
    inverted = match_form(F.array_join(F.reverse(raw), " "))
    whole = F.contains(hay, _padded(needle)) | (name & (inverted != needle) & F.contains(hay, _padded(inverted)))
    return F.coalesce((needle != "") & (whole | F.exists(distinctive_parts(answer), lambda p: F.contains(hay, _padded(p)))), F.lit(False))


def alnum_tokens(text: Column) -> Column:
    """Runs of ASCII letters, digits and apostrophes in lower case."""
    return F.transform(F.regexp_extract_all(text, F.lit("([A-Za-z0-9']+)"), 1), F.lower)


def ngrams(tokens: Column, n: int) -> Column:
    """Distinct n-grams joined by blanks; none for short texts."""
    if n <= 0:
        raise ValueError("n must be positive")
    firsts = lambda t: F.slice(t, F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(0)))
    return F.array_distinct(let(tokens, lambda t: F.transform(firsts(t), lambda x, i: F.concat_ws(" ", x, *[F.get(t, i + j) for j in range(1, n)]))))


def numbered(passages: Column) -> Column:
    """Texts as numbered blocks, separated by blank lines."""
    return F.array_join(F.transform(passages, lambda p, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), p)), "\n\n")


def snippet(text: Column, most: int = 240) -> Column:
    """The text with single blanks, cut to `most` characters, the last of which is then an ellipsis."""
    body = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)\s+", " "))
    return F.when(F.length(body) <= most, body).otherwise(F.concat(F.substring(body, 1, most - 1), F.lit("…")))


def number_word(token: Column) -> Column:
    names = ("zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine")
    spelt = reduce(lambda c, k: c.when(F.lower(token) == names[k], k), range(1, 10), F.when(F.lower(token) == names[0], 0))
    return F.coalesce(spelt, token.try_cast("int"))
