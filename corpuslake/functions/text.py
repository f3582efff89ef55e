"""Text functions: identifiers, queries, cleaning, quality, names.

All are column expressions that stay in the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: replacements, lists and identifier patterns of the text rules
LIGATURES = {"ﬁ": "fi", "ﬂ": "fl", "ﬀ": "ff", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "ft", "ﬆ": "st"}
STOPWORDS = ("a", "an", "the", "of", "for", "in", "on", "to", "and", "or", "about", "with", "using", "based", "via", "into", "is", "are", "what", "how")
EDGE_MARKS = r""".,;:!?"'()"""

MODERN_ID = r"(?U)(?<![\w.])\d{4}\.\d{4,5}(?:v\d+)?(?![\w.])"
LEGACY_ID = r"(?U)(?<![\w./])[a-zA-Z-]+(?:\.[a-zA-Z]{2,3})?/\d{7}(?:v\d+)?(?!\w)"
ID_URL = r"(?i)(?:https?://)?(?:www\.)?(?:export\.)?arxiv\.org/(?:abs|pdf)/([^\s?#]+)"
CONCLUDING = r"(?i)^\s*(?:\d+(?:\.\d+)*\s+)?(conclusion|conclusions|discussion|results)\b"


#: White space of any script, as a class of Java's patterns: no-break, thin and wide spaces, line separators.
SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def collapse(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def some(c: Column) -> Column:
    """Null for an empty string."""
    return F.nullif(c, F.lit(""))


# identifiers and queries


def normalise_id(c: Column) -> Column:
    """A paper id without slashes at its ends or a version; an archive in front of a slash is lower-cased."""
    bare = F.regexp_replace(F.regexp_replace(strip(c), r"^[\s/]+|[\s/]+$", ""), r"v\d+$", "")
    head = F.substring_index(bare, "/", 1)
    return F.when(F.contains(bare, F.lit("/")), F.concat(F.lower(head), F.substring(bare, F.length(head) + 1, F.length(bare)))).otherwise(bare)


def paper_id(c: Column) -> Column:
    """The paper id in a text: of a link, else an old one (archive/number), else a new one; null if there is none."""
    link = F.regexp_replace(F.regexp_extract(c, ID_URL, 1), r"(?i)\.pdf$", "")
    found = F.coalesce(some(link), some(F.regexp_extract(c, LEGACY_ID, 0)), some(F.regexp_extract(c, MODERN_ID, 0)))
    return normalise_id(found)


def query_terms(c: Column) -> Column:
    """Words of a topic that matter: marks at their ends cut off, lower case, no stop words."""
    cut = "[" + "".join("\\" + m for m in EDGE_MARKS) + "]+"
    words = F.transform(F.split(collapse(c), " "), lambda w: F.lower(F.regexp_replace(w, f"^{cut}|{cut}$", "")))
    return F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS))


def boolean_query(c: Column) -> Column:
    """A topic as ``all:"two words" AND all:word``: its terms in pairs."""
    terms = query_terms(c)
    pairs = F.transform(F.sequence(F.lit(0), F.size(terms) - 1, F.lit(2)), lambda i: F.slice(terms, i + 1, 2))
    quoted = F.transform(pairs, lambda p: F.when(F.size(p) > 1, F.concat(F.lit('all:"'), F.array_join(p, " "), F.lit('"'))).otherwise(F.concat(F.lit("all:"), p[0])))
    return F.when(F.size(terms) == 0, F.concat(F.lit('all:"'), strip(c), F.lit('"'))).otherwise(F.array_join(quoted, " AND "))


def broaden(query: Column) -> Column:
    """A wider query: one term less if there are more, and no quotes."""
    parts = F.split(query, " AND ")
    fewer = F.when(F.size(parts) > 1, F.slice(parts, 1, F.size(parts) - 1)).otherwise(parts)
    return F.replace(F.array_join(fewer, " AND "), F.lit('"'), F.lit(""))


def search_terms(query: Column) -> Column:
    """The phrases of a boolean query, lower-cased."""
    return F.transform(F.split(query, " AND "), lambda t: F.lower(F.replace(F.regexp_replace(t, "^all:", ""), F.lit('"'), F.lit(""))))


def intent(c: Column) -> Column:
    """unknown for a blank text, paper_lookup for one with an id, else topic_search."""
    return F.when(strip(F.coalesce(c, F.lit(""))) == "", "unknown").when(paper_id(c).isNotNull(), "paper_lookup").otherwise("topic_search")


# names


def slug(c: Column) -> Column:
    return F.coalesce(some(F.regexp_replace(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "-"), "^-+|-+$", "")), F.lit("section"))


def collection_name(c: Column) -> Column:
    """3 to 63 letters, digits, underscores or hyphens, with a letter or digit at both ends."""
    raw = F.substring(F.concat(F.lit("paper_"), F.regexp_replace(c, "[^A-Za-z0-9_-]", "_")), 1, 63)
    return F.regexp_replace(raw, "[^A-Za-z0-9]+$", "")


def file_name(c: Column) -> Column:
    return F.concat(F.replace(c, F.lit("/"), F.lit("_")), F.lit(".pdf"))


# cleaning and quality


def repair(c: Column) -> Column:
    """Ligatures as letters, words joined that a hyphen broke over two lines."""
    for sign, letters in LIGATURES.items():
        c = F.replace(c, F.lit(sign), F.lit(letters))
    return F.regexp_replace(c, r"(?U)(\w)-\n(\w)", "$1$2")


def is_page_number(line: Column) -> Column:
    return strip(line).rlike(r"^\p{Nd}{1,4}$")


def tidy(c: Column) -> Column:
    """Single spaces, at most one blank line in a row, none at the ends."""
    return strip(F.regexp_replace(F.regexp_replace(c, r"[ \t]+", " "), r"\n{3,}", "\n\n"))


def quality(text: Column, pages: Column) -> Column:
    """How well a text was extracted, 0 to 1: length a page, letters, the word abstract, white space.  ``text`` joins its pages with line ends."""
    n = F.length(text)
    dense = F.least(n / pages / F.lit(1500.0), F.lit(1.0))
    letters = F.length(F.regexp_replace(text, r"[^\p{L}]", "")) / n
    abstract = F.when(F.regexp_like(text, F.lit(r"(?i)\babstract\b")), 1.0).otherwise(0.0)
    spaces = F.greatest(F.lit(0.0), 1.0 - F.abs((n - F.length(F.regexp_replace(text, SPACE, ""))) / n - 0.18) / 0.18)
    score = 0.35 * dense + 0.35 * letters + 0.15 * abstract + 0.15 * spaces
    return F.when(F.coalesce(strip(text), F.lit("")) == "", 0.0).otherwise(F.round(score, 4))


def opens_conclusion(text: Column) -> Column:
    return F.regexp_like(F.substring(text, 1, 200), F.lit(CONCLUDING))


def prefix_key(c: Column, chars: int = 120) -> Column:
    """What near-duplicate passages share: their beginning in lower case with single spaces."""
    return F.substring(F.regexp_replace(strip(F.lower(c)), f"{SPACE}+", " "), 1, chars)


def keep_ends(text: Column, budget: Column) -> Column:
    """A text cut to about ``budget`` characters in its middle; the first and the last paragraph stay whole."""
    mark = "\n...[truncated]...\n"
    parts = F.filter(F.split(text, "\n\n"), lambda p: strip(p) != "")
    half = F.floor(F.greatest(budget - len(mark), F.lit(0)) / 2).cast("int")
    halves = F.when(half > 0, F.concat(F.substring(text, F.lit(1), half), F.lit(mark), F.substring(text, -half, half))).otherwise(F.substring(text, F.lit(1), budget))
    first, last = F.get(parts, F.lit(0)), F.get(parts, F.size(parts) - 1)
    room = F.greatest(budget - F.length(first) - F.length(last) - len(mark) - 4, F.lit(0))
    middle = F.substring(F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "\n\n"), F.lit(1), room)
    ends = F.concat(first, F.when(middle != "", F.concat(F.lit("\n\n"), middle)).otherwise(F.lit("")), F.lit(mark), last)
    return F.when((F.length(text) <= budget) | (budget <= 0), text).when(F.size(parts) <= 2, halves).otherwise(ends)


def pronoun_question(question: Column, previous: Column) -> Column:
    """A question of under eight words with a pronoun gets the question before it as its context."""
    short = F.size(F.split(collapse(question), " ")) < 8
    vague = F.regexp_like(question, F.lit(r"(?i)\b(it|this|that|they)\b"))
    return F.when(previous.isNotNull() & short & vague, F.concat(F.regexp_replace(question, r"[?.! ]+$", ""), F.lit(" - referring to: "), previous)).otherwise(question)


def cited_numbers(answer: Column, passages: Column) -> Column:
    """The numbers of ``[n]`` citations, each once, in order, within 1 and ``passages``."""
    numbers = F.transform(F.regexp_extract_all(answer, F.lit(r"\[(\d{1,9})\]"), 1), lambda n: n.cast("int"))
    return F.array_sort(F.array_distinct(F.filter(numbers, lambda n: (n >= 1) & (n <= passages))))


def json_candidate(response: Column) -> Column:
    """The object in a model's response: of a fenced block if there is one, from the first brace to its match.

    The match of the first brace is the first closing brace with as many opening ones before it
    as closing ones up to it, so only the pieces between closing braces are counted.
    """
    fenced = F.regexp_extract(response, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    text = F.when(F.regexp_like(response, F.lit(r"(?s)```(?:json)?\s*(.*?)\s*```")), fenced).otherwise(strip(response))
    at = F.locate("{", text)
    rest = F.substring(text, at, F.length(text))
    pieces = F.split(rest, r"\}")
    # what follows the last closing brace can't hold the match
    counted = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda x: F.struct(F.length(x).alias("n"), (F.length(x) - F.length(F.replace(x, F.lit("{"), F.lit("")))).alias("opened")))
    closed = F.aggregate(
        counted,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("depth"), F.lit(0).alias("end")),
        lambda s, x: F.struct((s["n"] + x["n"] + 1).alias("n"), (s["depth"] + x["opened"] - 1).alias("depth"), F.when((s["end"] == 0) & (s["depth"] + x["opened"] == 1), s["n"] + x["n"] + 1).otherwise(s["end"]).alias("end")),
        lambda s: s["end"],
    )
    whole = F.try_parse_json(text).isNotNull()
    return F.when(whole, text).when((at > 0) & (closed > 0), F.substring(rest, F.lit(1), closed))
