"""Text functions as Column expressions; none of them leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ASCII punctuation, stop words, the chunk budget, the vocabulary of entity types and importance words.
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
STOP_WORDS = ("a", "an", "the", "and", "but", "or", "is", "are", "was", "were")
BLANK = r"[\s\p{Z}]+"
ANSWER_MARK = "FINAL_ANSWER_TEXT:"
BUDGET = ((1, 2), (3, 3), (5, 4), (10, 5), (20, 6), (40, 8), (80, 10), (100, 12), (120, 15))
TYPES = {
    "PERSON": ("PEOPLE", "INDIVIDUAL", "HUMAN", "PERSONAL"),
    "ORG": ("ORGANIZATION", "COMPANY", "INSTITUTION", "CORPORATION", "AGENCY", "GROUP"),
    "LOC": ("LOCATION", "PLACE", "GEOGRAPHICAL", "GEOGRAPHY", "AREA", "REGION", "COUNTRY", "CITY"),
    "CONCEPT": ("IDEA", "THEORY", "PRINCIPLE", "METHODOLOGY", "METHOD", "TECHNIQUE", "APPROACH"),
    "DATE": ("TIME", "PERIOD", "YEAR", "MONTH", "DAY", "DATETIME", "TEMPORAL"),
    "EVENT": ("HAPPENING", "OCCURRENCE", "INCIDENT", "OCCASION"),
    "PRODUCT": ("SERVICE", "OFFERING", "ITEM", "GOOD", "MERCHANDISE"),
    "WORK": ("BOOK", "MOVIE", "FILM", "PUBLICATION", "ARTWORK", "CREATION"),
    "QUANTITY": ("MEASUREMENT", "NUMBER", "AMOUNT", "VALUE", "METRIC"),
    "MISC": ("MISCELLANEOUS", "OTHER", "UNKNOWN", "VARIOUS"),
}
HIGH_WORDS = ("high", "important", "critical", "key", "essential")
LOW_WORDS = ("low", "minor", "minimal")
NO_PREVIEW = "No text preview available"


def blank(text: Column) -> Column:
    """Whether a text is null, empty or white space only."""
    return text.isNull() | (F.regexp_replace(text, BLANK, "") == "")


def tokens(text: Column) -> Column:
    """Normalised tokens: small letters, ASCII punctuation deleted, split at white space, stop words dropped; [] for null."""
    bare = F.translate(F.lower(F.coalesce(text, F.lit(""))), PUNCTUATION, "")
    return F.filter(F.split(bare, BLANK), lambda w: (w != "") & ~w.isin(*STOP_WORDS))


def normalize(text: Column) -> Column:
    return F.array_join(tokens(text), " ")


def md5_hex(text: Column) -> Column:
    return F.md5(F.coalesce(text, F.lit("")))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, rounded down; 0 for null."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4).cast("int")


def word_count(text: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != ""))


def hop(identifier: Column) -> Column:
    """The number before ``hop_`` at the start of an id, else 0."""
    return F.coalesce(F.nullif(F.regexp_extract(identifier, r"^(\d+)hop_", 1), F.lit("")).try_cast("int"), F.lit(0))


def entity_text(text: Column, description: Column) -> Column:
    """What is embedded of an entity: its text, with a description if there is one."""
    return F.concat(text, F.when(description != "", F.concat(F.lit(": "), description)).otherwise(F.lit("")))


def preview(text: Column, size: int = 150) -> Column:
    return F.when(text.isNull() | (text == ""), F.lit(NO_PREVIEW)).otherwise(F.concat(F.substring(text, 1, size), F.lit("...")))


def stripped(text: Column) -> Column:
    return F.regexp_replace(text, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")


def parse_answer(text: Column) -> Column:
    """What follows the first answer mark, else the last line that is not blank, else the stripped text; '' for null."""
    text = F.coalesce(text, F.lit(""))
    at = F.instr(text, ANSWER_MARK)
    lines = F.filter(F.transform(F.split(text, "\n"), stripped), lambda line: line != "")
    return F.when(at > 0, stripped(F.substring(text, at + len(ANSWER_MARK), F.length(text)))).otherwise(F.coalesce(F.try_element_at(lines, F.lit(-1)), F.lit("")))


def canonical_type(text: Column) -> Column:
    """The entity type of a free spelling: an exact name first, else the first group with a spelling contained in it."""
    upper = F.upper(F.coalesce(text, F.lit("")))
    out = F.when(upper == "", F.lit("MISC"))
    for name in TYPES:
        out = out.when(upper == name, F.lit(name))
    for name, spellings in TYPES.items():
        hit = F.lit(False)
        for s in spellings:
            hit = hit | F.contains(upper, F.lit(s))
        out = out.when(hit, F.lit(name))
    return out.otherwise(F.lit("MISC"))


def canonical_importance(text: Column) -> Column:
    """1 to 5 from a free value: whole numbers in range, words, the first digits clamped, else 3."""
    low = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    digits = F.regexp_extract(low, r"\d+", 0)
    number = F.least(F.greatest(F.substring(digits, 1, 9).try_cast("int"), F.lit(1)), F.lit(5))
    number = F.when(F.length(digits) > 9, F.lit(5)).otherwise(number)
    return F.when(low == "", F.lit(3)).when(low.isin(*HIGH_WORDS), F.lit(5)).when(low.isin(*LOW_WORDS), F.lit(1)).when(digits != "", number).otherwise(F.lit(3))


def salvage_json(text: Column) -> Column:
    """Entities of a model's response: the JSON array in it, cleaned; an empty array where there is none.

    Elements that are no objects or have no text are dropped; a missing type becomes MISC, a missing description '',
    an importance that is missing, no number or outside 1..5 becomes 3.
    """
    body = F.regexp_extract(F.coalesce(text, F.lit("")), r"(?s)\[.*\]", 0)
    parsed = F.from_json(F.nullif(body, F.lit("")), "array<string>")
    shape = "text string, type string, description string, importance_score string"
    items = F.transform(F.coalesce(parsed, F.array().cast("array<string>")), lambda e: F.from_json(e, shape))
    whole = F.filter(items, lambda e: e.isNotNull() & F.coalesce(e["text"] != "", F.lit(False)))

    def clean(e: Column) -> Column:
        score = e["importance_score"].try_cast("double")
        kind = F.coalesce(F.nullif(e["type"], F.lit("")), F.lit("MISC"))
        return F.struct(e["text"].alias("text"), kind.alias("type"), F.coalesce(e["description"], F.lit("")).alias("description"), F.when(score.between(1, 5), score).otherwise(F.lit(3.0)).alias("importance_score"))

    return F.transform(whole, clean)


def tolerant_entities(text: Column) -> Column:
    """Entity texts of a response of any form: a JSON array of objects or strings, else ``"text": "..."`` fields, else
    quoted strings, else list items; null where nothing is found."""
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\s*```\w*\s*|\s*```\s*$", "")
    objects = F.transform(salvage_json(bare), lambda e: e["text"])
    strings = F.filter(F.coalesce(F.from_json(F.nullif(F.regexp_extract(bare, r"(?s)\[.*\]", 0), F.lit("")), "array<string>"), F.array().cast("array<string>")), lambda s: (s != "") & ~s.startswith("{"))
    fields = F.regexp_extract_all(bare, F.lit(r'"text"\s*:\s*"([^"]+)"'), F.lit(1))
    quoted = F.regexp_extract_all(bare, F.lit(r'"([^"]+)"'), F.lit(1))
    listed = F.regexp_extract_all(bare, F.lit(r"(?m)^\s*-\s+(.+)$"), F.lit(1))
    out = F.when(F.size(objects) > 0, objects)
    for found in (strings, fields, quoted, listed):
        out = out.when(F.size(found) > 0, found)
    return out


def tolerant_objects(text: Column) -> Column:
    """Entities of a response of any form as objects (text, type, description, importance_score); null where nothing is found.

    Objects keep what they tell, the first array of objects that can be read counts; bare texts get the defaults.
    """
    bare = F.regexp_replace(F.coalesce(text, F.lit("")), r"(?s)^\s*```\w*\s*|\s*```\s*$", "")
    whole = salvage_json(bare)
    # Where the span from the first to the last bracket is no array, each bracketed span is tried.
    spans = F.transform(F.regexp_extract_all(bare, F.lit(r"(?s)(\[[^\[\]]*\])"), F.lit(1)), salvage_json)
    parts = F.element_at(F.filter(F.concat(F.array(whole), spans), lambda x: F.size(x) > 0), 1)
    texts = F.transform(tolerant_entities(text), lambda t: F.struct(t.alias("text"), F.lit("MISC").alias("type"), F.lit("").alias("description"), F.lit(3.0).alias("importance_score")))
    return F.when(F.exists(F.concat(F.array(whole), spans), lambda x: F.size(x) > 0), parts).otherwise(texts)


def chunk_budget(top_k: Column) -> Column:
    """How many chunks go into the context for a top-k: linear between the fixed points, truncated, clamped at the ends."""
    out = F.when(top_k <= BUDGET[0][0], F.lit(BUDGET[0][1]))
    for (x0, y0), (x1, y1) in zip(BUDGET, BUDGET[1:], strict=False):
        out = out.when(top_k <= x1, F.floor(F.lit(y0) + (top_k - x0) * F.lit(y1 - y0) / F.lit(x1 - x0)).cast("int"))
    return out.otherwise(F.lit(BUDGET[-1][1]))


def file_stem(path: Column) -> Column:
    """(experiment, top_k) of a result file: split at the last underscore of a name with ``top_k``, else 'unknown'."""
    stem = F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)
    marked = F.contains(stem, F.lit("top_k"))
    return F.struct(F.when(marked, F.regexp_replace(stem, r"_[^_]*$", "")).otherwise(stem).alias("experiment"), F.when(marked, F.regexp_extract(stem, r"([^_]*)$", 1)).otherwise(F.lit("unknown")).alias("top_k"))
