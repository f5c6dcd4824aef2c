"""Text expressions shared by retrieval and response operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def long_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]{3,}"), F.lit(0))


def sentences(text: Column) -> Column:
    """Parts between white space that follows . ! or ?, trimmed, without blanks."""
    parts = F.split(text, r"(?<=[.!?])\s+")
    return F.filter(F.transform(parts, lambda s: F.regexp_replace(s, r"^\s+|\s+$", "")), lambda s: s != "")


#: Words without evidential weight.
FILLER = (
    "the", "and", "for", "that", "this", "with", "from", "have", "has", "had", "are", "was", "were", "been", "being", "will", "would", "should",
    "could", "can", "may", "might", "must", "not", "but", "its", "their", "there", "here", "then", "than", "when", "where", "which", "who", "whom",
    "whose", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "only", "own", "same", "too", "very", "just",
    "also", "into", "over", "under", "about", "after", "before", "because", "while", "during", "against", "between", "through", "above", "below",
    "down", "out", "off", "again", "further", "once", "you", "your", "they", "them", "our", "ours", "use", "used", "using", "make", "makes", "made",
    "need", "needs", "likely", "probable", "probably", "appears", "seems", "suggests", "indicates", "consider",
)


def content_words(text: Column) -> Column:
    """Distinct words of three characters or more that aren't filler."""
    return F.array_except(F.array_distinct(long_words(text)), F.array(*[F.lit(w) for w in FILLER]))


def clean_markdown(text: Column) -> Column:
    """Without front matter, template shortcodes and comments; runs of blank lines become one."""
    body = F.regexp_replace(text, r"(?s)\A---\n.*?\n---\n", "")
    body = F.regexp_replace(body, r"(?s)\{\{[<%].*?[>%]\}\}", "")
    body = F.regexp_replace(body, r"(?s)<!--.*?-->", "")
    return F.regexp_replace(F.regexp_replace(body, r"\n{3,}", "\n\n"), r"^\s+|\s+$", "")


def title(text: Column) -> Column:
    """The front matter's title, else the first heading; null if neither."""
    front = F.regexp_extract(text, r"(?s)\A---\n(.*?)\n---\n", 1)
    named = F.regexp_extract(front, r"""(?m)^title:\s*["']?(.*?)["']?\s*$""", 1)
    return F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.regexp_extract(text, r"(?m)^# +(.+?)\s*$", 1), F.lit("")))


def json_payload(text: Column) -> Column:
    """The JSON in a reply: a fenced block's, else from the first brace to the last, else the trimmed text."""
    fenced = F.nullif(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)\s*```", 1), F.lit(""))
    braced = F.nullif(F.regexp_extract(text, r"(?s)\{.*\}", 0), F.lit(""))
    return F.coalesce(fenced, braced, F.trim(text))


def one_of(text: Column, rules: dict[str, str], default: str) -> Column:
    """The answer of the first rule whose key the text holds."""
    out = None
    for key, answer in rules.items():
        out = F.when(text.contains(key), answer) if out is None else out.when(text.contains(key), answer)
    return F.lit(default) if out is None else out.otherwise(default)
