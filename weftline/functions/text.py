"""Text functions of tickets, commits and paths as Column expressions.

Character classes follow Unicode by default (as the tools these results are compared with do); ascii=True gives the
ASCII classes that engines with plain regular expressions share.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns that link a commit message to a ticket.
LINK_MASKS = {
    "simple": r"^[A-Z]+-\d+",
    "bracketed": r"\[([A-Z]+-\d+)\]",
    "fixed": r"[Ff]ixed\s+#(\d+)",
    "generic": r"(?:fix(?:e[sd])?|clos(?:e[sd]?)|resolv(?:e[sd]?))\s*[:#]?\s*#(\d+)",
    "broad": r"#(\d+)",
}
#: Words without meaning for matching commits, and brackets.
NOISE = r"\b(fix(es|ed)?|close[sd]?|resolve[sd]?|revert|merge|update|refactor|add(s|ed)?|remove[sd]?|bump|wip|nit|minor|style|cleanup|typo|test[s]?)\b"
BRACKETS = r"[\[\](){}<>]"
#: The common English stop words, short list of the public corpus.
STOP_WORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing don down "
    "during each few for from further had has have having he her here hers herself him himself his how i if in into is it its itself just me more most my "
    "myself no nor not now of off on once only or other our ours ourselves out over own s same she should so some such t than that the their theirs them "
    "themselves then there these they this those through to too under until up very was we were what when where which while who whom why will with you "
    "your yours yourself yourselves"
).split()
#: Fixed value: identifiers of at least one letter.
IDENTIFIER = r"\b[a-zA-Z]+[a-zA-Z0-9#_]*\b|\b[a-zA-Z0-9#_]*[a-zA-Z]+\b"
EMPTY_TASK = "empty_task"
#: A word's characters as Python's regular expressions have them: letters and numbers of any script and '_', no combining marks.
_W = r"\p{L}\p{N}_"


def extract_task_name(message: Column, mask: str = "bracketed") -> Column:
    """group 1 of the mask if it has one, else the whole match, without brackets around a key; null for none."""
    p = LINK_MASKS.get(mask, mask)
    group = 1 if "(" in p.replace("(?:", "") else 0
    hit = F.nullif(F.regexp_extract(message, p, group), F.lit(""))
    return F.regexp_replace(hit, r"^\[([A-Z]+-\d+)\]$", "$1")


def normalize_commit(message: Column, ascii: bool = False) -> Column:
    """the first line in lower case without brackets, noise words and punctuation, blanks collapsed; '' for null."""
    u, w = ("", r"\w") if ascii else ("(?U)", _W)
    noise = NOISE if ascii else rf"(?<![{w}]){NOISE[2:-2]}(?![{w}])"
    t = F.lower(F.substring_index(F.coalesce(message, F.lit("")), "\n", 1))
    t = F.regexp_replace(F.regexp_replace(t, BRACKETS, " "), noise, " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, u + rf"[^{w}\s]", " "), u + r"\s+", " "))


def upper_split(text: Column, ascii: bool = False) -> Column:
    """upper case, split at non-word characters; empty tokens at either end stay."""
    return F.split(F.upper(text), r"\W+" if ascii else f"[^{_W}]+", -1)


def tfidf_tokens(text: Column, ascii: bool = False) -> Column:
    """lower case; punctuation, digits and '_' to blanks; tokens of two characters or more that are no stop words. Nulls give no tokens."""
    u, w = ("", r"\w") if ascii else ("(?U)", _W)
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), u + rf"[^{w}\s]|\d|_", " ")
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(F.split(t, u + r"\s+"), lambda x: (F.length(x) > 1) & ~F.array_contains(stop, x))


def title_terms(title: Column) -> Column:
    """characters other than ASCII letters, digits, white space and '-' deleted, lower case, split at white space."""
    return F.filter(F.split(F.lower(F.regexp_replace(title, r"[^a-zA-Z0-9\s-]", "")), r"\s+"), lambda x: x != "")


def identifier_tokens(text: Column, least: int = 2) -> Column:
    """identifiers of the lower-cased text with `least` characters or more. A word ends at combining marks, as everywhere here."""
    edge = rf"(?:(?<=[{_W}])(?![{_W}])|(?<![{_W}])(?=[{_W}]))"
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(IDENTIFIER.replace(r"\b", edge)), 0)
    return F.filter(found, lambda x: F.length(x) >= least)


def html_clean(text: Column) -> Column:
    """tags to blanks, six entities, white space collapsed; '' for null."""
    t = F.regexp_replace(F.coalesce(text, F.lit("")), r"<[^>]+>", " ")
    for a, b in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " ")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(t, r"\s+", " "))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def file_path(path: Column) -> Column:
    """forward slashes, stripped; 'unknown' for null and empty."""
    return F.when(path.isNull() | (path == ""), "unknown").otherwise(strip(F.replace(path, F.lit("\\"), F.lit("/"))))


def module_path(path: Column) -> Column:
    """the first segment if there are several, else 'root'; '' for a leading slash."""
    p = F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/"))
    return F.when(F.instr(p, "/") > 0, F.substring_index(strip(p), "/", 1)).otherwise("root")


def root_module(path: Column) -> Column:
    """F16: first segment after slashes at either end are gone; '' if it has a dot."""
    seg = F.substring_index(F.regexp_replace(F.coalesce(path, F.lit("")), "^/+|/+$", ""), "/", 1)
    return F.when(F.contains(seg, F.lit(".")), "").otherwise(seg)


def path_parts(path: Column) -> Column:
    """the components that are not empty."""
    return F.filter(F.split(path, "/"), lambda x: x != "")


def path_prefixes(path: Column) -> Column:
    """All prefixes of a path, shortest first; none for a path without components."""
    p = path_parts(path)
    return F.when(F.size(p) > 0, F.transform(F.sequence(F.lit(1), F.size(p)), lambda k: F.array_join(F.slice(p, 1, k), "/"))).otherwise(F.array().cast("array<string>"))


def common_prefix_length(a: Column, b: Column) -> Column:
    """how many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: x.eqNullSafe(y) & x.isNotNull())
    state = F.struct(F.lit(0).alias("n"), F.lit(True).alias("on"))
    out = F.aggregate(same, state, lambda s, e: F.struct((s["n"] + F.when(s["on"] & e, 1).otherwise(0)).alias("n"), (s["on"] & e).alias("on")))
    return F.when(a.isNull() | b.isNull(), 0).otherwise(out["n"])


def short_name(name: Column, limit: int = 52) -> Column:
    """names longer than limit end in '_' and eight digits of their MD5."""
    return F.when(F.length(name) > limit, F.concat(F.substring(name, 1, limit - 9), F.lit("_"), F.substring(F.md5(name), 1, 8))).otherwise(name)


def preview(text: Column, n: int = 200) -> Column:
    """the first n characters, with '...' if any are left out."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def json_list(text: Column, field: str = "selected_files") -> Column:
    """the array of strings under field in the first flat JSON object that has it; null for none."""
    hit = F.regexp_extract(text, r'(?s)\{[^{}]*"' + field + r'"[^{}]*\[[^\]]*\][^{}]*\}', 0)
    return F.from_json(F.nullif(hit, F.lit("")), f"struct<{field}:array<string>>")[field]


def numbered_names(text: Column) -> Column:
    """names in '1. **name**' lines, or, if there are none, in '1. `name`' lines."""
    bold = F.regexp_extract_all(text, F.lit(r"\d+\.\s+\*\*([^*]+)\*\*"), 1)
    return F.when(F.size(bold) > 0, bold).otherwise(F.regexp_extract_all(text, F.lit(r"\d+\.\s+`([^`]+)`"), 1))


def confidence(text: Column) -> Column:
    """the number after 'confidence', 50 if there is none."""
    n = F.regexp_extract(text, r"(?i)confidence[:\s]+(\d+)%?", 1)
    return F.coalesce(F.nullif(n, F.lit("")).cast("double"), F.lit(50.0))


def list_section(text: Column, section: str) -> Column:
    """items ('-' or '•') of the lines after the first line that names the section, up to the first other line."""
    body = F.regexp_extract(text, r"(?is)(?:^|\n)[^\n]*" + section + r"[^\n]*\n(?:(?=\s*(?:\*\*|\n))[^\n]*\n)*((?:\s*[-•][^\n]*(?:\n|$))+)", 1)
    items = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s*[-•]+", ""))), lambda x: x != "")
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit("(None specified)")))


def head_lines(text: Column, n: int) -> Column:
    """the first n lines."""
    return F.array_join(F.slice(F.split(text, "\n"), 1, n), "\n")


def concat_fields(*cols: Column) -> Column:
    """Fields joined by a blank, nulls as empty."""
    return F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in cols])


def combine_fields(*cols: Column) -> Column:
    """Stripped fields that are not empty joined by a blank, 'empty_task' for none."""
    parts = F.filter(F.array(*[strip(F.coalesce(c, F.lit(""))) for c in cols]), lambda x: x != "")
    return F.coalesce(F.nullif(F.array_join(parts, " "), F.lit("")), F.lit(EMPTY_TASK))


def relevance(score: Column) -> Column:
    """P15"""
    return F.when(score >= 0.7, "High").when(score >= 0.5, "Medium").otherwise("Low")
