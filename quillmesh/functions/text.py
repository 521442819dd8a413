"""Column functions on texts, all inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that name nothing.
STOP = ["the", "and", "for", "this", "that", "with", "from", "are", "was", "not"]


def identifier_tokens(text: Column, stop: list[str] = STOP) -> Column:
    """Distinct identifiers of more than two characters, in lower case."""
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z_][a-z0-9_]*)"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: (F.length(w) > 2) & ~w.isin(stop)))


def word_set(text: Column, stop: list[str] | None = None) -> Column:
    found = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z0-9]{3,})"), F.lit(1))
    return F.array_distinct(F.filter(found, lambda w: ~w.isin(stop)) if stop else found)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union > 0, F.size(F.array_intersect(a, b)) / union).otherwise(F.lit(0.0))


# Openings that say nothing about what is asked.
FILLER = r"(?i)^(?:(?:please|pls|plz)\s+|can you\s+|could you\s+|would you\s+|i (?:want|need|would like) (?:you )?to\s+|help me\s+|i'm (?:trying|looking|wanting) to\s+|show me\s+|let's\s+|go ahead and\s+|i'd like (?:you )?to\s+)+"

# Intents of a question in the order in which they are tried, (pattern, intent, confidence).
INTENTS = [
    (r"\b(?:what calls|who (?:calls|imports|uses)|dependents|dependencies|callers|importers|imported by)\b", "trace", "high"),
    (r"^(?:why|reason|rationale|motivation|decision behind)\b", "rationale", "high"),
    (r"\b(?:instead of|rather than|chose|decision|trade.?off)\b", "rationale", "medium"),
    (r"\b(?:difference|compare|vs\.?|versus)\b|\bbetween .+ and\b", "compare", "high"),
    (r"\b(?:example|usage|how to use|call sites|who uses|show me how)\b", "example", "high"),
    (r"\b(?:what'?s in|overview|modules|list all|browse|contents of|what files)\b", "discover", "high"),
    (r"^(?:where|find|locate|which file|path to|definition of|show me)\b", "locate", "high"),
    (r"\b(?:find|locate|where is|definition)\b", "locate", "medium"),
    (r"\b(?:how does|what does|explain|walk me through|tell me about|describe)\b", "explain", "high"),
]
# Fixed value: words, anywhere in a question, with which a locate intent of medium confidence doesn't hold.
NOT_LOCATE = r"\b(?:how|why|explain)\b"
# What each intent's question opens with.
OPENINGS = {
    "locate": r"where is|find|locate|which file has|path to|definition of|show me",
    "explain": r"how does|what does|explain|walk me through|tell me about|describe",
    "rationale": r"why does|why is|why do|reason for|rationale for|motivation for",
    "trace": r"what calls|who calls|who imports|who uses",
    "example": r"how to use|how do i use|example of|usage of|show me how to use",
    "compare": r"compare|difference between",
    "discover": r"what'?s in|overview of|list all|contents of",
}
# Fixed value: the endings by which a word of a question is a file.
SUFFIX = r"\.(?:py|ts|tsx|js|jsx|rs|go|java|kt|rb|c|cpp|h|hpp|cs|swift|scala|sh|yaml|yml|toml|json|md)"
# Words that no search is about.
QUERY_STOP = [
    "the", "how", "does", "what", "where", "when", "why", "which", "this", "that", "with", "from", "for", "and",
    "not", "but", "can", "will", "just", "about", "into", "file", "files", "code", "function", "class", "method", "work",
    "works", "look", "explain", "show", "find", "get", "use", "uses", "handle", "handles", "module", "modules",
]

# Characters without a shape.
INVISIBLE = r"[​-‏⁠-⁤⁦-⁯﻿￹-￻]|[\x{e0000}-\x{e007f}]"

# Forms of well-known secrets.
SECRETS = {
    "aws_key": r"AKIA[0-9A-Z]{16}",
    "aws_secret": r"(?:aws_secret_access_key|aws_secret)\s*[:=]\s*['\"]?[A-Za-z0-9/+=]{40}",
    "github_token": r"gh[ps]_[A-Za-z0-9_]{36,}",
    "github_oauth": r"gho_[A-Za-z0-9_]{36,}",
    "slack_token": r"xox[bporas]-[0-9A-Za-z\-]{10,}",
    "sk_key": r"sk-[A-Za-z0-9]{20,}",
    "sk_ant_key": r"sk-ant-[A-Za-z0-9\-]{20,}",
    "google_key": r"AIza[0-9A-Za-z\-_]{35}",
    "private_key": r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----",
    "jwt": r"eyJ[A-Za-z0-9\-_]+\.eyJ[A-Za-z0-9\-_]+\.[A-Za-z0-9\-_.+/=]+",
    "generic": r"(?i)(?:api[_\-]?key|secret[_\-]?key|password|token|credential)[^=\n\r]{0,20}[:=]\s*['\"][^\s'\"]{8,}['\"]",
}

# Signs that a reply repeats planted instructions.
SUSPICIOUS = {
    "ignore_previous": r"(?i)ignore\s+(?:all\s+)?previous\s+instructions",
    "disregard": r"(?i)disregard\s+(?:all\s+)?(?:prior|previous|above)",
    "you_are_now": r"(?i)you\s+are\s+now\s+(?:a|an|in)\b",
    "new_instructions": r"(?i)new\s+instructions?\s*:",
    "system_role": r"(?i)system\s*:\s*you\s+are",
    "odd_domain": r"(?i)https?://[^\s]+\.(?:ru|cn|tk|ml|ga|cf)/",
    "shell_fetch": r"(?i)```\s*(?:bash|sh|shell|cmd|powershell)\s*\n\s*(?:curl|wget|nc|ncat)\s+",
    "code_call": r"(?i)os\.system\s*\(|subprocess\.(?:run|call|Popen)\s*\(|exec\s*\(",
}


def clean_query(q: Column, most: int = 300) -> Column:
    """Without filler in front; cut at a word's end when the last space is in the second half of what fits."""
    bare = F.trim(F.regexp_replace(F.trim(q), FILLER, ""))
    cut = F.substring(bare, 1, most)
    last = F.length(cut) - F.instr(F.reverse(cut), " ")
    whole = (F.instr(cut, " ") > 0) & (last > most // 2)
    return F.when(F.length(bare) <= most, bare).when(whole, F.substring(cut, F.lit(1), last)).otherwise(cut)


def first_intent(q: Column, what: int, default: str) -> Column:
    """The name (1) or the confidence (2) of the first intent whose pattern a question has."""
    low, out = F.lower(F.trim(q)), None
    for entry in INTENTS:
        hit = low.rlike(entry[0])
        if entry[1:] == ("locate", "medium"):
            hit = hit & ~low.rlike(NOT_LOCATE)
        out = F.when(hit, entry[what]) if out is None else out.when(hit, entry[what])
    return out.otherwise(default)


def intent(q: Column) -> Column:
    return first_intent(q, 1, "explain")


def intent_confidence(q: Column) -> Column:
    return first_intent(q, 2, "low")


def rewritten_query(q: Column, kind: Column) -> Column:
    """Without the words that gave its intent away; whole again if nothing would be left."""
    t = F.trim(q)
    out = t
    for name, opening in OPENINGS.items():
        out = F.when(kind == name, F.trim(F.regexp_replace(t, rf"(?i)^(?:{opening})\s+", ""))).otherwise(out)
    return F.when(out == "", t).otherwise(out)


def query_symbols(q: Column) -> Column:
    camel = F.regexp_extract_all(q, F.lit(r"\b([A-Z][a-z]+(?:[A-Z][a-z0-9]*)+)\b"), F.lit(1))
    snake = F.regexp_extract_all(q, F.lit(r"\b([a-z][a-z0-9]*(?:_[a-z0-9]+)+)\b"), F.lit(1))
    return F.concat(camel, snake)


def once(x: Column, use: Callable[[Column], Column]) -> Column:
    """use(x), where x is worked out once a row: a function inside of another would do so for each of its elements."""
    return F.transform(F.array(x), use)[0]


def query_signals(q: Column) -> Column:
    """paths, names, symbols and keywords of a question; what is a path, a name or a symbol is no keyword. Each part is worked out once from those before it."""
    all_paths = F.regexp_extract_all(q, F.lit(rf"(?:^|\s)((?:[\w.@-]+/)+[\w.-]+{SUFFIX})(?:\s|$)"), F.lit(1))
    bare = F.regexp_extract_all(q, F.lit(rf"(?:^|\s)([\w.-]+{SUFFIX})(?:\s|$)"), F.lit(1))

    def with_files(s: Column) -> Column:
        files = F.concat(s["paths"], s["names"])
        parts = F.flatten(F.transform(files, lambda p: F.split(p, "[/.]")))
        symbols = once(F.struct(parts.alias("parts"), query_symbols(q).alias("found")), lambda t: F.filter(t["found"], lambda x: ~F.array_contains(t["parts"], x)))
        return once(symbols, lambda found: with_symbols(s, files, found))

    def with_symbols(s: Column, files: Column, symbols: Column) -> Column:
        humps = F.flatten(F.transform(symbols, lambda x: F.split(F.trim(F.lower(F.regexp_replace(x, "([A-Z])", " $1"))), r"\s+")))
        pieces = F.flatten(F.transform(symbols, lambda x: F.split(F.lower(x), "_")))
        captured = F.concat(F.flatten(F.transform(files, lambda p: F.split(p, "[/._-]"))), humps, pieces)
        keywords = once(F.struct(captured.alias("captured"), query_keywords(q).alias("words")), lambda t: F.filter(t["words"], lambda w: ~F.array_contains(t["captured"], w)))
        return F.struct(s["paths"].alias("paths"), s["names"].alias("names"), symbols.alias("symbols"), keywords.alias("keywords"))

    found = F.struct(all_paths.alias("paths"), bare.alias("bare"))
    named = once(found, lambda s: F.struct(s["paths"].alias("paths"), F.filter(s["bare"], lambda n: ~F.exists(s["paths"], lambda p: F.endswith(p, n))).alias("names")))
    return once(named, with_files)


def query_keywords(q: Column) -> Column:
    found = F.array_distinct(F.transform(F.regexp_extract_all(q, F.lit(r"([A-Za-z]{3,})"), F.lit(1)), F.lower))
    return F.filter(found, lambda w: ~w.isin(QUERY_STOP))


def coverage(keywords: Column, content: Column) -> Column:
    hit = F.size(F.filter(keywords, lambda w: F.contains(F.lower(content), w)))
    return F.when(F.size(keywords) == 0, F.lit(1.0)).otherwise(hit / F.size(keywords))


def safe_fences(text: Column) -> Column:
    """Of three backticks or more in a row, all but two become quotation marks that open no fence."""
    return F.regexp_replace(text, "(?<=``)`", "‘")


def visible(text: Column) -> Column:
    return F.regexp_replace(text, INVISIBLE, "")


def has_invisible(text: Column) -> Column:
    return text.rlike(INVISIBLE)


def hits(text: Column, patterns: dict[str, str]) -> Column:
    """Names of the patterns found, in their order."""
    return F.filter(F.array(*(F.when(text.rlike(p), F.lit(n)) for n, p in patterns.items())), lambda x: x.isNotNull())


def warnings(text: Column, patterns: dict[str, str], around: int = 20) -> Column:
    """(name, context) of each pattern found: its first match with so many characters on both sides."""

    def one(name: str, pattern: str) -> Column:
        at = F.regexp_instr(text, F.lit(pattern)) - 1
        start = F.greatest(at - around, F.lit(0))
        context = F.substring(text, start + 1, at + F.length(F.regexp_extract(text, pattern, 0)) + around - start)
        return F.when(text.rlike(pattern), F.struct(F.lit(name).alias("name"), context.alias("context")))

    return F.filter(F.array(*(one(n, p) for n, p in patterns.items())), lambda x: x.isNotNull())


def redacted(text: Column, patterns: list[str]) -> Column:
    for p in patterns:
        text = F.regexp_replace(text, p, "[REDACTED]")
    return text


def without_urls(text: Column) -> Column:
    """Links that leave this machine become a placeholder."""
    return F.regexp_replace(text, r"(?i)https?://(?!(?:localhost|127\.0\.0\.1)(?:[:/]|$))[^\s)\]>\"']+", "[URL-REMOVED]")


def safe_output(text: Column, urls: bool = False) -> Column:
    out = visible(safe_fences(text))
    return without_urls(out) if urls else out


def digest(text: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(text, 256), 1, length)


def edge_id(kind: Column, source: Column, target: Column, more: Column | None = None) -> Column:
    return F.concat_ws(":", F.lit("edge"), kind, source, target, *([F.nullif(more, F.lit(""))] if more is not None else []))


def model_family(name: Column) -> Column:
    """Without provider, tag and version."""
    s = F.when(name.contains(":") & ~name.startswith("nomic"), F.regexp_replace(name, "^[^:]*:", "")).otherwise(name)
    return F.lower(F.regexp_replace(F.split_part(s, F.lit(":"), F.lit(1)), r"-v\d+(?:\.\d+)*$", ""))


def naming(name: Column) -> Column:
    low, up = F.lower(name), F.upper(name)
    upper_first, under = name.rlike(r"^\p{Lu}"), name.contains("_")
    return F.when(under & (name == low), "snake_case").when(under & (name == up), "UPPER_SNAKE").when(upper_first & ~under,
        "PascalCase").when(name.rlike(r"^\p{Ll}") & ~under & name.rlike(r"\p{Lu}"), "camelCase").when(name == low, "lowercase").otherwise("mixed")


def naming_violation(name: Column, kind: Column, language: Column) -> Column:
    up, down = name.rlike(r"^\p{Lu}"), name.rlike(r"^\p{Ll}")
    return (
        F.when((language == "python") & (kind == "class") & ~up, "Python classes should be PascalCase")
        .when((language == "python") & kind.isin("function", "method") & up, "Python functions should be snake_case")
        .when(language.isin("typescript", "javascript") & (kind == "class") & ~up, "JS/TS classes should be PascalCase")
        .when((language == "rust") & (kind == "function") & up, "Rust functions should be snake_case")
        .when((language == "rust") & (kind == "class") & down, "Rust structs/enums should be PascalCase")
        .otherwise("")
    )


def title_of(content: Column) -> Column:
    """The first sentence, 80 characters at most."""
    first = F.trim(F.split_part(content, F.lit("."), F.lit(1)))
    return F.when(first == "", F.substring(content, 1, 80)).when(F.length(first) > 80, F.concat(F.substring(first, 1, 77), F.lit("..."))).otherwise(first)


def excerpt(text: Column, most: int = 400) -> Column:
    """The opening, cut at the end of a paragraph where one ends in what fits."""
    cut = F.substring(text, 1, most)
    whole = F.regexp_extract(cut, r"(?s)^(.*)\n\n", 1)
    return F.when(F.length(text) <= most, text).when(whole != "", whole).otherwise(cut)


def headings(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1))


def repeats(text: Column, run: int = 30, units: int = 8) -> Column:
    """A character in a loop, or a unit of two to four."""
    return text.rlike(rf"(\S)\1{{{run},}}") | text.rlike(rf"(?s)((?!\s+)(?!(.)\2+).{{2,4}}?)\1{{{units},}}")


def stem_code(path: Column) -> Column:
    """Initials of the first three parts of the file's name, else its first three letters."""
    name = F.regexp_replace(F.substring_index(path, "/", -1), r"\.[^.]*$", "")
    parts = F.filter(F.split(name, r"[_\-]"), lambda x: x != "")
    initials = F.upper(F.array_join(F.transform(F.slice(parts, 1, 3), lambda x: F.substring(x, 1, 1)), ""))
    return F.when(F.size(parts) >= 3, initials).otherwise(F.rpad(F.upper(F.substring(name, 1, 3)), 3, "X"))


def fires(kind: str, hit: Column, text: Column, dependents: Column, pattern: str = "", most: int = 0) -> Column:
    """Whether a rule's trigger fires for a changed file; hit tells whether the file is one that the rule is about."""
    if kind in ("file_modified", "file_created"):
        return hit
    if kind == "import_added":
        lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
        return hit & F.exists(lines, lambda x: x.rlike("^(?:import|from) ") & x.rlike(pattern)) & F.lit(bool(pattern))
    if kind == "pattern_match":
        return hit & text.rlike(pattern) & F.lit(bool(pattern))
    if kind == "coupling_threshold":
        return hit & (dependents > most) & F.lit(most > 0)
    return F.lit(False)
