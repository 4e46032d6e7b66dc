"""String expressions. Sizes are UTF-8 bytes unless a name says otherwise; null in, null out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ELLIPSIS = "…"
#: Wrapper tags that harnesses add to a prompt; fixed values.
WRAPPER_TAGS = (
    "system-reminder",
    "ide_selection",
    "ide_opened_file",
    "user_info",
    "environment_details",
    "local-command-stdout",
    "command-name",
    "command-message",
    "command-args",
    "timestamp"
)
#: Prefixes of text that a harness wrote; fixed values.
ARTIFACT_PREFIXES = ("API Error", "Caveat: The messages below", "[Request interrupted", "[Tool ")
#: Words that say nothing in a rule; fixed values.
STOPWORDS = tuple(
    "a all always an and any are as at be been but by can cannot could did do does each ensure for from had has have how in instead into is it its may must never no not of on one or ought our over per rather shall should so than that the their then these they this those to was we were what when which why will with would".split()
)
#: Values that stand for no value; fixed values, case counts.
EMPTY_WORDS = ("N/A", "n/a", "None", "none", "null", "-", "unknown")


def let(value: Column, f) -> Column:
    """f(value) with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _whole_characters(raw: Column) -> Column:
    """The bytes as text, without an unfinished character at their end."""
    shorter = lambda k: F.substring(raw, F.lit(1), F.octet_length(raw) - k).cast("string")
    return F.coalesce(*[F.when(F.is_valid_utf8(shorter(k)), shorter(k)) for k in range(4)], F.lit(""))


def truncate(text: Column, size: int | Column) -> Column:
    """text if it has at most size bytes, else its longest prefix of whole characters within size bytes and an ellipsis."""
    size = F.lit(size) if isinstance(size, int) else size
    prefix = let(F.substring(F.encode(text, "UTF-8"), F.lit(1), size), _whole_characters)
    return F.when(text.isNull() | (F.octet_length(text) <= size), text).otherwise(F.concat(prefix, F.lit(ELLIPSIS)))


def truncate_lines(text: Column, size: int, appendix: Column | None = None) -> Column:
    """text if it fits size bytes, else cut at the last line end within size bytes (if there is one), with the appendix after it."""
    head = F.regexp_replace(truncate(text, size), f"{ELLIPSIS}$", "")
    whole = F.when(F.instr(head, "\n") > 0, F.regexp_replace(head, r"\n[^\n]*\z", "")).otherwise(head)
    return F.when(text.isNull() | (F.octet_length(text) <= size), text).otherwise(F.concat(whole, appendix) if appendix is not None else whole)


def collapse(text: Column) -> Column:
    """Runs of white space (any of Unicode's) become one space; none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def trimmed(text: Column) -> Column:
    """Without white space at the ends."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def remove_tag(text: Column, tag: str) -> Column:
    """Without <tag>...</tag>; an unclosed tag takes the rest of the text along."""
    return F.regexp_replace(text, rf"(?s)<{tag}>.*?(</{tag}>|\z)", "")


def strip_wrappers(text: Column) -> Column:
    """A prompt as its author typed it: no wrapper tags, query tags unwrapped."""
    bare = text
    for tag in WRAPPER_TAGS:
        bare = remove_tag(bare, tag)
    return trimmed(F.when(F.contains(text, F.lit("<")), F.regexp_replace(bare, "</?user_query>", "")).otherwise(text))


def unwrap_query(text: Column) -> Column:
    """What stands inside the first query envelope; '' without one."""
    return trimmed(F.regexp_extract(text, r"(?s)<user_query>(.*?)(</user_query>|\z)", 1))


def is_artifact(text: Column) -> Column:
    """Whether a harness wrote the text."""
    found = F.lit(False)
    for prefix in ARTIFACT_PREFIXES:
        found = found | text.startswith(prefix)
    return found


def fence(text: Column, tag: str) -> Column:
    """text whose closing delimiter of a prompt section can't end the section."""
    return F.replace(text, F.lit(f"</{tag}>"), F.lit(f"<\\/{tag}>"))


def short(text: Column) -> Column:
    """The first 8 characters of an id."""
    return F.left(text, F.lit(8))


def slug(path: Column, drop_lead: bool = False) -> Column:
    """A path as a directory name: everything but ASCII letters and digits becomes a dash."""
    name = F.regexp_replace(path, "[^A-Za-z0-9]", "-")
    return F.regexp_replace(name, "^-", "") if drop_lead else name


def sanitize_id(text: Column) -> Column:
    """An id that is safe in a file name, at most 64 characters; 'unnamed' if nothing is left."""
    return F.coalesce(F.nullif(F.left(F.regexp_replace(text, "[^A-Za-z0-9_-]", "-"), F.lit(64)), F.lit("")), F.lit("unnamed"))


def split_list(text: Column, mark: str = ",") -> Column:
    """The trimmed, non-empty items of a list."""
    return F.filter(F.transform(F.split(text, mark), trimmed), lambda x: x != "")


def first_line(text: Column) -> Column:
    """The first line that is not blank, trimmed; '' without one."""
    return F.coalesce(F.try_element_at(split_list(text, "\n"), F.lit(1)), F.lit(""))


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def relative(path: Column, root: Column) -> Column:
    """path below root, else as it is; a leading ./ goes."""
    inside = F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substring(path, F.length(root) + 2, F.length(path))).otherwise(path)
    return F.regexp_replace(inside, r"^(\./)+", "")


def plural(n: Column, one: str, many: str) -> Column:
    return F.concat(n.cast("string"), F.lit(" "), F.when(n == 1, one).otherwise(many))


def has_key(line: Column, key: str) -> Column:
    """Whether a line starts with 'key:', in any letter case."""
    return F.startswith(F.lower(line), F.lit(key.lower() + ":"))


def value_of(line: Column, key: str) -> Column:
    """What follows the key and its colon."""
    return trimmed(F.substring(line, len(key) + 2, 1 << 30))


def nonempty(text: Column, default: Column | str | None = None) -> Column:
    """text, or the default where it is null or ''."""
    other = F.lit(default) if isinstance(default, str) or default is None else default
    return F.coalesce(F.nullif(text, F.lit("")), other)


def clean_value(text: Column, size: int) -> Column:
    """Single-spaced and truncated; '' for words that stand for no value."""
    flat = collapse(F.coalesce(text, F.lit("")))
    return F.when(flat.isin(*EMPTY_WORDS), "").otherwise(truncate(flat, size))


def message_text(subject: Column, body: Column) -> Column:
    """A commit's whole message."""
    return F.when(F.coalesce(body, F.lit("")) == "", subject).otherwise(F.concat_ws("\n\n", subject, body))


def message_digest(message: Column) -> Column:
    """Hash of a message that ignores comment lines, trailing blanks and blank lines at the ends."""
    plain = F.regexp_replace(F.regexp_replace(message, r"(?m)^#.*(\n|\z)", ""), r"(?m)[ \t\r]+$", "")
    return F.sha2(F.regexp_replace(F.regexp_replace(plain, r"\n{3,}", "\n\n"), r"^\n+|\n+$", ""), 256)


def split_comment(message: Column) -> Column:
    """struct(body, tail): tail is the trailing block of comment lines (and blanks between them)."""
    tail = F.regexp_extract(message, r"(?s)((?:(?:^|(?<=\n))(?:#[^\n]*)?(?:\n|\z))+)\z", 1)
    has = tail.rlike(r"(?m)^#")
    return F.struct(F.when(has, F.left(message, F.length(message) - F.length(tail))).otherwise(message).alias("body"), F.when(has, tail).otherwise("").alias("tail"))


def truthy(text: Column) -> Column:
    return F.coalesce(F.lower(trimmed(text)).isin("1", "true", "yes", "on"), F.lit(False))


# --- words of rules -------------------------------------------------------------------------


def singular(word: Column) -> Column:
    """A plural's crude singular: ies to y, es and s dropped; short words and ss stay."""
    n = F.length(word)
    return (
        F.when(word.endswith("ies") & (n > 4), F.concat(F.left(word, n - 3), F.lit("y")))
        .when(word.endswith("es") & ~word.endswith("ses") & (n > 3), F.left(word, n - 2))
        .when(word.endswith("s") & ~word.endswith("ss") & (n > 3), F.left(word, n - 1))
        .otherwise(word)
    )


def tokens(text: Column) -> Column:
    """The distinct words of a rule in singular, sorted, without stopwords."""
    words = F.split(F.lower(text), "[^a-z0-9а-яё]+")
    return F.array_sort(F.array_distinct(F.transform(F.filter(words, lambda w: (w != "") & ~w.isin(*STOPWORDS)), singular)))


def numbers(words: Column) -> Column:
    return F.filter(words, lambda w: w.rlike("^[0-9]+$"))


def jaccard(a: Column, b: Column) -> Column:
    """Shared share of two word sets; 0 where both are empty."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))), F.lit(0.0))


def same_words(a: Column, b: Column, ta: Column, tb: Column, threshold: float) -> Column:
    """Whether two texts (and their tokens) say the same: equal numbers, and equal text if either is short, else enough shared words."""
    short_ = (F.size(ta) < 3) | (F.size(tb) < 3)
    return (trimmed(a) != "") & (trimmed(b) != "") & (numbers(ta) == numbers(tb)) & F.when(
        short_, F.lower(trimmed(a)) == F.lower(trimmed(b))
    ).otherwise(jaccard(ta, tb) >= threshold)


def heavy_shared(ta: Column, tb: Column) -> Column:
    """Whether a long word or one with a digit is shared."""
    return F.exists(F.array_intersect(ta, tb), lambda w: (F.octet_length(w) >= 6) | w.rlike("[0-9]"))


def same_rule(a: Column, b: Column, ta: Column, tb: Column, dup: float = 0.55, soft: float = 0.32) -> Column:
    """Whether two rules are one: alike enough, or somewhat alike with a heavy word in common."""
    return same_words(a, b, ta, tb, dup) | (same_words(a, b, ta, tb, soft) & heavy_shared(ta, tb))
