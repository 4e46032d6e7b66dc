"""Fragments of the checking SQL."""

from __future__ import annotations

from loomwork.functions.text import ARTIFACT_PREFIXES, EMPTY_WORDS, STOPWORDS, WRAPPER_TAGS


class Cte:
    """Named common tables: added to each other they are listed, added to a text they stand before it."""

    def __init__(self, *bodies: str):
        self.bodies = bodies

    def __add__(self, other):
        if isinstance(other, Cte):
            return Cte(*self.bodies, *other.bodies)
        return "with " + ", ".join(self.bodies) + ("" if other.startswith(",") else " ") + other


HUMAN = "coalesce(role = 'user' and not coalesce(meta, false) and text <> '', false)"
ARTIFACT = "(" + " or ".join(f"starts_with(text, '{p}')" for p in ARTIFACT_PREFIXES) + ")"
_READING = "coalesce(regexp_matches(lower(t.name), 'read|view|grep|search|glob|find|list|ls|fetch|lookup|todo|think|plan|diagnostic'), false)"
#: Every white space of Unicode, as RE2 has ASCII's only.
UNICODE_SPACE = r"[\t\n\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
RFC3339 = r"\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})"
SINGULAR = "case when ends_with(w, 'ies') and len(w) > 4 then left(w, len(w) - 3) || 'y' when ends_with(w, 'es') and not ends_with(w, 'ses') and len(w) > 3 then left(w, len(w) - 2) when ends_with(w, 's') and not ends_with(w, 'ss') and len(w) > 3 then left(w, len(w) - 1) else w end"

#: Messages without repeated rows.
M = Cte(
    "m as (select * from messages where session_key is not null and seq is not null qualify row_number() over (partition by session_key, seq order by message_id) = 1)"
)
#: The latest snapshot of each session.
LS = Cte(
    "ls as (select * from sessions where session_key is not null qualify row_number() over (partition by session_key order by updated_ts desc"
    " nulls last, cursor_bytes desc nulls last, complete desc nulls last, title desc nulls last, model desc nulls last, branch desc nulls last,"
    " cwd desc nulls last) = 1)"
)
#: Commits and entries without repeated rows.
CO = Cte("c as (select distinct * from commits)")
R = Cte(
    "r as (select * from rule_entries where sha is not null and kind is not null and pos is not null qualify row_number() over (partition by sha,"
    " kind, pos order by rule_id) = 1)"
)
#: The paths that commits touched, and that tool calls name.
CF = Cte(
    "r0 as (select * from rule_entries where sha is not null and kind is not null and pos is not null qualify row_number() over (partition by"
    " sha, kind, pos order by rule_id) = 1)",
    "cf as (select distinct sha, path from (select sha, unnest(files) as path from r0) where path <> '')"
)
TOUCHED = Cte(
    "calls as (select session_key, seq, i as tp, tools[i] as t from m, unnest(range(1, coalesce(len(tools), 0) + 1)) as u(i))",
    f"touched as (select session_key, seq, tp, j as fp, t.files[j] as file, {_READING} as reading from calls, unnest(range(1,"
    " coalesce(len(t.files), 0) + 1)) as u(j) where t.files[j] <> '')",
)
#: Raw messages as JSON, opened where a JSON string holds them.
LOG = Cte(
    "t as (select entry_id, case when json_valid(message) then case when json_type(message) = 'VARCHAR' then json_extract_string(message, '$')"
    " else message end end as j from log_entries)",
    "v as (select entry_id, j::json as v from t where j is not null and json_valid(j))",
)
SERVED = (
    R
    + CF
    + CO
    + Cte(
        "h as (select cf.path, c.sha, c.short, row_number() over (partition by cf.path order by c.ts desc nulls last, c.sha) as ord from cf join c using (sha))",
        "b as (select h.path, h.ord, h.sha, any_value(h.short) || chr(10) || string_agg('  ' || r.kind || ': ' || r.rule, chr(10) order by case"
        " when r.kind = 'reject' then 0 else 1 end, r.pos) || chr(10) as text from h join r using (sha) where h.ord <= 100 and r.rule is not null"
        " and len(list_filter(r.files, lambda f: f = h.path or split_part(f, '/', -1) = split_part(h.path, '/', -1))) > 0 group by h.path, h.ord,"
        " h.sha)",
        "n as (select *, count(*) over (partition by path) as total, sum(octet_length(encode(text))) over (partition by path order by ord rows"
        " unbounded preceding) as used from b)",
        "fit as (select * from n where used <= 10000 - octet_length(encode('Rules from ' || total || case when total = 1 then ' commit' else '"
        " commits' end || ' that bind ' || path || ':' || chr(10))) - octet_length(encode('… and ' || total || ' more for ' || path || chr(10))))",
    )
)
#: Entries of the first block of a message, by running entry and field numbers.
PARSE_TABLES = (
    CO
    + Cte(
        r"x as (select sha, concat_ws(chr(10) || chr(10), body, note) as t from c)",
        r"i as (select sha, regexp_replace(substr(t, position(regexp_extract(t, '(?m)^<[a-z][a-z0-9-]*>[ \t]*$') in t)), '^<[a-z][a-z0-9-]*>["
        r" \t]*\n?', '') as t, regexp_extract(t, '(?m)^<([a-z][a-z0-9-]*)>[ \t]*$', 1) as name from x where regexp_matches(t,"
        r" '(?m)^<[a-z][a-z0-9-]*>[ \t]*$'))",
        r"k as (select sha, case when starts_with(t, '</' || name || '>') then '' when contains(t, chr(10) || '</' || name || '>') then left(t,"
        r" position(chr(10) || '</' || name || '>' in t)) else t end as t from i)",
        r"l as (select sha, n, string_split(t, chr(10))[n] as line from k, unnest(range(1, len(string_split(t, chr(10))) + 1)) as u(n))",
        r"f as (select *, lower(regexp_extract(line, '(?i)^(reject|invariant):', 1)) as head, lower(regexp_extract(line, '(?i)^\s*(why|file):',"
        r" 1)) as sub, regexp_full_match(line, '\s*') as blank from l)",
        r"g as (select *, case when head <> '' then 'rule' else sub end as field from f)",
        r"e as (select *, sum(case when field <> '' or blank then 1 else 0 end) over (partition by sha order by n) as piece, sum(case when head <>"
        r" '' then 1 else 0 end) over (partition by sha order by n) as entry from g)",
        r"d as (select *, max(blank) over (partition by sha, entry order by n rows unbounded preceding) as dead from e)",
        r"p as (select sha, entry, piece, max(head) as head, max(field) as field, string_agg(text, ' ' order by n) filter (text <> '') as text"
        r" from (select *, regexp_replace(case when head <> '' then regexp_replace(line, '(?i)^(reject|invariant):', '') when field <> '' then"
        r" regexp_replace(line, '(?i)^\s*(why|file):', '') else line end, '^\s+|\s+$', '', 'g') as text from d where entry > 0 and not dead) group"
        r" by all)",
        r"q as (select sha, entry, max(head) as kind, max(text) filter (field = 'rule') as rule, max_by(coalesce(text, ''), piece) filter (field ="
        r" 'why') as why, coalesce(flatten(list(list_filter(list_transform(string_split(text, ','), lambda y: regexp_replace(y, '^\s+|\s+$', '',"
        r" 'g')), lambda y: y <> '') order by piece) filter (field = 'file' and text is not null)), []) as files from p group by sha, entry)",
    )
)
PARSE = PARSE_TABLES + "select sha, kind, row_number() over (partition by sha order by entry) - 1 as pos, rule, why, files from q where rule <> ''"
#: Trailer lines behind the last blank line of a body.
TRAILER_TABLES = Cte(
    r"t1 as (select sha, regexp_extract(regexp_replace(body, '\s+\z', ''), '(?s)(?:\A|\n[ \t]*\n)((?:[A-Za-z][\w-]*:[^\n]*(?:\n|\z)(?:["
    r" \t]+\S[^\n]*(?:\n|\z))*)+)\z', 1) as last from c)",
    r"t2 as (select sha, i - 1 as pos, string_split(regexp_replace(last, '\n[ \t]+', ' ', 'g'), chr(10))[i] as line from t1, unnest(range(1,"
    r" len(string_split(last, chr(10))) + 1)) as u(i))",
    r"trailers as (select sha, pos, regexp_extract(line, '^([^:]+):', 1) as key, regexp_replace(regexp_replace(line, '^[^:]+:', ''), '^\s+|\s+$',"
    r" '', 'g') as value from t2 where line <> '' and regexp_matches(line, '^[A-Z][A-Za-z]*(?:-[A-Z]\w*)*:'))",
)


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def strip_wrappers(x: str) -> str:
    for tag in WRAPPER_TAGS:
        x = rf"regexp_replace({x}, '(?s)<{tag}>.*?(</{tag}>|\z)', '', 'g')"
    return trimmed(f"regexp_replace({x}, '</?user_query>', '', 'g')")


def first_group(x: str) -> str:
    return rf"regexp_extract({x}, '(?s)<user_query>(.*?)(</user_query>|\z)', 1)"


def whole_bytes(x: str, size: int) -> str:
    """How many bytes the longest prefix of whole characters within size bytes has, of a text that is longer: a byte that begins with 8 to B continues a character."""
    code = f"hex(encode({x}))"
    inside = lambda k: f"substr({code}, {2 * k + 1}, 1) in ('8', '9', 'A', 'B')"
    return f"case when not {inside(size)} then {size} when not {inside(size - 1)} then {size - 1} when not {inside(size - 2)} then {size - 2} else {size - 3} end"


def truncated(x: str, size: int) -> str:
    cut = f"decode(unhex(left(hex(encode({x})), 2 * ({whole_bytes(x, size)}))))"
    return f"case when octet_length(encode({x})) <= {size} then {x} else {cut} || '…' end"


def flat(x: str) -> str:
    """Single-spaced, without blanks at the ends."""
    return f"trim(regexp_replace({x}, '{UNICODE_SPACE}+', ' ', 'g'), ' ')"


def cleaned_value(x: str, size: int) -> str:
    """Single-spaced and cut; '' for words that stand for no value."""
    value = flat(f"coalesce({x}, '')")
    return f"case when {value} in {EMPTY_WORDS!r} then '' else {truncated(value, size)} end"


def words(x: str) -> str:
    """The distinct words of a rule in singular, sorted, without stopwords."""
    plain = f"list_filter(string_split_regex(lower({x}), '[^a-z0-9а-яё]+'), lambda w: w <> '' and not list_contains({list(STOPWORDS)!r}, w))"
    return f"list_sort(list_distinct(list_transform({plain}, lambda w: {SINGULAR})))"


def prepared(rule: str, why: str, files: str) -> str:
    """A rule as a struct with its words, numbers and plain text, to be folded."""
    numbers = f"list_filter({words(rule)}, lambda w: regexp_full_match(w, '[0-9]+'))"
    return f"{{'rule': {rule}, 'why': {why}, 'files': {files}, 't': {words(rule)}, 'nums': {numbers}, 'plain': lower({trimmed(rule)})}}"


def _alike(a: str, b: str, over: str) -> str:
    return f"({a}.plain <> '' and {b}.plain <> '' and {a}.nums = {b}.nums and case when len({a}.t) < 3 or len({b}.t) < 3 then {a}.plain = {b}.plain else {over} end)"


def _shared(a: str, b: str) -> str:
    return f"(len(list_intersect({a}.t, {b}.t)) / greatest(1, len(list_distinct(list_concat({a}.t, {b}.t)))))"


def same(a: str, b: str, threshold: float) -> str:
    return _alike(a, b, f"{_shared(a, b)} >= {threshold}")


def folded(items: str) -> str:
    """An ordered list of prepared rules, near-duplicates folded into the first that is alike."""
    heavy = "len(list_filter(list_intersect(k.t, r.t), lambda w: octet_length(encode(w)) >= 6 or regexp_matches(w, '[0-9]'))) > 0"
    alike = _alike("k", "r", f"({_shared('k', 'r')} >= 0.55 or ({_shared('k', 'r')} >= 0.32 and {heavy}))")
    place = f"coalesce(list_position(list_transform(acc, lambda k: {alike}), true), 0)"
    longer = "octet_length(encode(r.why)) > octet_length(encode(k.why))"
    pick = ", ".join(f"'{c}': case when {longer} then r.{c} else k.{c} end" for c in ("rule", "why"))
    rest = ", ".join(f"'{c}': case when {longer} then r.{c} else k.{c} end" for c in ("t", "nums", "plain"))
    both = "list_concat(k.files, r.files)"
    union = f"list_filter({both}, lambda x, j: x <> '' and list_position({both}, x) = j)[1:3]"
    merged = f"{{{pick}, 'files': {union}, {rest}}}"
    step = f"case when {place} = 0 then list_append(acc, r) else list_transform(acc, lambda k, i: case when i = {place} then {merged} else k end) end"
    return f"list_reduce({items}, lambda acc, r: {step}, list_filter({items}, lambda x: false))"


def folded_texts(items: str, threshold: float = 0.55) -> str:
    """An ordered list of prepared texts without near-duplicates; the first of alike ones stays."""
    step = f"case when len(list_filter(acc, lambda k: {same('k', 'r', threshold)})) > 0 then acc else list_append(acc, r) end"
    return f"list_reduce({items}, lambda acc, r: {step}, list_filter({items}, lambda x: false))"


def matched(named: str, staged: str) -> str:
    """The staged path that a named one means; '' if none or several."""
    n = f"regexp_replace({trimmed(named)}, '^(\\./)+', '')"
    strong = f"(p = {n} or ends_with(p, '/' || {n}) or ends_with({n}, '/' || p))"
    first = f"coalesce(list_position(list_transform({staged}, lambda p: {strong}), true), 0)"
    weak = f"list_filter(range(1, len({staged}) + 1), lambda i: list_contains([i], i) and not list_transform({staged}, lambda p: {strong})[i] and split_part({staged}[i], '/', -1) = split_part({n}, '/', -1))"
    return (
        f"case when {n} = '' then '' when {first} > 0 and coalesce({first} < {weak}[2], true) then {staged}[{first}]"
        f" when len({weak}) > 1 then '' when len({weak}) = 1 then {staged}[{weak}[1]] else '' end"
    )
