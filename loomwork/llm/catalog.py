"""The queries of this subpackage. SQL gives the results of problems 1 and 5 and the laws that the results of the others obey;
tests hold those against brute force, round trips or held-out data."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import conversations, credentials, language, mixing, neardup, packing, personal, tokens
from loomwork.sources.stage import staged
from loomwork.sources.tables import table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.conversations(table(spark, sf_dir, "log_entries"))


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.session_report(table(spark, sf_dir, "log_entries"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal.personal_information(*(table(spark, sf_dir, t) for t in ("log_entries", "messages", "name_lexicon")))
    return found.select("row_table", "row_id", "part_no", "kind", "found_text").distinct()


def p3_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of both tables, its text with placeholders for what p3_found finds."""
    log, says, lexicon = (table(spark, sf_dir, t) for t in ("log_entries", "messages", "name_lexicon"))
    items = staged(personal.personal_information(log, says, lexicon))
    of = lambda name: items.where(F.col("row_table") == name)
    raw = personal.masked(log.select("entry_id", "message"), "entry_id", "message", of("log_entries"), personal.mask_message)
    plain = personal.masked(says.select("message_id", "text"), "message_id", "text", of("messages"))
    return raw.select(F.lit("log_entries").alias("row_table"), F.col("entry_id").alias("row_id"), F.col("message").alias("text")).unionByName(
        plain.select(F.lit("messages").alias("row_table"), F.col("message_id").alias("row_id"), "text")
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = credentials.credentials(table(spark, sf_dir, "log_entries"), table(spark, sf_dir, "messages"))
    return found.select("place", "row_id", "part_no", "found_text")


def p4_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of both tables, its raw columns without credentials."""
    log = credentials.redacted_log(table(spark, sf_dir, "log_entries").select("entry_id", "message", "tool_use_result"))
    says = credentials.redacted_messages(table(spark, sf_dir, "messages").select("message_id", "tools"))
    return log.select(F.lit("log_entries").alias("row_table"), F.col("entry_id").alias("row_id"), "message", "tool_use_result").unionByName(
        says.select(F.lit("messages").alias("row_table"), F.col("message_id").alias("row_id"), "tools"), allowMissingColumns=True
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_pairs(table(spark, sf_dir, "rule_entries"), "rule_id", "rule", "why", threshold=0.7)


def p5_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.similar_groups(table(spark, sf_dir, "rule_entries"), "rule_id", "rule", "why", threshold=0.7)


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(packing.sizes_of(table(spark, sf_dir, "documents")), table(spark, sf_dir, "pack_limits"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, sf_dir))


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(tokens.sized(table(spark, sf_dir, "documents"), "source"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, sf_dir), table(spark, sf_dir, "mix_targets"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.wrong_or_missing(language.paragraph_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes")))


def p8_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.document_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes"))


def p3_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: rows, rows whose text came or went, and rows whose null or blank text changed."""
    before = table(spark, sf_dir, "log_entries").select(F.lit("log_entries").alias("row_table"), F.col("entry_id").alias("row_id"), F.col("message").alias("old"))
    says = table(spark, sf_dir, "messages").select(F.lit("messages").alias("row_table"), F.col("message_id").alias("row_id"), F.col("text").alias("old"))
    both = before.unionByName(says).join(p3_masked(spark, sf_dir), ["row_table", "row_id"], "full")
    empty_changed = (F.coalesce(F.trim("old"), F.lit("")) == "") & ~F.col("old").eqNullSafe(F.col("text"))
    return both.groupBy("row_table").agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("old").isNull() != F.col("text").isNull()).alias("lost"),
        F.count_if(empty_changed).alias("empty_changed")
    )


def p4_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per table: rows that redaction keeps, and credentials that are still found behind it."""
    log = credentials.redacted_log(table(spark, sf_dir, "log_entries").select("entry_id", "message", "tool_use_result"))
    says = credentials.redacted_messages(table(spark, sf_dir, "messages").select("message_id", "tools"))
    rows = log.agg(F.count("entry_id").alias("rows")).withColumn("row_table", F.lit("log_entries")).unionByName(
        says.agg(F.count("message_id").alias("rows")).withColumn("row_table", F.lit("messages"))
    )
    left = credentials.credentials(log, says).groupBy(
        F.when(F.col("place") == "summary", "messages").otherwise("log_entries").alias("row_table")
    ).agg(F.count("*").alias("n"))
    return rows.join(left, "row_table", "left").select("row_table", "rows", F.coalesce("n", F.lit(0)).alias("still_there"))


def p6_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per limit: documents, documents whose pieces don't add up to them, cut documents that fit, and containers over a capacity."""
    sizes = packing.sizes_of(table(spark, sf_dir, "documents"))
    filled = staged(packing.packed(sizes, table(spark, sf_dir, "pack_limits")))
    per = filled.groupBy("limit_id", "capacity_tokens", "doc_id").agg(F.sum("tokens").alias("held"), F.count("*").alias("pieces")).join(sizes, "doc_id", "full")
    cost = F.sum(F.col("tokens").cast("double") * F.col("tokens"))
    box = filled.where("container is not null").groupBy("limit_id", "capacity_tokens", "container").agg(
        F.sum("tokens").alias("used"), F.count("*").alias("n"), cost.alias("cost")
    )
    square = F.col("capacity_tokens").cast("double") * F.col("capacity_tokens")
    over = (F.col("used") > F.col("capacity_tokens")) | (F.col("n") > packing.MAX_DOCUMENTS) | (F.col("n") > 1) & (
        F.col("cost") > packing.ATTENTION_SHARE * square * (1 + 1e-9)
    )
    boxes = box.groupBy("limit_id").agg(F.count_if(over).alias("over"))
    documents = per.groupBy("limit_id").agg(
        F.count("*").alias("documents"), F.count_if(~F.col("held").eqNullSafe(F.col("tokens"))).alias("torn"), F.count_if(
            (F.col("pieces") > 1) & (F.col("tokens") <= F.col("capacity_tokens"))
        ).alias("cut_needlessly")
    )
    return documents.join(boxes, "limit_id")


def p7_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source: its cap of repeats, documents repeated beyond it, documents of another source, and epochs that began before
    the one before was complete."""
    documents, targets = table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets")
    sized = staged(tokens.sized(documents, "source"))
    mix = staged(mixing.mixed(sized, targets))
    every = sized.where("tokens > 0").select("doc_id", "source").join(mix.select("doc_id", F.col("source").alias("mixed"), "copies"), "doc_id", "left")
    per = every.groupBy("source").agg(
        F.max("copies").alias("most"), F.min(F.coalesce("copies", F.lit(0))).alias("least"), F.count_if(
            F.col("mixed").isNotNull() & (F.col("mixed") != F.col("source"))
        ).alias("strange")
    )
    named = targets.where("source is not null").groupBy("source").agg(F.max("max_repeats").alias("max_repeats")).join(per, "source", "left")
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    return named.select(
        "source", F.col("max_repeats"), none(
            F.greatest(F.col("most") - F.col("max_repeats"), F.lit(0))
        ).alias("beyond"), none(F.col("strange")).alias("strange"), none((F.col("most") - F.col("least") > 1).cast("long")).alias("incomplete")
    )


def p8_laws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document with text: its paragraphs, and those that have a language though they hold no letter."""
    per = language.paragraph_languages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "lang_codes"))
    return per.groupBy("doc_id").agg(
        F.count("*").alias("paragraphs"),
        F.max("para_no").alias("last"),
        F.count_if((F.col("letters") == 0) & F.col("lang").isNotNull()).alias("groundless")
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (p1_found, p1_sessions, p3_found, p3_masked, p3_laws, p4_found, p4_redacted, p4_laws, p5_found, p5_groups)
    made = (p6_containers, p6_fill, p6_laws, p7_mix, p7_shares, p7_laws, p8_found, p8_documents, p8_laws)
    return {f.__name__: f for f in found + made}


_P1_TABLES = r"""
with f as (
    select lower(session_id) as s, line_no as n, min_by({'e': entry_id, 'k': entry_type, 'ts': ts, 'p': prompt_id, 'side': coalesce(is_sidechain, false), 'm': message}, entry_id) as x
    from log_entries where session_id is not null and line_no is not null group by all
), o as (
    select s, n, x.e as e, x.k as k, x.p as p, x.k in ('user', 'assistant') and not x.side as main,
        case when regexp_full_match(x.ts, '\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d+)?([Zz]|[+-]\d{2}:\d{2})') then try_cast(x.ts as timestamptz) end as stamp,
        case when json_valid(x.m) then case when json_type(x.m) = 'VARCHAR' then json_extract_string(x.m, '$') else x.m end end as t
    from f
), v as (
    select *, last_value(stamp ignore nulls) over (partition by s order by n rows between unbounded preceding and current row) as time,
        case when json_valid(t) then case when json_type(t) = 'OBJECT' then t::json end end as j from o
), c as (
    select *, json_type(j, '$.content') as shape, lower(json_extract_string(j, '$.role')) as role,
        case when json_type(j, '$.content') = 'ARRAY' then from_json(json_extract(j, '$.content'), '["JSON"]') end as parts from v
), d as (
    select *, coalesce(main and j is not null and role in ('user', 'assistant') and case when shape = 'VARCHAR' then regexp_matches(json_extract_string(j, '$.content'), '[^\s]')
        when shape = 'ARRAY' then len(list_filter(parts, lambda y: json_extract_string(y, '$.type') = 'text' and json_type(y, '$.text') = 'VARCHAR' and regexp_matches(json_extract_string(y, '$.text'), '[^\s]'))) > 0 end
        and not (k = 'user' and shape = 'ARRAY' and (p is null or len(list_filter(parts, lambda y: json_extract_string(y, '$.type') = 'tool_result')) > 0)), false) as turn from c
), g as (
    select s from d group by s having count(*) = max(n) - min(n) + 1 and count(*) filter (main and j is null) = 0 and count(*) filter (turn) > 1
), t as (
    select s, n, e, role, row_number() over w - 1 as turn_no, lag(role) over w as before, row_number() over (partition by s order by time desc nulls last, n desc) as back
    from d where turn and s in (select s from g) window w as (partition by s order by time nulls first, n)
)
"""
_P1 = _P1_TABLES + r"""
, keep as (
    select s from t group by s having bool_or(turn_no = 0 and role = 'user') and bool_or(back = 1 and role = 'assistant') and not bool_or(role = 'user' and coalesce(before, '') = 'user')
)
select s as session_id, turn_no, e as entry_id from t where s in (select s from keep)
"""
_P1_SESSIONS = _P1_TABLES + r"""
, w as (
    select s, count(*) as lines, count(*) filter (turn) as turns, max(n) - min(n) + 1 - count(*) as missing, count(*) filter (main and j is null) as unread from d group by s
), a as (
    select s, role, lead(role) over (partition by s order by turn_no) as after, count(*) filter (role = 'user') over (partition by s order by turn_no) as users from t
), x as (
    select s, count(*) filter (role = 'user' and after is distinct from 'assistant') as unanswered, count(*) filter (role = 'assistant' and users = 0) as unasked, 0::bigint as left_over from a group by s
)
select w.s as session_id, lines, turns, missing, unread, unanswered, unasked, left_over, coalesce(unanswered + unasked = 0, false) as kept from w left join x using (s)
"""

_P5 = r"""
with w as (
    select rule_id, list_distinct(list_filter(string_split_regex(lower(coalesce(rule, '') || ' ' || coalesce(why, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '')) as s from rule_entries
), u as (
    select rule_id, len(s) as n, unnest(s) as word from w
), b as (
    select a.rule_id as rule_a, b.rule_id as rule_b, any_value(a.n) as na, any_value(b.n) as nb, count(*) as shared from u a join u b on a.word = b.word and a.rule_id < b.rule_id group by all
)
select rule_a, rule_b from b where shared >= 0.7 * (na + nb - shared) - 1e-9
"""


_P5_GROUPS = (
    "with recursive pairs as ("
    + _P5
    + r"""), w as (
    select rule_id, list_sort(list_distinct(list_filter(string_split_regex(lower(coalesce(rule, '') || ' ' || coalesce(why, '')), '[^\p{L}\p{N}]+'), lambda x: x <> ''))) as s from rule_entries
), c as (
    select rule_id as record, min(rule_id) over (partition by s) as class_id, count(*) over (partition by s) as copies from w where len(s) > 0
), e as (
    select distinct x.class_id as a, y.class_id as b from pairs join c x on x.record = rule_a join c y on y.record = rule_b where x.class_id <> y.class_id
), ab as (
    select a, b from e union select b, a from e
), near(node, other) as (
    select class_id, class_id from c union select near.node, ab.b from near join ab on ab.a = near.other
), root as (
    select node, min(other) as root from near group by node
), degree as (
    select a, count(*) as links from ab group by a
)
select record, root as group_id, class_id, copies, coalesce(links, 0) as links from c join root on node = class_id left join degree on a = class_id
"""
)

_LAWS = {
    "p3_laws": "select 'log_entries' as row_table, count(*) as rows, 0::bigint as lost, 0::bigint as empty_changed from log_entries union all select 'messages', count(*), 0, 0 from messages",
    "p4_laws": "select 'log_entries' as row_table, count(*) as rows, 0::bigint as still_there from log_entries union all select 'messages', count(*), 0 from messages",
    "p6_laws": "select limit_id, (select count(*) from documents) as documents, 0::bigint as torn, 0::bigint as cut_needlessly, 0::bigint as over from (select distinct limit_id from pack_limits where capacity_tokens > 0)",
    "p7_laws": "select source, max(max_repeats) as max_repeats, 0::bigint as beyond, 0::bigint as strange, 0::bigint as incomplete from mix_targets where source is not null group by source",
    "p8_laws": r"""
with t as (
    select doc_id, replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)) as x from documents
), s as (
    select doc_id, regexp_replace(regexp_replace(x, '^([^\S\n]*\n)+', ''), '(\n[^\S\n]*)+\z', '') as x from t where regexp_matches(x, '\S')
), n as (
    select doc_id, len(string_split_regex(x, '\n(?:[^\S\n]*\n)+')) as paragraphs from s
)
select doc_id, paragraphs, paragraphs - 1 as last, 0::bigint as groundless from n
""",
}


def oracle_sql() -> dict[str, str]:
    return {"p1_found": _P1, "p1_sessions": _P1_SESSIONS, "p5_found": _P5, "p5_groups": _P5_GROUPS} | _LAWS
