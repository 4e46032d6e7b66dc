"""Named queries over the test tables and the SQL that checks them.

Roles of the tables: messages and sessions as they are; commits without repeated rows; rule_entries as rules and, by their
files, as the paths that a commit touched; log_entries as raw lines; events as touches (user_id the session, props.k the
file, error a reset); documents as free text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.functions import payload, text, times
from loomwork import model
from loomwork.operators import compact, delivery, nested, record, rules, sequence, sessions
from loomwork.plans import sql as S
from loomwork.sources.tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where SQL can express it."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# --- relations ---------------------------------------------------------------------------------


def _messages(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Messages without repeated rows; only the named columns (and the keys) are read and shuffled."""
    m = table(spark, d, "messages")
    return sessions.first_received(m.select("session_key", "seq", "message_id", *columns) if columns else m, ["session_key", "seq"], "message_id")


def _sessions(spark: SparkSession, d: str) -> DataFrame:
    return sessions.latest_snapshot(table(spark, d, "sessions"))


def _commits(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Commits without repeated rows, which are equal in all columns."""
    c = table(spark, d, "commits")
    return (c.select("sha", *columns) if columns else c).dropDuplicates()


def _rules(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """rule_entries with (sha, kind, pos) unique: of repeated ones the lowest rule_id."""
    r = table(spark, d, "rule_entries")
    return sessions.first_received(r.select("sha", "kind", "pos", "rule_id", *columns) if columns else r, ["sha", "kind", "pos"], "rule_id")


def _commit_files(spark: SparkSession, d: str) -> DataFrame:
    return _rules(spark, d, "files").select("sha", F.explode("files").alias("path")).where("path <> ''").distinct()


# --- nested records ----------------------------------------------------------------------------


def _opened(c: str) -> str:
    """A JSON text, or the text that a JSON string holds; null if it can't be read."""
    inner = f"case when json_valid({c}) then case when json_type({c}) = 'VARCHAR' then json_extract_string({c}, '$') else {c} end end"
    return f"(select case when json_valid(x) then x::json end from (select {inner} as x))"


_PATH = "replace(regexp_replace(fullkey, '^\\$\\.?', ''), '\"', '')"


@query(
    "with v as (select entry_id, " + _opened("message") + " as m, " + _opened("tool_use_result") + " as r from log_entries),"
    " parts as (select entry_id, i, json_extract(m, '$.content[' || i || ']') as p from v, unnest(range(0, coalesce(json_array_length(m,"
    " '$.content'), 0)::bigint)) as u(i) where json_type(m) = 'OBJECT' and json_type(m, '$.content') = 'ARRAY'),"
    " inputs as (select entry_id, 'content[' || i || '].input' as stem, " + _opened(
        "json_extract_string(p, '$.input')"
    ) + " as j from parts where json_extract_string(p, '$.type') = 'tool_use' and json_type(p, '$.input') = 'VARCHAR'),"
    f" n as (select entry_id, 'message' as root, {_PATH} as node_path from v, json_tree(m) t where t.type = 'OBJECT' and ends_with(t.fullkey, ']')"
    f" union all select entry_id, 'tool_use_result', {_PATH} from v, json_tree(r) t where t.type = 'OBJECT' and ends_with(t.fullkey, ']')"
    f" union all select entry_id, 'message', stem || case when starts_with({_PATH}, '[') then '' else '.' end || {_PATH} from inputs, json_tree(j)"
    " t where t.type = 'OBJECT' and ends_with(t.fullkey, ']'))"
    " select entry_id, root, node_path, regexp_extract(node_path, '^(.*\\])\\.', 1) as parent_path from n"
)
def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.array_objects(table(spark, sf_dir, "log_entries")).select("entry_id", "root", "node_path", "parent_path")


_NODE_TYPES = "case t.type when 'VARCHAR' then 'str' when 'DOUBLE' then 'float' when 'BOOLEAN' then 'bool' when 'NULL' then 'NoneType' when 'OBJECT' then null when 'ARRAY' then null else 'int' end"
_NODE = (
    "case t.type when 'OBJECT' then 'object' when 'ARRAY' then 'array' else 'scalar' end as kind, case when t.parent is null or"
    " ends_with(t.fullkey, ']') then null else t.key end as key,"
    f" case when ends_with(t.fullkey, ']') then t.key::bigint end as position, {_NODE_TYPES} as value_type,"
    " case when t.type not in ('OBJECT', 'ARRAY', 'NULL') then json_extract_string(t.value, '$') end as value"
)


@query(
    "with v as (select entry_id, "
    + _opened("message")
    + " as m, "
    + _opened("tool_use_result")
    + f" as r from log_entries), a as (select entry_id, 'message' as root, t.id as i, {_PATH} as path, {_NODE} from v, json_tree(m) t where"
    " json_type(m) in ('OBJECT', 'ARRAY')"
    f" union all select entry_id, 'tool_use_result', t.id, {_PATH}, {_NODE} from v, json_tree(r) t where json_type(r) in ('OBJECT', 'ARRAY')),"
    " held as (select x.entry_id, x.i, x.path as stem, " + _opened("x.value") + " as j from a x join a y on y.entry_id = x.entry_id and y.root = x.root and y.path = regexp_replace(x.path, 'input$', 'type') and y.value = 'tool_use'"
    " where x.root = 'message' and regexp_full_match(x.path, 'content\\[[0-9]+\\]\\.input') and x.value_type = 'str'),"
    f" inner_ as (select entry_id, 'message' as root, i, t.id as k, stem || case when {_PATH} = '' or starts_with({_PATH}, '[') then '' else '.'"
    f" end || {_PATH} as path, {_NODE.replace("t.parent is null or", '')} from held, json_tree(j) t where json_type(j) in ('OBJECT', 'ARRAY')),"
    " every as (select entry_id, root, i, 0::ubigint as k, path, kind, key, position, value_type, value from a anti join (select distinct"
    " entry_id, root, i from inner_) z using (entry_id, root, i)"
    " union all select entry_id, root, i, k, path, kind, case when k = 0 then 'input' else key end, position, value_type, value from inner_),"
    " n as (select *, row_number() over (partition by entry_id, root order by i, k) - 1 as pre from every),"
    " post as (select x.entry_id, x.root, x.pre, max(y.pre) as post from n x join n y on y.entry_id = x.entry_id and y.root = x.root and y.pre >="
    " x.pre and (y.pre = x.pre or x.path = '' or starts_with(y.path, x.path || '.') or starts_with(y.path, x.path || '[')) group by all)"
    " select entry_id, root, pre, post, kind, path as node_path, key, position, value_type, value from n join post using (entry_id, root, pre)"
)
def p2_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nested.nodes(table(spark, sf_dir, "log_entries"))


# --- selection ---------------------------------------------------------------------------------


@query(
    S.M + f"select session_key, min(seq) as seq, text from (select session_key, seq, {S.strip_wrappers('text')} as text from m where {S.HUMAN}) where"
    f" text <> '' and not {S.ARTIFACT} group by session_key, text"
)
def human_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.human_requests(_messages(spark, sf_dir, "role", "meta", "text"))


@query(
    S.M + f"select session_key, count(*) as messages from m group by session_key having bool_or(({S.HUMAN}) or coalesce(role = 'assistant' and (text <>"
    " '' or coalesce(thinking, '') <> '' or coalesce(len(tools), 0) > 0), false))"
)
def sessions_with_signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.sessions_with_signal(_messages(spark, sf_dir, "role", "meta", "text", "thinking", "tools"))


@query(
    S.M + "select t.name as tool, regexp_matches(lower(t.name), 'read|view|grep|search|glob|find|list|ls|fetch|lookup|todo|think|plan|diagnostic') as"
    " reading, count(*) as calls, count(*) filter (t.error is not null) as failed from (select unnest(tools) as t from m) group by all"
)
def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = _messages(spark, sf_dir, "tools").select(F.explode("tools").alias("t"))
    return calls.groupBy(
        F.col("t.name").alias("tool"), sessions.reading_only(F.col("t.name")).alias("reading")
    ).agg(F.count("*").alias("calls"), F.count("t.error").alias("failed"))


@query(
    S.M + S.TOUCHED + "select session_key, row_number() over (partition by session_key order by seq desc, tp, fp) - 1 as place, file from (select session_key,"
    " file, seq, tp, fp from touched qualify row_number() over (partition by session_key, file order by seq desc, tp, fp) = 1)"
)
def touched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.touched_files(_messages(spark, sf_dir, "tools"))


@query(
    S.M + S.TOUCHED + ", st as (select distinct left(md5(path), 8) as sha, path from (select regexp_extract(file, '([^/]+/[^/]+)$', 1) as path from touched) where"
    " path <> ''), ends as (select distinct session_key, array_to_string(p[i:], '/') as path from (select session_key,"
    " string_split(regexp_replace(file, '^(\\./|/)+', ''), '/') as p from touched where not reading), unnest(range(1, len(p) + 1)) as u(i))"
    " select distinct st.sha, e.session_key from ends e join st on st.path = e.path"
)
def wrote_staged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last two steps of every path that a tool names stand for a staged path of a commit of their own."""
    m = _messages(spark, sf_dir, "tools")
    named = sessions.touched(m).select(F.regexp_extract("file", "([^/]+/[^/]+)$", 1).alias("path")).where("path <> ''").distinct()
    return sessions.wrote_any(sessions.written_files(m), named.select(F.left(F.md5("path"), F.lit(8)).alias("sha"), "path"))


@query(
    S.M + S.TOUCHED + S.CF + S.LS + S.CO + ", cand as (select distinct sha, session_key from c join ls on split_part(c.repo, '/', 2) = regexp_extract(ls.cwd, '^/srv/work/([^/]+)', 1)"
    " and cast(c.ts as date) = cast(ls.updated_ts as date)),"
    " hits as (select distinct cand.sha, cand.session_key from cand join cf using (sha) join touched t on t.session_key = cand.session_key and"
    " not t.reading and (t.file = cf.path or ends_with(t.file, '/' || cf.path))),"
    " marked as (select cand.*, hits.sha is not null as hit from cand left join hits on hits.sha = cand.sha and hits.session_key = cand.session_key)"
    " select sha, session_key, hit, case when n = 0 then 0 else a - n end as skipped from (select *, count(*) filter (hit) over (partition by"
    " sha) as n, count(*) over (partition by sha) as a from marked) where hit or n = 0"
)
def relevant_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates: the sessions in the commit's repository that were updated on its day."""
    c = _commits(spark, sf_dir, "repo", "ts").select("sha", F.element_at(F.split("repo", "/"), 2).alias("place"), F.to_date("ts").alias("day"))
    s = _sessions(spark, sf_dir).select("session_key", F.regexp_extract("cwd", "^/srv/work/([^/]+)", 1).alias("place"), F.to_date("updated_ts").alias("day"))
    return sessions.relevant(c.join(s, ["place", "day"]), sessions.written_files(_messages(spark, sf_dir, "tools")), _commit_files(spark, sf_dir))


@query(S.M + f"select session_key, max(seq) as seq, max_by(text, seq) as text from m where {S.HUMAN} group by session_key")
def last_human_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.last_human_prompt(_messages(spark, sf_dir, "role", "meta", "text"))


@query(S.M + "select session_key, min(ts) as first_ts, max(ts) as last_ts, count(ts) as dated, count(*) - count(ts) as undated from m group by session_key")
def session_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions.session_span(_messages(spark, sf_dir, "ts"))


@query(
    "select lower(session_id) as session, max_by(git_branch, {'a': entry_id, 'b': git_branch}) filter (git_branch <> '') as git_branch,"
    " max_by(cwd, {'a': entry_id, 'b': cwd}) filter (cwd <> '' and not starts_with(cwd, '<')) as cwd, max_by(ai_title, {'a': entry_id, 'b':"
    " ai_title}) filter (ai_title <> '') as ai_title from log_entries where session_id is not null group by 1"
)
def last_nonempty_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "log_entries").where("session_id is not null").withColumn("session", F.lower("session_id"))
    return sessions.last_nonempty(log, "session", "entry_id", "git_branch", "cwd", "ai_title", ignore={"cwd": "<"})


@query(
    "select lower(session_id) as session, min_by(cwd, line_no) filter (cwd <> '') as cwd, min_by(ai_title, line_no) filter (ai_title <> '') as"
    " ai_title from (select * from log_entries where session_id is not null and line_no < 200 qualify row_number() over (partition by"
    " lower(session_id), line_no order by entry_id) = 1) group by 1"
)
def head_probe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First non-empty directory and title of a session's first 200 lines."""
    log = table(spark, sf_dir, "log_entries").where("session_id is not null and line_no < 200").select(
        F.lower("session_id").alias("session"), "line_no", "entry_id", "cwd", "ai_title"
    )
    first = sessions.first_received(log, ["session", "line_no"], "entry_id")
    pick = lambda c: F.min_by(F.when(F.col(c) != "", F.col(c)), F.when(F.col(c) != "", F.col("line_no"))).alias(c)
    return first.groupBy("session").agg(pick("cwd"), pick("ai_title"))


_FROM, _TO = "2025-05-01 00:00:00", "2025-09-01 00:00:00"


@query(
    S.M + S.LS + ", x as (select m.session_key, m.seq, m.ts from m left join ls using (session_key) where case when m.ts is not null then m.ts > timestamp"
    f" '{_FROM}' and m.ts <= timestamp '{_TO}' else coalesce(ls.updated_ts > timestamp '{_FROM}' and ls.updated_ts <= timestamp '{_TO}', false)"
    " end)"
    " select session_key, seq, ts, bool_or(ts is null) over (partition by session_key) as approximate from x"
)
def time_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sessions.time_slice(_messages(spark, sf_dir, "ts"), _sessions(spark, sf_dir), F.to_timestamp(F.lit(_FROM)), F.to_timestamp(F.lit(_TO)))
    return found.select("session_key", "seq", "ts", "approximate")


@query(
    S.LS + ", o as (select session_key, cursor_bytes // 2 as bytes from ls where cursor_bytes % 3 = 0) select session_key, agent, updated_ts, title,"
    " coalesce(bytes, 0) as read_bytes, case when coalesce(bytes, 0) = 0 then 'unread' when bytes < cursor_bytes then 'part' else 'whole' end as"
    " state from ls left join o using (session_key)"
)
def session_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored offsets: half the bytes of every session whose size divides by three."""
    s = _sessions(spark, sf_dir)
    return sessions.listing(s, s.where("cursor_bytes % 3 = 0").select("session_key", F.floor(F.col("cursor_bytes") / 2).cast("long").alias("bytes")))


@query(
    "with x as (select session_key, seq, octet_length(encode(coalesce(text, ''))) + 1 as n, seq * 400 as start from messages where session_key is"
    " not null), o as (select session_key, max(seq) * 250 as bytes from messages group by 1 having max(seq) % 5 <> 0)"
    " select session_key, seq, start from (select *, max(start) over (partition by session_key) as size from x) left join o using (session_key)"
    " where start >= case when size < coalesce(bytes, 0) then 0 else coalesce(bytes, 0) end"
)
def resume_from_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of 400 bytes each; four of five sessions were read to five eighths of their last line's place."""
    m = table(spark, sf_dir, "messages").where("session_key is not null").select("session_key", "seq", (F.col("seq") * 400).alias("start"))
    last = m.groupBy("session_key").agg(F.max("seq").alias("last"), F.max("start").alias("size"))
    offsets = last.where("last % 5 <> 0").select("session_key", (F.col("last") * 250).alias("bytes"))
    return sessions.resume(m.join(last.select("session_key", "size"), "session_key"), offsets).select("session_key", "seq", "start")


@query(
    S.LS + "select agent, count(*) as discovered, count(*) filter (cursor_bytes > 0) as tracked, count(*) filter (coalesce(degraded_reason, '') <> '')"
    " as degraded, count(*) filter (complete) as complete from ls group by agent"
)
def session_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sessions(spark, sf_dir).groupBy("agent").agg(
        F.count("*").alias("discovered"),
        F.count_if(F.col("cursor_bytes") > 0).alias("tracked"),
        F.count_if(F.coalesce("degraded_reason", F.lit("")) != "").alias("degraded"),
        F.count_if("complete").alias("complete")
    )


@query(
    S.LS + S.CO + ", l as (select c.sha, ls.session_key, ls.session_id, ls.agent, ls.model from c join ls on split_part(c.repo, '/', 2) ="
    " regexp_extract(ls.cwd, '^/srv/work/([^/]+)', 1) and cast(c.ts as date) = cast(ls.updated_ts as date))"
    " select sha, array_to_string(list_sort(list_distinct(list(session_id) filter (session_id <> ''))), ',') as session_ids,"
    " array_to_string(list_sort(list_distinct(list(agent))), '+') || coalesce('/' || nullif(array_to_string(list_sort(list_distinct(list(model)"
    " filter (model <> ''))), '+'), ''), '') as label, array_to_string(list_sort(list_distinct(list(sha256(session_key)))), ',') as transcripts"
    " from l group by sha"
)
def commit_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir, "repo", "ts").select("sha", F.element_at(F.split("repo", "/"), 2).alias("place"), F.to_date("ts").alias("day"))
    s = _sessions(spark, sf_dir).select(
        "session_key",
        "session_id",
        "agent",
        "model",
        F.regexp_extract("cwd", "^/srv/work/([^/]+)", 1).alias("place"),
        F.to_date("updated_ts").alias("day")
    )
    return sessions.commit_metadata(c.join(s, ["place", "day"]))


@query(S.M + "select session_key, min_by(thinking, seq) filter (thinking <> '') as thinking from m group by session_key")
def first_thinking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.first_position(_messages(spark, sf_dir, "thinking"), "session_key", "seq", "thinking")


# --- sequences ---------------------------------------------------------------------------------


@query(
    S.M + ", x as (select session_key, seq, role, case when row_number() over w = 1 or role is distinct from lag(role) over w then 1 else 0 end as s"
    " from m window w as (partition by session_key order by seq)), y as (select *, sum(s) over (partition by session_key order by seq) as run"
    " from x)"
    " select session_key, min(seq) as first, count(*) as repeats, any_value(role) as role, any_value(role) || case when count(*) > 1 then ' ×' ||"
    " count(*) else '' end as shown from y group by session_key, run"
)
def collapse_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = sequence.collapse_repeats(_messages(spark, sf_dir, "role").where("role is not null"), "session_key", "seq", "role")
    return runs.withColumn("shown", sequence.repeat_mark(F.col("role"), F.col("repeats")))


_SIZE = "octet_length(encode(coalesce(text, '')))"


@query(
    S.M + f"select session_key, seq, used from (select session_key, seq, sum({_SIZE} + 1) over (partition by session_key order by seq desc rows"
    " unbounded preceding)::bigint as used from m) where used <= 4000"
)
def tail_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir, "text").select("session_key", "seq", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    return sequence.tail_pack(m, "session_key", "seq", F.col("n"), 4000).select("session_key", "seq", "used")


@query(
    S.M + f", x as (select session_key, seq, coalesce(text, '') = '' as filler, {_SIZE} + coalesce(len(tools), 0) * 40 as n from m), y as (select *,"
    " sum(n + 1) over (partition by session_key, filler order by seq desc rows unbounded preceding)::bigint as used from x), z as (select *,"
    " coalesce(max(case when not filler and used <= 3000 then used end) over (partition by session_key), 0) as taken from y)"
    " select session_key, seq, filler, used from z where used <= case when filler then 3000 - taken else 3000 end"
)
def two_class_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _messages(spark, sf_dir, "text", "tools")
    sized = m.select(
        "session_key",
        "seq",
        (F.coalesce("text", F.lit("")) == "").alias("empty"),
        (F.octet_length(F.coalesce("text", F.lit(""))) + F.coalesce(F.size("tools"), F.lit(0)) * 40).cast("long").alias("n")
    )
    return sequence.two_class_pack(sized, "session_key", "seq", F.col("n"), F.col("empty"), 3000).select("session_key", "seq", "filler", "used")


@query(
    S.LS + ", n as (select cwd, cast(updated_ts as date) as day, list(session_key order by updated_ts, session_key) as sessions,"
    " list(coalesce(cursor_bytes, 0)::bigint order by updated_ts, session_key) as needs from ls where cwd <> '' and updated_ts is not null group"
    " by all)"
    " select cwd, day, sessions, list_reduce(list_transform(needs, lambda x: [x]), lambda acc, x: list_append(acc, least(x[1], (24000 -"
    " coalesce(list_sum(acc), 0)::bigint) // (len(needs) - len(acc)))), []::bigint[]) as shares from n"
)
def share_rollforward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of a repository's sessions of a day gets of 24000 bytes, oldest first."""
    s = _sessions(spark, sf_dir).where("cwd <> '' and updated_ts is not null").withColumn("day", F.to_date("updated_ts"))
    per = s.groupBy("cwd", "day").agg(F.array_sort(F.collect_list(F.struct("updated_ts", "session_key", F.coalesce("cursor_bytes", F.lit(0)).alias("need")))).alias("s"))
    return per.select(
        "cwd",
        "day",
        F.transform("s", lambda x: x["session_key"]).alias("sessions"),
        sequence.roll_forward(F.transform("s", lambda x: x["need"]), 24_000).alias("shares")
    )


@query(
    S.M + f", k as (select session_key, seq, sum({_SIZE} + 1) over (partition by session_key order by seq desc rows unbounded preceding) <= 2000 or seq"
    " % 7 = 0 as kept from m), x as (select *, min(case when kept then seq end) over (partition by session_key order by seq rows between 1"
    " following and unbounded following) as before from k)"
    " select session_key, before, count(*) as elided from x where not kept group by all"
)
def elision_markers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Left out: what neither fits 2000 bytes from the end nor has a sequence number that divides by seven."""
    m = _messages(spark, sf_dir, "text").select("session_key", "seq", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    packed = sequence.tail_pack(m, "session_key", "seq", F.col("n"), 2000).select("session_key", "seq", F.lit(True).alias("fits"))
    marked = m.join(packed, ["session_key", "seq"], "left")
    return sequence.elisions(marked, "session_key", "seq", F.coalesce("fits", F.lit(False)) | (F.col("seq") % 7 == 0))


@query(
    S.M
    + S.LS
    + "select cwd, session_key, seq, session_key is distinct from lag(session_key) over (partition by cwd order by updated_ts, session_key, seq) as header"
    " from (select ls.cwd, ls.updated_ts, m.session_key, m.seq from m join ls using (session_key) where ls.cwd <> '' and ls.updated_ts is not null)"
)
def session_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    dated = _sessions(spark, sf_dir).where("cwd <> '' and updated_ts is not null").select("session_key", "cwd", "updated_ts")
    m = _messages(spark, sf_dir, "role").select("session_key", "seq").join(dated, "session_key")
    return sequence.section_starts(
        m, "cwd", ["updated_ts", "session_key", "seq"], "session_key", F.unix_date(F.to_date("updated_ts"))
    ).select("cwd", "session_key", "seq", "header")


def _rung(cap: int) -> str:
    size = "octet_length(encode(text))"
    cut = f"case when {size} <= {cap} then {size} else {S.whole_bytes('text', cap)} + 3 end"
    return f"select session_key, {cap}::bigint as cap, sum({cut} + 3)::bigint as low, count(*) filter ({size} > {cap}) as cut from m where text is not null group by session_key"


@query(
    S.M
    + f", per as ({' union all '.join(_rung(c) for c in sequence.ladder())}), best as (select session_key, coalesce(max(case when low <= 1500 then"
    " cap end), 240) as cap from per group by 1)"
    " select session_key, cap, low as bytes, cut from best join per using (session_key, cap)"
)
def cap_ladder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A budget of 2000 bytes; texts are cut between characters."""
    return sequence.best_cap(_messages(spark, sf_dir, "text").where("text is not null"), "session_key", "text", 2000)


@query(
    "with l as (select doc_id, i, string_split(text, chr(10))[i] as line from (select doc_id, text from documents where text is not null),"
    " unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)), e as (select doc_id, i, line, sum(case when starts_with(line, ' ') or line"
    " = '' then 0 else 1 end) over (partition by doc_id order by i)::bigint as entry from l),"
    " g as (select doc_id, entry, string_agg(line, chr(10) order by i) as text, count(*) as lines from e group by all) select * from g qualify"
    " row_number() over (partition by doc_id order by entry desc) <= 3"
)
def log_group_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's last three entries: lines that are not indented or empty, with the lines behind them."""
    lines = table(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("n", "line"))
    entries = sequence.continuation_groups(lines, "doc_id", "n", "line", ~(F.col("line").startswith(" ") | (F.col("line") == "")))
    return sequence.last_entries(entries, "doc_id", 3)


_TOOL_SQL = (
    f"'  · ' || coalesce(x.name, '') || case when coalesce(x.error, '') <> '' then ' FAILED: ' || ({S.truncated(S.flat('x.error'), compact.FAILURE)})"
    " when coalesce(len(x.files), 0) > 0 then ' ' || array_to_string(x.files, ', ')"
    f" when coalesce(x.summary, '') <> '' then ': ' || ({S.truncated(S.flat('x.summary'), compact.SUMMARY)}) else '' end"
)
_DID_SQL = (
    f"concat_ws(chr(10), nullif(array_to_string(list_transform(list_filter(tools[1:12], lambda x: coalesce(x.error, '') = ''), lambda x: {_TOOL_SQL}), chr(10)), ''),"
    " case when len(tools) > 12 then '  · … ' || (len(tools) - 12) || ' more tool calls' end)"
)
_SAID_SQL = (
    f"concat_ws(chr(10), case when role = 'user' and not coalesce(meta, false) and {S.strip_wrappers('text')} <> '' then '[human] ' ||"
    f" ({S.truncated(S.strip_wrappers('text'), compact.HUMAN)}) end,"
    f" case when role = 'assistant' and thinking <> '' then '[agent thinking] ' || ({S.truncated(S.strip_wrappers('thinking'), compact.THINKING)}) end,"
    f" case when role = 'assistant' and text <> '' then '[agent] ' || ({S.truncated(S.strip_wrappers('text'), compact.TEXT)}) end,"
    f" nullif(array_to_string(list_transform(list_filter(tools[1:12], lambda x: coalesce(x.error, '') <> ''), lambda x: {_TOOL_SQL}), chr(10)), ''))"
)


@query(S.M + f"select session_key, seq, {_SAID_SQL} as said, {_DID_SQL} as did from m")
def rendered_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was said in each message and which routine calls it made, as lines; long texts, failures and summaries are cut."""
    return compact.rendered(_messages(spark, sf_dir, "role", "meta", "text", "thinking", "tools"))


@query(
    S.M + f"select session_key, seq, len(list_filter(tools[1:12], lambda x: coalesce(x.error, '') <> '')) as failures, {_DID_SQL} as did from m where tools is not null"
)
def tool_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Routine calls of each message as text, and how many of the first calls failed."""
    m = _messages(spark, sf_dir, "role", "meta", "text", "thinking", "tools").where("tools is not null")
    failures = F.size(F.filter(F.slice("tools", 1, 12), lambda t: text.nonempty(t["error"]).isNotNull())).cast("long")
    return compact.rendered(m).join(m.select("session_key", "seq", failures.alias("failures")), ["session_key", "seq"]).select("session_key", "seq", "failures", "did")


@query()
def session_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compact.payloads(_messages(spark, sf_dir, "role", "meta", "text", "thinking", "tools"), _sessions(spark, sf_dir), compact.BUDGET)


@query(
    S.M
    + f", x as (select distinct session_key from m where ({S.HUMAN}) and {S.strip_wrappers('text')} <> '' or {_SAID_SQL} <> '' or {_DID_SQL} <> '')"
    " select session_key, 'script' as model, null::varchar as error, 'keep {braces}' as rule, 1::bigint as claims from x join (select distinct"
    " session_key from sessions) using (session_key)"
)
def model_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads through a scripted model that answers with fenced JSON, decoded again."""
    prompts = compact.payloads(_messages(spark, sf_dir, "role", "meta", "text", "thinking", "tools"), _sessions(spark, sf_dir), compact.BUDGET)
    keyed = prompts.select(F.col("session_key").alias("i"), model.extraction_prompt(F.col("requests"), F.col("body"), F.array().cast("array<string>")).alias("prompt"))
    answer = 'Here it is:\n```json\n{"rejected": [], "invariants": [{"rule": "keep {braces}", "why": "they balance", "files": ["a.py"]}], "claims": ["it \\"works\\""]}\n```'
    answers = model.mapped(keyed, model.Scripted(_Fixed(answer)))
    return model.decoded(answers).select(
        F.col("i").alias("session_key"),
        "model",
        "error",
        F.col("value.invariants")[0]["rule"].alias("rule"),
        F.size("value.claims").cast("long").alias("claims")
    )


class _Fixed:
    def __init__(self, answer: str):
        self.answer = answer

    def __call__(self, prompt: str) -> str:
        return self.answer


# --- strings -----------------------------------------------------------------------------------


@query(
    "select doc_id, case when octet_length(encode(text)) <= 300 then text else left(text, list_max(list_filter(range(0, 301), lambda k:"
    " octet_length(encode(left(text, k))) <= 300))) || '…' end as cut from documents where text is not null"
)
def truncate_utf8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.truncate(F.col("text"), 300).alias("cut"))


@query(
    "with p as (select doc_id, text, left(text, list_max(list_filter(range(0, 401), lambda k: octet_length(encode(left(text, k))) <= 400))) as"
    " head from documents where text is not null)"
    " select doc_id, case when octet_length(encode(text)) <= 400 then text else case when contains(head, chr(10)) then regexp_replace(head,"
    " '\\n[^\\n]*\\z', '') else head end || '\n[cut]' end as cut from p"
)
def truncate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where("text is not null").select("doc_id", text.truncate_lines(F.col("text"), 400, F.lit("\n[cut]")).alias("cut"))


@query(
    f"select doc_id, trim(regexp_replace(text, '{S.UNICODE_SPACE}+', ' ', 'g'), ' ') as flat, regexp_replace(coalesce(path, ''), '[^A-Za-z0-9]',"
    " '-', 'g') as slug, coalesce(nullif(left(regexp_replace(coalesce(repo, ''), '[^A-Za-z0-9_-]', '-', 'g'), 64), ''), 'unnamed') as safe,"
    " left(md5(coalesce(path, '')), 8) as short,"
    " coalesce(split_part(path, '/', -1), '') as base, case when starts_with(path, 'src/') then substr(path, 5) else path end as below, n_chars"
    " || case when n_chars = 1 then ' character' else ' characters' end as size from documents where text is not null"
)
def string_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.coalesce("path", F.lit(""))
    return table(spark, sf_dir, "documents").where("text is not null").select(
        "doc_id", text.collapse(F.col("text")).alias("flat"), text.slug(path).alias("slug"), text.sanitize_id(F.coalesce("repo", F.lit(""))).alias("safe"), text.short(F.md5(path)).alias("short"), text.base_name(path).alias("base"), text.relative(F.col("path"), F.lit("src")).alias("below"), text.plural(
            F.col("n_chars"), "character", "characters"
        ).alias("size")
    )


@query(
    f"select message_id, {S.strip_wrappers('text')} as plain, {S.trimmed(S.first_group('text'))} as typed, replace(text, '</session>',"
    f" '<\\/session>') as fenced, coalesce({S.ARTIFACT}, false) as artifact from messages where text is not null"
)
def strip_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("text")
    return table(spark, sf_dir, "messages").where("text is not null").select(
        "message_id",
        text.strip_wrappers(t).alias("plain"),
        text.unwrap_query(t).alias("typed"),
        text.fence(t, "session").alias("fenced"),
        F.coalesce(text.is_artifact(t), F.lit(False)).alias("artifact")
    )


@query(
    "with p as (select distinct sha, subject, body from commits) select sha, case when coalesce(body, '') = '' then subject else"
    " concat_ws(chr(10) || chr(10), subject, body) end as message, coalesce(list_filter(list_transform(string_split(body, chr(10)), lambda x:"
    " regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '')[1], '') as first,"
    " len(list_filter(list_transform(string_split(coalesce(body, ''), ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <>"
    " '')) as items, starts_with(lower(coalesce(subject, '')), 'why:') as keyed from p"
)
def message_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir, "subject", "body").select("sha", "subject", "body").distinct()
    return c.select(
        "sha",
        text.message_text(F.col("subject"), F.col("body")).alias("message"),
        text.first_line(F.col("body")).alias("first"),
        F.size(text.split_list(F.coalesce("body", F.lit("")))).cast("long").alias("items"),
        text.has_key(F.coalesce("subject", F.lit("")), "why").alias("keyed")
    )


@query(
    "with p as (select distinct sha, subject, body from commits), m as (select sha, case when coalesce(body, '') = '' then subject else"
    " concat_ws(chr(10) || chr(10), subject, body) end as m from p),"
    " l as (select sha, m, string_split(m, chr(10)) as l from m where m is not null), k as (select *,"
    " coalesce(nullif(list_position(list_transform(list_reverse(l), lambda x: x <> '' and not starts_with(x, '#')), true), 0), len(l) + 1) - 1 as"
    " k from l),"
    " t as (select *, array_to_string(l[len(l) - k + 1:], chr(10)) as tail, len(list_filter(l[len(l) - k + 1:], lambda x: starts_with(x, '#'))) > 0 as has from k),"
    " d as (select *, regexp_replace(regexp_replace(m, '(?m)^#.*(\\n|\\z)', '', 'g'), '(?m)[ \\t\\r]+$', '', 'g') as plain from t)"
    " select sha, sha256(regexp_replace(regexp_replace(plain, '\\n{3,}', chr(10) || chr(10), 'g'), '^\\n+|\\n+$', '', 'g')) as digest, case when"
    " has then left(m, len(m) - len(tail)) else m end as body, case when has then tail else '' end as tail from d"
)
def commit_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A digest of each message that comments and blank space don't change, and the message without its trailing comments."""
    c = _commits(spark, sf_dir, "subject", "body").select("sha", text.message_text(F.col("subject"), F.col("body")).alias("m")).where("m is not null").distinct()
    return c.select(
        "sha",
        text.message_digest(F.col("m")).alias("digest"),
        text.split_comment(F.col("m"))["body"].alias("body"),
        text.split_comment(F.col("m"))["tail"].alias("tail")
    )


@query(
    "select rule_id, list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower(coalesce(rule, '')), '[^a-z0-9а-яё]+'), lambda"
    f" w: w <> '' and not list_contains({list(text.STOPWORDS)!r}, w)), lambda w: {S.SINGULAR}))) as tokens from rule_entries"
)
def rule_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "rule_entries").select("rule_id", text.tokens(F.coalesce("rule", F.lit(""))).alias("tokens"))


@query(f"select entry_id, case when regexp_full_match(ts, '{S.RFC3339}') then epoch_us(try_cast(ts as timestamptz)) end as at from log_entries")
def parse_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of each line in microseconds; null where its stamp is missing, unreadable or without a zone."""
    return table(spark, sf_dir, "log_entries").select("entry_id", F.unix_micros(times.instant(F.col("ts"))).alias("at"))


# --- JSON --------------------------------------------------------------------------------------


@query(
    S.LOG + "select entry_id, json_extract_string(v, '$.role') as role, nullif(json_extract_string(v, '$.model'), '') as model, json_type(v, '$.content')"
    " as shape, case when json_type(v, '$.content') = 'ARRAY' then json_array_length(v, '$.content') end::bigint as parts from v where"
    " json_type(v) = 'OBJECT'"
)
def message_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = table(spark, sf_dir, "log_entries").select("entry_id", payload.opened(F.col("message")).alias("v")).where(payload.kind(F.col("v")) == "OBJECT")
    v, shape = F.col("v"), payload.kind(F.try_variant_get(F.col("v"), "$.content", "variant"))
    return log.select(
        "entry_id",
        payload.text_at(v, "$.role").alias("role"),
        text.nonempty(payload.text_at(v, "$.model")).alias("model"),
        F.when(shape == "STRING", "VARCHAR").otherwise(shape).alias("shape"),
        F.size(F.try_variant_get(v, "$.content", "array<variant>")).cast("long").alias("parts")
    )


_FILES_SQL = "list_filter([" + ", ".join(f"json_extract_string({{v}}, '$.{k}')" for k in payload.PATH_KEYS_A) + "], lambda x: x <> '')"


@query(
    S.LOG + ", p as (select entry_id, i::bigint as part, json_extract(v, '$.content[' || i || ']') as p from v, unnest(range(0,"
    " coalesce(json_array_length(v, '$.content'), 0)::bigint)) as u(i) where json_type(v) = 'OBJECT' and json_type(v, '$.content') = 'ARRAY'), q"
    " as (select entry_id, part, json_extract_string(p, '$.name') as tool, case when json_type(p, '$.input') = 'VARCHAR' then case when"
    " json_valid(json_extract_string(p, '$.input')) then json_extract_string(p, '$.input')::json end else json_extract(p, '$.input') end as input"
    " from p where json_extract_string(p, '$.type') = 'tool_use')"
    f" select entry_id, part, tool, list_concat({_FILES_SQL.format(v='input')}, coalesce(flatten(list_transform(json_extract(input, '$.edits[*]'),"
    f" lambda e: {_FILES_SQL.format(v='e')})), [])) as files, {S.truncated('s', 200)} as summary"
    " from (select *,"
    f" {S.flat(f"coalesce({', '.join(f'nullif(json_extract_string(input, {chr(39)}$.{k}{chr(39)}), {chr(39)}{chr(39)})' for k in payload.SUMMARY_KEYS_A)}, '')")}"
    " as s from q)"
)
def tool_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tool calls of the raw log with the paths and the summary of their inputs."""
    log = table(spark, sf_dir, "log_entries").where("message like '%tool_use%'").select("entry_id", payload.opened(F.col("message")).alias("v"))
    parts = log.select(
        "entry_id", F.posexplode(F.try_variant_get("v", "$.content", "array<variant>")).alias("part", "p")
    ).where(payload.text_at(F.col("p"), "$.type") == "tool_use")
    held = payload.text_at(F.col("p"), "$.input")
    calls = parts.withColumn("input", F.when(held.isNotNull(), F.try_parse_json(held)).otherwise(F.try_variant_get("p", "$.input", "variant")))
    return calls.select(
        "entry_id",
        F.col("part").cast("long").alias("part"),
        payload.text_at(F.col("p"), "$.name").alias("tool"),
        payload.files_of(F.col("input")).alias("files"),
        payload.summary_of(F.col("input")).alias("summary")
    )


_CALLS_SQL = (
    ", p as (select entry_id, i::bigint as part, json_extract(v, '$.content[' || i || ']') as p from v, unnest(range(0,"
    " coalesce(json_array_length(v, '$.content'), 0)::bigint)) as u(i)"
    " where json_type(v) = 'OBJECT' and json_type(v, '$.content') = 'ARRAY'), q as (select entry_id, part, case when json_type(p, '$.input') = 'VARCHAR'"
    " then case when json_valid(json_extract_string(p, '$.input')) then json_extract_string(p, '$.input')::json end else json_extract(p,"
    " '$.input') end as input from p where json_extract_string(p, '$.type') = 'tool_use')"
)


@query(
    S.LOG
    + _CALLS_SQL
    + ", e as (select q.entry_id, q.part, nullif(l.session_id, '') as session, nullif(l.cwd, '') as cwd,"
    f" coalesce({', '.join(f"nullif(json_extract_string(input, '$.{k}'), '')" for k in payload.EVENT_PATH_KEYS)}) as path from q join log_entries"
    " l using (entry_id))"
    " select entry_id, part, session, path, coalesce(cwd, case when starts_with(path, '/') then nullif(regexp_replace(path, '/[^/]*$', ''), '')"
    " end, '/srv') as dir from e"
)
def touch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each tool call of the log as the event that a harness sends: which session touched which file, and where."""
    log = table(spark, sf_dir, "log_entries").where("message like '%tool_use%'").select("entry_id", "session_id", "cwd", payload.opened(F.col("message")).alias("v"))
    parts = log.select(
        "entry_id", "session_id", "cwd", F.posexplode(F.try_variant_get("v", "$.content", "array<variant>")).alias("part", "p")
    ).where(payload.text_at(F.col("p"), "$.type") == "tool_use")
    held = payload.text_at(F.col("p"), "$.input")
    given = F.when(held.isNotNull(), F.try_parse_json(held)).otherwise(F.try_variant_get("p", "$.input", "variant"))
    around = F.to_json(F.struct("session_id", "cwd"))
    event = F.try_parse_json(
        F.concat(
            F.lit('{"tool_input":'),
            F.coalesce(F.to_json(given), F.lit("null")),
            F.when(around == "{}", "").otherwise(F.lit(",")),
            F.substring(around, 2, 1 << 30)
        )
    )
    calls = parts.select("entry_id", F.col("part").cast("long").alias("part"), event.alias("e"))
    return calls.select(
        "entry_id",
        "part",
        payload.event_session(F.col("e")).alias("session"),
        payload.event_path(F.col("e")).alias("path"),
        payload.event_dir(F.col("e"), F.lit("/srv")).alias("dir")
    )


@query("select event_id, json_extract_string(props, '$.k')::bigint as k, json_object('user', user_id, 'kind', event_type)::varchar as emitted from events")
def event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(
        "event_id",
        F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k"),
        F.to_json(F.struct(F.col("user_id").alias("user"), F.col("event_type").alias("kind"))).alias("emitted")
    )


# --- rules -------------------------------------------------------------------------------------

_VERDICTS = "v as (select sha, pos, rule as claim, case when coalesce(why, '') = '' then 'unverifiable' when coalesce(len(files), 0) = 0 then 'contradicted' else 'supported' end as status from r)"


@query(
    S.R + S.CO + ", " + _VERDICTS + ", a as (select sha, count(*) as n, count(*) filter (status = 'contradicted') as against, count(*) filter (status = 'supported') as good, list_sort(list_distinct(list(claim) filter (status = 'contradicted' and claim is not null))) as disputed from v group by sha)"
    " select sha, case when coalesce(n, 0) = 0 then 'unverified' when against > 0 then 'disputed' when good = n then 'verified' else 'partial'"
    " end as confidence, coalesce(disputed, []) as disputed from (select distinct sha from c) left join a using (sha)"
)
def confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts stand for a model's: no reason is unverifiable, no file contradicted."""
    r = _rules(spark, sf_dir)
    status = F.when(F.coalesce("why", F.lit("")) == "", "unclear").when(F.coalesce(F.size("files"), F.lit(0)) <= 0, "contradicted").otherwise("Supported")
    verdicts = r.select("sha", F.struct("kind", "pos").alias("idx"), status.alias("status"))
    claims = r.select("sha", F.struct("kind", "pos").alias("idx"), F.col("rule").alias("claim"))
    return rules.confidence(table(spark, sf_dir, "commits").select("sha"), rules.attached(verdicts, claims))


@query(S.R + "select sha, len(list_distinct(flatten(list(list_filter(files, lambda x: x <> '')))))::bigint as n from r where files is not null group by sha")
def commit_file_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rules(spark, sf_dir).select("sha", F.explode("files").alias("f")).where("f <> ''")
    counted = r.groupBy("sha").agg(F.countDistinct("f").alias("n"))
    return _rules(spark, sf_dir).where("files is not null").select("sha").distinct().join(counted, "sha", "left").select("sha", F.coalesce("n", F.lit(0)).alias("n"))


@query(
    S.R + "select a.sha, a.kind, a.pos, list_distinct_ordered as files from (select sha, kind, pos, list_filter(u, lambda x, i: x <> '' and"
    " list_position(u, x) = i)[1:3] as list_distinct_ordered from (select x.sha, x.kind, x.pos, list_concat(coalesce(x.files, []),"
    " coalesce(y.files, [])) as u from r x join r y on y.sha = x.sha and y.kind = x.kind and y.pos = x.pos + 1)) a"
)
def files_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The united files of each entry and the one behind it."""
    r = _rules(spark, sf_dir)
    after = r.select("sha", "kind", (F.col("pos") - 1).alias("pos"), F.col("files").alias("more"))
    return r.join(after, ["sha", "kind", "pos"]).select("sha", "kind", "pos", sessions.union_capped(F.col("files"), F.col("more")).alias("files"))


@query(
    S.R
    + S.CF
    + ", st as (select sha, list(path order by path) as staged from cf group by sha)"
    f", p as (select sha, kind, pos, {S.cleaned_value('rule', rules.RULE_BYTES)} as rule, {S.cleaned_value('why', rules.WHY_BYTES)} as why, files from r)"
    f", q as (select *, {S.prepared('rule', "''", '[]::varchar[]')} as a, {S.prepared('why', "''", '[]::varchar[]')} as b from p where rule <> '' and why <> ''"
    f" and lower(regexp_replace({S.trimmed('why')}, '[. ]+$', '')) not in {rules.NON_REASONS!r} and not"
    f" ({' or '.join(f"contains(lower(rule), '{m}')" for m in rules.SELF_MARKERS)}))"
    f", o as (select q.*, st.staged from q join st using (sha) where not {S.same('q.a', 'q.b', rules.SAME)})"
    f", n as (select *, list_filter(list_transform(coalesce(files, []), lambda f: {S.matched('f', 'staged')}), lambda f: f <> '') as named from o)"
    ", u as (select *, case when coalesce(len(files), 0) = 0 then case when len(staged) = 1 then staged else [] end else list_filter(named,"
    " lambda x, i: list_position(named, x) = i) end[1:3] as bound from n)"
    f", g as (select sha, kind, list({S.prepared('rule', 'why', 'bound')} order by pos) as l from u where len(bound) > 0 group by sha, kind)"
    f", k as (select sha, kind, {S.folded('l')}[1:case when kind = 'reject' then {rules.REJECTED} else {rules.INVARIANTS} end] as k from g)"
    " select sha, kind, i - 1 as pos, k[i].rule as rule, k[i].why as why, k[i].files as files from k, unnest(range(1, len(k) + 1)) as x(i)"
)
def clean_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of each commit that survive cleaning, bound to the commit's files in order."""
    files = _commit_files(spark, sf_dir).groupBy("sha").agg(F.array_sort(F.collect_list("path")).alias("staged"))
    return rules.cleaned(_rules(spark, sf_dir), files)


@query(
    S.R
    + S.CF
    + ", st as (select sha, list(path order by path) as staged from cf group by sha) select sha, kind, pos, list_transform(coalesce(files, []),"
    f" lambda f: {S.matched('f', 'staged')}) as matched from r join st using (sha)"
)
def matched_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The commit's path that each file of an entry means."""
    files = _commit_files(spark, sf_dir).groupBy("sha").agg(F.array_sort(F.collect_list("path")).alias("staged"))
    named = F.coalesce("files", F.array().cast("array<string>"))
    return _rules(spark, sf_dir, "files").join(files, "sha").select(
        "sha", "kind", "pos", F.transform(named, lambda f: rules.matched_path(f, F.col("staged"))).alias("matched")
    )


@query(
    S.R
    + f", e as (select sha, kind, list({S.prepared("coalesce(rule, '')", "coalesce(why, '')", 'coalesce(files, [])')} order by pos) as l,"
    f" list({S.prepared("coalesce(why, '')", "''", '[]::varchar[]')} order by pos) as c from r group by sha, kind)"
    ", g as (select sha, count(*) as n, flatten(list(l order by kind)) as l, flatten(list(c order by kind)) as c from e group by sha)"
    f", t as (select sha, n, l, c, {S.folded('l')} as f,"
    f" {S.folded_texts(f"list_filter(list_transform(c, lambda x: {S.prepared(S.trimmed('x.rule'), "''", '[]::varchar[]')}), lambda x: x.rule <> '')")}"
    " as d from g)"
    ", o as (select sha, case when n = 1 then l else f end as rules, case when n = 1 then c else d[1:8] end as claims, case when n = 1 then 0"
    " else len(l) - len(f) end as folded_away from t)"
    " select sha, list_transform(rules, lambda x: x.rule) as rules, list_transform(rules, lambda x: x.why) as whys, list_transform(rules, lambda"
    " x: array_to_string(x.files, ',')) as files,"
    " list_transform(claims, lambda x: x.rule) as claims, folded_away::bigint as folded_away from o"
)
def merge_extractions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each kind of a commit's entries stands for one session's extraction."""
    r = _rules(spark, sf_dir)
    one = F.struct(
        F.coalesce("rule", F.lit("")).alias("rule"),
        F.coalesce("why", F.lit("")).alias("why"),
        F.coalesce("files", F.array().cast("array<string>")).alias("files")
    )
    per = r.groupBy("sha", F.col("kind").alias("ord")).agg(F.array_sort(F.collect_list(F.struct("pos", one.alias("r")))).alias("l"))
    parts = per.select("sha", "ord", F.transform("l", lambda x: x["r"]).alias("rules"), F.transform("l", lambda x: x["r"]["why"]).alias("claims"))
    merged = rules.merged(parts)
    of = lambda f: F.transform("rules", f)
    return merged.select(
        "sha",
        of(lambda x: x["rule"]).alias("rules"),
        of(lambda x: x["why"]).alias("whys"),
        of(lambda x: F.array_join(x["files"], ",")).alias("files"),
        "claims",
        "folded_away"
    )


_TOKENS_SQL = f"list_sort(list_distinct(list_transform(list_filter(string_split_regex(lower(rule), '[^a-z0-9а-яё]+'), lambda w: w <> '' and not list_contains({list(text.STOPWORDS)!r}, w)), lambda w: {S.SINGULAR})))"


@query(
    f"with t as (select rule_id, sha, kind, {S.trimmed('rule')} as rule, {_TOKENS_SQL} as t from rule_entries where rule is not null and sha is"
    " not null and kind is not null),"
    " p as (select x.rule_id as a, y.rule_id as b, x.rule as ra, y.rule as rb, len(x.t) as na, len(y.t) as nb, list_filter(x.t, lambda w:"
    " regexp_full_match(w, '[0-9]+')) = list_filter(y.t, lambda w: regexp_full_match(w, '[0-9]+')) as numbers, list_intersect(x.t, y.t) as i,"
    " len(list_distinct(list_concat(x.t, y.t))) as u from t x join t y on x.sha = y.sha and x.kind = y.kind and x.rule_id < y.rule_id),"
    " q as (select *, len(i) / u as j, len(list_filter(i, lambda w: octet_length(encode(w)) >= 6 or regexp_matches(w, '[0-9]'))) > 0 as heavy from p where len(i) > 0)"
    " select a, b, round(j, 6) as score, heavy from q where ra <> '' and rb <> '' and numbers and case when na < 3 or nb < 3 then lower(ra) ="
    " lower(rb) else j >= 0.55 or (j >= 0.32 and heavy) end"
)
def similar_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a commit's entries of one kind that would fold."""
    r = table(spark, sf_dir, "rule_entries").where("rule is not null and sha is not null and kind is not null")
    return rules.fold_candidates(r, ["sha", "kind"], "rule_id").select("a", "b", "score", "heavy")


@query(
    S.R
    + ", v as (select sha, kind, pos, flat, reason, "
    + f"{S.truncated('flat', rules.RULE_BYTES)} as rule from (select sha, kind, pos, {S.flat("coalesce(rule, '')")} as flat,"
    " lower(regexp_replace(regexp_replace(coalesce(why, ''), '^\\s+|\\s+$', '', 'g'), '[. ]+$', '')) as reason from r))"
    f" select sha, kind, pos, rule from v where flat not in {text.EMPTY_WORDS!r} and flat <> '' and reason not in {rules.NON_REASONS!r}"
    f" and not ({' or '.join(f"contains(lower(rule), '{m}')" for m in rules.SELF_MARKERS)})"
)
def valid_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _rules(spark, sf_dir).select("sha", "kind", "pos", text.clean_value(F.col("rule"), rules.RULE_BYTES).alias("rule"), F.coalesce("why", F.lit("")).alias("why"))
    return r.where((F.col("rule") != "") & ~rules.no_reason(F.col("why")) & ~rules.describes_itself(F.col("rule"))).select("sha", "kind", "pos", "rule")


# --- records -----------------------------------------------------------------------------------


@query(S.PARSE)
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.parsed(_commits(spark, sf_dir, "body", "note"))


def _flat(c: str) -> str:
    return f"trim(regexp_replace({c}, '{S.UNICODE_SPACE}+', ' ', 'g'), ' ')"



@query(
    S.R + f"select sha, kind, row_number() over (partition by sha order by case when kind = 'reject' then 0 else 1 end, pos) - 1 as pos, {_flat('rule')}"
    f" as rule, nullif({_flat('why')}, '') as why, list_filter(coalesce(files, []), lambda x: x <> '') as files from r where kind in ('reject',"
    " 'invariant') and trim(rule) <> ''"
)
def render_and_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries written as a block and read again."""
    r = _rules(spark, sf_dir).where("kind in ('reject', 'invariant') and trim(rule) <> ''")
    blocks = record.rendered(r)
    return record.parsed(blocks.select("sha", F.col("block").alias("body"), F.lit(None).cast("string").alias("note")), record.SESSION_RECORD)


@query(S.CO + S.TRAILER_TABLES + "select sha, pos, key, value from trailers")
def commit_trailers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.trailers(_commits(spark, sf_dir, "body"))


@query(
    S.PARSE_TABLES + S.TRAILER_TABLES
    + ", tr as (select sha, max(value) filter (ends_with(lower(key), '-agent')) as agent, max(value) filter (ends_with(lower(key), '-confidence'))"
    " as confidence, list_sort(list_distinct(list(value) filter (ends_with(lower(key), '-disputed')))) as disputed from trailers group by sha),"
    " en as (select sha, count(*) filter (kind = 'reject') as rejected, count(*) filter (kind = 'invariant') as invariants from q where rule <> '' group by sha)"
    " select sha, agent, confidence, coalesce(disputed, []) as disputed, coalesce(rejected, 0) as rejected, coalesce(invariants, 0) as invariants"
    " from c left join tr using (sha) left join en using (sha) where agent <> '' or confidence <> '' or rejected + invariants > 0"
)
def commit_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _commits(spark, sf_dir, "body", "note")
    return record.records(c, record.parsed(c), record.trailers(c))


@query(
    S.CO + "select sha, concat_ws(chr(10) || chr(10), nullif(regexp_replace(coalesce(body, ''), '\\n+\\z', ''), ''), nullif('<session-record>' ||"
    " chr(10) || 'reject: ' || subject || chr(10) || '</session-record>', ''), 'Loom-Agent: agent-a' || coalesce(chr(10) || 'Loom-Files: ' ||"
    " nullif(repo, ''), '')) as message from c"
)
def composed_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    block = F.concat(F.lit("<session-record>\nreject: "), F.col("subject"), F.lit("\n</session-record>"))
    lines = record.trailers_of([("Agent", F.array(F.lit("agent-a"))), ("Disputed", F.array(F.lit(""))), ("Files", F.array("repo"))])
    return _commits(spark, sf_dir, "subject", "body", "repo").select("sha", record.composed(F.coalesce("body", F.lit("")), block, lines).alias("message"))


@query(S.SERVED + "select path, ord, sha, text, total, count(*) over (partition by path) as kept from fit")
def served_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.served(_commit_files(spark, sf_dir), _rules(spark, sf_dir, "rule", "files"), _commits(spark, sf_dir, "short", "ts"))


@query(
    S.SERVED + ", k as (select *, count(*) over (partition by path) as kept from fit) select path, any_value(kept) as commits, any_value(total) -"
    " any_value(kept) as dropped, 'Rules from ' || any_value(kept) || case when any_value(kept) = 1 then ' commit' else ' commits' end || ' that"
    " bind ' || path || ':' || chr(10) || string_agg(text, '' order by ord) || case when any_value(total) > any_value(kept) then '… and ' ||"
    " (any_value(total) - any_value(kept)) || ' more for ' || path || chr(10) else '' end as text from k group by path"
)
def served_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.served_text(served_context(spark, sf_dir))


@query(S.SERVED + "select path, to_json({'file': path, 'commits': list({'commit': sha, 'text': text} order by ord)})::varchar as json from fit group by path")
def served_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record.served_json(served_context(spark, sf_dir))


@query()
def printed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each commit with its record as a person reads it."""
    c = _commits(spark, sf_dir, "body", "note")
    entries = record.parsed(c)
    return record.printed(_commits(spark, sf_dir, "short", "subject"), record.records(c, entries, record.trailers(c)), entries)


# --- delivery ----------------------------------------------------------------------------------


@query(
    "with e as (select event_id, user_id, json_extract_string(props, '$.k') as path, event_type = 'error' as reset, sum(case when event_type ="
    " 'error' then 1 else 0 end) over (partition by user_id order by ts, event_id rows unbounded preceding)::bigint as epoch from events)"
    " select event_id, user_id, path from e where not reset and path is not null qualify row_number() over (partition by user_id, path, epoch order by event_id) = 1"
)
def once_per_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        "ts",
        payload.text_at(F.try_parse_json(F.regexp_replace("props", r'("k":\s*)(\d+)', '$1"$2"')), "$.k").alias("path"),
        (F.col("event_type") == "error").alias("reset")
    )
    return delivery.once(e, "user_id", ["ts", "event_id"], block=F.unix_date(F.to_date("ts"))).select("event_id", "user_id", "path")
