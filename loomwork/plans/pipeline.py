"""From sessions to records: select, compact, extract, clean, merge, verify, render - one plan for all commits at once.

Model calls are the only steps outside Catalyst; their answers are staged, so that nothing is asked twice. Failures degrade a
commit, never the run: without an extraction it is metadata-only, without a verification unverified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork import model
from loomwork.functions.text import short
from loomwork.operators import compact, record, rules, sessions
from loomwork.sources.stage import staged

_RULES = "array<struct<rule:string,why:string,files:array<string>>>"


def extracted(
    messages: DataFrame, known: DataFrame, engine: model.Engine, budget: int = compact.BUDGET, files: DataFrame | None = None, seconds: float = model.CALL_S
) -> DataFrame:
    """session_key, value (rejected, invariants, claims), model, error, notes, took: one call a session with a payload.

    seconds: what a session has for both passes; the second pass's reserve is held back from the first."""
    pay = compact.payloads(messages, known, budget)
    named = pay if files is None else pay.join(files, "session_key", "left")
    paths = F.coalesce("files", F.array().cast("array<string>")) if files is not None else F.array().cast("array<string>")
    prompts = staged(named.select(F.col("session_key").alias("i"), "notes", model.extraction_prompt(F.col("requests"), F.col("body"), paths).alias("prompt")))
    first = seconds - model.RESERVE_S if seconds > model.RESERVE_S else seconds
    answers = staged(model.mapped(prompts, engine, seconds=first))
    unusable = F.when(F.col("error").isNull() & F.col("value").isNull(), F.lit("unusable JSON"))
    found = model.decoded(answers).join(prompts.select("i", "notes"), "i")
    return found.select(F.col("i").alias("session_key"), "value", "model", F.coalesce("error", unusable).alias("error"), "notes", "took")


def distilled(linked: DataFrame, found: DataFrame, staged_files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rules, claims, folded) of each commit: every session's extraction cleaned by itself, then merged, the oldest session first.

    linked(sha, session_key, updated_ts), found as from extracted, staged_files(sha, staged). Undated sessions come first, equal times go by session_key. rules: sha, kind, pos, rule, why, files; claims: sha, idx, claim; folded:
    sha, reject, invariant, how many rules of a kind said what another said."""
    per = linked.join(found.where("value is not null"), "session_key").withColumn("one", F.concat_ws("\u001f", "sha", "session_key"))
    kinds = F.array(
        *[
            F.struct(F.lit(k).alias("kind"), F.coalesce(F.col(f"value.{c}"), F.array().cast(_RULES)).alias("r")) for k,
            c in (("reject", "rejected"), ("invariant", "invariants"))
        ]
    )
    rows = per.select("one", F.explode(kinds).alias("k")).select("one", "k.kind", F.posexplode("k.r").alias("pos", "x")).select(
        F.col("one").alias("sha"), "kind", F.col("pos").cast("long").alias("pos"), "x.rule", "x.why", "x.files"
    )
    clean = rules.cleaned(rows, per.join(staged_files, "sha").select(F.col("one").alias("sha"), "staged"))
    split = F.split("sha", "\u001f")
    place = F.struct("updated_ts", F.col("session_key").alias("key"))
    dated = clean.join(per.select(F.col("one").alias("sha"), place.alias("ord")), "sha")
    groups = dated.groupBy(split[0].alias("commit"), "ord", "kind").agg(
        F.array_sort(F.collect_list(F.struct("pos", F.struct("rule", "why", "files").alias("r")))).alias("l")
    )
    parts = groups.select(
        F.concat_ws("\u001f", "commit", "kind").alias("sha"),
        "ord",
        F.transform("l", lambda x: x["r"]).alias("rules"),
        F.array().cast("array<string>").alias("claims")
    )
    joined = staged(rules.merged(parts))
    counts = joined.select(split[0].alias("sha"), split[1].alias("kind"), "folded_away").groupBy("sha")
    folded = counts.agg(*[F.sum(F.when(F.col("kind") == k, F.col("folded_away")).otherwise(0)).alias(k) for k in ("reject", "invariant")])
    kept = joined.select(
        split[0].alias("sha"), split[1].alias("kind"), F.posexplode("rules").alias("pos", "x")
    ).select("sha", "kind", F.col("pos").cast("long").alias("pos"), "x.rule", "x.why", "x.files")
    said = per.select(
        "sha",
        place.alias("ord"),
        F.array().cast(_RULES).alias("rules"),
        rules.cleaned_claims(F.coalesce("value.claims", F.array().cast("array<string>"))).alias("claims")
    )
    claims = rules.merged(said).select("sha", F.posexplode(F.slice("claims", 1, rules.MERGED_CLAIMS)).alias("idx", "claim"))
    return kept, claims, folded


def verified(commits: DataFrame, claims: DataFrame, diffs: DataFrame, extracted_shas: DataFrame, engine: model.Engine, left: DataFrame | None = None) -> DataFrame:
    """sha, confidence, disputed, note. The verifier sees the claims and the diff only.

    left(sha, seconds, total): what the first pass left of a commit's time; with less than the reserve nothing is asked."""
    asked = claims.groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("idx", "claim"))).alias("c")).join(diffs.select("sha", "diff"), "sha", "left")
    if left is not None:
        asked = asked.join(left, "sha", "left")
    limit = F.coalesce("seconds", F.lit(model.CALL_S)) if left is not None else F.lit(model.CALL_S)
    prompt = model.verification_prompt(F.transform("c", lambda x: x["claim"]), F.coalesce("diff", F.lit(""))).alias("prompt")
    prompts = staged(asked.select(F.col("sha").alias("i"), prompt, limit.alias("seconds")))
    answers = staged(model.mapped(prompts.where(F.col("seconds") >= model.RESERVE_S), engine))
    replies = staged(model.decoded(answers, model.VERIFICATION).withColumnRenamed("i", "sha"))
    verdicts = replies.select("sha", F.explode("value.claims").alias("v")).select("sha", F.col("v.index").alias("idx"), "v.status").dropDuplicates(["sha", "idx"])
    scored = rules.confidence(commits, rules.attached(verdicts, claims))
    done = extracted_shas.select("sha").distinct().withColumn("done", F.lit(True))
    told = prompts.select(F.col("i").alias("sha"), "seconds").join(replies.select("sha", "error", F.col("value").isNull().alias("unread")), "sha", "left")
    note = (
        F.when(F.col("seconds") < model.RESERVE_S, F.concat(F.lit("verification skipped: "), F.round("seconds", 1).cast("string"), F.lit(" s left")))
        .when(F.col("error").isNotNull(), F.concat(F.lit("verification failed: "), F.col("error")))
        .when(F.col("unread"), F.lit("verification returned unusable JSON"))
    )
    level = F.when(F.col("done"), F.col("confidence")).otherwise("metadata-only")
    without = F.when(F.col("done") & F.col("seconds").isNull(), F.lit("no checkable claims to verify"))
    return scored.join(done, "sha", "left").join(told, "sha", "left").select("sha", level.alias("confidence"), "disputed", F.coalesce(note, without).alias("note"))


def _notes(linked: DataFrame, candidates: DataFrame, found: DataFrame, known: DataFrame, diffs: DataFrame, folded: DataFrame, scored: DataFrame) -> DataFrame:
    """sha, notes: in order, what was left out, cut, degraded, failed, folded and not verified."""
    text = lambda c: F.col(c).cast("string")
    rows = lambda df, ord_, note, key="": df.select(
        "sha", F.lit(ord_).alias("ord"), F.lit(key).alias("key") if isinstance(key, str) else key.alias("key"), note.alias("note")
    )
    counts = candidates.select("sha", "session_key").distinct().groupBy("sha").agg(F.count("*").alias("all")).join(
        linked.groupBy("sha").agg(F.max("skipped").alias("skipped"), F.count("*").alias("n")), "sha"
    )
    each = linked.select("sha", "session_key").join(found.drop("value"), "session_key", "left").join(known, "session_key", "left")
    who = F.concat(short(F.coalesce("session_id", "session_key")), F.lit(" ("), F.coalesce("agent", F.lit("")), F.lit(")"))
    reason = F.col("degraded_reason") if "degraded_reason" in known.columns else F.lit(None).cast("string")
    empty = each.groupBy("sha").agg(F.count("*").alias("n"), F.count("took").alias("asked")).where("asked = 0")
    cut = F.col("truncated") if "truncated" in diffs.columns else F.lit(False)
    worded = lambda c, what: F.when(F.col(c) > 0, F.concat(text(c), F.lit(f" {what} worded twice")))
    all_rows = [
        rows(counts.where("skipped > 0"), 0, F.concat(text("skipped"), F.lit(" of "), text("all"), F.lit(" sessions wrote none of the staged files and were left out"))),
        rows(each.select("sha", "session_key", F.explode("notes").alias("x")), 1, F.col("x"), F.col("session_key")),
        rows(empty, 2, F.concat(F.lit("nothing to distill from "), text("n"), F.lit(" session(s)"))),
        rows(each.withColumn("reason", reason).where("reason <> ''"), 3, F.concat("agent", F.lit(" session read degraded: "), F.col("reason")), F.col("session_key")),
        rows(diffs.where(cut).join(counts, "sha", "left_semi"), 4, F.lit("the diff was cut, so claims on the rest cannot be verified")),
        rows(each.where("error is not null"), 5, F.concat(who, F.lit(" not distilled: "), F.col("error")), F.col("session_key")),
        rows(folded, 6, F.concat_ws("; ", worded("reject", "rejected alternatives were the same option"), worded("invariant", "invariants were the same rule"))),
        rows(scored, 7, F.col("note")),
    ]
    whole = all_rows[0]
    for more in all_rows[1:]:
        whole = whole.unionByName(more)
    per = whole.where("note <> ''").groupBy("sha").agg(F.array_sort(F.collect_list(F.struct("ord", "key", "note"))).alias("l"))
    return per.select("sha", F.transform("l", lambda x: x["note"]).alias("notes"))


def run(
    candidates: DataFrame, messages: DataFrame, known: DataFrame, staged_files: DataFrame, diffs: DataFrame, extract: model.Engine, verify: model.Engine, name: str = record.SESSION_RECORD, seconds: float = model.CALL_S
) -> DataFrame:
    """sha, confidence, disputed, block, sessions, skipped, notes of every commit in candidates(sha, session_key); staged_files(sha, path), diffs(sha, diff).

    seconds: the time of a session; a commit of N sessions has N times as much, and the second pass what the first left of it."""
    times = known.select("session_key", "updated_ts" if "updated_ts" in known.columns else F.lit(None).cast("timestamp").alias("updated_ts"))
    linked = staged(sessions.relevant(candidates, sessions.written_files(messages), staged_files).join(times, "session_key", "left"))
    paths = staged_files.groupBy("sha").agg(F.array_sort(F.collect_set("path")).alias("staged"))
    found = staged(extracted(messages.join(linked.select("session_key").distinct(), "session_key", "left_semi"), known, extract, seconds=seconds))
    kept, claims, folded = distilled(linked.select("sha", "session_key", "updated_ts"), found, paths)
    kept, claims, folded = staged(kept), staged(claims), staged(folded)
    commits = candidates.select("sha").distinct()
    spent = linked.join(found.select("session_key", "took"), "session_key", "left").groupBy("sha").agg(
        (F.count("*") * seconds - F.sum(F.coalesce("took", F.lit(0.0)))).alias("seconds")
    )
    done = linked.join(found.where("value is not null").select("session_key"), "session_key", "left_semi")
    scored = staged(verified(commits, claims, diffs, done, verify, spent))
    counts = linked.groupBy("sha").agg(F.count("*").alias("sessions"), F.max("skipped").alias("skipped"))
    blocks = record.rendered(kept, name)
    told = _notes(linked, candidates, found, known, diffs, folded, scored)
    whole = scored.join(counts, "sha", "left").join(blocks, "sha", "left").join(told, "sha", "left")
    return whole.select(
        "sha",
        "confidence",
        "disputed",
        F.coalesce("block", F.lit("")).alias("block"),
        "sessions",
        "skipped",
        F.coalesce("notes", F.array().cast("array<string>")).alias("notes")
    )
