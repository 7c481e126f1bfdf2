"""Content-lifecycle queries over projects, clips, tickets and beats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cadenza.functions.scoring import blank_to_null, filled, first_text, safe_name, said, stripped
from cadenza.sources.bridge import COPY, PLATFORMS, STAGES

#: Fixed values of the domain.
FORMATS = ["reel", "carousel"]
CAPTURE_MODES = ["longform-clip", "native-short", "repurpose"]
IN_FLIGHT = ["created", "ingesting", "transcribing", "analyzing"]
OPEN_STAGES = ["outlier", "scripted", "staged", "sourced"]
GATED = {"off": [], "supervised": ["scripted", "ready", "scheduled"], "semi": ["scheduled"], "hands_off": []}
GATE_REASONS = {"scripted": "review the script", "ready": "review the reel", "scheduled": "approve the post"}
WORDS_PER_SECOND, LEAST_SECONDS, MOST_SECONDS = 2.5, 4.0, 120.0
MAX_TRIES, WEEKLY_TARGET = 2, 3
INTERRUPTED = "The engine was restarted while this video was being analyzed. Nothing is lost - press Retry to pick it up again."

RENDER_LOST = "The engine was restarted during this export. Press Export again."


def spoken(c: str = "spoken_line") -> Column:
    return stripped(F.coalesce(F.col(c), F.lit(""))) != ""


def settled(config: DataFrame) -> DataFrame:
    """Configurations with their defaults: brand, target, level, feed, angles and hook_seeds without blanks, banned, proof_rules, platforms."""
    if "hook_seeds" not in config.columns:
        config = config.withColumn("hook_seeds", F.lit(None).cast("array<string>"))
    listed = lambda c: F.filter(F.coalesce(F.col(c), F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    target = F.when(F.coalesce("reels_per_week", F.lit(0)) == 0, WEEKLY_TARGET).otherwise(F.col("reels_per_week"))
    level = F.when(F.col("autonomy").isin(list(GATED)), F.col("autonomy")).otherwise("supervised")
    return config.select("brand", target.cast("int").alias("target"), level.alias("level"), F.coalesce("feed", F.lit(False)).alias("feed"), listed("angles").alias("angles"), listed("banned").alias("banned"), F.coalesce("proof_rules", F.lit(False)).alias("proof_rules"), listed("platforms").alias("cadence_platforms"), listed("hook_seeds").alias("hook_seeds"))


def one_of(values: list[str], c: str) -> Column:
    return F.coalesce(F.col(c).isin(values), F.lit(False))


def video_names(clips: DataFrame, tickets: DataFrame, projects: DataFrame) -> DataFrame:
    """A display name for each video; a clip of a caption project or with markers is a reel, named as its project."""
    p = projects.select(F.col("id").alias("project_id"), F.col("name"), "mode")
    j = clips.join(p, "project_id", "left")
    reel = filled("markers") | (F.coalesce("mode", F.lit("")) == "caption")
    name = F.when(reel, said(F.col("name"), F.concat(F.lit("Reel "), "id"))).otherwise(said(F.col("title"), F.concat(F.lit("Clip "), F.col("idx") + 1)))
    a = j.select(F.lit("clip").alias("kind"), "id", name.alias("name"), reel.alias("is_reel"))
    hook = first_text(F.col("hook_text"), F.col("angle"))
    b = tickets.select(F.lit("reel").alias("kind"), "id", said(hook, F.concat(F.lit("Reel "), "id")).alias("name"), F.lit(True).alias("is_reel"))
    return a.unionByName(b)


def video_brand(clips: DataFrame, tickets: DataFrame, projects: DataFrame) -> DataFrame:
    """A clip's brand: its own, its project's, that of the project's first ticket, or none; a reel has its ticket's."""
    p = projects.select(F.col("id").alias("project_id"), F.col("brand").alias("project_brand"))
    first = tickets.groupBy("project_id").agg(F.min_by("brand", "id").alias("ticket_brand"))
    j = clips.join(p, "project_id", "left").join(first, "project_id", "left")
    a = j.select(F.lit("clip").alias("kind"), "id", F.coalesce(first_text(F.col("brand"), F.col("project_brand"), F.col("ticket_brand")), F.lit("")).alias("brand"))
    return a.unionByName(tickets.select(F.lit("reel").alias("kind"), "id", F.coalesce("brand", F.lit("")).alias("brand")))


def ticket_validation(tickets: DataFrame) -> DataFrame:
    """The first field outside its domain, or null where all are inside."""
    bad = F.coalesce(*[F.when(~one_of(v, c), c) for c, v in (("format", FORMATS), ("capture_mode", CAPTURE_MODES), ("stage", STAGES))])
    return tickets.select("id", bad.alias("rejected_for"), bad.isNull().alias("accepted"))


def exports(clips: DataFrame, tickets: DataFrame, projects: DataFrame) -> DataFrame:
    """What can be exported, with its title, file name, group and subgroup: reels by brand, plain clips by project."""
    told = video_names(clips, tickets, projects).join(video_brand(clips, tickets, projects), ["kind", "id"])
    names = projects.select(F.col("id").alias("project_id"), F.col("name").alias("project"))
    c = clips.where("status = 'rendered'").select(F.lit("clip").alias("kind"), "id", "project_id", "folder").join(names, "project_id", "left")
    t = tickets.where("clip_url is not null").select(F.lit("reel").alias("kind"), "id", "folder", F.lit(None).cast("string").alias("project"))
    j = c.drop("project_id").unionByName(t).join(told, ["kind", "id"])
    # fixed values: names of groups and files without their own
    project = F.coalesce("project", F.lit("Clips"))
    grp = F.coalesce(blank_to_null(F.col("folder")), F.when(F.col("is_reel"), "Reels").otherwise(project))
    subgroup = F.when(F.col("is_reel"), F.coalesce(blank_to_null(F.col("brand")), F.lit("My videos"))).otherwise("Clips")
    fallback = F.concat(F.when(F.col("is_reel"), "reel_").otherwise("clip_"), "id")
    return j.select("kind", "id", F.col("name").alias("title"), grp.alias("grp"), subgroup.alias("subgroup"), safe_name(F.col("name"), fallback).alias("filename"))


def pickups(projects: DataFrame, n: int = 8) -> DataFrame:
    """Ready projects, the last opened first, then the newest."""
    ready = projects.where("status = 'ready'")
    return ready.orderBy(F.desc_nulls_last("last_opened"), F.desc("id")).limit(n).select("id", "name", F.coalesce(blank_to_null(F.col("folder")), F.when(F.col("mode") == "caption", "Reels")).alias("folder"))


def progress(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """Tickets with the numbers of beats, clips and voices; aggregated before the join."""
    per = beats.groupBy(F.col("ticket_id").alias("id")).agg(F.count("*").alias("n_beats"), F.count_if(filled("clip_path")).alias("n_clips"), F.count_if(filled("voiceover_path")).alias("n_vo"))
    return tickets.join(per, "id", "left").fillna(0, ["n_beats", "n_clips", "n_vo"])


def next_step(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """What a ticket needs next; only native shorts are built from scenes."""
    p = progress(tickets, beats)
    step = (
        F.when(filled("clip_url"), "done")
        .when(F.coalesce("capture_mode", F.lit("")) != "native-short", "footage")
        .when(F.col("n_beats") == 0, "script")
        .when(F.col("n_clips") < F.col("n_beats"), "clips")
        .when(~F.coalesce("auto_voiceover", F.lit(False)) & (F.col("n_vo") == 0), "voice")
        .otherwise("build")
    )
    return p.select("id", step.alias("step"))


def intake_board(intake: DataFrame, tickets: DataFrame, beats: DataFrame, n: int = 60) -> DataFrame:
    """The newest takes that aren't discarded, with what they are assigned to."""
    newest = intake.where("status <> 'discarded'").orderBy(F.desc("id")).limit(n).select("id", "filename", "status", "ticket_id", "beat_id")
    t = tickets.select(F.col("id").alias("ticket_id"), F.coalesce(blank_to_null(F.col("hook_text")), F.col("angle")).alias("ticket"))
    b = beats.select(F.col("id").alias("beat_id"), F.substring("spoken_line", 1, 40).alias("beat"))
    return newest.join(t, "ticket_id", "left").join(b, "beat_id", "left").select("id", "filename", "status", "ticket", "beat")


def open_beats(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """Beats with words and no footage, of native shorts that aren't assembled yet, with the line to say and the ticket's label."""
    label = F.coalesce(first_text(F.col("hook_text"), F.col("angle")), F.concat(F.lit("video "), "id"))
    early = tickets.where(F.col("stage").isin(OPEN_STAGES) & (F.col("capture_mode") == "native-short")).select(F.col("id").alias("ticket_id"), label.alias("ticket_label"))
    line = F.coalesce(first_text(F.col("spoken_line"), F.col("caption")), F.lit(""))
    wanted = beats.where(~filled("clip_path")).withColumn("line", line).where(stripped(F.col("line")) != "")
    return wanted.join(early, "ticket_id").select("ticket_id", F.col("id").alias("beat_id"), "order_index", "line", "ticket_label")


def proof_gaps(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """Tickets with a proof beat that has no footage."""
    gaps = beats.where(F.col("is_proof_beat") & ~filled("clip_path")).select(F.col("ticket_id").alias("id"))
    return tickets.join(gaps, "id", "left_semi").select("id")


def footage_ready(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """Tickets with beats, all of which have footage."""
    have = beats.groupBy(F.col("ticket_id").alias("id")).agg(F.bool_and(filled("clip_path")).alias("all_filled"))
    return tickets.join(have.where("all_filled"), "id", "left_semi").select("id")


def cadence_backlog(tickets: DataFrame, config: DataFrame) -> DataFrame:
    """Of each brand its autopilot tickets that aren't posted, its weekly target and what is missing."""
    flying = tickets.where(F.col("autopilot") & (F.col("stage") != "posted")).groupBy("brand").agg(F.count("*").alias("in_flight"))
    j = settled(config).join(flying, "brand", "left").fillna(0, ["in_flight"])
    return j.select("brand", "target", "in_flight", F.greatest(F.col("target") - F.col("in_flight"), F.lit(0)).alias("missing"))


def script_gate(tickets: DataFrame, beats: DataFrame, config: DataFrame) -> DataFrame:
    """Seconds that a script takes to say and the first reason why it fails: no scene, no hook, a banned phrase in what
    is spoken, shown or captioned, a number without a proof scene where the brand asks for one, or its length."""
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    n = F.size(F.filter(F.split(text("spoken_line"), r"\s+"), lambda t: t != ""))
    shown = F.concat_ws(" ", text("spoken_line"), text("on_screen_text"), text("caption"))
    ordered = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "id", shown.alias("t")))), lambda x: x["t"]), " ")
    states = F.concat_ws(" ", text("spoken_line"), text("on_screen_text")).rlike(r"\p{Nd}")
    per = beats.groupBy(F.col("ticket_id").alias("tid")).agg(F.sum(n).alias("tokens"), F.lower(ordered).alias("blob"), F.bool_or(states).alias("states"), F.bool_or("is_proof_beat").alias("proved"))
    j = tickets.join(per, F.col("id") == F.col("tid"), "left").join(settled(config).select("brand", "banned", "proof_rules"), "brand", "left")
    seconds = F.coalesce("tokens", F.lit(0)) / WORDS_PER_SECOND
    hit = F.get(F.filter(F.transform("banned", F.lower), lambda p: F.contains(F.col("blob"), p)), F.lit(0))
    # fixed values: what the gate says
    why = (
        F.when(F.col("tokens").isNull(), "no scenes were written")
        .when(~spoken("hook_text"), "missing a hook (the first line)")
        .when(hit.isNotNull(), F.concat(F.lit('uses an off-brand / non-compliant phrase: "'), hit, F.lit('"')))
        .when(F.coalesce("proof_rules", F.lit(False)) & F.col("states") & ~F.col("proved"), "states a real number but no proof scene is marked")
        .when(seconds < LEAST_SECONDS, F.format_string("script too short (~%.0fs of spoken content)", seconds))
        .when(seconds > MOST_SECONDS, F.format_string("script too long (~%.0fs spoken)", seconds))
    )
    return j.select(F.col("id").alias("ticket_id"), seconds.alias("seconds"), why.alias("reason"), why.isNull().alias("passed"))


def reel_score(tickets: DataFrame, beats: DataFrame, ai: bool = False) -> DataFrame:
    """A quality score from the number of beats, proofs and a hook."""
    per = beats.groupBy(F.col("ticket_id").alias("id")).agg(F.count("*").alias("n"), F.count_if("is_proof_beat").alias("proof"), F.min_by("spoken_line", "order_index").alias("opening"))
    j = tickets.join(per, "id", "left").fillna(0, ["n", "proof"])
    hook = (spoken("hook_text") | spoken("opening")).cast("long")  # blanks are no hook
    if ai:
        score = F.least(F.lit(98), 90 + F.col("n") % 5 + F.least(F.col("proof"), F.lit(3)))
    else:
        score = F.greatest(F.lit(60), F.least(F.lit(96), 72 + F.least(F.col("n"), F.lit(8)) + F.least(2 * F.col("proof"), F.lit(6)) + 6 * hook))
    return j.select("id", score.alias("score"))


def queue_board(tickets: DataFrame, n_posted: int = 20) -> DataFrame:
    """Lanes: assembled or ready with a clip, scheduled by time, undated last, and the last posted; rows in the board's order."""
    posted = tickets.where("stage = 'posted'").orderBy(F.desc_nulls_last("posted_at"), "id").limit(n_posted)
    ready = tickets.where(F.col("stage").isin("assembled", "ready") & filled("clip_url"))
    lanes = ready.withColumn("lane", F.lit("ready")).unionByName(tickets.where("stage = 'scheduled'").withColumn("lane", F.lit("scheduled"))).unionByName(posted.withColumn("lane", F.lit("posted")))
    first = F.when(F.col("lane") == "ready", 0).when(F.col("lane") == "scheduled", 1).otherwise(2)
    at = F.when(F.col("lane") == "scheduled", F.col("scheduled_at")).when(F.col("lane") == "posted", F.col("posted_at"))
    order = [first, F.asc_nulls_last(F.when(F.col("lane") == "scheduled", at)), F.desc_nulls_last(F.when(F.col("lane") == "posted", at)), F.col("id")]
    return lanes.orderBy(*order).select("lane", "id", F.date_format(at, "yyyy-MM-dd HH:mm").alias("at_time"))


def custom_details(beats: DataFrame) -> DataFrame:
    """Beats whose on-screen text says something, or whose caption differs from what is spoken."""
    own = lambda c: F.trim(F.coalesce(F.col(c), F.lit("")))
    return beats.select("id", ((own("on_screen_text") != "") | ((own("caption") != "") & (F.col("caption") != F.col("spoken_line")))).alias("custom"))


def reel_script(beats: DataFrame) -> DataFrame:
    """The spoken lines of a ticket in order, joined by spaces."""
    lines = F.sort_array(F.collect_list(F.struct("order_index", F.trim("spoken_line").alias("t"))))
    return beats.where(spoken()).groupBy("ticket_id").agg(F.array_join(F.transform(lines, lambda x: x["t"]), " ").alias("script"))


def next_stage(c: Column) -> Column:
    """One hop on; null for the last stage and for what isn't one."""
    stages = F.array(*map(F.lit, STAGES))
    at = F.array_position(stages, c)
    return F.when(at > 0, F.get(stages, at.cast("int")))


def plan_next(tickets: DataFrame) -> DataFrame:
    return tickets.select("id", "stage", next_stage(F.col("stage")).alias("next_stage"))


def gated(brand_level: Column, stage: Column) -> Column:
    """Whether a person must approve the entry of a stage at a level of autonomy; an unset level is supervised."""
    asks = F.coalesce(*[F.when(brand_level == k, stage.isin(v) if v else F.lit(False)) for k, v in GATED.items()], stage.isin(GATED["supervised"]))
    return F.coalesce(asks, F.lit(False))


def gate_entry(tickets: DataFrame, config: DataFrame) -> DataFrame:
    """Whether a ticket's next stage is one at which its brand waits for approval."""
    j = tickets.withColumn("next_stage", next_stage(F.col("stage"))).join(settled(config).select("brand", "level"), "brand", "left")
    return j.select("id", "next_stage", gated(F.col("level"), F.col("next_stage")).alias("gated"))


def missing_footage(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """id and the number of beats without footage of native shorts; other tickets miss none."""
    per = beats.where(~filled("clip_path")).groupBy(F.col("ticket_id").alias("id")).agg(F.count("*").alias("missing"))
    return tickets.where("capture_mode = 'native-short'").select("id").join(per, "id")


def tick_outcome(tickets: DataFrame, beats: DataFrame, config: DataFrame) -> DataFrame:
    """One tick of the autopilot: each ticket on it waits, is done, lacks footage, is retried or parked, or goes one stage
    on, where it may stop at a gate. A footage gate clears itself; `failure` is what the stage's work gave, null if it
    went well; `tries` are the failures of this stage before."""
    j = tickets.where("autopilot").join(missing_footage(tickets, beats), "id", "left").join(gate_entry(tickets, config), "id", "left")
    held = F.coalesce("gate", F.lit(""))
    lacking = F.col("missing").isNotNull()
    checks = F.col("stage") == "staged"  # the stage whose work is to look for footage
    failed = ~checks & F.col("failure").isNotNull() & (F.col("stage") != "scripted")  # staging can't fail
    outcome = (
        F.when((held == "awaiting_footage") & lacking, "waiting")
        .when(held.isin("awaiting_approval", "parked"), "waiting")
        .when(F.col("stage") == "posted", "done")
        .when(~one_of(STAGES, "stage"), "noop")
        .when(checks & lacking, "footage")
        .when(failed & (F.col("tries") + 1 > MAX_TRIES), "parked")
        .when(failed, "retry")
        .when(F.col("gated"), "gated")
        .otherwise("advanced")
    )
    t = j.withColumn("outcome", outcome)
    is_ = lambda *o: F.col("outcome").isin(*o)
    reasons = F.coalesce(*[F.when(F.col("next_stage") == k, v) for k, v in GATE_REASONS.items()], F.lit("review"))
    gate = F.when(is_("waiting"), F.col("gate")).when(is_("done"), "done").when(is_("footage"), "awaiting_footage").when(is_("parked"), "parked").when(is_("gated"), "awaiting_approval")
    why = F.when(is_("footage"), F.concat(F.col("missing").cast("string"), F.lit(" scene(s) still need footage"))).when(is_("parked"), F.col("failure")).when(is_("gated"), reasons)
    after = F.when(is_("gated", "advanced"), F.col("next_stage")).otherwise(F.col("stage"))
    tries = F.when(is_("parked", "retry"), F.col("tries") + 1).otherwise(F.col("tries"))
    error = F.when(is_("parked", "retry"), F.substring("failure", 1, 400))
    return t.select("id", "stage", "outcome", after.alias("stage_after"), gate.alias("gate_after"), why.alias("gate_reason"), tries.alias("tries_after"), error.alias("last_error"))


def entry_of(platform: Column) -> Column:
    return F.col("post_meta")[platform]


def has_copy(entry: Column) -> Column:
    """Anything to publish: a caption, title or description that isn't blank."""
    parts = [stripped(F.coalesce(entry[c], F.lit(""))) != "" for c in ("caption", "title", "description")]
    return F.coalesce(parts[0] | parts[1] | parts[2], F.lit(False))


def post_gate(tickets: DataFrame) -> DataFrame:
    """Why a post can't go out: no platform, or the first platform without copy."""
    platforms = F.coalesce("platforms", F.array().cast("array<string>"))
    bare = F.get(F.filter(platforms, lambda p: ~has_copy(entry_of(p))), F.lit(0))
    # fixed values: what the gate says
    why = F.when(F.size(platforms) == 0, "no target platforms are set").when(bare.isNotNull(), F.concat(F.lit("missing post copy for "), bare))
    return tickets.select("id", why.alias("reason"), why.isNull().alias("passed"))


def feed_plan(tickets: DataFrame, config: DataFrame) -> DataFrame:
    """The angle that each brand which opted in and is below its target takes next, by rotation over all its tickets."""
    total = tickets.groupBy("brand").agg(F.count("*").alias("total"))
    j = cadence_backlog(tickets, config).join(settled(config).select("brand", "feed", "angles"), "brand").join(total, "brand", "left").fillna(0, ["total"])
    open_ = j.where(F.col("feed") & (F.col("missing") > 0) & (F.size("angles") > 0))
    return open_.select("brand", "missing", F.element_at("angles", (F.col("total") % F.size("angles") + 1).cast("int")).alias("angle"))


def next_slot(tickets: DataFrame, config: DataFrame) -> DataFrame:
    """When a ticket would be posted: the hours between posts after its last date, at least six."""
    gap = F.greatest(F.lit(6), F.floor(F.lit(168) / F.greatest(F.lit(1), F.col("target")))).cast("int")
    base = F.coalesce("scheduled_at", "posted_at")
    j = tickets.where(base.isNotNull()).join(settled(config), "brand")
    return j.select("id", gap.cast("long").alias("gap_hours"), F.date_format(F.timestamp_add("HOUR", gap, base), "yyyy-MM-dd HH:mm").alias("slot"))


def recover_interrupted(projects: DataFrame) -> DataFrame:
    """Work that was under way when a process ended is an error now, with a message and the stage it was in."""
    lost = one_of(IN_FLIGHT, "status")
    stage = F.when(lost, F.concat(F.lit("Interrupted: "), F.coalesce(blank_to_null(F.col("stage")), F.lit("starting")))).otherwise(F.col("stage"))
    return projects.select("id", F.when(lost, "error").otherwise(F.col("status")).alias("status"), F.when(lost, INTERRUPTED).alias("error"), stage.alias("stage"), lost.alias("recovered"))


def recover_renders(clips: DataFrame) -> DataFrame:
    """A clip whose export was under way when a process ended is an error now, without a stage."""
    lost = one_of(["rendering"], "status")
    return clips.select("id", F.when(lost, "error").otherwise(F.col("status")).alias("status"), F.when(lost, "").otherwise(F.col("stage")).alias("stage"), F.when(lost, RENDER_LOST).alias("error"), lost.alias("recovered"))


def regenerated(tickets: DataFrame, note: str = "") -> DataFrame:
    """Tickets after being sent back: one stage earlier, no gate, no tries, the note, if any, in the angle."""
    stages = F.array(*map(F.lit, STAGES))
    at = F.array_position(stages, F.col("stage"))
    angle = F.col("angle") if not note else F.when(filled("angle"), F.concat("angle", F.lit(f"  [note: {note}]"))).otherwise(note)
    return tickets.select("id", F.get(stages, F.greatest(at - 2, F.lit(0)).cast("int")).alias("stage"), F.lit(None).cast("string").alias("gate"), F.lit(0).cast("long").alias("tries"), angle.alias("angle"))


def switched(tickets: DataFrame, on: Column) -> DataFrame:
    """Autopilot switched on or off; off clears the gate. Rejecting a ticket is switching it off."""
    return tickets.select("id", on.alias("autopilot"), F.when(on, F.col("gate")).alias("gate"))


def approved(tickets: DataFrame) -> DataFrame:
    """Approval clears a gate that waits for it or for footage, and no other."""
    return tickets.select("id", F.when(~one_of(["awaiting_approval", "awaiting_footage"], "gate"), F.col("gate")).alias("gate"))


def autopilot_queue(tickets: DataFrame) -> DataFrame:
    """Tickets on autopilot, newest first, with what they wait for."""
    kind = F.coalesce(blank_to_null(F.col("gate")), F.when(F.col("stage") == "posted", "done").otherwise("running"))
    return tickets.where("autopilot").select("id", kind.alias("kind")).orderBy(F.desc("id"))


#: What ends a line of text, and the tags of every post.
LINE_ENDS = "\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x85  ]"
TAGS = ["#shorts", "#reels", "#fyp"]


def post_copy(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """caption, hashtags, title (of at most 70 characters) and description for each ticket, from its hook and script."""
    say = F.coalesce(first_text(F.col("spoken_line"), F.col("caption")), F.lit(""))
    script = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("order_index", "id", say.alias("t")))), lambda x: x["t"]), "\n")
    lines = F.filter(F.transform(F.split("script", LINE_ENDS), stripped), lambda x: x != "")
    j = tickets.join(beats.groupBy(F.col("ticket_id").alias("tid")).agg(script.alias("script")), F.col("id") == F.col("tid"), "left")
    j = j.withColumn("lines", F.coalesce(lines, F.array().cast("array<string>")))
    caption = stripped(F.coalesce(blank_to_null(F.col("hook_text")), F.get("lines", F.lit(0)), F.lit("New video")))
    slug = F.regexp_replace(F.lower(F.coalesce("brand", F.lit(""))), "[^a-z0-9]", "")
    tags = F.concat_ws(" ", F.when(slug != "", F.concat(F.lit("#"), slug)), *map(F.lit, TAGS))
    about = F.coalesce(blank_to_null(F.array_join(F.slice("lines", 1, 2), " ")), caption)
    return j.select("id", caption.alias("caption"), tags.alias("hashtags"), F.substring(caption, 1, 70).alias("title"), about.alias("description"))


def post_meta_fill(tickets: DataFrame, beats: DataFrame, config: DataFrame) -> DataFrame:
    """A row of copy for each platform of a ticket: what it has stays, only a missing platform gets generated copy."""
    empty = F.array().cast("array<string>")
    listed = lambda c: F.when(F.size(F.coalesce(F.col(c), empty)) > 0, F.col(c))
    platforms = F.coalesce(listed("platforms"), listed("cadence_platforms"), F.array(*map(F.lit, PLATFORMS)))
    made = post_copy(tickets, beats).select("id", *[F.col(c).alias(f"new_{c}") for c in ("caption", "hashtags", "title", "description")])
    j = tickets.join(settled(config).select("brand", "cadence_platforms"), "brand", "left").join(made, "id").withColumn("platform", F.explode(platforms))
    entry = lambda *v: F.struct(*[x.alias(c) for c, x in zip(COPY, v, strict=True)])
    no = F.lit("")
    plain = F.coalesce(first_text(F.col("hook_text"), F.col("angle")), F.lit("New video"))
    new = (
        F.when(F.col("platform").isin("tt", "ig"), entry(F.col("new_caption"), F.col("new_hashtags"), no, no, no))
        .when(F.col("platform") == "yt", entry(no, no, F.col("new_title"), F.col("new_description"), no))
        .otherwise(entry(plain, no, no, no, no))
    )
    return j.withColumn("e", F.coalesce(entry_of(F.col("platform")), new)).select("id", "platform", "e.*")


def publish_caption(tickets: DataFrame, platform: str | None = None, order: list[str] = PLATFORMS) -> DataFrame:
    """What is sent with a post: caption or title with hashtags or tags of the platform, or of the first that has any;
    else the older captions, else hook or angle. Without a platform, platforms are tried in `order`."""
    one = lambda a, b: stripped(F.coalesce(first_text(a, b), F.lit("")))
    texts = []
    for p in [platform] if platform else order:
        e = entry_of(F.lit(p))
        texts.append(blank_to_null(F.concat_ws(" ", blank_to_null(one(e["caption"], e["title"])), blank_to_null(one(e["hashtags"], e["tags"])))))
    old = [blank_to_null(F.col("captions")[p]) for p in ([platform] if platform else []) + order]
    return tickets.select("id", F.coalesce(*texts, *old, first_text(F.col("hook_text"), F.col("angle")), F.lit("")).alias("caption"))


#: Names of the platforms.
PLATFORM_NAMES = {"tt": "TikTok", "ig": "Instagram", "yt": "YouTube"}


def publications(tickets: DataFrame) -> DataFrame:
    """What a publisher without credentials would do for each ticket: a row for each known platform, or for all if none is known."""
    names = F.create_map(*[F.lit(x) for p in PLATFORM_NAMES.items() for x in p])
    known = F.filter(F.coalesce("platforms", F.array().cast("array<string>")), lambda p: p.isin(list(PLATFORM_NAMES)))
    targets = F.when(F.size(known) > 0, known).otherwise(F.array(*map(F.lit, PLATFORM_NAMES)))
    action = F.when(F.col("scheduled_at").isNotNull(), "schedule").otherwise("post")
    each = tickets.select("id", action.alias("action"), F.explode(targets).alias("platform"))
    return each.select("id", "platform", "action", F.concat(F.lit("DRY-RUN — would "), "action", F.lit(" to "), names[F.col("platform")]).alias("result"))


def migrated_captions(tickets: DataFrame) -> DataFrame:
    """Older captions as copy for each platform, for tickets that have captions and no copy yet; run twice it changes nothing."""
    c = lambda p: F.coalesce(F.col("captions")[p], F.lit(""))
    no = F.lit("")
    entry = lambda caption, about: F.struct(*[x.alias(k) for k, x in zip(COPY, (caption, no, no, about, no), strict=True)])
    new = F.create_map(F.lit("tt"), entry(c("tt"), no), F.lit("ig"), entry(c("ig"), no), F.lit("yt"), entry(no, c("yt")))
    has = F.coalesce(F.size("post_meta") > 0, F.lit(False))
    old = F.coalesce(F.size("captions") > 0, F.lit(False))
    return tickets.withColumn("post_meta", F.when(~has & old, new).otherwise(F.col("post_meta")))


def next_ordinal(tickets: DataFrame, beats: DataFrame) -> DataFrame:
    """The place that each ticket's next beat takes: 0 for a ticket without beats."""
    last = beats.groupBy("ticket_id").agg(F.max("order_index").alias("last"))
    return tickets.select(F.col("id").alias("ticket_id")).join(last, "ticket_id", "left").select("ticket_id", (F.coalesce("last", F.lit(-1)) + 1).cast("long").alias("order_index"))
