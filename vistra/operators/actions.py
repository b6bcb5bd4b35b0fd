"""Model replies: parsing, validation against the packet or relation they speak of, and application."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What a reply may ask for.
#: The codes of reject_reason below are fixed values too.
ACTION_TYPES = ("accept_relation", "reject_relation", "change_predicate", "refine_interval", "request_more_frames", "request_candidate_expansion", "defer_for_review")


def reply_object(text: Column) -> Column:
    """The JSON object of a reply: the text without code fences, or else what lies between its first and last brace; null without one."""
    bare = F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"(?i)^```(?:json)?\s*|\s*```$", "")
    inner = F.regexp_extract(bare, r"(?s)(\{.*\})", 1)
    whole = F.when(bare.startswith("{") & F.get_json_object(bare, "$").isNotNull(), bare)
    return F.coalesce(whole, F.when((inner != "") & F.get_json_object(inner, "$").isNotNull(), inner))


def name_of(action: Column) -> Column:
    return F.lower(F.trim(F.coalesce(action, F.lit(""))))


def validate_proposals(actions: DataFrame, packets: DataFrame, directions: DataFrame, *, budget: bool = True) -> DataFrame:
    """Each action with ``accepted`` and ``reject_reason``, and the frames and families that a request is granted.

    ``packets``: packet_id, start_frame, end_frame, displayed, available, max_additional.  ``directions``: packet_id, subject_id, object_id,
    candidates, expandable.  Only a packet's first granted expansion counts.
    """
    rows = actions.join(packets, "packet_id").join(directions, ["packet_id", "subject_id", "object_id"], "left")
    name = name_of(F.col("action"))
    evidence = F.array_sort(F.array_distinct("evidence_frames"))
    first, last = F.element_at("ev", 1), F.element_at("ev", -1)
    complete = F.col("subject_id").isNotNull() & F.col("object_id").isNotNull() & F.col("predicate").isNotNull() & F.col("rel_start").isNotNull() & F.col("rel_end").isNotNull() & F.col("evidence_frames").isNotNull() & F.col("agent_score").isNotNull()
    inside = (
        F.array_contains("candidates", F.lower(F.trim("predicate"))) & (F.col("start_frame") <= F.col("rel_start")) & (F.col("rel_start") <= F.col("rel_end")) & (F.col("rel_end") <= F.col("end_frame"))
        & (F.size("ev") > 0) & (F.col("rel_start") <= first) & (last <= F.col("rel_end")) & (F.size(F.array_except("ev", "displayed")) == 0) & F.col("agent_score").between(0, 1)
    )
    asked = F.array_sort(F.array_distinct(F.coalesce("frame_ids", F.array().cast("array<int>"))))
    frames = F.slice(F.array_except(F.array_intersect(asked, F.col("available")), F.col("displayed")), F.lit(1), F.col("max_additional"))
    families = F.array_intersect(F.array_distinct(F.coalesce("families", F.array().cast("array<string>"))), F.coalesce("expandable", F.array().cast("array<string>")))
    rows = rows.withColumns({"name": name, "ev": evidence, "granted_frames": frames, "granted_families": families})
    well = (F.col("name").isin(*ACTION_TYPES)) & (F.trim(F.coalesce("reason", F.lit(""))) != "")
    expands = well & (F.col("name") == "request_candidate_expansion") & F.lit(budget) & (F.size("granted_families") > 0)
    before = F.min(F.when(expands, F.col("ord"))).over(Window.partitionBy("packet_id"))
    rows = rows.withColumn("expanded_at", before)
    because = (
        F.when(~F.col("name").isin(*ACTION_TYPES), "unsupported_action").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "missing_reason")
        .when(F.col("name") == "accept_relation", F.when(~complete, "invalid_relation_fields").when(~F.coalesce(inside, F.lit(False)), "relation_outside_evidence_packet"))
        .when(F.col("name") == "request_more_frames", F.when(~F.lit(budget) | (F.size("granted_frames") == 0), "request_budget_or_frames_invalid"))
        .when(F.col("name") == "request_candidate_expansion", F.when(F.col("ord") > F.col("expanded_at"), "candidate_expansion_already_requested").when(F.col("subject_id").isNull() | F.col("object_id").isNull(), "invalid_candidate_expansion")
              .when(~F.lit(budget) | (F.size("granted_families") == 0), "request_budget_or_families_invalid"))
        .when(~F.col("name").isin("reject_relation", "defer_for_review"), "action_not_valid_during_proposal")
    )
    out = rows.withColumn("reject_reason", because).withColumn("accepted", F.col("reject_reason").isNull())
    none = lambda c, kind, of: F.when(F.col("accepted") & (F.col("name") == of), F.col(c)).otherwise(F.array().cast(kind))
    return out.withColumns({"granted_frames": none("granted_frames", "array<int>", "request_more_frames"), "granted_families": none("granted_families", "array<string>", "request_candidate_expansion")})


def supplemental_packets(packets: DataFrame, validated: DataFrame, expanded: DataFrame | None = None) -> DataFrame:
    """The second round: one packet for each that was granted frames or families, with no budget left.

    It shows the frames that were displayed and those granted, and has the candidates of ``expanded(packet_id, subject_id, object_id, candidates)`` where
    a direction was expanded.  Columns: packet_id (the parent's with ``:supplemental``), parent_id, displayed, max_additional, granted_families.
    """
    asked = validated.where("accepted").groupBy("packet_id").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("granted_frames")))).alias("more"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("granted_families")))).alias("granted_families")
    )
    asked = asked.where((F.size("more") > 0) | (F.size("granted_families") > 0))
    out = packets.join(asked, "packet_id").withColumn("displayed", F.array_sort(F.array_distinct(F.concat("displayed", "more"))))
    out = out.withColumns({"parent_id": F.col("packet_id"), "max_additional": F.lit(0), "packet_id": F.concat("packet_id", F.lit(":supplemental"))}).drop("more")
    if expanded is not None:
        named = expanded.groupBy("packet_id").agg(F.array_sort(F.collect_list(F.struct("subject_id", "object_id", "candidates"))).alias("directions")).withColumnRenamed("packet_id", "parent_id")
        out = out.join(named, "parent_id", "left")
    return out


def semantic_relations(validated: DataFrame) -> DataFrame:
    """Relation rows of the accepted proposals."""
    rows = validated.where("accepted and name = 'accept_relation'")
    return rows.select("packet_id", "video_id", "subject_id", F.lower(F.trim("predicate")).alias("predicate"), "object_id", F.col("rel_start").alias("start_frame"), F.col("rel_end").alias("end_frame"), F.col("ev").alias("evidence_frames"),
                       "agent_score", F.col("agent_score").alias("ranking_score"), F.lit("agent_ranking").alias("score_kind"), F.lit("window_semantic_vl").alias("source"), F.col("window_id").alias("segment_id"))


def validate_reviews(actions: DataFrame, relations: DataFrame, predicates: DataFrame) -> DataFrame:
    """Each review action with ``accepted`` and ``reject_reason``: the relation must exist, a new predicate be known, an interval only narrow."""
    kept = relations.select("relation_id", F.col("start_frame").alias("r_start"), F.col("end_frame").alias("r_end"), F.col("evidence_frames").alias("r_evidence"))
    known = F.broadcast(predicates.select(F.col("name").alias("new_name"), F.lit(True).alias("known")))
    rows = actions.join(kept, "relation_id", "left").withColumn("new_name", F.lower(F.trim("new_predicate"))).join(known, "new_name", "left")
    rows = rows.withColumns({"name": name_of(F.col("action")), "ev": F.array_sort(F.array_distinct("evidence_frames"))})
    complete = F.col("new_start").isNotNull() & F.col("new_end").isNotNull() & F.col("evidence_frames").isNotNull()
    narrows = (F.size("ev") > 0) & (F.size(F.array_except("ev", "r_evidence")) == 0) & (F.col("r_start") <= F.col("new_start")) & (F.col("new_start") <= F.element_at("ev", 1)) & (F.element_at("ev", -1) <= F.col("new_end")) & (F.col("new_end") <= F.col("r_end"))
    because = (
        F.when(~F.col("name").isin(*ACTION_TYPES) | F.col("r_start").isNull(), "unsupported_action_or_relation").when(F.trim(F.coalesce("reason", F.lit(""))) == "", "missing_reason")
        .when(F.col("name").isin("accept_relation", "reject_relation", "defer_for_review"), F.lit(None).cast("string"))
        .when(F.col("name") == "change_predicate", F.when(F.col("known").isNull(), "invalid_predicate"))
        .when(F.col("name") == "refine_interval", F.when(~complete, "invalid_interval").when(~F.coalesce(narrows, F.lit(False)), "interval_outside_relation_evidence"))
        .otherwise("supplemental_request_not_available_in_review")
    )
    return rows.withColumn("reject_reason", because).withColumn("accepted", F.col("reject_reason").isNull())


def apply_reviews(relations: DataFrame, accepted: DataFrame) -> DataFrame:
    """``relations`` after their accepted actions, in order: rejected ones go, of several changes of the same kind the last holds.

    Predicate and interval are changed by different actions, so the last of each kind is the result of applying all in turn.
    """
    last = lambda c, kind: F.max_by(c, F.when(F.col("name") == kind, F.col("ord")))
    turn = F.col("new_start") <= F.col("new_end")
    rows = accepted.where((F.col("name") != "refine_interval") | turn)
    span = last(F.struct("new_start", "new_end", "ev"), "refine_interval").alias("span")
    edits = rows.groupBy("relation_id").agg(F.max((F.col("name") == "reject_relation").cast("int")).alias("gone"), last(F.col("new_name"), "change_predicate").alias("new_name"), span)
    out = relations.join(edits, "relation_id", "left").where("coalesce(gone, 0) = 0")
    changed = F.col("new_name").isNotNull() | F.col("span").isNotNull()
    return out.withColumns({
        "predicate": F.coalesce("new_name", "predicate"), "start_frame": F.coalesce("span.new_start", "start_frame"), "end_frame": F.coalesce("span.new_end", "end_frame"),
        "evidence_frames": F.coalesce("span.ev", "evidence_frames"), "source": F.when(changed, "verify_corrected").otherwise(F.col("source")),
    }).drop("gone", "new_name", "span")


def packet_audit(packets: DataFrame, results: DataFrame) -> DataFrame:
    """packet_id, actions, state: the last result of each packet (by ``ord``); packets without a list of actions are ``missing``."""
    last = results.where("actions is not null").groupBy("packet_id").agg(F.max_by("actions", "ord").alias("actions"))
    return packets.select("packet_id").join(last, "packet_id", "left").withColumn("state", F.when(F.col("actions").isNull(), "missing").otherwise("answered"))


def split_by_storyboard(relations: DataFrame, storyboards: DataFrame, most: int = 8) -> DataFrame:
    """``relations`` with ``paths``, the first ``most`` storyboards of their pair, and ``deferred`` where there is none.

    A storyboard's name ends in ``_A<id>_B<id>.jpg``; the order of the two does not matter.
    """
    a, b = (F.regexp_extract("path", r"_A(\d+)_B(\d+)\.jpg$", i).try_cast("long") for i in (1, 2))
    s = storyboards.withColumns({"a": a, "b": b}).where("a is not null and b is not null").select("video_id", F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"), "path")
    lists = s.groupBy("video_id", "lo", "hi").agg(F.slice(F.array_sort(F.collect_set("path")), 1, most).alias("paths"))
    rows = relations.withColumns({"lo": F.least("subject_id", "object_id"), "hi": F.greatest("subject_id", "object_id")}).join(lists, ["video_id", "lo", "hi"], "left")
    return rows.withColumn("deferred", F.col("paths").isNull()).drop("lo", "hi")
